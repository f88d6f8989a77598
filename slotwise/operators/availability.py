"""Slot grids, bookable dates, free slots and the availability calendar.

Per-doctor lists (dates, slot grid) are built as arrays inside one row, so
they need no shuffle; each array is bounded by construction (the grid by the
minutes of a day, the dates by the search horizon).  Booked slots are reduced
to one deduplicated set per (doctor, day) with a map-side partial aggregate
before they meet the candidates, so a heavily double-booked slot or a hot
doctor never piles up in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.clock import hhmm_to_minutes, minutes_to_hhmm, weekday_token, working_day_tokens
from slotwise.functions.text import fmt_day, numbered_list

# Dates are searched on days 1 .. days_ahead + 13 after as_of
# and at most five are offered.
DAYS_AHEAD = 7
EXTRA_SEARCH_DAYS = 13
MAX_DATES = 5


def _day(d) -> Column:
    return F.lit(d).cast("date") if isinstance(d, (str, dt.date)) else d


def slot_minutes(start: Column | str = "start_time", end: Column | str = "end_time",
                 duration: Column | str = "slot_duration_mins") -> Column:
    """Minute offsets of the half-open grid [start, end) every ``duration``.

    The last slot may run past ``end``.  An inverted window or a duration
    <= 0 gives an empty grid (``sequence`` would fail on either).
    """
    s, e = hhmm_to_minutes(start), hhmm_to_minutes(end)
    d = F.col(duration) if isinstance(duration, str) else duration
    return F.when((s < e) & (d > 0), F.sequence(s, e - 1, d)).otherwise(F.array().cast("array<int>"))


def slot_times(**kw) -> Column:
    """The grid as ``HH:mm`` strings."""
    return F.transform(slot_minutes(**kw), lambda m: minutes_to_hhmm(m))


def slot_grid(doctors: DataFrame) -> DataFrame:
    """One row per (doctor, slot) of the daily grid."""
    return doctors.select(
        F.col("id").alias("doctor_id"), F.posexplode(slot_times()).alias("pos", "slot_time")
    ).select("doctor_id", (F.col("pos") + 1).alias("slot_no"), "slot_time")


def _leave_sets(leaves: DataFrame, first: Column, last: Column) -> DataFrame:
    """Leave days inside the horizon, as one set per doctor (bounded by the horizon)."""
    return (
        leaves.where(F.col("leave_date").between(first, last))
        .groupBy("doctor_id")
        .agg(F.collect_set("leave_date").alias("_leaves"))
    )


def with_date_menu(doctors: DataFrame, leaves: DataFrame, as_of, days_ahead: int = DAYS_AHEAD,
                   max_dates: int = MAX_DATES) -> DataFrame:
    """Doctors with ``dates``: the next bookable days (working day, not on
    leave, today excluded), at most ``max_dates``.  Fully booked days are
    still offered."""
    today = _day(as_of)
    horizon = days_ahead + EXTRA_SEARCH_DAYS
    lv = _leave_sets(leaves, F.date_add(today, 1), F.date_add(today, horizon))
    d = doctors.withColumn("_days", working_day_tokens("available_days"))
    d = d.join(lv, d["id"] == lv["doctor_id"], "left").drop(lv["doctor_id"])
    candidates = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.date_add(today, i))
    open_days = F.filter(
        candidates,
        lambda x: F.array_contains(F.col("_days"), weekday_token(x))
        & ~F.coalesce(F.array_contains(F.col("_leaves"), x), F.lit(False)),
    )
    return d.withColumn("dates", F.slice(open_days, 1, max_dates)).drop("_days", "_leaves")


def available_dates(doctors: DataFrame, leaves: DataFrame, as_of, **kw) -> DataFrame:
    """One row per (doctor, offered date) with its menu number."""
    return with_date_menu(doctors, leaves, as_of, **kw).select(
        F.col("id").alias("doctor_id"), F.posexplode("dates").alias("pos", "available_date")
    ).select("doctor_id", (F.col("pos") + 1).alias("date_no"), "available_date")


def booked_slot_sets(appointments: DataFrame, day_filter: Column | None = None) -> DataFrame:
    """Distinct booked slot times per (doctor, day).  Only ``booked`` blocks a
    slot; cancelled and completed free it."""
    a = appointments.where(F.col("status") == "booked")
    if day_filter is not None:
        a = a.where(day_filter)
    return a.groupBy("doctor_id", "appointment_date").agg(F.collect_set("slot_time").alias("_booked"))


def _free(grid: Column) -> Column:
    return F.array_except(grid, F.coalesce(F.col("_booked"), F.array().cast("array<string>")))


def available_slots(doctors: DataFrame, appointments: DataFrame, requested: DataFrame) -> DataFrame:
    """Free slots for each requested (doctor_id, appointment_date), in grid
    order, numbered as the slot menu shows them.  Unknown doctors get none."""
    req = requested.select("doctor_id", "appointment_date").distinct()
    grids = doctors.select(F.col("id").alias("doctor_id"), slot_times().alias("_grid"))
    booked = booked_slot_sets(appointments)
    pairs = req.join(grids, "doctor_id").join(booked, ["doctor_id", "appointment_date"], "left")
    return pairs.select(
        "doctor_id", "appointment_date", F.posexplode(_free(F.col("_grid"))).alias("pos", "slot_time")
    ).select("doctor_id", "appointment_date", (F.col("pos") + 1).alias("slot_no"), "slot_time")


def availability_calendar(doctors: DataFrame, leaves: DataFrame, appointments: DataFrame, as_of,
                          **kw) -> DataFrame:
    """The whole booking menu as one table: department → doctor → date → free slot."""
    today = _day(as_of)
    horizon = kw.get("days_ahead", DAYS_AHEAD) + EXTRA_SEARCH_DAYS
    menu = with_date_menu(doctors, leaves, as_of, **kw).select(
        "department", F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"),
        slot_times().alias("_grid"), F.posexplode("dates").alias("pos", "appointment_date"),
    )
    booked = booked_slot_sets(
        appointments, F.col("appointment_date").between(F.date_add(today, 1), F.date_add(today, horizon))
    )
    days = menu.join(booked, ["doctor_id", "appointment_date"], "left")
    return days.select(
        "department", "doctor_id", "doctor_name", (F.col("pos") + 1).alias("date_no"),
        "appointment_date", F.posexplode(_free(F.col("_grid"))).alias("spos", "slot_time"),
    ).select(
        "department", "doctor_id", "doctor_name", "date_no", "appointment_date",
        (F.col("spos") + 1).alias("slot_no"), "slot_time",
    )


def date_menu_text(doctors: DataFrame, leaves: DataFrame, as_of, **kw) -> DataFrame:
    """The numbered date menu a patient sees for each doctor ('' if none)."""
    return with_date_menu(doctors, leaves, as_of, **kw).select(
        F.col("id").alias("doctor_id"),
        numbered_list(F.transform("dates", lambda d: fmt_day(d))).alias("menu_text"),
    )


def display_dates(appointments: DataFrame) -> DataFrame:
    """Display label of every appointment day (``Tue, 10 Jun``)."""
    return appointments.select("appointment_date").distinct().select(
        "appointment_date", fmt_day("appointment_date").alias("label")
    )
