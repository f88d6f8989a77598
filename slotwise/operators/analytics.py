"""Dashboard KPIs and analytics (counts per day / department / doctor, arg-max).

Plan shape: appointment rows are first reduced to counts per
(doctor_id, appointment_date) with a map-side partial aggregate, and only that
reduced frame is shuffled and joined to ``doctors``.  A hot doctor or day
therefore never becomes one oversized task, and the join moves at most one
row per (doctor, day) instead of one row per appointment.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.text import EMPTY_CELL

ANALYTICS_WINDOW_DAYS = 30  # "last 30 days", inclusive at both ends


def _day(d) -> Column:
    return F.lit(d).cast("date") if isinstance(d, (str, dt.date)) else d


def active(appointments: DataFrame) -> DataFrame:
    """``status != 'cancelled'`` — three-valued logic drops a NULL status too."""
    return appointments.where(F.col("status") != F.lit("cancelled"))


def day_doctor_counts(appointments: DataFrame) -> DataFrame:
    """Active appointments per (doctor_id, appointment_date)."""
    return active(appointments).groupBy("doctor_id", "appointment_date").agg(F.count(F.lit(1)).alias("n"))


def _doctor_counts(appointments: DataFrame) -> DataFrame:
    return active(appointments).groupBy("doctor_id").agg(F.count(F.lit(1)).alias("n"))


def _with_doctor(counts: DataFrame, doctors: DataFrame, *cols: str) -> DataFrame:
    """Inner join of per-doctor counts to doctor attributes (dangling ids drop).

    No broadcast hint: the planner broadcasts ``doctors`` only when its
    estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE
    re-checks with the real size); beyond it this is a sort-merge join.
    """
    d = doctors.select(F.col("id").alias("doctor_id"), *cols)
    return counts.join(d, "doctor_id")


def dashboard_stats(appointments: DataFrame, patients: DataFrame, doctors: DataFrame, as_of) -> DataFrame:
    """One row: booked today, booked tomorrow, number of patients and doctors."""
    today = _day(as_of)
    tomorrow = F.date_add(today, 1)
    d = F.col("appointment_date")
    booked = appointments.where((F.col("status") == "booked") & d.between(today, tomorrow))
    kpis = booked.agg(
        F.count_if(d == today).alias("today"),
        F.count_if(d == tomorrow).alias("tomorrow"),
    )
    return kpis.select(
        "today",
        "tomorrow",
        patients.select(F.count(F.lit(1))).scalar().alias("patients"),
        doctors.select(F.count(F.lit(1))).scalar().alias("doctors"),
    )


def daily_counts(
    appointments: DataFrame, as_of, days: int = ANALYTICS_WINDOW_DAYS, fill_zero: bool = False, sort: bool = True
) -> DataFrame:
    """Active appointments per day over [as_of - days, as_of]; future days excluded.

    Days without appointments are absent unless ``fill_zero``.
    """
    end = _day(as_of)
    start = F.date_sub(end, days)
    counts = (
        active(appointments)
        .where(F.col("appointment_date").between(start, end))
        .groupBy("appointment_date")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if fill_zero:
        span = appointments.sparkSession.range(1).select(
            F.explode(F.sequence(start, end)).alias("appointment_date")
        )
        counts = span.join(counts, "appointment_date", "left").select(
            "appointment_date", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
        )
    return counts.orderBy("appointment_date") if sort else counts


def _by_attribute(appointments: DataFrame, doctors: DataFrame, attribute: str) -> DataFrame:
    per_doctor = _with_doctor(_doctor_counts(appointments), doctors, attribute)
    return per_doctor.groupBy(attribute).agg(F.sum("n").cast("bigint").alias("count"))


def counts_by_department(appointments: DataFrame, doctors: DataFrame) -> DataFrame:
    """Active appointments per department, busiest first."""
    return _by_attribute(appointments, doctors, "department").orderBy(F.desc("count"), "department")


def counts_by_doctor(appointments: DataFrame, doctors: DataFrame) -> DataFrame:
    """Active appointments per doctor *name* (namesakes merge), busiest first."""
    return _by_attribute(appointments, doctors, "name").orderBy(F.desc("count"), "name")


def counts_by_doctor_id(appointments: DataFrame, doctors: DataFrame) -> DataFrame:
    """Variant keyed by doctor id, so namesakes stay apart."""
    per_doctor = _with_doctor(_doctor_counts(appointments), doctors, "name", "department")
    return per_doctor.select(
        "doctor_id", "name", "department", F.col("n").cast("bigint").alias("count")
    ).orderBy(F.desc("count"), "doctor_id")


def month_total(appointments: DataFrame, as_of) -> DataFrame:
    """Active appointments in the calendar month of ``as_of`` (whole month)."""
    first = F.trunc(_day(as_of), "month")
    d = F.col("appointment_date")
    return (
        active(appointments)
        .where((d >= first) & (d < F.add_months(first, 1)))
        .agg(F.count(F.lit(1)).alias("month_total"))
    )


def busiest_day(appointments: DataFrame) -> DataFrame:
    """The day with most active appointments (ties: earliest day); empty if none."""
    return (
        active(appointments)
        .groupBy("appointment_date")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "appointment_date")
        .limit(1)
    )


def busiest_doctor(appointments: DataFrame, doctors: DataFrame) -> DataFrame:
    """The doctor name with most active appointments (ties: name ascending)."""
    return counts_by_doctor(appointments, doctors).limit(1)


def top_department(appointments: DataFrame, doctors: DataFrame) -> DataFrame:
    """Always one row: the busiest department, or the em dash when there is none."""
    counts = _by_attribute(appointments, doctors, "department")
    top = counts.agg(F.min_by("department", F.struct(-F.col("count"), F.col("department"))).alias("department"))
    return top.select(F.coalesce("department", F.lit(EMPTY_CELL)).alias("department"))


def analytics_bundle(appointments: DataFrame, doctors: DataFrame, as_of) -> dict[str, DataFrame]:
    """The six analytics results from one shared reduced frame.

    Appointments are scanned and reduced once to counts per (doctor, day);
    that frame is persisted (recomputable from lineage if an executor is lost)
    and every result is derived from it.
    """
    reduced = day_doctor_counts(appointments).persist()
    per_doctor = reduced.groupBy("doctor_id").agg(F.sum("n").alias("n"))
    end = _day(as_of)
    first = F.trunc(end, "month")
    d = F.col("appointment_date")
    per_day = reduced.groupBy("appointment_date").agg(F.sum("n").cast("bigint").alias("count"))
    by_dept = (
        _with_doctor(per_doctor, doctors, "department")
        .groupBy("department").agg(F.sum("n").cast("bigint").alias("count"))
        .orderBy(F.desc("count"), "department")
    )
    by_doctor = (
        _with_doctor(per_doctor, doctors, "name")
        .groupBy("name").agg(F.sum("n").cast("bigint").alias("count"))
        .orderBy(F.desc("count"), "name")
    )
    return {
        "daily": per_day.where(d.between(F.date_sub(end, ANALYTICS_WINDOW_DAYS), end)).orderBy("appointment_date"),
        "by_dept": by_dept,
        "by_doctor": by_doctor,
        "month_total": reduced.where((d >= first) & (d < F.add_months(first, 1))).agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("month_total")
        ),
        "busiest_day": per_day.orderBy(F.desc("count"), "appointment_date").limit(1),
        "busiest_doctor": by_doctor.limit(1),
    }


def chart_series(appointments: DataFrame, doctors: DataFrame, as_of) -> DataFrame:
    """The three chart series as JSON lines: (series, label, count, json)."""
    daily = daily_counts(appointments, as_of, sort=False).select(
        F.lit("daily").alias("series"),
        F.col("appointment_date").cast("string").alias("label"),
        "count",
        F.to_json(F.struct("appointment_date", "count")).alias("json"),
    )
    dept = _by_attribute(appointments, doctors, "department").select(
        F.lit("by_dept").alias("series"),
        F.col("department").alias("label"),
        "count",
        F.to_json(F.struct("department", "count")).alias("json"),
    )
    doc = _by_attribute(appointments, doctors, "name").select(
        F.lit("by_doctor").alias("series"),
        F.col("name").alias("label"),
        "count",
        F.to_json(F.struct("name", "count")).alias("json"),
    )
    return daily.unionByName(dept).unionByName(doc)
