"""Ledger maintenance as snapshot → snapshot functions.

Parquet tables cannot be updated in place, so every mutation of the
source application (book, cancel, complete, leave insert / cascade / delete, patient
and session upserts) is a pure function from the current snapshot plus a
DataFrame of commands to the next snapshot (and, where the source application replies
or notifies, a DataFrame of outcomes).  Persist a result with
:func:`slotwise.sources.sinks.write_snapshot`.

Per-key "first" / "latest" picks are aggregates (``min``/``max`` over a
struct), which combine map-side, so a hot phone or slot is reduced before it
is shuffled.  Ranks that the semantics need (tokens, k-th cancel) use the
sliced :func:`number_rows`.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.text import normalize_phone, parse_day
from slotwise.plans.numbering import id_slice, number_rows
from slotwise.schemas import DEFAULT_STEP, DEFAULT_TEMP_DATA

# Booking outcomes, in the order the checks are applied.
UNKNOWN_DOCTOR = "unknown_doctor"
ON_LEAVE = "on_leave"
SLOT_TAKEN = "slot_taken"
ACCEPTED = "accepted"
CANCELLED = "cancelled"
NOT_FOUND = "not_found"

LEDGER_COLUMNS = (
    "id", "patient_phone", "patient_name", "doctor_id", "appointment_date", "slot_time",
    "token_number", "status",
)


def _day(d) -> Column:
    return F.lit(d).cast("date") if isinstance(d, (str, dt.date)) else d


def _doctor_dim(doctors: DataFrame) -> DataFrame:
    return doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"), "department")


# ----------------------------------------------------------------------------- tokens, load


def token_numbers(appointments: DataFrame) -> DataFrame:
    """Token = arrival rank of a booking within its (doctor, day), all statuses."""
    return number_rows(
        appointments.select("id", "doctor_id", "appointment_date"),
        ["doctor_id", "appointment_date"],
        ["id"],
        "token_number",
        [id_slice("id")],
    )


def day_load(appointments: DataFrame) -> DataFrame:
    """Bookings per (doctor, day), all statuses — the base of the next token."""
    return appointments.groupBy("doctor_id", "appointment_date").agg(F.count(F.lit(1)).alias("count"))


# ----------------------------------------------------------------------------- next appointment


def next_appointment(appointments: DataFrame, doctors: DataFrame, from_date=None) -> DataFrame:
    """Per phone, the earliest booked (date, slot) whose doctor exists, with
    the doctor's name and department.  No ``>= today`` filter unless
    ``from_date`` is given (past bookings count, as in the source application)."""
    booked = appointments.where(F.col("status") == "booked")
    if from_date is not None:
        booked = booked.where(F.col("appointment_date") >= _day(from_date))
    joined = booked.join(_doctor_dim(doctors), "doctor_id")
    cols = [c for c in appointments.columns] + ["doctor_name", "department"]
    # A phone is the same person with and without the address prefix.
    return joined.groupBy(normalize_phone("patient_phone").alias("_key")).agg(
        F.min_by(F.struct(*cols), F.struct("appointment_date", "slot_time", "id")).alias("_a")
    ).select(*[F.col("_a")[c].alias(c) for c in cols])


# ----------------------------------------------------------------------------- booking


def _flag(df: DataFrame, flags: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.join(flags.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")


def booking_conflicts(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests whose slot already holds a booked appointment in the ledger."""
    taken = ledger.where(F.col("status") == "booked").select("doctor_id", "appointment_date", "slot_time").distinct()
    return requests.join(taken, ["doctor_id", "appointment_date", "slot_time"], "left_semi")


def leave_conflicts(requests: DataFrame, leaves: DataFrame) -> DataFrame:
    """Requests for a day the doctor is on leave."""
    days = leaves.select("doctor_id", F.col("leave_date").alias("appointment_date")).distinct()
    return requests.join(days, ["doctor_id", "appointment_date"], "left_semi")


def book_requests(ledger: DataFrame, requests: DataFrame, doctors: DataFrame, leaves: DataFrame) -> DataFrame:
    """Arbitrate a batch of booking requests against the ledger, as if they
    were processed one by one in ``id`` (arrival) order.

    Outcome per request, first match wins: ``unknown_doctor``, ``on_leave``,
    ``slot_taken`` (booked in the ledger, or by an earlier request of the
    batch), else ``accepted``.  An accepted request gets token = bookings of
    its (doctor, day) in the ledger (any status) + its rank among the
    accepted requests of that (doctor, day); rejected requests use no token.
    """
    slot = ["doctor_id", "appointment_date", "slot_time"]
    r = requests.select("id", "patient_phone", "patient_name", *slot)
    known = doctors.select(F.col("id").alias("doctor_id"))
    on_leave = leaves.select("doctor_id", F.col("leave_date").alias("appointment_date"))
    taken = ledger.where(F.col("status") == "booked").select(*slot)
    flagged = (
        _flag(r, known, ["doctor_id"], "_known")
        .transform(lambda x: _flag(x, on_leave, ["doctor_id", "appointment_date"], "_leave"))
        .transform(lambda x: _flag(x, taken, slot, "_taken"))
    )
    first_check = (
        F.when(F.col("_known").isNull(), F.lit(UNKNOWN_DOCTOR))
        .when(F.col("_leave"), F.lit(ON_LEAVE))
        .when(F.col("_taken"), F.lit(SLOT_TAKEN))
    )
    staged = flagged.withColumn("_stage", first_check)
    # Among still-open requests the earliest per slot wins (an aggregate, so
    # a slot requested by millions is combined map-side).
    winners = staged.where(F.col("_stage").isNull()).groupBy(*slot).agg(F.min("id").alias("_win"))
    decided = staged.join(winners, slot, "left").withColumn(
        "outcome",
        F.coalesce(F.col("_stage"), F.when(F.col("id") == F.col("_win"), F.lit(ACCEPTED)).otherwise(F.lit(SLOT_TAKEN))),
    ).select("id", "patient_phone", "patient_name", *slot, "outcome")

    # One numbering pass over all requests: within a (doctor, day) accepted
    # requests sort first (by id), so their position is their rank among the
    # accepted; rejected rows get no token.
    is_accepted = F.col("outcome") == ACCEPTED
    ranked = number_rows(
        decided, ["doctor_id", "appointment_date"], [~is_accepted, F.col("id")], "_rank", [~is_accepted, id_slice("id")]
    )
    prior = ledger.groupBy("doctor_id", "appointment_date").agg(F.count(F.lit(1)).alias("_prior"))
    return ranked.join(prior, ["doctor_id", "appointment_date"], "left").select(
        *decided.columns,
        F.when(is_accepted, F.coalesce("_prior", F.lit(0)) + F.col("_rank")).cast("bigint").alias("token_number"),
    )


def apply_bookings(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Next ledger snapshot: accepted requests appended as ``booked``."""
    new = outcomes.where(F.col("outcome") == ACCEPTED).select(
        "id", "patient_phone", "patient_name", "doctor_id", "appointment_date", "slot_time",
        "token_number", F.lit("booked").alias("status"),
    )
    return ledger.select(*LEDGER_COLUMNS).unionByName(new)


# ----------------------------------------------------------------------------- patients, sessions


def patient_upsert(patients: DataFrame, bookings: DataFrame, as_of) -> DataFrame:
    """Patients after an upsert by phone from accepted bookings.

    The latest booking of a phone sets its name (even to NULL); an existing
    patient keeps id and first-seen ``created_at``; a new phone gets the next
    id in order of its first booking and ``created_at`` = ``as_of``.
    """
    inc = bookings.select(
        normalize_phone("patient_phone").alias("_key"), F.col("patient_phone").alias("_phone"),
        F.col("patient_name").alias("_name"), F.col("id").alias("_req"),
    )
    latest = inc.groupBy("_key").agg(
        F.max(F.struct("_req", "_name", "_phone")).alias("_last"), F.min("_req").alias("_first")
    )
    p = patients.select("id", "name", "phone", "created_at").withColumn("_key", normalize_phone("phone"))
    merged = p.join(latest, "_key", "full")
    existing = merged.where(F.col("id").isNotNull())
    fresh = number_rows(merged.where(F.col("id").isNull()), [], ["_first"], "_new_no", [id_slice("_first")])
    max_id = patients.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = fresh.withColumn("id", max_id + F.col("_new_no")).drop("_new_no")
    created = F.lit(_day(as_of)).cast("timestamp_ntz") if isinstance(as_of, (str, dt.date)) else as_of
    return existing.unionByName(fresh).select(
        "id",
        F.when(F.col("_last").isNotNull(), F.col("_last._name")).otherwise(F.col("name")).alias("name"),
        F.coalesce("phone", F.col("_last._phone")).alias("phone"),
        F.coalesce(F.col("created_at"), created).alias("created_at"),
    )


def session_latest(updates: DataFrame) -> DataFrame:
    """Last write per phone wins, ordered by (updated_at, seq).  A phone is the
    same with and without the address prefix; it is returned without."""
    return updates.groupBy(normalize_phone("phone").alias("phone")).agg(
        F.max(F.struct("updated_at", "seq", "step", "temp_data")).alias("_s")
    ).select("phone", F.col("_s.step").alias("step"), F.col("_s.temp_data").alias("temp_data"),
             F.col("_s.updated_at").alias("updated_at"))


def session_reset(updates: DataFrame, resets: DataFrame) -> DataFrame:
    """Apply resets (phone, updated_at, seq) → step ``start`` with ``{}``."""
    r = resets.select(
        "phone", F.lit(DEFAULT_STEP).alias("step"), F.lit(DEFAULT_TEMP_DATA).alias("temp_data"),
        "updated_at", "seq",
    )
    return session_latest(updates.select("phone", "step", "temp_data", "updated_at", "seq").unionByName(r))


# ----------------------------------------------------------------------------- cancellations


def cancel_earliest(ledger: DataFrame, doctors: DataFrame, requests: DataFrame) -> DataFrame:
    """Cancel-my-appointment requests (phone, request_id, ts).

    Processed in (ts, request_id) order per phone, each request cancels the
    earliest still-booked (date, slot) appointment of that phone whose doctor
    exists — past dates included — so the k-th request takes the k-th
    earliest.  Requests beyond the phone's bookings are ``not_found``.
    """
    req = number_rows(
        requests.select(normalize_phone("phone").alias("phone_key"), "phone", "request_id", "ts"),
        ["phone_key"], ["ts", "request_id"], "k", [F.date_trunc("hour", "ts")],
    )
    asking = req.select("phone_key").distinct()
    booked = (
        ledger.where(F.col("status") == "booked")
        .withColumn("phone_key", normalize_phone("patient_phone"))
        .join(asking, "phone_key", "left_semi")
        .join(_doctor_dim(doctors), "doctor_id")
    )
    ranked = number_rows(
        booked.select("phone_key", F.col("id").alias("appointment_id"), "doctor_name", "appointment_date", "slot_time"),
        ["phone_key"], ["appointment_date", "slot_time", "appointment_id"], "k", [F.col("appointment_date")],
    )
    return req.join(ranked, ["phone_key", "k"], "left").select(
        "request_id", "phone", "k",
        F.when(F.col("appointment_id").isNotNull(), F.lit(CANCELLED)).otherwise(F.lit(NOT_FOUND)).alias("outcome"),
        "appointment_id", "doctor_name", "appointment_date", "slot_time",
    )


def set_status(ledger: DataFrame, ids: DataFrame, status: str, only_booked: bool = False) -> DataFrame:
    """Next snapshot with ``status`` set on the given appointment ids.

    Like the source application there is no status guard unless ``only_booked``;
    unknown ids change nothing.
    """
    hits = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    cond = F.col("_hit").isNotNull()
    if only_booked:
        cond = cond & (F.col("status") == "booked")
    return ledger.join(hits, "id", "left").withColumn(
        "status", F.when(cond, F.lit(status)).otherwise(F.col("status"))
    ).drop("_hit")


def cancel_by_id(ledger: DataFrame, ids: DataFrame, only_booked: bool = False) -> DataFrame:
    return set_status(ledger, ids, "cancelled", only_booked)


def complete_by_id(ledger: DataFrame, ids: DataFrame, only_booked: bool = False) -> DataFrame:
    return set_status(ledger, ids, "completed", only_booked)


def cancelled_by_id(ledger: DataFrame, doctors: DataFrame, ids: DataFrame) -> DataFrame:
    """Appointments an admin cancel reaches (doctor must exist), whatever
    their status — each gets a notice."""
    return (
        ledger.join(ids.select("id").distinct(), "id", "left_semi")
        .join(_doctor_dim(doctors), "doctor_id")
        .select(F.col("id").alias("appointment_id"), "patient_phone", "doctor_name", "appointment_date", "slot_time")
    )


# ----------------------------------------------------------------------------- leaves


def _parsed_leaves(requests: DataFrame) -> DataFrame:
    return requests.withColumn("_day", parse_day("leave_date"))


def leave_errors(requests: DataFrame) -> DataFrame:
    """Leave requests whose date does not parse; they insert and cancel nothing."""
    return _parsed_leaves(requests).where(F.col("_day").isNull()).select(
        "request_id", "doctor_id", "leave_date", F.lit("invalid_date").alias("error")
    )


def leave_insert(leaves: DataFrame, requests: DataFrame) -> DataFrame:
    """Next leaves snapshot after leave requests (request_id, doctor_id,
    leave_date text, reason), inserted or ignored.

    An existing (doctor, day) keeps its first reason; within the batch the
    earliest request wins; new rows get the next ids in request order.
    Requests whose date does not parse are left to :func:`leave_errors`.
    """
    first = (
        _parsed_leaves(requests).where(F.col("_day").isNotNull())
        .groupBy("doctor_id", F.col("_day").alias("leave_date"))
        .agg(F.min(F.struct("request_id", "reason")).alias("_f"))
    )
    fresh = first.join(leaves.select("doctor_id", "leave_date"), ["doctor_id", "leave_date"], "left_anti")
    fresh = number_rows(fresh.withColumn("_req", F.col("_f.request_id")), [], ["_req"], "_no", [id_slice("_req")])
    max_id = leaves.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new_rows = fresh.select(
        (max_id + F.col("_no")).alias("id"), "doctor_id", "leave_date", F.col("_f.reason").alias("reason")
    )
    return leaves.select("id", "doctor_id", "leave_date", "reason").unionByName(new_rows)


def leave_cascade(ledger: DataFrame, doctors: DataFrame, leave_days: DataFrame) -> DataFrame:
    """Booked appointments hit by a leave (doctor, day), with the doctor's
    name; each becomes ``cancelled``.  Runs for repeated leaves too."""
    days = leave_days.select("doctor_id", F.col("leave_date").alias("appointment_date")).distinct()
    return (
        ledger.where(F.col("status") == "booked")
        .join(days, ["doctor_id", "appointment_date"], "left_semi")
        .join(_doctor_dim(doctors), "doctor_id")
        .select(
            F.col("id").alias("appointment_id"), "patient_phone", "doctor_id", "doctor_name",
            "appointment_date", "slot_time", F.lit(CANCELLED).alias("status"),
        )
    )


def apply_cascade(ledger: DataFrame, hit: DataFrame) -> DataFrame:
    return set_status(ledger, hit.select(F.col("appointment_id").alias("id")), CANCELLED)


def leave_delete(leaves: DataFrame, ids: DataFrame) -> DataFrame:
    """Leaves minus the given ids; cancelled appointments are not restored."""
    return leaves.join(ids.select("id").distinct(), "id", "left_anti")


@dataclass(frozen=True)
class MarkedLeave:
    """What marking leaves changes: both next snapshots, the appointments it
    cancels (with the doctor's name, for the notices) and the rejected requests."""

    leaves: DataFrame
    ledger: DataFrame
    cancelled: DataFrame
    errors: DataFrame


def mark_leave(ledger: DataFrame, doctors: DataFrame, leaves: DataFrame, requests: DataFrame) -> MarkedLeave:
    """Leave requests as one operation: insert or ignore, then cancel every
    booking on a *requested* day — on days that were marked before as well."""
    days = _parsed_leaves(requests).where(F.col("_day").isNotNull()).select("doctor_id", F.col("_day").alias("leave_date"))
    cancelled = leave_cascade(ledger, doctors, days)
    return MarkedLeave(leave_insert(leaves, requests), apply_cascade(ledger, cancelled), cancelled, leave_errors(requests))
