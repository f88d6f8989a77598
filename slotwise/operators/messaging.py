"""Outbound texts: reminders and their summary, admin and leave notices,
booking confirmations, cancel replies and status cards, plus the outbox.

Every notice is a row (kind, ref_id, to_address, body); delivery is a sink,
not a side effect inside a transformation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import templates as T
from slotwise.functions.text import PATIENT_FALLBACK, fmt_day, messaging_address, or_fallback, py_str
from slotwise.operators import ledger as L
from slotwise.plans.numbering import id_slice, number_rows

OUTBOX_KEY = ("kind", "ref_id", "as_of")


def _day(d) -> Column:
    return F.lit(d).cast("date") if isinstance(d, (str, dt.date)) else d


def _doctor_dim(doctors: DataFrame) -> DataFrame:
    return doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"), "department")


def tomorrows_bookings(appointments: DataFrame, doctors: DataFrame, as_of) -> DataFrame:
    """Booked appointments of the day after ``as_of`` whose doctor exists."""
    tomorrow = F.date_add(_day(as_of), 1)
    a = appointments.where((F.col("appointment_date") == tomorrow) & (F.col("status") == "booked"))
    return a.join(_doctor_dim(doctors), "doctor_id")


def reminders(appointments: DataFrame, doctors: DataFrame, as_of) -> DataFrame:
    """One reminder per booked appointment tomorrow."""
    b = tomorrows_bookings(appointments, doctors, as_of)
    return b.select(
        F.col("id").alias("appointment_id"),
        messaging_address("patient_phone").alias("to_address"),
        T.render(
            T.REMINDER,
            patient=or_fallback("patient_name", PATIENT_FALLBACK),
            doctor_name=py_str("doctor_name"),
            department=py_str("department"),
            slot_time=py_str("slot_time"),
            token_number=py_str("token_number"),
        ).alias("body"),
    )


def reminder_summary(appointments: DataFrame, doctors: DataFrame, as_of, admin_phone: str | None) -> DataFrame:
    """The admin summary as ordered lines: ``line_no`` 0 is the header with
    the count, then one bullet per appointment in id order.

    The lines are rows, not one concatenated string, so a busy day is never
    gathered into a single task; the message body is the lines in order.
    No admin phone → no summary.  A day without bookings still has a header.
    """
    b = tomorrows_bookings(appointments, doctors, as_of)
    tomorrow = F.date_add(_day(as_of), 1)
    spark = appointments.sparkSession
    if not admin_phone:
        return spark.createDataFrame([], "line_no bigint, to_address string, text string")
    to = messaging_address(F.lit(admin_phone))
    header = b.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(0).cast("bigint").alias("line_no"),
        to.alias("to_address"),
        T.render(T.SUMMARY_HEADER, day=F.date_format(tomorrow, "yyyy-MM-dd"), count=F.col("count")).alias("text"),
    )
    lines = number_rows(b.select("id", "patient_name", "doctor_name", "slot_time"), [], ["id"], "line_no", [id_slice("id")]).select(
        "line_no",
        to.alias("to_address"),
        T.render(
            T.SUMMARY_LINE,
            patient_name=py_str("patient_name"),
            doctor_name=py_str("doctor_name"),
            slot_time=py_str("slot_time"),
        ).alias("text"),
    )
    return header.unionByName(lines)


def cancel_notices(ledger: DataFrame, doctors: DataFrame, ids: DataFrame) -> DataFrame:
    """Notice for every appointment an admin cancels (even if already cancelled)."""
    hit = L.cancelled_by_id(ledger, doctors, ids)
    return hit.select(
        "appointment_id",
        messaging_address("patient_phone").alias("to_address"),
        T.render(
            T.ADMIN_CANCEL_NOTICE,
            doctor_name=py_str("doctor_name"),
            day=fmt_day("appointment_date"),
            slot_time=py_str("slot_time"),
        ).alias("body"),
    )


def leave_notices(hit: DataFrame) -> DataFrame:
    """Notice for every booking cancelled by a leave (output of leave_cascade)."""
    return hit.select(
        "appointment_id",
        messaging_address("patient_phone").alias("to_address"),
        T.render(
            T.LEAVE_NOTICE,
            doctor_name=py_str("doctor_name"),
            day=fmt_day("appointment_date"),
            slot_time=py_str("slot_time"),
        ).alias("body"),
    )


def booking_confirmations(outcomes: DataFrame, doctors: DataFrame) -> DataFrame:
    """Reply per arbitrated request.  Unknown doctors get no reply."""
    o = outcomes.join(_doctor_dim(doctors), "doctor_id")
    body = (
        F.when(
            F.col("outcome") == L.ACCEPTED,
            T.render(
                T.BOOKING_CONFIRMED,
                name=py_str("patient_name"),
                department=py_str("department"),
                doctor_name=py_str("doctor_name"),
                day=fmt_day("appointment_date"),
                slot_time=py_str("slot_time"),
                token_number=py_str("token_number"),
            ),
        )
        .when(F.col("outcome") == L.SLOT_TAKEN, F.lit(T.SLOT_TAKEN_REPLY))
        .when(
            F.col("outcome") == L.ON_LEAVE,
            T.render(T.ON_LEAVE_REPLY, doctor_name=py_str("doctor_name"), day=fmt_day("appointment_date")),
        )
    )
    return o.select(
        F.col("id").alias("request_id"), messaging_address("patient_phone").alias("to_address"), "outcome",
        body.alias("body"),
    )


def cancel_replies(cancel_outcomes: DataFrame) -> DataFrame:
    """Reply per cancel request (output of cancel_earliest)."""
    body = F.when(
        F.col("outcome") == L.CANCELLED,
        T.render(
            T.CANCEL_DONE_REPLY,
            doctor_name=py_str("doctor_name"),
            day=fmt_day("appointment_date"),
            slot_time=py_str("slot_time"),
        ),
    ).otherwise(F.lit(T.CANCEL_NONE_REPLY))
    return cancel_outcomes.select("request_id", messaging_address("phone").alias("to_address"), body.alias("body"))


def status_cards(requests: DataFrame, appointments: DataFrame, doctors: DataFrame) -> DataFrame:
    """Reply per status request (phone, request_id) from the current ledger."""
    nxt = L.next_appointment(appointments, doctors).withColumnRenamed("patient_phone", "_phone")
    from slotwise.functions.text import normalize_phone

    r = requests.select("request_id", "phone", normalize_phone("phone").alias("_key"))
    n = nxt.withColumn("_key", normalize_phone("_phone"))
    joined = r.join(n, "_key", "left")
    body = F.when(
        F.col("id").isNotNull(),
        T.render(
            T.STATUS_CARD,
            department=py_str("department"),
            doctor_name=py_str("doctor_name"),
            day=fmt_day("appointment_date"),
            slot_time=py_str("slot_time"),
            token_number=py_str("token_number"),
        ),
    ).otherwise(F.lit(T.STATUS_NONE_REPLY))
    return joined.select("request_id", messaging_address("phone").alias("to_address"), body.alias("body"))


def outbox(notices: dict[str, DataFrame], as_of, already_sent: DataFrame | None = None) -> DataFrame:
    """All notices of a run as (kind, ref_id, to_address, body, as_of).

    Deduplicated on (kind, ref_id, as_of) so that a rerun — or several
    workers starting the same daily job — sends each notice once; rows
    already in the outbox are removed with an anti join.
    """
    frames = []
    for kind, df in notices.items():
        ref = df.columns[0]
        frames.append(
            df.select(
                F.lit(kind).alias("kind"), F.col(ref).cast("bigint").alias("ref_id"), "to_address",
                F.col("body" if "body" in df.columns else "text").alias("body"),
                _day(as_of).alias("as_of"),
            )
        )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    out = out.dropDuplicates(list(OUTBOX_KEY))
    if already_sent is not None:
        out = out.join(already_sent.select(*OUTBOX_KEY), list(OUTBOX_KEY), "left_anti")
    return out


def run_daily_reminders(appointments: DataFrame, doctors: DataFrame, as_of, admin_phone: str | None,
                        outbox_path: str) -> int:
    """The daily reminder job for ``as_of``: reminders plus the admin summary
    appended to the outbox table at ``outbox_path``.

    Safe to start more than once (several workers, a retry): notices already
    in the outbox for this ``as_of`` are removed by an anti join before the
    append, so each is written once.  Returns the number of notices appended.
    """
    from pyspark.errors import AnalysisException

    spark = appointments.sparkSession
    notices = {"reminder": reminders(appointments, doctors, as_of)}
    if admin_phone:
        notices["summary_line"] = reminder_summary(appointments, doctors, as_of, admin_phone).select(
            "line_no", "to_address", F.col("text").alias("body")
        )
    try:
        sent = spark.read.parquet(outbox_path).where(F.col("as_of") == _day(as_of))
    except AnalysisException:  # empty outbox
        sent = None
    new = outbox(notices, as_of, already_sent=sent).persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").partitionBy("as_of").parquet(outbox_path)
        return n
    finally:
        new.unpersist()
