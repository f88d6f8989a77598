"""Book, cancel and status commands, as if handled one by one (T-5, T-6).

A booking takes its slot only if nobody holds it at that moment; a cancel takes
the phone's earliest booking that stands at that moment and so frees a slot; a
status answer shows the earliest one.  Each depends on commands before it, of
other phones and other slots.  The commands are not replayed one by one but
settled together, by two passes that each look at all of them:

* *Slots.*  Given when each slot is freed, the requests of a slot fall into
  spans between its frees.  With ``taken`` bookings in the ledger, the first
  ``taken`` frees leave it held; in each later span the first request wins.
* *Phones.*  Given which requests were accepted and when, every cancel of a
  phone is matched with a booking.  Bookings that stood before the same cancel
  are ranked by (date, slot, id): the r-th goes to the r-th cancel after them at
  the soonest.  Where two want the same cancel the earlier booking gets it and
  the other asks for the next one, until no two want the same.

Only slots of a booking that some cancel or status could be about are looked at
again; requests of other slots are settled once, before the rounds.

The passes repeat until the accepted requests no longer change.  Commands
before the first wrong outcome are right, and a round puts at least that one
right, so the end is the serial result; the rounds follow the length of chains
such as "a booking that was possible because of a cancel that took a booking
that was possible because ...", not the number of commands.

Commands are numbered by (ts, msg_id) over all, in slices; a hot slot or phone
is cut into slices of that number (see ``streaming/dialogue.py``).

Defined cases: an unknown doctor, then a leave, is found before a taken slot;
a slot that the ledger holds twice is free after two cancels; a booking of an
unknown doctor is neither cancelled nor shown; new bookings get ids after the
ledger's, in order, without gaps; a null phone never matches a booking.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.text import normalize_phone
from slotwise.operators import ledger as L
from slotwise.plans.numbering import number_rows
from slotwise.session import ensure_checkpoint_dir, scratch_path
from slotwise.streaming.dialogue import SLICE, last_before

SLOT = ["doctor_id", "appointment_date", "slot_time"]
DAY = ["doctor_id", "appointment_date"]
FOUND = "found"
# What orders the bookings of a phone: those of the ledger have smaller ids than new ones.
_ORDER = ["appointment_date", "slot_time", "fresh", "ref"]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, "arbitration", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _slice(c: str = "n"):
    return [F.floor(F.col(c) / SLICE)]


def _accepted(candidates: DataFrame, frees: DataFrame | None) -> DataFrame:
    """(n) of the requests that get their slot; ``frees`` (slot, n): when slots are freed."""
    rows = candidates.select(*SLOT, F.col("n").alias("p"), "taken")
    if frees is None:
        spans = rows.withColumn("span", F.lit(0).cast("bigint"))
    else:
        counted = number_rows(frees.select(*SLOT, "n"), SLOT, ["n"], "m", _slice())
        both = rows.unionByName(counted.select(*SLOT, F.col("n").alias("p"), "m"), allowMissingColumns=True)
        spans = last_before(both, SLOT, span=F.col("m")).where("taken IS NOT NULL").withColumn("span", F.coalesce("span", F.lit(0)))
    return spans.where("span >= taken").groupBy(*SLOT, "span").agg(F.min("p").alias("n")).select("n")


def _matched(items: DataFrame, cancels: DataFrame) -> DataFrame:
    """Bookings that cancels take: ``items`` with ``c``, the number of the phone's cancel, and its place ``gone``."""
    marks = cancels.select("phone", F.col("n").alias("p"), "j")
    rows = items.withColumn("p", F.col("n")).unionByName(marks, allowMissingColumns=True)
    placed = last_before(rows, ["phone"], passed=F.col("j")).where("ref IS NOT NULL").drop("p", "j")
    placed = placed.withColumn("passed", F.coalesce("passed", F.lit(0)))
    ranked = number_rows(placed, ["phone", "passed"], _ORDER, "r", [F.col("appointment_date")])
    last = cancels.groupBy("phone").agg(F.max("j").alias("last"))
    pool = ranked.withColumn("c", F.col("passed") + F.col("r")).drop("r", "passed").join(last, "phone")
    while True:
        pool = _written(pool.where("c <= last"), "pool")
        first = pool.groupBy("phone", "c").agg(F.min(F.struct(*_ORDER)).alias("first"), F.count(F.lit(1)).alias("wants"))
        crowded = first.where("wants > 1").drop("wants")
        if crowded.isEmpty():
            break
        pool = pool.join(crowded, ["phone", "c"], "left").withColumn(
            "c", F.when(F.col("first") != F.struct(*_ORDER), F.col("c") + 1).otherwise(F.col("c"))
        ).drop("first")
    times = cancels.select("phone", F.col("j").alias("c"), F.col("n").alias("gone"))
    return pool.drop("last").join(times, ["phone", "c"])


def _same(a: DataFrame, b: DataFrame) -> bool:
    return a.count() == b.count() and a.join(b, "n", "left_anti").isEmpty()


@dataclass(frozen=True)
class Arbitrated:
    """``outcomes``: a row per command (msg_id, n, phone, ts, command, outcome and
    the appointment it concerns); ``changes``: the ledger rows that are new or changed."""

    outcomes: DataFrame
    changes: DataFrame


def arbitrate(ledger: DataFrame, commands: DataFrame, doctors: DataFrame, leaves: DataFrame) -> Arbitrated:
    """Settle commands (msg_id, phone, ts, command, doctor_id, date, slot, name) against the ledger."""
    ensure_checkpoint_dir(commands.sparkSession)
    said = commands.where(F.col("command").isin("book", "cancel", "status")).select(
        "msg_id", "phone", normalize_phone("phone").alias("key"), "ts", "command", "doctor_id",
        F.to_date("date").alias("appointment_date"), F.col("slot").alias("slot_time"), "name",
    )
    said = _written(number_rows(said, [], ["ts", "msg_id"], "n", [F.date_trunc("hour", "ts")]), "commands")
    books = said.where("command = 'book'")
    stands = ledger.where("status = 'booked'")

    # What no other command can change: the doctor, the leave, the bookings of the ledger.
    known = _written(doctors.select(F.col("id").alias("doctor_id"), F.lit(True).alias("known")).distinct(), "known")
    off = leaves.select("doctor_id", F.col("leave_date").alias("appointment_date"), F.lit(True).alias("off")).distinct()
    holders = stands.join(books.select(*SLOT).distinct(), SLOT, "left_semi").groupBy(*SLOT).agg(F.count(F.lit(1)).alias("holders"))
    cancels = said.where("command = 'cancel'").select(F.col("key").alias("phone"), "n", "msg_id")
    cancels = _written(number_rows(cancels, ["phone"], ["n"], "j", _slice()), "cancels")
    asking = said.where("command <> 'book'").select(F.col("key").alias("phone")).distinct()
    held = stands.withColumn("phone", normalize_phone("patient_phone")).join(asking, "phone", "left_semi").join(
        known.select("doctor_id"), "doctor_id", "left_semi"
    )
    held = _written(held.select("phone", *SLOT, F.lit(False).alias("fresh"), F.col("id").alias("ref"), F.lit(0).cast("bigint").alias("n")), "held")
    # Cancels free slots of these bookings only: what is asked of other slots is settled once.
    asked_for = books.join(asking.withColumnRenamed("phone", "key"), "key", "left_semi")
    open_slots = held.select(*SLOT).union(asked_for.select(*SLOT)).distinct().withColumn("open", F.lit(True))
    checked = books.join(known, "doctor_id", "left").join(off, DAY, "left").join(holders, SLOT, "left").join(open_slots, SLOT, "left")
    checked = checked.withColumn("refused", F.when(F.col("known").isNull(), L.UNKNOWN_DOCTOR).when(F.col("off"), L.ON_LEAVE))
    checked = _written(checked.withColumn("taken", F.coalesce("holders", F.lit(0))).drop("known", "off", "holders"), "checked")
    shut = _written(_accepted(checked.where("refused IS NULL AND open IS NULL").dropna(subset=SLOT), None), "accepted")
    candidates = _written(checked.where("refused IS NULL AND open"), "candidates")
    hopeful = candidates.withColumnRenamed("phone", "address").withColumnRenamed("key", "phone").join(asking, "phone", "left_semi")
    hopeful = _written(hopeful.select("phone", *SLOT, F.lit(True).alias("fresh"), F.col("n").alias("ref"), "n"), "hopeful")

    accepted = _written(_accepted(candidates, None), "accepted")
    while True:
        items = held.unionByName(hopeful.join(accepted, "n", "left_semi").select(held.columns))
        taken = _written(_matched(items, cancels), "taken")
        again = _written(_accepted(candidates, taken.select(*SLOT, F.col("gone").alias("n"))), "accepted")
        if _same(accepted, again):
            break
        accepted = again
    return _settled(ledger, said, checked, shut.union(accepted), items, taken)


def _settled(ledger, said, checked, accepted, items, taken) -> Arbitrated:
    ledger = ledger.select(*L.LEDGER_COLUMNS)
    top = ledger.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    judged = _written(checked.join(accepted.withColumn("won", F.lit(True)), "n", "left"), "judged")
    won = judged.where("won").select("n", "msg_id", "ts", "phone", "name", *SLOT)
    # Written, since numbering reads its rows twice.
    numbered = _written(number_rows(won, [], ["n"], "i", _slice()), "numbered")
    ranked = number_rows(numbered, DAY, ["n"], "rank", _slice())
    prior = ledger.join(won.select(*DAY).distinct(), DAY, "left_semi").groupBy(*DAY).agg(F.count(F.lit(1)).alias("prior"))
    gone = taken.where("fresh").select(F.col("ref").alias("n"), F.lit(True).alias("cancelled"))
    fresh = ranked.join(prior, DAY, "left").join(gone, "n", "left").select(
        "n", "msg_id", "ts", (top + F.col("i")).alias("id"), F.col("phone").alias("patient_phone"), F.col("name").alias("patient_name"), *SLOT,
        (F.coalesce("prior", F.lit(0)) + F.col("rank")).cast("bigint").alias("token_number"),
        F.when(F.col("cancelled"), L.CANCELLED).otherwise("booked").alias("status"),
    )
    fresh = _written(fresh, "fresh")
    hit = taken.where("NOT fresh").select(F.col("ref").alias("id"))
    touched = items.where("NOT fresh").select(F.col("ref").alias("id")).distinct()
    shown = _written(ledger.join(touched, "id", "left_semi"), "shown")  # what cancels and answers are about
    struck = shown.join(hit, "id", "left_semi").withColumn("status", F.lit(L.CANCELLED))
    changes = struck.unionByName(fresh.drop("n", "msg_id", "ts"))

    about = ["id", "patient_name", *SLOT, "token_number"]
    of_item = shown.select(F.lit(False).alias("fresh"), F.col("id").alias("ref"), *about).unionByName(
        fresh.select(F.lit(True).alias("fresh"), F.col("n").alias("ref"), *about)
    )
    # A booking stands from its own command until the cancel that takes it.
    ends = taken.select("fresh", "ref", "gone")
    spans = items.select("phone", *SLOT[1:], "fresh", "ref", F.col("n").alias("since")).join(ends, ["fresh", "ref"], "left")
    asked = said.where("command = 'status'").select(F.col("key").alias("phone"), "n")
    alive = (F.col("since") < F.col("n")) & (F.col("gone").isNull() | (F.col("gone") > F.col("n")))
    seen = asked.join(spans, "phone").where(alive).groupBy("n").agg(F.min(F.struct(*_ORDER)).alias("k")).select("n", "k.fresh", "k.ref")
    meant = taken.select(F.col("gone").alias("n"), "fresh", "ref").unionByName(seen).join(of_item, ["fresh", "ref"])
    answers = said.where("command <> 'book'").select("msg_id", "n", "phone", "ts", "command").join(
        meant.select("n", *about), "n", "left"
    )
    good = F.when(F.col("command") == "cancel", L.CANCELLED).otherwise(FOUND)
    answers = answers.withColumn("outcome", F.when(F.col("id").isNull(), L.NOT_FOUND).otherwise(good))
    lost = judged.where("won IS NULL").withColumn("outcome", F.coalesce("refused", F.lit(L.SLOT_TAKEN))).withColumnRenamed("name", "patient_name")
    got = fresh.withColumnRenamed("patient_phone", "phone").withColumn("command", F.lit("book")).withColumn("outcome", F.lit(L.ACCEPTED))
    columns = ["msg_id", "n", "phone", "ts", "command", "outcome", *about]
    lost = lost.withColumn("id", F.lit(None).cast("bigint")).withColumn("token_number", F.lit(None).cast("bigint"))
    return Arbitrated(answers.select(columns).unionByName(got.select(columns)).unionByName(lost.select(columns)), changes)


def merged(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """The ledger with changed rows in place of the old ones, and the new rows."""
    old = ledger.select(*L.LEDGER_COLUMNS).join(changes.select("id"), "id", "left_anti")
    return old.select(*L.LEDGER_COLUMNS).unionByName(changes.select(*L.LEDGER_COLUMNS))


def replies(outcomes: DataFrame, doctors: DataFrame) -> DataFrame:
    """The message that answers each command: msg_id, to_address, body (none for an unknown doctor, as before)."""
    from slotwise.functions import templates as T
    from slotwise.functions.text import fmt_day, messaging_address, py_str
    from slotwise.operators import messaging

    named = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"), "department")
    booked = outcomes.where("command = 'book'").select(
        F.col("msg_id").alias("id"), F.col("phone").alias("patient_phone"), "patient_name", *SLOT, "token_number", "outcome"
    )
    confirmed = messaging.booking_confirmations(booked, doctors).select(F.col("request_id").alias("msg_id"), "to_address", "body")
    asked = outcomes.where("command = 'cancel'").join(named, "doctor_id", "left").withColumnRenamed("msg_id", "request_id")
    cancelled = messaging.cancel_replies(asked).select(F.col("request_id").alias("msg_id"), "to_address", "body")
    shown = outcomes.where("command = 'status'").join(named, "doctor_id", "left")
    card = T.render(
        T.STATUS_CARD, department=py_str("department"), doctor_name=py_str("doctor_name"), day=fmt_day("appointment_date"),
        slot_time=py_str("slot_time"), token_number=py_str("token_number"),
    )
    body = F.when(F.col("outcome") == FOUND, card).otherwise(F.lit(T.STATUS_NONE_REPLY))
    status = shown.select("msg_id", messaging_address("phone").alias("to_address"), body.alias("body"))
    return confirmed.unionByName(cancelled).unionByName(status)
