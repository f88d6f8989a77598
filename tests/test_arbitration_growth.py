"""A round of the arbitration looks at the slots that a cancel can free, not at all requests."""

import datetime as dt

from pyspark.sql import functions as F

from slotwise.functions.text import py_strip
from slotwise.operators import arbitration
from tests.test_arbitration import APPT, CMDS, DAY0, T0, serial

PHONES = 80


def test_rounds_leave_out_slots_that_nobody_can_free(spark, monkeypatch):
    """Many phones book and one cancels; two of the requests want what it holds."""
    day, sent = str(DAY0), iter(T0 + dt.timedelta(minutes=i) for i in range(10**6))
    doctors = {*range(1, PHONES + 1)}
    ledger = [(1, "+0", "L", 1, DAY0, "08:00", 1, "booked"), (2, "+9999", "L", 2, DAY0, "08:00", 1, "booked")]
    commands = [(i, f"+{i}", next(sent), "book", i, day, "09:00", f"N{i}") for i in range(1, PHONES + 1)]
    commands += [(200 + i, f"+{i}", next(sent), "book", i, day, "09:00", "late") for i in range(1, PHONES + 1)]
    # Not free yet; freed; taken again; a slot that nobody frees.
    commands += [(500, "+7", next(sent), "book", 1, day, "08:00", "N"), (501, "+0", next(sent), "cancel", *[None] * 4),
                 (502, "+8", next(sent), "book", 1, day, "08:00", "N"), (503, "+7", next(sent), "book", 1, day, "08:00", "N"),
                 (504, "+7", next(sent), "book", 2, day, "08:00", "N"), (505, "+8", next(sent), "book", 99, day, "08:00", "N")]
    want, final = serial(ledger, commands, doctors, set())
    assert [want[m][0] for m in range(500, 506)] == ["slot_taken", "cancelled", "accepted", "slot_taken", "slot_taken", "unknown_doctor"]
    looked_at, plain = [], arbitration._accepted

    def accepted(candidates, frees):
        if frees is not None:
            looked_at.append(candidates.count())
        return plain(candidates, frees)

    monkeypatch.setattr(arbitration, "_accepted", accepted)
    rows = spark.createDataFrame(ledger, APPT)
    known = spark.createDataFrame([(d, f"Dr. {d}", "ENT") for d in sorted(doctors)], "id long, name string, department string")
    leaves = spark.createDataFrame([], "id long, doctor_id long, leave_date date, reason string")
    done = arbitration.arbitrate(rows, spark.createDataFrame(commands, CMDS), known, leaves)
    assert {r.msg_id: (r.outcome, r.id, r.token_number) for r in done.outcomes.collect()} == want
    assert {tuple(r) for r in arbitration.merged(rows, done.changes).collect()} == final
    assert looked_at and max(looked_at) <= 3


def test_strip_looks_at_the_ends_only(spark):
    """All white space of Python's ``str.strip``; no pattern goes through the text between."""
    space = [c for c in map(chr, range(0x10000)) if c.isspace()]
    rows = spark.createDataFrame([(f"{c}{c}a{c}b{c}\n",) for c in [*space, "x", "​"]], "t string").select("t", py_strip("t").alias("s"))
    assert all(r.s == r.t.strip() for r in rows.collect())
    assert "regexp" not in rows.select(F.col("s"))._jdf.queryExecution().toString().lower()
