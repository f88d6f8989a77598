"""Commands settled together against a serial model, over any cut into batches."""

import datetime as dt
import random

import pytest

from slotwise.operators import arbitration

APPT = "id long, patient_phone string, patient_name string, doctor_id long, appointment_date date, slot_time string, token_number long, status string"
CMDS = "msg_id long, phone string, ts timestamp_ntz, command string, doctor_id long, date string, slot string, name string"
DAY0 = dt.date(2025, 6, 10)
T0 = dt.datetime(2025, 6, 1)


def serial(ledger, commands, doctors, leaves):
    """One command after the other: ({msg_id: (outcome, id, token)}, rows of the ledger)."""
    rows, out = [list(r) for r in ledger], {}
    key = lambda p: p.replace("whatsapp:", "")
    for msg_id, phone, _, command, doctor, day, slot, name in sorted(commands, key=lambda c: (c[2], c[0])):
        mine = sorted((r[4], r[5], r[0], r) for r in rows if r[7] == "booked" and key(r[1]) == key(phone) and r[3] in doctors)
        if command == "book":
            date = dt.date.fromisoformat(day)
            if doctor not in doctors:
                out[msg_id] = ("unknown_doctor", None, None)
            elif (doctor, date) in leaves:
                out[msg_id] = ("on_leave", None, None)
            elif any(r[3] == doctor and r[4] == date and r[5] == slot and r[7] == "booked" for r in rows):
                out[msg_id] = ("slot_taken", None, None)
            else:
                token = 1 + sum(r[3] == doctor and r[4] == date for r in rows)
                rows.append([1 + max((r[0] for r in rows), default=0), phone, name, doctor, date, slot, token, "booked"])
                out[msg_id] = ("accepted", rows[-1][0], token)
        elif not mine:
            out[msg_id] = ("not_found", None, None)
        else:
            r = mine[0][3]
            if command == "cancel":
                r[7] = "cancelled"
            out[msg_id] = ("cancelled" if command == "cancel" else "found", r[0], r[6])
    return out, {tuple(r) for r in rows}


def clinic(rnd, phones, n):
    """A ledger with slots held twice, and commands that contend for few slots; times tie."""
    slots, days = ["09:00", "09:20", "09:40"], [str(DAY0 + dt.timedelta(d)) for d in range(2)]
    ledger = [(i, "whatsapp:" + rnd.choice(phones), "L", rnd.choice([1, 2, 7]), DAY0 + dt.timedelta(rnd.randrange(2)), rnd.choice(slots), 1,
               rnd.choice(["booked", "booked", "cancelled", None])) for i in range(1, 15)]
    commands = []
    for i in range(n):
        phone, ts = rnd.choice(["", "whatsapp:"]) + rnd.choice(phones), T0 + dt.timedelta(minutes=rnd.randrange(n))
        kind = rnd.choice(["book", "book", "cancel", "status"])
        booking = (rnd.choice([1, 1, 2, 3]), rnd.choice(days), rnd.choice(slots), f"N{i}") if kind == "book" else (None,) * 4
        commands.append((i, phone, ts, kind, *booking))
    return ledger, commands


@pytest.fixture(scope="module")
def parties(spark):
    doctors = spark.createDataFrame([(1, "Dr. A", "ENT"), (2, "Dr. B", "ENT")], "id long, name string, department string")
    leaves = spark.createDataFrame([(1, 2, DAY0, "x")], "id long, doctor_id long, leave_date date, reason string")
    return doctors, leaves


@pytest.mark.parametrize("seed, batches", [(1, 2), (2, 1)])
def test_any_cut_into_batches_is_serial(spark, parties, seed, batches):
    rnd = random.Random(seed)
    rows, commands = clinic(rnd, ["+1", "+2", "+3", "+4"], 60)
    want, final = serial(rows, commands, {1, 2}, {(2, DAY0)})
    assert {o for o, _, _ in want.values()} == {"accepted", "slot_taken", "unknown_doctor", "on_leave", "cancelled", "found", "not_found"}
    ordered = sorted(commands, key=lambda c: (c[2], c[0]))
    cuts = sorted(rnd.sample(range(1, len(ordered)), batches - 1))
    ledger, got = spark.createDataFrame(rows, APPT), {}
    for lo, hi in zip([0, *cuts], [*cuts, len(ordered)], strict=True):
        done = arbitration.arbitrate(ledger, spark.createDataFrame(ordered[lo:hi], CMDS), *parties)
        got |= {r.msg_id: (r.outcome, r.id, r.token_number) for r in done.outcomes.collect()}
        ledger = arbitration._written(arbitration.merged(ledger, done.changes), "test-ledger")
    assert got == want
    assert {tuple(r) for r in ledger.collect()} == final


def test_a_chain_of_frees(spark, parties):
    """Each booking is possible only because the phone before it cancelled: the outcome travels along the chain."""
    rows = [(1, "+0", "L", 1, DAY0, "09:00", 1, "booked")]
    commands = []
    for i in range(6):
        ts = T0 + dt.timedelta(hours=i)
        commands += [(10 * i, f"+{i}", ts, "cancel", None, None, None, None), (10 * i + 1, f"+{i + 1}", ts, "book", 1, str(DAY0), "09:00", "N"),
                     (10 * i + 2, f"+{i + 1}", ts, "status", None, None, None, None)]
    want, final = serial(rows, commands, {1, 2}, set())
    done = arbitration.arbitrate(spark.createDataFrame(rows, APPT), spark.createDataFrame(commands, CMDS), *parties)
    assert {r.msg_id: (r.outcome, r.id, r.token_number) for r in done.outcomes.collect()} == want
    assert {tuple(r) for r in arbitration.merged(spark.createDataFrame(rows, APPT), done.changes).collect()} == final
    said = {r.msg_id: r.body for r in arbitration.replies(done.outcomes, parties[0]).collect()}
    assert set(said) == set(want) and "09:00" in said[2] and "Dr. A" in said[0]


def test_query_equals_the_serial_model(spark):
    """The registered query over its whole tables."""
    from slotwise.plans.catalog import _commands
    from slotwise.plans.registry import QUERIES
    from slotwise.sources.fixtures import tables
    from tests.conftest import SF_SMALL

    t = tables(spark, SF_SMALL)
    ledger, commands = _commands(t)
    doctors = {r.id for r in t.doctors.collect()}
    leaves = {(r.doctor_id, r.leave_date) for r in t.doctor_leaves.collect()}
    rows = [tuple(r[c] for c in (x.split()[0] for x in APPT.split(", "))) for r in ledger.collect()]
    said = [tuple(r[c] for c in (x.split()[0] for x in CMDS.split(", "))) for r in commands.collect()]
    want, _ = serial(rows, said, doctors, leaves)
    got = {r.msg_id: (r.outcome, r.id, r.token_number) for r in QUERIES["command_outcomes"](spark, SF_SMALL).collect()}
    assert got == want and len({o for o, _, _ in want.values()}) >= 6


def test_nothing_to_settle(spark, parties):
    rows = spark.createDataFrame([(1, "+0", "L", 1, DAY0, "09:00", 1, "booked")], APPT)
    for ledger in (rows, rows.limit(0)):
        done = arbitration.arbitrate(ledger, spark.createDataFrame([], CMDS), *parties)
        assert done.outcomes.collect() == [] and done.changes.collect() == []
