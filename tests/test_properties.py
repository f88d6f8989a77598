"""Operators against plain serial models of the booking rules, on random inputs."""

import datetime as dt
import random

import pytest

from slotwise.operators import availability, ledger
from slotwise.plans import numbering


@pytest.fixture(params=[None, 3])
def numbering_path(request, monkeypatch):
    """Run a test with the usual slices of ids and with slices of three ids."""
    if request.param:
        monkeypatch.setattr(ledger, "id_slice", lambda c: numbering.id_slice(c, request.param))
    return request.param

DOCS = "id long, name string, department string, available_days string, slot_duration_mins int, " \
       "start_time string, end_time string"
APPT = "id long, patient_phone string, patient_name string, doctor_id long, appointment_date date, " \
       "slot_time string, token_number long, status string"
LEAVES = "id long, doctor_id long, leave_date date, reason string"


def serial_grid(start: str, end: str, dur: int) -> list[str]:
    """The grid as a loop over time of day (empty for a non-positive step)."""
    h, m = map(int, start.split(":"))
    eh, em = map(int, end.split(":"))
    cur, stop, out = h * 60 + m, eh * 60 + em, []
    while cur < stop and dur > 0:
        out.append(f"{cur // 60:02d}:{cur % 60:02d}")
        cur += dur
    return out


def test_slot_grid_matches_serial_loop(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(200):
        s, e = rnd.randrange(0, 24 * 60), rnd.randrange(0, 24 * 60)
        rows.append((i, "d", "X", "Mon", rnd.choice([-5, 0, 1, 7, 15, 20, 25, 30, 45, 90]),
                     f"{s // 60:02d}:{s % 60:02d}", f"{e // 60:02d}:{e % 60:02d}"))
    df = spark.createDataFrame(rows, DOCS)
    got: dict[int, list] = {}
    for r in availability.slot_grid(df).orderBy("doctor_id", "slot_no").collect():
        got.setdefault(r.doctor_id, []).append(r.slot_time)
    for i, _, _, _, dur, s, e in rows:
        assert got.get(i, []) == serial_grid(s, e, dur), (s, e, dur)


def serial_booking(ledger_rows, requests, doctor_ids, leave_days):
    """One request at a time, in id order."""
    booked = {(r[3], r[4], r[5]) for r in ledger_rows if r[7] == "booked"}
    count: dict[tuple, int] = {}
    for r in ledger_rows:
        count[(r[3], r[4])] = count.get((r[3], r[4]), 0) + 1
    out = {}
    for rid, _, _, doc, day, slot, _, _ in sorted(requests):
        if doc not in doctor_ids:
            out[rid] = ("unknown_doctor", None)
        elif (doc, day) in leave_days:
            out[rid] = ("on_leave", None)
        elif (doc, day, slot) in booked:
            out[rid] = ("slot_taken", None)
        else:
            token = count.get((doc, day), 0) + 1
            count[(doc, day)] = token
            booked.add((doc, day, slot))
            out[rid] = ("accepted", token)
    return out


def test_book_requests_matches_serial_model(spark, numbering_path):
    rnd = random.Random(11)
    days = [dt.date(2025, 7, d) for d in (1, 2, 3)]
    slots = ["09:00", "09:15", "09:30", "09:45"]
    doctors = spark.createDataFrame(
        [(i, f"Dr {i}", "X", "Mon", 15, "09:00", "10:00") for i in (1, 2, 3)], DOCS
    )
    led = [(i, f"p{i}", f"P{i}", rnd.choice([1, 2, 3, 4]), rnd.choice(days), rnd.choice(slots), None,
            rnd.choice(["booked", "booked", "cancelled", "completed", None])) for i in range(1, 41)]
    # a hot (doctor, day): half of the requests go to doctor 1 on 1 July
    req = []
    for i in range(100, 400):
        doc, day = (1, days[0]) if rnd.random() < 0.5 else (rnd.choice([1, 2, 3, 9]), rnd.choice(days))
        req.append((i, f"q{i}", f"Q{i}", doc, day, rnd.choice(slots), None, None))
    leave_days = {(2, days[1])}
    leaves = spark.createDataFrame([(1, 2, days[1], "x")], LEAVES)
    got = {r.id: (r.outcome, r.token_number) for r in ledger.book_requests(
        spark.createDataFrame(led, APPT), spark.createDataFrame(req, APPT), doctors, leaves).collect()}
    assert got == serial_booking(led, req, {1, 2, 3}, leave_days)


def test_cancel_earliest_matches_serial_model(spark, numbering_path):
    rnd = random.Random(5)
    days = [dt.date(2025, 6, d) for d in range(1, 8)]
    slots = ["09:00", "09:15", "09:30"]
    doctors = spark.createDataFrame([(i, f"Dr {i}", "X", "Mon", 15, "09:00", "10:00") for i in (1, 2)], DOCS)
    phones = ["whatsapp:+1"] * 6 + ["whatsapp:+2", "whatsapp:+3"]  # +1 is hot
    led = [(i, rnd.choice(phones), "P", rnd.choice([1, 2, 7]), rnd.choice(days), rnd.choice(slots), 1,
            rnd.choice(["booked", "booked", "cancelled"])) for i in range(1, 120)]
    ts0 = dt.datetime(2025, 6, 1)
    req = [(rnd.choice(phones), 1000 + i, ts0 + dt.timedelta(minutes=rnd.randrange(50))) for i in range(60)]
    # serial model
    live = {r[0]: r for r in led if r[7] == "booked" and r[3] in (1, 2)}
    want = {}
    for phone, rid, ts in sorted(req, key=lambda x: (x[2], x[1])):
        mine = sorted((r[4], r[5], r[0]) for r in live.values() if r[1] == phone)
        if mine:
            aid = mine[0][2]
            del live[aid]
            want[rid] = ("cancelled", aid)
        else:
            want[rid] = ("not_found", None)
    out = ledger.cancel_earliest(
        spark.createDataFrame(led, APPT), doctors,
        spark.createDataFrame(req, "phone string, request_id long, ts timestamp_ntz"),
    )
    assert {r.request_id: (r.outcome, r.appointment_id) for r in out.collect()} == want
