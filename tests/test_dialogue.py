"""The composed dialogue against the serial walk of one message after the other."""

import datetime as dt
import random

import pytest

from slotwise.streaming import dialogue
from tests.serial_walk import MemoryMenus, step_once

DOCTORS = "id long, name string, department string, available_days string, slot_duration_mins int, start_time string, end_time string"
AS_OF = dt.date(2025, 7, 1)  # a Tuesday
T0 = dt.datetime(2025, 6, 1)


@pytest.fixture(scope="module")
def clinic(spark):
    """Doctors without dates, with a full day, with one slot; departments of one and of many doctors; a leave on an offered day."""
    doctors = [
        (1, "Dr. A", "ENT", "Mon,Wed", 60, "09:00", "12:00"), (2, "Dr. B", "ENT", "Nowhere", 30, "09:00", "12:00"),
        (3, "Dr. C", "Cardiology", "Thu", 30, "09:00", "09:30"), (4, "Dr. D", "ENT", "Fri", 0, "09:00", "10:00"),
        (5, "Dr. E", "Oncology", "Nowhere", 30, "09:00", "12:00"), (6, "Dr. F", "ENT", "Mon,Tue,Wed,Thu,Fri", 20, "10:00", "11:00"),
    ]
    taken = [(1, "p", "n", 6, dt.date(2025, 7, 2), s, 1, "booked") for s in ("10:00", "10:20", "10:40")]
    taken += [(2, "p", "n", 1, dt.date(2025, 7, 2), "10:00", 1, "booked"), (3, "p", "n", 3, dt.date(2025, 7, 3), "09:00", 1, "cancelled")]
    appointments = "id long, patient_phone string, patient_name string, doctor_id long, appointment_date date, slot_time string, token_number long, status string"
    leaves = [(1, 1, dt.date(2025, 7, 7), "x")]
    return (
        spark.createDataFrame(doctors, DOCTORS),
        spark.createDataFrame(leaves, "id long, doctor_id long, leave_date date, reason string"),
        spark.createDataFrame(taken, appointments),
    )


def serial_menus(menus):
    """The menu tables as the serial walk reads them."""
    docs, dates, slots = {}, {}, {}
    for r in menus["doctors"].orderBy("k").collect():
        docs.setdefault(r.dept, []).append({"id": r.doctor_id})
    for r in menus["dates"].orderBy("k").collect():
        dates.setdefault(r.doctor_id, []).append(r.date)
    for r in menus["slots"].orderBy("k").collect():
        slots.setdefault((r.doctor_id, r.date), []).append(r.slot)
    leaves = {(r.doctor_id, r.date) for r in menus["leaves"].collect()}
    return MemoryMenus([r.dept for r in menus["departments"].orderBy("k").collect()], docs, dates, slots, leaves)


def serial(rows, menus, start=None):
    state, out = dict(start or {}), set()
    for msg_id, phone, ts, text in sorted(rows, key=lambda r: (r[2], r[0])):
        phone = phone.replace("whatsapp:", "")
        step, data = state.get(phone, ("start", {}))
        nxt, after, f = step_once(step, data, text, menus)
        state[phone] = (nxt, after)
        picks = (after.get("dept"), (after.get("doctor") or {}).get("id"), after.get("date"), after.get("slot"))
        out.add((phone, msg_id, ts, f["intent"], "start" if step == "idle" else step, nxt, f["command"], f["doctor_id"], f["date"], f["slot"], f["name"],
                 f["reply_kind"], *picks))
    return out


WORDS = ["1", "1", "1", "2", "3", "+1", "-1", "7", "99", "99999999999", "0", "hi", "cancel", "status", "x", "jo anne", "12", "o'neil", "é"]


def talk(rnd, n, phones, words):
    """Random messages; whole dialogues among them; times that tie."""
    rows, script = [], ["ann lee", "2", "4", "1", "2", "rob roy"]
    for i in range(n):
        text = rnd.choice(words) if rnd.random() < 0.6 else script[i % len(script)]
        prefix = rnd.choice(["", "whatsapp:"])
        rows.append((i, prefix + rnd.choice(phones), T0 + dt.timedelta(minutes=rnd.randrange(1 + n // 3)), text))
    return rows


def composed(spark, rows, menus, sessions=None):
    df = spark.createDataFrame(rows, "id long, phone string, ts timestamp_ntz, text string")
    return dialogue.dialogue_steps(df, menus, sessions)


@pytest.mark.parametrize("width", [3])
def test_equals_the_serial_walk(spark, clinic, monkeypatch, width):
    monkeypatch.setattr(dialogue, "SLICE", width)
    menus = dialogue.menu_tables(*clinic, AS_OF)
    rnd = random.Random(width)
    # Many phones, and one that never says a resetting word.
    rows = talk(rnd, 400, ["+1", "+2", "+3"], WORDS)
    calm = ["1"] * 8 + ["4", "2", "ann lee", "bo", "status", "+1", "x", "99"]
    rows += [(1000 + i, "+9", ts, text) for i, _, ts, text in talk(rnd, 500, ["+9"], calm)]
    want = serial(rows, serial_menus(menus))
    assert len([r for r in want if r[0] == "+9" and r[6] == "book"]) > 5
    assert {r[11] for r in want} >= {"book", "ask_name", "no_dates", "reprompt", "status", "cancel", "departments"}
    got = [tuple(r) for r in composed(spark, rows, menus).collect()]
    assert len(got) == len(rows) and set(got) == want


def test_sessions_go_on_where_they_stood(spark, clinic):
    """A history cut anywhere and continued from the sessions gives the same transitions; phones stand where the walk leaves them."""
    menus = dialogue.menu_tables(*clinic, AS_OF)
    rows = talk(random.Random(5), 200, ["+1", "+2", "+3", "+4"], [w for w in WORDS if w != "hi"])
    want = serial(rows, serial_menus(menus))
    rows.sort(key=lambda r: (r[2], r[0]))
    sessions, got = None, []
    for part in (rows[:60], rows[60:61], rows[61:]):
        steps = composed(spark, part, menus, sessions)
        sessions = dialogue._written(dialogue.sessions_after(steps, sessions), "test-sessions")
        got += [tuple(r) for r in steps.collect()]
    assert set(got) == want
    last = {}
    for r in sorted(want, key=lambda r: (r[2], r[1])):
        last[r[0]] = (r[5], *r[12:])
    assert {r.phone: (r.step, r.dept, r.doctor_id, r.date, r.slot) for r in sessions.collect()} == last


def test_nothing_said(spark, clinic):
    menus = dialogue.menu_tables(*clinic, AS_OF)
    assert composed(spark, [], menus).collect() == []
    one = composed(spark, [(1, "+1", T0, "hello there")], menus).collect()
    assert [(r.from_step, r.to_step, r.reply_kind) for r in one] == [("start", "choose_dept", "departments")]
