"""Stream = batch for the message log; golden dialogue for the state machine."""

import datetime as dt
import os
import tempfile

from slotwise.streaming import ingest
from tests.serial_walk import MemoryMenus, step_once

SEED_DEPTS = ["Cardiology", "General OPD", "Gynecology", "Orthopedics", "Pediatrics"]


def test_message_log_stream_equals_batch(spark):
    from slotwise.sources.fixtures import tables
    from tests.conftest import SF_SMALL

    msgs = tables(spark, SF_SMALL).messages
    root = tempfile.mkdtemp(prefix="slotwise-stream-")
    src = os.path.join(root, "in")
    msgs.repartition(3).write.parquet(src)
    sink, ckpt = os.path.join(root, "out"), os.path.join(root, "ckpt")
    q = ingest.start_message_log(spark, src, sink, ckpt)
    q.awaitTermination()
    streamed = spark.read.parquet(sink)
    batch = ingest.message_log(msgs)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0
    q2 = ingest.start_message_log(spark, src, sink, ckpt)  # restart: nothing new
    q2.awaitTermination()
    assert spark.read.parquet(sink).count() == batch.count()


def _menus():
    ramesh = {"id": 1, "name": "Dr. Ramesh Kumar", "department": "General OPD"}
    priya = {"id": 2, "name": "Dr. Priya Sharma", "department": "General OPD"}
    return MemoryMenus(
        SEED_DEPTS,
        {"General OPD": [ramesh, priya]},
        {1: ["2025-06-09", "2025-06-10"]},
        {(1, "2025-06-09"): ["09:00", "09:15", "09:30"]},
        {(2, "2025-06-09")},
    )


def test_golden_dialogue():
    menus, step, data = _menus(), "start", {}
    kinds = []
    for text in ["hi", "2", "1", "1", "2", "rahul sharma"]:
        step, data, out = step_once(step, data, text, menus)
        kinds.append(out["reply_kind"])
    assert kinds == ["departments", "doctors", "dates", "slots", "ask_name", "book"]
    assert out["command"] == "book" and out["name"] == "Rahul Sharma"
    assert (out["doctor_id"], out["date"], out["slot"]) == (1, "2025-06-09", "09:15")
    assert step == "start"


def test_reprompts_and_global_words():
    menus = _menus()
    step, data, out = step_once("choose_dept", {"depts": SEED_DEPTS}, "9", menus)
    assert (step, out["reply_kind"]) == ("choose_dept", "reprompt")
    step, data, out = step_once("choose_slot", {"slots": ["09:00"]}, "status", menus)
    assert (step, out["command"]) == ("choose_slot", "status")
    step, data, out = step_once("choose_slot", {"slots": ["09:00"]}, "cancel", menus)
    assert (step, data, out["command"]) == ("start", {}, "cancel")
    step, data, out = step_once("confirm_name", {"doctor": {"id": 1}, "date": "2025-06-09", "slot": "09:00"}, "x", menus)
    assert (step, out["reply_kind"]) == ("confirm_name", "ask_name")
    step, data, out = step_once("idle", {}, "anything", menus)
    assert step == "choose_dept"


def test_chat_pipeline_over_two_runs(spark):
    """Two runs over two file drops: sessions, ledger and menus go on from the first to the second; a replay changes nothing."""
    import uuid

    from pyspark.sql import functions as F

    from slotwise.operators import arbitration
    from slotwise.session import scratch_path
    from slotwise.sources.fixtures import AS_OF, tables
    from slotwise.streaming import commands, dialogue, pipeline
    from tests.conftest import SF_SMALL

    t = tables(spark, SF_SMALL)
    root = scratch_path(spark, "pipeline-test", uuid.uuid4().hex)
    src, ckpt, name = os.path.join(root, "in"), os.path.join(root, "ckpt"), "chat-" + uuid.uuid4().hex
    msgs = t.messages
    # In the middle of the dialogues of one conversation.
    cut = dt.datetime(2025, 6, 1, 3, 30, 3)
    parts = [msgs.where(F.col("ts") < cut), msgs.where(F.col("ts") >= cut)]
    ledger, sessions, want, said = t.appointments, None, [], []
    for i, part in enumerate(parts):
        part.write.parquet(os.path.join(src, f"part{i}"))
        args = (os.path.join(src, "*"), t.doctors, t.doctor_leaves, t.appointments, AS_OF, name, ckpt)
        pipeline.start_chat_pipeline(spark, *args).awaitTermination()
        menus = dialogue.menu_tables(t.doctors, t.doctor_leaves, ledger, AS_OF)
        steps = dialogue._written(dialogue.dialogue_steps(ingest.tagged_messages(part), menus, sessions), "test-steps")
        done = arbitration.arbitrate(ledger, steps, t.doctors, t.doctor_leaves)
        ledger = dialogue._written(arbitration.merged(ledger, done.changes), "test-ledger")
        sessions = dialogue.sessions_after(steps, sessions)
        want += [tuple(r) for r in steps.collect()]
        said += [tuple(r) for r in arbitration.replies(done.outcomes, t.doctors).collect()]
    columns = ["phone", "msg_id", "ts", "intent", "from_step", "to_step", "command", "doctor_id", "date", "slot", "name", "reply_kind",
               "at_dept", "at_doctor_id", "at_date", "at_slot"]
    got = commands.written(spark, name, "transitions").select(columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    replies = commands.written(spark, name, "replies")
    assert sorted(tuple(r)[:3] for r in replies.collect()) == sorted(said) and len(said) > 20
    booked = [r for r in want if r[6] == "book"]
    assert booked and replies.where(F.col("msg_id").isin([r[1] for r in booked])).count() == len(booked)
    final = sorted(map(repr, map(tuple, ledger.collect())))
    assert sorted(map(repr, map(tuple, commands.current_ledger(spark, name, t.appointments).collect()))) == final
    stand = lambda df: {r.phone: (r.step, r.dept, r.doctor_id, r.date, r.slot) for r in df.collect()}
    assert stand(commands.current_sessions(spark, name)) == stand(sessions)
    # A batch writes its own changes, not the ledger; a new base leaves the ledger as it is.
    assert commands.written(spark, name, "changes").count() < 0.2 * ledger.count()
    commands.compact(spark, name, t.appointments)
    assert [r.kind for r in commands.commits(spark, name)] == ["base"] and commands.last_applied_batch(spark, name) == 1
    assert sorted(map(repr, map(tuple, commands.current_ledger(spark, name, t.appointments).collect()))) == final
    assert stand(commands.current_sessions(spark, name)) == stand(sessions)
