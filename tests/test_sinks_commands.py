"""CSV bytes, snapshots and the idempotent command stream."""

import csv
import datetime as dt
import glob
import io
import os
import uuid

from pyspark.sql import functions as F

from slotwise.session import scratch_path
from slotwise.sources import sinks
from slotwise.streaming import commands

APPT = "id long, patient_phone string, patient_name string, doctor_id long, appointment_date date, " \
       "slot_time string, token_number long, status string"
LEAVES = "id long, doctor_id long, leave_date date, reason string"


def test_csv_matches_python_csv_writer(spark):
    rows = [(1, 'Asha "A" Rao', "+91,1", None, "2025-07-01"), (2, "plain", " padded ", "x", "2025-07-02")]
    df = spark.createDataFrame(rows, "Token long, Name string, Phone string, Doctor string, Date string")
    out = scratch_path(spark, "csv-test", uuid.uuid4().hex)
    sinks.write_csv(df.coalesce(1), out)
    (part,) = glob.glob(os.path.join(out, "part-*.csv"))
    got = open(part, newline="").read()
    buf = io.StringIO()
    w = csv.writer(buf)
    w.writerow(df.columns)
    for r in rows:
        w.writerow(["" if v is None else v for v in r])
    assert got == buf.getvalue()


def test_snapshot_publish_and_read(spark):
    df = spark.range(5)
    name = "snap-" + uuid.uuid4().hex
    path = sinks.write_snapshot(df, name)
    assert sinks.current_snapshot(spark, name) == path
    assert spark.read.parquet(path).count() == 5


def test_command_batches_apply_once(spark, seed):
    day = dt.date(2025, 6, 10)
    ledger = spark.createDataFrame([(1, "whatsapp:+1", "A", 3, day, "09:00", 1, "booked")], APPT)
    leaves = spark.createDataFrame([], LEAVES)
    ts = dt.datetime(2025, 6, 1, 9, 0)
    cmds = spark.createDataFrame(
        [(10, "whatsapp:+2", ts, "book", 3, "2025-06-10", "09:20", "Ravi"),
         (11, "whatsapp:+3", ts, "book", 3, "2025-06-10", "09:20", "Meena"),
         (12, "whatsapp:+1", ts, "cancel", None, None, None, None)],
        "msg_id long, phone string, ts timestamp_ntz, command string, doctor_id long, date string, "
        "slot string, name string",
    )
    name = "ledger-" + uuid.uuid4().hex
    write = commands.ledger_writer(name, seed, leaves, ledger)
    write(cmds, 0)
    write(cmds, 0)  # replay of batch 0: skipped
    assert commands.last_applied_batch(spark, name) == 0
    out = {r.id: (r.patient_name, r.status, r.token_number) for r in commands.current_ledger(spark, name, ledger).collect()}
    # the cancel takes the phone's only booking; Meena loses the slot to Ravi
    assert out == {1: ("A", "cancelled", 1), 2: ("Ravi", "booked", 2)}


def test_daily_reminders_write_each_notice_once(spark):
    from slotwise.operators import messaging
    from slotwise.sources.fixtures import AS_OF, tables
    from tests.conftest import SF_SMALL

    t = tables(spark, SF_SMALL)
    path = scratch_path(spark, "outbox-test", uuid.uuid4().hex)
    first = messaging.run_daily_reminders(t.appointments, t.doctors, AS_OF, "+919999999999", path)
    again = messaging.run_daily_reminders(t.appointments, t.doctors, AS_OF, "+919999999999", path)
    stored = spark.read.parquet(path)
    assert first > 0 and again == 0 and stored.count() == first
    assert stored.groupBy("kind", "ref_id", "as_of").count().where("count > 1").count() == 0


def test_chart_series_json_lines_round_trip(spark):
    from slotwise.operators import analytics
    from slotwise.sources.fixtures import AS_OF, tables
    from tests.conftest import SF_SMALL

    t = tables(spark, SF_SMALL)
    series = analytics.chart_series(t.appointments, t.doctors, AS_OF)
    path = scratch_path(spark, "json-test", uuid.uuid4().hex)
    sinks.write_json_lines(series.select("series", "label", "count"), path, partition_by="series")
    back = spark.read.json(path).select("series", "label", F.col("count").cast("bigint").alias("count"))
    assert back.exceptAll(series.select("series", "label", "count")).count() == 0
    assert back.count() == series.count()


def test_seed_table_is_idempotent(spark):
    from slotwise.sources.seed import seed_doctors_table

    path = scratch_path(spark, "seed-test", uuid.uuid4().hex)
    assert seed_doctors_table(spark, path) is True
    assert seed_doctors_table(spark, path) is False
    rows = spark.read.parquet(path).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4, 5, 6] and rows[0].slot_duration_mins == 15
