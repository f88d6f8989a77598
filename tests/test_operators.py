"""Golden and property tests for the operators on tiny hand-made inputs."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotwise.operators import analytics, availability, ledger, quality, reports
from slotwise.plans.numbering import number_rows

D = dt.date
APPT = "id long, patient_phone string, patient_name string, doctor_id long, appointment_date date, " \
       "slot_time string, token_number long, status string"
LEAVES = "id long, doctor_id long, leave_date date, reason string"


def test_seed_grid_sizes(seed):
    grid = availability.slot_grid(seed)
    sizes = {r.doctor_id: r["count"] for r in grid.groupBy("doctor_id").count().collect()}
    assert sizes == {1: 16, 2: 16, 3: 9, 4: 9, 5: 6, 6: 16}
    first = [r.slot_time for r in grid.where("doctor_id = 3").orderBy("slot_no").collect()]
    assert first[:3] == ["09:00", "09:20", "09:40"] and first[-1] == "11:40"


def test_degenerate_grids(spark):
    d = spark.createDataFrame(
        [(1, "a", "X", "Mon", 0, "09:00", "10:00"), (2, "b", "X", "Mon", 15, "10:00", "10:00"),
         (3, "c", "X", "Mon", 25, "09:00", "09:30"), (4, "d", "X", "Mon", 15, "bad", "10:00")],
        "id long, name string, department string, available_days string, slot_duration_mins int, "
        "start_time string, end_time string",
    )
    got = {r.doctor_id: r.slot_time for r in availability.slot_grid(d).collect()}
    assert got == {3: "09:00"} or sorted(r.slot_time for r in availability.slot_grid(d).collect()) == ["09:00", "09:25"]
    assert sorted(r.slot_time for r in availability.slot_grid(d).collect()) == ["09:00", "09:25"]


def test_available_dates_skip_leaves_and_today(spark, seed):
    as_of = D(2025, 6, 9)  # a Monday
    leaves = spark.createDataFrame([(1, 5, D(2025, 6, 11), "x")], LEAVES)
    got = availability.available_dates(seed.where("id = 5"), leaves, as_of).orderBy("date_no").collect()
    # Mon/Wed/Fri doctor, 11 Jun on leave, today excluded, five dates
    assert [r.available_date for r in got] == [D(2025, 6, 13), D(2025, 6, 16), D(2025, 6, 18),
                                                D(2025, 6, 20), D(2025, 6, 23)]


def test_free_slots_partition_the_grid(spark, seed):
    day = D(2025, 6, 10)
    appts = spark.createDataFrame(
        [(1, "p1", "A", 3, day, "09:20", 1, "booked"), (2, "p2", "B", 3, day, "09:40", 2, "cancelled"),
         (3, "p3", "C", 3, day, "10:00", 3, "completed"), (4, "p4", "D", 3, day, "09:20", 4, "booked"),
         (5, "p5", "E", 3, day, "13:00", 5, "booked")],
        APPT,
    )
    free = availability.available_slots(seed, appts, appts)
    got = [r.slot_time for r in free.orderBy("slot_no").collect()]
    grid = [r.slot_time for r in availability.slot_grid(seed.where("id = 3")).orderBy("slot_no").collect()]
    assert "09:20" not in got and "09:40" in got and "10:00" in got  # only booked blocks
    assert sorted(got + ["09:20"]) == sorted(grid)
    assert [r.slot_no for r in free.orderBy("slot_no").collect()] == list(range(1, len(got) + 1))


def test_active_drops_null_status_and_namesakes_merge(spark):
    docs = spark.createDataFrame(
        [(1, "Dr. A", "X"), (2, "Dr. A", "Y"), (3, "Dr. B", "X")], "id long, name string, department string"
    )
    appts = spark.createDataFrame(
        [(1, "p", None, 1, D(2025, 7, 1), "09:00", 1, "booked"), (2, "p", None, 2, D(2025, 7, 1), "09:00", 1, None),
         (3, "p", None, 2, D(2025, 7, 1), "09:15", 2, "completed"), (4, "p", None, 3, D(2025, 7, 2), "09:00", 1, "cancelled"),
         (5, "p", None, 9, D(2025, 7, 2), "09:00", 1, "booked")],
        APPT,
    )
    by_doc = {r.name: r["count"] for r in analytics.counts_by_doctor(appts, docs).collect()}
    assert by_doc == {"Dr. A": 2}  # NULL status dropped, dangling doctor 9 dropped by the join
    daily = {r.appointment_date: r["count"] for r in analytics.daily_counts(appts, D(2025, 7, 1)).collect()}
    assert daily == {D(2025, 7, 1): 2}  # future day 2 Jul excluded
    assert analytics.busiest_day(appts).first().appointment_date == D(2025, 7, 1)
    assert quality.dangling_appointments(appts, docs).count() == 1
    assert analytics.top_department(appts.limit(0), docs).first().department == "—"


import pytest


@pytest.mark.parametrize("width", [1, 50, 10**9])  # rows per slice
def test_number_rows_equals_row_number_on_skewed_and_null_keys(spark, width):
    # one key holds a third of the rows, another key is null
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 7 != 1, F.col("id") % 97).alias("k"),
        (F.col("id") * 7919 % 3001).alias("o"), F.col("id"),
    )
    got = number_rows(df, ["k"], ["o", "id"], "rn", [F.floor(F.col("o") / width)])
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    glob = number_rows(df, [], ["o", "id"], "rn", [F.floor(F.col("o") / width)])
    assert sorted(r.rn for r in glob.collect()) == list(range(1, 3001))


def test_number_rows_runs_no_job_while_building(spark):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    number_rows(spark.range(0, 100), [], ["id"], "rn", [F.floor(F.col("id") / 10)])
    assert set(tracker.getJobIdsForGroup()) == before


def test_requests_with_null_keys_are_answered(spark):
    """A request without a doctor is answered like any other that names none."""
    leaves = spark.createDataFrame([], "doctor_id long, leave_date date")
    docs = spark.createDataFrame([(1, "a")], "id long, name string")
    cols = "id long, patient_phone string, patient_name string, doctor_id long, appointment_date date, slot_time string"
    rows = [(1, "+1", "x", None, D(2025, 7, 1), "09:00"), (2, "+2", "y", 1, None, "09:00"), (3, "+3", "z", 1, D(2025, 7, 1), "09:00")]
    ledger_rows = spark.createDataFrame([], cols + ", token_number long, status string")
    out = ledger.book_requests(ledger_rows, spark.createDataFrame(rows, cols), docs, leaves).collect()
    assert len(out) == 3 and {r.id: r.outcome for r in out}[1] == "unknown_doctor"


def test_tokens_are_dense_per_doctor_day(spark):
    appts = spark.range(0, 500).select(
        F.col("id"), (F.col("id") % 3).alias("doctor_id"), F.lit(D(2025, 7, 1)).alias("appointment_date")
    )
    tok = ledger.token_numbers(appts)
    per = tok.groupBy("doctor_id").agg(F.min("token_number").alias("lo"), F.max("token_number").alias("hi"),
                                       F.count("*").alias("n"), F.countDistinct("token_number").alias("d"))
    for r in per.collect():
        assert r.lo == 1 and r.hi == r.n == r.d


def test_book_requests_serial_semantics(spark, seed):
    day = D(2025, 6, 10)
    ledger_df = spark.createDataFrame(
        [(1, "p1", "A", 3, day, "09:00", 1, "booked"), (2, "p2", "B", 3, day, "09:20", 2, "cancelled")], APPT
    )
    leaves = spark.createDataFrame([(1, 4, day, "x")], LEAVES)
    req = spark.createDataFrame(
        [(10, "q1", "Q1", 3, day, "09:00", None, None),   # taken in ledger
         (11, "q2", "Q2", 3, day, "09:20", None, None),   # cancelled frees it -> accepted, token 3
         (12, "q3", "Q3", 3, day, "09:20", None, None),   # taken by request 11
         (13, "q4", "Q4", 4, day, "10:00", None, None),   # doctor 4 on leave
         (14, "q5", "Q5", 99, day, "10:00", None, None),  # unknown doctor
         (15, "q6", "Q6", 3, day, "09:40", None, None)],  # accepted, token 4
        APPT,
    )
    out = {r.id: (r.outcome, r.token_number) for r in ledger.book_requests(ledger_df, req, seed, leaves).collect()}
    assert out == {10: ("slot_taken", None), 11: ("accepted", 3), 12: ("slot_taken", None),
                   13: ("on_leave", None), 14: ("unknown_doctor", None), 15: ("accepted", 4)}
    new = ledger.apply_bookings(ledger_df, ledger.book_requests(ledger_df, req, seed, leaves))
    booked = new.where("status = 'booked'").groupBy("doctor_id", "appointment_date", "slot_time").count()
    assert booked.where("count > 1").count() == 0


def test_cancel_earliest_kth_request(spark, seed):
    ledger_df = spark.createDataFrame(
        [(1, "whatsapp:+1", "A", 1, D(2025, 6, 12), "09:00", 1, "booked"),
         (2, "whatsapp:+1", "A", 1, D(2025, 6, 11), "10:00", 1, "booked"),
         (3, "whatsapp:+1", "A", 9, D(2025, 6, 1), "09:00", 1, "booked"),   # dangling doctor: invisible
         (4, "whatsapp:+1", "A", 1, D(2025, 6, 11), "09:00", 2, "completed")],
        APPT,
    )
    ts = dt.datetime(2025, 6, 1)
    req = spark.createDataFrame([("whatsapp:+1", 100, ts), ("whatsapp:+1", 101, ts), ("whatsapp:+1", 102, ts)],
                                "phone string, request_id long, ts timestamp_ntz")
    out = {r.request_id: (r.outcome, r.appointment_id)
           for r in ledger.cancel_earliest(ledger_df, seed, req).collect()}
    assert out == {100: ("cancelled", 2), 101: ("cancelled", 1), 102: ("not_found", None)}


def test_session_latest_idempotent(spark):
    ups = spark.createDataFrame(
        [("p", "a", "{}", dt.datetime(2025, 1, 1), 1), ("p", "b", "{}", dt.datetime(2025, 1, 1), 2),
         ("q", "c", "{}", dt.datetime(2025, 1, 2), 3)],
        "phone string, step string, temp_data string, updated_at timestamp_ntz, seq long",
    )
    once = ledger.session_latest(ups)
    twice = ledger.session_latest(once.withColumn("seq", F.lit(0).cast("long")))
    assert {r.phone: r.step for r in once.collect()} == {"p": "b", "q": "c"}
    assert once.exceptAll(twice).count() == 0


def test_single_key_equals_set_form_filtered(spark, seed):
    keys = spark.createDataFrame([(1,), (2,), (42,)], "doctor_id long")
    from slotwise.operators import lookups

    all_ = lookups.doctor_lookup(keys, seed)
    one = lookups.doctor_lookup(keys.where("doctor_id = 2"), seed)
    assert one.exceptAll(all_.where("doctor_id = 2")).count() == 0
    assert all_.where("doctor_id = 42").first().name is None


def test_leave_insert_keeps_first_reason_and_rejects_bad_dates(spark):
    leaves = spark.createDataFrame([(1, 1, D(2025, 6, 10), "old")], LEAVES)
    req = spark.createDataFrame(
        [(5, 1, "2025-06-10", "new"), (6, 2, "2025-06-11", "first"), (7, 2, "2025-06-11", "second"),
         (8, 3, "2025-02-30", "bad")],
        "request_id long, doctor_id long, leave_date string, reason string",
    )
    nxt, errors = ledger.leave_insert(leaves, req), ledger.leave_errors(req)
    assert {(r.id, r.doctor_id, r.reason) for r in nxt.collect()} == {(1, 1, "old"), (2, 2, "first")}
    assert [r.request_id for r in errors.collect()] == [8]


def test_doctors_with_leaves_nested(spark, seed):
    leaves = spark.createDataFrame([(2, 1, D(2025, 6, 12), "b"), (1, 1, D(2025, 6, 10), "a")], LEAVES)
    rows = {r.id: r.leaves for r in reports.doctors_with_leaves(seed, leaves).collect()}
    assert [l.id for l in rows[1]] == [1, 2] and rows[2] == []


def test_analytics_bundle_equals_single_queries(spark):
    from slotwise.sources.fixtures import AS_OF, tables
    from tests.conftest import SF_SMALL

    t = tables(spark, SF_SMALL)
    b = analytics.analytics_bundle(t.appointments, t.doctors, AS_OF)
    singles = {
        "daily": analytics.daily_counts(t.appointments, AS_OF),
        "by_dept": analytics.counts_by_department(t.appointments, t.doctors),
        "by_doctor": analytics.counts_by_doctor(t.appointments, t.doctors),
        "month_total": analytics.month_total(t.appointments, AS_OF),
        "busiest_day": analytics.busiest_day(t.appointments),
        "busiest_doctor": analytics.busiest_doctor(t.appointments, t.doctors),
    }
    for k, df in singles.items():
        assert b[k].collect() == df.collect(), k


def test_outbox_is_idempotent(spark):
    from slotwise.operators import messaging
    from slotwise.sources.fixtures import AS_OF, tables
    from tests.conftest import SF_SMALL

    t = tables(spark, SF_SMALL)
    notices = {"reminder": messaging.reminders(t.appointments, t.doctors, AS_OF)}
    first = messaging.outbox(notices, AS_OF)
    doubled = messaging.outbox({"reminder": notices["reminder"].unionByName(notices["reminder"])}, AS_OF)
    assert doubled.count() == first.count() > 0
    assert messaging.outbox(notices, AS_OF, already_sent=first).count() == 0


def test_leave_removal_restores_nothing_and_status_guard(spark, seed):
    day = D(2025, 6, 10)
    appts = spark.createDataFrame(
        [(1, "p1", "A", 3, day, "09:00", 1, "booked"), (2, "p2", "B", 3, day, "09:20", 2, "completed")], APPT
    )
    leaves = spark.createDataFrame([(7, 3, day, "x")], LEAVES)
    hit = ledger.leave_cascade(appts, seed, leaves)
    after = ledger.apply_cascade(appts, hit)
    assert {r.id: r.status for r in after.collect()} == {1: "cancelled", 2: "completed"}
    remaining = ledger.leave_delete(leaves, spark.createDataFrame([(7,)], "id long"))
    assert remaining.count() == 0
    assert {r.id: r.status for r in after.collect()}[1] == "cancelled"  # B20: no restore
    ids = spark.createDataFrame([(2,)], "id long")
    assert ledger.cancel_by_id(appts, ids).where("id = 2").first().status == "cancelled"  # B21: no guard
    assert ledger.cancel_by_id(appts, ids, only_booked=True).where("id = 2").first().status == "completed"
