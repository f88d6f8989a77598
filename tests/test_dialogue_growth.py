"""What the dialogue's joins and windows make grows with messages plus menus, not with their product."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from slotwise.session import scratch_path
from slotwise.streaming import dialogue

AS_OF = dt.date(2025, 7, 1)
T0 = dt.datetime(2025, 6, 1)
PHONES, DOCTORS = 60, 300


def joined(plan) -> list[int]:
    """Rows that each join of an executed plan gave out."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return joined(plan.executedPlan())
    if name.endswith("QueryStage"):
        return joined(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    children = plan.children()
    return own + [n for i in range(children.size()) for n in joined(children.apply(i))]


def test_a_menu_is_not_joined_to_every_question(spark, monkeypatch):
    """Many phones ask for a department of many doctors."""
    doctors = spark.range(1, DOCTORS + 1).selectExpr(
        "id", "concat('Dr. ', id) AS name", "'ENT' AS department", "'Mon,Tue,Wed,Thu,Fri' AS available_days",
        "30 AS slot_duration_mins", "'09:00' AS start_time", "'10:00' AS end_time",
    )
    leaves = spark.createDataFrame([], "id long, doctor_id long, leave_date date, reason string")
    booked = spark.createDataFrame([], "doctor_id long, appointment_date date, slot_time string, status string")
    texts = ["hi", "1", "999", "2", "1", "1", "ann lee"]
    rows = [(10 * i + j, f"+{i}", T0 + dt.timedelta(seconds=j), x) for i in range(PHONES) for j, x in enumerate(texts)]
    said = spark.createDataFrame(rows, "id long, phone string, ts timestamp_ntz, text string")
    made = []

    def written(df, name):
        out = df.collect()
        made.extend(joined(df._jdf.queryExecution().executedPlan()))
        path = scratch_path(df.sparkSession, "dialogue", f"{name}-{uuid.uuid4().hex}")
        spark.createDataFrame(out, df.schema).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(dialogue, "_written", written)
    steps = dialogue.dialogue_steps(said, dialogue.menu_tables(doctors, leaves, booked, AS_OF)).collect()
    done = [(r.doctor_id, r.date, r.slot, r.name) for r in steps if r.command == "book"]
    assert done == [(2, "2025-07-02", "09:00", "Ann Lee")] * PHONES
    assert sum(r.reply_kind == "reprompt" for r in steps) == PHONES
    assert made and max(made) <= 5 * (len(rows) + DOCTORS)


def test_later_rows_are_added_up_once(spark):
    """No window frame shrinks from row to row, which Spark goes through anew for each row."""
    rows = spark.range(10).selectExpr("1 AS phone", "id AS p")
    found = dialogue.first_after(rows, ["phone"], next=F.when(F.col("p") % 3 == 0, F.col("p")))
    assert {r.p: r.next for r in found.collect()} == {p: next((q for q in range(p + 1, 10) if q % 3 == 0), None) for p in range(10)}
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
