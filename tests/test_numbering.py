"""Places of rows in a global order, at a size where the sort samples its ranges."""

import pytest
from pyspark.sql import functions as F

from slotwise.plans.numbering import number_rows, positions


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("n", [0, 1, 20_000, 3_000_000])
def test_every_position_once(spark, adaptive, n):
    """Returned columns outside the sort key; ties in its first column."""
    rows = spark.range(n).select("id", F.concat(F.lit("payload "), "id").alias("text"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"))
    got = positions(rows.orderBy("a", F.desc("id")), "id", "text", "a").cache()
    try:
        found = got.agg(F.count("*"), F.countDistinct("position"), F.min("position"), F.max("position")).first()
        assert tuple(found) == ((n, n, 1, n) if n else (0, 0, None, None))
        # Neighbours are in order, so with every position present the order is right.
        by = got.selectExpr("position AS p", "a", "id", "text")
        after = got.selectExpr("position - 1 AS p", "a AS a2", "id AS id2")
        assert by.join(after, "p").where("a > a2 OR (a = a2 AND id < id2)").count() == 0
        assert by.where("text <> concat('payload ', id)").count() == 0
    finally:
        got.unpersist()


def test_sizes_of_slices_read_no_payload(spark):
    """The second copy of the input is counted before its shuffle, from keys and slices alone."""
    rows = spark.range(1000).selectExpr("id", "id % 3 AS k", "repeat('x', 10) AS payload")
    plan = number_rows(rows, ["k"], ["id"], "n", [F.floor(F.col("id") / 100)])._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "partial_count" in physical
    assert physical.count("repeat") + physical.count("xxxxxxxxxx") <= 1
