"""Row numbering within groups, in slices, so that no task holds a whole group.

``row_number().over(Window.partitionBy(k).orderBy(o))`` sends every row of a
group to one task; if one key holds a third of the table, that task holds a
third of the table.  :func:`number_rows` cuts every group into *slices*: the
values of ``slices`` are coarse, deterministic functions of the order (a range
of ids, a day, an hour) that never decrease along it.

1. rows are numbered inside their (keys, slice) — one shuffle on both;
2. the slice sizes, counted map-side from keys and slices alone (no payload is
   read, no row shuffled for them), are added up in order of the slices of a
   group (one small row per slice);
3. number = rows of the earlier slices + number inside the slice.

There is one path for every size of data, nothing is sampled or collected, and
no job runs while the plan is built.  Null keys form a group like any other
(the join of step 3 is null-safe).

:func:`positions` gives the places of rows in a global order, which has no such
slices: its ranges come from the sort itself, so the sorted rows are written
once and read back.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.session import ensure_checkpoint_dir, scratch_path

_SLICE, _INSIDE, _OFFSET, _OTHER = "__slice", "__inside", "__offset", "__other_"

# Ids per slice where a group is cut by id ranges.
IDS_PER_SLICE = 1 << 20


def id_slice(id_col: str | Column, width: int = IDS_PER_SLICE) -> Column:
    """Slice of an integer id: its range of ``width`` ids (null ids come first, as in an ascending order)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.floor(c / F.lit(width))


def number_rows(df: DataFrame, keys: list[str], order: list, name: str, slices: list[Column]) -> DataFrame:
    """Append ``name`` = 1-based position of each row in its group by ``order``.

    ``order`` should make the position unique (end it with an id column).
    ``slices`` must not decrease along ``order`` within a group.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    sliced = df.withColumn(_SLICE, F.struct(*[s.alias(f"s{i}") for i, s in enumerate(slices)]))
    inside = sliced.withColumn(
        _INSIDE, F.row_number().over(Window.partitionBy(*keys, _SLICE).orderBy(*order_cols)).cast("bigint")
    )
    sizes = sliced.groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias(_OFFSET))
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(_OTHER + k) for k in [*keys, _SLICE]],
        F.coalesce(F.sum(_OFFSET).over(before), F.lit(0)).alias(_OFFSET),
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(_OTHER + k)) for k in [*keys, _SLICE]])
    return inside.join(offsets, same).select(
        *[F.col(c) for c in df.columns], (F.col(_INSIDE) + F.col(_OFFSET)).cast("bigint").alias(name)
    )


def positions(ordered: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of a sorted DataFrame with ``position``, the 1-based place of each row in it.

    The sort cuts the rows into ranges, by bounds that it samples: two runs of
    it need not agree.  So it runs once, into a table in the shared folder, in
    which every row has its range and its place there; sizes of the ranges (a
    row each) are added up and joined to what was written.
    """
    spark = ordered.sparkSession
    ensure_checkpoint_dir(spark)
    at = F.monotonically_increasing_id()  # the range above 33 bits, the row inside below
    placed = ordered.select(*columns, at.alias("__at"))
    path = scratch_path(spark, "positions", uuid.uuid4().hex)
    placed.write.parquet(path)
    written = spark.read.schema(placed.schema).parquet(path).withColumn("__range", F.shiftright("__at", 33))
    sizes = written.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(offsets, "__range").select(*columns, (F.col("__offset") + inside + 1).alias("position"))
