"""Exact deduplication by 128-bit content hash, with a byte comparison.

1. Each text is normalised (A-Z lower-cased, null as empty) and hashed.
2. Rows are grouped by (128-bit hash, text).  The aggregation compares the
   bytes of the texts inside a hash group, so two different texts with one
   hash end up in two groups.  Map-side partial aggregation collapses a hot
   group to one row per task before the shuffle.
3. Every row is joined back to its group by the 128-bit hash and the SHA-256
   of its text (hashes only: no text is shuffled a second time).  The join is
   a plain equi-join, so adaptive execution splits a hot group.

Only built-in functions are used.

Defined cases: null text equals the empty text; rows that repeat a document
id inside a group all count towards ``group_size`` and are kept together
(nothing tells them apart); a group of null ids keeps its null ids.  Columns
of the input other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import ascii_lower


def content_hash(text: Column) -> Column:
    """128-bit hash of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    hash128: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``max`` or ``min``: which id of equal texts stays.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("body")).select(
        "doc_id", "body", hash128(F.col("body")).alias("h"), F.unhex(F.sha2("body", 256)).alias("sha")
    )
    pick = F.max if keep == "max" else F.min
    groups = (
        rows.groupBy("h", "body", "sha")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .drop("body")
    )
    return (
        rows.select("doc_id", "h", "sha")
        .join(groups, ["h", "sha"])
        .select(
            "doc_id",
            "keep_id",
            F.col("group_size").cast("bigint").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the largest (or least) id.

    Rows are grouped by hash and bytes and carry their columns along, so every
    distinct text is shuffled once, copies are combined before the shuffle, and
    exactly one row of a text stays even where ids repeat.  A null id stays only
    where the group has no other; of rows with one id the tie is broken by a
    digest of the whole row, so reruns agree.
    """
    others = [_named(c) for c in docs.columns if c != "text"]
    text = F.col("text")
    whole = F.concat(F.to_json(F.struct(*others)), F.when(text.isNull(), "-").otherwise(F.concat(F.lit("+"), text)))
    known = F.col("doc_id").isNotNull() if keep == "max" else F.col("doc_id").isNull()
    rows = docs.select(
        F.struct(*[_named(c) for c in docs.columns]).alias("row"),
        F.struct(known.alias("known"), "doc_id", F.unhex(F.md5(whole.cast("binary"))).alias("tie")).alias("place"),
        ascii_lower(text).alias("body"),
    ).withColumn("h", content_hash(F.col("body")))
    pick = F.max_by if keep == "max" else F.min_by
    return rows.groupBy("h", "body").agg(pick("row", "place").alias("row")).select("row.*")


def _named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")
