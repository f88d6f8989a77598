"""Mix sources to target weights: capped water-filling and seeded sampling.

*Targets.*  Sources share a word budget by weight; a source's target stops at
``max_epochs`` times its size.  Water-filling: while some open source would
exceed its cap, clamp every such source at its cap and share what is left
among the open ones by weight.  Each round is one aggregate over the table of
sources (a row per source); only scalars reach the driver.

*Sampling.*  A source with target t and size s repeats every document
floor(t / s) whole times.  What remains (a fraction of one more pass) goes to
documents in the order of a seeded hash until the target is met; the last one
is taken in part.  The running sums need no global sort: sizes are summed per
(source, leading hash digits), those sums are accumulated, and only the
documents of the one slice where the target falls are ordered exactly.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0; an empty table gives an
empty result; rows that repeat an id are ordered by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import WORD_PATTERN, cut, word_count

# Hex digits of the seeded hash that name a slice of a source (16**3 slices).
SLICE_DIGITS = 3


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights by code-point order of the source (null last), repeating."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(table, (place % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, budget_share: float, max_epochs: float) -> DataFrame:
    """Append ``target`` to (source, source_size, weight).

    A round clamps every open source whose proportional share is above its
    cap; the share of the others only grows, so clamped sources stay clamped
    and the loop ends after as many rounds as there are steps of clamping.
    """
    cap = F.col("source_size") * max_epochs
    level = None  # words per unit of weight for the open sources
    while True:
        # A source is clamped when level * weight has reached its cap.
        clamped = F.lit(False) if level is None else F.col("weight") * level > cap
        total, used, open_weight, open_n = sources.agg(
            F.sum("source_size"),
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(~clamped, 1)),
        ).first()
        budget = budget_share * float(total or 0)
        if open_n == 0 or open_weight == 0:
            return sources.withColumn("target", cap.cast("double"))
        new_level = (budget - used) / open_weight
        if level is not None and new_level <= level:
            share = F.col("weight") * F.lit(level)
            return sources.withColumn("target", F.when(clamped, cap).otherwise(share).cast("double"))
        level = new_level


def seeded_key(id_col: Column, seed: str) -> Column:
    """A hash of seed and document id, as hex text; orders documents at random."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def slice_plan(slices: DataFrame, weights: tuple[float, ...], budget_share: float, max_epochs: float) -> DataFrame:
    """What is taken where, a small row per (s_source, s_slice) of (source, slice, slice_size).

    Every document is taken ``whole`` times, and once more if its slice ends at
    or before ``extra`` words of its source; ``edge`` marks the one slice of a
    source in which that bound falls, ``start`` the words of the slices before.
    """
    sources = cyclic_weights(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights)
    sources = cut(sources, "mix-sources")
    targets = water_fill(sources, budget_share, max_epochs)
    s = F.col("source_size")
    plan = targets.select(
        "source",
        "source_size",
        "target",
        F.when(s > 0, F.floor(F.col("target") / s)).otherwise(0).cast("bigint").alias("whole"),
    ).withColumn("extra", F.round("target").cast("bigint") - F.col("whole") * s)

    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("start", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    sp = plan.select(F.col("source").alias("s_source"), "source_size", "target", "whole", "extra")
    return starts.join(sp, F.col("source").eqNullSafe(F.col("s_source"))).select(
        F.col("source").alias("s_source"),
        F.col("slice").alias("s_slice"),
        "source_size",
        "target",
        "whole",
        "extra",
        "start",
        ((F.col("start") < F.col("extra")) & (F.col("start") + F.col("slice_size") > F.col("extra"))).alias("edge"),
    )


def sizes(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, key, slice) of every document, written once."""
    return cut(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), seed).alias("key")
        ).withColumn("slice", F.substring("key", 1, SLICE_DIGITS)),
        "mix-sizes",
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    budget_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, epochs, taken."""
    sized = sizes(docs, seed)
    # One small row per (source, slice); everything about sources comes from it.
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    starts = slice_plan(slices, weights, budget_share, max_epochs)
    placed = sized.join(
        starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice"))
    ).drop("s_source", "s_slice")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size")
    edge = placed.where("edge").withColumn(
        "ahead", F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    rest = placed.where("NOT edge").withColumn("ahead", F.col("start"))
    # Outside the edge slice a document is taken wholly or not at all.
    part = F.when(
        F.col("edge"), F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("ahead")))
    ).otherwise(F.when(F.col("start") < F.col("extra"), F.col("size")).otherwise(F.lit(0)))
    return edge.unionByName(rest).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))).alias("epochs"),
        (F.col("whole") * F.col("size") + part).cast("bigint").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    budget_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: whole repetitions as
    repeated rows, and for the one document a source takes in part, its first
    words up to the target (``n_chars``, where present, follows the text).

    A document's slice follows from its id, so the plan of slices, a small
    written table, is joined to the documents as they are read.  Only those of
    an edge slice need sizes and an order; their texts stay out of it.

    Documents without words have nothing to take and carry no weight: one row
    of each stays, so that nothing is lost to a size of zero.  Rows that repeat
    an id count each; in an edge slice, rows that repeat id, source and text are
    one document as many times over.  Columns of any name are carried along.
    """
    slices = sizes(docs, seed).groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    starts = cut(slice_plan(slices, weights, budget_share, max_epochs), "mix-starts")
    names = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), seeded_key(F.col("doc_id"), seed).alias("key"))
    text = F.col("row.text")
    placed = rows.withColumn("slice", F.substring("key", 1, SLICE_DIGITS)).join(
        starts, F.col("row.source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice"))
    )
    # Outside the edge slice a document is taken wholly or not at all.
    has_words = F.coalesce(text.rlike(WORD_PATTERN), F.lit(False))
    times = F.when(has_words, F.col("whole") + (F.col("start") < F.col("extra")).cast("bigint")).otherwise(1)
    rest = placed.where("NOT edge").withColumn("times", times).where("times >= 1")
    rest = rest.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row")

    edge = placed.where("edge").select(
        "row", "key", "start", "whole", "extra",
        F.col("row.source").alias("source"), "slice", F.col("row.doc_id").alias("doc_id"),
        word_count(text).alias("size"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"),
    )
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "digest")
    words = F.col("n") * F.col("size")
    ahead = F.col("start") + F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - words
    amounts = (
        edge.groupBy("source", "slice", "key", "doc_id", "size", "digest", "start", "whole", "extra")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ahead", ahead)
        .select(
            F.col("source").alias("a_source"), F.col("doc_id").alias("a_id"), F.col("digest").alias("a_digest"), "n",
            (F.col("whole") * words + F.greatest(F.lit(0), F.least(words, F.col("extra") - F.col("ahead")))).alias("taken"),
        )
    )
    once = edge.dropDuplicates(["source", "doc_id", "digest"]).select("row", "source", "doc_id", "digest", "size")
    copies = F.when(F.col("size") == 0, F.col("n")).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    each = (
        once.join(
            amounts,
            F.col("source").eqNullSafe(F.col("a_source"))
            & F.col("doc_id").eqNullSafe(F.col("a_id"))
            & (F.col("digest") == F.col("a_digest")),
        )
        .where(copies >= 1)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    )
    left = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    partial = (F.col("size") > 0) & (left < F.col("size"))
    first_words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), left.cast("int")), " ")
    row = F.col("row").withField("text", F.when(partial, first_words).otherwise(text))
    if "n_chars" in docs.columns:
        shorter = F.length(first_words).cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(partial, shorter).otherwise(F.col("row.n_chars")))
    return rest.unionByName(each.select(row.alias("row"))).select("row.*")
