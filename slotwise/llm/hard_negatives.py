"""Hard-negative mining by a secondary sort of scored pairs.

Anchors meet all rows in a grid: rows are dealt to blocks, each of which is held
by a task while all anchors (a stated part of the rows) stream past it.  A cell,
a block and some anchors, keeps what an answer may still need:

1. *Positives.*  The best ``positives`` rows of the anchor's own label in each
   cell; the best of all cells are the anchor's positives.
2. *Candidates.*  Now that the positives' scores are known, the best
   ``negatives`` rows of other labels under each of their windows in each cell.

So a pair is made inside a task only, and a cell sends a bounded number of rows
per anchor, however many rows there are.

3. *Secondary sort.*  Positives and candidates carry a packed key (anchor,
   descending score, id).  They are partitioned by anchor and sorted by key
   inside the partitions (one shuffle), then streamed: the first rows of the
   anchor's label open their windows, and a later row of another label is
   emitted for every open window that it satisfies and that is not full.  No
   task holds the rows of an anchor.

A positive with a score above 0 comes before every row of its window.  At a
score of 0 the window is the score 0 itself, where smaller ids may come first:
the first ``negatives`` rows of score 0 are remembered.  Below 0 no row
satisfies both bounds.

Scores are exact: products are summed as doubles where they stay below 2^53,
else as 64-bit integers.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component, take no part, nor do vectors of another length than most (the
shorter at a tie).  Of rows that repeat an id the one with the least (label,
vector) counts.  A zero vector takes part; one whose scaled length passes 2^30
does not (its scores would not be 64-bit numbers).  An anchor without positives
has no rows.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import cut, ready, tasks

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative scores LOW to HIGH per cent of its positive
SCALE, LONGEST = 256, 1 << 30
# Rows that a task holds while anchors stream past, and anchors multiplied with them at a time.
BLOCK_ROWS, ANCHOR_ROWS = 65536, 256

SCORED = "anchor_id long, score long, vec_id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_SIGN = -(1 << 63)


def relabelled(vec_id: Column, label: Column) -> Column:
    """Every seventh id has the next of ten labels."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def usable(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    relabel: Callable[[Column, Column], Column] = relabelled,
) -> DataFrame:
    """(vec_id, label, vec: scaled and floored components) of the rows that take part."""
    vec = F.col("vec")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x * SCALE)
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), scaled.alias("vec"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull()).where(~bad)
    kept = kept.where(F.aggregate(vec, F.lit(0.0), lambda total, x: total + x * x) <= float(LONGEST) ** 2)
    lengths = kept.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is not None:
        kept = kept.where(F.size("vec") == lengths["n"])
    whole = kept.withColumn("vec", F.transform("vec", lambda x: F.floor(x)))
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("row")).select("vec_id", "row.*")
    return one.withColumn("label", relabel(F.col("vec_id"), F.col("label")))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` largest scores, ties by smaller id, in that order."""
    among = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
    return among[np.lexsort((ids[among], -scores[among]))][:k]


def bounds(positive_score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and largest negative score in the window of a positive."""
    return -(-low * positive_score // 100), high * positive_score // 100


class Block:
    """Rows of a block by (label, id)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, a row per anchor."""
        largest = [int(np.abs(x).max(initial=0)) for x in (anchors, self.vectors)]
        kind = np.float64 if largest[0] * largest[1] * anchors.shape[1] < 1 << 53 else np.int64
        return anchors.astype(kind) @ self.vectors.astype(kind).T

    def own(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def _positives(block: Block, ids, labels, vectors, wanted, k: int) -> Iterator[tuple]:
    for anchor, label, scores in zip(ids, labels, block.scores(vectors), strict=True):
        own = block.own(label)
        others = np.flatnonzero(block.ids[own] != anchor) + own.start
        for i in others[best(scores[others], block.ids[others], k)]:
            yield int(anchor), int(scores[i]), int(block.ids[i])


def _candidates(block: Block, ids, labels, vectors, wanted, k: int, low: int, high: int) -> Iterator[tuple]:
    for anchor, label, positive_scores, scores in zip(ids, labels, wanted, block.scores(vectors), strict=True):
        own, found = block.own(label), set()
        for positive_score in positive_scores:
            least, most = bounds(positive_score, low, high)
            inside = (scores >= least) & (scores <= most)
            inside[own] = False
            among = np.flatnonzero(inside)
            found.update(among[best(scores[among], block.ids[among], k)].tolist())
        for i in sorted(found):
            yield int(anchor), int(scores[i]), int(block.ids[i])


def _cells(batches: Iterator[pa.RecordBatch], fn, dim: int) -> Iterator[pa.RecordBatch]:
    """Rows of a block come first, then the anchors, which stream past them."""
    names = [c.split()[0] for c in SCORED.split(", ")]
    held, block, grid = [], None, None

    def columns(b: pa.RecordBatch) -> tuple:
        vectors = b.column("vec").flatten().to_numpy().reshape(b.num_rows, dim)
        return b.column("vec_id").to_numpy(), b.column("label").to_numpy(), vectors

    for b in batches:
        at, anchor = b.column("grid").to_numpy(), b.column("anchor").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (anchor[1:] != anchor[:-1])) + 1), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if at[lo] != grid:
                grid, held, block = at[lo], [], None
            part = b.slice(lo, hi - lo)
            if not anchor[lo]:
                held.append(columns(part))
                continue
            if block is None:
                if not held:
                    continue
                block, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True))), []
            for start in range(0, part.num_rows, ANCHOR_ROWS):
                some = part.slice(start, ANCHOR_ROWS)
                rows = list(fn(block, *columns(some), some.column("wanted").to_pylist()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)


def _grid(rows: DataFrame, anchors: DataFrame, fn, dim: int, blocks: int) -> DataFrame:
    """``fn`` of every block of rows with all anchors (that have their ``wanted`` scores)."""
    none = F.array().cast("array<long>").alias("wanted")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("grid")
    held = rows.select(block, F.lit(False).alias("anchor"), "vec_id", "label", "vec", none)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("grid")
    passing = anchors.select(every, F.lit(True).alias("anchor"), "vec_id", "label", "vec", "wanted")
    dealt = held.unionByName(passing).repartitionById(blocks, F.col("grid").cast("int"))
    return dealt.sortWithinPartitions("grid", "anchor", "vec_id").mapInArrow(partial(_cells, fn=fn, dim=dim), SCORED)


def packed_key(anchor: Column, score: Column, vec_id: Column) -> Column:
    """24 bytes that sort by anchor, then score downwards, then id."""
    parts = [anchor.bitwiseXOR(F.lit(_SIGN)), F.bitwise_not(score.bitwiseXOR(F.lit(_SIGN))), vec_id.bitwiseXOR(F.lit(_SIGN))]
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in parts]))


def unpacked(keys: pa.Array) -> np.ndarray:
    """(anchor, score, id) of packed keys, a row each."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 3)
    raw = np.stack([raw[:, 0], ~raw[:, 1], raw[:, 2]], axis=1)
    return (raw ^ np.uint64(1 << 63)).view(np.int64)


def _mine(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Open a window at each positive; emit later rows of other labels for the windows that they are in."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.int32() if " int" in c else pa.int64() for c in RESULT.split(", ")]
    anchor, seen, windows, zeros = None, 0, [], []
    for b in batches:
        out = []
        for (at, score, vec_id), positive in zip(unpacked(b.column("key")).tolist(), b.column("positive").to_pylist(), strict=True):
            if at != anchor:
                anchor, seen, windows, zeros = at, 0, [], []
            if positive:
                if seen < positives and score >= 0:
                    window = [vec_id, score, *bounds(score, low, high), 0]
                    for other in zeros if score == 0 else ():
                        window[4] += 1
                        out.append((anchor, vec_id, window[4], other, 0, 0))
                    windows.append(window)
                seen += 1
                continue
            if score == 0 and len(zeros) < negatives:
                zeros.append(vec_id)
            for window in windows:
                if window[4] < negatives and window[2] <= score <= window[3]:
                    window[4] += 1
                    out.append((anchor, window[0], window[4], vec_id, window[1], score))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Callable[[Column], Column],
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_rows: int = BLOCK_ROWS,
    **columns,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``columns`` as :func:`usable` has them."""
    spark = rows.sparkSession
    ready(spark)
    table = cut(usable(rows, **columns), "negatives-rows")
    shape = table.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    blocks, dim = max(tasks(spark), -(-shape["n"] // block_rows)), shape["dim"] or 0
    anchors = table.where(is_anchor(F.col("vec_id")))
    none = F.array().cast("array<long>")
    near = _grid(table, anchors.withColumn("wanted", none), partial(_positives, k=positives), dim, blocks)
    place = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    own = near.withColumn("place", F.row_number().over(place)).where(F.col("place") <= positives).drop("place")
    own = cut(own, "negatives-positives")
    wanted = own.where(F.col("score") >= 0).groupBy("anchor_id").agg(F.collect_set("score").alias("wanted"))
    asking = anchors.join(wanted.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    fn = partial(_candidates, k=negatives, low=low, high=high)
    far = _grid(table, asking, fn, dim, blocks)
    scored = own.withColumn("positive", F.lit(True)).unionByName(far.withColumn("positive", F.lit(False)))
    keyed = scored.select("anchor_id", packed_key(F.col("anchor_id"), F.col("score"), F.col("vec_id")).alias("key"), "positive")
    in_order = keyed.repartition(tasks(spark), "anchor_id").sortWithinPartitions("key")
    mine = partial(_mine, positives=positives, negatives=negatives, low=low, high=high)
    return in_order.mapInArrow(mine, RESULT)
