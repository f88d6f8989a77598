"""Approximate nearest neighbours (largest inner product) by a hash-prefix forest.

*Hashes.*  Every tree gives a vector a long bit string, the signs of its inner
products with random directions.  Vectors are first scaled by the largest norm
and completed to unit length by one more component, queries by a zero, so that
the largest inner product is the smallest angle.

*Trees.*  A tree is the array of the vectors sorted by bit string; a prefix is
a range of it.  The array is cut into cells of equal leading bits and a cell
into blocks of at most ``BLOCK`` vectors, each a Spark group that sorts its
part.  A cell however full is thus never in one task.

*Search.*  A query descends every tree to the longest prefix it shares with
enough vectors, and all trees ascend together, a bit at a time, until the
ranges of all trees hold ``wanted`` vectors.  How many share a prefix is known
from the counts of the leading ``LEVELS`` bits (a bounded table).  The query
then visits the blocks under its prefix in each tree; every vector in range is
compared by its exact inner product.

*Calibration.*  ``wanted`` is measured, not guessed: for at most ``PROBES``
queries the true neighbours are found by brute force (distributed over all
vectors), and ``wanted`` is set so that ``recall`` of them lie within the
levels that the search would reach.

Equal vectors are one entry that keeps its smallest ids (as many as can be in
an answer), so masses of copies cost no more than one vector and nothing is
lost: the answer holds the smallest ids among ties.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do null ids; a query with
fewer candidates than asked for gets them all; rows that repeat an id and
vector count once.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import cut, ready

TREES, BITS, LEVELS = 16, 62, 12
BLOCK, PROBES, RECALL = 8192, 256, 0.96


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (sizes[0] if sizes else 0))


def distinct_vectors(rows: DataFrame, keep: int, is_query) -> DataFrame:
    """One row per different vector: gid (smallest id), vec, ids (the ``keep``
    smallest), is_query.  The ranking drops surplus copies before the shuffle."""
    w = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("rn", F.dense_rank().over(w)).where(F.col("rn") <= keep)
    ids = F.array_sort(F.collect_set("vec_id"))
    return few.groupBy("vec").agg(F.min("vec_id").alias("gid"), ids.alias("ids"))


@dataclass
class Forest:
    """Directions and scale of the trees; counts of the leading bits."""

    dim: int
    scale: float
    seed: int = 10
    counts: np.ndarray | None = None  # trees x 2**LEVELS
    wanted: int = 0

    def hashes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Bit strings, one row per vector and one column per tree."""
        r = np.random.default_rng(self.seed).normal(size=(self.dim + 1, TREES * BITS))
        norm = np.sqrt((x * x).sum(axis=1))
        if query:
            x = np.hstack([x / norm[:, None], np.zeros((len(x), 1))])
        else:
            x = np.hstack([x / self.scale, np.sqrt(np.maximum(0.0, 1 - (norm / self.scale) ** 2))[:, None]])
        signs = (x @ r > 0).reshape(len(x), TREES, BITS)
        return signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def sharing(self, h: np.ndarray) -> np.ndarray:
        """Vectors under the query's prefix, of all trees together, at levels 0 to LEVELS."""
        out = np.zeros((len(h), LEVELS + 1), np.int64)
        for t in range(TREES):
            c = self.counts[t]
            for level in range(LEVELS, -1, -1):
                out[:, level] += c[h[:, t] >> (BITS - level)]
                c = c.reshape(-1, 2).sum(axis=1) if level else c
        return out

    def level(self, h: np.ndarray) -> np.ndarray:
        """The deepest level at which the trees together hold enough vectors."""
        enough = self.sharing(h) >= self.wanted
        return np.where(enough.any(axis=1), LEVELS - enough[:, ::-1].argmax(axis=1), 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def inner_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, components added in order, so equal rows give equal results."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, those of -inf left out."""
    k = min(k, scores.shape[1])
    cols = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(
        np.arange(scores.shape[1]), (len(scores), 1)
    )
    rows = np.repeat(np.arange(len(scores)), cols.shape[1])
    cols = cols.ravel()
    ok = np.isfinite(scores[rows, cols])
    return rows[ok], cols[ok]


def _probe(entries: DataFrame, forest: Forest, top: int, recall: float) -> int:
    """Vectors to want so that ``recall`` of the probes' true neighbours are in reach."""
    spark = entries.sparkSession
    chosen = (
        entries.where("is_query").orderBy(F.xxhash64("gid", F.lit(3)), "gid").limit(PROBES).select("gid", "vec").collect()
    )
    if not chosen:
        return 1
    q = np.array([r[1] for r in chosen], np.float64)
    gids = np.array([r[0] for r in chosen])
    hq = forest.hashes(q, query=True)
    held = spark.sparkContext.broadcast((q, gids, hq, forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, gids, hq, f = held.value
        for b in batches:
            x = _matrix(b.column("vec"))
            own = b.column("gid").to_numpy()
            scores = q @ x.T
            scores[gids[:, None] == own[None, :]] = -np.inf
            r, c = _best(scores, top)
            h = f.hashes(x, query=False)
            differ = hq[r] ^ h[c]
            bits = np.where(differ > 0, np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).astype(np.int64) + 1, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r), pa.array(scores[r, c]), pa.array((BITS - bits).max(axis=1).clip(0, LEVELS))],
                ["probe", "score", "depth"],
            )

    w = Window.partitionBy("probe").orderBy(F.desc("score"))
    true = (
        entries.select("gid", "vec")
        .mapInArrow(run, "probe long, score double, depth long")
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= top)
        .collect()
    )  # at most PROBES x top rows
    if not true:
        return 1
    sharing = np.hstack([forest.sharing(hq), np.zeros((len(hq), 1), np.int64)])
    # A neighbour is met if the level below its depth does not hold enough vectors yet.
    needed = np.sort([sharing[r["probe"], r["depth"] + 1] for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def nearest(
    vectors: DataFrame,
    is_query,
    top: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each query row.

    ``is_query`` maps the id column to a condition.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = usable(vectors, id_col, vec_col)
    queries = rows.where(is_query(F.col("vec_id"))).select("vec_id", "vec").distinct()
    asked = queries.select("vec").distinct().withColumn("is_query", F.lit(True))
    entries = distinct_vectors(rows, top + 1, is_query).join(asked, "vec", "left")
    entries = cut(entries.withColumn("is_query", F.coalesce("is_query", F.lit(False))), "forest-entries")
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, largest, dim = entries.agg(F.count(F.lit(1)), F.max(F.sqrt(norm2)), F.max(F.size("vec"))).first()
    forest = Forest(int(dim or 1), float(largest or 1.0))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = forest.hashes(_matrix(b.column("vec")), query=False) >> (BITS - LEVELS)
            cell = (h + (np.arange(TREES, dtype=np.int64) << LEVELS)[None, :]).ravel()
            cell, count = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count)], ["cell", "n"])

    seen = entries.select("vec").mapInArrow(prefixes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(TREES << LEVELS, np.int64)
    for r in seen.collect():  # at most TREES * 2**LEVELS rows
        flat[r[0]] = r[1]
    forest.counts = flat.reshape(TREES, 1 << LEVELS)
    forest.wanted = _probe(entries, forest, top, recall)
    # Cells: leading bits such that a cell holds about a block.
    bits = int(np.clip(np.ceil(np.log2(max(1.0, (n or 1) / BLOCK))), 0, LEVELS))
    cell_counts = forest.counts.reshape(TREES, 1 << bits, -1).sum(axis=2)
    blocks = np.maximum(1, -(-cell_counts // BLOCK))  # blocks of each cell

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, gid = _matrix(b.column("vec")), b.column("gid").to_numpy()
            h = forest.hashes(x, query=False)
            packed = [row.tobytes() for row in x]
            spread = (gid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for t in range(TREES):
                cell = h[:, t] >> (BITS - bits)
                block = (spread % blocks[t, cell].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gid), t, np.int32)), pa.array(cell), pa.array(block), pa.array(h[:, t]),
                     pa.array(gid), pa.array(packed, pa.binary())],
                    ["tree", "cell", "block", "h", "gid", "x"],
                )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, gid = _matrix(b.column("vec")), b.column("gid").to_numpy()
            h = forest.hashes(x, query=True)
            level = forest.level(h)
            packed = np.array([row.tobytes() for row in x], object)
            for t in range(TREES):
                # A prefix shorter than a cell's visits every cell below it.
                short = np.maximum(0, bits - level)
                first = ((h[:, t] >> (BITS - bits)) >> short) << short
                at = np.repeat(np.arange(len(gid)), 1 << short)
                cell = first[at] + (np.arange(len(at)) - np.repeat(np.cumsum(1 << short) - (1 << short), 1 << short))
                k = blocks[t, cell]
                at, cell = np.repeat(at, k), np.repeat(cell, k)
                block = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), t, np.int32)), pa.array(cell), pa.array(block.astype(np.int32)),
                     pa.array(h[at, t]), pa.array(level[at]), pa.array(gid[at]), pa.array(packed[at], pa.binary())],
                    ["tree", "cell", "block", "h", "level", "gid", "x"],
                )

    def compare(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"qid": [], "gid": [], "score": []})
        data = data.sort_values("h", kind="stable")
        h = data["h"].to_numpy()
        x = np.frombuffer(b"".join(data["x"]), "<f8").reshape(len(data), -1)
        gid = data["gid"].to_numpy()
        out = []
        for lo in range(0, len(asked), 256):
            part = asked.iloc[lo : lo + 256]
            q = np.frombuffer(b"".join(part["x"]), "<f8").reshape(len(part), -1)
            drop = BITS - part["level"].to_numpy()
            start = (part["h"].to_numpy() >> drop) << drop
            left = np.searchsorted(h, start, "left")
            right = np.searchsorted(h, start + ((np.int64(1) << drop) - 1), "right")
            scores = q @ x.T
            place = np.arange(len(h))[None, :]
            scores[(place < left[:, None]) | (place >= right[:, None])] = -np.inf
            r, c = _best(scores, top + 1)
            out.append(
                pd.DataFrame(
                    {"qid": part["gid"].to_numpy()[r], "gid": gid[c], "score": inner_product(q[r], x[c])}
                )
            )
        return pd.concat(out)

    key = ["tree", "cell", "block"]
    data = entries.select("gid", "vec").mapInArrow(
        place, "tree int, cell long, block int, h long, gid long, x binary"
    )
    asked_rows = entries.where("is_query").select("gid", "vec").mapInArrow(
        send, "tree int, cell long, block int, h long, level long, gid long, x binary"
    )
    met = data.groupBy(*key).cogroup(asked_rows.groupBy(*key)).applyInPandas(compare, "qid long, gid long, score double")
    own = entries.where("is_query").select(F.col("gid").alias("qid"), "gid", norm2.alias("score"))
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "gid")
    best = (
        met.unionByName(own)
        .groupBy("qid", "gid")
        .agg(F.max("score").alias("score"))
        .withColumn("rn", F.row_number().over(by_score))
        .where(F.col("rn") <= top + 1)
    )
    by_id = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    # top + 1 answers per different query vector: one of them may be the query's own row.
    answers = (
        best.join(entries.select("gid", "ids"), "gid")
        .select("qid", "score", F.explode("ids").alias("vec_id"))
        .withColumn("rn", F.row_number().over(by_id))
        .where(F.col("rn") <= top + 1)
        .drop("rn")
    )
    who = queries.select(F.col("vec_id").alias("query_id"), "vec").join(
        entries.where("is_query").select("vec", F.col("gid").alias("qid")), "vec"
    )
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        who.drop("vec")
        .join(answers, "qid")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(final).cast("int"))
        .where(F.col("rank") <= top)
        .select(
            F.col("query_id").cast(T.LongType()).alias("query_id"),
            "rank",
            F.col("vec_id").cast(T.LongType()).alias("vec_id"),
            "score",
        )
    )
