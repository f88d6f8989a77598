"""Phrase collocations by relational mining of sorted occurrence relations (SETM).

The occurrence relation of a length says at which place of which piece of text
a phrase stands.  It is persisted sorted by (piece, place), in blocks of a few
megabytes of text: one row per block, with packed columns.

1. *Words.*  Texts are cut into pieces and words; a block lists its distinct
   (language, word) pairs with their counts, and which one stands at each place.
2. *Group and count.*  A block sends each distinct group once, with its count,
   however often it occurs: words as rows, pairs packed by hash range (a row per
   block and range that holds one pair at least, so never more rows than pairs).
   A window, or the task of a range, adds the counts up; groups with fewer than
   ``min_count`` occurrences go, the others get an id.
3. *Semi-join.*  The frequent groups return to their blocks, whose places
   without a frequent phrase go.
4. *Extend.*  The relation is merge-joined with itself at adjacent places of a
   piece: phrases of k words at places p and p + 1 make one of k + 1 words, named
   by their two ids.  Back to 2, until ``longest`` words or nothing is left.

A phrase is known by the ids of its two parts, and a word by its text, so
phrases are compared exactly.  Every part of a frequent phrase is frequent:
counts of all heads and tails are carried along with it.

Scores use 128-bit decimals.  A phrase goes if a longer one contains it and is
as frequent; it is enough to look at phrases a word longer, since those inside
that longer one are at least as frequent.

Defined cases: null text is empty; a null language is ``und``; texts without
words give nothing; a repeated row or id counts as often as it stands there.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import cut, ready, tasks

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
# Text bytes of a block (a longer document is a block of its own).
BLOCK_BYTES = 8 << 20
# Words of the corpus per hash range of pairs: a range gets fewer pairs than that.
RANGE_WORDS = 4 << 20

# Bytes that end a piece become 0xFF, which UTF-8 never holds; a tab is a blank; A-Z lower-cased.
_STOP = b"\xff"
_BYTES = bytes(0xFF if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 9 else c for c in range(256)).lower()

# A block is one row with ``places`` and ``groups``, and rows for its distinct groups.
WORDS = "block long, index int, lang string, word string, n long, places binary, groups binary"
PAIRS = "block long, part int, first int, left binary, right binary, n binary, places binary, groups binary"
FOUND = "block long, at binary, ids binary, id long, left long, right long, a long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
ROWS = 1 << 16


def _packed(values: np.ndarray) -> bytes:
    """64-bit values, byte by byte in planes: those of high order hardly cost anything."""
    planes = values.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return np.int64(len(values)).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    planes = pa.decompress(data[8:], 8 * n, "zstd", asbytes=True) if n else b""
    return np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(-1)


def _dump(places: np.ndarray, groups: np.ndarray) -> dict:
    return {"places": _packed(np.diff(places, prepend=0)), "groups": _packed(groups)}


def _load(places: bytes, groups: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpacked(places)), _unpacked(groups)


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


class _Words:
    """Words of some documents: the places of a block in order, and its distinct (language, word)."""

    def __init__(self):
        number = itertools.count().__next__
        self.known: dict[str, defaultdict] = defaultdict(lambda: defaultdict(number))
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        tokens = text.translate(_BYTES).replace(_STOP, b" \xff ").split()
        tokens.append(_STOP)  # documents never run into each other
        known = self.known[lang]
        self.parts.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(text)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        groups = np.concatenate(self.parts)
        index, langs, words, stops = [], [], [], []
        for lang, known in self.known.items():
            stops.append(known.pop(_STOP))
            index += known.values()
            words += known
            langs += [lang] * len(known)
        places = np.flatnonzero(~np.isin(groups, stops))
        groups = groups[places]
        n = np.bincount(groups, minlength=int(groups.max(initial=0)) + 1)
        schema = _schema(WORDS)
        yield pa.RecordBatch.from_pylist([{"block": block, **_dump(places, groups)}], schema)
        listed = [pa.array(index, pa.int32()), pa.array(langs, pa.string()),
                  pa.array(words, pa.binary()).cast(pa.string()), pa.array(n[np.array(index, np.int64)], pa.int64())]
        for lo in range(0, len(index), ROWS):
            part = [x.slice(lo, ROWS) for x in listed]
            size = len(part[0])
            ends = [pa.nulls(size, pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), *part, *ends], schema=schema)


def occurrences(docs: DataFrame, lang_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The relation of single words, written once."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # 12 bits for the blocks of a task, 30 for the words of a block (see _frequent_words).
        number, words = TaskContext.get().partitionId() << 12, _Words()
        for b in batches:
            for lang, body in zip(b.column("lang"), b.column("body"), strict=True):
                words.add(lang.as_py(), body.as_py())
                if words.size >= block_bytes:
                    yield from words.rows(number)
                    number, words = number + 1, _Words()
        if words.parts:
            yield from words.rows(number)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")
    return cut(docs.select(lang, body).mapInArrow(run, WORDS), "phrase-words")


def _range_of(left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
    h = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _extend(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Semi-join a block with its frequent groups, then join it with itself at adjacent places."""
    schema = _schema(PAIRS)
    for b in batches:
        for block, at, of, index, ids in zip(
            *(b.column(c) for c in ("block", "places", "groups", "index", "ids")), strict=True
        ):
            places, groups = _load(at.as_py(), of.as_py())
            index, ids = (np.concatenate([_unpacked(x) for x in c.as_py()]) for c in (index, ids))
            name = np.full(int(groups.max(initial=-1)) + 1, -1, np.int64)
            distinct, name[index] = np.unique(ids, return_inverse=True)  # small numbers in place of the ids
            kept = name[groups] >= 0
            places, groups = places[kept], name[groups[kept]]
            follows = np.flatnonzero(np.diff(places) == 1)
            pair, which, n = np.unique(
                groups[follows] * len(distinct) + groups[follows + 1], return_inverse=True, return_counts=True
            )
            left, right = distinct[pair // max(1, len(distinct))], distinct[pair % max(1, len(distinct))]
            # Pairs are numbered by range, then by their ids.
            part = _range_of(left, right, parts)
            order = np.argsort(part, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            left, right, n = left[order], right[order], n[order]
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [{"block": block.as_py(), **_dump(places[follows], number[which.reshape(-1)])}]
            for p in np.flatnonzero(np.diff(ends)).tolist():
                mine = slice(ends[p], ends[p + 1])
                packed = {"left": _packed(left[mine]), "right": _packed(right[mine]), "n": _packed(n[mine])}
                rows.append({"block": block.as_py(), "part": p, "first": int(ends[p]), **packed})
            yield pa.RecordBatch.from_pylist(rows, schema)


def _frequent_words(relation: DataFrame, min_count: int) -> DataFrame:
    """(block, index, ref, id, lang, word, a): the words of each block that are frequent in all, written once."""
    rows = relation.where(F.col("index").isNotNull()).select("block", "index", "lang", "word", "n")
    rows = rows.withColumn("ref", F.shiftleft("block", 30) + F.col("index"))
    group = Window.partitionBy("lang", "word")
    rows = rows.withColumn("a", F.sum("n").over(group)).withColumn("id", F.min("ref").over(group))
    return cut(rows.where(F.col("a") >= min_count).drop("n"), "phrase-frequent1")


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [
            {"block": block.as_py(), **{c: [_packed(x.values.field(c).to_numpy())] for c in ("index", "ids")}}
            for block, x in zip(b.column("block"), b.column("found"), strict=True)
        ]
        kind = pa.list_(pa.binary())
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int64()), ("index", kind), ("ids", kind)]))


def _words_by_block(found: DataFrame) -> DataFrame:
    """(block, index, ids): packed, a row per block."""
    lists = found.groupBy("block").agg(F.collect_list(F.struct("index", F.col("id").alias("ids"))).alias("found"))
    return lists.mapInArrow(_pack_words, "block long, index array<binary>, ids array<binary>")


def _count_range(rows: pa.Table, min_count: int) -> pa.Table:
    """Add up the counts that all blocks sent for the pairs of a range; number the frequent ones."""
    left, right, n = ([_unpacked(x.as_py()) for x in rows.column(c)] for c in ("left", "right", "n"))
    sizes = [len(x) for x in left]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.array(rows.column("first").to_pylist(), np.int64)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]
    left, right, n = np.concatenate(left), np.concatenate(right), np.concatenate(n)
    order = np.lexsort((right, left))
    l, r = left[order], right[order]
    starts = np.flatnonzero(np.concatenate([[True], (l[1:] != l[:-1]) | (r[1:] != r[:-1])]))
    total = np.add.reduceat(n[order], starts)
    often = total >= min_count
    ids = (rows.column("part")[0].as_py() << 32) + np.cumsum(often) - 1
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    groups = {"id": ids[often], "left": l[starts][often], "right": r[starts][often], "a": total[often]}
    out = [pa.table({k: pa.array(v, pa.int64()) for k, v in groups.items()})]
    hit = np.flatnonzero(often[group])
    ends = np.searchsorted(owner[hit], np.arange(len(sizes) + 1))
    for k, block in enumerate(rows.column("block").to_pylist()):
        mine = hit[ends[k] : ends[k + 1]]
        if len(mine):
            out.append(pa.Table.from_pylist([{"block": block, "at": _packed(index[mine]), "ids": _packed(ids[group[mine]])}]))
    schema = _schema(FOUND)
    full = [pa.table([t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(len(t), f.type) for f in schema], schema) for t in out]
    return pa.concat_tables(full)


def _frequent_pairs(relation: DataFrame, min_count: int, name: str) -> DataFrame:
    """The frequent pairs (id, left, right, a), and for each block which of its pairs are (block, at, ids); written once."""

    def count(rows: pa.Table) -> pa.Table:
        return _count_range(rows, min_count)

    sent = relation.where(F.col("part").isNotNull()).select("block", "part", "first", "left", "right", "n")
    return cut(sent.groupBy("part").applyInArrow(count, FOUND), name)


def _pairs_by_block(found: DataFrame) -> DataFrame:
    lists = found.where(F.col("block").isNotNull()).groupBy("block").agg(F.collect_list(F.struct("at", "ids")).alias("x"))
    return lists.select("block", F.col("x.at").alias("index"), F.col("x.ids").alias("ids"))


def _longer(relation: DataFrame, answers: DataFrame, parts: int, name: str) -> DataFrame:
    """The relation of phrases a word longer, written once."""
    blocks = relation.where(F.col("places").isNotNull()).select("block", "places", "groups").join(answers, "block")
    return cut(blocks.mapInArrow(partial(_extend, parts=parts), PAIRS), name)


def frequent_phrases(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    lang_col: str = "lang",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with at least ``min_count`` occurrences, and the words of each language.

    First: words, lang, phrase, a, heads (counts of its first 1, 2, ... words),
    tails (counts of what is left then), covered (a phrase a word longer
    contains it and is as frequent).  Second: lang, n.
    """
    relation = occurrences(docs, lang_col, text_col, block_bytes)
    totals = relation.where(F.col("index").isNotNull()).groupBy("lang").agg(F.sum("n").alias("n"))
    parts = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS
    found = _frequent_words(relation, min_count)
    none = F.array().cast("array<long>")
    level = found.where(F.col("id") == F.col("ref")).select(
        "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("heads"), none.alias("tails")
    )
    level, answers, levels = cut(level, "phrases1"), _words_by_block(found), []
    for k in range(2, longest + 1):
        relation = _longer(relation, answers, parts, f"phrase-pairs{k}")
        found = _frequent_pairs(relation, min_count, f"phrase-frequent{k}")
        groups = found.where(F.col("id").isNotNull()).select("id", "left", "right", "a")
        if groups.isEmpty():
            break
        longer = cut(_named(groups, level), f"phrases{k}")
        levels.append((k - 1, _marked(level, longer)))
        level, answers = longer, _pairs_by_block(found)
    else:
        k = longest + 1
    levels.append((k - 1, level.withColumn("covered", F.lit(False))))
    columns = ["lang", "phrase", "a", "heads", "tails", "covered"]
    phrases = [x.select(F.lit(n).alias("words"), *columns) for n, x in levels]
    out = phrases[0]
    for x in phrases[1:]:
        out = out.unionByName(x)
    return out, totals


def _named(groups: DataFrame, level: DataFrame) -> DataFrame:
    """Phrases a word longer than those of ``level``, with their text and the counts of their parts."""
    left = level.select(
        F.col("id").alias("left"), "lang", "phrase", F.col("a").alias("left_a"), F.col("heads").alias("left_heads")
    )
    right = level.select(
        F.col("id").alias("right"), "last", F.col("a").alias("right_a"), F.col("tails").alias("right_tails")
    )
    return groups.join(left, "left").join(right, "right").select(
        "id", "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a",
        F.concat("left_heads", F.array("left_a")).alias("heads"),
        F.concat(F.array("right_a"), "right_tails").alias("tails"), "left_a", "right_a",
    )


def _marked(level: DataFrame, longer: DataFrame) -> DataFrame:
    """``level`` with whether a phrase of ``longer`` contains it and is as frequent."""
    inside = [longer.where(F.col("a") >= F.col(f"{side}_a")).select(F.col(side).alias("id")) for side in ("left", "right")]
    covered = inside[0].union(inside[1]).distinct().withColumn("covered", F.lit(True))
    return level.join(covered, "id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


# Products pass 64 bits, so they are decimals; least score first, then the smallest cut.
_LOWEST = """
array_min(transform(sequence(1, words - 1), k -> struct(
  (CAST(1000 * a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)))
    div (CAST(element_at(heads, k) AS DECIMAL(19,0)) * CAST(element_at(tails, k) AS DECIMAL(19,0))) AS score,
  k AS cut, element_at(heads, k) AS l, element_at(tails, k) AS r)))
"""


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score, cut, covered of phrases of several words: their lowest-scoring cut."""
    of = phrases.where(F.col("words") > 1).join(totals, "lang").withColumn("best", F.expr(_LOWEST))
    return of.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "best.cut", "covered")


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    top: int = TOP,
    lang_col: str = "lang",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, cut."""
    phrases, totals = frequent_phrases(docs, min_count, longest, lang_col, text_col, block_bytes)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    left = scored(phrases, totals).where(~F.col("covered"))
    # The best of a language are among the best of its parts, so no task ranks all of its phrases.
    part = F.pmod(F.xxhash64("phrase"), F.lit(tasks(docs.sparkSession)))
    first = Window.partitionBy("lang", "part").orderBy(*order)
    some = left.withColumn("part", part).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    last = Window.partitionBy("lang").orderBy(*order)
    best = some.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
