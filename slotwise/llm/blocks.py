"""Documents packed into blocks, and questions that blocks ask each other.

Operators that look for repeats among *all* positions of *all* texts can't
afford a shuffled row per position.  Here documents are packed once into
blocks of a few megabytes (a Parquet table in the shared folder).  A block
sends each hash range one row of sorted, packed, *distinct* keys; the task
that owns the range compares what all blocks sent and answers each block with
bits in the order of its keys; the block, read again with its answers, works
out the same keys and applies them.

A key shared by a third of all documents is in a range at most once per
block, so no key is hot; memory is bounded by the size of a block and of a
range.  A document is never split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import cut, ready

# Text bytes of a block (a longer document is a block of its own) and text
# bytes per hash range.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
NO_ID = np.iinfo(np.int64).max  # stands for a null id: after every other

ANSWER = "block long, level int, part int, bits binary"


class Block:
    """Ids (ascending, null last), byte lengths and joined bytes of some documents."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: bytes):
        self.ids, self.lengths, self.data = ids, lengths, data
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    @classmethod
    def of(cls, ids: list, texts: list[bytes]) -> Block:
        key = np.array([NO_ID if i is None else i for i in ids], np.int64)
        order = np.argsort(key, kind="stable")
        texts = [texts[i] for i in order]
        return cls(key[order], np.array([len(t) for t in texts], np.int64), b"".join(texts))

    def dump(self) -> bytes:
        import zstandard

        head = np.int64(len(self.ids)).tobytes() + self.ids.tobytes() + self.lengths.tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + self.data)

    @classmethod
    def load(cls, body: bytes) -> Block:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(body)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        return cls(
            np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), raw[8 + 16 * n :]
        )

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]]

    def id_list(self) -> list:
        return [None if i == NO_ID else i for i in self.ids.tolist()]


def pack(docs: DataFrame, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, n_bytes, body): all documents in blocks, written once."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            body = Block.of(ids, texts).dump()
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([body], pa.binary())],
                ["block", "n_bytes", "body"],
            )

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                data = (t.as_py() or "").encode("utf-8")
                ids.append(i)
                texts.append(data)
                size += len(data)
                if size >= block_bytes:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield row()

    return cut(docs.select("doc_id", "text").mapInArrow(run, "block long, n_bytes long, body binary"), name)


def ranges(blocks: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Number of hash ranges for these blocks."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, -(-total // range_bytes))


def range_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Hash range of 64-bit hashes: ascending in the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def range_bounds(h: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash range starts in sorted hashes; one more entry than ranges."""
    return np.searchsorted(range_of(h, parts), np.arange(parts + 1))


def ask(blocks: DataFrame, fn: Callable[[int, Block], Iterator[tuple]], columns: str) -> DataFrame:
    """Rows that ``fn(block number, block)`` yields as tuples, ``columns`` their schema."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, body in zip(b["block"], b["body"], strict=True):
                yield pd.DataFrame(list(fn(int(number), Block.load(body))), columns=names, dtype=object)

    return blocks.select("block", "body").mapInPandas(run, columns)


def answered(
    blocks: DataFrame, answers: DataFrame, fn: Callable[[int, Block, dict], Iterator[tuple]], columns: str
) -> DataFrame:
    """As :func:`ask`, with the answers of each block: {(level, part): bits}."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bits = {
            (int(k), int(p)): np.frombuffer(b, np.uint8)
            for k, p, b in zip(right["level"], right["part"], right["bits"], strict=True)
        }
        rows = [
            row
            for number, body in zip(left["block"], left["body"], strict=True)
            for row in fn(int(number), Block.load(body), bits)
        ]
        return pd.DataFrame(rows, columns=names, dtype=object)

    return (
        blocks.select("block", "body")
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(run, columns)
    )


def resolve(questions: DataFrame, fn: Callable[[pd.DataFrame], list[tuple]], level: int, name: str) -> DataFrame:
    """Answers of every hash range, written once: ``fn`` gets the rows that all
    blocks sent to a range and gives (block, bits as uint8 array) for them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        out = [(block, level, part, bits.astype(np.uint8).tobytes()) for block, bits in fn(rows)]
        return pd.DataFrame(out, columns=["block", "level", "part", "bits"])

    return cut(questions.groupBy("part").applyInPandas(run, ANSWER), name)


# --- seeds: which windows share their least gram with another place --------


def sliding(a: np.ndarray, k: int, op) -> np.ndarray:
    """``op`` over every k neighbours, by doubling."""
    if len(a) < k:
        return a[:0]
    width = 1
    while 2 * width <= k:
        a = op(a[:-width], a[width:])
        width *= 2
    return op(a[: len(a) - (k - width)], a[k - width :]) if width < k else a


def spread(h: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Seeds:
    """The least gram hash of every window, and the distinct ones of the block.

    Equal windows have equal least grams, so a window can only repeat if its
    least gram occurs at another place.  ``grams``: hash of the gram at every
    symbol; ``span``: grams per window; ``valid``: window starts that stay
    within a document.
    """

    def __init__(self, grams: np.ndarray, span: int, valid: np.ndarray):
        least = sliding(grams, span, np.minimum)[: len(valid)]
        own = np.where(valid, least, np.uint64(0))
        padded = np.zeros(len(grams) + span - 1, np.uint64)
        padded[span - 1 : span - 1 + len(own)] = own
        # A place holds a window's least gram if the largest minimum around it is its own.
        places = (sliding(padded, span, np.maximum) == grams) & (grams > 0)
        # Minima crowd at the low end; spread anew, they fill the hash ranges evenly.
        self.least = spread(least)
        self.keys, counts = np.unique(spread(grams[places]), return_counts=True)
        self.twice = counts > 1
        self.valid = valid

    def questions(self, number: int, parts: int) -> Iterator[tuple]:
        bounds = range_bounds(self.keys, parts)
        for p in range(parts):
            if bounds[p] < bounds[p + 1]:
                yield (p, number, self.keys[bounds[p] : bounds[p + 1]].tobytes())

    def answers(self, bits: dict, parts: int, level: int = 1) -> np.ndarray:
        """Per distinct key: blocks it is in (0: this one alone; 1: several; 2: very many)."""
        bounds = range_bounds(self.keys, parts)
        out = np.zeros(len(self.keys), np.uint8)
        for p in range(parts):
            if (level, p) in bits:
                out[bounds[p] : bounds[p + 1]] = bits[level, p]
        return out

    def repeated(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts whose least gram occurs elsewhere, and the answer of its key."""
        if not len(self.valid) or not len(self.keys):
            return np.zeros(0, np.int64), found[:0]
        # Neighbouring windows mostly share their least gram: looked up once a run.
        new = np.append(True, self.least[1:] != self.least[:-1])
        at = np.minimum(np.searchsorted(self.keys, self.least[new]), len(self.keys) - 1)
        run = np.cumsum(new) - 1
        keep = (self.twice[at] | (found[at] > 0))[run] & self.valid
        starts = np.flatnonzero(keep)
        return starts, found[at[run[starts]]]


SEED_COLUMNS = "part int, block long, keys binary"


def seed_resolver(very_many: int) -> Callable[[pd.DataFrame], list[tuple]]:
    """Answers to :meth:`Seeds.questions`."""

    def fn(rows: pd.DataFrame) -> list[tuple]:
        sent = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
        every, count = np.unique(np.concatenate(sent), return_counts=True)
        grade = (count > 1).astype(np.uint8) + (count > very_many)
        return [(b, grade[np.searchsorted(every, k)]) for b, k in zip(rows["block"], sent, strict=True)]

    return fn
