"""Line deduplication: range-partitioned line hashes, streamed; bitmaps instead of text.

1. Every document gives the 128-bit hash and the place of each of its lines
   that is long enough (``line_hashes``, written once).
2. One row per line is range-partitioned on (hash, document) and sorted inside
   the ranges by (hash, document descending, place).  Ranges are cut by
   document as well, so a line that a third of all documents hold is spread
   over many ranges.
3. A range is streamed.  The first document of a hash keeps its lines, those of
   all others go once a third document (``min_docs``) has come.  At most one
   document's lines of one hash are held back.  The first hash of a range may
   have begun in the range before it and the last one may go on in the next:
   their rows are left open, and settled by what the ranges say about their
   edge hashes (at most two small rows a range, hence a bounded broadcast).
4. What is dropped is gathered per document into a compressed bitmap of the
   lines that stay (``keep_bitmaps``).  Texts travel once, to meet their
   bitmap (``cleaned_texts``).

A row of the table is known by its id and the hash of its text.

Defined cases: null or empty text is one empty line; rows that share an id are
one document when documents are counted and all of them keep the lines that
the id keeps; a null id is a document smaller than every other; rows equal in
id and text get equal results.  Extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import cut, ready, tasks

MIN_CHARS, MIN_DOCS = 20, 3
BLANK = b" \t\n\x0b\x0c\r"

DROP, OPEN, EDGE = 0, 1, 2
FOUND = "kind int, doc_id long, text_hash long, at int, hi long, lo long, n_docs long"


def line_key(line: bytes) -> bytes:
    """What makes two lines equal: stripped, A-Z lower-cased."""
    return line.strip(BLANK).lower()  # bytes.lower changes A-Z only


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).select(
        "doc_id", F.xxhash64("body").alias("text_hash"), "body"
    )


def _hash_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        counts, ends, digests, places = [], [0], [], []
        for body in b.column("body"):
            lines = body.as_py().split(b"\n")
            for at, line in enumerate(lines):
                key = line_key(line)
                if long_enough(key, min_chars):
                    digests.append(xxhash.xxh3_128_digest(key))
                    places.append(at)
            counts.append(len(lines))
            ends.append(len(places))
        pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        line = pa.StructArray.from_arrays(
            [pa.array(places, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["at", "hi", "lo"]
        )
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), pa.array(counts, pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), line)],
            ["doc_id", "text_hash", "n_lines", "lines"],
        )


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_lines, lines: array of (at, hi, lo)), a row per document, written once."""
    ready(docs.sparkSession)
    rows = _documents(docs, id_col, text_col).mapInArrow(
        partial(_hash_lines, min_chars=min_chars),
        "doc_id long, text_hash long, n_lines long, lines array<struct<at: int, hi: long, lo: long>>",
    )
    return cut(rows, "line-hashes")


class _Stream:
    """Runs of equal hashes in one sorted range; see step 3 of the module."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.key: tuple | None = None  # hash of the current run
        self.first = True  # the current run is the first of the range
        self.n_docs, self.top, self.last_doc = 0, None, None
        self.held: list[pa.RecordBatch] = []  # rows that go if enough documents come

    @staticmethod
    def rows(kind: int, b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        cols = [pa.array(np.full(n, kind, np.int32)), *(b.column(c) for c in ("doc_id", "text_hash", "at", "hi", "lo"))]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int64())], [c.split()[0] for c in FOUND.split(", ")])

    def edge(self) -> pa.RecordBatch:
        hi, lo = self.key
        row = {"kind": EDGE, "doc_id": self.top, "text_hash": 0, "at": 0, "hi": hi, "lo": lo, "n_docs": self.n_docs}
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32()),
                            ("hi", pa.int64()), ("lo", pa.int64()), ("n_docs", pa.int64())])
        return pa.RecordBatch.from_pylist([row], schema)

    def take(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = b.num_rows
        hi, lo = b.column("hi").to_numpy(), b.column("lo").to_numpy()
        null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        doc = b.column("doc_id").fill_null(0).to_numpy()
        of = lambda i: None if null[i] else int(doc[i])
        new_key, new_doc = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        new_key[0] = self.key != (int(hi[0]), int(lo[0]))
        new_doc[1:] = new_key[1:] | (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
        new_doc[0] = new_key[0] or of(0) != self.last_doc
        run, seen = np.cumsum(new_key), np.cumsum(new_doc)  # run 0 goes on from the batch before
        starts = np.flatnonzero(new_key)
        before = np.concatenate([[-self.n_docs], seen[starts] - 1])
        order = seen - before[run]  # 1 for the largest document of the hash
        total = np.concatenate([[self.n_docs], np.zeros(len(starts), np.int64)])
        np.maximum.at(total, run, order)
        leading = run == 0 if self.first else np.zeros(n, bool)
        if self.key is None:
            leading = run == 1
        enough = total >= self.min_docs
        # The run that was open before this batch.
        if self.held and enough[0]:
            yield from (self.rows(DROP, h) for h in self.held)
        if enough[0] or len(starts):
            self.held = []
        if self.first and self.key is not None and len(starts):
            self.n_docs = int(total[0])
            yield self.edge()
            self.first = False
        if leading.any():
            yield self.rows(OPEN, b.filter(pa.array(leading)))
        gone = ~leading & (order > 1) & enough[run]
        if gone.any():
            yield self.rows(DROP, b.filter(pa.array(gone)))
        last = run[-1]
        waits = ~leading & (run == last) & (order > 1) & ~enough[last]
        if waits.any():
            self.held.append(b.filter(pa.array(waits)))
        if len(starts):
            if self.key is None and len(starts) > 1:  # the first run of the range has ended in its first batch
                self.key, self.n_docs, self.top = (int(hi[0]), int(lo[0])), int(total[1]), of(0)
                yield self.edge()
                self.first = False
            s = starts[-1]
            self.key, self.top = (int(hi[s]), int(lo[s])), of(s)
        self.n_docs, self.last_doc = int(total[last]), of(n - 1)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            yield self.edge()
            yield from (self.rows(OPEN, h) for h in self.held)


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    state = _Stream(min_docs)
    for b in batches:
        if b.num_rows:
            yield from state.take(b)
    yield from state.end()


def dropped_lines(hashes: DataFrame, min_docs: int = MIN_DOCS, ranges: int | None = None) -> DataFrame:
    """(doc_id, text_hash, at) of every line that goes; ``hashes`` as :func:`line_hashes` writes them."""
    spark = hashes.sparkSession
    largest = F.col("doc_id").desc_nulls_last()
    lines = hashes.select("doc_id", "text_hash", F.explode("lines").alias("x")).select("doc_id", "text_hash", "x.*")
    sorted_ranges = lines.repartitionByRange(ranges or tasks(spark), "hi", "lo", largest).sortWithinPartitions(
        "hi", "lo", largest, "text_hash", "at"
    )
    found = cut(sorted_ranges.mapInArrow(partial(_stream, min_docs=min_docs), FOUND), "line-dedup")
    edges = (
        found.where(F.col("kind") == EDGE)
        .groupBy("hi", "lo")
        .agg(F.sum("n_docs").alias("edge_docs"), F.max("doc_id").alias("top"))
        .where(F.col("edge_docs") >= min_docs)
    )
    # At most two edge rows per range, whatever the input.
    opened = found.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["hi", "lo"])
    settled = opened.where(~F.col("doc_id").eqNullSafe(F.col("top")))
    columns = ["doc_id", "text_hash", "at"]
    return found.where(F.col("kind") == DROP).select(columns).unionByName(settled.select(columns))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dropped, maps = [], []
        for n, places in zip(b.column("n_lines").to_pylist(), b.column("places"), strict=True):
            gone = np.asarray(places.values if places.is_valid else [], np.int64)
            keep = np.ones(n, bool)
            keep[gone] = False
            dropped.append(len(gone))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), b.column("n_lines"), pa.array(dropped, pa.int64()),
             pa.array(maps, pa.binary())],
            ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"],
        )


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    """Bitmap of the lines that stay, as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    ranges: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep: a row per (id, text); ``keep`` as :func:`unpack` reads it."""
    hashes = line_hashes(docs, min_chars, id_col, text_col)
    heads = hashes.select("doc_id", "text_hash", "n_lines", F.lit(None).cast("int").alias("at"))
    lines = dropped_lines(hashes, min_docs, ranges).withColumn("n_lines", F.lit(None).cast("long"))
    rows = heads.unionByName(lines).groupBy("doc_id", "text_hash")
    return rows.agg(F.max("n_lines").alias("n_lines"), F.collect_set("at").alias("places")).mapInArrow(
        _pack, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary"
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for body, n, gone, keep in zip(*(b.column(c) for c in ("body", "n_lines", "n_dropped", "keep")), strict=True):
            text = body.as_py()
            if gone.as_py():
                lines = text.split(b"\n")
                text = b"\n".join([lines[i] for i in np.flatnonzero(unpack(keep.as_py(), n.as_py()))])
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_lines"), b.column("n_dropped"), pa.array(texts, pa.binary())],
            ["doc_id", "n_lines", "n_dropped", "text"],
        )


def cleaned_texts(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    ranges: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_lines, n_dropped and the lines that stay, joined by newlines, for every row."""
    maps = keep_bitmaps(docs, min_chars, min_docs, ranges, id_col, text_col)
    maps = maps.select(F.col("doc_id").alias("map_id"), F.col("text_hash").alias("map_hash"), "n_lines", "n_dropped", "keep")
    same: Column = F.col("doc_id").eqNullSafe(F.col("map_id")) & (F.col("text_hash") == F.col("map_hash"))
    rows = _documents(docs, id_col, text_col).join(maps, same)
    kept = rows.select("doc_id", "body", "n_lines", "n_dropped", "keep").mapInArrow(
        _apply, "doc_id long, n_lines long, n_dropped long, text binary"
    )
    return kept.withColumn("text", F.col("text").cast("string"))


def digests(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of :func:`cleaned_texts`."""
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
