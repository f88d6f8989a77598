"""Suffix-array deduplication of long byte repeats, built blockwise with a difference cover.

Every byte that lies in a ``window``-byte string which also starts earlier (in
a smaller doc_id, or before in the same document) is removed.

Which strings repeat is read off sorted suffixes, but a suffix array of all
texts is never built in one place:

1. *Buckets.*  A suffix belongs to the bucket of the least (by hash) short
   gram among its first ``window`` bytes, so suffixes that agree on a window
   share a bucket.  Buckets with a single place are dropped at once: blocks
   ask each other for the bucket keys they have in common (``blocks.py``).
2. *Contexts.*  Neighbouring suffixes of one bucket are sent together, as the
   bytes they cover.  Contexts that occur again byte for byte are settled
   where they meet: only the first stays.  A bucket that very many blocks
   share is cut further, by the hash of each single window.
3. *Blockwise sorting with a difference cover.*  A task lays the contexts of
   its buckets side by side in (doc_id, place) order.  The suffixes at the
   places of a difference cover modulo 7 are ranked first, by prefix doubling
   in steps of the period.  Then blocks of suffixes with equal leading bytes
   are sorted one at a time.  Long ties are not compared byte by byte: two
   suffixes always have an offset below the period at which both are cover
   places, and the ranks there decide; a short head and tail complete the
   window.  The least place of each class of equal windows is its original.

The bytes themselves decide; hashes only choose buckets, and leave out of the
sorting the windows whose hash no other window has.  Memory is bounded by
a block, a hash range and ``SUFFIXES`` suffixes sorted at a time.

Defined cases: null text is empty; texts shorter than the window lose nothing;
rows that share a doc_id are told apart by where they are packed (one of them
counts as earlier).  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from slotwise.llm import blocks as B
from slotwise.llm.substring_dedup import _BYTE, scramble

WINDOW = 100
GRAM = 32  # bytes of the gram that names a bucket (less for short windows)
VERY_MANY = 256  # blocks that may share a bucket before it is cut further
SUFFIXES = 1 << 17
# Several 8-byte numbers per byte of a block or of a range's contexts are in memory at a time.
BLOCK_BYTES, RANGE_BYTES = 2 << 20, 8 << 20
PERIOD, COVER = 7, (0, 1, 3)  # every difference modulo 7 is one of two members


def gram_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each place on; ``length`` is a power of two."""
    h = _BYTE[0][raw]
    width = 1
    while width < length:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    return scramble(h) if len(raw) >= length else h[:0]


def gram_length(window: int) -> int:
    """The largest power of two up to GRAM and half the window."""
    return 1 << min(GRAM, max(1, window // 2)).bit_length() - 1


class Suffixes:
    """The windows of a block and their buckets."""

    def __init__(self, block: B.Block, window: int):
        self.block, self.window = block, window
        raw = np.frombuffer(block.data, np.uint8)
        n = max(0, len(raw) - window + 1)
        valid = np.zeros(n + 1, np.int32)  # +1 where a document's starts begin, -1 where they end
        long = block.lengths >= window
        np.add.at(valid, block.starts[long], 1)
        np.add.at(valid, block.ends[long] - window + 1, -1)
        gram = gram_length(window)
        self.seeds = B.Seeds(gram_hashes(raw, gram), window - gram + 1, np.cumsum(valid[:n]) > 0)

    def contexts(self, bits: dict, parts: int):
        """Contexts of repeated buckets: first start, number of windows, bucket, cut further."""
        starts, grade = self.seeds.repeated(self.seeds.answers(bits, parts))
        key = self.seeds.least[starts]
        many = grade > 1
        doc = np.searchsorted(self.block.ends, starts, "right")
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | many[1:]
        first = np.flatnonzero(new)
        return starts[first], np.diff(np.append(first, len(starts))), key[first], many[first]

    def outgoing(self, bits: dict, parts: int):
        """Distinct contexts in the order of the block with their ranges, and for
        every context (start, windows) the distinct one it equals."""
        starts, sizes, key, many = self.contexts(bits, parts)
        data, window = self.block.data, self.window
        seen: dict = {}
        which = np.empty(len(starts), np.int64)
        first = []
        for k, (s, n, bucket) in enumerate(zip(starts.tolist(), sizes.tolist(), key.tolist(), strict=True)):
            text = data[s : s + n + window - 1]
            at = seen.setdefault((bucket, text), len(first))
            if at == len(first):
                first.append(k)
            which[k] = at
        first = np.array(first, np.int64)
        place = key[first].copy()
        for j in np.flatnonzero(many[first]):
            s = int(starts[first[j]])
            place[j] = int.from_bytes(hashlib.blake2b(data[s : s + window], digest_size=8).digest(), "little")
        return starts, sizes, which, first, place, key[first]


def _ask_buckets(number: int, block: B.Block, parts: int, window: int) -> Iterator[tuple]:
    yield from Suffixes(block, window).seeds.questions(number, parts)


CONTEXT_COLUMNS = "part int, block long, buckets binary, ids binary, sizes binary, bytes binary"


def _send_contexts(number: int, block: B.Block, bits: dict, parts: int, window: int) -> Iterator[tuple]:
    suffixes = Suffixes(block, window)
    starts, sizes, _, first, place, bucket = suffixes.outgoing(bits, parts)
    part = B.range_of(place, parts)
    ids = block.ids[np.searchsorted(block.ends, starts[first], "right")] if len(first) else block.ids[:0]
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)  # in the order of the block
        pieces = [block.data[s : s + n + window - 1] for s, n in zip(starts[first[mine]].tolist(), sizes[first[mine]].tolist(), strict=True)]
        yield (
            int(p), number, bucket[mine].tobytes(), ids[mine].tobytes(),
            sizes[first[mine]].astype(np.int64).tobytes(), b"".join(pieces),
        )


def _repeats_itself(text: bytes, window: int) -> bool:
    n = len(text) - window + 1
    return n > 1 and len({text[i : i + window] for i in range(n)}) < n


def _resolve_contexts(rows: pd.DataFrame, window: int) -> list[tuple]:
    """For each window of each context sent: 1 if the same bytes start earlier."""
    bucket = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["buckets"]])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["ids"]])
    size = np.concatenate([np.frombuffer(x, np.int64) for x in rows["sizes"]])
    per_row = np.array([len(x) // 8 for x in rows["sizes"]])
    block = np.repeat(rows["block"].to_numpy(), per_row)
    data = b"".join(rows["bytes"])
    ends = np.cumsum(size + window - 1)
    begins = ends - (size + window - 1)
    out_ends = np.cumsum(size)
    out_begins = out_ends - size
    later = np.zeros(int(size.sum()), np.uint8)

    # Contexts in the order of their places; equal ones are settled here.
    order = np.lexsort((np.arange(len(ids)), block, ids))
    seen: set = set()
    firsts = []
    for k in order.tolist():
        text = (bucket[k], data[begins[k] : ends[k]])
        if text in seen:
            later[out_begins[k] : out_ends[k]] = 1
        else:
            seen.add(text)
            firsts.append(k)
    del seen
    firsts = np.array(firsts, np.int64)
    _, which, shared = np.unique(bucket[firsts], return_inverse=True, return_counts=True)
    open_ = shared[which] > 1
    for j in np.flatnonzero(~open_):
        open_[j] = _repeats_itself(data[begins[firsts[j]] : ends[firsts[j]]], window)
    firsts = firsts[open_]
    if len(firsts):
        text = b"".join([data[begins[k] : ends[k]] for k in firsts.tolist()])
        span = size[firsts] + window - 1
        at = np.cumsum(span) - span
        n = size[firsts]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(at, n) + inner
        # Only windows whose hash occurs twice can repeat; the text around the others isn't sorted.
        again = twice_hashed(text, start, window)
        low = np.minimum.reduceat(np.where(again, inner, size.max()), np.cumsum(n) - n)
        high = np.maximum.reduceat(np.where(again, inner, -1), np.cumsum(n) - n)
        some = high >= 0
        if some.any():
            text = b"".join([text[a + lo : a + hi + window] for a, lo, hi in zip(at[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True)])
            span = high[some] - low[some] + window
            moved = np.zeros(len(n), np.int64)
            moved[some] = np.cumsum(span) - span - low[some]
            start = (np.repeat(moved, n) + inner)[again]
            place = (np.repeat(out_begins[firsts], n) + inner)[again]
            later[place] |= repeated_windows(text, start, window)
    row_ends = np.cumsum([size[e - c : e].sum() for c, e in zip(per_row, np.cumsum(per_row), strict=True)]).astype(int)
    row_begins = np.concatenate([[0], row_ends[:-1]])
    return [(b, later[s:e]) for b, s, e in zip(rows["block"], row_begins, row_ends, strict=True)]


def twice_hashed(data: bytes, starts: np.ndarray, window: int) -> np.ndarray:
    """Whether the hash of the ``window`` bytes from each start on is that of another start's too."""
    width = 1 << window.bit_length() - 1
    h = gram_hashes(np.frombuffer(data, np.uint8), width)
    h = scramble(h[starts] * np.uint64(0x9E3779B97F4A7C15) + h[starts + window - width])
    order = np.argsort(h)
    s = h[order]
    same = np.append(s[1:] == s[:-1], False)
    same[1:] |= same[:-1].copy()
    out = np.zeros(len(starts), bool)
    out[order] = same
    return out


# --- sorting with a difference cover ---------------------------------------


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | text[at + k]
    return out


def _rank(column: np.ndarray) -> np.ndarray:
    """Rank of each value in sorted order, equal values alike."""
    order = np.argsort(column)
    s = column[order]
    new = np.zeros(len(order), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Rank of each row in the order of the columns, equal rows alike.

    Ranks of two columns fit one 64-bit number, so each sort has a single key.
    """
    out = _rank(columns[0])
    for c in columns[1:]:
        out = _both(out, _rank(c))
    return out


def _both(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Rank of each row in the order of two columns that are ranks already (-1: before all)."""
    return _rank((first << 32) | (then + 1))


class CoverRanks:
    """Ranks, to a depth of ``periods`` periods, of the suffixes at cover places."""

    def __init__(self, text: np.ndarray, periods: int):
        n = len(text)
        padded = np.append(text, np.zeros(PERIOD * (periods + 2) + 8, np.uint8))
        places = np.arange(n + PERIOD)
        self.places = places[np.isin(places % PERIOD, COVER)]
        # Cover places repeat with the period: the one a period on is a fixed number of rows on.
        c = len(COVER)
        # 7 leading bytes fit a number.
        rank = _dense(_words(padded, self.places) >> np.uint64(8))
        depth, total, filled = 1, None, 0
        while filled < periods:
            if periods & depth:
                total = rank if total is None else _both(total, self._on(rank, c * filled))
                filled += depth
            if filled < periods:
                rank = _both(rank, self._on(rank, c * depth))
                depth *= 2
        self.rank = np.zeros(n + PERIOD, np.int64)
        self.rank[self.places] = total

    @staticmethod
    def _on(rank: np.ndarray, rows: int) -> np.ndarray:
        out = np.full(len(rank), -1, np.int64)
        if rows < len(rank):
            out[: len(rank) - rows] = rank[rows:]
        return out


def repeated_windows(data: bytes, starts: np.ndarray, window: int, suffixes: int = SUFFIXES) -> np.ndarray:
    """1 for each start (ascending) whose ``window`` bytes also begin at an earlier start."""
    text = np.frombuffer(data, np.uint8)
    if window < 2 * PERIOD + 8:
        classes = _dense(*[text[starts + k] for k in range(window)])
        first = np.full(classes.max() + 1, len(starts))
        np.minimum.at(first, classes, np.arange(len(starts)))
        return (first[classes] < np.arange(len(starts))).astype(np.uint8)
    padded = np.append(text, np.zeros(16, np.uint8))
    # Head [0, 7), cover ranks from an offset below 7 on, tail to the end of the window.
    periods = (window - PERIOD + 1) // PERIOD
    ranks = CoverRanks(text, periods).rank
    tail = range(periods * PERIOD, window, 8)
    head = _words(padded, starts) >> np.uint64(8)
    order = np.argsort(head, kind="stable")
    out = np.zeros(len(starts), np.uint8)
    sorted_head = head[order]
    edges = np.append(np.flatnonzero(np.append(True, sorted_head[1:] != sorted_head[:-1])), len(order))
    lo = 0
    while lo < len(edges) - 1:
        # One block: whole groups of equal heads, up to the bound.
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + suffixes, "right")) - 1)
        mine = np.sort(order[edges[lo] : edges[hi]])
        out[mine] = _repeated_in(padded, starts[mine], head[mine], ranks, tail, window)
        lo = hi
    return out


def _repeated_in(text, starts, head, ranks, tail, window) -> np.ndarray:
    n = len(starts)
    # Head and tail of all suffixes together; what lies between is decided below.
    ends = _dense(head, *[_words(text, np.minimum(starts + min(t, window - 8), len(text) - 8)) for t in tail])
    first = np.arange(n)
    for offset in range(PERIOD):
        # The suffixes that have a cover place at this offset; any two equal ones meet at some offset.
        rows = np.flatnonzero(np.isin((starts + offset) % PERIOD, COVER))
        if not len(rows):
            continue
        classes = _both(ends[rows], ranks[starts[rows] + offset])
        least = np.full(classes.max() + 1, n)
        np.minimum.at(least, classes, rows)
        first[rows] = np.minimum(first[rows], least[classes])
    return (first < np.arange(n)).astype(np.uint8)


# --- results ----------------------------------------------------------------


def _covered(block: B.Block, bits: dict, parts: int, window: int) -> np.ndarray:
    """Bytes of the block to remove."""
    suffixes = Suffixes(block, window)
    starts, sizes, which, first, place, _ = suffixes.outgoing(bits, parts)
    part = B.range_of(place, parts)
    n = sizes[first] if len(first) else np.zeros(0, np.int64)
    begins = np.cumsum(n) - n
    later = np.zeros(int(n.sum()), bool)
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        inner = np.arange(n[mine].sum()) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
        later[np.repeat(begins[mine], n[mine]) + inner] = bits[2, int(p)] > 0
    cover = np.zeros(len(block.data) + 1, np.int32)
    if len(starts):
        original = np.zeros(len(starts), bool)
        original[first] = True
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        removed = later[np.repeat(begins[which], sizes) + inner] | ~np.repeat(original, sizes)
        at = (np.repeat(starts, sizes) + inner)[removed]
        np.add.at(cover, at, 1)
        np.subtract.at(cover, at + window, 1)
    return np.cumsum(cover[:-1]) > 0


def _pieces(number: int, block: B.Block, bits: dict, parts: int, window: int) -> Iterator[tuple]:
    """doc_id, bytes, removed bytes, removed runs, what is left."""
    gone = _covered(block, bits, parts, window)
    raw = np.frombuffer(block.data, np.uint8)
    for k, doc_id in enumerate(block.id_list()):
        s, e = block.starts[k], block.ends[k]
        mine = gone[s:e]
        if mine.any():
            runs = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
            yield (doc_id, len(mine), int(mine.sum()), runs, raw[s:e][~mine].tobytes())
        else:
            yield (doc_id, len(mine), 0, 0, block.bytes_of(k))


def _digests(*args, **kw) -> Iterator[tuple]:
    for doc_id, n, removed, runs, kept in _pieces(*args, **kw):
        yield (doc_id, n, removed, runs, hashlib.sha256(kept).hexdigest())


def _run(docs, finish, columns, window, block_bytes, range_bytes, very_many) -> DataFrame:
    blocks = B.pack(docs, "suffix-blocks", block_bytes)
    parts = B.ranges(blocks, range_bytes)
    asked = B.ask(blocks, partial(_ask_buckets, parts=parts, window=window), B.SEED_COLUMNS)
    answers = B.resolve(asked, B.seed_resolver(very_many), 1, "suffix-buckets")
    sent = B.answered(blocks, answers, partial(_send_contexts, parts=parts, window=window), CONTEXT_COLUMNS)
    answers = answers.unionByName(B.resolve(sent, partial(_resolve_contexts, window=window), 2, "suffix-windows"))
    return B.answered(blocks, answers, partial(finish, parts=parts, window=window), columns)


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    range_bytes: int = RANGE_BYTES,
    very_many: int = VERY_MANY,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _run(docs, _digests, columns, window, block_bytes, range_bytes, very_many)


def cleaned_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that are left (cut characters stay cut)."""
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return _run(docs, _pieces, columns, window, BLOCK_BYTES, RANGE_BYTES, VERY_MANY)
