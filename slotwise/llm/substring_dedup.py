"""Substring deduplication by level-wise doubling of repeated word windows.

Windows of a short length are looked at first; only those that repeat are
extended to twice the length, and so on up to the window of interest; a level
without survivors ends the work of a block.  With ``window`` = 20 and
``levels`` = 1 the lengths are 10 and 20.

*First level.*  Every window of the full length is stood for by the least
(by hash) of the short windows inside it.  Equal full windows have equal least
short ones, so the others need not be sent: about a sixth of the places are.
A full window survives if its least short window occurs at another place.

*Further levels.*  Survivors are asked for by the hash of their leading words,
twice as many at each level, until the full length is reached.

*Last level.*  The 96-bit hash of each surviving full window is sent with the
smallest document that holds it in the block.  The first in (doc_id, place) is
the original; every other occurrence is removed.

Keys are distinct per block before they are sent, so windows that thousands of
documents share cost a row entry per block and no task gathers their
occurrences.  See ``blocks.py`` for the exchange.

Defined cases: null or empty text has no words; texts shorter than the window
lose nothing; rows that share a doc_id are told apart by where they are packed
(one of them counts as earlier).  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from slotwise.llm import blocks as B

WINDOW, LEVELS = 20, 1
# Fixed per program, so that every worker hashes alike.
_rng = np.random.default_rng(4)
_BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def scramble(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (never 0)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) | np.uint64(1)


class Words:
    """Words of a block: document of each, and two 64-bit hashes."""

    def __init__(self, block: B.Block):
        raw = np.frombuffer(block.data, np.uint8)
        inside = ~_SEPARATOR[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        # The first byte of a document begins a word even if the one before is no separator.
        first = block.starts[block.lengths > 0]
        begins[first] = inside[first]
        self.starts = np.flatnonzero(begins)
        self.doc = np.searchsorted(block.ends, self.starts, "right")
        self.hash = [np.zeros(0, np.uint64)] * 2
        if len(self.starts):
            lead = self.starts[0]  # bytes before the first word belong to none
            gaps = np.diff(np.append(self.starts, len(raw)))
            place = np.arange(lead, len(raw)) - np.repeat(self.starts, gaps)
            longest = int(place.max()) + 1
            for k in (0, 1):
                power = np.cumprod(np.full(longest, _STEP[k]), dtype=np.uint64)
                value = _BYTE[k][raw[lead:]] * power[place]
                value[~inside[lead:]] = 0
                self.hash[k] = scramble(np.add.reduceat(value, self.starts - lead))
        per_doc = np.bincount(self.doc, minlength=len(block.ids))
        self.ends = np.cumsum(per_doc)
        self.counts = per_doc

    def windows(self, length: int, k: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each word on (over all documents)."""
        h = self.hash[k]
        n = len(h) - length + 1
        if n <= 0:
            return h[:0]
        # The j-th word counts step**j; sums over 1, 2, 4, ... words are put together.
        step = int(_STEP[1 - k])
        sums, width, offset, total = h, 1, 0, np.zeros(n, np.uint64)
        while offset < length:
            if length & width:
                total += sums[offset : offset + n] * np.uint64(pow(step, offset, 1 << 64))
                offset += width
            if offset < length:
                sums = sums[:-width] + sums[width:] * np.uint64(pow(step, width, 1 << 64))
                width *= 2
        return scramble(total)

    def windows_of(self, start: int, length: int) -> int:
        """Hash of the ``length`` words from one word on; as :meth:`windows` has it."""
        step, total = int(_STEP[1]), 0
        for j in range(length):
            total += int(self.hash[0][start + j]) * pow(step, j, 1 << 64)
        return int(scramble(np.array([total & ((1 << 64) - 1)], np.uint64))[0])

    def whole(self, length: int) -> np.ndarray:
        """For each window start whether the window stays within a document."""
        n = len(self.doc) - length + 1
        return self.doc[:n] == self.doc[length - 1 :] if n > 0 else np.zeros(0, bool)


def _seeds(words: Words, window: int, levels: int) -> B.Seeds:
    short = window >> levels
    return B.Seeds(words.windows(short), window - short + 1, words.whole(window))


def _survivors(words: Words, bits: dict, parts: int, window: int, levels: int, upto: int) -> np.ndarray:
    """Starts of the full windows that have survived the levels up to ``upto``."""
    seeds = _seeds(words, window, levels)
    starts, _ = seeds.repeated(seeds.answers(bits, parts))
    for level in range(2, upto + 1):
        key = _middle(words, starts, window, levels, level)
        distinct, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        bounds = B.range_bounds(distinct, parts)
        found = np.zeros(len(distinct), bool)
        for p in range(parts):
            if (level, p) in bits:
                found[bounds[p] : bounds[p + 1]] = bits[level, p] > 0
        starts = starts[(found | (count > 1))[inverse]]
    return starts


def _middle(words: Words, starts: np.ndarray, window: int, levels: int, level: int) -> np.ndarray:
    """Hash of the first words of surviving windows, at a level between the first and the last."""
    return words.windows(window >> (levels + 1 - level))[starts]


def _last(words: Words, starts: np.ndarray, window: int):
    """Distinct full windows of the block: two hashes, first start; and for each start its window."""
    a, b = words.windows(window)[starts], words.windows(window, 1)[starts] >> np.uint64(32)
    order = np.lexsort((starts, b, a))
    a, b, at = a[order], b[order], starts[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new].astype(np.uint32), at[new], at, np.cumsum(new) - 1


def _ask_first(number: int, block: B.Block, parts: int, window: int, levels: int) -> Iterator[tuple]:
    yield from _seeds(Words(block), window, levels).questions(number, parts)


def _ask_middle(number, block, bits, parts, window, levels, level) -> Iterator[tuple]:
    words = Words(block)
    keys = np.unique(_middle(words, _survivors(words, bits, parts, window, levels, level - 1), window, levels, level))
    bounds = B.range_bounds(keys, parts)
    for p in range(parts):
        if bounds[p] < bounds[p + 1]:
            yield (p, number, keys[bounds[p] : bounds[p + 1]].tobytes())


def _ask_last(number, block, bits, parts, window, levels) -> Iterator[tuple]:
    words = Words(block)
    a, b, first, _, _ = _last(words, _survivors(words, bits, parts, window, levels, levels), window)
    ids = block.ids[words.doc[first]]
    bounds = B.range_bounds(a, parts)
    for p in range(parts):
        lo, hi = bounds[p], bounds[p + 1]
        if lo < hi:
            yield (p, number, a[lo:hi].tobytes(), b[lo:hi].tobytes(), ids[lo:hi].tobytes())


def _resolve_last(rows: pd.DataFrame) -> list[tuple]:
    """For each window sent: whether an earlier document (or block) has it too."""
    a = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["a"]])
    b = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["b"]])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["ids"]])
    sizes = np.array([len(x) // 8 for x in rows["a"]])
    block = np.repeat(rows["block"].to_numpy(), sizes)
    order = np.lexsort((block, ids, b, a))
    a, b = a[order], b[order]
    later = np.zeros(len(a), np.uint8)
    again = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    later[order[1:][again]] = 1
    ends = np.cumsum(sizes)
    return [(n, later[e - s : e]) for n, s, e in zip(rows["block"], sizes, ends, strict=True)]


def _finish(number, block, bits, parts, window, levels, last) -> Iterator[tuple]:
    words = Words(block)
    a, _, first, at, which = _last(words, _survivors(words, bits, parts, window, levels, levels), window)
    bounds = B.range_bounds(a, parts)
    earlier = np.zeros(len(a), bool)
    for p in range(parts):
        if (last, p) in bits:
            earlier[bounds[p] : bounds[p + 1]] = bits[last, p] > 0
    removed = at[earlier[which] | (first[which] != at)]
    cover = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(cover, removed, 1)
    np.subtract.at(cover, removed + window, 1)
    keep = np.cumsum(cover[:-1]) == 0
    for k, doc_id in enumerate(block.id_list()):
        mine = keep[words.ends[k] - words.counts[k] : words.ends[k]]
        kept = block.bytes_of(k).split()
        if not mine.all():
            kept = compress(kept, mine.tolist())
        yield (doc_id, len(mine), int(len(mine) - mine.sum()), b" ".join(kept))


def _digest(*args) -> Iterator[tuple]:
    for doc_id, n, removed, kept in _finish(*args):
        yield (doc_id, n, removed, hashlib.sha256(kept).hexdigest())


def _run(docs: DataFrame, window: int, levels: int, finish, columns: str, block_bytes: int, range_bytes: int):
    blocks = B.pack(docs, "substring-blocks", block_bytes)
    parts = B.ranges(blocks, range_bytes)
    first = B.ask(blocks, partial(_ask_first, parts=parts, window=window, levels=levels), B.SEED_COLUMNS)
    answers = B.resolve(first, B.seed_resolver(1 << 62), 1, "substring-level1")
    for level in range(2, levels + 1):
        fn = partial(_ask_middle, parts=parts, window=window, levels=levels, level=level)
        asked = B.answered(blocks, answers, fn, B.SEED_COLUMNS)
        answers = answers.unionByName(B.resolve(asked, B.seed_resolver(1 << 62), level, f"substring-level{level}"))
    fn = partial(_ask_last, parts=parts, window=window, levels=levels)
    asked = B.answered(blocks, answers, fn, "part int, block long, a binary, b binary, ids binary")
    answers = answers.unionByName(B.resolve(asked, _resolve_last, levels + 1, "substring-last"))
    fn = partial(finish, parts=parts, window=window, levels=levels, last=levels + 1)
    return B.answered(blocks, answers, fn, columns)


def _call(fn, number, block, bits, parts, window, levels, last):
    yield from fn(number, block, bits, parts, window, levels, last)


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    levels: int = LEVELS,
    block_bytes: int = B.BLOCK_BYTES,
    range_bytes: int = B.RANGE_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    return _run(
        docs,
        window,
        levels,
        partial(_call, _digest),
        "doc_id long, n_words long, n_removed long, kept_sha256 string",
        block_bytes,
        range_bytes,
    )


def _texts(*args) -> Iterator[tuple]:
    for doc_id, _, removed, kept in _finish(*args):
        yield (doc_id, removed, kept.decode("utf-8"))


def cleaned_texts(docs: DataFrame, window: int = WINDOW, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_removed and the text that is left (its words joined by one space)."""
    return _run(
        docs,
        window,
        levels,
        partial(_call, _texts),
        "doc_id long, n_removed long, text string",
        B.BLOCK_BYTES,
        B.RANGE_BYTES,
    )
