"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A text is the set of its distinct word shingles.  Two texts link when
intersection / union >= ``percent`` / 100; the result gives every document the
smallest doc_id that links lead to.

*Signatures.*  Sets are put into size bands; a pair belongs to the band of its
smaller set.  In a band the symmetric difference of a linked pair is at most
H.  The universe of shingles is hashed into segments, and every segment i is
allocated a number v_i: 1 (the segments of a pair must be equal) or 2 (they
may differ by one shingle: all one-deletion neighbours are indexed too), with
sum v_i = H + 1 + slack.  By the pigeonhole principle a linked pair agrees
within its allowance on segments of total allowance 1 + slack or more.  An
empty segment would match everything, so none is indexed by itself: a pair
that agrees on nothing else has slack + 1 empty segments in common, so of sets
with that many, subsets of their empty segments are indexed.  How many
segments get which allowance, the slack and the size of the subsets are chosen
per band by the cost of the keys and of chance matches.  No linked pair is
lost.

*Candidates.*  Batches of documents send packed keys to hash ranges, a row per
batch and range, each distinct set once; a range gives the distinct lists of
sets that share a key.  In a range a key is 40 bits (a chance match costs one
comparison) and a set its identity, 64 bits of a digest of its shingles, so
copies are one set however many there are; of 15 million sets, two have the same
identity with odds of 1 to 160,000.  Size and sketch of a set are sent once, to
the range that its identity lies in, not with its keys.

*Verification.*  Every set is compared with two others first: of the sets that
lead a list it is in, the least and the closest.  Near copies agree on the least,
so a group becomes a star, linear in its members however many lists it is in; the
closest stands in where the least is too far.  Components of the verified links
are formed; leaders that lie in another component come next.  Only lists that
still hold several components are looked at again, and only the sets outside a
list's main component, its largest, ask: first for their closest ones, then for
all.  Where these are more pairs than members, the sets are compared where the
members of the list meet, and only links that join components leave the task, fewer
than the members, however many pairs there are to compare.  Before sets meet, an exact bound by size and by parity sketches rules
pairs out (two sets differ in at least as many shingles as their sketches differ
in bits).  Sketches grow with their set, one to two bits a shingle; within lists
they are at most ``SKETCH`` bits.  Sets that no such pair is left of are no
candidates, so their shingles are never written.  So a huge group of near copies
never becomes all its pairs, and no link between components is missed.  Shingles
are compared in full as 64-bit hashes of their words.  Texts are read twice: for
the keys, and for the sets of candidates, which are written once.

Defined cases: null or blank text is the empty set, linked with nothing; with
fewer words than a shingle the whole sequence is the one shingle; copies link;
rows that repeat a doc_id are separate rows of one component if their sets
link; a null doc_id is never a component's smallest id unless all are null.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import blocks as B
from slotwise.llm.common import cut, hand_back, lean, ready
from slotwise.llm.components import components
from slotwise.llm.substring_dedup import Words, scramble

SHINGLE, PERCENT = 5, 80
BATCH_BYTES, RANGE_BYTES = 2 << 20, 16 << 20
SKETCH = 2048  # most bits of a sketch within lists
MOST_CELLS = 1 << 20  # of a wide sketch; a still larger set has a weaker bound
CHANCE = 1e8  # cost of a chance match in keys, for sets by the hundred million
NEAREST = 3  # closest sets compared before all pairs across components are
LIST_CHUNK = 1024  # sets compared with each other in one task
CHUNK_SHINGLES = 256 * LIST_CHUNK  # about as many of them, where sets are compared in full
BLOOM_WORDS = 1 << 19  # 64-bit words of the filter of candidate sets


# --- bands and allocation ----------------------------------------------------


@lru_cache(maxsize=None)
def bands(percent: int, top: int) -> list[tuple[int, int]]:
    """Size bands (smallest, largest), a ratio of about 100 / percent wide."""
    out, low = [], 1
    while low <= top:
        high = max(low, low * 100 // percent)
        out.append((low, high))
        low = high + 1
    return out


def difference(percent: int, high: int) -> int:
    """Largest symmetric difference of a linked pair whose smaller set has up to ``high``."""
    larger = high * 100 // percent
    # |XΔY| <= (|X| + |Y|) (1 - t) / (1 + t)
    return (high + larger) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def allocation(percent: int, low: int, high: int) -> tuple[int, int, int, int]:
    """(segments, how many of them are allocated 2, slack, subset size) of a band.

    A set with more than ``slack`` empty segments has their subsets of the last
    size indexed.  Chosen by least cost: the expected keys of one of the
    band's smallest sets, and those it shares by chance with another.
    """
    need = difference(percent, high) + 1
    size = math.sqrt(low * high)
    best = None
    for two in range((min(need, 3) if need < 8 else 0) + 1):
        for slack in sorted({*range(9), *range(8, need // 2, max(1, need // 24))}):
            segments = need + slack - two
            if segments < max(1, two):
                continue
            ones = segments - two
            none = (1 - 1 / segments) ** low
            mean = ones * none
            one = low / segments * (1 - 1 / segments) ** (low - 1) if segments > 1 else 0.0
            # The number of empty segments is about Poisson distributed.
            tail = int(max(slack, mean) + 8 * math.sqrt(mean)) + 20
            counts = range(slack + 1, min(ones, tail) + 1) if mean > 0 else range(0)
            weight = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in counts]
            over = sum(weight)
            for take in range(1, min(slack + 1, 6) + 1):
                subsets = sum(w * math.comb(k, take) for w, k in zip(weight, counts, strict=True))
                full = max(slack + 1, mean) / max(1, ones)
                chance = two * (none + one) + over * over * math.comb(ones, take) * full ** (2 * take)
                cost = segments + two * size / segments + subsets + CHANCE * chance
                if best is None or cost < best[0]:
                    best = (cost, (segments, two, slack, take))
    return best[1]


# --- sets ---------------------------------------------------------------------


class Sets:
    """Shingle sets of a batch: sorted distinct hashes, joined, with bounds."""

    def __init__(self, texts: list[bytes], shingle: int):
        block = B.Block(
            np.arange(len(texts)), np.array([len(t) for t in texts], np.int64), b"".join(texts).lower()
        )
        words = Words(block)
        n = words.counts
        begin = words.ends - n
        h = words.windows(shingle)
        whole = words.whole(shingle)
        doc = words.doc[: len(whole)][whole]
        h = h[whole]
        short = np.flatnonzero((n > 0) & (n < shingle))
        if len(short):
            own = np.array([int(words.windows_of(begin[k], n[k])) for k in short], np.uint64)
            doc, h = np.append(doc, short), np.append(h, own)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        self.doc, self.h = doc[new], h[new]
        self.sizes = np.bincount(self.doc, minlength=len(texts))
        self.ends = np.cumsum(self.sizes)

    def of(self, k: int) -> np.ndarray:
        return self.h[self.ends[k] - self.sizes[k] : self.ends[k]]

    def ids(self) -> np.ndarray:
        """Identities: 64 bits of a digest of the shingles."""
        digests = [hashlib.blake2b(self.of(k).tobytes(), digest_size=8).digest() for k in range(len(self.sizes))]
        return np.frombuffer(b"".join(digests), np.int64)

    def keys(self, percent: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signature keys of the chosen sets and the set of each."""
        top = int(self.sizes.max()) if len(self.sizes) else 0
        lows = np.array([b[0] for b in bands(percent, max(1, top))])
        band = np.searchsorted(lows, self.sizes, "right") - 1
        keys, owner = [], []
        for k in np.unique(band[chosen]):
            mine = chosen[band[chosen] == k]
            self._in_band(percent, int(k), mine, keys, owner)
            if k:
                # As the larger set of a pair whose smaller one is in the band below.
                high = lows[k] - 1
                self._in_band(percent, int(k) - 1, mine[self.sizes[mine] * percent <= high * 100], keys, owner)
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(keys), np.concatenate(owner)

    def _in_band(self, percent: int, number: int, mine: np.ndarray, keys: list, owner: list) -> None:
        if not len(mine):
            return
        low, high = bands(percent, 1 << 40)[number]
        segments, two, slack, take = allocation(percent, low, high)
        sizes = self.sizes[mine]
        at = np.repeat(self.ends[mine] - sizes, sizes) + np.arange(sizes.sum()) - np.repeat(
            np.cumsum(sizes) - sizes, sizes
        )
        salt = np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        token = scramble(self.h[at] ^ salt)
        segment = ((token >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        slot = np.repeat(np.arange(len(mine)), sizes) * segments + segment
        total = np.zeros(len(mine) * segments, np.uint64)
        token = scramble(token)
        np.add.at(total, slot, token)
        count = np.bincount(slot, minlength=len(total))
        name = np.tile(np.arange(segments, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), len(mine)) ^ salt
        full = scramble(total ^ name)
        who = np.repeat(mine, segments)
        place = np.tile(np.arange(segments), len(mine))
        empty = (count == 0) & (place >= two)
        keys.append(full[~empty])
        owner.append(who[~empty])
        blank = empty.reshape(len(mine), segments)
        subsets, holder = [], []
        for k in np.flatnonzero(blank.sum(axis=1) > slack).tolist():
            names = scramble(name[: segments][blank[k]]).tolist()
            for some in combinations(names, take):
                subsets.append(sum(some) & (1 << 64) - 1)
                holder.append(mine[k])
        if subsets:
            keys.append(scramble(np.array(subsets, np.uint64)))
            owner.append(np.array(holder, np.int64))
        if two:
            near = np.flatnonzero(segment < two)
            keys.append(scramble((total[slot[near]] - token[near]) ^ name[slot[near]]))
            owner.append(who[slot[near]])

    def sketch(self, k: int) -> bytes:
        """Parity of a set in each of its hashed cells."""
        h = self.of(k)
        cells = 8 * int(sketch_bytes(len(h)))
        cell = (scramble(h ^ np.uint64(0xA5A5A5A5)) >> np.uint64(40)).astype(np.int64) % cells
        return np.packbits((np.bincount(cell, minlength=cells) & 1).astype(np.uint8)).tobytes()


def sketch_bytes(n) -> np.ndarray:
    """Length of the sketches of sets of ``n`` shingles: one to two cells a shingle, a power
    of two in all; the parts of a sketch added up give the sketch of fewer cells."""
    n = np.maximum(np.asarray(n, np.int64), 1)
    return np.clip(1 << np.ceil(np.log2(n)).astype(np.int64), 64, MOST_CELLS) // 8


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of 64-bit words brought to fewer of them."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0) if len(sketch) > words else sketch


BATCH_TEXTS = 4096  # owners fit 16 bits


def _arrays(column: pa.Array | pa.ChunkedArray, dtype) -> Iterator[np.ndarray]:
    """The values of a binary column as arrays over Arrow's own memory, one at a time."""
    return (np.frombuffer(x.as_buffer(), dtype) for x in column)


def _batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of about ``limit`` bytes, at most ``BATCH_TEXTS`` of them."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            data = (t.as_py() or "").encode("utf-8")
            ids.append(i)
            texts.append(data)
            size += len(data)
            if size >= limit or len(ids) >= BATCH_TEXTS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


# --- candidate lists ------------------------------------------------------------


def questions(docs: DataFrame, shingle: int, percent: int, parts: int, batch_bytes: int) -> DataFrame:
    """What batches of documents send the hash ranges: keys with the identities of their sets,
    and size and sketch of each set whose identity lies in the range."""

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _batches(batches, batch_bytes):
            sets = Sets(texts, shingle)
            ids = sets.ids()
            _, first = np.unique(ids, return_index=True)  # a set once per batch
            chosen = np.sort(first[sets.sizes[first] > 0])
            key, owner = sets.keys(percent, chosen)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            bounds = B.range_bounds(key, parts)
            home = B.range_of(ids[chosen].view(np.uint64), parts)
            chosen = chosen[np.argsort(home, kind="stable")]
            homes = np.searchsorted(np.sort(home), np.arange(parts + 1))
            for p in range(parts):
                lo, hi = bounds[p], bounds[p + 1]
                mine = chosen[homes[p] : homes[p + 1]]
                if lo < hi or len(mine):
                    here, index = np.unique(owner[lo:hi], return_inverse=True)
                    high = (key[lo:hi] >> np.uint64(32)).astype(np.uint8)
                    row = {
                        "keys": key[lo:hi].astype(np.uint32), "high": high, "owner": index.astype(np.uint16), "ids": ids[here],
                        "own": ids[mine], "sizes": sets.sizes[mine].astype(np.int64),
                        "sketches": np.frombuffer(b"".join([sets.sketch(k) for k in mine.tolist()]), np.uint8),
                    }
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in row.values())],
                        ["part", *row],
                    )

    columns = "part int, keys binary, high binary, owner binary, ids binary, own binary, sizes binary, sketches binary"
    return docs.select("doc_id", "text").mapInArrow(send, columns)


def candidate_lists(
    docs: DataFrame, shingle: int, percent: int, parts: int, batch_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """(list, chunk, least, n, members): distinct lists of the identities of sets that share a
    key, ``LIST_CHUNK`` members a row at most, with the least and the number of all of them;
    and (id, n_shingles, sketch, wide) of every set, ``sketch`` being the one used within lists."""

    def meet(table: pa.Table) -> pa.Table:
        hand_back()  # what the range before has left
        rows = {c: table.column(c) for c in table.column_names}
        ids = list(_arrays(rows["ids"], np.int64))
        every, index = np.unique(np.concatenate(ids), return_inverse=True)
        offset = np.cumsum([0, *map(len, ids)])
        index = index.astype(np.int32)
        owners = zip(_arrays(rows["owner"], np.uint16), offset, strict=False)
        owner = np.concatenate([index[x.astype(np.int64) + o] for x, o in owners])
        key = np.concatenate(list(_arrays(rows["high"], np.uint8))).astype(np.uint64) << np.uint64(32)
        key |= np.concatenate(list(_arrays(rows["keys"], np.uint32)))
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[new], owner[new]
        del order, new
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        # Lists of equal members are one; a list is named by two sums of its members' hashes.
        many = np.flatnonzero(size > 1)
        found: dict[bytes, np.ndarray] = {}
        if len(many):
            member = every.view(np.uint64)
            sums = [np.add.reduceat(scramble(member ^ np.uint64(k))[owner], start) for k in (0, 0x5BD1E995)]
            label = np.ascontiguousarray(np.stack(sums, axis=1)).view("V16").ravel()
            _, first = np.unique(label[many], return_index=True)
            for s, n in zip(start[many[first]].tolist(), size[many[first]].tolist(), strict=True):
                members = every[owner[s : s + n]]
                found[hashlib.blake2b(members.tobytes(), digest_size=16).digest()] = members
        # A row holds LIST_CHUNK members at most; equal lists are cut alike, since their members are in order.
        lists = [
            (name, k // LIST_CHUNK, int(members[0]), len(members), members[k : k + LIST_CHUNK])
            for name, members in found.items() for k in range(0, len(members), LIST_CHUNK)
        ]
        known = [np.concatenate(list(_arrays(rows[c], np.int64))) for c in ("own", "sizes")]
        wide = b"".join(x.as_py() for x in rows["sketches"])
        length = sketch_bytes(known[1])
        begin = np.cumsum(length) - length
        own, which = np.unique(known[0], return_index=True)
        sketches = [wide[b : b + n] for b, n in zip(begin[which].tolist(), length[which].tolist(), strict=True)]
        short = [folded(np.frombuffer(x, np.uint64), SKETCH // 64).tobytes() for x in sketches]
        # Typed, so that a range without lists is a table like any other.
        none, no_set = [None] * len(own), [None] * len(lists)
        columns = list(zip(*lists, strict=True)) if lists else [()] * 5
        types = {"list": pa.binary(), "chunk": pa.int32(), "least": pa.int64(), "n": pa.int64(), "members": pa.list_(pa.int64())}
        out = {c: pa.array([*x, *none], t) for (c, t), x in zip(types.items(), columns, strict=True)}
        out |= {"id": pa.array([*no_set, *own.tolist()], pa.int64()), "n_shingles": pa.array([*no_set, *known[1][which].tolist()], pa.int64())}
        out |= {c: pa.array([*no_set, *x], pa.binary()) for c, x in (("sketch", short), ("wide", sketches))}
        return pa.table(out)

    schema = "list binary, chunk int, least long, n long, members array<long>, id long, n_shingles long, sketch binary, wide binary"
    asked = questions(docs, shingle, percent, parts, batch_bytes)
    both = cut(asked.groupBy("part").applyInArrow(meet, schema), "jaccard-ranges")
    lists = both.where("list IS NOT NULL").select("list", "chunk", "least", "n", "members").dropDuplicates(["list", "chunk"])
    return cut(lists, "jaccard-lists"), both.where("id IS NOT NULL").select("id", "n_shingles", "sketch", "wide")


# --- sets of candidates -----------------------------------------------------------


def _bloom_places(ids: np.ndarray) -> list[np.ndarray]:
    """Three bit positions of identities."""
    a = ids.view(np.uint64)
    b = scramble(a) | np.uint64(1)
    return [(scramble(a + np.uint64(k) * b) % np.uint64(BLOOM_WORDS * 64)).astype(np.int64) for k in range(3)]


def _bloom(candidates: DataFrame) -> np.ndarray:
    """Bloom filter of the candidate sets (id, once each); its size is fixed."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_bloom_places(b.column("id").to_numpy())))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array(value.astype(np.int64))], ["word", "value"]
            )

    rows = candidates.mapInArrow(bits, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    out = np.zeros(BLOOM_WORDS, np.uint64)
    got = rows.toArrow()  # at most BLOOM_WORDS rows
    out[got["word"].to_numpy()] = got["value"].to_numpy().astype(np.uint64)
    return out


def describe(docs: DataFrame, candidates: DataFrame, shingle: int, batch_bytes: int) -> DataFrame:
    """Every document's set: doc_id, n_shingles, id (null for the empty set), the row's
    number, and of a candidate also its shingles (sorted 64-bit hashes).

    A Bloom filter of fixed size names the candidates, so of most other sets
    nothing but the identity is written; a set is written once per batch.
    """
    held = docs.sparkSession.sparkContext.broadcast(_bloom(candidates))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for doc_ids, texts in _batches(batches, batch_bytes):
            sets = Sets(texts, shingle)
            ids = sets.ids()
            maybe = sets.sizes > 0
            for at in _bloom_places(ids):
                maybe &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            kept = np.zeros(len(ids), bool)
            kept[np.unique(ids, return_index=True)[1]] = True
            kept &= maybe
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(sets.sizes),
                    pa.array(ids, mask=sets.sizes == 0),
                    pa.array([sets.of(k).tobytes() if y else None for k, y in enumerate(kept)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "id", "shingles"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, id long, shingles binary")
    return cut(rows.withColumn("row", F.monotonically_increasing_id()), "jaccard-described")


def written_sets(described: DataFrame) -> DataFrame:
    """(id, shingles) of the written sets, each once: of rows with one identity the first.

    Only the numbers of the other rows are moved; the shingles stay where they are.
    """
    rows = described.where("shingles IS NOT NULL")
    first = rows.groupBy("id").agg(F.min("row").alias("first"), F.collect_list("row").alias("rows"))
    more = first.where(F.size("rows") > 1).select("first", F.explode("rows").alias("row")).where("row <> first")
    return rows.join(cut(more.select("row"), "jaccard-copies"), "row", "left_anti").select("id", "shingles")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 * intersection >= percent * union of two sorted sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches differ, in the cells of the shorter one."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64))


def allowed(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that sizes and wide sketches do not rule out,
    with the bits in which these differ."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = batch.column("m").to_numpy(), batch.column("n").to_numpy()
            both = zip(_arrays(batch.column("x"), np.uint64), _arrays(batch.column("y"), np.uint64), strict=True)
            differing = np.array([_differing(x, y) for x, y in both], np.int64)
            rows = batch.select(["a", "b"]).append_column("differing", pa.array(differing))
            yield rows.filter(pa.array(_possible(m, n, differing, percent), pa.bool_()))

    left = info.select(F.col("id").alias("a"), F.col("n_shingles").alias("m"), F.col("wide").alias("x"))
    right = info.select(F.col("id").alias("b"), F.col("n_shingles").alias("n"), F.col("wide").alias("y"))
    close = F.least("m", "n") * 100 >= F.greatest("m", "n") * percent
    return pairs.join(left, "a").join(right, "b").where(close).mapInArrow(run, "a long, b long, differing long")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joined = pairs.join(la, "a", "left").join(lb, "b", "left")
    return joined.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _possible(m, n, differing: np.ndarray, percent: int) -> np.ndarray:
    small, large = np.minimum(m, n), np.maximum(m, n)
    return (small * 100 >= large * percent) & (differing * (100 + percent) <= (m + n) * (100 - percent))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link: their shingles are counted in full.

    ``pairs`` is a written table, so the planner knows its size: a small one is
    sent to the sets, which then are read and not shuffled.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(_arrays(batch.column("x"), np.uint64), _arrays(batch.column("y"), np.uint64), strict=True)
            keep = [linked(x, y, percent) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")).join(pairs.select("b"), "b", "left_semi")
    joined = left.join(right, "b").select("a", "b", "x", "y")
    return cut(joined.mapInArrow(run, "a long, b long"), "jaccard-links")


# --- lists with several components ---------------------------------------------------


class Entries:
    """Members of a list's main component and others, by size, and which of them may link across components.

    Every pair across components has a member outside the main one, so only
    those are asked for their partners.  With ``inner`` not set, two of them
    are a pair only if they are on different sides.
    """

    def __init__(self, rows: list[dict], inner: bool, percent: int):
        rows.sort(key=lambda r: (r["n_shingles"], r["id"]))
        self.ids = [r["id"] for r in rows]
        self.n = np.array([r["n_shingles"] for r in rows])
        self.label = np.array([r["label"] for r in rows])
        self.main = np.array([r["main"] for r in rows])
        self.side = np.array([r["side"] for r in rows])
        words = min(len(r["sketch"]) for r in rows) // 8
        self.sketch = np.stack([folded(np.frombuffer(r["sketch"], np.uint64), words) for r in rows])
        self.inner, self.percent = inner, percent
        self.others = np.flatnonzero(~self.main).tolist()

    def partners(self, i: int) -> np.ndarray:
        """Members of the main component, and later ones of further components, that size
        and sketch allow a member outside the main one, the closest first."""
        n, label = self.n, self.label
        # Sets of other components of the sizes that can link.
        least = int(np.searchsorted(n, -(-n[i] * self.percent // 100), "left"))
        j = np.arange(least, int(np.searchsorted(n, n[i] * 100 // self.percent, "right")))
        j = j[self.main[j] | ((j > i) & (label[j] != label[i]) & (self.inner | (self.side[j] != self.side[i])))]
        differing = np.bitwise_count(self.sketch[j] ^ self.sketch[i]).sum(axis=1, dtype=np.int64)
        fits = _possible(n[i], n[j], differing, self.percent)
        return j[fits][np.argsort(differing[fits], kind="stable")]

    def pair(self, i: int, j: int) -> tuple[int, int]:
        a, b = self.ids[i], self.ids[j]
        return (a, b) if a < b else (b, a)

    def closest(self, nearest: int) -> Iterator[tuple[int, int]]:
        """Of every member outside the main component the pairs with so many of its partners."""
        return (self.pair(i, j) for i in self.others for j in self.partners(i)[:nearest].tolist())

    def partnered(self) -> Iterator[int]:
        """Members that may link with one of another component."""
        found = np.zeros(len(self.ids), bool)
        for i in self.others:
            j = self.partners(i)
            found[j] = True
            found[i] |= len(j) > 0
        return (self.ids[k] for k in np.flatnonzero(found).tolist())

    def pairs(self) -> list[tuple[int, int]] | None:
        """The pairs that may link across components; none if they are more than the members."""
        out = []
        for i in self.others:
            out.extend(self.pair(i, j) for j in self.partners(i).tolist())
            if len(out) > len(self.ids):
                return None
        return out

    def joining(self, sets: dict[int, np.ndarray]) -> Iterator[tuple[int, int]]:
        """Links that join all components that links join: fewer than there are components.

        Partners are compared in full unless the links found before have joined them.
        """
        _, joined = np.unique(self.label, return_inverse=True)
        for i in self.others:
            for j in self.partners(i).tolist():
                if joined[i] != joined[j] and linked(sets[self.ids[i]], sets[self.ids[j]], self.percent):
                    joined[joined == joined[i]] = joined[j]
                    yield self.pair(i, j)


def mixed_chunks(members: DataFrame, labels: DataFrame, info: DataFrame) -> DataFrame:
    """(list, inner, entries): the members of lists that hold several components.

    The members of a long list's main component and its others are cut into
    chunks by hash.  A row holds a chunk of the others with one of the main
    component or with another chunk of the others, so its size is bounded, and
    with few others the main component's members are in one row each.  If
    ``members`` has ``n``, sets so large count as several.
    """
    weight = F.greatest(F.lit(1), F.ceil(F.col("n") * LIST_CHUNK / CHUNK_SHINGLES)) if "n" in members.columns else F.lit(1)
    named = members.withColumn("weight", weight).join(labels, members["member"] == labels["node"], "left").select(
        "list", "member", "weight", F.coalesce("label", "member").alias("label")
    )
    held = named.groupBy("list", "label").agg(F.sum("weight").alias("held"))
    spread = held.groupBy("list").agg(
        F.max(F.struct("held", "label")).alias("main"), F.sum("held").alias("all"), F.count(F.lit(1)).alias("labels")
    )
    chunks = {"mains": F.col("main.held"), "outs": F.col("all") - F.col("main.held")}
    # Written, so that its size is known where it meets the members again.
    mixed = cut(
        spread.where("labels > 1").select(
            "list", F.col("main.label").alias("most"), *(F.ceil(n / LIST_CHUNK).cast("int").alias(c) for c, n in chunks.items())
        ),
        "jaccard-mixed",
    )
    short = info.withColumnRenamed("id", "member")
    rows = named.join(mixed, "list").join(short, "member").withColumn("main", F.col("label") == F.col("most")).withColumn(
        "chunk", F.pmod(F.xxhash64("member"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("outs"))).cast("int")
    )

    def to(c1, c2):
        return F.struct(c1.cast("int").alias("c1"), c2.cast("int").alias("c2"))

    every_main, every_other = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("mains", "outs"))
    chunk = F.col("chunk")
    # Of two chunks of others, the first is numbered below zero.
    places = F.when(F.col("main"), F.transform(every_other, lambda k: to(chunk, k))).otherwise(
        F.concat(
            F.transform(every_main, lambda k: to(k, chunk)),
            F.transform(F.filter(every_other, lambda k: k != chunk), lambda k: to(-1 - F.least(k, chunk), F.greatest(k, chunk))),
        )
    )
    entry = F.struct(
        F.col("member").alias("id"), "label", "main", (chunk == F.col("at.c2")).alias("side"),
        *(c for c in short.columns if c != "member"),
    )
    return (
        rows.withColumn("at", F.explode(places))
        .groupBy("list", F.col("at.c1").alias("c1"), F.col("at.c2").alias("c2"))
        .agg(F.collect_list(entry).alias("entries"))
        .select("list", (F.col("c1") == 0).alias("inner"), "entries")
    )


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bool, list[dict]]]:
    """The rows of :func:`mixed_chunks`, one at a time."""
    for name, inner, entries in zip(batch.column("list"), batch.column("inner").to_pylist(), batch.column("entries"), strict=True):
        yield name.as_py(), inner, entries.as_py()


def _pair_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*sorted(found), strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def closest_across(members: DataFrame, labels: DataFrame, info: DataFrame, percent: int, nearest: int) -> DataFrame:
    """Pairs (a, b) across components within the lists that hold several (see :class:`Entries`)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = (Entries(entries, inner, percent) for _, inner, entries in _entries(b))
            yield _pair_batch({p for e in rows for p in e.closest(nearest)})

    chunks = mixed_chunks(members, labels, info.select("id", "n_shingles", "sketch"))
    return chunks.mapInArrow(run, "a long, b long").distinct()


def split_across(members: DataFrame, labels: DataFrame, info: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) across components, of the rows of :func:`mixed_chunks` that have no more
    pairs than members; of the others (list, member, n): the sets that may link and their size."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, held = set(), set()
            for name, inner, rows in _entries(b):
                n = {r["id"]: r["n_shingles"] for r in rows}
                entries = Entries(rows, inner, percent)
                pairs = entries.pairs()
                if pairs is None:
                    held.update((name, i, n[i]) for i in entries.partnered())
                else:
                    found.update(pairs)
            out = [(*p, None, None, None) for p in sorted(found)] + [(None, None, *h) for h in sorted(held)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    kinds = {"a": pa.int64(), "b": pa.int64(), "list": pa.binary(), "member": pa.int64(), "n": pa.int64()}
    schema = pa.schema(kinds.items())
    # Wide sketches: what they let through may be moved with all its shingles.
    wide = info.select("id", "n_shingles", F.col("wide").alias("sketch"))
    rows = mixed_chunks(members, labels, wide).mapInArrow(run, "a long, b long, list binary, member long, n long")
    rows = cut(rows.distinct(), "jaccard-split")
    return rows.where("a IS NOT NULL").select("a", "b"), rows.where("list IS NOT NULL").select("list", "member", "n")


def links_across(members: DataFrame, labels: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) that join all components that a link within a list joins.

    The members meet with their shingles; a row makes fewer links than it has members.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for _, inner, rows in _entries(b):
                held = {r["id"]: np.frombuffer(r.pop("shingles"), np.uint64) for r in rows}
                found.update(Entries(rows, inner, percent).joining(held))
            yield _pair_batch(found)

    full = info.select("id", "n_shingles", F.col("wide").alias("sketch"))
    full = full.join(members.select(F.col("member").alias("id")), "id", "left_semi").join(sets, "id")
    return cut(mixed_chunks(members, labels, full).mapInArrow(run, "a long, b long").distinct(), "jaccard-joining")


def candidate_sets(star: DataFrame, members: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """(id): the sets that may link with another one of their lists, by size and sketch.

    Those of a pair with a leader, and of the others those that find a partner in a list.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = (Entries(entries, inner, percent) for _, inner, entries in _entries(b))
            found = {i for e in rows for i in e.partnered()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["id"])

    led = star.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # As if the sets with a leader were one component and every other set its own.
    one = led.crossJoin(star.agg(F.min("a").alias("label"))).select(F.col("id").alias("node"), "label")
    others = mixed_chunks(members, one, info.select("id", "n_shingles", "sketch")).mapInArrow(run, "id long")
    return cut(led.unionByName(others).distinct(), "jaccard-candidates")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    batch_bytes: int = BATCH_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    ready(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // range_bytes))
    lists, info = candidate_lists(docs, shingle, percent, parts, batch_bytes)
    star = lists.select(F.col("least").alias("a"), F.explode("members").alias("b")).where("a <> b").distinct()
    star = cut(allowed(star, info, percent), "jaccard-star")
    # The only pair of a list of two is in the star.
    members = lists.where("n > 2").select("list", F.explode("members").alias("member"))
    candidates = candidate_sets(star, members, info, percent)
    members = cut(members.join(candidates.withColumnRenamed("id", "member"), "member", "left_semi"), "jaccard-members")
    described = describe(docs, candidates, shingle, batch_bytes)
    sets = written_sets(described)
    ends = star.groupBy("b").agg(
        F.min("a").alias("least"), F.min(F.struct("differing", "a"))["a"].alias("closest")
    )
    first = ends.select(F.explode(F.array_distinct(F.array("least", "closest"))).alias("a"), "b")
    first = cut(first, "jaccard-first")
    links = verify(first, sets, percent)
    labels = components(links)
    rest = cut(apart(star.join(first, ["a", "b"], "left_anti"), labels), "jaccard-rest")
    links = links.unionByName(verify(rest, sets, percent))
    labels = components(links)
    compared = first.unionByName(rest)

    # Sets that no leader linked: their closest ones join them to their component,
    # so that few pairs across components are left to compare.
    close = closest_across(members, labels, info, percent, NEAREST).join(compared, ["a", "b"], "left_anti")
    close = cut(allowed(close, info, percent).select("a", "b"), "jaccard-close")
    labels = components(links.unionByName(verify(close, sets, percent)))
    few, many = split_across(members, labels, info, percent)
    few = few.join(compared.unionByName(close), ["a", "b"], "left_anti")
    few = cut(allowed(few, info, percent).select("a", "b"), "jaccard-across")
    more = verify(few, sets, percent).unionByName(links_across(many, labels, info, sets, percent))
    # Links between components, as links between their least members.
    la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joined = more.join(la, "a", "left").join(lb, "b", "left")
    joined = cut(joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct(), "jaccard-more")
    upper = components(joined).select(F.col("node").alias("label"), F.col("label").alias("top"))
    every = labels.unionByName(
        upper.select(F.col("label").alias("node"), F.col("label"))
    ).distinct()
    top = every.join(upper, "label", "left").groupBy("node").agg(F.min(F.coalesce("top", "label")).alias("set"))
    where = described.select("doc_id", "n_shingles", "id")
    placed = where.join(top.withColumnRenamed("node", "id"), "id", "left").select(
        "doc_id", "n_shingles", F.coalesce("set", "id").alias("set")
    )
    # A document without shingles is alone; its component is itself.
    least_id = placed.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least_id, "set", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The documents that stay: the smallest id of every component, with all columns."""
    kept = near_duplicates(docs, **params).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return docs.join(kept.select(F.col("doc_id").alias("__kept")), docs["doc_id"].eqNullSafe(F.col("__kept")), "left_semi")
