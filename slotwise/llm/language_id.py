"""Language identification by interpolated Kneser-Ney character models.

*Text.*  Letters are lower-cased; any run of other characters is one space.
An alphabet of the commonest letters of the training sample gives every
character a 12-bit number, so five characters pack into one 64-bit key.

*Models.*  One model of order five per language: absolute discounting,
continuation counts below the top order, interpolated down to a uniform floor.
For every n-gram that any language has seen, the full log-probability in every
language is worked out once; for every context, its backoff weight.  They are
kept in arrays sorted by the key's hash.  A lookup starts at the place that
the leading hash bits name and steps on to the key, so scoring a text is a
handful of vector operations per order.

*Decision.*  The language of the lowest cross-entropy per character.  The
score is the calibrated probability that the decision is right, a logistic
map of the lead over the runner-up, the length and the cross-entropy itself,
fitted on sample rows that the models had not seen.  Below ``REJECT_BELOW``
the decision is marked as rejected; the best language is still given.

Fitting uses at most about ``PER_LANGUAGE`` training documents of each
language (drawn by a hash of the id); every document is scored whole, in one
pass without a shuffle.

Defined cases: null text and text without a letter are ``und`` with score 0;
ties go to the language first by code point; without training rows every
document is ``und`` with score 0.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import crc_mod, ready
from slotwise.llm.quality import logistic_map
from slotwise.llm.sampling import draw

# Bound of the training sample, documents of each language.
PER_LANGUAGE = 1500
ORDER = 5
BITS = 12  # of a character's number; 0 is the start of a text, 1 space, the last any rare letter
RARE = (1 << BITS) - 1
REJECT_BELOW = 0.5
UNDETERMINED = "und"
# Characters scored together.
CHUNK = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """For every code point: itself if it is a letter, else space."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)


class Reader:
    """Texts to characters: letters and single spaces, as code points."""

    def __init__(self) -> None:
        self.letters = _letters()

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        points = self.letters[points]
        space = points == 32
        keep = ~space
        keep[1:] |= ~space[:-1]  # the first space of a run stays
        return points[keep]


def numbers(points: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Numbers of code points; ``alphabet`` maps every code point."""
    return alphabet[points]


def keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Packed last ``ORDER`` characters at every place of the joined texts;
    places before the start of a text count as 0."""
    ids = ids.astype(np.uint64)
    code = ids.copy()
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(ids)) - starts
    for back in range(1, ORDER):
        prev = np.zeros_like(ids)
        prev[back:] = ids[:-back]
        prev[place < back] = 0
        code |= prev << np.uint64(BITS * back)
    return code


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (BITS * n)) - 1)


class HashArray:
    """Rows of values in an array sorted by the hash of their 64-bit keys."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        h = key * _MIX
        order = np.argsort(h)
        self.h, self.value = h[order], np.ascontiguousarray(value[order])
        self.bits = max(1, int(len(h)).bit_length() + 1)
        first = self.h >> np.uint64(64 - self.bits)
        self.start = np.searchsorted(first, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.start).max()) if len(h) else 0
        self.h = np.append(self.h, np.uint64(0xFFFFFFFFFFFFFFFF))

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not there."""
        h = key * _MIX
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        live = np.flatnonzero(self.h[at] < h)
        for _ in range(self.steps):
            if not len(live):
                break
            at[live] += 1
            live = live[self.h[at[live]] < h[live]]
        found = self.h[at] == h
        found &= at < len(self.value)
        return np.where(found, at, -1)


@dataclass
class Models:
    """``gram[n]`` and ``context[n]``: log-probabilities and log backoff weights
    of order n (1 to ORDER) in every language."""

    languages: list[str]
    alphabet: dict[int, int]
    gram: list = field(default_factory=list)
    context: list = field(default_factory=list)
    floor: float = 0.0
    # Coefficients of the calibration.
    shift: np.ndarray | None = None

    def alphabet_table(self) -> np.ndarray:
        out = np.full(0x110000, RARE, np.uint16)
        out[32] = 1
        for point, number in self.alphabet.items():
            out[point] = number
        return out

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """Natural log-probability of each place in each language."""
        out = np.zeros((len(code), len(self.languages)), np.float32)
        live = np.arange(len(code))
        for n in range(ORDER, 0, -1):
            part = code[live] & _mask(n)
            row = self.gram[n].find(part)
            hit = row >= 0
            out[live[hit]] += self.gram[n].value[row[hit]]
            miss = ~hit
            live = live[miss]
            if not len(live):
                return out
            back = self.context[n].find(part[miss] >> np.uint64(BITS))
            known = back >= 0
            out[live[known]] += self.context[n].value[back[known]]
        out[live] += np.float32(self.floor)
        return out

    def cross_entropy(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per text and language, nats per character (texts must not be empty)."""
        logs = self.log_probabilities(keys(ids, lengths))
        return -np.add.reduceat(logs, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64) / lengths[:, None]


def train(counts: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: dict[int, int]) -> Models:
    """Models from each language's top-order keys and their counts."""
    languages = sorted(counts)
    models = Models(languages, alphabet, [None] * (ORDER + 1), [None] * (ORDER + 1))
    models.floor = float(-np.log(len(alphabet) + 2.0))
    # Counts by order: raw on top, below it the number of different characters before.
    by_order: list[dict] = [{} for _ in range(ORDER + 1)]
    for lang in languages:
        key, n = counts[lang]
        by_order[ORDER][lang] = (key, n.astype(np.float64))
        for k in range(ORDER - 1, 0, -1):
            key, n = np.unique(key & _mask(k), return_counts=True)
            by_order[k][lang] = (key, n.astype(np.float64))
    for n in range(1, ORDER + 1):
        every = np.unique(np.concatenate([by_order[n][x][0] for x in languages]))
        contexts = np.unique(every >> np.uint64(BITS))
        if n == 1:
            lower = np.full((len(every), len(languages)), np.exp(models.floor))
        else:
            lower = np.exp(models.gram[n - 1].value[models.gram[n - 1].find(every & _mask(n - 1))].astype(np.float64))
        prob, weight = np.empty(lower.shape), np.ones((len(contexts), len(languages)))
        at = np.searchsorted(contexts, every >> np.uint64(BITS))
        for j, lang in enumerate(languages):
            key, c = by_order[n][lang]
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            ctx = np.searchsorted(contexts, key >> np.uint64(BITS))
            total = np.bincount(ctx, c, len(contexts))
            kinds = np.bincount(ctx, minlength=len(contexts))
            seen = total > 0
            weight[seen, j] = d * kinds[seen] / total[seen]
            own = np.zeros(len(every))
            own[np.searchsorted(every, key)] = c - d
            prob[:, j] = own / np.maximum(total[at], 1e-12) + weight[at, j] * lower[:, j]
        models.gram[n] = HashArray(every, np.log(np.maximum(prob, 1e-30)).astype(np.float32))
        models.context[n] = HashArray(contexts, np.log(np.maximum(weight, 1e-30)).astype(np.float32))
    return models


def _evidence(entropy: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language and what the calibration looks at."""
    best = entropy.argmin(axis=1)
    ordered = np.sort(entropy, axis=1)
    lead = ordered[:, 1] - ordered[:, 0] if entropy.shape[1] > 1 else np.full(len(entropy), 1.0)
    # Nats by which the best language is ahead over the whole text, damped.
    return best, np.log1p(lead * np.sqrt(lengths) * 10) - np.maximum(ordered[:, 0] - 3.0, 0)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Models | None:
    """Learn from rows with a language whose crc32(doc_id) mod 4 is not 2."""
    spark = docs.sparkSession
    ready(spark)
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)
    ).select("doc_id", "lang", "text")
    chosen, weight = draw(known, "lang", per_language, seed=1)
    if not weight:
        return None
    chosen = chosen.withColumn("probe", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0).persist()

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for b in batches:
            points = np.concatenate([read(t.as_py()) for t in b.column("text")] or [np.zeros(0, np.uint32)])
            point, n = np.unique(points, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(point.astype(np.int64)), pa.array(n)], ["point", "n"])

    # At most as many rows as Unicode has letters.
    found = chosen.select("text").mapInArrow(letters, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    common = found.where("point <> 32").orderBy(F.desc("n"), "point").limit(RARE - 2).collect()
    alphabet = {r[0]: k for k, r in enumerate(common, 2)}
    table = Models([], alphabet).alphabet_table()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for b in batches:
            langs, probes = b.column("lang").to_pylist(), b.column("probe").to_pylist()
            by: dict = {}
            for t, lang, probe in zip(b.column("text"), langs, probes, strict=True):
                by.setdefault((lang, probe), []).append(numbers(read(t.as_py()), table))
            for (lang, probe), parts in by.items():
                lengths = np.array([len(x) for x in parts])
                key, n = np.unique(keys(np.concatenate(parts), lengths), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key), pa.string()), pa.array([probe] * len(key)),
                     pa.array(key.astype(np.int64)), pa.array(n)],
                    ["lang", "probe", "key", "n"],
                )

    rows = (
        chosen.mapInArrow(grams, "lang string, probe boolean, key long, n long")
        .groupBy("lang", "key")
        .agg(
            F.sum(F.when(F.col("probe"), F.col("n")).otherwise(0)).alias("probe_n"),
            F.sum(F.when(F.col("probe"), 0).otherwise(F.col("n"))).alias("rest_n"),
        )
        .toArrow()
    )
    lang, key = np.array(rows["lang"].to_pylist(), object), rows["key"].to_numpy().astype(np.uint64)
    probe_n, rest_n = rows["probe_n"].to_numpy(), rows["rest_n"].to_numpy()

    def select(n: np.ndarray) -> dict:
        out = {}
        for x in sorted(set(lang)):
            mine = (lang == x) & (n > 0)
            if mine.any():
                order = np.argsort(key[mine])
                out[x] = (key[mine][order], n[mine][order])
        return out

    models = train(select(probe_n + rest_n), alphabet)
    _calibrate(models, select(rest_n), chosen.where("probe"), spark)
    chosen.unpersist()
    return models


def _calibrate(models: Models, rest: dict, probes: DataFrame, spark) -> None:
    """Fit the calibration of ``models`` on rows kept from a second training."""
    models.shift = np.array([1.0, 0.0])
    if not rest:
        return
    held = spark.sparkContext.broadcast(train(rest, models.alphabet))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, read = held.value, Reader()
        table = m.alphabet_table()
        for b in batches:
            x, right = [], []
            for t, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                ids = numbers(read(t.as_py()), table)
                if len(ids):
                    size = np.array([len(ids)])
                    best, evidence = _evidence(m.cross_entropy(ids, size), size)
                    x.append(float(evidence[0]))
                    right.append(float(m.languages[best[0]] == lang))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(right, pa.float64())], ["x", "y"])

    got = probes.select("lang", "text").mapInArrow(run, "x double, y double").collect()
    got.sort()
    x, y = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    if len(y):
        # One imagined right and one wrong row at the mean keep the map finite.
        x, y = np.append(x, [x.mean(), x.min()]), np.append(y, [1.0, 0.0])
        models.shift = np.array(logistic_map(x, y, np.ones(len(y))))


OUT = "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double"


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, cross_entropy for every document."""
    models = fit(docs, per_language)
    held = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, read = held.value, Reader()
        table = m.alphabet_table() if m else None
        for b in batches:
            n = b.num_rows
            best, score, entropy = np.full(n, -1), np.zeros(n), np.full(n, np.nan)

            def flush(at: list, parts: list) -> None:
                if not at:
                    return
                lengths = np.array([len(x) for x in parts])
                h = m.cross_entropy(np.concatenate(parts), lengths)
                best[at], evidence = _evidence(h, lengths)
                score[at] = 1 / (1 + np.exp(-np.clip(m.shift[0] * evidence + m.shift[1], -30, 30)))
                entropy[at] = h.min(axis=1)

            at, parts, size = [], [], 0
            for i, t in enumerate(b.column("text") if m else ()):
                points = read(t.as_py() or "")
                if not (points != 32).any():
                    continue
                at.append(i)
                parts.append(numbers(points, table))
                size += len(points)
                if size >= CHUNK:
                    flush(at, parts)
                    at, parts, size = [], [], 0
            if m:
                flush(at, parts)
            names = [m.languages[k] if k >= 0 else UNDETERMINED for k in best] if m else [UNDETERMINED] * n
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(score < REJECT_BELOW),
                 pa.array(entropy, from_pandas=True)],
                ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"],
            )

    return (
        docs.select("doc_id", "text")
        .mapInArrow(run, OUT)
        .select(
            "doc_id",
            (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
            "lang_pred",
            "score",
            "rejected",
            "cross_entropy",
        )
    )
