"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

1. *Lexicon.*  Words and word stems (leading letters) whose document frequency
   among toxic training texts is significantly above that among clean ones
   (log-likelihood ratio and lift), counted by a Spark aggregation over a
   bounded sample of training rows.
2. *Features* of a whole text: density, variety and strength of lexicon hits,
   their nearness to words of the second person, capitals, punctuation,
   symbols, digits, obfuscated words and letter repeats.
3. *Trees*: boosted regression trees on the logistic loss over binned features.
4. *Calibration*: isotonic regression of labels on out-of-fold scores.

The lexicon that makes a training row's features is learned without that
row's fold, so hits are as telling in training as they are on new texts.
Scoring is one pass over the documents without a shuffle.

Fitting uses at most about ``PER_CLASS`` training rows of each class (drawn
by a hash of the id); every document is scored.

Defined cases: null text and empty text have all-zero features and get the
model's score for them; without training rows of both classes every score is
the share of toxic training rows (0 without any).  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import crc_mod, lean, ready, resident
from slotwise.llm.sampling import draw, labelled_texts

# Bound of the training sample, rows of each class.
PER_CLASS = 4000
FOLDS = 4
STEM_LETTERS = (4, 5, 6, 7)
# A lexicon entry is in this many toxic sample texts, this many times as
# frequent among toxic as among clean ones, with this log-likelihood ratio.
MIN_TOXIC_TEXTS, MIN_LIFT, MIN_LLR = 4, 6.0, 24.0
MAX_ENTRIES = 20_000
NEAR_CHARS = 60
TREES, DEPTH, SHRINKAGE, BINS = 120, 3, 0.1, 32

# Words of the second person in some languages.
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen ihr euch euer eure tu te toi ton ta tes "
    "vous votre vos tú ti tuyo tus usted ustedes vosotros vuestro os"
).split()

FEATURES = (
    "hits_per_100_words log_hits log_distinct_hits strongest near_second_person second_person_per_100_words "
    "closest upper_share shouted_share exclamation question punctuation symbols digits obfuscated repeats "
    "log_words word_length"
).split()

_UPPER = bytes(c for c in range(256) if chr(c).isupper())
_LOWER = bytes(c for c in range(256) if chr(c).islower())
_DIGITS, _POINTS, _SYMBOLS = b"0123456789", b".,;:'\"()-", b"@#$%&*|~^+=<>_/\\"
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
_OBFUSCATED = re.compile(r"[^\W\d_][\d@$*#!|+]+[^\W\d_]")


@dataclass
class Lexicon:
    """``entries``: (text, is a whole word, log lift)."""

    entries: list[tuple[str, bool, float]]

    def automaton(self):
        import ahocorasick

        found: dict[str, list] = {}
        for text, whole, lift in self.entries:
            found.setdefault(text, []).append((whole, lift))
        for word in SECOND_PERSON:
            found.setdefault(word, []).append((True, -1.0))
        out = ahocorasick.Automaton()
        for text, kinds in found.items():
            out.add_word(text, (len(text), kinds))
        out.make_automaton()
        return out


def features(text: str | None, automaton) -> list[float]:
    """The dense features of one whole text, in the order of ``FEATURES``."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    hits: dict[int, float] = {}  # start of a word -> strongest entry
    names: set[str] = set()
    persons: list[int] = []
    n = len(low)
    for end, (length, kinds) in automaton.iter(low):
        start = end + 1 - length
        if start and low[start - 1].isalpha():
            continue
        closed = end + 1 == n or not low[end + 1].isalpha()
        for whole, lift in kinds:
            if whole and not closed:
                continue
            if lift < 0:
                persons.append(start)
            else:
                hits[start] = max(lift, hits.get(start, 0.0))
                names.add(low[start : end + 1])
    words = max(1, len(text.split()))
    near, closest = 0, 0.0
    if hits and persons:
        p = np.array(persons)
        gaps = np.abs(np.fromiter(hits, np.int64, len(hits))[:, None] - p[None, :]).min(axis=1) if len(hits) * len(
            persons
        ) < 10_000 else _nearest(np.sort(np.fromiter(hits, np.int64, len(hits))), np.sort(p))
        near, closest = int((gaps <= NEAR_CHARS).sum()), 1.0 / (1.0 + gaps.min() / 10.0)
    data = text.encode("latin-1", "replace")
    size = len(data)
    upper, lower = size - len(data.translate(None, _UPPER)), size - len(data.translate(None, _LOWER))
    letters = max(1, upper + lower)
    raw = np.frombuffer(data, np.uint8)
    repeats = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] > 64)).sum()) if size > 2 else 0
    per = 100.0 / size
    return [
        100.0 * len(hits) / words,
        float(np.log1p(len(hits))),
        float(np.log1p(len(names))),
        max(hits.values(), default=0.0),
        near / max(1, len(hits)),
        100.0 * len(persons) / words,
        closest,
        upper / letters,
        len(_SHOUTED.findall(text)) / words,
        per * text.count("!"),
        per * text.count("?"),
        per * (size - len(data.translate(None, _POINTS))),
        per * (size - len(data.translate(None, _SYMBOLS))),
        per * (size - len(data.translate(None, _DIGITS))),
        100.0 * len(_OBFUSCATED.findall(text)) / words,
        per * repeats,
        float(np.log1p(words)),
        letters / words,
    ]


def _nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each of sorted ``a`` to the nearest of sorted ``b``."""
    at = np.searchsorted(b, a)
    left, right = b[np.maximum(at - 1, 0)], b[np.minimum(at, len(b) - 1)]
    return np.minimum(np.abs(a - left), np.abs(a - right))


# --- lexicon -------------------------------------------------------------


def _term_counts(sample: DataFrame) -> DataFrame:
    """Of each term, its numbers of texts by fold and class; terms of too few toxic texts are left out."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    stems = [
        F.transform(F.filter(words, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.substring(w, 1, k))
        for k in STEM_LETTERS
    ]
    terms = F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(w, F.lit("$"))), *stems))
    each = sample.select("fold", "toxic", F.explode(terms).alias("term"))
    cells = [
        F.count(F.when((F.col("fold") == k) & (F.col("toxic") == y), 1)).alias(f"n{k}_{y}")
        for k in range(FOLDS)
        for y in (0, 1)
    ]
    toxic = sum((F.col(f"n{k}_1") for k in range(FOLDS)), F.lit(0))
    clean = sum((F.col(f"n{k}_0") for k in range(FOLDS)), F.lit(0))
    # No entry can have more clean than toxic texts unless the classes differ in size by the lift.
    return each.groupBy("term").agg(*cells).where((toxic >= MIN_TOXIC_TEXTS) & (clean <= toxic))


def _lexicon(counts: list, sizes: np.ndarray, without: int | None) -> Lexicon:
    """Entries of the folds but ``without``; sizes: rows by fold and class."""
    folds = [k for k in range(FOLDS) if k != without]
    n0, n1 = sizes[folds, 0].sum(), sizes[folds, 1].sum()
    if not n0 or not n1 or not counts:
        return Lexicon([])
    table = np.array([[r[1 + 2 * k + y] for y in (0, 1)] for r in counts for k in folds], float)
    b, a = table.reshape(len(counts), len(folds), 2).sum(axis=1).T
    lift = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    share = (a + b) / (n0 + n1)

    def part(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))

    llr = 2 * (
        part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share))
    )
    good = np.flatnonzero((a >= MIN_TOXIC_TEXTS) & (lift >= MIN_LIFT) & (llr >= MIN_LLR))
    good = good[np.argsort(-llr[good], kind="stable")][:MAX_ENTRIES]
    return Lexicon(
        [(counts[i][0].rstrip("$"), counts[i][0].endswith("$"), float(np.log(lift[i]))) for i in good]
    )


# --- trees ---------------------------------------------------------------


@dataclass
class Trees:
    """Boosted trees as arrays: for each tree, feature and cut of the inner
    nodes in heap order, then the values of its leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting on the logistic loss over quantile bins."""
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], axis=1)
    base = float(np.log((w @ y + 0.5) / (w @ (1 - y) + 0.5)))
    margin = np.full(n, base)
    inner = 2**DEPTH - 1
    all_f, all_c, all_l = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            gains = np.full(width, 1e-6)
            total_g = np.bincount(node - first, g, width)
            total_h = np.bincount(node - first, h, width)
            for j in range(f):
                if not len(cuts[j]):
                    continue
                bins = len(cuts[j]) + 1
                at = (node - first) * bins + binned[:, j]
                lg = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1]
                lh = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1]
                rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
                gain = lg**2 / (lh + l2) + rg**2 / (rh + l2) - (total_g**2 / (total_h + l2))[:, None]
                gain[(lh < least) | (rh < least)] = -1.0
                best = gain.argmax(axis=1)
                value = gain[np.arange(width), best]
                better = np.flatnonzero(value > gains)
                gains[better] = value[better]
                feature[first + better], cut[first + better] = j, cuts[j][best[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        leaf = -SHRINKAGE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        margin += leaf[at]
        all_f.append(feature), all_c.append(cut), all_l.append(leaf)
    return Trees(base, np.array(all_f), np.array(all_c), np.array(all_l))


# --- calibration ---------------------------------------------------------


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from score to probability."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # first score, last score, weighted positives, weight
    for i in order:
        blocks.append([score[i], score[i], w[i] * y[i], w[i]])
        while len(blocks) > 1 and (
            blocks[-2][1] == blocks[-1][0] or blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]
        ):
            _, last, pos, weight = blocks.pop()
            blocks[-1][1] = last
            blocks[-1][2] += pos
            blocks[-1][3] += weight
    xs = np.array([v for b in blocks for v in (b[0], b[1])])
    ys = np.array([v for b in blocks for v in [(b[2]) / b[3]] * 2])
    return xs, ys


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.interp(self.trees.margin(x), *self.knots)


def _automaton(entries: tuple) -> object:
    """The automaton of a lexicon, kept by the worker process."""
    return resident(("toxicity", entries), Lexicon(list(entries)).automaton)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from the training rows: labelled, and crc32(doc_id) mod 5 is not 0."""
    spark = docs.sparkSession
    ready(spark)
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
        .dropDuplicates(["doc_id"])
    )
    chosen, weight = draw(known, "toxic", per_class, seed=9)
    prior = weight.get(1, 0.0)
    if set(weight) != {0, 1}:
        return Model(Lexicon([]), None, (np.zeros(1), np.zeros(1)), 1.0 if prior else 0.0)
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(10)), F.lit(FOLDS)).cast("int")
    sample = labelled_texts(docs, chosen.withColumn("fold", fold)).persist()
    sizes = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", "toxic").count().collect():
        sizes[r[0], r[1]] = r[2]
    counts = [tuple(r) for r in _term_counts(sample).orderBy("term").collect()]
    lexicons = [_lexicon(counts, sizes, k) for k in range(FOLDS)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [x.automaton() for x in lexicons]
        for b in batches:
            folds = b.column("fold").to_pylist()
            x = [features(t.as_py(), machines[k]) for t, k in zip(b.column("text"), folds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("fold"), b.column("toxic"), pa.array(x, pa.list_(pa.float64()))],
                ["doc_id", "fold", "toxic", "x"],
            )

    rows = sample.mapInArrow(run, "doc_id long, fold int, toxic int, x array<double>").collect()
    sample.unpersist()
    rows.sort(key=lambda r: r[0])
    x = np.array([r[3] for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r[2] for r in rows], float)
    folds = np.array([r[1] for r in rows])
    if len(set(y)) < 2:
        return Model(Lexicon([]), None, (np.zeros(1), np.zeros(1)), float(y.mean()) if len(y) else 0.0)
    w = np.array([weight[int(v)] for v in y])
    w /= w.mean()
    trees = boost(x, y, w)
    out = np.zeros(len(y))
    for k in range(FOLDS):
        a, b = folds != k, folds == k
        if b.any():
            out[b] = boost(x[a], y[a], w[a]).margin(x[b]) if len(set(y[a])) == 2 else trees.margin(x[b])
    return Model(_lexicon(counts, sizes, None), trees, isotonic(out, y, w), float(w @ y / w.sum()))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every document, in one pass."""
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: MAX_ENTRIES, TREES

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        machine = _automaton(tuple(m.lexicon.entries))
        for b in batches:
            x = np.array([features(t.as_py(), machine) for t in b.column("text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m.score(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score_documents(docs, fit(docs, labels)).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns.

    They are filtered while they are scored, so no text is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # bounded as above

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        machine = _automaton(tuple(m.lexicon.entries))
        for b in batches:
            x = np.array([features(t.as_py(), machine) for t in b.column("text")]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(m.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
