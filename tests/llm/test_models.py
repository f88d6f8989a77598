"""Classifiers: held-out accuracy and defined cases.  Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import hash_forest, language_id, quality, toxicity
from slotwise.llm.common import table

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and len(held) > 150
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_defined_cases(docs_of):
    train = [(i, t * 3, "s", lang) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de")] * 12)]
    odd = [(100, None, "s", "en"), (101, "", "s", None), (102, "12 !?", "s", "de"), (103, "die katze", "s", None), (104, "a", "s", "en")]
    rows = {r.doc_id: r for r in language_id.identify(docs_of(train + odd, extra=True)).collect()}
    assert [rows[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and rows[100].score == 0
    assert rows[103].lang_pred == "de" and rows[104].lang_pred in ("de", "en")
    assert language_id.identify(docs_of([])).collect() == []
    unlabelled = language_id.identify(docs_of([(1, "abc", "s", None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_language_probabilities_sum_to_one():
    """Over the alphabet, the model of every context is a distribution."""
    rnd = np.random.default_rng(0)
    ids = rnd.choice([1, 2, 3, 4], 400, p=[0.2, 0.5, 0.2, 0.1])
    key, n = np.unique(language_id.keys(ids, np.array([150, 250])), return_counts=True)
    models = language_id.train({"xx": (key, n)}, {97: 2, 98: 3, 99: 4})
    # 1 to 4 are seen; the rest of the floor's mass is one rare letter.
    for context in ([1, 2, 2, 3], [3, 3, 4, 4], [4, 4, 4, 4]):
        code = [sum(c << (12 * (4 - k)) for k, c in enumerate([*context, x])) for x in (1, 2, 3, 4, language_id.RARE)]
        p = np.exp(models.log_probabilities(np.array(code, np.uint64))).sum()
        assert abs(p - 1) < 1e-3


@pytest.mark.parametrize(("fn", "label"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_held_out(spark, fn, label):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = fn(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert auc(held[label].to_numpy(), held.score.to_numpy()) > 0.9
    assert (held.predicted == held[label]).mean() > 0.9
    assert fn(docs, labels).count() == 1000


@pytest.mark.parametrize("fn", [quality.quality, toxicity.toxicity])
def test_classifiers_defined_cases(spark, docs_of, fn):
    rows = [(i, f"you are trash {i}" if i % 2 else f"plain words {i}") for i in range(40)]
    docs = docs_of(rows + [(100, None), (101, ""), (102, "x" * 5000)], extra=True)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    got = fn(docs, labels).collect()
    assert len(got) == 43 and all(0 <= r.score <= 1 for r in got)
    none = labels.where("false")
    assert {r.score for r in fn(docs, none).collect()} == {0.0}
    assert {r.score for r in fn(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert fn(docs_of([]), labels).collect() == []


def test_without_toxic_keeps_columns(spark, docs_of):
    rows = [(i, f"you stupid trash {i}" if i % 2 else f"plain words {i}") for i in range(60)]
    docs = docs_of(rows, extra=True)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id % 2 for r in kept.collect()} == {0}


def test_isotonic_is_monotone_and_calibrated():
    rnd = np.random.default_rng(1)
    s = rnd.normal(size=500)
    y = (rnd.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float)
    xs, ys = toxicity.isotonic(s, y, np.ones(500))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()
    assert abs(np.interp(s, xs, ys).mean() - y.mean()) < 1e-9


def test_dual_descent_satisfies_the_optimality_conditions():
    rnd = np.random.default_rng(2)
    rows = [np.unique(rnd.integers(0, 40, 8)).astype(np.uint32) for _ in range(80)]
    y = np.array([float((r < 15).sum() > 3) for r in rows])
    model = quality.dual_descent(rows, y, np.ones(len(y)))
    margin = np.array([model.margin(r) for r in rows])
    assert ((margin > 0) == (y == 1)).mean() > 0.9


def brute_nearest(vectors, top=20):
    good = {i: np.array(v, float) for i, v in vectors if i is not None and v is not None and None not in v}
    good = {i: v for i, v in good.items() if np.isfinite(v).all() and v.any()}
    out = {}
    for q in good:
        if q % 20 == 0:
            scores = sorted(((-float(np.dot(good[q], v)), i) for i, v in good.items() if i != q))[:top]
            out[q] = [(i, -s) for s, i in scores]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def forest(spark, vectors, **kw):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    return by_query(hash_forest.nearest(df, lambda c: c % 20 == 0, **kw))


def test_forest_small_ties_and_odd_vectors(spark):
    rnd = np.random.default_rng(4)
    vectors = [(i, rnd.integers(-3, 4, 6).astype(float).tolist()) for i in range(50)]
    vectors += [(100 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(45)]  # more copies than an answer holds
    vectors += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] + [1.0] * 5),
                (280, [float("inf")] + [1.0] * 5), (300, [1.0, 2.0]), (None, [1.0] * 6)]
    want = brute_nearest([v for v in vectors if v[0] != 300])
    got = forest(spark, vectors, recall=1.0)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_forest_few_candidates_and_empty(spark):
    assert forest(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]) == {0: [(1, 1.0)]}
    assert forest(spark, [(0, [1.0, 0.0])]) == {}
    assert forest(spark, []) == {}


def test_forest_recall_over_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "BLOCK", 300)
    rnd = np.random.default_rng(6)
    centers = rnd.normal(size=(12, 24))
    x = centers[rnd.integers(0, 12, 4000)] + 0.5 * rnd.normal(size=(4000, 24))
    x[:1500] = centers[0] + 0.2 * rnd.normal(size=(1500, 24))  # one cluster holds a third of all rows
    vectors = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    want, got = brute_nearest(vectors), forest(spark, vectors)
    assert set(got) == set(want) and all(len(r) == 20 for r in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
