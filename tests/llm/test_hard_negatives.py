"""Hard-negative mining against a plain version."""

import random

import brute
import pytest

from slotwise.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    """Few labels, many copies and ties, zero vectors, opposite vectors, one large label."""
    rnd = random.Random(3)
    some = [[rnd.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(4)] for _ in range(12)]
    rows = [(i, rnd.choice(some) if i % 3 else [rnd.uniform(-1, 1) for _ in range(4)], rnd.choice([1, 1, 1, 2, 9])) for i in range(260)]
    rows += [(300 + i, [0.0] * 4, 1 + i % 2) for i in range(30)]
    rows += [(-10, [1.0, 0.0, 0.0, 0.0], 3), (-20, [-1.0, 0.0, 0.0, 0.0], 3), (400, [0.001] * 4, 4)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("vec", "grid", "anchor", "wanted", "score", "n", "row", "key"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(3) if rows else df


def plain(spark, rows, **kw):
    kept = [(r.vec_id, r.label, r.embedding) for r in spark.createDataFrame(rows, SCHEMA).collect()]  # as floats
    return sorted(brute.hard_negatives(kept, lambda i: i % 10 == 0, **kw))


def mined(df, **kw):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, lambda i: i % 10 == 0, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"block_rows": 7}, {"positives": 2, "negatives": 3}])
def test_hard_negatives(spark, vectors, kw):
    want = plain(spark, vectors, **{k: v for k, v in kw.items() if k != "block_rows"})
    assert len(want) > 100 and any(r[4] == 0 for r in want)
    assert mined(frame(spark, vectors), **kw) == want


def test_rows_that_take_no_part(spark, vectors):
    bad = [(None, [1.0] * 4, 1), (1000, None, 1), (1001, [1.0] * 4, None), (1002, [1.0, None, 1.0, 1.0], 1), (1010, [], 1),
           (1003, [1.0, float("nan"), 1.0, 1.0], 1), (1004, [float("inf")] * 4, 1), (1005, [1.0] * 3, 1), (1006, [3e7] * 4, 1)]
    want = plain(spark, vectors)
    assert mined(frame(spark, vectors + bad + vectors[:40])) == want  # repeated rows count once
    worse = [(i, [9.0] * 4, 99) for i, _, _ in vectors[:40]]  # of a repeated id the least label counts
    assert mined(frame(spark, vectors + worse)) == want


def test_few_rows(spark):
    for rows in ([], [(10, [1.0], 1)], [(10, [1.0], 1), (20, [1.0], 1)], [(10, [1.0], 1), (20, [0.5], 2)], [(10, [], 1), (20, [], 1), (30, [], 2)]):
        assert mined(frame(spark, rows)) == plain(spark, rows)


def test_large_components_are_exact(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-4e5, 4e5) for _ in range(64)], i % 2) for i in range(40)]
    assert any(abs(r[4]) > 1 << 53 for r in plain(spark, rows))
    assert mined(frame(spark, rows)) == plain(spark, rows)


def test_packed_keys_sort_as_their_parts(spark):
    rnd = random.Random(5)
    parts = [(rnd.choice([-3, 0, 7]), rnd.choice([-(1 << 62), -1, 0, 1, 1 << 62]), rnd.choice([-5, 0, 5])) for _ in range(200)]
    df = spark.createDataFrame(parts, "a long, s long, i long")
    keyed = df.select("*", hard_negatives.packed_key(*map(df.__getitem__, "asi")).alias("key")).toArrow()
    assert hard_negatives.unpacked(keyed["key"]).tolist() == [list(p) for p in zip(*(keyed[c].to_pylist() for c in "asi"), strict=True)]
    ordered = sorted(zip(keyed["key"].to_pylist(), parts, strict=True))
    assert [p for _, p in ordered] == sorted(parts, key=lambda p: (p[0], -p[1], p[2]))
