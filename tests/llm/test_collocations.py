"""Phrase collocations against a plain version."""

import random

import brute
import pytest

from slotwise.llm import collocations


@pytest.fixture(scope="module")
def phrased():
    """(doc_id, text, source, lang): phrases that recur whole, overlap, nest, and stop at the ends of pieces."""
    rnd = random.Random(11)
    voc = ["a", "b", "C", "dé", "e-f", "x\x00y"]
    fixed = ["New York City", "new york city hall is open", "a a a a a a a", "once upon a time", "dé C dé C dé"]
    rows = []
    for i in range(120):
        parts = [rnd.choice(fixed + [" ".join(rnd.choices(voc, k=rnd.randint(0, 9)))]) for _ in range(rnd.randint(0, 8))]
        text = "".join(p + rnd.choice([" ", "\t ", ". ", ",", "\n", "!\r\n", " ? "]) for p in parts)
        rows.append((i, text, "s", rnd.choice(["en", "de", None, "und"])))
    rows += [(200, None, "s", "en"), (201, "", "s", None), (202, " .,;\n", "s", "xx"), (203, "one" * 1000, "s", "yy")]
    rows += [(204, "again and again, " * 2000, "s", "zz"), (0, rows[0][1], "s", "en")]
    return rows


def results(df):
    return sorted(tuple(r) for r in df.drop("cut").collect())


@pytest.mark.parametrize("kw", [{"min_count": 3}, {"min_count": 12, "block_bytes": 300}, {"min_count": 2, "longest": 3, "top": 4, "block_bytes": 1}])
def test_collocations(docs_of, phrased, kw):
    got = collocations.collocations(docs_of(phrased, extra=True), **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]
    plain = {k: v for k, v in kw.items() if k != "block_bytes"}
    assert results(got) == sorted(brute.collocations([(r[3], r[1]) for r in phrased], **plain))


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r pass 64 bits."""
    a, l, r, n = 3_000_000_007, 5_000_000_011, 4_000_000_009, 9_000_000_000_001
    phrases = spark.createDataFrame(
        [(2, "en", "p q", a, [l], [r], False), (3, "en", "p q r", 7, [l, 10], [10, r], False)],
        "words int, lang string, phrase string, a long, heads array<long>, tails array<long>, covered boolean",
    )
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    got = {x.phrase: (x.score, x.l, x.r, x.cut) for x in collocations.scored(phrases, totals).collect()}
    tie = (1000 * 7 * n // (l * 10), 1000 * 7 * n // (10 * r))
    k = 0 if tie[0] <= tie[1] else 1
    assert got == {"p q": (1000 * a * n // (l * r), l, r, 1), "p q r": (tie[k], [l, 10][k], [10, r][k], k + 1)}


def test_many_ranges_of_pairs(docs_of, phrased, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_WORDS", 900)
    got = collocations.collocations(docs_of(phrased), min_count=3, block_bytes=2000)
    assert results(got) == sorted(brute.collocations([(r[3], r[1]) for r in phrased], min_count=3))


def test_nothing_to_find(docs_of):
    for rows in ([], [(1, None)], [(1, "a b. c d")]):
        assert collocations.collocations(docs_of(rows)).collect() == []


def test_phrases_and_their_parts(docs_of):
    phrases, totals = collocations.frequent_phrases(docs_of([(1, "x y z. x y z. x y")]), min_count=2)
    got = {r.phrase: (r.words, r.a, r.heads, r.tails, r.covered) for r in phrases.collect()}
    assert got == {
        "x": (1, 3, [], [], True), "y": (1, 3, [], [], True), "z": (1, 2, [], [], True),
        "x y": (2, 3, [3], [3], False), "y z": (2, 2, [3], [2], True), "x y z": (3, 2, [3, 3], [2, 2], False),
    }
    assert [tuple(r) for r in totals.collect()] == [("en", 8)]
