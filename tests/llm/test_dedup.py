"""Exact, substring, suffix-array and n-gram deduplication against plain versions."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from slotwise.llm import exact_dedup, jaccard_join, substring_dedup, suffix_dedup
from slotwise.llm.components import components


def rows_by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs_of, repeats, weak):
    # A weak hash puts different texts into one hash group: the bytes keep them apart.
    kw = {"hash128": lambda c: F.unhex(F.lpad((F.length(c) % 2).cast("string"), 32, "0"))} if weak else {}
    got = exact_dedup.exact_groups(docs_of(repeats, extra=True), **kw)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows_by_id(got) == brute.exact(repeats)


def test_exact_dedup_keeps_one_row_with_all_columns(docs_of, repeats):
    docs = docs_of(repeats, extra=True)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, v in brute.exact(repeats).items() if v[2]}
    assert exact_dedup.drop_exact_copies(docs_of([])).count() == 0


def test_exact_dedup_null_and_repeated_ids(docs_of):
    got = exact_dedup.exact_groups(docs_of([(None, "a"), (None, "A"), (1, "b"), (1, "b")])).collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in sorted(got, key=lambda r: (r.doc_id or 0))] == [
        (None, None, 2, True), (None, None, 2, True), (1, 1, 2, True), (1, 1, 2, True)
    ]


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 2000, "range_bytes": 1000}, {"window": 8, "block_bytes": 3000}])
def test_substrings(docs_of, repeats, kw):
    got = rows_by_id(substring_dedup.remove_repeats(docs_of(repeats, extra=True), **kw))
    assert got == brute.substrings(repeats, kw.get("window", 20))


def test_substrings_by_three_levels(docs_of, repeats):
    got = rows_by_id(substring_dedup.remove_repeats(docs_of(repeats), levels=2, block_bytes=3000, range_bytes=4000))
    assert got == brute.substrings(repeats)


def test_substrings_texts_empty_table_and_null_id(docs_of):
    assert substring_dedup.remove_repeats(docs_of([])).collect() == []
    text = " ".join(map(str, range(30)))
    got = {r.doc_id: r.text for r in substring_dedup.cleaned_texts(docs_of([(1, text), (None, "x " + text)])).collect()}
    assert got == {1: text, None: "x"}  # a null id comes after every other


@pytest.mark.parametrize(
    "kw",
    [{}, {"block_bytes": 2000, "range_bytes": 1000}, {"window": 40, "block_bytes": 2000},
     {"block_bytes": 2000, "range_bytes": 1000, "very_many": 1}],
)
def test_suffixes(docs_of, repeats, kw):
    got = rows_by_id(suffix_dedup.remove_repeats(docs_of(repeats, extra=True), **kw))
    assert got == brute.suffixes(repeats, kw.get("window", 100))


def test_suffixes_empty_table_and_bytes(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([])).collect() == []
    text = "".join(map(str, range(80)))
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.cleaned_texts(docs_of([(1, text), (2, "é" + text + "!")])).collect()}
    assert got == {1: text.encode(), 2: "é!".encode()}


def test_cover_sorting_alone():
    import numpy as np

    rnd = random.Random(3)
    data = bytes(rnd.choice(b"ab") for _ in range(600)) * 2 + b"a" * 300
    starts = np.arange(len(data) - 60 + 1)
    seen, want = set(), []
    for s in starts.tolist():
        want.append(int(data[s : s + 60] in seen))
        seen.add(data[s : s + 60])
    for bound in (50, 1 << 18):
        assert suffix_dedup.repeated_windows(data, starts, 60, bound).tolist() == want


def test_only_windows_that_may_repeat_are_sorted(monkeypatch):
    """Contexts of one bucket: the text around windows that occur once isn't sorted."""
    import numpy as np
    import pandas as pd

    rnd = random.Random(4)
    common = rnd.randbytes(130)
    # The bytes next to the common ones differ in all of them.
    texts = [rnd.randbytes(59) + bytes([k]) + common + bytes([k]) + rnd.randbytes(49) for k in range(20)]
    windows = [len(t) - 99 for t in texts]
    rows = pd.DataFrame(
        {"block": [0, 1], "buckets": [np.full(10, 7, np.uint64).tobytes()] * 2,
         "ids": [np.arange(10).tobytes(), np.arange(10, 20).tobytes()],
         "sizes": [np.array(windows[:10]).tobytes(), np.array(windows[10:]).tobytes()],
         "bytes": [b"".join(texts[:10]), b"".join(texts[10:])]}
    )
    sorted_, real = [], suffix_dedup.repeated_windows

    def repeated_windows(data, starts, *args):
        sorted_.append((len(data), len(starts)))
        return real(data, starts, *args)

    monkeypatch.setattr(suffix_dedup, "repeated_windows", repeated_windows)
    later = np.concatenate([x for _, x in suffix_dedup._resolve_contexts(rows, 100)])
    seen, want = set(), []
    for t in texts:
        for i in range(len(t) - 99):
            want.append(int(t[i : i + 100] in seen))
            seen.add(t[i : i + 100])
    assert later.tolist() == want
    assert sorted_ == [(20 * 130, 20 * 31)]  # before: all 20 * 240 bytes and 20 * 141 windows


def test_every_difference_is_in_the_cover():
    pairs = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert pairs == set(range(suffix_dedup.PERIOD))


@pytest.fixture(scope="module")
def near(repeats):
    """Random edits of random texts of many lengths, besides the other repeats."""
    rnd = random.Random(5)
    voc = [f"w{i}" for i in range(2000)]
    rows, k = list(repeats), 1000
    for _ in range(60):
        base = [rnd.choice(voc) for _ in range(rnd.choice([1, 3, 5, 6, 7, 8, 10, 12, 17, 25, 40, 60, 100, 300]))]
        for _ in range(rnd.choice([1, 2, 3, 6])):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, max(1, len(base) // 30)])):
                i = rnd.randrange(len(words))
                words[i : i + rnd.randint(0, 1)] = [rnd.choice(voc)]
            if rnd.random() < 0.3:
                base = words
            rows.append((k, " ".join(words)))
            k += 1
    return rows


def test_jaccard(docs_of, near):
    got = rows_by_id(jaccard_join.near_duplicates(docs_of(near, extra=True)))
    assert got == brute.jaccard(near)


def test_jaccard_many_batches_ranges_and_chunks(docs_of, near, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_CHUNK", 3)
    got = rows_by_id(jaccard_join.near_duplicates(docs_of(near, parts=5), batch_bytes=3000, range_bytes=9000))
    assert got == brute.jaccard(near)


def test_jaccard_chain_of_links(docs_of):
    """Neighbours link, ends do not: one component, found across several lists."""
    voc = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(voc[2 * i : 2 * i + 60])) for i in range(20)]
    want = brute.jaccard(rows)
    assert len({c for _, c in want.values()}) == 1
    assert rows_by_id(jaccard_join.near_duplicates(docs_of(rows))) == want


@pytest.mark.parametrize("chunk, shingles", [(1024, 1 << 18), (16, 1 << 18), (64, 5000)])
def test_jaccard_links_where_members_of_a_list_meet(docs_of, spark, near, monkeypatch, chunk, shingles):
    """One list of all sets, in chunks by number or by size: links enough to join each component, and no more a row."""
    from slotwise.llm.common import ready

    ready(spark)
    monkeypatch.setattr(jaccard_join, "LIST_CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", shingles)
    sets = jaccard_join.Sets([(t or "").encode() for _, t in near], 5)
    ids, want = sets.ids().tolist(), brute.jaccard(near)
    of = {ids[k]: k for k in range(len(near)) if sets.sizes[k]}
    info = [(i, int(sets.sizes[k]), bytearray(sets.sketch(k)), bytearray(sets.of(k).tobytes())) for i, k in of.items()]
    info = spark.createDataFrame(info, "id long, n_shingles long, wide binary, shingles binary")
    members = [(bytearray(b"x"), i, int(sets.sizes[k])) for i, k in of.items()]
    members = spark.createDataFrame(members, "list binary, member long, n long")
    # Some components are known in part.
    first = {}
    for i, k in of.items():
        first.setdefault(want[near[k][0]][1], []).append(i)
    known = [(i, min(c[: len(c) // 2])) for c in first.values() for i in c[: len(c) // 2]]
    labels = spark.createDataFrame(known, "node long, label long")
    sets_of = info.select("id", "shingles")
    got = jaccard_join.links_across(members, labels, info, sets_of, 80).collect()
    assert all(want[near[of[r.a]][0]][1] == want[near[of[r.b]][0]][1] for r in got)
    every = spark.createDataFrame([*known, *((r.a, r.b) for r in got)], "a long, b long")
    label = {r.node: r.label for r in components(every).collect()}
    for c in first.values():
        assert len({label.get(i, i) for i in c}) == 1
    assert got and (chunk < 1024 or len(got) < len(of))


def test_jaccard_group_with_sets_just_beyond_it_never_becomes_its_pairs(docs_of, monkeypatch):
    """80 near copies of one text and 40 texts that just fail to link with any of them."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(200)]

    def changed(k, places):
        words = list(base)
        for p in places:
            words[p] = f"x{k}-{p}"
        return k, " ".join(words)

    rows = [changed(k, [rnd.randrange(5, 60)]) for k in range(80)]
    rows += [changed(100 + k, [70 + 30 * j + rnd.randrange(20) for j in range(4)]) for k in range(40)]
    written, real = {}, jaccard_join.cut

    def cut(df, name):
        out = real(df, name)
        if {"a", "b"} <= set(out.columns):
            written[name] = max(written.get(name, 0), out.where("a IS NOT NULL").count())  # pairs
        return out

    monkeypatch.setattr(jaccard_join, "cut", cut)
    got = rows_by_id(jaccard_join.near_duplicates(docs_of(rows)))
    assert got == brute.jaccard(rows)
    assert max(written.values()) <= 5 * len(rows), written  # before: 1,000 pairs or more to compare


def test_jaccard_empty_table_and_one_of_each(docs_of, repeats):
    assert jaccard_join.near_duplicates(docs_of([])).collect() == []
    docs = docs_of(repeats, extra=True)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute.jaccard(repeats).items() if d == c}


@pytest.mark.parametrize("kind", ["one", "copies", "unlike", "clean", "blank", "lists in some ranges"])
def test_jaccard_where_ranges_have_no_lists(docs_of, kind):
    rnd = random.Random(8)

    def text(n=40):
        return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))

    copy = text()
    rows = {
        "one": [(1, copy)],
        "copies": [(1, copy), (2, copy), (7, copy.upper())],
        "unlike": [(1, text()), (2, text())],
        "clean": [(i, text()) for i in range(50)],
        "blank": [(1, None), (2, ""), (3, " \t")],
        "lists in some ranges": [(i, text()) for i in range(30)] + [(90, copy), (91, copy + " more")],
    }[kind]
    got = rows_by_id(jaccard_join.near_duplicates(docs_of(rows), range_bytes=500))
    assert got == brute.jaccard(rows)


def test_jaccard_sends_size_and_sketch_of_a_set_once(docs_of):
    """Beside its keys, a set has 8 bytes in each hash range, however many ranges there are."""
    from slotwise.session import ensure_checkpoint_dir

    rnd = random.Random(9)
    docs = docs_of([(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(300))) for i in range(60)], parts=1)
    ensure_checkpoint_dir(docs.sparkSession)

    def sent(parts):
        rows = jaccard_join.questions(docs, 5, 80, parts, 1 << 20).collect()
        size = {c: sum(len(r[c]) for r in rows) for c in rows[0].asDict() if c != "part"}
        assert size["sizes"] == size["own"] == 8 * 60
        assert size["sketches"] == 60 * 512 // 8
        return sum(size.values())

    # Before: 56 bytes.
    assert sent(40) - sent(4) <= 36 * 60 * 8


def test_jaccard_sets_that_share_a_phrase_are_no_candidates(docs_of, monkeypatch):
    """Long texts that agree on a key by chance: their sketches rule them out before shingles are written."""
    rnd = random.Random(10)

    def words(n):
        return [f"w{rnd.randrange(10**6)}" for _ in range(n)]

    phrase, base = words(5), words(1500)
    rows = [(i, " ".join(words(700) + phrase + words(700))) for i in range(60)]
    rows += [(90, " ".join(base)), (91, " ".join(base + words(5)))]
    seen, real = [], jaccard_join.describe

    def describe(docs, candidates, *args):
        out = real(docs, candidates, *args)
        seen.append(({r.id for r in candidates.collect()}, {r.id for r in out.where("doc_id >= 90").collect()}))
        return out

    monkeypatch.setattr(jaccard_join, "describe", describe)
    got = rows_by_id(jaccard_join.near_duplicates(docs_of(rows)))
    assert got == brute.jaccard(rows)
    assert seen[0][0] == seen[0][1]


def test_signatures_never_miss_a_linked_pair():
    """Random pairs at the threshold share a key in every band."""
    import numpy as np

    rnd = np.random.default_rng(1)
    for size in [*range(1, 60), 90, 150, 300, 800, 2000]:
        for _ in range(6):
            a = rnd.integers(1, 1 << 62, size).astype(np.uint64)
            k = int(rnd.integers(0, size // 9 + 1))
            b = np.concatenate([a[k:], rnd.integers(1, 1 << 62, int(rnd.integers(0, size // 9 + 1))).astype(np.uint64)])
            if not jaccard_join.linked(np.sort(a), np.sort(b), 80):
                continue
            sets = object.__new__(jaccard_join.Sets)
            sets.h = np.concatenate([np.sort(a), np.sort(b)])
            sets.sizes = np.array([len(a), len(b)])
            sets.ends = np.cumsum(sets.sizes)
            key, owner = sets.keys(80, np.array([0, 1]))
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist()), (len(a), len(b))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 5: 5} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_exact_dedup_keeps_one_row_of_a_text_whatever_its_ids(docs_of):
    rows = [(1, "a"), (1, "A"), (1, "b"), (2, "b"), (None, "c"), (3, "c"), (None, "d"), (None, "D"), (4, None), (5, "")]
    for keep, want in (("max", [(1, "a"), (2, "b"), (3, "c"), (None, "d"), (5, "")]),
                       ("min", [(1, "a"), (1, "b"), (3, "c"), (None, "d"), (4, "")])):
        docs = docs_of(rows, extra=True).withColumn("a.b`c", F.lit(1))
        got = exact_dedup.drop_exact_copies(docs, keep=keep)
        assert got.columns == docs.columns
        kept = sorted((r.doc_id or 0, (r.text or "").lower()) for r in got.collect())
        assert kept == sorted((d or 0, t) for d, t in want)
    text = "x" * 3_000_000
    assert exact_dedup.drop_exact_copies(docs_of([(1, text), (2, text.upper()), (3, text + "y")])).count() == 2
