"""Line deduplication against a plain version."""

import random

import brute
import pytest

from slotwise.llm import line_dedup


@pytest.fixture(scope="module")
def lined():
    """Lines shared by two, three and many documents, repeated inside one, blank, short, long, with odd blanks."""
    rnd = random.Random(7)
    common = [f"this line number {i} is shared by some documents" for i in range(12)]
    common += ["  \tÄpfel und Birnen, zwanzig Zeichen\x0b ", "ééééééééééééééééééé", "éééééééééééééééééééé", "short line"]
    rows = []
    for i in range(60):
        own = [f"own line {i} of some length, part {j}" for j in range(rnd.randint(0, 4))]
        mine = own + [rnd.choice(common[: 4 + i // 4]) for _ in range(rnd.randint(0, 6))]
        mine = [x.swapcase() if x.isascii() and rnd.random() < 0.3 else x for x in mine]
        rnd.shuffle(mine)
        rows.append((i, "\n".join(mine)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "licence line of every document\r\n" * 400)]
    rows += [(200 + i, "licence line of every document\n" + rnd.choice(common)) for i in range(150)]
    rows += [(400, "x" * 200_000 + "\n" + "licence line of every document"), (401, "x" * 200_000)]
    return rows


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_lines(docs_of, lined, ranges):
    docs = docs_of(lined, extra=True)
    got = line_dedup.digests(line_dedup.cleaned_texts(docs, ranges=ranges))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert results(got) == sorted(brute.lines(lined), key=repr)


def test_lines_in_tiny_batches(spark, docs_of, lined):
    """Runs of a hash that go over many Arrow batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = results(line_dedup.digests(line_dedup.cleaned_texts(docs_of(lined), ranges=5)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(brute.lines(lined), key=repr)


def test_null_and_repeated_ids(docs_of):
    shared = "a line that is long enough to count"
    rows = [(None, shared), (None, shared + "\nx"), (1, shared), (1, shared), (1, "y\n" + shared), (2, shared + "\nz")]
    for docs in (rows, rows[:5], rows[:2], rows[2:5]):
        got = line_dedup.digests(line_dedup.cleaned_texts(docs_of(docs), ranges=3))
        assert results(got) == sorted(brute.lines(docs), key=repr)


def test_empty_table_texts_and_bitmaps(docs_of):
    assert line_dedup.cleaned_texts(docs_of([])).collect() == []
    shared = "Seen in three documents, so it goes"
    docs = docs_of([(1, f"a\n{shared}\nb"), (2, shared), (3, f"{shared}\n{shared.lower()} \nc")])
    texts = {r.doc_id: r.text for r in line_dedup.cleaned_texts(docs).collect()}
    assert texts == {1: "a\nb", 2: "", 3: f"{shared}\n{shared.lower()} \nc"}
    maps = {r.doc_id: line_dedup.unpack(r.keep, r.n_lines).tolist() for r in line_dedup.keep_bitmaps(docs).collect()}
    assert maps == {1: [True, False, True], 2: [False], 3: [True, True, True]}
