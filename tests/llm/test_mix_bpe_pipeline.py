"""Mixing, byte-level BPE, the queries' SQL and the pipeline."""

import base64
import gc
import random
import sys
import tracemalloc
import weakref

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotwise.llm import byte_bpe, common, mixing, toxicity
from slotwise.llm.common import table
from slotwise.llm.queries import BPE_VOCABULARY, QUERIES

P = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sourced():
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a", "B", "é", None, "zz", "hot", "hot", "hot"])) for i in range(300)]
    return rows + [(1000, None, "a"), (1001, "", "only blank"), (1002, "x " * 3000, "long"), (1003, "y", "a")]


def test_mix(docs_of, sourced):
    got = mixing.mix(docs_of(sourced, extra=True)).select("doc_id", "size", "source_size", "target", "taken").collect()
    want = brute.mixture(sourced)
    assert {r[0]: tuple(r[1:]) for r in got} == want
    for _, _, source in sourced:
        mine = [d for d, _, s in sourced if s == source]
        assert abs(sum(want[d][3] for d in mine) - want[mine[0]][2]) <= 0.5
    assert all(v[3] <= 2 * v[0] for v in want.values())


def test_mix_empty_and_one_source(docs_of):
    assert mixing.mix(docs_of([])).collect() == []
    got = mixing.mix(docs_of([(1, "a b c d", "s"), (2, "e f", "s")])).collect()
    assert sum(r.taken for r in got) == 9 and {r.target for r in got} == {9.0}


def test_mixed_documents(docs_of, sourced):
    docs = docs_of(sourced, extra=True)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.WORD.findall(r.text or ""))
    assert {d: n for d, n in words.items() if n} == {d: v[3] for d, v in brute.mixture(sourced).items() if v[3]}


def test_mixed_documents_repeated_ids_clashing_names_and_long_texts(docs_of):
    # The source's target is 1.5 times its words: rows that repeat an id count each.
    rows = [(7, "a b c d", "s"), (7, "e f g h", "s"), (7, "a b c d", "s"), (8, "w " * 100, "s"), (9, None, "s"), (9, "", "s")]
    docs = docs_of(rows, extra=True)
    for name in ("__id", "__size", "__taken", "__copy", "row", "key", "n", "copy", "edge", "start", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    for seed in ("mix", "1", "2", "3"):
        out = mixing.mixed_documents(docs, seed=seed)
        assert out.columns == docs.columns
        got = out.collect()
        assert sum(len((r.text or "").split()) for r in got) == 168  # of 112 words
        assert sum(r.doc_id == 9 for r in got) == 2
        assert all(r.n_chars == len(r.text or "") for r in got)
    long = docs_of([(1, "w " * 400_000, "s"), (2, "v " * 1000, "s")])
    assert sum(len(r.text.split()) for r in mixing.mixed_documents(long).collect()) == 601_500


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(P.path(BPE_VOCABULARY), P.PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_bpe_equals_merges(bpe, reference):
    rnd = random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyz éüßñABC 0123456789!?.,'日本語한국어\U0001f600\n\t\x1c   "
    texts = ["".join(rnd.choice(alphabet[: rnd.choice([6, 27, 99])]) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 3000, "é" * 999, " " * 1000, "<|endoftext|>", "don't I'LL", " x　y"]
    texts += ["".join(map(chr, range(a, a + 200))) for a in range(0, 0xD700, 200)]
    for text in texts:
        ids = bpe.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_bpe_caches_do_not_change_results(bpe, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE_CACHE", 3)
    monkeypatch.setattr(byte_bpe, "PAIR_CACHE", 5)
    text = "some words that come again: some words that come again, other words that do not"
    assert bpe.encode(text) == reference.encode_ordinary(text)


def test_bpe_documents(docs_of, reference):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (None, "x"), (5, "long " * 20_000)]
    got = byte_bpe.encode_documents(docs_of(rows, extra=True), BPE_VOCABULARY, P.PATTERN).collect()
    want = {}
    for doc_id, text in rows:
        ids = reference.encode_ordinary(text or "")
        want[doc_id] = (len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha((text or "").encode()))
    assert {r[0]: tuple(r[1:]) for r in got} == want
    ids = byte_bpe.token_ids(docs_of(rows[:1]), BPE_VOCABULARY, P.PATTERN).first().ids
    assert ids == reference.encode_ordinary("Hello wörld")
    assert byte_bpe.encode_documents(docs_of([]), BPE_VOCABULARY, P.PATTERN).collect() == []


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline_equals_plain_stages(spark, reference):
    """The stages by hand over the same input; the classifier's decisions are taken from its operator."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id not in toxic]
    kept = {d for d, v in brute.exact([r[:2] for r in rows]).items() if v[2]}
    rows = [r for r in rows if r[0] in kept]
    kept = {d for d, (_, c) in brute.jaccard([r[:2] for r in rows]).items() if d == c}
    rows = [r for r in rows if r[0] in kept]
    taken = brute.mixture(rows)
    want = []
    for d, text, _ in rows:
        size, _, _, left = taken[d]
        while left > 0:
            part = text if left >= size else " ".join(brute.WORD.findall(text)[:left])
            ids = reference.encode_ordinary(part)
            want.append((d, len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha(part.encode())))
            left -= size
    got = [tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns(spark, docs_of):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mix", "bpe"]
    docs = table(spark, SMALL, "documents").where(F.col("doc_id") < 60)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


# --- what a worker keeps ---------------------------------------------------


@pytest.fixture
def small_ranks(tmp_path):
    """A rank table of the single bytes, two letters and two digits."""
    tokens = [bytes([k]) for k in range(256)] + [a + b for s in (b"abcdefghij", b"0123456789") for a in _each(s) for b in _each(s)]
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)))
    return str(path)


def _each(s):
    return [s[k : k + 1] for k in range(len(s))]


def test_worker_keeps_tables_of_one_operator(small_ranks):
    bpe = weakref.ref(byte_bpe.load(small_ranks, P.PATTERN))
    assert byte_bpe.load(small_ranks, P.PATTERN) is bpe()
    first = toxicity._automaton((("vile", False, 2.0),))
    assert toxicity._automaton((("vile", False, 2.0),)) is first
    gc.collect()
    assert bpe() is None  # its tables would lie beside those of the toxicity model
    held = sys.getrefcount(first)
    toxicity._automaton((("mean", True, 1.0),))
    assert sys.getrefcount(first) < held  # nor do earlier models stay


def test_cached_piece_holds_its_ids_only(small_ranks):
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(small_ranks), P.PATTERN)
    text = " ".join(f"{a}{b}{c}{d}{e}" for a in "abcdef" for b in "abcdefgh" for c in "abcdefgh" for d in "abcdefgh" for e in "abc")
    n = len(bpe.split(text))
    bpe.round_trip(text)  # pairs of tokens are known from here on
    bpe.pieces = {}
    tracemalloc.start()
    try:
        bpe.round_trip(text)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(bpe.pieces) == n > 9000
    assert held < 170 * n, held / n
    assert bpe.encode("ab") == [257] and bpe.encode_pieces("ab") == [bpe.alone[257]]


def test_lean_task_gives_its_rows():
    closed = []

    def run(batches):
        try:
            yield from (2 * b for b in batches)
        finally:
            closed.append(True)

    assert list(common.lean(run)(iter([1, 2]))) == [2, 4] and closed == [True]
    some = common.lean(run)(iter([1, 2]))  # a task that is ended early
    assert next(some) == 2
    some.close()
    assert len(closed) == 2
