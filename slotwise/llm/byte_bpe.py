"""Byte-level BPE encoding and decoding against a published rank table.

A text is split by the tokenizer's pattern; each piece is encoded by itself.
Bytes are mapped to the 256 Latin-1 characters, so that one Aho-Corasick
automaton over the vocabulary finds every token inside a piece.  The merges
are not simulated per piece.  A token sequence is what the merges give exactly
when each two neighbours are *compatible*: merging their joined bytes gives
the same two tokens again.  So the encoder walks from the left, takes the
longest token that is compatible with the one before, and steps back when a
position has no way on; positions found hopeless are remembered, so each is
tried once and the walk is linear in the piece.  Compatibility of two tokens
is worked out once per pair and kept.

The rank table is a constant file of the tokenizer (about a megabyte); each
Python worker loads it once and keeps it until another operator's tables take
its place.  Memory beyond it is bounded by the sizes of the caches, which are
emptied when full; results never depend on them.  Of a piece only the ids are
kept, of a piece that is one token the same ids for every piece: their text is
joined from a table of the tokens.

Defined cases: null text is the empty text: no tokens, and the hashes of the
empty string.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from slotwise.llm.common import lean, ready, resident

# Entries of one generation of the piece cache (two are kept) and of the pair
# cache, per worker.
PIECE_CACHE = 150_000
PAIR_CACHE = 1_000_000
# Longer pieces are encoded each time they occur.
CACHED_PIECE_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.split = splitter(pattern)
        self.ranks = ranks
        self.token_bytes = {r: t for t, r in ranks.items()}
        # The two tokens whose merge makes a token (None for single bytes).
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                last = self._merge_below(token, rank)
                if len(last) != 2:
                    continue  # merges never reach this token; it only occurs as a whole piece
                self.parts[rank] = last = (last[0], last[1])
                self.merged[last] = rank
            else:
                self.parts[rank] = None
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        # Of each token its length and the longest token that is a proper prefix (-1: none).
        self.length, self.shorter = [0] * (max(self.token_bytes) + 1), [-1] * (max(self.token_bytes) + 1)
        for rank in self.parts:
            token = self.token_bytes[rank]
            self.length[rank] = len(token)
            prefixes = (ranks.get(token[:k], -1) for k in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((r for r in prefixes if r in self.parts), -1)
        # Of each token its id as text, and the ids of a piece that is this token.
        self.id_text = [str(k) for k in range(len(self.length))]
        self.alone = [(k,) for k in range(len(self.length))]
        self.pairs: dict[tuple[int, int], bool] = {}
        # piece -> ids; the older generation is dropped when the newer is full
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _merge_below(self, token: bytes, limit: int) -> list[int]:
        """Tokens left of ``token`` once every merge of a rank under ``limit`` is done."""
        ranks = self.ranks
        seq = [token[i : i + 1] for i in range(len(token))]
        while len(seq) > 1:
            best, at = limit, -1
            for i in range(len(seq) - 1):
                r = ranks.get(seq[i] + seq[i + 1], limit)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            seq[at : at + 2] = [seq[at] + seq[at + 1]]
        return [ranks[x] for x in seq]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens leaves these two tokens."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens, latest first, and look whether, at
        any of these moments, the two parts that touch would have merged with
        each other before the merge just undone."""
        horizon = len(self.ranks) + 1  # merges of a smaller rank come first
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < horizon:
                return False
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                return True
            # Equal ranks are merged from the left, so the right one is undone first.
            if b is None or (a is not None and left > right):
                horizon, left = left, a[1]
            else:
                # A merge across the border of equal rank lies left of it and goes first.
                horizon, right = right + 1, b[0]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None:
            return self.alone[whole]
        chars = data.decode("latin-1")
        pairs, compatible = self.pairs, self.compatible
        # The first way tried takes the longest token everywhere; most pieces need no other.
        longest = tuple([token for _, token in self.automaton.iter_long(chars)])
        for key in zip(longest, longest[1:], strict=False):
            known = pairs.get(key)
            if known is None:
                known = compatible(*key)
            if not known:
                return self._search(chars)
        return longest

    def _search(self, chars: str) -> tuple[int, ...]:
        """The walk with steps back."""
        n = len(chars)
        length, shorter, compatible, longest = self.length, self.shorter, self.compatible, self.automaton.iter_long
        out: list[int] = []
        dead = bytearray(n + 1)  # positions from which the end can't be reached
        pos = 0
        token = next(longest(chars, 0))[1]
        while True:
            while token >= 0 and (dead[pos + length[token]] or (out and not compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += length[token]
                if pos == n:
                    return tuple(out)
                token = next(longest(chars, pos))[1]
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= length[token]
                token = shorter[token]

    def encode_pieces(self, text: str) -> list[tuple[int, ...]]:
        """For each piece of a text its ids."""
        out = []
        cache, older = self.pieces, self.older
        get = cache.get
        for piece in self.split(text):
            known = get(piece)
            if known is None:
                known = older.get(piece)
                if known is None:
                    known = self.encode_piece(piece)
                if len(piece) <= CACHED_PIECE_CHARS:
                    if len(cache) >= PIECE_CACHE:
                        self.older = older = cache
                        self.pieces = cache = {}
                        get = cache.get
                    cache[piece] = known
            out.append(known)
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_pieces(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, digest of the ids, digest of the decoded bytes."""
        ids = self.encode(text)
        listed = ",".join(map(self.id_text.__getitem__, ids))
        return len(ids), sha256(listed.encode()).hexdigest(), sha256(self.decode(ids)).hexdigest()


def splitter(pattern: str):
    """``findall`` of the tokenizer's pattern.

    The standard ``re`` module splits faster than a matcher with Unicode
    properties as long as its character classes are small.  So texts within
    Latin-1 go to a form of the pattern whose classes are spelled out as
    Latin-1 ranges, read off the properties; both split alike.
    """
    import regex

    full = regex.compile(pattern).findall
    latin = "".join(map(chr, range(256)))
    spans = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = [(m[0], m[-1]) for m in regex.findall(f"{name}+", latin)]
        spans[name] = "".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in runs)
    spelled, inside = "", False
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern):
        if part in "[]":
            inside = part == "["
        if part == r"\S":
            spelled += f"[^{spans[chr(92) + 's']}]"
        elif part in spans:
            spelled += spans[part] if inside else f"[{spans[part]}]"
        else:
            spelled += part
    small = re.compile(spelled).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return small(text)

    return split


def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a vocabulary, kept by the worker process."""
    return resident(("byte_bpe", path, pattern), lambda: ByteBpe(read_ranks(path), pattern))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file where this process runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens and the two digests.

    ``vocab`` names a file of the public tokenizers; workers resolve it
    themselves, because it is installed at its own place on each machine.
    """
    ready(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary(vocab), pattern)
        for batch in batches:
            rows = [bpe.round_trip(text.as_py() or "") for text in batch.column("text")]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def token_ids(docs: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """doc_id and the token ids themselves, for a training set."""
    ready(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary(vocab), pattern)
        for batch in batches:
            ids = [bpe.encode(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
