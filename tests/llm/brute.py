"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def substrings(docs, window=20):
    """doc_id -> (n_words, n_removed, kept_sha256)"""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc_id] = (len(words), sum(gone), sha(" ".join(kept).encode()))
    return out


def suffixes(docs, window=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)"""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            key = data[i : i + window]
            if key in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(key)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[doc_id] = (len(data), sum(gone), spans, sha(kept))
    return out


def shingles(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def jaccard(docs, n=5, percent=80):
    """doc_id -> (n_shingles, component_id)"""
    sets = {d: shingles(t, n) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for e in holders[x]:
                if e < d:
                    common[e] += 1
        for e, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def exact(docs):
    """doc_id -> (keep_id, group_size, kept, text_sha256)"""
    groups = defaultdict(list)
    for d, t in docs:
        groups[(t or "").translate(LOWER)].append(d)
    return {d: (max(g), len(g), d == max(g), sha(t.encode())) for t, g in groups.items() for d in g}


def mixture(docs, weights=(3, 1, 2), share=1.5, epochs=2, seed="mix"):
    """docs: (doc_id, text, source) -> doc_id: (size, source_size, target, taken)"""
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    sources = sorted({s for _, _, s in docs if s is not None}, key=lambda s: s.encode())
    sources += [None] * any(s is None for _, _, s in docs)
    total = {s: sum(size[d] for d, _, x in docs if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:
        left = share * sum(total.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > epochs * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: epochs * float(total[s]) for s in over}
        open_ -= over
    out = {}
    for s in sources:
        n = total[s]
        whole = int(target[s] // n) if n else 0
        extra = int(target[s] + 0.5) - whole * n
        mine = [d for d, _, x in docs if x == s]
        for d in sorted(mine, key=lambda d: (hashlib.md5(f"{seed}:{d}".encode()).hexdigest(), d)):
            part = max(0, min(size[d], extra))
            extra -= size[d]
            out[d] = (size[d], n, target[s], whole * size[d] + part)
    return out


def lines(docs, min_chars=20, min_docs=3):
    """docs: (doc_id, text) rows -> a list of (doc_id, n_lines, n_dropped, kept_sha256), one per row"""
    rank = lambda d: float("-inf") if d is None else d
    holders = defaultdict(set)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(holders[key(x)]) < min_docs or max(holders[key(x)], key=rank) == d]
        out.append((d, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def collocations(docs, min_count, longest=5, top=2000):
    """docs: (lang, text) -> rows (lang, rank, phrase, a, l, r, n, score)"""
    counts, sizes = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in often.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and b >= a and inside(q) for q, b in often.items()):
                continue
            best = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            k = best[1]
            rows.append((" ".join(p), a, f[p[:k]], f[p[k:]], sizes[lang], best[0]))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return out


def hard_negatives(rows, anchor, positives=5, negatives=10):
    """rows: (vec_id, label, vector) with usable values and distinct ids -> the rows of the result"""
    scaled = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for a, label, v in scaled:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, k == label) for i, k, w in scaled if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits[:negatives])]
    return out
