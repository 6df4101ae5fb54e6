import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from factloom.llm import runs
from factloom.llm.queries import op11_runs, repeated_tail


def brute(words):
    """All maximal runs by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def searched(texts):
    """The same through the operator's kernel, for lists of words."""
    names = {}
    ids = np.array([names.setdefault(w, len(names)) for t in texts for w in t], np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.cumsum([0, *map(len, texts)])
    out = [[] for _ in texts]
    for s, e, q in zip(*map(np.ndarray.tolist, runs.find(ids, text))):
        out[text[s]].append((s - int(first[text[s]]), e - s, q))
    return out


def texts(seed):
    rng = random.Random(seed)
    many = [[str(rng.randrange(v)) for _ in range(rng.randrange(1, 400))] for v in (2, 3, 5, 50) for _ in range(8)]
    for _ in range(120):
        t = []
        for _ in range(rng.randrange(1, 5)):
            t += [str(rng.randrange(40)) for _ in range(rng.randrange(30))]
            unit = [str(rng.randrange(rng.choice([2, 4, 30]))) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 60, 65]))]
            size = rng.randrange(1, 6 * len(unit) + 30)
            t += (unit * (size // len(unit) + 1))[:size]
        if rng.random() < 0.3:  # the same again, also inside another period
            t = (t + ["x"]) * rng.choice([2, 3, 4])
        if rng.random() < 0.3 and t:
            t[rng.randrange(len(t))] = "y"
        many.append(t)
    a, b = ["a"], ["b"]
    while len(b) < 600:
        a, b = b, b + a
    many += [a, b, ["a"] * 1000, ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, (["a"] * 30 + ["b"]) * 5, []]
    return many


def test_runs_match_brute_force():
    for seed in range(4):
        some = texts(seed)
        for t, got in zip(some, searched(some)):
            assert got == brute(t), t


def test_grammar_derives_the_text():
    """Every occurrence of a rule spells the same words as its first one."""
    words = np.array([int(x) for t in texts(9) for x in t if x.isdigit()])
    n = len(words)
    g = runs.Grammar(words, np.zeros(n), np.zeros(n, np.int64), np.full(n, n), np.zeros(n, np.int64))
    first = {r: (a, b) for r, a, b in zip(g.rule.tolist(), g.low.tolist(), g.high.tolist()) if r >= 0}
    assert first and len(g.occurs) > len(first)
    for r, p in zip(g.occurs.tolist(), g.place.tolist()):
        a, b = first[r]
        assert b - a >= 24 and np.array_equal(words[a:b], words[p : p + b - a])


def wanted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in found)), sha(kept))


def test_query_matches_brute_force(spark, sf_dir):
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in op11_runs(spark, sf_dir).collect()}
    assert len(docs) > 150 and sum(r[1] > 0 for r in got.values()) > 5
    for r in docs:
        assert got[r.doc_id] == wanted(r.doc_id, r.text)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b " * 30), (4, "a b " * 30), (None, "q " * 40), (6, "é　ü " * 40), (7, "w" * 100_000 + " x" * 50), (8, "a\x0bb\x0cc\rd " * 9), (9, " ".join(str(i % 700) for i in range(30_000)))]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, runs int, collapsed string")
    got = [tuple(r) for r in runs.digest(runs.find_runs(docs, repeated_tail)).collect()]
    assert sorted(map(str, got[:-1])) == sorted(str(wanted(d, t)) for d, t in rows[:-1])
    a, p = repeated_tail(9, 30_000) or (30_000, 1)
    assert a == 30_000 and got[-1][1:6] == (1, 0, 30_000, 700, 42857)
    assert runs.find_runs(docs.limit(0)).collect() == []
