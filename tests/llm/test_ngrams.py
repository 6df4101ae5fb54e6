import math
import re
from collections import Counter

import pytest

from factloom.llm import lm, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(rows, window=13):
    least = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def brute_scores(rows):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    c = {k: Counter(tuple(w[i : i + k]) for _, w in docs for i in range(len(w) - k + 1)) for k in (1, 2, 3)}
    total = sum(c[1].values())
    out = []
    for d, w in docs:
        own = {k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in (1, 2, 3)}
        n = lambda *g: c[len(g)][g] - own[len(g)][g]  # noqa: B023, E731  # in the other documents
        s, by = 0.0, Counter()
        for i in range(len(w)):
            tri, bi = tuple(w[max(i - 2, 0) : i + 1]), tuple(w[max(i - 1, 0) : i + 1])
            if i > 1 and n(*tri) > 0:
                x, k = n(*tri) / n(*tri[:2]), 3
            elif i > 0 and n(*bi) > 0:
                x, k = n(*bi) / n(bi[0]) * (0.4 if i > 1 else 1), 2
            else:
                x, k = max(n(w[i]), 1) / max(total - len(w), 1) * 0.4 ** min(i, 2), 1
            s += math.log(x)
            by[k] += 1
        out.append((d, len(w), by[3], by[2], by[1], s))
    return sorted(out, key=str)


EDGE = [
    (1, None), (2, ""), (3, " \n "), (4, "a b c"), (None, " ".join("abcdefghijklmnop")), (5, " ".join("abcdefghijklmnop")),
    (6, "x\ny " + "\t".join("abcdefghijklmnop") + " z"), (5, " ".join("bcdefghijklmno")), (7, "w " * 40_000), (8, "w " * 20),
    (9, "é" + "\x0b".join("abcdefghijklmnop")), (10, "q\x85r s t　u v w x y z a b c d e f"), (11, "q\x85r s t　u v w x y z a b c d e f"),
]


@pytest.fixture(params=["documents", "edge"])
def case(request, spark, sf_dir):
    if request.param == "edge":
        docs = spark.createDataFrame([(d, t, 1, "b") for d, t in EDGE], "doc_id long, text string, part int, bucket string")
        return docs, EDGE
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.collect()]


def test_repeats_match_brute_force(case):
    docs, rows = case
    got = substrings.drop_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_repeats(rows)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_scores_match_brute_force(case):
    docs, rows = case
    got = sorted((tuple(r) for r in lm.score(docs).collect()), key=str)
    for g, w in zip(got, brute_scores(rows), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.drop_repeats(docs).collect() == [] and lm.score(docs).collect() == []


def test_common_prefix():
    assert substrings._common_words(b"a b c", b"a b d", 3) == 2
    assert substrings._common_words(b"ab c", b"a bc", 2) == 0
    assert substrings.deep_nodes([b"a b", b"a c", b"a b"], 2).tolist() == [0, 1, 0]
