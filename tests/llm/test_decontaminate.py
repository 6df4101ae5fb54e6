import random
import re

import numpy as np

from factloom.llm import decontaminate as dc

WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute(item, doc):
    a, b = words(item), words(doc)
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h)) / max(1, 2 * len(a))


def test_alignment_is_smith_waterman():
    random.seed(2)
    for _ in range(60):
        a, b = (np.array([random.randrange(4) for _ in range(random.randrange(1, 15))]) for _ in range(2))
        want = brute(" ".join("wxyz"[i] for i in a), " ".join("wxyz"[i] for i in b)) * 2 * len(a)
        assert dc.align(a, b)[0] == round(want)


def edited(text, rng, share):
    out = []
    for w in text.split():
        x = rng.random()
        out += [] if x < share / 3 else [w, "added"] if x < 2 * share / 3 else ["other"] if x < share else [w]
    return " ".join(out)


def test_planted_copies(spark):
    rng = random.Random(7)
    d = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").limit(300).collect()]
    planted = {}
    for k, (i, t) in enumerate(items):
        if len(t.split()) > 20:
            docs.append((10_000 + k, f"{docs[k][1]} {edited(t, rng, 0.2)} {docs[k + 1][1]}"))
            planted[10_000 + k] = i
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id): r.score for r in got}
    assert len(pairs) == len(got)
    missed = [p for p in planted.items() if p not in pairs]
    assert len(missed) <= len(planted) * 0.05, missed
    text, item = dict(docs), dict(items)
    for (i, k), s in pairs.items():
        assert s >= 0.5 and abs(s - brute(item[k], text[i])) < 1e-9
    exact = [(i, k) for i, t in docs for k, x in items if x in t]
    assert all(p in pairs for p in exact) and exact


def test_edge_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "two words"), (None, "one other item with six words"), (5, "Ünï cödé")]
    docs = [(1, None), (2, ""), (3, "x " + item.upper() + "! y"), (3, item), (None, item), (4, "here are two-words."), (5, "ünï CÖDÉ Ünï cödé"), (6, "w " * 30_000 + item), (7, "one other item with six words")]
    schema = "{} long, text string, item long, words string"
    d = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], schema.format("doc_id"))
    b = spark.createDataFrame([(i, t, 1, "w") for i, t in items], schema.format("item_id"))
    got = sorted(((r.doc_id, r.item_id, r.score) for r in dc.leaks(d, b).collect()), key=str)
    assert got == sorted([(3, 1, 1.0), (None, 1, 1.0), (4, 4, 1.0), (5, 5, 1.0), (6, 1, 1.0), (7, None, 1.0)], key=str)
    assert dc.leaks(d.limit(0), b).collect() == [] and dc.leaks(d, b.limit(0)).collect() == []
