import math
import random
import re

from factloom.llm import licenses
from factloom.llm.queries import op12_licenses


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_base(text):
    words = words_of(text)
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


def brute_places(text, weight):
    """Every place of every template tried, with no index."""
    words, found = words_of(text), set()
    for t in licenses.TEMPLATES:
        own, key = words_of(t.text), words_of(t.key)
        key_at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
        total = sum(weight[w] for w in own)
        top = sorted(set(own) & set(words), key=lambda w: (-weight[w], w))[: licenses.TOP]
        near = lambda at, size: words[max(at - 3, 0) : max(at - 3, 0) + 9 + size]
        if total <= 0 or sum(weight[w] for w in own if w in words) < total * (0.6 - 1e-9):
            continue
        for at in range(-len(own), len(words)):
            votes = {w for w in top for p, x in enumerate(own) if x == w for d in range(4) if 0 <= at + p + d < len(words) and words[at + p + d] == w}
            exact = any(0 <= at + p < len(words) and words[at + p] == x and x in top for p, x in enumerate(own))
            if len(votes) < 2 or not exact:
                continue
            if f" {' '.join(key)} " not in f" {' '.join(near(at + key_at, len(key)))} ":
                continue
            share = sum(weight[w] for p, w in enumerate(own) if w in near(at + p, 1)) / total
            if share >= 0.6:
                found.add((max(at, 0), t.label, round(min(share, 1.0), 9)))
    return sorted(found)


def texts():
    rng = random.Random(7)
    out = []
    for k in range(60):
        t = rng.choice(licenses.TEMPLATES).text.split()
        for _ in range(rng.randrange(4)):  # edited notices
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], ["extra", t[i]], ["changed"]])
        before, after = ([rng.choice(["the", "of", "xylo", "software", "License", "ça", "cc", "by"]) for _ in range(rng.randrange(40))] for _ in range(2))
        out.append(" ".join([*before, *t, *after]))
    return out + [None, "", " \n", "CC BY CC BY-SA cc  by", "APACHE license", "İ MIT_License é", "mit license " * 400, "x " * 20_000 + "GNU General Public License", "apachelicense", "a b c"]


def test_scan_matches_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "Apache-License"), (3, texts()[3]), (3, texts()[3])]
    docs = spark.createDataFrame([(d, t, 0, "z") for d, t in rows], "doc_id long, text string, word int, places string")
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in words_of(t.text)})
    has = [set(words_of(t)) for _, t in rows]
    weight = {w: math.log((len(rows) + 1) / (sum(w in h for h in has) + 1)) for w in vocabulary}
    assert licenses.weights(docs, vocabulary) == weight
    got = licenses.scan(docs).collect()
    assert sorted(str((r.doc_id, *r[1:5], r.base_labels)) for r in got) == sorted(str((d, *brute_base(t))) for d, t in rows)
    want = sorted(str((d, brute_places(t, weight))) for d, t in rows)
    assert sorted(str((r.doc_id, [(p.word, p.label, round(p.share, 9)) for p in r.places])) for r in got) == want
    assert sum(bool(r.places) for r in got) > 40
    assert licenses.scan(docs.limit(0)).collect() == []


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in op12_licenses(spark, sf_dir).collect()}
    for r in docs:
        n_words, n_base, first, last, labels = brute_base(r.text)
        g = got[r.doc_id]
        assert tuple(g)[1:6] == (n_words, n_base, first, last, ",".join(labels))
        assert set(labels) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1
    # the notices in the table are found by the index as well; the rest has no label
    assert all(g.score >= 0.6 for g in got.values() if g.labels) and sum(bool(g.labels) for g in got.values()) < 0.1 * len(docs)
