import itertools
import random
import re

import numpy as np
import xxhash

from factloom.llm import simhash


def plain_fingerprint(text, words=3):
    """Bit by bit, without the library's code."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=3, words=3):
    fps = [(d, plain_fingerprint(t, words)) for d, t in rows]
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if bin(fps[a][1] ^ fps[b][1]).count("1") <= radius:
            label[find(a)] = find(b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    low = {}
    for members in groups.values():
        named = [fps[m][0] for m in members if fps[m][0] is not None]
        for m in members:
            low[m] = min(named, default=None)
    return sorted(((fps[i][0], f"{fps[i][1]:016x}", low[i]) for i in range(len(fps))), key=str)


def test_components_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_components(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (None, "a b"), (None, None), (7, "word " * 50_000)]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_components(rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_shards_keep_every_link(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) for b in base for _ in range(12)}
    fps = {f & (2**64 - 1) for f in fps} | set(base)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    from factloom.plans.components import connected_components

    def components(shard):
        links = simhash.link_fingerprints(frame, shard=shard)
        return sorted(tuple(r) for r in connected_components(links).collect())

    want = components(2048)
    assert want and components(3) == want
    label = {f: f for f in signed}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    assert want == sorted((f, find(f)) for f in signed if any(find(g) == find(f) for g in signed if g != f))
