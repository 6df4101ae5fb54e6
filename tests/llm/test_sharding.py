import random
import zlib
from collections import Counter, defaultdict

from factloom.llm import sharding


def minimax(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, at = (lo + hi) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


def check(docs, rows, shards):
    got = [r.asDict() for r in sharding.assign_shards(docs, shards).collect()]
    assert Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows) == Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got)
    slots, held = defaultdict(list), defaultdict(int)
    for g in got:
        slots[g["shard"]].append(g["slot"])
        held[g["shard"]] += g["size"]
        assert g["law"] == "bytes" and g["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    return held


def test_capacity_is_smallest(spark):
    random.seed(3)
    rows = [(i, "x" * random.randrange(60) + str(random.randrange(400))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = check(docs, rows, 7)
    from pyspark.sql import functions as F

    groups = docs.groupBy(F.sha2("text", 256).alias("gid")).agg(F.sum(F.octet_length("text") + 16).alias("bytes"))
    sizes = [r.bytes for r in groups.orderBy("gid").collect()]
    assert max(held.values()) == minimax(sizes, 7) == sharding.plan_cuts(groups, 7)[2]


def test_cells_refine_to_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_FIRST", 1)
    random.seed(4)
    sizes = [(f"{random.getrandbits(64):016x}", random.randrange(1, 1000)) for _ in range(2000)]
    groups = spark.createDataFrame(sizes, "gid string, bytes long")
    for shards in (1, 2, 13, 40):
        assert sharding.plan_cuts(groups, shards)[2] == minimax([b for _, b in sorted(sizes)], shards)


def test_hot_group_and_odd_rows(spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, f"t{i}") for i in range(300)] + [(None, None), (5000, None), (5001, ""), (5001, ""), (9, "é" * 5000)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, shard int, gid int")
    held = check(docs, rows, 6)
    assert len(held) == 6
    small = sorted(held.values())[:4]
    assert max(small) - min(small) <= 200
    assert sharding.assign_shards(docs.limit(0)).collect() == []
