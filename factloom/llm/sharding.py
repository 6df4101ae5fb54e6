"""Shards of nearly equal bytes: minimax contiguous partition of groups of equal texts.

Groups are ordered by the SHA-256 of their text. A group larger than an equal share of
what is left gets a shard alone (no cut can do better); over the rest, the smallest
feasible shard capacity is found by binary search with a greedy check.

The search never sees all groups. It starts with the 65,536 cells of the first four hex
digits and, until the capacity is certain, splits only the cells in which a cut may lie:
treating such a cell as one block gives an upper bound, treating it as divisible at any
byte a lower one. So the driver holds a bounded table, and the answer is exact.

Law: ``bytes``. Defined results: a null text counts as the empty text; a null doc_id stays null; repeated rows are
rows of one group; an empty table gives no rows; slots of a shard run from 0 without gaps.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.shared import materialize

SHARDS = 40
ROW_BYTES = 16
_FIRST = 4
_BUCKETS = 1024


class Cells:
    """Consecutive runs of groups: ``(prefix, groups, bytes)`` in order of prefix."""

    def __init__(self, cells: list[tuple[str, int, int]]):
        self.cells = sorted(cells)
        self.ends = list(accumulate(c[2] for c in self.cells))
        self.total = self.ends[-1] if self.ends else 0
        self.start = [e - c[2] for e, c in zip(self.ends, self.cells, strict=True)]

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """Greedy ends of the first shards, in bytes; stops where a block does not fit."""
        at, out = 0, []
        while at < self.total and len(out) < shards:
            k = bisect_right(self.ends, at + capacity)
            to = self.ends[k - 1] if k else 0
            if divisible and k < len(self.cells) and self.cells[k][1] > 1:
                to = max(to, at + capacity)
            if to <= at:
                break
            at = min(to, self.total)
            out.append(at)
        return out

    def capacity(self, shards: int, divisible: bool) -> int:
        lo, hi = -(-self.total // shards), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, shards, divisible)[-1:] == [self.total]:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def unsure(self, low: int, high: int, shards: int) -> list[str]:
        """Prefixes of the cells of several groups in which some cut may lie."""
        found = set()
        first, last = self.cuts(low, shards, False), self.cuts(high, shards, True)
        first += [first[-1] if first else 0] * (len(last) - len(first))
        for a, b in zip(first, last, strict=False):
            for k in range(bisect_left(self.ends, a), min(bisect_right(self.start, b), len(self.cells))):
                if self.cells[k][1] > 1:
                    found.add(self.cells[k][0])
        return sorted(found)


def _count(groups: DataFrame, digits: int) -> list[tuple[str, int, int]]:
    cells = groups.groupBy(F.substring("gid", 1, digits).alias("cell"))
    return [(r.cell, r.n, r.bytes) for r in cells.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()]


def plan_cuts(groups: DataFrame, shards: int) -> tuple[list[str], list[str], int]:
    """``(gid hex, bytes)`` -> groups that get a shard alone, first prefix of each further
    shard of the rest, and the largest shard's bytes."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone, left, largest = [], total, 0
    for r in groups.orderBy(F.desc("bytes"), "gid").limit(shards).collect():
        if r.bytes * (shards - len(alone)) <= left:
            break
        alone.append(r.gid)
        left -= r.bytes
        largest = max(largest, r.bytes)
    if not left:
        return alone, [], largest
    rest, shards = groups.where(~F.col("gid").isin(alone)) if alone else groups, shards - len(alone)
    cells = Cells(_count(rest, _FIRST))
    while True:
        low, high = cells.capacity(shards, True), cells.capacity(shards, False)
        split = set(cells.unsure(low, high, shards)) if low < high else set()
        if not split:
            break
        kept = [c for c in cells.cells if c[0] not in split]
        for digits in sorted({len(p) for p in split}):
            part = spark.createDataFrame([(p,) for p in sorted(split) if len(p) == digits], "prefix string")
            inside = rest.join(F.broadcast(part), F.substring("gid", 1, digits) == F.col("prefix"), "left_semi")
            kept += _count(inside, digits + 2)
        cells = Cells(kept)
    cuts = cells.cuts(high, shards, False)
    return alone, [cells.cells[bisect_left(cells.start, c)][0] for c in cuts[:-1]], max(largest, high)


def _shard(gid: Column, alone: list[str], firsts: list[str]) -> Column:
    at = F.lit(len(alone))
    if firsts:
        at = at + F.size(F.filter(F.array(*map(F.lit, firsts)), lambda p: gid >= p))
    for k, g in enumerate(alone):
        at = F.when(gid == g, k).otherwise(at)
    return at.cast("int")


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: ``doc_id, size, text_crc32, law,
    shard, slot, grown_shard``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.sha2(text, 256).alias("gid"),
    )
    rows = materialize(rows, "rows")
    groups = materialize(rows.groupBy("gid").agg(F.sum("size").alias("bytes")), "groups")
    alone, firsts, _ = plan_cuts(groups, shards)
    bucket = F.pmod(F.xxhash64("doc_id", "gid"), F.lit(_BUCKETS)).cast("int")
    placed = rows.withColumn("shard", _shard(F.col("gid"), alone, firsts)).withColumn("bucket", bucket)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most shards x _BUCKETS rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "gid")
    placed = placed.withColumn("place", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["shard", "bucket"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
