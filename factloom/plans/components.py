"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.shared import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of comparable ids -> ``(node, root)``, root the smallest node reached.

    Large-star and small-star rounds (each halves the distance to the root) until the
    edge set stays the same. Self-loops and null ends are ignored; nodes without an
    edge do not appear. Each round is a table in the shared folder, which takes the place of
    the one before.
    """
    e = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = _mark(e)
    while before[0]:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("x"), "m")
        small = small.select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))
        last, e = e, materialize(small.union(low).distinct(), "star")
        discard(last)
        after = _mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("node")).distinct().join(e.select(F.col("a").alias("node")), "node", "left_anti")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
