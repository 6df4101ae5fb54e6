"""Ranks, first and last of a key, periods, top-k and packing (W, K and R5, without W9-W11, K5 and K9)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from factloom.fixtures import Tables, named
from factloom.plans.ranges import sums_before
from factloom.plans.shared import materialize, shuffled, spread
from factloom.registry import query


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves up, as floor(x + 0.5) does."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def mid_rank(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``<metric>_rank`` = (below + (equal - 1) / 2) / (n - 1) for each metric, NULL kept and
    not counted, 0 for one row or fewer; ``<metric>_flat`` where all values are equal.

    Counts per metric and value come from one aggregation; what lies below is summed up in one
    pass over ranges of all metrics' values, so no window spans the whole table. Values are
    compared as doubles. The table is stored, since it is read twice.
    """
    df = materialize(df, "ranked")
    stacked = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    counts = df.select(F.explode(stacked).alias("x")).where("x.value is not null").groupBy("x.metric", "x.value").agg(F.count("*").alias("equal"))
    counts = sums_before(counts, ["metric", "value"], "equal", "before")
    whole = counts.groupBy("metric").agg(F.min("before").alias("start"), F.sum("equal").alias("total"), F.count("*").alias("values"))  # a row a metric
    below = F.col("before") - F.col("start")
    rank = F.when(F.col("total") <= 1, 0.0).otherwise(half_up((below + (F.col("equal") - 1) / 2) / (F.col("total") - 1), 4))
    ranks = materialize(counts.join(F.broadcast(whole), "metric").select("metric", "value", rank.alias("rank"), (F.col("values") == 1).alias("flat")), "ranks")
    out = df
    for m in metrics:
        table = ranks.where(F.col("metric") == m).select(F.col("value").alias("_value"), F.col("rank").alias(f"{m}_rank"), F.col("flat").alias(f"{m}_flat"))
        out = out.join(table, F.col(m).cast("double") == F.col("_value"), "left").drop("_value")
    return out


def grade_bands(df: DataFrame, score: str, high: float = 0.1, medium: float = 0.3) -> DataFrame:
    """``grade`` by place in descending score; ties share their first member's band, and at
    least one row is high. A row without a score has no grade and takes no place. The table is
    stored, since it is read twice."""
    df = materialize(df, "graded")
    counts = sums_before(df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("equal")), [F.negative(F.col(score))], "equal", "above")
    counts = counts.join(F.broadcast(counts.agg(F.sum("equal").alias("total"))))  # one row
    place, n = F.col("above"), F.col("total")
    grade = F.when(place < F.greatest(F.ceil(n * high), F.lit(1)), "high").when(place < F.ceil(n * medium), "medium").otherwise("low")
    return df.join(counts.select(score, grade.alias("grade")), score, "left")


def active_time(events: DataFrame, key: str, at: str, idle: float = 60.0) -> DataFrame:
    """Per key, seconds from first to last event, and without the gaps over ``idle``."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    gap = seconds - F.lag(seconds).over(Window.partitionBy(key).orderBy(at))
    e = events.select(key, seconds.alias("s"), gap.alias("gap"))
    idle_sum = F.coalesce(F.sum(F.when(F.col("gap") > idle, F.col("gap"))), F.lit(0.0))
    return e.groupBy(key).agg(F.round(F.max("s") - F.min("s"), 3).alias("wall_s"), F.round(F.max("s") - F.min("s") - idle_sum, 3).alias("active_s"))


def first_confirmation(ledger: DataFrame, confirm: str, start: str, end: str) -> DataFrame:
    """Earliest confirm event of each entity and whether it falls in (start, end]; an entity
    without one falls back to its own first time."""
    at = F.coalesce(F.min(F.when(F.col("event") == confirm, F.col("ts"))), F.min("ts"))
    out = ledger.groupBy("entity").agg(at.alias("first_ts"), F.bool_or(F.col("event") == confirm).alias("audited"))
    return out.withColumn("in_window", (F.col("first_ts") > F.lit(start).cast("timestamp_ntz")) & (F.col("first_ts") <= F.lit(end).cast("timestamp_ntz")))


def keep_last(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The row with the largest ``seq`` of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def keep_heaviest(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the largest weight (bad ones are 0), the first of equals."""
    weight = F.coalesce(F.expr("try_cast(weight as double)"), F.lit(0.0))
    rest = [c for c in edges.columns if c not in keys]
    e = edges.withColumn("weight", weight)
    return e.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("weight", -F.col("seq"))).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def number_duplicates(df: DataFrame, name: str, seq: str = "seq") -> DataFrame:
    """``key`` = the name, from the second one on with ``#dupN``."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(seq))
    return df.withColumn("key", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#dup"), n.cast("string"))))


def step_weight(df: DataFrame, flow: str, order: Sequence[str]) -> DataFrame:
    """Step i of n weighs (i + 1) / n, 4 decimals."""
    w = Window.partitionBy(flow)
    place = F.row_number().over(w.orderBy(*order))
    return df.withColumn("weight", half_up(place / F.count("*").over(w), 4))


def period_over_period(log: DataFrame, days: int) -> DataFrame:
    """Rows of (anchor - days, anchor] against the equally long period before, in one pass."""
    anchor = log.agg(F.max("ts").alias("anchor"))
    d = log.join(F.broadcast(anchor)).withColumn("age", F.unix_seconds(F.col("anchor").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")))
    span = days * 86400
    d = d.where(F.col("age") < 2 * span).withColumn("period", F.when(F.col("age") < span, "current").otherwise("previous"))
    return d.groupBy("period").agg(F.count_distinct("sha").alias("commits"), F.count_distinct("author").alias("authors"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def natural_key(text: Column) -> Column:
    """K1: a sort key in which runs of digits compare as numbers."""
    bare = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    number = lambda p: F.concat(F.lit("0"), F.lpad(F.length(bare(p)).cast("string"), 10, "0"), bare(p))  # noqa: E731  # more digits, larger
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(F.concat(F.lit("1"), p)))


def cap_neighbours(edges: DataFrame, most: int) -> DataFrame:
    """K4: of each node's neighbours the ``most`` of highest degree, then smallest id."""
    pairs = edges.where("source <> target").select(F.greatest("source", "target").alias("node"), F.least("source", "target").alias("neighbour")).distinct()
    pairs = materialize(pairs, "pairs")
    both = pairs.union(pairs.select("neighbour", "node"))
    degree = both.groupBy(F.col("node").alias("neighbour")).agg(F.count("*").alias("degree"))
    ranked = both.join(shuffled(degree), "neighbour").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("degree"), "neighbour")))
    return ranked.where(F.col("place") <= most).select("node", "neighbour", "degree", "place")


def capped_sample(df: DataFrame, key: str, order: Sequence[str], most: int) -> DataFrame:
    """K6, K7: the first ``most`` rows of each key, with the count of all."""
    total = df.groupBy(key).agg(F.count("*").alias("total"))
    kept = df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)
    return kept.join(total, key)


def chunks(df: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """K8: ``chunk`` 0, 1, ... of ``size`` rows within each key."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))


def packed(df: DataFrame, key: str, order: Sequence[str], size: str, budget: int) -> DataFrame:
    """In order, rows whose running total of kept sizes stays in the budget are kept; one
    that does not fit is skipped but listed. Each key's rows come sorted, and only the running
    total is held."""
    rows = df.select(key, *order, size).repartition(key).sortWithinPartitions(key, *order, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, 0
        for batch in batches:
            kept: list[bool | None] = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                last, used = k, used if k == last else 0
                fits = None if n is None else used + n <= budget
                used += n if fits else 0
                kept.append(fits)
            yield pa.record_batch([*batch.columns, pa.array(kept, pa.bool_())], [*batch.schema.names, "kept"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("kept", BooleanType())]))


_METRICS = """metrics AS (SELECT path, loc, CASE WHEN domain = 'brand11' THEN NULL ELSE seq % 17 END AS complexity FROM files)"""


@query(
    "w1_mid_rank",
    f"""{_METRICS}, c AS (SELECT *, count(loc) OVER () AS n1, count(complexity) OVER () AS n2,
  rank() OVER (ORDER BY loc) - 1 AS b1, count(*) OVER (PARTITION BY loc) AS e1,
  CASE WHEN complexity IS NOT NULL THEN rank() OVER (ORDER BY complexity NULLS LAST) - 1 END AS b2, count(*) OVER (PARTITION BY complexity) AS e2 FROM metrics)
SELECT path, floor((b1 + (e1 - 1) / 2e0) / (n1 - 1) * 10000 + 0.5) / 10000 AS loc_rank,
  CASE WHEN complexity IS NOT NULL THEN floor((b2 + (e2 - 1) / 2e0) / (n2 - 1) * 10000 + 0.5) / 10000 END AS complexity_rank FROM c""",
    ("files",),
)
def _w1(t: Tables) -> DataFrame:
    f = t.files.select("path", "loc", F.when(F.col("domain") != "brand11", F.col("seq") % 17).alias("complexity"))
    return mid_rank(f, ["loc", "complexity"]).select("path", "loc_rank", "complexity_rank")


@query(
    "w2_grade_bands",
    """c AS (SELECT path, loc, rank() OVER (ORDER BY loc DESC) - 1 AS place, count(*) OVER () AS n FROM files)
SELECT path, loc, CASE WHEN place < greatest(ceil(n * 0.1e0), 1) THEN 'high' WHEN place < ceil(n * 0.3e0) THEN 'medium' ELSE 'low' END AS grade FROM c""",
    ("files",),
)
def _w2(t: Tables) -> DataFrame:
    return grade_bands(t.files.select("path", "loc"), "loc").select("path", "loc", "grade")


@query(
    "w3_active_time",
    """g AS (SELECT entity, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY entity ORDER BY ts) AS gap FROM ledger)
SELECT entity, round(max(s) - min(s), 3) AS wall_s, round(max(s) - min(s) - coalesce(sum(gap) FILTER (WHERE gap > 3600), 0), 3) AS active_s FROM g GROUP BY entity""",
    ("ledger",),
)
def _w3(t: Tables) -> DataFrame:
    return active_time(t.ledger, "entity", "ts", 3600.0)


@query(
    "w4_first_confirmation",
    """c AS (SELECT entity, coalesce(min(ts) FILTER (WHERE event = 'purchase'), min(ts)) AS first_ts, bool_or(event = 'purchase') AS audited FROM ledger GROUP BY entity)
SELECT entity, first_ts, audited, first_ts > TIMESTAMP '2024-01-03' AND first_ts <= TIMESTAMP '2024-01-10' AS in_window FROM c""",
    ("ledger",),
)
def _w4(t: Tables) -> DataFrame:
    return first_confirmation(t.ledger, "purchase", "2024-01-03", "2024-01-10")


@query("w5_keep_last", "SELECT id, arg_max(type, seq) AS type, arg_max(name, seq) AS name, max(seq) AS seq FROM raw_nodes GROUP BY id", ("raw_nodes",))
def _w5(t: Tables) -> DataFrame:
    return keep_last(t.raw_nodes.select("id", "type", "name", "seq"), ["id"])


@query(
    "w6_keep_heaviest",
    """e AS (SELECT source, target, type, coalesce(TRY_CAST(weight AS DOUBLE), 0e0) AS weight, seq FROM raw_edges),
r AS (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY weight DESC, seq) AS n FROM e) SELECT source, target, type, weight, seq FROM r WHERE n = 1""",
    ("raw_edges",),
)
def _w6(t: Tables) -> DataFrame:
    return keep_heaviest(t.raw_edges, ["source", "target", "type"])


@query(
    "w7_number_duplicates",
    """r AS (SELECT type, seq, row_number() OVER (PARTITION BY type ORDER BY seq) AS n FROM raw_nodes) SELECT seq, CASE WHEN n = 1 THEN type ELSE concat(type, '#dup', n) END AS key FROM r""",
    ("raw_nodes",),
)
def _w7(t: Tables) -> DataFrame:
    return number_duplicates(t.raw_nodes, "type").select("seq", "key")


@query("w8_step_weight", "SELECT sha, path, added, floor(row_number() OVER (PARTITION BY sha ORDER BY path, added, deleted) * 1e0 / count(*) OVER (PARTITION BY sha) * 10000 + 0.5) / 10000 AS weight FROM commits", ("commits",))
def _w8(t: Tables) -> DataFrame:
    return step_weight(spread(t.commits, t.rows("lineitem"), "sha"), "sha", ["path", "added", "deleted"]).select("sha", "path", "added", "weight")


@query(
    "w12_period_over_period",
    """a AS (SELECT max(ts) AS anchor FROM commits), d AS (SELECT *, epoch(anchor) - epoch(ts) AS age FROM commits, a)
SELECT CASE WHEN age < 2592000 THEN 'current' ELSE 'previous' END AS period, count(DISTINCT sha) AS commits, count(DISTINCT author) AS authors, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted
FROM d WHERE age < 5184000 GROUP BY 1""",
    ("commits",),
)
def _w12(t: Tables) -> DataFrame:
    return period_over_period(t.commits, 30)


@query("k1_natural_order", "SELECT id, row_number() OVER (PARTITION BY type ORDER BY CAST(split_part(id, ':', 2) AS BIGINT)) AS place, type FROM nodes WHERE type IN ('file', 'service')", ("nodes",))
def _k1(t: Tables) -> DataFrame:
    n = t.nodes.where(F.col("type").isin("file", "service"))
    return n.select("id", F.row_number().over(Window.partitionBy("type").orderBy(natural_key(F.col("id")))).alias("place"), "type")


@query("k2_top_risk", "SELECT path, loc FROM files ORDER BY loc DESC, path LIMIT 20", ("files",))
def _k2(t: Tables) -> DataFrame:
    return t.files.select("path", "loc").orderBy(F.desc("loc"), "path").limit(20)


@query(
    "k4_cap_neighbours",
    """b AS (SELECT source AS node, target AS neighbour FROM file_edges WHERE source <> target UNION SELECT target, source FROM file_edges WHERE source <> target),
d AS (SELECT node AS neighbour, count(*) AS degree FROM b GROUP BY node),
r AS (SELECT b.node, neighbour, degree, row_number() OVER (PARTITION BY b.node ORDER BY degree DESC, neighbour) AS place FROM b JOIN d USING (neighbour)) SELECT * FROM r WHERE place <= 5""",
    ("file_edges",),
)
def _k4(t: Tables) -> DataFrame:
    edges, names = t.numbered_edges()
    return named(cap_neighbours(edges, 5), names, "node", "neighbour")


@query(
    "k6_capped_sample",
    "r AS (SELECT entity, seq, value, row_number() OVER (PARTITION BY entity ORDER BY seq) AS place, count(*) OVER (PARTITION BY entity) AS total FROM ledger) SELECT entity, seq, place, total FROM r WHERE place <= 3",
    ("ledger",),
)
def _k6(t: Tables) -> DataFrame:
    return capped_sample(t.ledger, "entity", ["seq"], 3).select("entity", "seq", "place", "total")


@query("k8_chunks", "SELECT domain, path, CAST(floor((row_number() OVER (PARTITION BY domain ORDER BY path) - 1) / 12) AS BIGINT) AS chunk FROM files", ("files",))
def _k8(t: Tables) -> DataFrame:
    return chunks(t.files, "domain", ["path"], 12).select("domain", "path", "chunk")


@query(
    "r5_packed",
    """o AS (SELECT domain, path, loc, row_number() OVER (PARTITION BY domain ORDER BY path) AS n FROM files),
p AS (SELECT domain, path, loc, n, CASE WHEN loc <= 200 THEN loc ELSE 0 END AS used, loc <= 200 AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.domain, o.path, o.loc, o.n, CASE WHEN p.used + o.loc <= 200 THEN p.used + o.loc ELSE p.used END, p.used + o.loc <= 200 FROM p JOIN o ON o.domain = p.domain AND o.n = p.n + 1)
SELECT domain, path, loc, kept FROM p""",
    ("files",),
    recursive=True,
)
def _r5(t: Tables) -> DataFrame:
    return packed(t.files, "domain", ["path"], "loc", 200)
