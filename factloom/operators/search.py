"""Search and retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.plans.shared import materialize
from factloom.registry import query

# Weights of the searched fields and the bound of a hit.
FIELDS = {"name": 0.4, "tags": 0.3, "summary": 0.2, "notes": 0.1}
THRESHOLD = 0.4


def fuzzy_search(nodes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Words of the query are alternatives; per word and field the best edit similarity of the
    field's words (0 where it holds the word), weighted; lower is better. Blank finds nothing."""
    words = [w for w in text.lower().split() if w]
    if not words:
        return nodes.select("id").limit(0).withColumn("score", F.lit(0.0))

    def miss(field: str, word: str) -> Column:
        value = F.lower(F.coalesce(field, F.lit("")))
        near = F.transform(F.split(value, r"[^\p{L}\p{N}]+"), lambda x: F.when(x == "", 1.0).otherwise(F.levenshtein(x, F.lit(word)) / F.greatest(F.length(x), F.lit(len(word)))))
        return F.when(value.contains(word), 0.0).otherwise(F.least(F.array_min(near), F.lit(1.0)))

    found = [F.when(miss(f, w) <= THRESHOLD, (miss(f, w) + 0.001) ** weight).otherwise(1.0) for w in words for f, weight in FIELDS.items() if f in nodes.columns]
    bound = F.least(F.lit(1.0), *found)
    return nodes.select("id", F.round(bound, 6).alias("score")).where("score < 1").orderBy("score", "id").limit(limit)


#: Vectors and queries that meet in one task.
VECTOR_ROWS, QUERY_ROWS = 1 << 13, 1 << 10


def semantic_search(vectors: DataFrame, queries: DataFrame, least: float, limit: int = 10, vector_rows: int = VECTOR_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """R2: for each row of ``queries(query, q)`` its nearest vectors by cosine, ``score`` being one less it,
    and their places. A vector without length has a cosine of 0; vectors of another dimension than
    the query's do not meet it.

    Both sides are dealt into blocks of bounded size and every block of vectors meets every block of
    queries in a task of its own, as a matrix product; of these only the nearest of a query go on."""
    v, q = vectors.where("embedding is not null"), queries.where("q is not null")
    v_blocks, q_blocks = max(1, -(-v.count() // vector_rows)), max(1, -(-q.count() // query_rows))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), deal("vec_id", v_blocks).alias("v_block"), each(q_blocks).alias("q_block"))
    right = q.select(F.col("query").cast("long").alias("query"), F.col("q").cast("array<double>").alias("x"), deal("query", q_blocks).alias("q_block"), each(v_blocks).alias("v_block"))

    def by_size(table: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Ids and unit vectors of each dimension."""
        rows, ids = table.column("x").combine_chunks(), table.column(name).to_numpy()
        rows = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows
        sizes, flat = np.diff(rows.offsets.to_numpy()), rows.flatten().to_numpy(zero_copy_only=False)
        out = {}
        for n in np.unique(sizes).tolist():
            mine = sizes == n
            x = np.nan_to_num(flat[np.repeat(mine, sizes)].reshape(-1, n))
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            out[n] = ids[mine], np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        return out

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        ours = by_size(a, "vec_id") if a.num_rows else {}
        for n, (asked, y) in (by_size(b, "query") if b.num_rows else {}).items():
            if n not in ours:
                continue
            ids, x = ours[n]
            near = x @ y.T
            score = np.round(1 - near, 6)
            for k in range(len(asked)):
                some = np.flatnonzero(near[:, k] >= least)
                some = some[np.lexsort((ids[some], score[some, k]))[:limit]]
                found.append((np.full(len(some), asked[k]), ids[some], score[some, k]))
        query_, vec, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query": pa.array(query_, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    d = left.groupBy("v_block", "q_block").cogroup(right.groupBy("v_block", "q_block")).applyInArrow(meet, "query long, vec_id long, score double")
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id")))
    return d.where(F.col("place") <= limit)


def retrieve(items: DataFrame, request: list[str], limit: int) -> DataFrame:
    """Items that hold words of the request, most first; the first ones where none does."""
    hits = sum((F.lower("text").contains(w).cast("int") for w in request), F.lit(0))
    d = items.select("id", hits.alias("hits"))
    # one pass either way: with any hit the rows without one sort behind and are cut
    top = d.orderBy(F.desc("hits"), "id").limit(limit)
    some = top.agg(F.max("hits").alias("most"))
    return top.join(F.broadcast(some)).where("hits > 0 or most = 0").select("id", "hits")


def allocate(axes: DataFrame, budget: int) -> DataFrame:
    """``axes(request, axis, floor, weight)``: floors, then the rest by weight with whole units,
    the remainder one by one in order of axis; floors over the budget shrink in proportion."""
    sums = axes.groupBy("request").agg(F.sum("floor").alias("floors"), F.sum("weight").alias("weights"))
    d = axes.join(sums, "request")
    left = F.greatest(F.lit(budget) - F.col("floors"), F.lit(0))
    base = F.when(F.col("floors") > budget, F.floor(F.col("floor") * budget / F.col("floors"))).otherwise(F.col("floor") + F.floor(left * F.col("weight") / F.col("weights")))
    d = d.withColumn("units", base)
    total = d.groupBy("request").agg(F.sum("units").alias("given"), F.array_sort(F.collect_list("axis")).alias("order"))
    d = d.join(total, "request")
    more = (F.lit(budget) - F.col("given") >= F.array_position("order", F.col("axis"))) & (F.col("floors") <= budget)
    return d.select("request", "axis", (F.col("units") + F.when(more, 1).otherwise(0)).cast("long").alias("units"))


def fill_budget(demands: DataFrame, budgets: DataFrame) -> DataFrame:
    """``demands(request, axis, demand, floor, weight)`` and ``budgets(request, available)`` ->
    ``(request, axis, units)``. Each axis gets its floor, or its demand if that is less; floors over the
    budget shrink in proportion. Then rounds: what is left is shared among the axes that want more,
    by weight in whole units, until nobody wants more or no share comes to a unit; what then is
    left is given to none.

    A request's few axes are a window; all requests take a round together, and there are at most
    some more rounds than axes, since a round without a satisfied axis leaves less than a unit for
    each."""
    w = Window.partitionBy("request")
    need = F.least("demand", "floor")
    d = demands.join(budgets, "request").withColumn("need", need).withColumn("floors", F.sum("need").over(w))
    over = (F.col("floors") > F.col("available")) & (F.col("floors") > 0)
    shrunk = F.expr("need * available div floors")
    d = d.select("request", "axis", "demand", "weight", F.when(over, shrunk).otherwise(F.col("need")).alias("units"), F.when(over, 0).otherwise(F.col("available") - F.col("floors")).cast("long").alias("rest"))
    d = materialize(d, "budget")
    while True:
        d = d.withColumn("hungry", (F.col("demand") > F.col("units")) & (F.col("rest") > 0))
        d = d.withColumn("weights", F.sum(F.when(F.col("hungry"), F.col("weight"))).over(w))
        take = F.when(F.col("hungry"), F.least(F.expr("rest * weight div weights"), F.col("demand") - F.col("units"))).otherwise(0)
        d = d.withColumn("take", take.cast("long")).withColumn("given", F.sum("take").over(w))
        d = materialize(d.select("request", "axis", "demand", "weight", (F.col("units") + F.col("take")).alias("units"), F.when(F.col("given") > 0, F.col("rest") - F.col("given")).otherwise(0).alias("rest")), "budget")
        if d.where("rest > 0 and demand > units").isEmpty():
            return d.select("request", "axis", "units")


@query(
    "r4_fill_budget",
    """x AS (SELECT domain AS request, lang AS axis, sum(loc)::BIGINT AS demand, max(loc) % 37 + 1 AS floor, count(*) % 4 + 1 AS weight FROM files GROUP BY 1, 2), b AS (SELECT domain AS request, (sum(loc) * (CASE WHEN domain LIKE '%3' THEN 1 ELSE 61 END) // 100)::BIGINT AS available FROM files GROUP BY 1),
y AS (SELECT *, least(demand, floor) AS need, sum(least(demand, floor)) OVER (PARTITION BY request) AS floors FROM x JOIN b USING (request)),
r AS (SELECT request, axis, demand, weight, (CASE WHEN floors > available AND floors > 0 THEN need * available // floors ELSE need END)::BIGINT AS units, (CASE WHEN floors > available AND floors > 0 THEN 0 ELSE available - floors END)::BIGINT AS rest, 0 AS k FROM y
  UNION ALL SELECT request, axis, demand, weight, (units + take)::BIGINT, (rest - given)::BIGINT, k + 1 FROM (SELECT *, sum(take) OVER (PARTITION BY request) AS given FROM (
    SELECT *, CASE WHEN demand > units THEN least(rest * weight // sum(CASE WHEN demand > units THEN weight ELSE 0 END) OVER (PARTITION BY request), demand - units) ELSE 0 END AS take FROM r WHERE rest > 0)) WHERE given > 0)
SELECT request, axis, arg_max(units, k) AS units FROM r GROUP BY request, axis""",
    ("files",),
    recursive=True,
)
def _r4b(t: Tables) -> DataFrame:
    demands = t.files.groupBy(F.col("domain").alias("request"), F.col("lang").alias("axis")).agg(F.sum("loc").alias("demand"), (F.max("loc") % 37 + 1).alias("floor"), (F.count("*") % 4 + 1).alias("weight"))
    share = F.when(F.col("request").endswith("3"), 1).otherwise(61)
    budgets = t.files.groupBy(F.col("domain").alias("request")).agg(F.sum("loc").alias("all")).select("request", F.floor(F.col("all") * share / 100).cast("long").alias("available"))
    return fill_budget(demands, budgets)


@query("r1_fuzzy_search")
def _r1(t: Tables) -> DataFrame:
    nodes = t.nodes.select("id", "name", F.col("type").alias("tags"), F.col("file_path").alias("summary"))
    return fuzzy_search(nodes, "controler stock")


@query(
    "r2_semantic_search",
    """q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS sim FROM embeddings, q),
s AS (SELECT query, vec_id, round(1 - sim, 6) AS score FROM d WHERE sim >= 0.1e0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, vec_id) AS place FROM s) WHERE place <= 10""",
)
def _r2(t: Tables) -> DataFrame:
    return semantic_search(t.embeddings, t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 0.1)


@query("r3_retrieve", "SELECT path AS id, CAST(path ILIKE '%order%' AS INT) + CAST(path ILIKE '%service%' AS INT) + CAST(path ILIKE '%.py' AS INT) AS hits FROM files WHERE path ILIKE '%order%' OR path ILIKE '%service%' OR path ILIKE '%.py' ORDER BY hits DESC, id LIMIT 40", ("files",))
def _r3(t: Tables) -> DataFrame:
    return retrieve(t.files.select(F.col("path").alias("id"), F.col("path").alias("text")), ["order", "service", ".py"], 40)


@query(
    "r4_allocate",
    """x AS (SELECT domain AS request, lang AS axis, count(*) AS floor, sum(loc) AS weight FROM files GROUP BY 1, 2), s AS (SELECT request, sum(floor) AS floors, sum(weight) AS weights FROM x GROUP BY 1),
d AS (SELECT request, axis, floors, CASE WHEN floors > 9 THEN floor(floor * 9e0 / floors) ELSE floor + floor((9 - floors) * weight * 1e0 / weights) END AS units, row_number() OVER (PARTITION BY request ORDER BY axis) AS place FROM x JOIN s USING (request)),
g AS (SELECT request, sum(units) AS given FROM d GROUP BY 1)
SELECT request, axis, CAST(units + CASE WHEN 9 - given >= place AND floors <= 9 THEN 1 ELSE 0 END AS BIGINT) AS units FROM d JOIN g USING (request)""",
    ("files",),
)
def _r4(t: Tables) -> DataFrame:
    return allocate(t.files.groupBy(F.col("domain").alias("request"), F.col("lang").alias("axis")).agg(F.count("*").alias("floor"), F.sum("loc").alias("weight")), 9)
