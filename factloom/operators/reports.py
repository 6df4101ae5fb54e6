"""Scores and composite reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.fixtures import Tables, named
from factloom.functions import text as fn
from factloom.operators.aggregates import linked
from factloom.operators.windows import grade_bands, half_up, mid_rank
from factloom.plans.shared import materialize
from factloom.registry import query

# Weights of the risk score, bounds of the update decision and of growth.
RISK_WEIGHTS = {"complexity": 0.25, "churn": 0.25, "loc": 0.15, "fan_in": 0.15, "fan_out": 0.10}
PARTIAL, ARCHITECTURE, FULL = 10, 30, 0.5


def risk(programs: DataFrame) -> DataFrame:
    """``programs(path, <metrics>)`` -> score, grade and top two factors. A NULL metric and
    one without spread drop out and the other weights are scaled up; no metric gives NULL."""
    d = mid_rank(programs, list(RISK_WEIGHTS))
    parts = F.array(*[F.struct(F.lit(m).alias("name"), F.lit(w).alias("weight"), F.when(~F.col(f"{m}_flat"), F.col(f"{m}_rank")).alias("rank")) for m, w in RISK_WEIGHTS.items()])
    d = d.select("path", F.filter(parts, lambda x: x["rank"].isNotNull()).alias("parts"))
    weight = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["weight"])
    value = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["weight"] * x["rank"])
    d = d.withColumn("score", F.when(F.size("parts") > 0, half_up(value / weight, 4)))
    top = F.transform(F.slice(F.array_sort(F.transform("parts", lambda x: F.struct((-x["weight"] * x["rank"]).alias("w"), x["name"].alias("name")))), 1, 2), lambda x: x["name"])
    return grade_bands(d.where("score is not null").select("path", "score", F.array_join(top, ",").alias("factors")), "score")


def precedents(flows: DataFrame, hints: DataFrame, entities: DataFrame, operations: DataFrame) -> DataFrame:
    """``flows(flow, tokens, complete)`` scored: 100 if the tokens hold a whole hint, 40 if part
    of one, 20 for an entity word, 8 for an operation word, 5 for a complete slice. Hints are few
    and matched by word, so flows meet only hints that share one."""
    words = flows.select("flow", F.explode("tokens").alias("word"))
    h = hints.select("hint", F.explode("tokens").alias("word"), F.size("tokens").alias("n"))
    hit = words.join(h, "word").groupBy("flow", "hint", "n").agg(F.count_distinct("word").alias("k"))
    hit = hit.groupBy("flow").agg(F.max(F.when(F.col("k") == F.col("n"), 100).otherwise(40)).alias("domain"))
    ent = words.join(entities, "word", "left_semi").select("flow").distinct().withColumn("entity", F.lit(20))
    ops = words.join(operations, "word", "left_semi").select("flow").distinct().withColumn("operation", F.lit(8))
    d = flows.join(hit, "flow", "left").join(ent, "flow", "left").join(ops, "flow", "left")
    score = F.coalesce("domain", F.lit(0)) + F.coalesce("entity", F.lit(0)) + F.coalesce("operation", F.lit(0)) + F.when(F.col("complete"), 5).otherwise(0)
    return d.select("flow", score.alias("score"), F.when(F.col("domain") == 100, "strong").otherwise("partial").alias("strength")).where("domain > 0 or entity > 0 or operation > 0")


def requirement_fold(changes: DataFrame) -> DataFrame:
    """``changes(fn, req, verb, withdrawn)``: per function its history and the last requirement
    that is not withdrawn, in natural order of requirement."""
    key = F.struct(F.length("req"), "req")
    head = F.max_by(F.when(~F.col("withdrawn"), F.struct("req", "verb")), F.when(~F.col("withdrawn"), key))
    d = changes.groupBy("fn").agg(head.alias("head"), F.count("*").alias("n"))
    state = F.when(F.col("head").isNull(), "untouched").when(F.col("head.verb") == "R", "removed").when(F.col("head.verb") == "A", "planned").otherwise("changed")
    return d.select("fn", F.col("head.req").alias("req"), state.alias("state"), "n")


def requirement_coverage(reqs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per requirement its functions, how many are implemented and tested; one without
    functions is not implemented."""
    d = targets.groupBy("req").agg(F.count("*").alias("fns"), F.sum(F.col("implemented").cast("int")).alias("done"), F.bool_and("implemented").alias("implemented"), F.bool_and("tested").alias("tested"))
    false = F.lit(False)
    return reqs.join(d, "req", "left").select("req", F.coalesce("fns", F.lit(0)).alias("fns"), F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("implemented", false).alias("implemented"), (F.coalesce("implemented", false) & F.coalesce("tested", false)).alias("verified"))


def update_decision(before: DataFrame, after: DataFrame) -> DataFrame:
    """C17: one row: SKIP, PARTIAL, ARCHITECTURE or FULL from the changed files and new top
    directories; a deleted file alone triggers nothing."""
    d = before.select("path", F.col("hash").alias("h1")).join(after.select("path", F.col("hash").alias("h2")), "path", "full_outer")
    top = F.substring_index("path", "/", 2)
    counts = d.agg(F.count_if(F.col("h1").isNull() | (F.col("h2").isNotNull() & (F.col("h1") != F.col("h2")))).alias("changed"), F.count("h1").alias("total"), (F.count_distinct(top) - F.count_distinct(F.when(F.col("h1").isNotNull(), top))).alias("new_dirs"))
    what = F.when(F.col("changed") == 0, "SKIP").when(F.col("changed") > F.col("total") * FULL, "FULL").when((F.col("changed") > ARCHITECTURE) | (F.col("new_dirs") > 0), "ARCHITECTURE").otherwise("PARTIAL")
    return counts.select("changed", "total", "new_dirs", what.alias("decision"))


def fingerprint_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per path and function: added, removed, params or size (by over half up or down)."""
    d = before.toDF("path", "fn", "p1", "s1").join(after.toDF("path", "fn", "p2", "s2"), ["path", "fn"], "full_outer")
    detail = F.when(F.col("p1").isNull(), "added").when(F.col("p2").isNull(), "removed").when(F.col("p1") != F.col("p2"), "params").when((F.col("s2") > F.col("s1") * 1.5) | (F.col("s2") < F.col("s1") * 0.5), "size")
    d = d.withColumn("detail", F.concat_ws(":", detail, "fn")).where(detail.isNotNull())
    return d.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("detail")), ",").alias("details"), F.lit("STRUCTURAL").alias("level"))


def golden_score(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: recall of golden keys, their values that agree, and extra keys; NULL ratios
    where there is nothing to score."""
    d = golden.toDF("key", "g").join(candidate.toDF("key", "c"), "key", "full_outer")
    both = F.col("g").isNotNull() & F.col("c").isNotNull()
    n = F.nullif(F.count("g"), F.lit(0))
    return d.agg(half_up(F.count_if(both) / n, 4).alias("recall"), half_up(F.count_if(both & (F.col("g") == F.col("c"))) / F.nullif(F.count_if(both), F.lit(0)), 4).alias("citations"), F.count_if(F.col("g").isNull()).alias("extras"))


def oracle_recall(must: DataFrame, forbidden: DataFrame, found: DataFrame) -> DataFrame:
    """Per seed, how much of what it must reach is found and how much forbidden leaks."""
    f = found.select("seed", "id", F.lit(1).alias("hit")).distinct()
    m = must.join(f, ["seed", "id"], "left").groupBy("seed").agg(F.count("*").alias("must"), F.count("hit").alias("hit"))
    leak = forbidden.join(f, ["seed", "id"]).groupBy("seed").agg(F.count("*").alias("leaks"))
    return m.join(leak, "seed", "left").select("seed", "must", "hit", F.coalesce("leaks", F.lit(0)).alias("leaks"))


def scenarios(functions: DataFrame) -> DataFrame:
    """C11: three test scenarios per function with hashed ids."""
    kinds = F.array(*[F.lit(k) for k in ("normal", "exception", "boundary")])
    return functions.select("fn", F.explode(kinds).alias("kind")).withColumn("id", fn.hash_id("ts", F.col("fn"), F.col("kind")))


_METRICS = """p AS (SELECT f.path, CASE WHEN domain = 'brand11' THEN NULL ELSE seq % 17 END AS complexity, c.lines AS churn, loc, i.n AS fan_in, o.n AS fan_out FROM files f
  LEFT JOIN (SELECT path, sum(added + deleted) AS lines FROM commits GROUP BY path) c USING (path)
  LEFT JOIN (SELECT target, count(DISTINCT source) AS n FROM file_edges WHERE source <> target AND kind IN ('call', 'import') GROUP BY target) i ON i.target = f.path
  LEFT JOIN (SELECT source, count(DISTINCT target) AS n FROM file_edges WHERE source <> target AND kind IN ('call', 'import') GROUP BY source) o ON o.source = f.path)"""
_RANKS = ", ".join(
    f"CASE WHEN {m} IS NOT NULL THEN floor((rank() OVER (ORDER BY {m} NULLS LAST) - 1 + (count(*) OVER (PARTITION BY {m}) - 1) / 2e0) / (count({m}) OVER () - 1) * 10000 + 0.5) / 10000 END AS {m}_r" for m in RISK_WEIGHTS
)
_TOP = " UNION ALL ".join(f"SELECT path, '{m}' AS name, {w}e0 AS w, {m}_r AS r FROM k" for m, w in RISK_WEIGHTS.items())


@query(
    "c1_risk_report",
    f"""{_METRICS}, k AS (SELECT path, {_RANKS} FROM p), x AS (SELECT * FROM ({_TOP}) WHERE r IS NOT NULL),
s AS (SELECT path, floor(sum(w * r) / sum(w) * 10000 + 0.5) / 10000 AS score FROM x GROUP BY path), g AS (SELECT *, rank() OVER (ORDER BY score DESC) - 1 AS place, count(*) OVER () AS n FROM s)
SELECT path, score, CASE WHEN place < greatest(ceil(n * 0.1e0), 1) THEN 'high' WHEN place < ceil(n * 0.3e0) THEN 'medium' ELSE 'low' END AS grade FROM g""",
    ("files", "commits", "file_edges"),
)
def _c1(t: Tables) -> DataFrame:
    edges, names = t.numbered_edges()
    pairs = materialize(linked(edges, ("call", "import")), "pairs")
    fan = lambda end, name: named(pairs.groupBy(F.col(end).alias("path")).agg(F.count("*").alias(name)), names, "path")
    p = t.files.select("path", F.when(F.col("domain") != "brand11", F.col("seq") % 17).alias("complexity"), "loc")
    p = p.join(t.commits.groupBy("path").agg(F.sum(F.col("added") + F.col("deleted")).alias("churn")), "path", "left")
    p = p.join(fan("target", "fan_in"), "path", "left").join(fan("source", "fan_out"), "path", "left")
    return risk(p).select("path", "score", "grade")


@query(
    "c2_precedents",
    """f AS (SELECT path AS flow, lower(domain) AS d, lang, CASE seq % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'item' ELSE 'stock' END AS what, seq % 5 = 0 AS complete FROM files),
s AS (SELECT flow, CASE WHEN d = 'brand11' AND what = 'order' THEN 100 WHEN d = 'brand11' OR what = 'order' THEN 40 END AS domain, CASE WHEN what = 'item' THEN 20 END AS entity, CASE WHEN lang = 'sql' THEN 8 END AS operation, complete FROM f)
SELECT flow, coalesce(domain, 0) + coalesce(entity, 0) + coalesce(operation, 0) + CASE WHEN complete THEN 5 ELSE 0 END AS score, CASE WHEN domain = 100 THEN 'strong' ELSE 'partial' END AS strength FROM s WHERE domain > 0 OR entity > 0 OR operation > 0""",
    ("files",),
)
def _c2(t: Tables) -> DataFrame:
    what = F.when(F.col("seq") % 3 == 0, "order").when(F.col("seq") % 3 == 1, "item").otherwise("stock")
    flows = t.files.select(F.col("path").alias("flow"), F.array("domain", "lang", what).alias("tokens"), (F.col("seq") % 5 == 0).alias("complete"))
    one = lambda w: t.spark.createDataFrame([(w,)], "word string")
    hints = t.spark.createDataFrame([("h", ["brand11", "order"])], "hint string, tokens array<string>")
    return precedents(flows, hints, one("item"), one("sql"))


_CHANGES = "c AS (SELECT concat('fn', l_partkey) AS fn, concat('R', l_orderkey) AS req, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'R' END AS verb, o_orderstatus = 'F' AS withdrawn FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1)"


@query(
    "c7_requirement_fold",
    f"""{_CHANGES}, l AS (SELECT fn, arg_max(struct_pack(req := req, verb := verb), struct_pack(n := length(req), req := req)) FILTER (WHERE NOT withdrawn) AS head, count(*) AS n FROM c GROUP BY fn)
SELECT fn, head.req AS req, CASE WHEN head IS NULL THEN 'untouched' WHEN head.verb = 'R' THEN 'removed' WHEN head.verb = 'A' THEN 'planned' ELSE 'changed' END AS state, n FROM l""",
)
def _c7(t: Tables) -> DataFrame:
    verb = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "M").otherwise("R")
    d = t.lineitem.where("l_linenumber = 1").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return requirement_fold(d.select(F.concat(F.lit("fn"), F.col("l_partkey").cast("string")).alias("fn"), F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("req"), verb.alias("verb"), (F.col("o_orderstatus") == "F").alias("withdrawn")))


@query(
    "c8_requirement_coverage",
    """x AS (SELECT l_orderkey AS req, count(*) AS fns, count(*) FILTER (WHERE l_returnflag <> 'R') AS done, bool_and(l_returnflag <> 'R') AS implemented, bool_and(l_linestatus = 'O') AS tested FROM lineitem GROUP BY 1)
SELECT o_orderkey AS req, coalesce(fns, 0) AS fns, coalesce(done, 0) AS done, coalesce(implemented, FALSE) AS implemented, coalesce(implemented AND tested, FALSE) AS verified FROM orders LEFT JOIN x ON req = o_orderkey""",
)
def _c8(t: Tables) -> DataFrame:
    targets = t.lineitem.select(F.col("l_orderkey").alias("req"), (F.col("l_returnflag") != "R").alias("implemented"), (F.col("l_linestatus") == "O").alias("tested"))
    return requirement_coverage(t.orders.select(F.col("o_orderkey").alias("req")), targets)


@query("c11_scenarios", "SELECT path AS fn, kind, concat('ts:', substr(sha256(concat(path, chr(0), kind)), 1, 8)) AS id FROM files, (VALUES ('normal'), ('exception'), ('boundary')) k(kind)", ("files",))
def _c11(t: Tables) -> DataFrame:
    return scenarios(t.files.select(F.col("path").alias("fn")))


@query(
    "c17_update_decision",
    """b AS (SELECT path, loc AS hash FROM files WHERE seq % 11 > 0), a AS (SELECT path, CASE WHEN seq % 7 = 0 THEN loc + 1 ELSE loc END AS hash FROM files WHERE seq % 13 > 0),
d AS (SELECT path, b.hash AS h1, a.hash AS h2, array_to_string(string_split(path, '/')[1:2], '/') AS top FROM b FULL JOIN a USING (path)),
c AS (SELECT count(*) FILTER (WHERE h1 IS NULL OR (h2 IS NOT NULL AND h1 <> h2)) AS changed, count(h1) AS total, count(DISTINCT top) - count(DISTINCT top) FILTER (WHERE h1 IS NOT NULL) AS new_dirs FROM d)
SELECT *, CASE WHEN changed = 0 THEN 'SKIP' WHEN changed > total * 0.5e0 THEN 'FULL' WHEN changed > 30 OR new_dirs > 0 THEN 'ARCHITECTURE' ELSE 'PARTIAL' END AS decision FROM c""",
    ("files",),
)
def _c17(t: Tables) -> DataFrame:
    f = t.files
    return update_decision(f.where("seq % 11 > 0").select("path", F.col("loc").alias("hash")), f.where("seq % 13 > 0").select("path", F.when(F.col("seq") % 7 == 0, F.col("loc") + 1).otherwise(F.col("loc")).alias("hash")))


@query(
    "c18_fingerprint_changes",
    """b AS (SELECT domain AS path, path AS fn, seq % 4 AS p, loc AS s FROM files WHERE seq % 9 > 0), a AS (SELECT domain AS path, path AS fn, CASE WHEN seq % 5 = 0 THEN 9 ELSE seq % 4 END AS p, CASE WHEN seq % 3 = 0 THEN loc * 2 ELSE loc END AS s FROM files WHERE seq % 8 > 0),
d AS (SELECT path, fn, CASE WHEN b.p IS NULL THEN 'added' WHEN a.p IS NULL THEN 'removed' WHEN a.p <> b.p THEN 'params' WHEN a.s > b.s * 1.5e0 OR a.s < b.s * 0.5e0 THEN 'size' END AS detail FROM b FULL JOIN a USING (path, fn))
SELECT path, string_agg(concat(detail, ':', fn), ',' ORDER BY concat(detail, ':', fn)) AS details, 'STRUCTURAL' AS level FROM d WHERE detail IS NOT NULL GROUP BY path""",
    ("files",),
)
def _c18(t: Tables) -> DataFrame:
    f, n = t.files, F.col("seq")
    before = f.where("seq % 9 > 0").select(F.col("domain"), F.col("path").alias("fn"), (n % 4).alias("p"), "loc")
    return fingerprint_changes(before, f.where("seq % 8 > 0").select("domain", F.col("path").alias("fn"), F.when(n % 5 == 0, 9).otherwise(n % 4).alias("p"), F.when(n % 3 == 0, F.col("loc") * 2).otherwise(F.col("loc")).alias("s")))


@query(
    "c22_golden_score",
    """g AS (SELECT path AS key, loc AS v FROM files WHERE seq % 3 > 0), c AS (SELECT path AS key, CASE WHEN seq % 10 = 1 THEN 0 ELSE loc END AS v FROM files WHERE seq % 4 > 0)
SELECT floor(count(*) FILTER (WHERE g.v IS NOT NULL AND c.v IS NOT NULL) * 1e0 / count(g.v) * 10000 + 0.5) / 10000 AS recall,
  floor(count(*) FILTER (WHERE g.v = c.v) * 1e0 / count(*) FILTER (WHERE g.v IS NOT NULL AND c.v IS NOT NULL) * 10000 + 0.5) / 10000 AS citations, count(*) FILTER (WHERE g.v IS NULL) AS extras FROM g FULL JOIN c USING (key)""",
    ("files",),
)
def _c22(t: Tables) -> DataFrame:
    return golden_score(t.files.where("seq % 3 > 0").select("path", "loc"), t.files.where("seq % 4 > 0").select("path", F.when(F.col("seq") % 10 == 1, 0).otherwise(F.col("loc"))))


@query(
    "c23_oracle_recall",
    """f AS (SELECT DISTINCT source AS seed, target AS id FROM file_edges WHERE kind <> 'data'), m AS (SELECT DISTINCT source AS seed, target AS id FROM file_edges WHERE line < 3), b AS (SELECT DISTINCT source AS seed, target AS id FROM file_edges WHERE line = 5),
x AS (SELECT m.seed, count(*) AS must, count(f.id) AS hit FROM m LEFT JOIN f USING (seed, id) GROUP BY 1), y AS (SELECT seed, count(*) AS leaks FROM b JOIN f USING (seed, id) GROUP BY 1)
SELECT seed, must, hit, coalesce(leaks, 0) AS leaks FROM x LEFT JOIN y USING (seed)""",
    ("file_edges",),
)
def _c23(t: Tables) -> DataFrame:
    pairs = lambda c: t.file_edges.where(c).select(F.col("source").alias("seed"), F.col("target").alias("id")).distinct()
    return oracle_recall(pairs("line < 3"), pairs("line = 5"), pairs("kind <> 'data'"))
