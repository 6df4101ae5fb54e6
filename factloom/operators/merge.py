"""Graph hygiene and merging (N1-N20 without N14 and N18, U1-U9, Q1-Q8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.functions import text as fn
from factloom.operators.windows import keep_heaviest, keep_last
from factloom.plans.shared import spread
from factloom.registry import query


def normalise_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical ids, types, complexities and weights; the last node of an id and the first
    edge of a key stay; dangling edges go."""
    n = nodes.select(fn.node_id(F.col("id")).alias("id"), fn.alias(F.col("type"), fn.NODE_TYPES).alias("type"), "name", fn.complexity(F.col("complexity")).alias("complexity"), "seq")
    n = keep_last(n, ["id"])
    e = edges.select(fn.node_id(F.col("source")).alias("source"), fn.node_id(F.col("target")).alias("target"), fn.alias(F.col("type"), fn.EDGE_TYPES).alias("type"), fn.weight(F.col("weight")).alias("weight"), "seq")
    e = e.groupBy("source", "target", "type").agg(F.min_by("weight", "seq").alias("weight"), F.min("seq").alias("seq"))
    ids = n.select("id")
    e = e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return n, e


def merge_groups(groups: DataFrame) -> DataFrame:
    """Node ids of groups of one name as one list, first occurrence first."""
    d = groups.groupBy("layer", "node_id").agg(F.min("pos").alias("pos"))
    return d.groupBy("layer").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]), ",").alias("ids"))


def merge_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """U4: edges with the ends of equally named entities made one, the first edge of a key."""
    norm = F.lower(fn.squeeze(F.col("name")))
    first = entities.groupBy(norm.alias("norm")).agg(F.min_by("id", "seq").alias("to"))
    remap = entities.select("id", norm.alias("norm")).join(first, "norm").select("id", "to")
    e = edges.join(remap.toDF("source", "s"), "source").join(remap.toDF("target", "t"), "target").where("s <> t")
    return e.groupBy(F.col("s").alias("source"), F.col("t").alias("target"), "kind").agg(F.min("seq").alias("seq"))


def audit(expected: DataFrame, covered: DataFrame) -> DataFrame:
    """Per chunk, how much is missing and why it counts as incomplete."""
    d = expected.join(covered.select("chunk", "item", F.lit(1).alias("has")).distinct(), ["chunk", "item"], "left")
    d = d.groupBy("chunk").agg(F.count("*").alias("expected"), F.count("has").alias("covered"))
    return d.withColumn("reason", F.when(F.col("covered") == 0, "empty").when(F.col("covered") < F.col("expected"), "partial").otherwise("complete"))


def declared_first(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """First row of each declared id; ``dropped`` counts the others."""
    d = rows.join(declared.select("id", F.lit(1).alias("ok")).distinct(), "id", "left")
    kept = d.where("ok is not null").groupBy("id").agg(F.min_by("name", "seq").alias("name"), (F.count("*") - 1).alias("dropped"))
    return kept


def drift(plan: DataFrame, candidates: DataFrame) -> DataFrame:
    """Roots that only one side has."""
    new, gone = candidates.select("root").subtract(plan.select("root")), plan.select("root").subtract(candidates.select("root"))
    return new.withColumn("drift", F.lit("new")).union(gone.withColumn("drift", F.lit("gone")))


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q1, Q2: everything that is wrong with a graph, a row for each finding and key."""
    dup = nodes.groupBy("id").count().where("count > 1").select(F.lit("duplicate-id").alias("issue"), F.col("id").alias("key"))
    bad = nodes.where(F.col("complexity").isNull()).select(F.lit("no-complexity").alias("issue"), "id")
    weights = edges.where(F.col("weight").isNull() | F.col("weight").try_cast("double").isNull() | ~F.col("weight").try_cast("double").between(0, 1)).select(F.lit("weight").alias("issue"), F.col("seq").cast("string"))
    ids = nodes.select("id").distinct()
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    dangling = ends.join(ids, "id", "left_anti").select(F.lit("dangling").alias("issue"), "id")
    orphan = ids.join(ends, "id", "left_anti").select(F.lit("orphan").alias("issue"), "id")
    return dup.union(bad).union(weights).union(dangling).union(orphan)


def table_hash(df: DataFrame) -> DataFrame:
    """Q7: content hash of a table that neither row order nor partitions change."""
    columns = sorted(df.columns)
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("hash"))


def requirement_diagnostics(reqs: DataFrame, links: DataFrame) -> DataFrame:
    """Q3: duplicates, dangling references and live requirements that need a withdrawn one."""
    dup = reqs.groupBy("req").count().where("count > 1").select("req", F.lit("duplicate").alias("issue"))
    dangling = links.join(reqs.select("req"), links.needs == reqs.req, "left_anti").select("req", F.lit("dangling").alias("issue"))
    off = reqs.where("withdrawn").select(F.col("req").alias("needs")).distinct()
    on = links.join(reqs.where("not withdrawn").select("req"), "req", "left_semi").join(off, "needs", "left_semi").select("req", F.lit("needs-withdrawn").alias("issue"))
    return dup.union(dangling).union(on).distinct()


_ALIASES = {k: " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.items()) for k, t in (("n", fn.NODE_TYPES), ("e", fn.EDGE_TYPES))}
_CLEAN_ID = "regexp_replace(regexp_replace({0}, '^proj:', ''), '^(file:)+', 'file:')"
_GRAPH = f"""n0 AS (SELECT {_CLEAN_ID.format('id')} AS id, CASE lower(type) {_ALIASES['n']} ELSE lower(type) END AS type, name,
  CASE complexity WHEN 'LOW' THEN 'simple' WHEN 'easy' THEN 'simple' WHEN 'hard' THEN 'complex' WHEN '7' THEN 'complex' WHEN '2' THEN 'simple' WHEN 'simple' THEN 'simple' WHEN 'complex' THEN 'complex' ELSE 'moderate' END AS complexity, seq FROM raw_nodes),
n AS (SELECT id, arg_max(type, seq) AS type, arg_max(name, seq) AS name, arg_max(complexity, seq) AS complexity, max(seq) AS seq FROM n0 GROUP BY id),
e0 AS (SELECT {_CLEAN_ID.format('source')} AS source, target, CASE lower(type) {_ALIASES['e']} ELSE lower(type) END AS type, CASE WHEN TRY_CAST(weight AS DOUBLE) IS NULL OR isnan(TRY_CAST(weight AS DOUBLE)) THEN 0.5e0 ELSE least(greatest(TRY_CAST(weight AS DOUBLE), 0e0), 1e0) END AS weight, seq FROM raw_edges),
e AS (SELECT source, target, type, arg_min(weight, seq) AS weight, min(seq) AS seq FROM e0 WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) GROUP BY source, target, type)"""


@query("u1_normalise_nodes", f"{_GRAPH} SELECT id, type, name, complexity FROM n", ("raw_nodes", "raw_edges"))
def _u1(t: Tables) -> DataFrame:
    return normalise_graph(t.raw_nodes, t.raw_edges)[0].select("id", "type", "name", "complexity")


@query("u1_normalise_edges", f"{_GRAPH} SELECT * FROM e", ("raw_nodes", "raw_edges"))
def _u1b(t: Tables) -> DataFrame:
    return normalise_graph(t.raw_nodes, t.raw_edges)[1]


@query("u2_merge_heaviest", f"{_GRAPH} SELECT source, target, type, max(weight) AS weight FROM e0 GROUP BY source, target, type", ("raw_nodes", "raw_edges"))
def _u2(t: Tables) -> DataFrame:
    e = t.raw_edges.select(fn.node_id(F.col("source")).alias("source"), fn.node_id(F.col("target")).alias("target"), fn.alias(F.col("type"), fn.EDGE_TYPES).alias("type"), fn.weight(F.col("weight")).alias("weight"), "seq")
    return keep_heaviest(e, ["source", "target", "type"]).drop("seq")


@query(
    "u3_merge_groups",
    "d AS (SELECT CASE WHEN pos % 2 = 0 THEN layer ELSE concat(left(layer, 6), '*') END AS layer, node_id, min(pos) AS pos FROM memberships GROUP BY 1, 2) SELECT layer, string_agg(node_id, ',' ORDER BY pos, node_id) AS ids FROM d GROUP BY layer",
    ("memberships",),
)
def _u3(t: Tables) -> DataFrame:
    return merge_groups(t.memberships.withColumn("layer", F.when(F.col("pos") % 2 == 0, F.col("layer")).otherwise(F.concat(F.substring("layer", 1, 6), F.lit("*")))))


@query(
    "u4_merge_entities",
    """x AS (SELECT path AS id, concat(domain, ' ', CASE WHEN seq % 2 = 0 THEN ' ' ELSE '' END, lang) AS name, seq FROM files), f AS (SELECT concat_ws(' ', split_part(name, ' ', 1), regexp_extract(name, '[a-z]+$')) AS norm, id, seq FROM x),
m AS (SELECT id, first_value(id) OVER (PARTITION BY norm ORDER BY seq) AS t FROM f)
SELECT a.t AS source, b.t AS target, kind, min(seq) AS seq FROM file_edges JOIN m a ON a.id = source JOIN m b ON b.id = target WHERE a.t <> b.t GROUP BY ALL""",
    ("files", "file_edges"),
)
def _u4(t: Tables) -> DataFrame:
    entities = t.files.select(F.col("path").alias("id"), F.concat("domain", F.lit(" "), F.when(F.col("seq") % 2 == 0, " ").otherwise(""), "lang").alias("name"), "seq")
    return merge_entities(entities, t.file_edges)


@query(
    "u6_audit",
    """x AS (SELECT domain AS chunk, path AS item, seq % 3 > 0 AND domain > 'brand2' AS has FROM files), d AS (SELECT chunk, count(*) AS expected, count(*) FILTER (WHERE has) AS covered FROM x GROUP BY chunk)
SELECT *, CASE WHEN covered = 0 THEN 'empty' WHEN covered < expected THEN 'partial' ELSE 'complete' END AS reason FROM d""",
    ("files",),
)
def _u6(t: Tables) -> DataFrame:
    items = t.files.select(F.col("domain").alias("chunk"), F.col("path").alias("item"), "seq")
    return audit(items.drop("seq"), items.where("seq % 3 > 0 and chunk > 'brand2'"))


@query("u7_declared_first", "SELECT id, arg_min(name, seq) AS name, count(*) - 1 AS dropped FROM raw_nodes WHERE id IN (SELECT concat('file:', seq) FROM files WHERE seq % 4 < 3) GROUP BY id", ("files", "raw_nodes"))
def _u7(t: Tables) -> DataFrame:
    return declared_first(t.raw_nodes, t.files.where("seq % 4 < 3").select(F.concat(F.lit("file:"), F.col("seq").cast("string")).alias("id")))


@query("u9_drift", "SELECT path AS root, CASE WHEN seq % 3 = 0 THEN 'new' ELSE 'gone' END AS drift FROM files WHERE (seq % 3 = 0) <> (seq % 2 = 0)", ("files",))
def _u9(t: Tables) -> DataFrame:
    f = t.files.select(F.col("path").alias("root"), "seq")
    return drift(f.where("seq % 2 = 0"), f.where("seq % 3 = 0"))


@query(
    "q1_graph_issues",
    """i AS (SELECT DISTINCT id FROM raw_nodes), x AS (SELECT source AS id FROM raw_edges UNION SELECT target FROM raw_edges)
SELECT 'duplicate-id' AS issue, id AS key FROM raw_nodes GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'no-complexity', id FROM raw_nodes WHERE complexity IS NULL
UNION ALL SELECT 'weight', CAST(seq AS VARCHAR) FROM raw_edges WHERE TRY_CAST(weight AS DOUBLE) IS NULL OR TRY_CAST(weight AS DOUBLE) NOT BETWEEN 0 AND 1
UNION ALL SELECT 'dangling', id FROM x WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT 'orphan', id FROM i WHERE id NOT IN (SELECT id FROM x)""",
    ("raw_nodes", "raw_edges"),
)
def _q1(t: Tables) -> DataFrame:
    return issues(t.raw_nodes, t.raw_edges)


@query(
    "q3_requirement_diagnostics",
    """r AS (SELECT o_orderkey AS req, o_orderstatus = 'F' AS withdrawn FROM orders UNION ALL SELECT o_orderkey, FALSE FROM orders WHERE o_orderkey % 50 = 0), l AS (SELECT DISTINCT l_orderkey AS req, l_orderkey + l_linenumber * 3 AS needs FROM lineitem)
SELECT req, 'duplicate' AS issue FROM r GROUP BY req HAVING count(*) > 1 UNION SELECT req, 'dangling' FROM l WHERE needs NOT IN (SELECT req FROM r)
UNION SELECT req, 'needs-withdrawn' FROM l WHERE req IN (SELECT req FROM r WHERE NOT withdrawn) AND needs IN (SELECT req FROM r WHERE withdrawn)""",
)
def _q3(t: Tables) -> DataFrame:
    reqs = t.orders.select(F.col("o_orderkey").alias("req"), (F.col("o_orderstatus") == "F").alias("withdrawn"))
    reqs = reqs.union(t.orders.where("o_orderkey % 50 = 0").select("o_orderkey", F.lit(False)))
    reqs = spread(reqs, t.rows("lineitem"), "req")
    links = spread(t.lineitem.select(F.col("l_orderkey").alias("req"), (F.col("l_orderkey") + F.col("l_linenumber") * 3).alias("needs")), t.rows("lineitem"), "req").distinct()
    return requirement_diagnostics(reqs, links)


@query(
    "n_path_functions",
    r"""SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS stem, path AS normal, regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g') AS slug,
  concat('program:', substr(sha256(path), 1, 8)) AS id, CASE WHEN loc <= 8 THEN 'simple' WHEN loc <= 20 THEN 'moderate' ELSE 'complex' END AS band FROM files""",
    ("files",),
)
def _n6(t: Tables) -> DataFrame:
    p = F.col("path")
    messy = F.concat(F.lit("./a/../"), F.replace(p, F.lit("/"), F.lit("//")))
    return t.files.select("path", fn.dirname(p).alias("dir"), fn.stem(p).alias("stem"), fn.normal_path(messy).alias("normal"), fn.slug(p).alias("slug"), fn.hash_id("program", p).alias("id"), fn.band(F.col("loc"), 8, 20).alias("band"))


@query(
    "n_text_functions",
    r"""SELECT doc_id, line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS squeezed, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[^\p{L}\p{N}]+'), lambda x: length(x) > 1 AND x NOT IN ('the', 'and', 'for', 'with', 'this', 'that')))), ' '), '') AS tokens FROM lines""",
    ("lines",),
)
def _n5(t: Tables) -> DataFrame:
    return t.lines.select("doc_id", "line_no", fn.squeeze(F.col("line")).alias("squeezed"), F.array_join(fn.request_tokens(F.col("line")), " ").alias("tokens"))
