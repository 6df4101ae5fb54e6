"""Tiered repair of graphs, inline review, requirement diagnostics (Q1-Q3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.functions import text as fn
from factloom.operators.traces import has_cycle
from factloom.plans.shared import materialize
from factloom.registry import query

# The types, complexities and directions that a graph may have, and the types that stand for files.
NODE_TYPES = (
    "file", "function", "class", "module", "concept", "config", "document", "service", "table", "endpoint",
    "pipeline", "schema", "resource", "domain", "flow", "step", "article", "entity", "topic", "claim", "source",
)
EDGE_TYPES = (
    "imports", "exports", "contains", "inherits", "implements", "calls", "subscribes", "publishes", "middleware",
    "reads_from", "writes_to", "transforms", "validates", "depends_on", "tested_by", "configures", "related", "similar_to",
    "deploys", "serves", "provisions", "triggers", "migrates", "documents", "routes", "defines_schema",
    "contains_flow", "flow_step", "cross_domain", "cites", "contradicts", "builds_on", "exemplifies", "categorized_under", "authored_by",
)
COMPLEXITIES = ("simple", "moderate", "complex")
DIRECTIONS = ("forward", "backward", "bidirectional")
FILE_TYPES = ("file", "config", "document", "service", "pipeline", "table", "schema", "resource", "endpoint")

_ISSUE = "struct<level: string, category: string, part: string, seq: bigint, field: string, was: string, now: string>"


def _aliased(column: Column, table: dict[str, str]) -> Column:
    """Through an alias table of lower-case names; itself if unknown."""
    low = F.lower(column)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), low), low)


def _blank(column: Column) -> Column:
    return column.isNull() | (column == "")


def _issue(when: Column, level: str, category: Column | str, part: str, field: str, was: Column | str, now: Column | str) -> Column:
    """A finding, null where it does not hold."""
    text = lambda c: F.lit(c) if isinstance(c, str) else c.cast("string")
    row = F.struct(F.lit(level), text(category), F.lit(part), F.col("seq").cast("bigint"), F.lit(field), text(was), text(now))
    return F.when(when, row.cast(_ISSUE))


def _number(column: Column) -> Column:
    """The number that a text begins with; null without one."""
    return F.regexp_extract(F.trim(column), r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", 0).try_cast("double")


def repair_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q1: ``nodes(seq, id, type, name, complexity, tags, summary)`` and ``edges(seq, source, target, type,
    direction, weight)`` -> nodes, edges and ``issues(level, category, part, seq, field, was, now)``.

    Tiers, one column pipeline: types, complexities and directions in lower case and without
    aliases; what lacks gets a default, text weights become numbers, weights outside of 0 to 1 are
    clamped, each ``auto-corrected``; nodes and edges that still break the schema, then edges with an
    end that no kept node is, are ``dropped``; a graph without a valid node is ``fatal``."""
    n = nodes.withColumns({"_type": _aliased(F.col("type"), fn.NODE_TYPES), "_complexity": F.lower("complexity")})
    complexity = F.when(_blank(F.col("_complexity")), "moderate").otherwise(_aliased(F.col("_complexity"), fn.COMPLEXITIES))
    n = n.withColumns(
        {
            "new_type": F.when(_blank(F.col("_type")), "file").otherwise(F.col("_type")),
            "new_complexity": complexity,
            "new_tags": F.coalesce("tags", F.array().cast("array<string>")),
            "new_summary": F.when(~_blank(F.col("summary")), F.col("summary")).when(~_blank(F.col("name")), F.col("name")).otherwise("No summary"),
        }
    )
    valid = F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("new_type").isin(*NODE_TYPES) & F.col("new_complexity").isin(*COMPLEXITIES)
    found = F.array_compact(
        F.array(
            _issue(_blank(F.col("_type")), "auto-corrected", "missing-field", "nodes", "type", F.col("type"), "file"),
            _issue(_blank(F.col("_complexity")), "auto-corrected", "missing-field", "nodes", "complexity", F.col("complexity"), "moderate"),
            _issue(F.col("_complexity").isin(*fn.COMPLEXITIES), "auto-corrected", "alias", "nodes", "complexity", F.col("_complexity"), complexity),
            _issue(F.col("tags").isNull(), "auto-corrected", "missing-field", "nodes", "tags", F.lit(None), "[]"),
            _issue(_blank(F.col("summary")), "auto-corrected", "missing-field", "nodes", "summary", F.col("summary"), F.col("new_summary")),
            _issue(~valid, "dropped", "invalid-node", "nodes", "", F.col("id"), F.lit(None)),
        )
    )
    n = materialize(n.select("seq", "id", F.col("new_type").alias("type"), "name", F.col("new_complexity").alias("complexity"), F.col("new_tags").alias("tags"), F.col("new_summary").alias("summary"), valid.alias("valid"), found.alias("issues")), "repaired_nodes")
    good = n.where("valid").drop("valid", "issues")

    texts = dict(edges.dtypes)["weight"] == "string"
    number = _number(F.col("weight")) if texts else F.col("weight").cast("double")
    e = edges.withColumns({"_type": _aliased(F.col("type"), fn.EDGE_TYPES), "_direction": F.lower("direction"), "_number": number})
    weight = F.coalesce("_number", F.lit(0.5))
    clamped = F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0))
    e = e.withColumns({"new_type": F.when(_blank(F.col("_type")), "depends_on").otherwise(F.col("_type")), "new_direction": F.when(_blank(F.col("_direction")), "forward").otherwise(_aliased(F.col("_direction"), fn.DIRECTIONS))})
    ids = good.select("id").distinct()
    e = e.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("has_source")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("has_target")), "target", "left")
    whole = F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("new_type").isin(*EDGE_TYPES) & F.col("new_direction").isin(*DIRECTIONS)
    found = F.array_compact(
        F.array(
            _issue(_blank(F.col("_type")), "auto-corrected", "missing-field", "edges", "type", F.col("type"), "depends_on"),
            _issue(_blank(F.col("_direction")), "auto-corrected", "missing-field", "edges", "direction", F.col("direction"), "forward"),
            _issue(F.col("_direction").isin(*fn.DIRECTIONS), "auto-corrected", "alias", "edges", "direction", F.col("_direction"), F.col("new_direction")),
            _issue(F.col("weight").isNull(), "auto-corrected", "missing-field", "edges", "weight", F.lit(None), "0.5"),
            _issue(F.lit(texts) & F.col("weight").isNotNull(), "auto-corrected", "type-coercion", "edges", "weight", F.col("weight"), F.lit(None)),
            _issue(F.col("weight").isNotNull() & (weight != clamped), "auto-corrected", "out-of-range", "edges", "weight", F.col("weight"), F.when(weight < 0, "0").otherwise("1")),
            _issue(~whole, "dropped", "invalid-edge", "edges", "", F.lit(None), F.lit(None)),
            _issue(whole & F.col("has_source").isNull(), "dropped", "invalid-reference", "edges", "source", F.col("source"), F.lit(None)),
            _issue(whole & F.col("has_source").isNotNull() & F.col("has_target").isNull(), "dropped", "invalid-reference", "edges", "target", F.col("target"), F.lit(None)),
        )
    )
    kept = whole & F.col("has_source").isNotNull() & F.col("has_target").isNotNull()
    e = materialize(e.select("seq", "source", "target", F.col("new_type").alias("type"), F.col("new_direction").alias("direction"), clamped.alias("weight"), kept.alias("kept"), found.alias("issues")), "repaired_edges")
    fatal = good.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).alias("seq")).select(_issue(F.lit(True), "fatal", "no-valid-nodes", "nodes", "", F.lit(None), F.lit(None)).alias("issue"))
    issues = n.select(F.explode("issues").alias("issue")).union(e.select(F.explode("issues").alias("issue"))).union(fatal).select("issue.*")
    return good, e.where("kept").drop("kept", "issues"), issues


def review_graph(nodes: DataFrame, edges: DataFrame, layers: DataFrame, tour: DataFrame) -> DataFrame:
    """Q2: ``nodes(seq, id, type, name, summary, tags)``, ``edges(seq, source, target)``, ``layers(layer,
    node_id)`` and ``tour(step, node_id)`` -> ``(level, code, ref, item)``, a row for each finding."""
    known = nodes.where(~_blank(F.col("id")))
    ids = known.select("id").distinct()
    row = lambda d, level, code, ref, item: d.select(F.lit(level).alias("level"), F.lit(code).alias("code"), F.col(ref).cast("string").alias("ref"), item.cast("string").alias("item"))
    out = row(nodes.where(_blank(F.col("id"))), "issue", "missing-id", "seq", F.lit(""))
    lacks = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in (("type", _blank(F.col("type"))), ("name", _blank(F.col("name"))), ("summary", _blank(F.col("summary"))), ("tags", F.col("tags").isNull() | (F.size("tags") == 0)))]))
    out = out.union(row(known.select("seq", F.explode(lacks).alias("field")), "issue", "missing-field", "seq", F.col("field")))
    again = known.withColumn("first", F.min("seq").over(Window.partitionBy("id"))).where("seq > first")
    out = out.union(row(again, "issue", "duplicate-id", "seq", F.col("id")))
    ends = edges.select("seq", F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("source").alias("id")), F.struct(F.lit("target").alias("end"), F.col("target").alias("id")))).alias("x")).select("seq", "x.end", "x.id")
    loose = ends.join(ids, "id", "left_anti")
    for end in ("source", "target"):
        out = out.union(row(loose.where(F.col("end") == end), "issue", f"unknown-{end}", "seq", F.col("id")))
    out = out.union(row(layers.join(ids, layers.node_id == ids.id, "left_anti"), "issue", "layer-unknown-node", "layer", F.col("node_id")))
    many = layers.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1")
    out = out.union(row(many, "issue", "several-layers", "node_id", F.col("n")))
    files = known.where(F.col("type").isin(*FILE_TYPES)).select("id").join(layers.select(F.col("node_id").alias("id")), "id", "left_anti")
    out = out.union(row(files, "issue", "no-layer", "id", F.lit("")))
    out = out.union(row(tour.join(ids, tour.node_id == ids.id, "left_anti"), "issue", "tour-unknown-node", "step", F.col("node_id")))
    orphan = nodes.select("id").join(ends.select("id"), "id", "left_anti")
    return out.union(row(orphan, "warning", "orphan", "id", F.lit("")))


def diagnose_requirements(functions: DataFrame, requirements: DataFrame, changes: DataFrame, criteria: DataFrame, scopes: DataFrame, needs: DataFrame, domains: DataFrame, dropped: DataFrame) -> DataFrame:
    """Q3: ``(level, code, ref, item)``. ``functions(seq, fn)``, ``requirements(seq, req, status, supersedes,
    superseded_by)``, ``changes(req, bucket, fn)``, ``criteria(req, ac, fn)``, ``scopes(req, item)``, ``needs(req,
    needs)``, ``domains(domain)``, ``dropped(req)``. Of duplicate ids the first one is told; of cycles that
    there are any."""
    row = lambda d, level, code, ref, item: d.select(F.lit(level).alias("level"), F.lit(code).alias("code"), ref.cast("string").alias("ref"), item.cast("string").alias("item"))
    c, none = F.col, F.lit("")
    fns, reqs = functions.select("fn").distinct(), requirements.select("req").distinct()
    out = row(dropped, "error", "req-dropped", c("req"), none)
    for d, key, code in ((functions, "fn", "dup-function-id"), (requirements, "req", "dup-requirement-id")):
        second = d.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where("k = 2")
        out = out.union(row(second.agg(F.min_by(key, "seq").alias(key)).where(c(key).isNotNull()), "error", code, c(key), none))
    out = out.union(row(changes.join(fns, "fn", "left_anti"), "error", "dangling-changeset-fn", c("req"), F.concat("bucket", F.lit(":"), "fn")))
    more = changes.groupBy("req", "fn").agg((F.count("*") - 1).alias("more")).where("more > 0").select("req", "fn", F.explode(F.sequence(F.lit(1), c("more").cast("int"))))
    out = out.union(row(more, "warn", "fn-multiple-buckets", c("req"), c("fn")))
    at = F.concat("req", F.lit("/"), "ac")
    out = out.union(row(criteria.join(fns, "fn", "left_anti"), "error", "dangling-ac-fn", at, c("fn")))
    out = out.union(row(criteria.join(fns, "fn", "left_semi").join(changes.select("req", "fn"), ["req", "fn"], "left_anti"), "warn", "ac-fn-not-in-changeset", at, c("fn")))
    known = fns.select(c("fn").alias("item")).union(domains.select("domain"))
    out = out.union(row(scopes.join(known, "item", "left_anti"), "warn", "dangling-nfr-scope", c("req"), c("item")))
    out = out.union(row(needs.join(reqs.withColumnRenamed("req", "needs"), "needs", "left_anti"), "warn", "dangling-depends-on", c("req"), c("needs")))
    # of a repeated id the last status holds
    status = requirements.groupBy("req").agg(F.max_by("status", "seq").alias("needed"))
    active = requirements.where("status = 'ACTIVE'").select("req")
    broken = needs.join(active, "req").join(status.withColumnRenamed("req", "needs"), "needs").where("needed = 'WITHDRAWN'")
    out = out.union(row(broken, "warn", "depends-on-withdrawn", c("req"), c("needs")))
    older = requirements.where("supersedes is not null").select("req", "supersedes")
    out = out.union(row(older.join(reqs.withColumnRenamed("req", "supersedes"), "supersedes", "left_anti"), "warn", "dangling-supersedes", c("req"), c("supersedes")))
    back = requirements.groupBy(c("req").alias("supersedes")).agg(F.min_by(F.struct("superseded_by"), "seq")["superseded_by"].alias("back"))
    out = out.union(row(older.join(back, "supersedes").where(~c("back").eqNullSafe(c("req"))), "warn", "supersede-asymmetry", c("req"), c("supersedes")))
    chains = older.join(reqs.withColumnRenamed("req", "supersedes"), "supersedes", "left_semi")
    for d, end, code in ((chains, "supersedes", "supersede-cycle"), (needs, "needs", "depends-on-cycle")):
        if has_cycle(d.select(c("req").alias("source"), c(end).alias("target"))):
            out = out.union(row(d.sparkSession.range(1), "error", code, none, none))
    return out


def _raw(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The raw graph with directions, tags and summaries of its own."""
    s = F.col("seq")
    kind = F.when(s % 13 == 0, None).when(s % 17 == 0, "").when(s % 19 == 0, "Gadget").otherwise(F.col("type"))
    nodes = t.raw_nodes.select("seq", "id", kind.alias("type"), F.when(s % 23 > 0, F.col("name")).alias("name"), "complexity", F.when(s % 4 > 0, F.array("type")).alias("tags"), F.when(s % 5 > 0, F.concat(F.lit("of "), "name")).alias("summary"))
    way = F.when(s % 7 == 0, "Inbound").when(s % 7 == 1, "mutual").when(s % 7 == 2, None).when(s % 7 == 3, "sideways").otherwise("FORWARD")
    edges = t.raw_edges.select("seq", "source", "target", F.when(s % 11 > 0, F.col("type")).alias("type"), way.alias("direction"), "weight")
    return nodes, edges


def _cases(table: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {column} END"


def _among(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_TIERS = f"""n0 AS (SELECT seq, id, CASE WHEN seq % 13 = 0 THEN NULL WHEN seq % 17 = 0 THEN '' WHEN seq % 19 = 0 THEN 'Gadget' ELSE type END AS type, CASE WHEN seq % 23 > 0 THEN name END AS name, complexity, seq % 4 > 0 AS tagged, CASE WHEN seq % 5 > 0 THEN concat('of ', name) END AS summary FROM raw_nodes),
n1 AS (SELECT *, {_cases(fn.NODE_TYPES, 'lower(type)')} AS t, lower(complexity) AS c FROM n0),
n2 AS (SELECT *, CASE WHEN coalesce(t, '') = '' THEN 'file' ELSE t END AS t2, CASE WHEN coalesce(c, '') = '' THEN 'moderate' ELSE {_cases(fn.COMPLEXITIES, 'c')} END AS c2 FROM n1),
n3 AS (SELECT *, id IS NOT NULL AND name IS NOT NULL AND t2 IN ({_among(NODE_TYPES)}) AND c2 IN ({_among(COMPLEXITIES)}) AS valid FROM n2),
e0 AS (SELECT seq, source, target, CASE WHEN seq % 11 > 0 THEN type END AS type, CASE seq % 7 WHEN 0 THEN 'Inbound' WHEN 1 THEN 'mutual' WHEN 2 THEN NULL WHEN 3 THEN 'sideways' ELSE 'FORWARD' END AS way, weight FROM raw_edges),
e1 AS (SELECT *, coalesce({_cases(fn.EDGE_TYPES, 'lower(type)')}, 'depends_on') AS t, lower(way) AS d, TRY_CAST(weight AS DOUBLE) AS w FROM e0),
e2 AS (SELECT *, coalesce({_cases(fn.DIRECTIONS, 'd')}, 'forward') AS d2, source IN (SELECT id FROM n3 WHERE valid) AS s, target IN (SELECT id FROM n3 WHERE valid) AS g FROM e1),
e3 AS (SELECT *, t IN ({_among(EDGE_TYPES)}) AND d2 IN ({_among(DIRECTIONS)}) AS whole FROM e2)"""


@query(
    "q1_tier_issues",
    f"""{_TIERS}, i AS (
SELECT 'auto-corrected' AS level, 'missing-field' AS category, 'nodes' AS part, seq, 'type' AS field, type AS was, 'file' AS now FROM n3 WHERE coalesce(t, '') = ''
UNION ALL SELECT 'auto-corrected', 'missing-field', 'nodes', seq, 'complexity', complexity, 'moderate' FROM n3 WHERE coalesce(c, '') = ''
UNION ALL SELECT 'auto-corrected', 'alias', 'nodes', seq, 'complexity', c, c2 FROM n3 WHERE c IN ({_among(tuple(fn.COMPLEXITIES))})
UNION ALL SELECT 'auto-corrected', 'missing-field', 'nodes', seq, 'tags', NULL, '[]' FROM n3 WHERE NOT tagged
UNION ALL SELECT 'auto-corrected', 'missing-field', 'nodes', seq, 'summary', summary, coalesce(nullif(name, ''), 'No summary') FROM n3 WHERE coalesce(summary, '') = ''
UNION ALL SELECT 'dropped', 'invalid-node', 'nodes', seq, '', id, NULL FROM n3 WHERE NOT valid
UNION ALL SELECT 'auto-corrected', 'missing-field', 'edges', seq, 'type', type, 'depends_on' FROM e3 WHERE coalesce(type, '') = ''
UNION ALL SELECT 'auto-corrected', 'missing-field', 'edges', seq, 'direction', way, 'forward' FROM e3 WHERE coalesce(d, '') = ''
UNION ALL SELECT 'auto-corrected', 'alias', 'edges', seq, 'direction', d, d2 FROM e3 WHERE d IN ({_among(tuple(fn.DIRECTIONS))})
UNION ALL SELECT 'auto-corrected', 'missing-field', 'edges', seq, 'weight', NULL, '0.5' FROM e3 WHERE weight IS NULL
UNION ALL SELECT 'auto-corrected', 'type-coercion', 'edges', seq, 'weight', weight, NULL FROM e3 WHERE weight IS NOT NULL
UNION ALL SELECT 'auto-corrected', 'out-of-range', 'edges', seq, 'weight', weight, CASE WHEN w < 0 THEN '0' ELSE '1' END FROM e3 WHERE w < 0 OR w > 1
UNION ALL SELECT 'dropped', 'invalid-edge', 'edges', seq, '', NULL, NULL FROM e3 WHERE NOT whole
UNION ALL SELECT 'dropped', 'invalid-reference', 'edges', seq, 'source', source, NULL FROM e3 WHERE whole AND NOT s
UNION ALL SELECT 'dropped', 'invalid-reference', 'edges', seq, 'target', target, NULL FROM e3 WHERE whole AND s AND NOT g) SELECT * FROM i""",
    ("raw_nodes", "raw_edges"),
)
def _q1a(t: Tables) -> DataFrame:
    weight = F.when(F.col("field") == "weight", F.col("was"))
    return repair_graph(*_raw(t))[2].withColumn("was", F.coalesce(weight, F.col("was")))


@query("q1_repaired_nodes", f"{_TIERS} SELECT seq, id, t2 AS type, name, c2 AS complexity, coalesce(summary, nullif(name, ''), 'No summary') AS summary, CAST(tagged AS INT) AS tags FROM n3 WHERE valid", ("raw_nodes", "raw_edges"))
def _q1n(t: Tables) -> DataFrame:
    return repair_graph(*_raw(t))[0].withColumn("tags", F.size("tags"))


@query("q1_repaired_edges", f"{_TIERS} SELECT seq, source, target, t AS type, d2 AS direction, CASE WHEN w IS NULL THEN 0.5e0 ELSE least(greatest(w, 0e0), 1e0) END AS weight FROM e3 WHERE whole AND s AND g", ("raw_nodes", "raw_edges"))
def _q1e(t: Tables) -> DataFrame:
    return repair_graph(*_raw(t))[1]


@query(
    "q2_graph_review",
    f"""n AS (SELECT seq, CASE WHEN seq % 29 > 0 THEN id END AS id, CASE WHEN seq % 13 > 0 THEN lower(type) END AS type, CASE WHEN seq % 23 > 0 THEN name ELSE '' END AS name, CASE WHEN seq % 5 > 0 THEN name END AS summary, seq % 4 > 0 AS tagged FROM raw_nodes),
e AS (SELECT seq, source, target FROM raw_edges), l AS (SELECT layer, replace(node_id, 'part:', 'file:') AS node_id FROM memberships UNION ALL SELECT 'again', replace(node_id, 'part:', 'file:') FROM memberships WHERE pos % 6 = 0 AND node_id LIKE 'part:%'),
u AS (SELECT concat('step', page_id) AS step, concat('file:', page_id * 11) AS node_id FROM pages), i AS (SELECT DISTINCT id FROM n WHERE id IS NOT NULL), x AS (SELECT source AS id FROM e UNION SELECT target FROM e)
SELECT 'issue' AS level, 'missing-id' AS code, CAST(seq AS VARCHAR) AS ref, '' AS item FROM n WHERE id IS NULL
UNION ALL SELECT 'issue', 'missing-field', CAST(seq AS VARCHAR), f FROM (SELECT seq, unnest(list_filter([CASE WHEN type IS NULL THEN 'type' END, CASE WHEN name = '' THEN 'name' END, CASE WHEN coalesce(summary, '') = '' THEN 'summary' END, CASE WHEN NOT tagged THEN 'tags' END], lambda v: v IS NOT NULL)) AS f FROM n WHERE id IS NOT NULL)
UNION ALL SELECT 'issue', 'duplicate-id', CAST(seq AS VARCHAR), id FROM (SELECT *, min(seq) OVER (PARTITION BY id) AS first FROM n WHERE id IS NOT NULL) WHERE seq > first
UNION ALL SELECT 'issue', 'unknown-source', CAST(seq AS VARCHAR), source FROM e WHERE source NOT IN (SELECT id FROM i)
UNION ALL SELECT 'issue', 'unknown-target', CAST(seq AS VARCHAR), target FROM e WHERE target NOT IN (SELECT id FROM i)
UNION ALL SELECT 'issue', 'layer-unknown-node', layer, node_id FROM l WHERE node_id NOT IN (SELECT id FROM i)
UNION ALL SELECT 'issue', 'several-layers', node_id, CAST(count(*) AS VARCHAR) FROM l GROUP BY node_id HAVING count(*) > 1
UNION ALL SELECT 'issue', 'no-layer', id, '' FROM n WHERE id IS NOT NULL AND type IN ({_among(FILE_TYPES)}) AND id NOT IN (SELECT node_id FROM l)
UNION ALL SELECT 'issue', 'tour-unknown-node', step, node_id FROM u WHERE node_id NOT IN (SELECT id FROM i)
UNION ALL SELECT 'warning', 'orphan', id, '' FROM n WHERE id IS NULL OR id NOT IN (SELECT id FROM x)""",
    ("raw_nodes", "raw_edges", "memberships"),
)
def _q2(t: Tables) -> DataFrame:
    s = F.col("seq")
    nodes = t.raw_nodes.select("seq", F.when(s % 29 > 0, F.col("id")).alias("id"), F.when(s % 13 > 0, F.lower("type")).alias("type"), F.when(s % 23 > 0, F.col("name")).otherwise("").alias("name"), F.when(s % 5 > 0, F.col("name")).alias("summary"), F.when(s % 4 > 0, F.array("type")).otherwise(F.array()).alias("tags"))
    m = t.memberships.withColumn("node_id", F.replace("node_id", F.lit("part:"), F.lit("file:")))
    layers = m.select("layer", "node_id").union(m.where("pos % 6 = 0 and node_id like 'file:%'").select(F.lit("again"), "node_id"))
    tour = t.pages.select(F.concat(F.lit("step"), F.col("page_id").cast("string")).alias("step"), F.concat(F.lit("file:"), (F.col("page_id") * 11).cast("string")).alias("node_id"))
    return review_graph(nodes, t.raw_edges, layers, tour)


@query(
    "q3_diagnostics",
    """fs AS (SELECT p_partkey AS seq, concat('F', p_partkey) AS fn FROM part UNION ALL SELECT 50000000 + p_partkey, concat('F', p_partkey) FROM part WHERE p_partkey % 90 = 7),
o AS (SELECT o_orderkey AS k, o_orderstatus, (SELECT count(*) FROM orders) AS n FROM orders),
r AS (SELECT k AS seq, concat('R', k) AS req, CASE WHEN o_orderstatus = 'F' THEN 'WITHDRAWN' ELSE 'ACTIVE' END AS status, CASE WHEN k % 9 = 0 THEN concat('R', k + 1) WHEN k % 9 = 1 THEN concat('R', k - 1) END AS supersedes, CASE WHEN k % 18 = 0 THEN concat('R', k + 1) END AS superseded_by FROM o),
c AS (SELECT concat('R', l_orderkey) AS req, CASE l_linenumber % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed' ELSE 'revived' END AS bucket, concat('F', l_partkey % ((SELECT count(*) FROM part) + 20) + 1 - CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) AS fn FROM lineitem UNION ALL SELECT concat('R', l_orderkey), 'added', concat('F', l_partkey % ((SELECT count(*) FROM part) + 20) + 1) FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 5 = 0),
a AS (SELECT concat('R', l_orderkey) AS req, concat('AC-', l_linenumber) AS ac, concat('F', l_partkey + CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 9 END) AS fn FROM lineitem WHERE l_linenumber < 3),
z AS (SELECT concat('R', o_orderkey) AS req, CASE WHEN o_orderkey % 4 = 0 THEN concat('brand', o_orderkey % 60) ELSE concat('F', o_custkey * 2) END AS item FROM orders), dm AS (SELECT DISTINCT lower(replace(p_brand, '#', '')) AS domain FROM part),
d AS (SELECT concat('R', k) AS req, concat('R', k * 2 - 40) AS needs FROM o), rs AS (SELECT req, status FROM r)
SELECT 'error' AS level, 'req-dropped' AS code, concat('R', o_orderkey) AS ref, '' AS item FROM orders WHERE o_custkey % 37 = 5
UNION ALL SELECT 'error', 'dup-function-id', (SELECT arg_min(fn, seq) FROM fs WHERE seq > 50000000), ''
UNION ALL SELECT 'error', 'dangling-changeset-fn', req, concat(bucket, ':', fn) FROM c WHERE fn NOT IN (SELECT fn FROM fs)
UNION ALL SELECT 'warn', 'fn-multiple-buckets', req, fn FROM (SELECT req, fn, row_number() OVER (PARTITION BY req, fn) AS k FROM c) WHERE k > 1
UNION ALL SELECT 'error', 'dangling-ac-fn', concat(req, '/', ac), fn FROM a WHERE fn NOT IN (SELECT fn FROM fs)
UNION ALL SELECT 'warn', 'ac-fn-not-in-changeset', concat(req, '/', ac), fn FROM a WHERE fn IN (SELECT fn FROM fs) AND NOT EXISTS (SELECT 1 FROM c WHERE c.req = a.req AND c.fn = a.fn)
UNION ALL SELECT 'warn', 'dangling-nfr-scope', req, item FROM z WHERE item NOT IN (SELECT fn FROM fs) AND item NOT IN (SELECT domain FROM dm)
UNION ALL SELECT 'warn', 'dangling-depends-on', req, needs FROM d WHERE needs NOT IN (SELECT req FROM r)
UNION ALL SELECT 'warn', 'depends-on-withdrawn', d.req, needs FROM d JOIN rs x ON x.req = d.req JOIN rs y ON y.req = d.needs WHERE x.status = 'ACTIVE' AND y.status = 'WITHDRAWN'
UNION ALL SELECT 'warn', 'dangling-supersedes', req, supersedes FROM r WHERE supersedes NOT IN (SELECT req FROM rs)
UNION ALL SELECT 'warn', 'supersede-asymmetry', x.req, x.supersedes FROM r x JOIN r y ON y.req = x.supersedes WHERE y.superseded_by IS DISTINCT FROM x.req
UNION ALL SELECT 'error', 'supersede-cycle', '', '' WHERE EXISTS (SELECT 1 FROM r x JOIN r y ON y.req = x.supersedes AND y.supersedes = x.req)
UNION ALL SELECT 'error', 'depends-on-cycle', '', '' WHERE EXISTS (SELECT 1 FROM d WHERE req = needs)""",
)
def _q3(t: Tables) -> DataFrame:
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    p, k = F.col("p_partkey"), F.col("o_orderkey")
    functions = t.part.select(p.alias("seq"), text("F", p).alias("fn")).union(t.part.where("p_partkey % 90 = 7").select(p + 50000000, text("F", p)))
    requirements = t.orders.select(
        k.alias("seq"),
        text("R", k).alias("req"),
        F.when(F.col("o_orderstatus") == "F", "WITHDRAWN").otherwise("ACTIVE").alias("status"),
        F.when(k % 9 == 0, text("R", k + 1)).when(k % 9 == 1, text("R", k - 1)).alias("supersedes"),
        F.when(k % 18 == 0, text("R", k + 1)).alias("superseded_by"),
    )
    line, size = F.col("l_linenumber"), t.part.count() + 20
    req, fn_ = text("R", F.col("l_orderkey")), F.col("l_partkey") % size + 1
    bucket = F.element_at(F.array(*map(F.lit, ("added", "modified", "removed", "revived"))), (line % 4 + 1).cast("int"))
    changes = t.lineitem.select(req.alias("req"), bucket.alias("bucket"), text("F", fn_ - F.when(line == 3, 1).otherwise(0)).alias("fn"))
    changes = changes.union(t.lineitem.where("l_linenumber = 1 and l_orderkey % 5 = 0").select(req, F.lit("added"), text("F", fn_)))
    criteria = t.lineitem.where("l_linenumber < 3").select(req.alias("req"), text("AC-", line).alias("ac"), text("F", F.col("l_partkey") + F.when(line % 2 == 0, 1).otherwise(9)).alias("fn"))
    scopes = t.orders.select(text("R", k).alias("req"), F.when(k % 4 == 0, text("brand", k % 60)).otherwise(text("F", F.col("o_custkey") * 2)).alias("item"))
    needs = t.orders.select(text("R", k).alias("req"), text("R", k * 2 - 40).alias("needs"))
    domains = t.part.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("domain")).distinct()
    return diagnose_requirements(functions, requirements, changes, criteria, scopes, needs, domains, t.orders.where("o_custkey % 37 = 5").select(text("R", k).alias("req")))
