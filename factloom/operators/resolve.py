"""Calls, tests, impact chains and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.operators.filters import is_test
from factloom.plans.shared import broadcast_if_small, materialize
from factloom.registry import query

# Weights of built edges.
EDGE_WEIGHTS = {"contains": 1.0, "imports": 0.7, "calls": 0.8}


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """``calls(call, file, receiver, name)`` to ``functions(fn, file, cls, name)``. With a
    receiver, classes that begin with it (or it with them) are strong, the one with the longest
    common part wins if it is alone; without one, a unique name, else a unique one in an imported
    file. ``outcome`` says which."""
    f = functions.select("fn", F.col("file").alias("f_file"), F.lower("cls").alias("cls"), "name")
    # rows of one call differ in their file alone
    one_call = calls.groupBy("call").agg(F.min(F.struct("name", F.lower("receiver").alias("receiver"))).alias("x")).select("call", "x.*")
    one_call = materialize(one_call, "calls")
    named = f.groupBy("name").agg(F.count_distinct("fn").alias("n"), F.min("fn").alias("one"))

    # classes that begin with the receiver share all of it; only if there are none does the longest that it begins with count
    starts = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda i: F.substring(c, F.lit(1), i))
    asked = materialize(one_call.where("receiver is not null").select("name", "receiver").distinct(), "receivers")
    longer = f.where("cls is not null").select("name", "fn", F.explode(starts(F.col("cls"))).alias("receiver"))
    longer = longer.join(asked, ["name", "receiver"]).groupBy("name", "receiver").agg(F.count_distinct("fn").alias("k"), F.min("fn").alias("top"))
    classes = f.where("cls is not null").groupBy("name", "cls").agg(F.count_distinct("fn").alias("k"), F.min("fn").alias("top"))
    shorter = asked.select("name", "receiver", F.explode(starts(F.col("receiver"))).alias("cls")).join(classes, ["name", "cls"])
    shorter = shorter.groupBy("name", "receiver").agg(F.max_by(F.struct("k", "top"), F.length("cls")).alias("short"))
    strong = asked.join(longer, ["name", "receiver"], "left").join(shorter, ["name", "receiver"], "left")
    strong = strong.select("name", "receiver", F.coalesce("k", "short.k").alias("k"), F.when(F.col("k").isNotNull(), F.col("top")).otherwise(F.col("short.top")).alias("top"))
    strong = broadcast_if_small(materialize(strong, "strong"))

    bare = calls.where("receiver is null").select("call", "file", "name")
    near = imports.select("file", F.col("target").alias("f_file")).distinct().join(f.select("f_file", "name", "fn").hint("merge"), "f_file").select("file", "name", "fn")
    near = bare.join(near.hint("merge"), ["file", "name"]).groupBy("call").agg(F.count_distinct("fn").alias("n_imported"), F.min("fn").alias("imported_one"))

    g = one_call.join(broadcast_if_small(materialize(named, "names")), "name").join(strong, ["name", "receiver"], "left").join(near.hint("merge"), "call", "left")
    has = F.col("receiver").isNotNull()
    to = F.when(has, F.when(F.col("k") == 1, F.col("top"))).when(F.col("n") == 1, F.col("one")).when(F.col("n_imported") == 1, F.col("imported_one"))
    outcome = F.when(has, F.when(F.col("k") == 1, "strong").when(F.col("k") > 1, "ambiguous").otherwise("weak")).when(F.col("n") == 1, "unique").when(F.col("n_imported") == 1, "imported").otherwise("ambiguous")
    g = g.select("call", to.alias("fn"), outcome.alias("outcome"))
    return calls.select("call").join(g.hint("merge"), "call", "left").withColumn("outcome", F.coalesce("outcome", F.lit("unknown")))


def link_tests(edges: DataFrame) -> DataFrame:
    """Edges between production and test files as production to test, the heaviest of a pair;
    edges between two of a kind go."""
    s, t = is_test(F.col("source")), is_test(F.col("target"))
    d = edges.where(s != t)
    return d.groupBy(F.when(is_test(F.col("source")), F.col("target")).otherwise(F.col("source")).alias("prod"), F.when(is_test(F.col("source")), F.col("source")).otherwise(F.col("target")).alias("test")).agg(F.max("weight").alias("weight"))


def class_mentions(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """Known class names in each file with the first line of each; tokens, not containment."""
    d = lines.select("file", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z_]\w*)"), 1))).alias("cls"))
    return d.join(classes.select("cls"), "cls", "left_semi").groupBy("file", "cls").agg(F.min("line_no").alias("line_no"))


def key_cardinality(keys: DataFrame) -> DataFrame:
    """``keys(fk, cols, pk, uniques, nullable)``: the child side is one if its columns are the
    key or unique; the parent optional if all of them may be null."""
    same = F.array_sort("cols") == F.array_sort("pk")
    unique = F.exists("uniques", lambda u: F.array_sort(u) == F.array_sort("cols"))
    return keys.select("fk", F.when(same | unique, "one").otherwise("many").alias("child"), F.forall("cols", lambda c: F.array_contains("nullable", c)).alias("optional"))


def flow_impact(impacted: DataFrame, steps: DataFrame, flows: DataFrame, owners: DataFrame) -> DataFrame:
    """Impacted files to steps to flows to domains; a file without a step counts through its
    owners; a step beats that, and the smallest step names the flow's hit."""
    by_step = impacted.join(steps, "path").select("flow", F.lit(0).alias("rank"), "step")
    rest = impacted.join(steps.select("path").distinct(), "path", "left_anti")
    by_owner = rest.join(owners, "path").select("flow", F.lit(1).alias("rank"), F.lit(None).cast("string").alias("step"))
    hit = by_step.union(by_owner).groupBy("flow").agg(F.min(F.struct("rank", "step")).alias("best"))
    return hit.join(flows, "flow").select("flow", "domain", F.when(F.col("best.rank") == 0, "step").otherwise("ownership").alias("way"), F.col("best.step").alias("step"))


def requirement_seeds(evidence: DataFrame) -> DataFrame:
    """Strongest confidence of each path (CONFIRMED, CONFIRMED_AI, INFERRED, UNVERIFIED)."""
    rank = F.array_position(F.array(*map(F.lit, ("CONFIRMED", "CONFIRMED_AI", "INFERRED", "UNVERIFIED"))), F.col("confidence"))
    return evidence.groupBy("path").agg(F.min_by("confidence", rank).alias("confidence"), F.count_distinct("fn").alias("fns"))


def persistence_impact(edges: DataFrame, impacted: DataFrame) -> DataFrame:
    """Mapper edges into the impact set, each file with its earliest citation."""
    d = edges.join(impacted.select(F.col("path").alias("target")), "target", "left_semi")
    return d.groupBy("source").agg(F.min(F.struct("line", "target")).alias("first")).select("source", "first.line", "first.target")


def verdicts(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """Per node grounded and unverified claims; its text is marked once if any is not."""
    d = claims.groupBy("id").agg(F.count_if("grounded").alias("grounded"), F.count_if(~F.col("grounded")).alias("review"))
    d = nodes.select("id", "name").join(d, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("grounded", "review")})
    return d.withColumn("name", F.when((F.col("review") > 0) & ~F.startswith("name", F.lit("[?] ")), F.concat(F.lit("[?] "), "name")).otherwise(F.col("name")))


def apply_layer_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """the first rule (by order) that equals a segment of the path, singular or plural;
    ``Other`` if none. Rules meet segments by equality."""
    r = rules.select("place", "layer", F.explode(F.array("pattern", F.concat("pattern", F.lit("s")))).alias("segment"))
    d = paths.select("path", F.explode(F.array_distinct(F.split(F.lower("path"), "/"))).alias("segment")).join(r, "segment")
    return paths.join(d.groupBy("path").agg(F.min_by("layer", "place").alias("layer")), "path", "left").withColumn("layer", F.coalesce("layer", F.lit("Other")))


def frameworks(manifests: DataFrame, keywords: DataFrame) -> DataFrame:
    """frameworks whose keyword is a word of a manifest."""
    d = manifests.select("file", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9@_/-]+"))).alias("keyword"))
    return d.join(keywords, "keyword").groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("framework")), ",").alias("frameworks"))


def build_graph(facts: DataFrame) -> DataFrame:
    """edges of file facts (kind contains, imports or calls) with their weights; repeats go."""
    table = F.create_map(*[F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair])
    return facts.groupBy("source", "target", "kind").agg(F.min("seq").alias("seq")).withColumn("weight", table[F.col("kind")]).where("weight is not null")


def reconcile_steps(steps: DataFrame, as_of: str, grace_s: int = 600) -> DataFrame:
    """Running steps of sessions idle for longer than the grace become failed."""
    idle = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) > grace_s
    return steps.withColumn("status", F.when((F.col("status") == "running") & idle, "failed").otherwise(F.col("status")))


def database_links(lines: DataFrame) -> DataFrame:
    """``table@link`` after from or join, comments blanked so that lines hold."""
    code = F.regexp_replace("line", r"--.*$", "")
    d = lines.select("file", "line_no", F.explode(F.regexp_extract_all(code, F.lit(r"(?i)\b(?:from|join)\s+(\w+@\w+)"), 1)).alias("link"))
    return d.groupBy("file", "link").agg(F.min("line_no").alias("line_no"))


def mapper_statements(lines: DataFrame) -> DataFrame:
    """Statements of mapper files with their verb, under the namespace set before them."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    part = lambda p, i=1: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    d = lines.withColumn("namespace", F.last(part(r'<mapper\s+namespace="([^"]+)"'), ignorenulls=True).over(w))
    tag = r'<(select|insert|update|delete)\s+id="([^"]+)"'
    return d.select("file", "line_no", "namespace", part(tag).alias("verb"), part(tag, 2).alias("statement")).where("verb is not null")


@query(
    "j18_resolve_calls",
    """f AS (SELECT path AS fn, path AS file, lower(concat(CASE seq % 3 WHEN 0 THEN 'Order' WHEN 1 THEN 'Item' ELSE 'Stock' END, loc % 3)) AS cls, concat('m', loc) AS name FROM files),
c AS (SELECT seq AS call, source AS file, CASE WHEN seq % 3 = 0 THEN 'item' WHEN seq % 3 = 1 THEN 'order1x' END AS receiver, concat('m', seq % 60) AS name FROM file_edges), i AS (SELECT DISTINCT source AS file, target FROM file_edges WHERE kind = 'import'),
d AS (SELECT c.*, fn, cls, target IS NOT NULL AS imported, CASE WHEN receiver IS NOT NULL AND (starts_with(cls, receiver) OR starts_with(receiver, cls)) THEN least(length(cls), length(receiver)) END AS common FROM c JOIN f USING (name) LEFT JOIN i ON i.file = c.file AND i.target = f.file),
b AS (SELECT *, max(common) OVER (PARTITION BY call) AS best FROM d),
g AS (SELECT call, count(DISTINCT fn) AS n, count(DISTINCT fn) FILTER (WHERE imported) AS ni, min(fn) AS one, min(fn) FILTER (WHERE imported) AS ione, bool_or(receiver IS NOT NULL) AS has, count(DISTINCT fn) FILTER (WHERE common = best) AS k, min(fn) FILTER (WHERE common = best) AS top FROM b GROUP BY call)
SELECT call, CASE WHEN has THEN CASE WHEN k = 1 THEN top END WHEN n = 1 THEN one WHEN ni = 1 THEN ione END AS fn,
  coalesce(CASE WHEN has THEN CASE WHEN k = 1 THEN 'strong' WHEN k > 1 THEN 'ambiguous' ELSE 'weak' END WHEN n = 1 THEN 'unique' WHEN ni = 1 THEN 'imported' WHEN n IS NOT NULL THEN 'ambiguous' END, 'unknown') AS outcome FROM c LEFT JOIN g USING (call)""",
    ("files", "file_edges"),
)
def _j18(t: Tables) -> DataFrame:
    n = F.col("seq") % 3
    functions = t.files.select(F.col("path").alias("fn"), F.col("path").alias("file"), F.concat(F.when(n == 0, "Order").when(n == 1, "Item").otherwise("Stock"), (F.col("loc") % 3).cast("string")).alias("cls"), F.concat(F.lit("m"), F.col("loc").cast("string")).alias("name"))
    calls = t.file_edges.select(F.col("seq").alias("call"), F.col("source").alias("file"), F.when(n == 0, "item").when(n == 1, "order1x").alias("receiver"), F.concat(F.lit("m"), (F.col("seq") % 60).cast("string")).alias("name"))
    return resolve_calls(calls, functions, t.file_edges.where("kind = 'import'").select(F.col("source").alias("file"), "target"))


@query(
    "j19_link_tests",
    """e AS (SELECT source, target, line * 0.1e0 AS weight, source LIKE '%/test/%' AS s, target LIKE '%/test/%' AS t FROM file_edges)
SELECT CASE WHEN s THEN target ELSE source END AS prod, CASE WHEN s THEN source ELSE target END AS test, max(weight) AS weight FROM e WHERE s <> t GROUP BY 1, 2""",
    ("file_edges",),
)
def _j19(t: Tables) -> DataFrame:
    return link_tests(t.file_edges.withColumn("weight", F.col("line") * 0.1))


@query(
    "j20_class_mentions",
    r"SELECT doc_id AS file, cls, min(line_no) AS line_no FROM (SELECT doc_id, line_no, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z_][0-9A-Za-z_]*'))) AS cls FROM lines WHERE regexp_matches(line, '^[\x00-\x7F]*$')) WHERE cls IN ('The', 'onea', 'with', 'idiot') GROUP BY 1, 2",
    ("lines",),
)
def _j20(t: Tables) -> DataFrame:
    classes = t.spark.createDataFrame([("The",), ("onea",), ("with",), ("idiot",)], "cls string")
    return class_mentions(t.lines.withColumnRenamed("doc_id", "file").where(F.col("line").rlike(r"^[\x00-\x7F]*$")), classes)


@query(
    "j26_persistence_impact",
    "i AS (SELECT path FROM files WHERE seq % 6 = 0), d AS (SELECT source, min(struct_pack(line := line, target := target)) AS f FROM file_edges WHERE target IN (SELECT path FROM i) GROUP BY source) SELECT source, f.line AS line, f.target AS target FROM d",
    ("files", "file_edges"),
)
def _j26(t: Tables) -> DataFrame:
    return persistence_impact(t.file_edges, t.files.where("seq % 6 = 0").select("path"))


@query(
    "j27_flow_impact",
    """i AS (SELECT path FROM files WHERE seq % 5 < 2), s AS (SELECT source AS path, source_domain AS flow, concat(kind, line) AS step FROM file_edges WHERE source IN (SELECT path FROM files WHERE seq % 2 = 0)), o AS (SELECT path, concat('own-', domain) AS flow FROM files),
h AS (SELECT flow, 0 AS rank, step FROM i JOIN s USING (path) UNION ALL SELECT flow, 1, NULL FROM i JOIN o USING (path) WHERE path NOT IN (SELECT path FROM s)), b AS (SELECT flow, min(rank) AS rank, min(step) FILTER (WHERE rank = 0) AS step FROM h GROUP BY flow)
SELECT flow, replace(flow, 'own-', '') AS domain, CASE rank WHEN 0 THEN 'step' ELSE 'ownership' END AS way, step FROM b""",
    ("files", "file_edges"),
)
def _j27(t: Tables) -> DataFrame:
    even = t.files.where("seq % 2 = 0").select(F.col("path").alias("source"))
    steps = t.file_edges.join(even, "source", "left_semi").select(F.col("source").alias("path"), F.col("source_domain").alias("flow"), F.concat("kind", F.col("line").cast("string")).alias("step"))
    owners = t.files.select("path", F.concat(F.lit("own-"), "domain").alias("flow"))
    domains = t.files.select("domain").distinct()
    flows = domains.select(F.col("domain").alias("flow"), "domain").union(domains.select(F.concat(F.lit("own-"), "domain"), "domain"))
    return flow_impact(t.files.where("seq % 5 < 2").select("path"), steps, flows, owners)


@query(
    "j28_requirement_seeds",
    """e AS (SELECT source AS path, target AS fn, CASE line % 4 WHEN 0 THEN 'UNVERIFIED' WHEN 1 THEN 'INFERRED' WHEN 2 THEN 'CONFIRMED' ELSE 'CONFIRMED_AI' END AS confidence FROM file_edges)
SELECT path, CASE min(list_position(['CONFIRMED', 'CONFIRMED_AI', 'INFERRED', 'UNVERIFIED'], confidence)) WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'CONFIRMED_AI' WHEN 3 THEN 'INFERRED' ELSE 'UNVERIFIED' END AS confidence, count(DISTINCT fn) AS fns FROM e GROUP BY path""",
    ("file_edges",),
)
def _j28(t: Tables) -> DataFrame:
    n = F.col("line") % 4
    return requirement_seeds(t.file_edges.select(F.col("source").alias("path"), F.col("target").alias("fn"), F.when(n == 0, "UNVERIFIED").when(n == 1, "INFERRED").when(n == 2, "CONFIRMED").otherwise("CONFIRMED_AI").alias("confidence")))


@query(
    "j32_verdicts",
    """c AS (SELECT concat('part:', l_partkey) AS id, l_linenumber % 3 > 0 AS grounded FROM lineitem), d AS (SELECT id, count(*) FILTER (WHERE grounded) AS grounded, count(*) FILTER (WHERE NOT grounded) AS review FROM c GROUP BY id)
SELECT id, CASE WHEN review > 0 THEN concat('[?] ', name) ELSE name END AS name, coalesce(grounded, 0) AS grounded, coalesce(review, 0) AS review FROM nodes LEFT JOIN d USING (id) WHERE type = 'file'""",
    ("nodes",),
)
def _j32(t: Tables) -> DataFrame:
    claims = t.lineitem.select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"), (F.col("l_linenumber") % 3 > 0).alias("grounded"))
    return verdicts(t.nodes.where("type = 'file'"), claims)


@query("f3_layer_rules", "SELECT path, CASE WHEN path LIKE '%/controller/%' THEN 'API' WHEN path LIKE '%/repository/%' THEN 'Data' WHEN path LIKE '%/test/%' THEN 'Test' ELSE 'Other' END AS layer FROM files", ("files",))
def _f3(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([(1, "API", "controller"), (2, "Data", "repository"), (3, "Data", "repositorie"), (4, "Test", "test")], "place int, layer string, pattern string")
    return apply_layer_rules(t.files.select("path"), rules)


@query("f5_build_graph", "SELECT source, target, CASE kind WHEN 'import' THEN 'imports' ELSE 'calls' END AS kind, min(seq) AS seq, CASE kind WHEN 'import' THEN 0.7e0 ELSE 0.8e0 END AS weight FROM file_edges WHERE kind IN ('import', 'call') GROUP BY source, target, kind", ("file_edges",))
def _f5(t: Tables) -> DataFrame:
    return build_graph(t.file_edges.withColumn("kind", F.when(F.col("kind") == "import", "imports").when(F.col("kind") == "call", "calls").otherwise("other")))


@query("t3_reconcile_steps", "SELECT seq, CASE WHEN event = 'view' AND epoch(TIMESTAMP '2024-01-10')::BIGINT - epoch(ts)::BIGINT > 600 THEN 'failed' WHEN event = 'view' THEN 'running' ELSE 'done' END AS status FROM ledger", ("ledger",))
def _t3(t: Tables) -> DataFrame:
    return reconcile_steps(t.ledger.withColumn("status", F.when(F.col("event") == "view", "running").otherwise("done")), "2024-01-10").select("seq", "status")


@query(
    "x3_database_links",
    "SELECT l_orderkey AS file, concat('t', l_partkey % 5, '@db', l_suppkey % 3) AS link, min(CAST(l_linenumber AS BIGINT)) AS line_no FROM lineitem WHERE l_linenumber % 3 > 0 GROUP BY 1, 2",
)
def _x3(t: Tables) -> DataFrame:
    link = F.concat(F.lit("t"), (F.col("l_partkey") % 5).cast("string"), F.lit("@db"), (F.col("l_suppkey") % 3).cast("string"))
    line = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "-- ").otherwise(""), F.lit("select a FROM "), link, F.lit(" x"))
    return database_links(t.lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line_no"), line.alias("line")))


@query(
    "x2_mapper_statements",
    """SELECT user_id AS file, event_id AS line_no, concat('ns', (SELECT max(e.event_id) FROM events e WHERE e.user_id = x.user_id AND e.event_id <= x.event_id AND e.event_type = 'view')) AS namespace, CASE event_type WHEN 'purchase' THEN 'insert' ELSE 'select' END AS verb, concat('s', event_id) AS statement
FROM events x WHERE event_type IN ('purchase', 'click')""",
)
def _x2(t: Tables) -> DataFrame:
    k = F.col("event_id").cast("string")
    line = F.when(F.col("event_type") == "view", F.concat(F.lit('<mapper namespace="ns'), k, F.lit('">'))).when(F.col("event_type") == "purchase", F.concat(F.lit('  <insert id="s'), k, F.lit('">'))).when(F.col("event_type") == "click", F.concat(F.lit('<select  id="s'), k, F.lit('" x="y">'))).otherwise("text")
    d = mapper_statements(t.events.select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), line.alias("line")))
    return d.withColumn("namespace", F.coalesce("namespace", F.lit("ns")))
