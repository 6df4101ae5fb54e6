"""Joins: integrity, rewriting, resolution, reconciliation, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.operators.filters import basename
from factloom.plans.shared import shuffled, spread
from factloom.registry import query


def integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every edge with ``problem``: NULL, missing-source, missing-target or missing-both."""
    ids = nodes.select("id").distinct()
    s, t = ids.select(F.col("id").alias("source"), F.lit(1).alias("has_s")), ids.select(F.col("id").alias("target"), F.lit(1).alias("has_t"))
    e = edges.join(s, "source", "left").join(t, "target", "left")
    problem = F.when(F.col("has_s").isNull() & F.col("has_t").isNull(), "missing-both").when(F.col("has_s").isNull(), "missing-source").when(F.col("has_t").isNull(), "missing-target")
    return e.withColumn("problem", problem).drop("has_s", "has_t")


def prune_members(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """``groups(layer, node_ids)`` without dangling ids, order kept."""
    m = groups.select("layer", F.posexplode("node_ids").alias("pos", "id")).join(nodes.select("id"), "id", "left_semi")
    kept = m.groupBy("layer").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("node_ids"))
    return groups.select("layer").join(kept, "layer", "left").withColumn("node_ids", F.coalesce("node_ids", F.array().cast("array<string>")))


def rewrite_ends(edges: DataFrame, renamed: DataFrame, normal: Column) -> DataFrame:
    """Ends through ``renamed(old, new)``, probed as they are, then normalised, else kept.
    ``normal`` is an expression of column ``end``."""
    out = edges
    for end in ("source", "target"):
        own = renamed.select(F.col("old").alias(end), F.col("new").alias("by_id"))
        other = renamed.select(F.col("old").alias("norm"), F.col("new").alias("by_norm"))
        out = out.withColumn("end", F.col(end)).withColumn("norm", normal).join(own, end, "left").join(other, "norm", "left")
        out = out.withColumn(end, F.coalesce("by_id", "by_norm", end)).drop("by_id", "by_norm", "norm", "end")
    return out


def overlay(impacted: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths to their best node (files before others, then smallest id) and role; unresolved
    paths have a NULL id."""
    best = nodes.where("file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.min_by("id", F.struct(F.when(F.col("type") == "file", 0).otherwise(1), "id")).alias("id"))
    both = seeds.select("path", F.lit("seed").alias("role")).union(impacted.join(seeds, "path", "left_anti").select("path", F.lit("affected").alias("role")))
    return both.join(best, "path", "left")


def merge_overlay(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Edges after a merge: a native node wins, a new edge stays if both ends exist and one is new."""
    fresh = new_nodes.join(nodes.select("id"), "id", "left_anti").select("id", F.lit(1).alias("new"))
    known = nodes.select("id", F.lit(0).alias("new")).union(fresh)
    a, b = known.toDF("source", "new_s"), known.toDF("target", "new_t")
    kept = new_edges.join(a, "source").join(b, "target").where("new_s + new_t > 0").select(*edges.columns)
    return edges.unionByName(kept)


def replace_changed(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of changed files and the edges that touch them go."""
    gone = nodes.join(changed, "file_path", "left_semi").select("id")
    kept = nodes.join(gone, "id", "left_anti")
    for end in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return kept, edges


def stale_claims(claims: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """A claim is stale if the hash of any of its evidence differs; absent on one side differs."""
    e = claims.join(before.select("path", F.col("hash").alias("h1")), "path", "left").join(after.select("path", F.col("hash").alias("h2")), "path", "left")
    return e.groupBy("claim").agg(F.bool_or(~F.col("h1").eqNullSafe(F.col("h2"))).alias("stale"))


def fingerprint_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and changed paths."""
    d = before.select("path", F.col("hash").alias("h1")).join(after.select("path", F.col("hash").alias("h2")), "path", "full_outer")
    change = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").when(F.col("h1") != F.col("h2"), "changed")
    return d.select("path", change.alias("change")).where("change is not null")


def set_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What came and what went between two snapshots."""
    came = after.select(key).distinct().join(before, key, "left_anti").withColumn("delta", F.lit("added"))
    return came.union(before.select(key).distinct().join(after, key, "left_anti").withColumn("delta", F.lit("removed")))


def route_links(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``calls(call, method, path)`` to ``routes(route, method, pattern)`` segment by segment:
    ``{x}`` takes one segment, a last ``*`` one or more. Patterns meet only calls with their number
    of segments and their first literal one (a ``*`` pattern: with its literal head)."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda s: s != "")
    c = calls.withColumn("cs", parts(F.col("path"))).withColumn("n", F.size("cs"))
    r = routes.withColumn("rs", parts(F.col("pattern"))).withColumn("star", F.element_at("rs", -1) == "*").withColumn("n", F.size("rs")).drop("path")
    r = r.withColumnRenamed("method", "route_method")
    fits = F.forall(F.arrays_zip("rs", "cs"), lambda z: (z["rs"] == z["cs"]) | z["rs"].rlike(r"^\{.*\}$"))
    same = F.col("method").isNull() | F.col("route_method").isin("ANY") | (F.col("method") == F.col("route_method"))
    # by the first literal segment and its place; patterns of placeholders alone by their length
    spot = F.array_position(F.transform("rs", lambda s: s.rlike(r"^\{.*\}$")), False).cast("int")
    fixed = r.where("not star").withColumn("spot", spot).withColumn("word", F.when(F.col("spot") > 0, F.element_at("rs", F.when(F.col("spot") > 0, F.col("spot")))).otherwise(""))
    spots = F.concat(F.array(F.struct(F.lit(0).alias("spot"), F.lit("").alias("word"))), F.transform("cs", lambda s, i: F.struct((i + 1).cast("int").alias("spot"), s.alias("word"))))
    plain = c.select("*", F.inline(spots)).join(fixed, ["n", "spot", "word"]).where(fits & same)
    head = F.col("n") - 1
    tail = c.withColumn("h", F.explode(F.sequence(F.lit(1), "n"))).withColumn("head", F.concat_ws("/", F.slice("cs", 1, F.col("h") - 1)))
    starred = r.where("star").withColumn("head", F.concat_ws("/", F.slice("rs", F.lit(1), head))).drop("n")
    wild = tail.join(starred, "head").where(same)
    return plain.select("call", "route").union(wild.select("call", "route")).distinct()


def first_candidate(candidates: DataFrame, targets: DataFrame, owner: str, key: str) -> DataFrame:
    """``candidates(owner, pos, key)``: the first that exists in ``targets(key)`` wins."""
    return candidates.join(shuffled(targets.select(key).distinct()), key).groupBy(owner).agg(F.min_by(key, "pos").alias(key))


def nearest_ancestor(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """The config whose directory is the longest prefix of each path's directories."""
    parts = F.split("path", "/")
    up = paths.select("path", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).alias("depth")).withColumn("dir", F.concat_ws("/", F.slice(F.split("path", "/"), F.lit(1), F.col("depth"))))
    return up.join(configs, "dir").groupBy("path").agg(F.max_by("config", "depth").alias("config"))


def suffix_index(paths: DataFrame, rows: int = 0) -> DataFrame:
    """Every suffix of whole segments of each path, without the extension; ``rows`` is about how many."""
    bare = F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/")
    return spread(paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(bare)), lambda i: F.array_join(F.slice(bare, i, F.size(bare)), "/"))).alias("suffix")), rows, "suffix")


def unique_name(names: DataFrame, paths: DataFrame, rows: int = 0) -> DataFrame:
    """A dotted name to the one file with that suffix, else to the one file with its
    last part, else NULL."""
    s = suffix_index(paths, rows)
    one = s.groupBy("suffix").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")
    d = names.select("name", F.replace("name", F.lit("."), F.lit("/")).alias("whole"), F.substring_index("name", ".", -1).alias("last")).distinct()
    d = d.join(shuffled(one.toDF("whole", "p1")), "whole", "left").join(shuffled(one.toDF("last", "p2")), "last", "left")
    return d.select("name", F.coalesce("p1", "p2").alias("path"))


def incident_seeds(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Exact path, else the one file of that base name, else ambiguous, else not found."""
    by_name = files.groupBy(basename(F.col("path")).alias("ref")).agg(F.count("*").alias("n"), F.min("path").alias("named"))
    d = refs.join(files.select(F.col("path").alias("ref"), F.lit(True).alias("exact")), "ref", "left").join(by_name, "ref", "left")
    status = F.when(F.col("exact"), "exact").when(F.col("n") == 1, "basename").when(F.col("n") > 1, "ambiguous").otherwise("not-in-project")
    return d.select("ref", status.alias("status"), F.when(F.col("exact"), F.col("ref")).when(F.col("n") == 1, F.col("named")).alias("path"))


def infer_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """A column with the name and type of just one other table's single key column; of two
    tables that point at each other the smaller name's direction stays."""
    k = keys.select(F.lower("col").alias("name"), "type", F.col("tbl").alias("parent")).where("parent is not null")
    # key columns of a name and type are counted, not met one by one; of two tables one is not the column's own
    groups = k.groupBy("name", "type").agg(F.count("*").alias("all"), F.min("parent").alias("first"), F.max("parent").alias("last"))
    own = k.groupBy("name", "type", F.col("parent").alias("tbl")).agg(F.count("*").alias("own"))
    d = columns.where("tbl is not null").select("tbl", "col", F.lower("col").alias("name"), "type")
    d = d.join(groups, ["name", "type"]).join(shuffled(own), ["name", "type", "tbl"], "left")
    d = d.select("tbl", "col", (F.col("all") - F.coalesce("own", F.lit(0))).alias("n"), F.when(F.col("first") == F.col("tbl"), F.col("last")).otherwise(F.col("first")).alias("parent")).where("n > 0")
    one = d.groupBy("tbl", "col").agg(F.sum("n").alias("n"), F.min("parent").alias("parent")).where("n = 1").drop("n")
    back = one.select(F.col("tbl").alias("parent"), F.col("parent").alias("tbl")).distinct().withColumn("mutual", F.lit(True))
    return one.join(back, ["tbl", "parent"], "left").where("mutual is null or tbl < parent").select("tbl", "col", "parent")


def reconcile(documented: DataFrame, found: DataFrame) -> DataFrame:
    """Policies of documents against those of code on (category, normalised subject)."""
    norm = F.lower(F.trim(F.regexp_replace("subject", r"\s+", " ")))
    first = lambda d, s: d.withColumn("norm", norm).groupBy("category", "norm").agg(F.min_by("subject", "seq").alias(s), F.count("*").alias(f"n_{s}"))
    d = first(documented, "doc").join(first(found, "code"), ["category", "norm"], "full_outer")
    status = F.when(F.col("doc").isNotNull() & F.col("code").isNotNull(), "compliant").when(F.col("code").isNull(), "doc-only").otherwise("undefined")
    more = F.when(F.col("n_code") > 1, F.concat(F.lit("+"), (F.col("n_code") - 1).cast("string"), F.lit(" more")))
    return d.select("category", "norm", status.alias("status"), F.coalesce(more, F.lit("")).alias("more"))


def federated_history(ledger: DataFrame, derived: DataFrame, most: int) -> DataFrame:
    """Ledger rows that are not derived already and the derived ones, newest first."""
    rest = ledger.join(derived.select("job"), "job", "left_anti")
    return rest.unionByName(derived).orderBy(F.desc("ts"), "job").limit(most)


def cross_check(entries: DataFrame, by_owner: DataFrame, by_reach: DataFrame) -> DataFrame:
    """How each entry point was hit; both ways is certain."""
    d = entries.join(by_owner.select("id").distinct().withColumn("o", F.lit(1)), "id", "left").join(by_reach.select("id").distinct().withColumn("r", F.lit(1)), "id", "left")
    way = F.when(F.col("o").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("o").isNotNull(), "ownership").when(F.col("r").isNotNull(), "reach")
    return d.select("id", way.alias("way"), F.when(way == "both", "CONFIRMED").otherwise("INFERRED").alias("confidence")).where("way is not null")


def placeholders(values: DataFrame, properties: DataFrame) -> DataFrame:
    """``${key:default}`` in each value, resolved against ``properties(key, seq, value)``, the
    first of a key winning; a key without value and default leaves the text unresolved."""
    first = properties.groupBy("key").agg(F.min_by("value", "seq").alias("found"))
    parts = values.select("id", "text", F.posexplode_outer(F.regexp_extract_all("text", F.lit(r"(\$\{[^}]*\})"), 1)).alias("pos", "mark"))
    inner = F.expr("substring(mark, 3, length(mark) - 3)")
    parts = parts.withColumn("key", F.substring_index(inner, ":", 1)).withColumn("fallback", F.when(inner.contains(":"), F.expr("substring(mark, 4 + length(substring_index(substring(mark, 3, length(mark) - 3), ':', 1)), length(mark) - 4 - length(substring_index(substring(mark, 3, length(mark) - 3), ':', 1)))")))
    parts = parts.join(first, "key", "left").withColumn("to", F.coalesce("found", "fallback"))
    d = parts.groupBy("id", "text").agg(F.sort_array(F.collect_list(F.struct("pos", "mark", "to"))).alias("marks"), F.bool_or(F.col("mark").isNotNull() & F.col("to").isNull()).alias("unresolved"))
    out = F.aggregate("marks", F.col("text"), lambda a, m: F.when(m["to"].isNull(), a).otherwise(F.replace(a, m["mark"], m["to"])))
    return d.select("id", out.alias("text"), "unresolved")


def recover_imports(imports: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports between existing nodes that no edge has yet, no self loops."""
    ids = nodes.select("id")
    d = imports.where("source <> target").distinct().join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return d.join(edges.where("kind = 'import'"), ["source", "target"], "left_anti")


def apply_fills(nodes: DataFrame, fills: DataFrame) -> DataFrame:
    """Generated text on its node; ``status`` filled, unfilled or rejected (no such node)."""
    d = nodes.select("id", "name").join(fills.select("id", F.col("name").alias("new")), "id", "full_outer")
    status = F.when(F.col("name").isNull(), "rejected").when(F.col("new").isNull(), "unfilled").otherwise("filled")
    return d.select("id", F.coalesce("new", "name").alias("name"), status.alias("status"))


@query(
    "j1_integrity",
    """n AS (SELECT DISTINCT id FROM raw_nodes)
SELECT e.seq, CASE WHEN a.id IS NULL AND b.id IS NULL THEN 'missing-both' WHEN a.id IS NULL THEN 'missing-source' WHEN b.id IS NULL THEN 'missing-target' ELSE 'ok' END AS problem
FROM raw_edges e LEFT JOIN n a ON a.id = source LEFT JOIN n b ON b.id = target""",
    ("raw_nodes", "raw_edges"),
)
def _j1(t: Tables) -> DataFrame:
    return integrity(t.raw_edges, t.raw_nodes).select("seq", F.coalesce("problem", F.lit("ok")).alias("problem"))


@query("j2_prune_members", "SELECT layer, coalesce(string_agg(CASE WHEN n.id IS NOT NULL THEN node_id END, ',' ORDER BY pos), '') AS ids FROM memberships LEFT JOIN nodes n ON n.id = node_id GROUP BY layer", ("nodes", "memberships"))
def _j2(t: Tables) -> DataFrame:
    groups = t.memberships.groupBy("layer").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("node_ids"))
    return prune_members(groups, t.nodes).select("layer", F.array_join("node_ids", ",").alias("ids"))


@query(
    "j3_rewrite_ends",
    """m AS (SELECT concat('file:', seq) AS old, path AS new FROM files WHERE seq % 2 = 0)
SELECT e.seq, coalesce(a.new, b.new, source) AS source, coalesce(c.new, d.new, target) AS target FROM raw_edges e
LEFT JOIN m a ON a.old = source LEFT JOIN m b ON b.old = replace(source, 'proj:', '') LEFT JOIN m c ON c.old = target LEFT JOIN m d ON d.old = replace(target, 'proj:', '')""",
    ("files", "raw_edges"),
)
def _j3(t: Tables) -> DataFrame:
    renamed = t.files.where("seq % 2 = 0").select(F.concat(F.lit("file:"), F.col("seq").cast("string")).alias("old"), F.col("path").alias("new"))
    return rewrite_ends(t.raw_edges, renamed, F.replace("end", F.lit("proj:"), F.lit(""))).select("seq", "source", "target")


@query(
    "j4_overlay",
    """s AS (SELECT path FROM files WHERE seq % 31 = 0), i AS (SELECT DISTINCT target AS path FROM file_edges WHERE source IN (SELECT path FROM s)),
b AS (SELECT path, 'seed' AS role FROM s UNION ALL SELECT path, 'affected' FROM i WHERE path NOT IN (SELECT path FROM s))
SELECT path, role, id FROM b LEFT JOIN nodes ON file_path = path""",
    ("files", "file_edges", "nodes"),
)
def _j4(t: Tables) -> DataFrame:
    seeds = t.files.where("seq % 31 = 0").select("path")
    hit = t.file_edges.join(seeds.withColumnRenamed("path", "source"), "source", "left_semi").select(F.col("target").alias("path")).distinct()
    return overlay(hit, seeds, t.nodes).select("path", "role", "id")


@query(
    "j5_merge_overlay",
    """old AS (SELECT id FROM nodes WHERE seq % 3 > 0), news AS (SELECT id FROM nodes WHERE seq % 3 < 2), fresh AS (SELECT id FROM news WHERE id NOT IN (SELECT id FROM old)),
k AS (SELECT id, 0 AS n FROM old UNION ALL SELECT id, 1 FROM fresh)
SELECT source, target, seq FROM edges WHERE kind = 'call' UNION ALL SELECT source, target, seq FROM edges JOIN k a ON a.id = source JOIN k b ON b.id = target WHERE kind = 'data' AND a.n + b.n > 0""",
    ("nodes", "edges"),
)
def _j5(t: Tables) -> DataFrame:
    cols = ["source", "target", "seq"]
    return merge_overlay(t.nodes.where("seq % 3 > 0"), t.edges.where("kind = 'call'").select(cols), t.nodes.where("seq % 3 < 2"), t.edges.where("kind = 'data'").select(cols))


@query(
    "j6_replace_changed",
    """g AS (SELECT nodes.id FROM nodes JOIN files f ON f.path = file_path WHERE f.seq % 9 = 0)
SELECT source, target, kind, seq FROM edges WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g)""",
    ("files", "nodes", "edges"),
)
def _j6(t: Tables) -> DataFrame:
    changed = t.files.where("seq % 9 = 0").select(F.col("path").alias("file_path"))
    return replace_changed(t.nodes, t.edges, changed)[1].select("source", "target", "kind", "seq")


_PRINTS = "b AS (SELECT path, concat('h', loc) AS hash FROM files WHERE seq % 11 > 0), a AS (SELECT path, concat('h', CASE WHEN seq % 7 = 0 THEN loc + 1 ELSE loc END) AS hash FROM files WHERE seq % 13 > 0)"


def _prints(t: Tables) -> tuple[DataFrame, DataFrame]:
    f = t.files
    h = lambda c: F.concat(F.lit("h"), c.cast("string")).alias("hash")
    return f.where("seq % 11 > 0").select("path", h(F.col("loc"))), f.where("seq % 13 > 0").select("path", h(F.when(F.col("seq") % 7 == 0, F.col("loc") + 1).otherwise(F.col("loc"))))


@query(
    "j7_stale_claims",
    f"{_PRINTS}, c AS (SELECT DISTINCT sha AS claim, path FROM commits WHERE deleted < 2) SELECT claim, bool_or(b.hash IS DISTINCT FROM a.hash) AS stale FROM c LEFT JOIN b USING (path) LEFT JOIN a USING (path) GROUP BY claim",
    ("files", "commits"),
)
def _j7(t: Tables) -> DataFrame:
    return stale_claims(t.commits.where("deleted < 2").select(F.col("sha").alias("claim"), "path").distinct(), *_prints(t))


@query(
    "j8_fingerprint_diff",
    f"{_PRINTS}, d AS (SELECT path, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'changed' END AS change FROM b FULL JOIN a USING (path)) SELECT * FROM d WHERE change IS NOT NULL",
    ("files",),
)
def _j8(t: Tables) -> DataFrame:
    return fingerprint_diff(*_prints(t))


@query("j9_set_delta", f"{_PRINTS} SELECT path, 'added' AS delta FROM a WHERE path NOT IN (SELECT path FROM b) UNION ALL SELECT path, 'removed' FROM b WHERE path NOT IN (SELECT path FROM a)", ("files",))
def _j9(t: Tables) -> DataFrame:
    return set_delta(*_prints(t), "path")


@query(
    "j10_route_links",
    """c AS (SELECT page_id AS call, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS method, concat('/api/', page_id % 6, '/', CASE page_id % 2 WHEN 0 THEN 'item' ELSE 'order' END, CASE WHEN page_id % 5 = 0 THEN '/more' ELSE '' END) AS path FROM pages)
SELECT call, 'a' AS route FROM c WHERE regexp_matches(path, '^/api/[^/]+/item$') AND (method IS NULL OR method = 'GET')
UNION ALL SELECT call, 'b' FROM c WHERE regexp_matches(path, '^/api/3/.+$') UNION ALL SELECT call, 'c' FROM c WHERE regexp_matches(path, '^/api/[^/]+/order/more$') AND (method IS NULL OR method = 'POST')""",
)
def _j10(t: Tables) -> DataFrame:
    n = F.col("page_id")
    path = F.concat(F.lit("/api/"), (n % 6).cast("string"), F.lit("/"), F.when(n % 2 == 0, "item").otherwise("order"), F.when(n % 5 == 0, "/more").otherwise(""))
    calls = t.pages.select(n.alias("call"), F.when(n % 3 == 0, "GET").when(n % 3 == 1, "POST").alias("method"), path.alias("path"))
    routes = t.spark.createDataFrame([("a", "GET", "/api/{id}/item"), ("b", "ANY", "/api/3/*"), ("c", "POST", "/api/{x}/order/more")], "route string, method string, pattern string")
    return route_links(calls, routes)


@query(
    "j13_first_candidate",
    """c AS (SELECT seq AS owner, i AS pos, regexp_replace(path, '\\.[a-z]+$', e) AS path FROM files, (VALUES (1, '.sql'), (2, '.py'), (3, '.ts'), (4, '.java')) x(i, e))
SELECT owner, arg_min(path, pos) AS path FROM c WHERE path IN (SELECT path FROM files) GROUP BY owner""",
    ("files",),
)
def _j13(t: Tables) -> DataFrame:
    stem = F.regexp_replace("path", r"\.[a-z]+$", "")
    c = t.files.select(F.col("seq").alias("owner"), F.posexplode(F.array(*[F.concat(stem, F.lit(e)) for e in (".sql", ".py", ".ts", ".java")])).alias("pos", "path"))
    return first_candidate(c, spread(t.files.select("path"), 4 * t.rows("part"), "path"), "owner", "path")


@query(
    "j14_nearest_ancestor",
    """d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM files), k AS (SELECT dir FROM d WHERE dir LIKE '%2%' OR dir LIKE '%/service' UNION SELECT 'src')
SELECT path, concat('cfg:', arg_max(dir, length(dir))) AS config FROM files JOIN k ON starts_with(path, concat(dir, '/')) GROUP BY path""",
    ("files",),
)
def _j14(t: Tables) -> DataFrame:
    dirs = t.files.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).distinct().where("dir like '%2%' or dir like '%/service'")
    dirs = dirs.union(dirs.limit(1).select(F.lit("src")))
    return nearest_ancestor(t.files.select("path"), dirs.withColumn("config", F.concat(F.lit("cfg:"), "dir")))


@query(
    "j16_unique_name",
    r"""s AS (SELECT path, regexp_replace(path, '\.[^./]*$', '') AS bare FROM files), n AS (SELECT DISTINCT replace(substr(bare, 5), '/', '.') AS name FROM s UNION SELECT concat('x.', regexp_extract(bare, '[^/]*$')) FROM s),
x AS (SELECT path, array_to_string(list_slice(string_split(bare, '/'), i, 99), '/') AS suffix FROM s, range(1, 9) r(i) WHERE i <= len(string_split(bare, '/'))),
o AS (SELECT suffix, min(path) AS path FROM x GROUP BY suffix HAVING count(*) = 1)
SELECT name, coalesce(a.path, b.path) AS path FROM n LEFT JOIN o a ON a.suffix = replace(name, '.', '/') LEFT JOIN o b ON b.suffix = regexp_extract(name, '[^.]*$')""",
    ("files",),
)
def _j16(t: Tables) -> DataFrame:
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    names = t.files.select(F.replace(F.expr("substring(regexp_replace(path, '\\\\.[^./]*$', ''), 5)"), F.lit("/"), F.lit(".")).alias("name")).union(t.files.select(F.concat(F.lit("x."), F.substring_index(bare, "/", -1))))
    return unique_name(names, t.files.select("path"), 4 * t.rows("part"))


@query(
    "j17_incident_seeds",
    """r AS (SELECT DISTINCT CASE seq % 3 WHEN 0 THEN path WHEN 1 THEN regexp_extract(path, '[^/]*$') ELSE concat('gone/', path) END AS ref FROM files), n AS (SELECT regexp_extract(path, '[^/]*$') AS ref, count(*) AS n, min(path) AS named FROM files GROUP BY 1)
SELECT ref, CASE WHEN f.path IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'basename' WHEN n > 1 THEN 'ambiguous' ELSE 'not-in-project' END AS status, CASE WHEN f.path IS NOT NULL THEN ref WHEN n = 1 THEN named END AS path
FROM r LEFT JOIN files f ON f.path = ref LEFT JOIN n USING (ref)""",
    ("files",),
)
def _j17(t: Tables) -> DataFrame:
    k = F.col("seq") % 3
    refs = t.files.select(F.when(k == 0, F.col("path")).when(k == 1, basename(F.col("path"))).otherwise(F.concat(F.lit("gone/"), "path")).alias("ref")).distinct()
    return incident_seeds(refs, t.files)


@query(
    "j21_infer_keys",
    """c AS (SELECT path AS tbl, concat('k', seq % 50, '_', loc) AS col, CASE WHEN seq % 2 = 0 THEN 'int' ELSE 'text' END AS type FROM files UNION ALL SELECT path, concat('K', seq % 50 - 1, '_', loc), 'int' FROM files),
k AS (SELECT path AS tbl, upper(concat('k', seq % 50, '_', loc)) AS col, 'int' AS type FROM files),
d AS (SELECT c.tbl, c.col, min(k.tbl) AS parent FROM c JOIN k ON lower(c.col) = lower(k.col) AND c.type = k.type AND c.tbl <> k.tbl GROUP BY c.tbl, c.col HAVING count(*) = 1)
SELECT tbl, col, parent FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.tbl = d.parent AND x.parent = d.tbl) OR tbl < parent""",
    ("files",),
)
def _j21(t: Tables) -> DataFrame:
    f = t.files.withColumn("name", F.concat(F.lit("k"), (F.col("seq") % 50).cast("string"), F.lit("_"), F.col("loc").cast("string")))
    other = F.concat(F.lit("K"), (F.col("seq") % 50 - 1).cast("string"), F.lit("_"), F.col("loc").cast("string"))
    columns = f.select(F.col("path").alias("tbl"), F.col("name").alias("col"), F.when(F.col("seq") % 2 == 0, "int").otherwise("text").alias("type"))
    columns = columns.union(f.select("path", other, F.lit("int")))
    return infer_keys(columns, f.select(F.col("path").alias("tbl"), F.upper("name").alias("col"), F.lit("int").alias("type")))


@query(
    "j23_reconcile",
    """d AS (SELECT event AS category, concat(' ', upper(entity), '  rule ') AS subject, seq FROM ledger WHERE seq % 3 = 0), c AS (SELECT event AS category, concat(entity, ' rule') AS subject, seq FROM ledger WHERE seq % 4 = 1),
x AS (SELECT category, lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) AS norm, count(*) AS n FROM d GROUP BY 1, 2), y AS (SELECT category, lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) AS norm, count(*) AS n FROM c GROUP BY 1, 2)
SELECT category, norm, CASE WHEN x.n IS NOT NULL AND y.n IS NOT NULL THEN 'compliant' WHEN y.n IS NULL THEN 'doc-only' ELSE 'undefined' END AS status, CASE WHEN y.n > 1 THEN concat('+', y.n - 1, ' more') ELSE '' END AS more
FROM x FULL JOIN y USING (category, norm)""",
    ("ledger",),
)
def _j23(t: Tables) -> DataFrame:
    e = t.ledger
    doc = e.where("seq % 3 = 0").select(F.col("event").alias("category"), F.concat(F.lit(" "), F.upper("entity"), F.lit("  rule ")).alias("subject"), "seq")
    return reconcile(doc, e.where("seq % 4 = 1").select(F.col("event").alias("category"), F.concat("entity", F.lit(" rule")).alias("subject"), "seq"))


@query(
    "j24_federated_history",
    """l AS (SELECT concat('j', o_orderkey) AS job, o_orderdate AS ts, 'ledger' AS src FROM orders), d AS (SELECT job, ts, 'derived' AS src FROM l WHERE hash(job) IS NOT NULL AND CAST(substr(job, 2) AS BIGINT) % 5 = 0)
SELECT * FROM (SELECT * FROM l WHERE job NOT IN (SELECT job FROM d) UNION ALL SELECT * FROM d) ORDER BY ts DESC, job LIMIT 200""",
)
def _j24(t: Tables) -> DataFrame:
    ledger = t.orders.select(F.concat(F.lit("j"), F.col("o_orderkey").cast("string")).alias("job"), F.col("o_orderdate").alias("ts"), F.lit("ledger").alias("src"))
    return federated_history(ledger, ledger.where("cast(substring(job, 2) as bigint) % 5 = 0").withColumn("src", F.lit("derived")), 200)


@query(
    "j25_cross_check",
    """o AS (SELECT DISTINCT source FROM edges WHERE kind = 'call'), r AS (SELECT DISTINCT target FROM edges WHERE kind = 'import'),
d AS (SELECT id, CASE WHEN source IS NOT NULL AND target IS NOT NULL THEN 'both' WHEN source IS NOT NULL THEN 'ownership' WHEN target IS NOT NULL THEN 'reach' END AS way FROM nodes LEFT JOIN o ON source = id LEFT JOIN r ON target = id)
SELECT id, way, CASE WHEN way = 'both' THEN 'CONFIRMED' ELSE 'INFERRED' END AS confidence FROM d WHERE way IS NOT NULL""",
    ("nodes", "edges"),
)
def _j25(t: Tables) -> DataFrame:
    return cross_check(t.nodes, t.edges.where("kind = 'call'").select(F.col("source").alias("id")), t.edges.where("kind = 'import'").select(F.col("target").alias("id")))


@query(
    "j29_placeholders",
    """v AS (SELECT seq AS id, domain, loc FROM files)
SELECT id, concat('http://', CASE WHEN domain < 'brand4' THEN upper(domain) ELSE 'local' END, ':', CASE WHEN loc % 2 = 0 THEN concat('P', loc) ELSE concat('${', 'port', loc, '}') END) AS text, loc % 2 = 1 AS unresolved FROM v""",
    ("files",),
)
def _j29(t: Tables) -> DataFrame:
    text = F.concat(F.lit("http://${host."), "domain", F.lit(":local}:${port"), F.col("loc").cast("string"), F.lit("}"))
    props = t.files.where("domain < 'brand4'").select(F.concat(F.lit("host."), "domain").alias("key"), "seq", F.upper("domain").alias("value"))
    props = props.union(t.files.where("loc % 2 = 0").select(F.concat(F.lit("port"), F.col("loc").cast("string")), "seq", F.concat(F.lit("P"), F.col("loc").cast("string"))))
    return placeholders(t.files.select(F.col("seq").alias("id"), text.alias("text")), props)


@query(
    "j30_recover_imports",
    """i AS (SELECT DISTINCT l_partkey, l_suppkey, concat('part:', l_partkey) AS source, concat('supplier:', l_suppkey) AS target FROM lineitem)
SELECT source, target FROM i WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) AND (source, target) NOT IN (SELECT (source, target) FROM edges WHERE kind = 'import')""",
    ("nodes", "edges"),
)
def _j30(t: Tables) -> DataFrame:
    imports = t.lineitem.select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("target"))
    return recover_imports(imports, t.nodes, t.edges)


@query(
    "j31_apply_fills",
    """f AS (SELECT concat('part:', seq + 50) AS id, path AS name FROM files WHERE seq % 3 = 0), n AS (SELECT id, name FROM nodes WHERE type = 'file')
SELECT coalesce(n.id, f.id) AS id, coalesce(f.name, n.name) AS name, CASE WHEN n.id IS NULL THEN 'rejected' WHEN f.id IS NULL THEN 'unfilled' ELSE 'filled' END AS status FROM n FULL JOIN f ON n.id = f.id""",
    ("files", "nodes"),
)
def _j31(t: Tables) -> DataFrame:
    fills = t.files.where("seq % 3 = 0").select(F.concat(F.lit("part:"), (F.col("seq") + 50).cast("string")).alias("id"), F.col("path").alias("name"))
    return apply_fills(t.nodes.where("type = 'file'"), fills)
