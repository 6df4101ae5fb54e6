"""Merge of batch graphs with a report of fixes by pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.functions import text as fn
from factloom.operators.validation import COMPLEXITIES, NODE_TYPES
from factloom.plans.ranges import number_rows
from factloom.plans.shared import materialize, shuffled, spread
from factloom.registry import query

# Prefixes of ids, the types whose ids hold a name, the directions that are told apart.
PREFIXES = ("file", "func", *[t for t in NODE_TYPES if t != "file"])
NAMED_TYPES = ("function", "class")
BATCH_DIRECTIONS = {"both": "bidirectional", "mutual": "bidirectional"}
_KNOWN = "|".join(PREFIXES)


def canonical_id(node_id: Column, kind: Column, path: Column, name: Column) -> Column:
    """A doubled prefix, a project's name before a known prefix and ``func:`` go; an id without a prefix
    gets its type's, functions and classes with the file's path (or a mark that there is none)."""
    once = F.regexp_replace(node_id, f"^({_KNOWN}):\\1:", "$1:")
    bare = F.regexp_replace(once, f"^(?!(?:{_KNOWN}):)[^:]+:((?:{_KNOWN}):.+)$", "$1")
    whole = F.regexp_replace(bare, "^func:", "function:")
    prefix = F.when(kind == "func", "function").when(kind.isin(*NODE_TYPES), kind).otherwise("file")
    named = F.concat(prefix, F.lit(":"), F.coalesce(F.nullif(path, F.lit("")), F.lit("__nofilepath__")), F.lit(":"), F.coalesce(name, whole))
    return F.when(whole.rlike(f"^({_KNOWN}):"), whole).when(kind.isin(*NAMED_TYPES), named).otherwise(F.concat(prefix, F.lit(":"), whole))


def id_pattern(before: Column, after: Column) -> Column:
    """What was wrong with an id, without its own names."""
    double, project = F.regexp_extract(before, f"^({_KNOWN}):\\1:", 1), F.regexp_extract(before, f"^(?!(?:{_KNOWN}):)[^:]*:({_KNOWN}):", 1)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(double != "", say(double, ":", double, ": → ", double, ": (double prefix)"))
        .when(project != "", say("<project>:", project, ": → ", project, ": (project-name prefix)"))
        .when(before.startswith("func:") & after.startswith("function:"), "func: → function: (prefix canonicalization)")
        .when(~before.rlike(f"^({_KNOWN}):"), say("bare path → ", F.substring_index(after, ":", 1), ": (missing prefix)"))
        .otherwise(say(before, " → ", after))
    )


def corrected(nodes: DataFrame) -> DataFrame:
    """``nodes(seq, id, type, name, path, complexity)`` that have an id, with the ``new`` one, the complexity's
    ``level`` and the ``state`` that it was in."""
    c = F.col
    d = nodes.where(c("id").isNotNull() & (c("id") != "")).withColumn("new", canonical_id(c("id"), c("type"), c("path"), c("name")))
    low = F.lower(F.trim("complexity"))
    return d.withColumn("level", F.when(low.isin(*COMPLEXITIES), low).when(low.isin(*fn.COMPLEXITIES), fn.alias(c("complexity"), fn.COMPLEXITIES)).otherwise("moderate")).withColumn("state", F.when(low.isin(*COMPLEXITIES), "valid").when(low.isin(*fn.COMPLEXITIES), "mapped").otherwise("unknown"))


def last_nodes(fixed: DataFrame) -> DataFrame:
    """Of each id of ``corrected`` nodes the last row."""
    last = fixed.groupBy(F.col("new").alias("id")).agg(F.max_by(F.struct("type", "name", "path", F.col("level").alias("complexity")), "seq").alias("x"))
    return last.select("id", "x.*")


def _numbered_ends(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with numbers for the ids of their ends, and ``names(number, id)``."""
    ids = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    names = materialize(number_rows(ids, ["id"], "number").select("number", "id"), "ends")
    for end in ("source", "target"):
        place = names.select(F.col("number").alias("_number"), F.col("id").alias("_id"))
        edges = edges.join(shuffled(place), F.col(end).eqNullSafe(F.col("_id"))).drop(end, "_id").withColumnRenamed("_number", end)
    return edges, names


def _followed(fixed: DataFrame, places: DataFrame, edges: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """``n`` edges whose ends are numbers of ``names(number, id)`` with ``source_at`` and ``target_at``, numbers of
    ``places(at, id)`` or null, for the corrected ids, and ``source_moved`` and ``target_moved``."""
    c = F.col
    # of an id that was corrected in several ways the last one holds, as for edges of all batches
    moved = fixed.where(c("new") != c("id")).groupBy("id").agg(F.max_by("new", "seq").alias("to"))
    ends = names.join(shuffled(moved), "id", "left").select("number", F.coalesce("to", "id").alias("id"), c("to").isNotNull().alias("moved"))
    ends = materialize(ends.join(shuffled(places), "id", "left").select("number", "at", "moved"), "batch_ends")
    for end in ("source", "target"):
        edges = edges.join(shuffled(spread(ends.select(c("number").alias(end), c("at").alias(f"{end}_at"), c("moved").alias(f"{end}_moved")), n, end)), end).drop(end)
    return edges


def last_edges(fixed: DataFrame, edges: DataFrame, names: DataFrame | None = None, n: int = 0) -> DataFrame:
    """Ends of ``edges(seq, source, target, type, direction, weight)`` follow the ids that were corrected; of an edge's
    ends, type and direction the greatest weight, the first of equals; edges without an end are dropped. With
    ``names(number, id)`` the ends of about ``n`` edges are numbers, and edges to a number without a name go."""
    c = F.col
    if names is None:
        edges, names = _numbered_ends(edges)
    places = materialize(number_rows(fixed.select(c("new").alias("id")).distinct(), ["id"], "at").select("at", "id"), "places")
    way = F.lower("direction")
    way = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in BATCH_DIRECTIONS.items() for x in p]), way), way)
    e = edges.select("seq", "source", "target", "type", F.when(way.isin("forward", "backward", "bidirectional"), way).otherwise("forward").alias("direction"), c("weight").try_cast("double").alias("weight"))
    kept = _followed(fixed, places, e, names, n).where("source_at is not null and target_at is not null")
    heavy = F.struct(F.coalesce("weight", F.lit(0.0)).alias("w"), (-c("seq")).alias("s"))
    out = kept.groupBy("source_at", "target_at", "type", "direction").agg(F.max_by("weight", heavy).alias("weight"))
    for end in ("source", "target"):
        out = out.join(shuffled(spread(places.select(c("at").alias(f"{end}_at"), c("id").alias(end)), n, f"{end}_at")), f"{end}_at")
    return out.select("source", "target", "type", "direction", "weight")


def findings(nodes: DataFrame, fixed: DataFrame, edges: DataFrame, names: DataFrame | None = None, n: int = 0) -> DataFrame:
    """``report(part, pattern, n)`` with ``fixed`` and ``open`` findings; ``names`` and ``n`` as for ``last_edges``."""
    c, kind = F.col, F.col("type")
    if names is None:
        edges, names = _numbered_ends(edges)
    places = materialize(number_rows(fixed.select(c("new").alias("id")).distinct(), ["id"], "at").select("at", "id"), "places")
    e = _followed(fixed, places, edges.select("source", "target"), names, n)
    no_source = c("source_at").isNull()
    met = e.agg(F.count_if(c("source_moved") | c("target_moved")).alias("moved"), F.count_if(no_source).alias("source"), F.count_if(~no_source & c("target_at").isNull()).alias("target"))
    said = [("fixed", "edge references rewritten", "moved"), ("open", "edge without source", "source"), ("open", "edge without target", "target")]
    of_edges = met.select(F.inline(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(pattern).alias("pattern"), c(name).alias("n")) for part, pattern, name in said]))).where("n > 0")
    lost = nodes.where(c("id").isNull() | (c("id") == ""))
    count = lambda rows, part, pattern: rows.groupBy(F.lit(part).alias("part"), pattern.alias("pattern")).agg(F.count("*").alias("n"))
    shown = F.coalesce(F.concat(F.lit('"'), "complexity", F.lit('"')), F.lit("None"))
    again = fixed.groupBy("new").agg((F.count("*") - 1).alias("k")).agg(F.sum("k").alias("n")).where("n > 0").select(F.lit("fixed").alias("part"), F.lit("duplicate node ids removed").alias("pattern"), "n")
    parts = [
        count(fixed.where(c("new") != c("id")), "fixed", id_pattern(c("id"), c("new"))),
        count(fixed.where("state = 'mapped'"), "fixed", F.concat(F.lit("complexity "), shown, F.lit(' → "'), "level", F.lit('"'))),
        of_edges,
        again,
        count(fixed.where((kind != "") & ~kind.isin(*NODE_TYPES, "func")), "open", F.concat(F.lit("unknown node type "), kind)),
        count(fixed.where("state = 'unknown'"), "open", F.concat(F.lit("complexity "), shown, F.lit(" → moderate"))),
        count(lost, "open", F.lit("node without id")),
    ]
    return reduce(DataFrame.union, parts)


def merge_batches(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes(seq, id, type, name, path, complexity)`` and ``edges(seq, source, target, type, direction, weight)`` of
    all batches in order -> nodes (``last_nodes``), edges (``last_edges``) and report (``findings``)."""
    fixed = materialize(corrected(nodes), "batch_nodes")
    return last_nodes(fixed), last_edges(fixed, edges), findings(nodes, fixed, edges)


_BATCH = """n AS (SELECT seq, CASE seq % 7 WHEN 0 THEN concat('proj:file:', path) WHEN 1 THEN concat('file:file:', path) WHEN 2 THEN concat('func:', path) WHEN 3 THEN path WHEN 4 THEN '' ELSE concat('file:', path) END AS id, ['function', 'file', 'widget', 'class', 'config'][loc % 5 + 1] AS type, concat('N', seq % 50) AS name, CASE WHEN seq % 2 = 0 THEN path END AS path,
    CASE seq % 6 WHEN 0 THEN 'LOW' WHEN 1 THEN ' hard ' WHEN 2 THEN 'odd' WHEN 3 THEN NULL ELSE 'Simple' END AS complexity, FALSE AS again FROM files UNION ALL SELECT 1000000 + seq, concat('file:', path), 'file', 'again', path, 'complex', TRUE FROM files WHERE seq % 7 = 5 AND seq % 2 = 0),
g AS (SELECT seq, source AS s0, target AS t0, kind AS type, CASE seq % 5 WHEN 0 THEN 'Both' WHEN 1 THEN 'backward' WHEN 2 THEN 'odd' END AS way, CASE WHEN seq % 4 = 0 THEN 'x' ELSE CAST(line AS VARCHAR) END AS weight FROM file_edges),
x AS (SELECT *, CASE seq % 7 WHEN 0 THEN replace(id, 'proj:', '') WHEN 1 THEN replace(id, 'file:file:', 'file:') WHEN 2 THEN concat('function:', substr(id, 6)) WHEN 3 THEN CASE WHEN type IN ('function', 'class') THEN concat(type, ':', coalesce(path, '__nofilepath__'), ':', name) ELSE concat(CASE WHEN type = 'widget' THEN 'file' ELSE type END, ':', id) END ELSE id END AS new0 FROM n WHERE id <> ''),
y AS (SELECT *, CASE WHEN again THEN id ELSE new0 END AS new, CASE lower(trim(complexity)) WHEN 'low' THEN 'simple' WHEN 'hard' THEN 'complex' WHEN 'simple' THEN 'simple' WHEN 'complex' THEN 'complex' ELSE 'moderate' END AS level, CASE WHEN lower(trim(complexity)) IN ('simple', 'moderate', 'complex') THEN 'valid' WHEN lower(trim(complexity)) IN ('low', 'hard') THEN 'mapped' ELSE 'unknown' END AS state FROM x),
raw AS (SELECT g.seq, a.id AS source, b.id AS target, g.type, way, weight FROM g JOIN files fa ON fa.path = s0 JOIN files fb ON fb.path = t0 JOIN n a ON a.seq = fa.seq AND NOT a.again JOIN n b ON b.seq = fb.seq AND NOT b.again),
mv AS (SELECT id, arg_max(new, seq) AS new FROM y WHERE new <> id GROUP BY id),
e AS (SELECT r.seq, coalesce(ms.new, source) AS source, coalesce(mt.new, target) AS target, type, CASE lower(way) WHEN 'both' THEN 'bidirectional' WHEN 'backward' THEN 'backward' ELSE 'forward' END AS direction, TRY_CAST(weight AS DOUBLE) AS weight, ms.new IS NOT NULL OR mt.new IS NOT NULL AS moved FROM raw r LEFT JOIN mv ms ON ms.id = source LEFT JOIN mv mt ON mt.id = target),
la AS (SELECT new AS id, arg_max({'type': type, 'name': name, 'path': path, 'complexity': level}, seq) AS x FROM y GROUP BY new), ou AS (SELECT source, target, type, direction, arg_max({'w': weight}, (coalesce(weight, 0), -seq)).w AS weight FROM e WHERE source IN (SELECT id FROM la) AND target IN (SELECT id FROM la) GROUP BY source, target, type, direction)"""


def _batch(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges with numbers for ends, and ``names(number, id)`` of the files."""
    s, p = F.col("seq"), F.col("path")
    pre = lambda head: F.concat(F.lit(head), p)
    node_id = F.when(s % 7 == 0, pre("proj:file:")).when(s % 7 == 1, pre("file:file:")).when(s % 7 == 2, pre("func:")).when(s % 7 == 3, p).when(s % 7 == 4, "").otherwise(pre("file:"))
    kind = F.element_at(F.array(*map(F.lit, ("function", "file", "widget", "class", "config"))), (F.col("loc") % 5 + 1).cast("int"))
    level = F.when(s % 6 == 0, "LOW").when(s % 6 == 1, " hard ").when(s % 6 == 2, "odd").when(s % 6 == 3, None).otherwise("Simple")
    nodes = t.files.select("seq", node_id.alias("id"), kind.alias("type"), F.concat(F.lit("N"), (s % 50).cast("string")).alias("name"), F.when(s % 2 == 0, p).alias("path"), level.alias("complexity"))
    nodes = nodes.union(t.files.where("seq % 7 = 5 and seq % 2 = 0").select(s + 1000000, pre("file:"), F.lit("file"), F.lit("again"), p, F.lit("complex")))
    names = t.files.where("path is not null").select(s.alias("number"), node_id.alias("id"))
    way = F.when(s % 5 == 0, "Both").when(s % 5 == 1, "backward").when(s % 5 == 2, "odd")
    edges = t.raw_links().select("seq", F.col("s").alias("source"), F.col("t").alias("target"), F.col("kind").alias("type"), way.alias("direction"), F.when(s % 4 == 0, "x").otherwise(F.col("line").cast("string")).alias("weight"))
    return nodes, edges, names


@query("u2_batch_nodes", f"{_BATCH} SELECT id, x.type, x.name, x.path, x.complexity FROM la", ("files", "file_edges"))
def _u2a(t: Tables) -> DataFrame:
    return last_nodes(corrected(_batch(t)[0]))


@query("u2_batch_edges", f"{_BATCH} SELECT * FROM ou", ("files", "file_edges"))
def _u2b(t: Tables) -> DataFrame:
    nodes, edges, names = _batch(t)
    return last_edges(materialize(corrected(nodes).select("seq", "id", "new"), "batch_nodes"), edges, names, t.rows("lineitem"))


@query(
    "u2_batch_report",
    f"""{_BATCH} SELECT 'fixed' AS part, CASE seq % 7 WHEN 0 THEN '<project>:file: → file: (project-name prefix)' WHEN 1 THEN 'file:file: → file: (double prefix)' WHEN 2 THEN 'func: → function: (prefix canonicalization)' ELSE concat('bare path → ', string_split(new, ':')[1], ': (missing prefix)') END AS pattern, count(*) AS n FROM y WHERE new <> id GROUP BY ALL
UNION ALL SELECT 'fixed', concat('complexity "', complexity, '" → "', level, '"'), count(*) FROM y WHERE state = 'mapped' GROUP BY ALL UNION ALL SELECT 'fixed', 'edge references rewritten', count(*) FROM e WHERE moved HAVING count(*) > 0
UNION ALL SELECT 'fixed', 'duplicate node ids removed', count(*) FROM (SELECT row_number() OVER (PARTITION BY new ORDER BY seq) AS k FROM y) WHERE k > 1 HAVING count(*) > 0 UNION ALL SELECT 'open', 'unknown node type widget', count(*) FROM y WHERE type = 'widget' HAVING count(*) > 0
UNION ALL SELECT 'open', concat('complexity ', coalesce(concat('"', CASE WHEN complexity IS NOT NULL THEN complexity END, '"'), ''), ' → moderate'), count(*) FROM y WHERE state = 'unknown' AND complexity IS NOT NULL GROUP BY ALL UNION ALL SELECT 'open', 'complexity None → moderate', count(*) FROM y WHERE complexity IS NULL HAVING count(*) > 0
UNION ALL SELECT 'open', 'node without id', count(*) FROM n WHERE id = '' HAVING count(*) > 0 UNION ALL SELECT 'open', 'edge without source', count(*) FROM e WHERE source NOT IN (SELECT id FROM la) HAVING count(*) > 0
UNION ALL SELECT 'open', 'edge without target', count(*) FROM e WHERE source IN (SELECT id FROM la) AND target NOT IN (SELECT id FROM la) HAVING count(*) > 0""",
    ("files", "file_edges"),
)
def _u2c(t: Tables) -> DataFrame:
    nodes, edges, names = _batch(t)
    return findings(nodes, materialize(corrected(nodes), "batch_nodes"), edges, names, t.rows("lineitem"))
