"""Projections, filters and path predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.registry import query

# Names, suffixes and segments of the tool chain whose reports these are.
SKIPPED_SEGMENTS = ("node_modules", "build", "dist", "target", "vendor")
ROLES = (("controller", "controller"), ("service", "service"), ("repository", "repository"), ("entity", "entity"))
EDGE_CATEGORIES = {"import": "dependencies", "call": "behavioral", "inherit": "structural"}


def node_filter(nodes: DataFrame, memberships: DataFrame, types: Sequence[str], complexities: Sequence[str], layers: Sequence[str]) -> DataFrame:
    """Nodes of the chosen types and complexities in any of the chosen layers; an empty
    layer choice sets no bound."""
    kept = nodes.where(F.col("type").isin(*types) & F.col("complexity").isin(*complexities))
    if not layers:
        return kept
    inside = memberships.where(F.col("layer").isin(*layers)).select(F.col("node_id").alias("id"))
    return kept.join(inside, "id", "left_semi")


def edge_filter(edges: DataFrame, nodes: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Edges between visible nodes whose kind's category is chosen; a kind without one passes."""
    table = F.create_map(*[F.lit(x) for pair in EDGE_CATEGORIES.items() for x in pair])
    category = table[F.col("kind")]
    ids = nodes.select("id")
    kept = edges.where(category.isNull() | category.isin(*categories))
    return kept.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def flow_filter(flows: DataFrame, text: str = "", **choices: Sequence[str]) -> DataFrame:
    """Rows whose name or path holds the text, ignoring case, and whose columns are in the
    chosen sets; an empty set sets no bound."""
    kept = flows
    if text:
        kept = kept.where(F.lower("name").contains(text.lower()) | F.lower("path").contains(text.lower()))
    for column, chosen in choices.items():
        if chosen:
            kept = kept.where(F.col(column).isin(*chosen))
    return kept


def facets(flows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The values present in each facet column, with counts, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return flows.select(F.explode(pairs).alias("x")).where("x.value is not null").groupBy("x.facet", "x.value").count()


def is_generated(path: Column) -> Column:
    """P5."""
    return path.startswith("dist/") | path.contains("/build/") | path.contains("/generated/") | path.endswith(".min.js") | path.endswith("package-lock.json")


def has_skipped_segment(path: Column) -> Column:
    """P6."""
    return F.exists(F.split(path, "/"), lambda s: s.isin(*SKIPPED_SEGMENTS))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """By file name, then by extension; the first rule wins."""
    name = F.lower(basename(path))
    by_suffix = {".java": "java", ".ts": "typescript", ".py": "python", ".xml": "xml", ".sql": "sql", ".md": "markdown"}
    out = F.when(name == "dockerfile", "dockerfile").when(name.startswith("makefile"), "makefile")
    for suffix, lang in by_suffix.items():
        out = out.when(name.endswith(suffix), lang)
    return out.otherwise("unknown")


def category(path: Column) -> Column:
    return F.when(language(path).isin("xml"), "config").when(language(path).isin("sql"), "data").when(language(path).isin("markdown"), "docs").otherwise("code")


def is_test(path: Column) -> Column:
    """A test or tests segment, or a base name that says so."""
    return path.rlike("(^|/)tests?/") | basename(path).rlike(r"(Test|Tests|Spec)\d*\.java$|\.(test|spec)\.[jt]sx?$|^test_.*\.py$")


def is_root_ineligible(path: Column) -> Column:
    """Tests and markup are no roots of a domain."""
    return is_test(path) | path.rlike(r"\.(xml|html?|jsp|css)$")


def is_trivial_evidence(snippet: Column) -> Column:
    """P10: shorter than 8, a Hangul syllable counting two, or without a word-like token."""
    size = F.char_length(F.trim(snippet)) + F.regexp_count(snippet, F.lit(r"[가-힣]"))
    return (size < 8) | ~snippet.rlike(r"[A-Za-z_가-힣][A-Za-z0-9_가-힣]+")


def seed_routes(routes: DataFrame, excluded: DataFrame) -> DataFrame:
    """First GET or ANY route of each list-like path without a template, not excluded.

    ``routes(method, path, seq)``, ``excluded(path)``."""
    leaf = F.lower(F.substring_index("path", "/", -1))
    kept = routes.where(F.col("method").isin("GET", "ANY") & leaf.rlike("list|index|search|main") & ~F.lower("path").rlike("delete|update|save|insert") & ~F.col("path").rlike(r"[{}*:]"))
    return kept.groupBy("path").agg(F.min_by("method", "seq").alias("method"), F.min("seq").alias("seq")).join(excluded.select("path"), "path", "left_anti")


def role(path: Column) -> Column:
    """Architecture role; the first match wins."""
    low = F.lower(path)
    out = F.when(low.endswith(".xml"), "xml")
    for word, name in ROLES:
        out = out.when(low.contains(word), name)
    return out.otherwise("other")


@query(
    "p1_node_filter",
    "SELECT id, type, complexity FROM nodes WHERE type IN ('file', 'class') AND complexity IN ('simple', 'complex') AND id IN (SELECT node_id FROM memberships WHERE layer IN ('brand11', 'brand23', 'building'))",
    ("nodes", "memberships"),
)
def _p1(t: Tables) -> DataFrame:
    return node_filter(t.nodes, t.memberships, ["file", "class"], ["simple", "complex"], ["brand11", "brand23", "building"]).select("id", "type", "complexity")


@query(
    "p2_edge_filter",
    """seen AS (SELECT id FROM nodes WHERE complexity <> 'moderate')
SELECT source, target, kind, seq FROM edges WHERE kind NOT IN ('inherit') AND kind IN ('call', 'data')
AND source IN (SELECT id FROM seen) AND target IN (SELECT id FROM seen)""",
    ("nodes", "edges"),
)
def _p2(t: Tables) -> DataFrame:
    return edge_filter(t.edges, t.nodes.where("complexity <> 'moderate'"), ["behavioral"]).select("source", "target", "kind", "seq")


_FLOWS = "SELECT page_id AS seq, url AS path, regexp_replace(url, '[0-9]+', '{id}', 'g') AS name, CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'ANY' ELSE 'DELETE' END AS method, CASE page_id % 3 WHEN 0 THEN 'grounded' WHEN 1 THEN 'review' ELSE NULL END AS verdict FROM pages"


def _flows(t: Tables) -> DataFrame:
    n = F.col("page_id") % 4
    return t.pages.select(
        F.col("page_id").alias("seq"),
        F.col("url").alias("path"),
        F.regexp_replace("url", "[0-9]+", "{id}").alias("name"),
        F.when(n == 0, "GET").when(n == 1, "POST").when(n == 2, "ANY").otherwise("DELETE").alias("method"),
        F.when(F.col("page_id") % 3 == 0, "grounded").when(F.col("page_id") % 3 == 1, "review").alias("verdict"),
    )


@query("p3_flow_filter", f"flows AS ({_FLOWS}) SELECT seq, path, method FROM flows WHERE (lower(name) LIKE '%/e%' OR lower(path) LIKE '%/e%') AND method IN ('GET', 'ANY') AND verdict IN ('grounded')")
def _p3(t: Tables) -> DataFrame:
    return flow_filter(_flows(t), "/E", method=["GET", "ANY"], verdict=["grounded"], name=[]).select("seq", "path", "method")


@query("p4_facets", f"flows AS ({_FLOWS}) SELECT 'method' AS facet, method AS value, count(*) AS count FROM flows GROUP BY method UNION ALL SELECT 'verdict', verdict, count(*) FROM flows WHERE verdict IS NOT NULL GROUP BY verdict")
def _p4(t: Tables) -> DataFrame:
    return facets(_flows(t), ["method", "verdict"])


@query(
    "p5_p12_path_predicates",
    r"""SELECT path, path LIKE '%/build/%' AS generated, path LIKE '%/build/%' AS skipped, lang AS language,
  CASE lang WHEN 'xml' THEN 'config' WHEN 'sql' THEN 'data' ELSE 'code' END AS category,
  path LIKE '%/test/%' OR regexp_matches(path, 'Test[0-9]*\.java$') AS test,
  path LIKE '%/test/%' OR regexp_matches(path, 'Test[0-9]*\.java$') OR lang = 'xml' AS ineligible,
  CASE WHEN lang = 'xml' THEN 'xml' WHEN path ILIKE '%controller%' THEN 'controller' WHEN path ILIKE '%service%' THEN 'service' WHEN path ILIKE '%repository%' THEN 'repository' ELSE 'other' END AS role
FROM files""",
    ("files",),
)
def _p5(t: Tables) -> DataFrame:
    p = F.col("path")
    return t.files.select(
        "path", is_generated(p).alias("generated"), has_skipped_segment(p).alias("skipped"), language(p).alias("language"), category(p).alias("category"), is_test(p).alias("test"), is_root_ineligible(p).alias("ineligible"), role(p).alias("role")
    )


@query("p10_trivial_evidence", r"SELECT doc_id, line_no, length(trim(line, ' ')) < 8 OR NOT regexp_matches(line, '[A-Za-z_][A-Za-z0-9_]+') AS trivial FROM lines", ("lines",))
def _p10(t: Tables) -> DataFrame:
    return t.lines.select("doc_id", "line_no", is_trivial_evidence(F.col("line")).alias("trivial"))


@query(
    "p11_seed_routes",
    f"""flows AS ({_FLOWS}), routes AS (SELECT method, concat('/', method, '/', CASE seq % 3 WHEN 0 THEN 'orderList' WHEN 1 THEN 'main' ELSE 'updateMain' END, seq % 20) AS path, seq FROM flows)
SELECT path, arg_min(method, seq) AS method, min(seq) AS seq FROM routes WHERE method IN ('GET', 'ANY') AND path NOT LIKE '%updateMain%' AND path NOT LIKE '%7' GROUP BY path""",
)
def _p11(t: Tables) -> DataFrame:
    n = F.col("seq")
    leaf = F.when(n % 3 == 0, "orderList").when(n % 3 == 1, "main").otherwise("updateMain")
    routes = _flows(t).select("method", F.concat(F.lit("/"), "method", F.lit("/"), leaf, (n % 20).cast("string")).alias("path"), "seq")
    return seed_routes(routes, routes.where(F.col("path").endswith("7")))
