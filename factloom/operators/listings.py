"""Numberings, fixed orders, dictionaries, plans and catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.functions import text as fn
from factloom.operators.extract import _SQL_LINES, _sql_lines
from factloom.plans.ranges import number_rows
from factloom.registry import query

# Layers of a step, in the order in which they are looked for.
LAYERS = ("db", "dao", "api", "service")


def function_numbers(functions: DataFrame) -> DataFrame:
    """``FN-001`` and on over domains in order, functions without a domain last."""
    placed = number_rows(functions, ["domain is null", "domain", "key"])
    digits = F.greatest(F.length(F.col("place").cast("string")), F.lit(3))
    return placed.withColumn("number", F.concat(F.lit("FN-"), F.lpad(F.col("place").cast("string"), digits, "0")))


def annotation_numbers(marks: DataFrame, band: int = 8) -> DataFrame:
    """Per screen and kind by rows of ``band`` pixels, then from the left, then by selector."""
    w = Window.partitionBy("screen", "kind").orderBy(F.floor(F.col("y") / band + 0.5), "x", "selector", "y")
    return marks.withColumn("number", F.row_number().over(w))


def onboarding_ranks(domains: DataFrame) -> DataFrame:
    """``3 complexity + 2 coupling + size``, highest first."""
    score = 3 * F.col("complexity") + 2 * F.col("coupling") + F.col("size")
    return number_rows(domains.withColumn("score", score), ["-score", "key"], "rank")


def precedents_first(scored: DataFrame, limit: int = 5) -> DataFrame:
    """K3: per request the ``limit`` flows of highest score."""
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "flow"))
    return scored.withColumn("place", place).where(F.col("place") <= limit)


def fixed_order(rows: DataFrame, column: str, ranks: Sequence[str], key: str) -> DataFrame:
    """K5: by the place of ``column`` in ``ranks``, values that are not there last, then by key."""
    at = F.array_position(F.array(*map(F.lit, ranks)), F.col(column))
    return number_rows(rows.withColumn("rank", F.when(at > 0, at).otherwise(len(ranks) + 1)), ["rank", key])


def reading_order(documents: DataFrame) -> DataFrame:
    """K9: by priority where there is one, else by node order, else by id."""
    return number_rows(documents, ["priority is null", "priority", "node_order is null", "node_order", "id"])


def layer_of(db: Column, dao: Column, api: Column, service: Column) -> Column:
    """The first layer whose signal is there."""
    out = F.lit("unknown")
    for name, signal in reversed(list(zip(LAYERS, (db, dao, api, service), strict=True))):
        out = F.when(signal, name).otherwise(out)
    return out


def table_frequency(lines: DataFrame, limit: int = 3) -> DataFrame:
    """Per file the tables that its SQL names most often."""
    names = F.explode(F.regexp_extract_all("line", F.lit(r"(?i)\b(?:from|join|into|update)\s+([A-Za-z_]+)"), F.lit(1)))
    counted = lines.select("file", names.alias("tbl")).groupBy("file", F.lower("tbl").alias("tbl")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "tbl"))
    return counted.withColumn("place", place).where(F.col("place") <= limit)


def unmatched(files: DataFrame, mapped: DataFrame, fragments: DataFrame) -> DataFrame:
    """U8: paths that are neither mapped nor fragments."""
    return files.select("path").subtract(mapped.select("path")).subtract(fragments.select("path"))


def apply_plan(plan: DataFrame, operations: Sequence[tuple]) -> DataFrame:
    """``plan(domain, root, grp)`` after the operations, in their order, with ``alias_keys``, the
    keys that were merged into the row's domain or renamed to it, joined by commas. The list is a person's, so it is short; each
    operation is one projection or filter of all rows. Domains and groups without a root are gone
    with their last row. A domain, root or group that is not there is an error, as is a merge of a
    domain into itself; whether they are is looked up once, at the start, and kept up by the
    operations. A row with a null domain belongs to none and stays.

    Operations: ``merge(froms, into)``, ``rename(old, new)``, ``move(root prefix, to)``, ``split(domain,
    infix, new)``, ``exclude(domain)``, ``group(name, domains)``, ``ungroup(name)``."""
    domain, root, grp = F.col("domain"), F.col("root"), F.col("grp")
    aliases: dict[str, set[str]] = {}
    named = [a for name, *args in operations for a in [*_domains_of(name, args), *({"rename": args[1:2], "split": args[2:3]}.get(name, []))]]
    known = {r[0] for r in plan.where(domain.isin(*named)).select("domain").distinct().collect()} if named else set()
    groups = {r[0] for r in plan.where(grp.isNotNull()).select("grp").distinct().where(grp.isin(*[a[1] for a in operations if a[0] == "ungroup"])).collect()} if any(a[0] == "ungroup" for a in operations) else set()
    for i, (name, *args) in enumerate(operations):
        missing = [d for d in _domains_of(name, args) if d not in known]
        if missing:
            raise ValueError(f"operation {i} {name}: unknown domain {missing[0]}")
        if name in ("rename", "merge"):
            olds, new = ([args[0]], args[1]) if name == "rename" else (list(args[0]), args[1])
            if name == "merge" and new in olds:
                raise ValueError(f"operation {i} merge: {new} into itself")
            if name == "rename" and new in known:
                raise ValueError(f"operation {i} rename: {new} is there already")
            aliases[new] = aliases.get(new, set()).union(olds, *[aliases.pop(old, set()) for old in olds])
            plan = plan.withColumn("domain", F.when(domain.isin(*olds), new).otherwise(domain))
            known = (known - set(olds)) | {new}
        elif name == "move":
            if plan.where(root.startswith(args[0])).isEmpty():
                raise ValueError(f"operation {i} move: no root {args[0]}")
            plan = plan.withColumn("domain", F.when(root.startswith(args[0]), args[1]).otherwise(domain))
        elif name == "split":
            if args[2] in known:
                raise ValueError(f"operation {i} split: {args[2]} is there already")
            plan = plan.withColumn("domain", F.when((domain == args[0]) & root.contains(args[1]), args[2]).otherwise(domain))
            known |= {args[2]}
        elif name == "exclude":
            plan = plan.where(~domain.eqNullSafe(args[0]))
            known -= {args[0]}
        elif name == "group":
            plan = plan.withColumn("grp", F.when(domain.isin(*args[1]), args[0]).otherwise(grp))
            groups |= {args[0]}
        elif name == "ungroup":
            if args[0] not in groups:
                raise ValueError(f"operation {i} ungroup: unknown group {args[0]}")
            plan = plan.withColumn("grp", F.when(grp == args[0], F.lit(None)).otherwise(grp))
        else:
            raise ValueError(f"no plan operation {name}")
    old_keys = F.lit("")
    for key, olds in aliases.items():
        old_keys = F.when(domain == key, ",".join(sorted(olds))).otherwise(old_keys)
    return plan.withColumn("alias_keys", old_keys)


def _domains_of(name: str, args: list) -> list[str]:
    """Domains that an operation needs to be there."""
    return {"rename": lambda: [args[0]], "merge": lambda: [*args[0], args[1]], "move": lambda: [args[1]], "split": lambda: [args[0]], "exclude": lambda: [args[0]], "group": lambda: list(args[1])}.get(name, list)()


def definition_differences(columns: DataFrame) -> DataFrame:
    """``columns(tbl, seq, col, type)``, seq one definition; per later definition of a table
    the columns in which it differs from the first, names compared without case."""
    d = columns.select(F.lower("tbl").alias("tbl"), "seq", F.lower("col").alias("col"), "type")
    first = d.groupBy("tbl").agg(F.min("seq").alias("first"))
    d = d.join(first, "tbl")
    kept = d.where("seq = first").select("tbl", "col", F.col("type").alias("first_type"))
    later = d.where("seq > first").select("tbl", "seq").distinct()
    other = d.where("seq > first").select("tbl", "seq", "col", "type")
    both = later.join(kept, "tbl").join(other, ["tbl", "seq", "col"], "full_outer")
    differ = both.where(~F.col("first_type").eqNullSafe(F.col("type")))
    return differ.groupBy("tbl", "seq").agg(F.array_join(F.array_sort(F.collect_set("col")), ",").alias("columns"))


def attach_comments(columns: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns with the first comment on each, and the comments on no known column."""
    first = comments.groupBy("tbl", "col").agg(F.min_by("comment", "seq").alias("comment"))
    return columns.join(first, ["tbl", "col"], "left"), comments.join(columns.select("tbl", "col").distinct(), ["tbl", "col"], "left_anti")


def planned_stubs(requested: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each requested function without code; its domain is the first part of its id."""
    stubs = requested.select("id").distinct().join(known.select("id"), "id", "left_anti")
    stubs = stubs.select("id", F.substring_index("id", "-", 1).alias("domain"), F.lit("planned").alias("status"))
    return known.select("id", "domain", F.lit("found").alias("status")).union(stubs)


def catalogue(sections: dict[str, DataFrame]) -> DataFrame:
    """``(section, key, evidence, n)``: each key of a section once, with its first evidence."""
    parts = [d.groupBy("key").agg(F.min("evidence").alias("evidence"), F.count("*").alias("n")).select(F.lit(name).alias("section"), "key", "evidence", "n") for name, d in sections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def include_fragments(includes: DataFrame, files: DataFrame) -> DataFrame:
    """Files that another file includes: by the whole path, else by the only path that ends so."""
    refs = includes.select("source", fn.normal_path(F.col("ref")).alias("ref")).distinct()
    whole = refs.join(files.select(F.col("path").alias("ref")), "ref", "left_semi").select("source", F.col("ref").alias("path"))
    rest = refs.join(files.select(F.col("path").alias("ref")), "ref", "left_anti")
    ends = files.select("path", F.substring_index("path", "/", -1).alias("name"))
    hits = rest.withColumn("name", F.substring_index("ref", "/", -1)).join(ends, "name").where(F.expr("endswith(path, concat('/', ref))"))
    only = hits.groupBy("source", "ref").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("source", "path")
    return whole.union(only).where("source <> path").groupBy("path").agg(F.countDistinct("source").alias("included_by"))


@query(
    "w9_function_numbers",
    """f AS (SELECT path AS key, CASE WHEN domain = 'brand11' THEN NULL ELSE domain END AS domain FROM files), n AS (SELECT *, row_number() OVER (ORDER BY domain IS NULL, domain, key) AS place FROM f)
SELECT key, domain, place, concat('FN-', CASE WHEN place < 1000 THEN lpad(CAST(place AS VARCHAR), 3, '0') ELSE CAST(place AS VARCHAR) END) AS number FROM n""",
    ("files",),
)
def _w9(t: Tables) -> DataFrame:
    return function_numbers(t.files.select(F.col("path").alias("key"), F.when(F.col("domain") != "brand11", F.col("domain")).alias("domain")))


@query("w10_annotation_numbers", "SELECT l_orderkey AS screen, l_returnflag AS kind, CAST(l_partkey % 200 AS BIGINT) AS y, CAST(l_suppkey % 50 AS BIGINT) AS x, l_linenumber AS selector, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY floor(l_partkey % 200 / 8e0 + 0.5e0), l_suppkey % 50, l_linenumber, l_partkey % 200) AS number FROM lineitem")
def _w10(t: Tables) -> DataFrame:
    return annotation_numbers(t.lineitem.select(F.col("l_orderkey").alias("screen"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 200).alias("y"), (F.col("l_suppkey") % 50).alias("x"), F.col("l_linenumber").alias("selector")))


@query(
    "w11_onboarding_ranks",
    """s AS (SELECT domain AS key, CASE WHEN max(loc) > 40 THEN 3 WHEN max(loc) > 20 THEN 2 ELSE 1 END AS complexity, CASE WHEN count(*) > 20 THEN 2 ELSE 1 END AS size FROM files GROUP BY domain), c AS (SELECT source_domain AS key, count(*) AS coupling FROM file_edges WHERE source_domain <> target_domain GROUP BY 1)
SELECT key, 3 * complexity + 2 * coalesce(coupling, 0) + size AS score, row_number() OVER (ORDER BY 3 * complexity + 2 * coalesce(coupling, 0) + size DESC, key) AS rank FROM s LEFT JOIN c USING (key)""",
    ("files", "file_edges"),
)
def _w11(t: Tables) -> DataFrame:
    band = lambda x, low, high: F.when(x > high, 3).when(x > low, 2).otherwise(1)
    sizes = t.files.groupBy(F.col("domain").alias("key")).agg(band(F.max("loc"), 20, 40).alias("complexity"), F.when(F.count("*") > 20, 2).otherwise(1).alias("size"))
    cross = t.file_edges.where("source_domain <> target_domain").groupBy(F.col("source_domain").alias("key")).agg(F.count("*").alias("coupling"))
    return onboarding_ranks(sizes.join(cross, "key", "left").withColumn("coupling", F.coalesce("coupling", F.lit(0)))).select("key", "score", "rank")


@query("k3_precedents", "SELECT * FROM (SELECT domain AS request, path AS flow, loc AS score, row_number() OVER (PARTITION BY domain ORDER BY loc DESC, path) AS place FROM files) WHERE place <= 5", ("files",))
def _k3(t: Tables) -> DataFrame:
    return precedents_first(t.files.select(F.col("domain").alias("request"), F.col("path").alias("flow"), F.col("loc").alias("score")))


@query("k5_fixed_order", "SELECT path, lang, CASE lang WHEN 'sql' THEN 1 WHEN 'java' THEN 2 WHEN 'python' THEN 3 ELSE 4 END AS rank, row_number() OVER (ORDER BY CASE lang WHEN 'sql' THEN 1 WHEN 'java' THEN 2 WHEN 'python' THEN 3 ELSE 4 END, path) AS place FROM files", ("files",))
def _k5(t: Tables) -> DataFrame:
    return fixed_order(t.files.select("path", "lang"), "lang", ("sql", "java", "python"), "path")


@query("k9_reading_order", "SELECT path AS id, row_number() OVER (ORDER BY CASE WHEN seq % 5 = 0 THEN loc END NULLS LAST, CASE WHEN seq % 3 = 0 THEN seq END NULLS LAST, path) AS place FROM files", ("files",))
def _k9(t: Tables) -> DataFrame:
    n = F.col("seq")
    return reading_order(t.files.select(F.col("path").alias("id"), F.when(n % 5 == 0, F.col("loc")).alias("priority"), F.when(n % 3 == 0, n).alias("node_order"))).select("id", "place")


@query(
    "n14_date_ranges",
    """SELECT o_orderkey AS id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_end, strftime(CAST(o_orderdate AS DATE) - INTERVAL 28 DAY, '%Y-%m-%d') AS weeks_back FROM orders""",
)
def _n14(t: Tables) -> DataFrame:
    month = fn.month_bounds(F.date_format("o_orderdate", "yyyy-MM"))
    return t.orders.select(F.col("o_orderkey").alias("id"), month[0].cast("string").alias("month_start"), month[1].cast("string").alias("month_end"), fn.weeks_back(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), 4).cast("string").alias("weeks_back"))


@query("n15_percent", "SELECT domain, CASE WHEN count(*) FILTER (WHERE loc > 48) = 0 THEN 100e0 ELSE floor(count(*) FILTER (WHERE loc > 48 AND lang = 'java') * 1e0 / count(*) FILTER (WHERE loc > 48) * 1000 + 0.5) / 10 END AS pct FROM files GROUP BY domain", ("files",))
def _n15(t: Tables) -> DataFrame:
    big = F.col("loc") > 48
    return t.files.groupBy("domain").agg(F.count_if(big & (F.col("lang") == "java")).alias("part"), F.count_if(big).alias("base")).select("domain", fn.percent(F.col("part"), F.col("base"), 100.0).alias("pct"))


_TERMS = (("thing", "item"), ("the", "a"), ("and", "&"))


@query(
    "n18_dictionary",
    """a AS (SELECT doc_id, line_no, replace(line, 'thing', 'item') AS line, (length(line) - length(replace(line, 'thing', ''))) // 5 AS h FROM lines), b AS (SELECT doc_id, line_no, replace(line, 'and', '&') AS line, h + (length(line) - length(replace(line, 'and', ''))) // 3 AS h FROM a)
SELECT doc_id, line_no, replace(line, 'the', 'a') AS line, h + (length(line) - length(replace(line, 'the', ''))) // 3 AS hits FROM b""",
    ("lines",),
)
def _n18(t: Tables) -> DataFrame:
    line, hits = fn.translate_terms(F.col("line"), dict(_TERMS))
    return t.lines.select("doc_id", "line_no", line.alias("line"), hits.alias("hits"))


@query("n21_layers", "SELECT path, CASE WHEN lang = 'sql' THEN 'db' WHEN path LIKE '%/repository/%' THEN 'dao' WHEN path LIKE '%/controller/%' THEN 'api' WHEN regexp_matches(path, 'Service[0-9]*[.]') THEN 'service' ELSE 'unknown' END AS layer FROM files", ("files",))
def _n21(t: Tables) -> DataFrame:
    path = F.col("path")
    return t.files.select("path", layer_of(F.col("lang") == "sql", path.contains("/repository/"), path.contains("/controller/"), path.rlike(r"Service[0-9]*\.")).alias("layer"))


@query("a27_table_frequency", f"{_SQL_LINES}, x AS (SELECT file, lower(unnest(regexp_extract_all(line, '(?i)\\b(?:from|join|into|update)\\s+([A-Za-z_]+)', 1))) AS tbl FROM q), c AS (SELECT file, tbl, count(*) AS n FROM x GROUP BY file, tbl) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, tbl) AS place FROM c) WHERE place <= 3")
def _a27(t: Tables) -> DataFrame:
    return table_frequency(_sql_lines(t))


@query("u8_unmatched", "SELECT path FROM files EXCEPT SELECT source FROM file_edges WHERE kind = 'import' AND line > 5 EXCEPT SELECT path FROM files WHERE path LIKE '%/test/%'", ("files", "file_edges"))
def _u8(t: Tables) -> DataFrame:
    return unmatched(t.files, t.file_edges.where("kind = 'import' and line > 5").select(F.col("source").alias("path")), t.files.where("path like '%/test/%'"))


_PLAN = (("rename", "brand11", "core"), ("merge", ("brand13",), "brand12"), ("split", "brand21", "/test/", "checks"), ("move", "src/brand22/controller/", "core"), ("exclude", "brand23"), ("group", "first", ("core", "brand12")), ("group", "second", ("checks", "brand20")), ("ungroup", "second"))


@query(
    "u10_plan_operations",
    """d AS (SELECT path AS root, CASE WHEN path LIKE 'src/brand22/controller/%' OR domain = 'brand11' THEN 'core' WHEN domain = 'brand13' THEN 'brand12' WHEN domain = 'brand21' AND path LIKE '%/test/%' THEN 'checks' ELSE domain END AS domain FROM files)
SELECT domain, root, CASE WHEN domain IN ('core', 'brand12') THEN 'first' END AS grp, CASE domain WHEN 'core' THEN 'brand11' WHEN 'brand12' THEN 'brand13' ELSE '' END AS alias_keys FROM d WHERE domain <> 'brand23'""",
    ("files",),
)
def _u10(t: Tables) -> DataFrame:
    return apply_plan(t.files.select("domain", F.col("path").alias("root"), F.lit(None).cast("string").alias("grp")), _PLAN)


@query(
    "u11_definition_differences",
    """c AS (SELECT lower(p_brand) AS tbl, p_partkey AS seq, 'id' AS col, CAST(p_size % 3 AS VARCHAR) AS type FROM part UNION ALL SELECT lower(p_brand), p_partkey, concat('c', p_size % 4), 'text' FROM part),
f AS (SELECT tbl, min(seq) AS first FROM c GROUP BY tbl), k AS (SELECT c.tbl, col, type FROM c JOIN f USING (tbl) WHERE seq = first), l AS (SELECT DISTINCT c.tbl, seq FROM c JOIN f USING (tbl) WHERE seq > first),
b AS (SELECT coalesce(x.tbl, y.tbl) AS tbl, coalesce(x.seq, y.seq) AS seq, coalesce(x.col, y.col) AS col, x.type AS a, y.type AS b FROM (SELECT l.tbl, l.seq, k.col, k.type FROM l JOIN k USING (tbl)) x FULL JOIN (SELECT c.tbl, c.seq, c.col, c.type FROM c JOIN l USING (tbl, seq)) y ON x.tbl = y.tbl AND x.seq = y.seq AND x.col = y.col)
SELECT tbl, seq, string_agg(DISTINCT col, ',' ORDER BY col) AS columns FROM b WHERE a IS DISTINCT FROM b GROUP BY tbl, seq""",
)
def _u11(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_brand").alias("tbl"), F.col("p_partkey").alias("seq"), "p_size")
    ids = p.select("tbl", "seq", F.lit("ID").alias("col"), (F.col("p_size") % 3).cast("string").alias("type"))
    return definition_differences(ids.union(p.select("tbl", "seq", F.concat(F.lit("c"), (F.col("p_size") % 4).cast("string")), F.lit("text"))))


@query(
    "u12_comments",
    """k AS (SELECT domain AS tbl, path AS col FROM files), c AS (SELECT source_domain AS tbl, CASE WHEN line = 7 THEN concat(source, '~') ELSE source END AS col, concat(kind, line) AS comment, seq FROM file_edges), f AS (SELECT tbl, col, arg_min(comment, seq) AS comment FROM c GROUP BY tbl, col)
SELECT tbl, col, comment, TRUE AS known FROM k LEFT JOIN f USING (tbl, col) UNION ALL SELECT tbl, col, comment, FALSE FROM c WHERE line_is_unknown(col)""".replace("line_is_unknown(col)", "col LIKE '%~'"),
    ("files", "file_edges"),
)
def _u12(t: Tables) -> DataFrame:
    comments = t.file_edges.select(F.col("source_domain").alias("tbl"), F.when(F.col("line") == 7, F.concat("source", F.lit("~"))).otherwise(F.col("source")).alias("col"), F.concat("kind", F.col("line").cast("string")).alias("comment"), "seq")
    known, unknown = attach_comments(t.files.select(F.col("domain").alias("tbl"), F.col("path").alias("col")), comments)
    return known.select("tbl", "col", "comment", F.lit(True).alias("known")).union(unknown.select("tbl", "col", "comment", F.lit(False)))


@query(
    "c25_planned_stubs",
    """k AS (SELECT concat(lower(o_orderstatus), '-', o_orderkey) AS id, lower(o_orderstatus) AS domain FROM orders), r AS (SELECT DISTINCT concat(lower(l_linestatus), '-', l_orderkey) AS id FROM lineitem)
SELECT id, domain, 'found' AS status FROM k UNION ALL SELECT id, split_part(id, '-', 1), 'planned' FROM r WHERE id NOT IN (SELECT id FROM k)""",
)
def _c25(t: Tables) -> DataFrame:
    known = t.orders.select(F.concat(F.lower("o_orderstatus"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("id"), F.lower("o_orderstatus").alias("domain"))
    return planned_stubs(t.lineitem.select(F.concat(F.lower("l_linestatus"), F.lit("-"), F.col("l_orderkey").cast("string")).alias("id")), known)


@query(
    "c26_catalogue",
    """SELECT 'route' AS section, split_part(url, '?', 1) AS key, min(CAST(page_id AS VARCHAR)) AS evidence, count(*) AS n FROM pages GROUP BY 2 UNION ALL SELECT 'program', path, min(id), count(*) FROM files GROUP BY 2 UNION ALL SELECT 'technology', lang, min(path), count(*) FROM files GROUP BY 2""",
    ("files",),
)
def _c26(t: Tables) -> DataFrame:
    routes = t.pages.select(F.substring_index("url", "?", 1).alias("key"), F.col("page_id").cast("string").alias("evidence"))
    return catalogue({"route": routes, "program": t.files.select(F.col("path").alias("key"), F.col("id").alias("evidence")), "technology": t.files.select(F.col("lang").alias("key"), F.col("path").alias("evidence"))})


@query(
    "g17_include_fragments",
    """i AS (SELECT source, target AS path FROM file_edges WHERE kind = 'import' AND source <> target) SELECT path, count(DISTINCT source) AS included_by FROM i GROUP BY path""",
    ("file_edges",),
)
def _g17(t: Tables) -> DataFrame:
    ref = F.when(F.col("line") % 3 == 0, F.substring_index("target", "/", -1)).when(F.col("line") % 3 == 1, F.concat(F.lit("./"), "target")).otherwise(F.col("target"))
    return include_fragments(t.file_edges.where("kind = 'import'").select("source", ref.alias("ref")), t.files)
