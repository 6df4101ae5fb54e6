"""Mapper statements, database links, policies, table signals, structure changes, requirement coverage, charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.plans.shared import materialize, spread
from factloom.registry import query

# Words that are no table, columns of a policy table that say nothing of it, letters of mapper tags.
SQL_WORDS = ("SET", "SELECT", "WHERE", "VALUES", "DISTINCT", "ALL")
META_COLUMNS = ("confidence", "evidence", "신뢰도", "근거")
TAG_LETTERS = {"select": "R", "insert": "C", "update": "U", "delete": "D"}
_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_TABLE = rf"{_NAME}(?:\s*\.\s*{_NAME})?"


def located(text: Column, pattern: str) -> Column:
    """Every match of a pattern in a text, with the number of the line that it starts in."""
    breaks = lambda s: F.char_length(s) - F.char_length(F.replace(s, F.lit("\n"), F.lit("")))
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    step = lambda s, x: F.struct((s["line"] + x["skip"]).alias("line"), F.concat(s["out"], F.array(F.struct(x["match"].alias("match"), (s["line"] + x["before"]).cast("int").alias("line")))).alias("out"))
    parts = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("match"), breaks(b).alias("before"), (breaks(b) + breaks(m)).alias("skip")))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<match: string, line: int>>").alias("out"))
    return F.aggregate(parts, start, step, lambda s: s["out"])


def without_comments(text: Column, xml: Column) -> Column:
    """A text whose comments are blank but for their line breaks, so that line numbers hold."""
    kept = lambda pattern, opens: F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda s: F.when(s.startswith(opens) & (F.length(s) > 3), F.regexp_replace(s, r"[^\n]", " ")).otherwise(s)), "")
    sql = kept(r"(?s)/\*.*?\*/|--[^\n]*|[^/\-]+|[/\-]", "/*")
    return F.when(xml, kept(r"(?s)<!--.*?-->|[^<]+|<", "<!--")).otherwise(F.regexp_replace(sql, r"--[^\n]*", " "))


def database_links(files: DataFrame) -> DataFrame:
    """``files(file, lang, text)`` -> ``(file, line_no, tbl, link)`` of ``table@link`` behind from, join, into, update
    or a comma, once for each line, comments left out; ``tbl`` is null for the definition of a link."""
    text = without_comments(F.col("text"), F.col("lang") == "xml")
    refs = rf"(?i)(?:\b(?:FROM|JOIN|INTO|UPDATE)\s+|,\s*)([A-Za-z_][\w$#.]*)@([A-Za-z_][\w$#.]*)"
    made = r"(?i)\bCREATE\s+(?:PUBLIC\s+)?DATABASE\s+LINK\s+([A-Za-z_\"][\w$#.\"]*)"
    d = files.select("file", text.alias("text"))
    used = d.select("file", F.explode(located(F.col("text"), refs)).alias("x")).select("file", F.col("x.line").alias("line_no"), F.regexp_extract("x.match", refs, 1).alias("tbl"), F.regexp_extract("x.match", refs, 2).alias("link"))
    defined = d.select("file", F.explode(located(F.col("text"), made)).alias("x")).select("file", F.col("x.line").alias("line_no"), F.lit(None).cast("string").alias("tbl"), F.replace(F.regexp_extract("x.match", made, 1), F.lit('"'), F.lit("")).alias("link"))
    return used.union(defined).distinct()


def mapper_statements(files: DataFrame) -> DataFrame:
    """``files(file, text)`` whose root is a mapper -> ``(file, namespace, id, letter, tables, columns, line_no)``:
    tables behind from (also in a list), join, into and update, columns of an insert's list or of an
    update's assignments, in upper case, sorted and joined by commas."""
    comments = r"(?s)<!--.*?-->"
    root = r"(?is)^\x{FEFF}?\s*(?:(?:<\?[^>]*\?>|<!--.*?-->|<!DOCTYPE[^>]*>)\s*)*<mapper[\s>]"
    tag = r"(?is)<(select|insert|update|delete)\b[^>]*\bid\s*=\s*\"([^\"]+)\"[^>]*>(.*?)</\1>"
    d = files.where(F.col("text").rlike(root)).select("file", F.regexp_extract("text", r"(?i)<mapper\s+[^>]*\bnamespace\s*=\s*\"([^\"]+)\"", 1).alias("namespace"), F.explode(located(F.col("text"), tag)).alias("x")).where("namespace <> ''")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("x.match", tag, 3), comments, " "), r"<!\[CDATA\[|\]\]>", " "), r"<[^>]*>", " "), r"[#$]\{[^}]*\}", "?")
    letter = F.element_at(F.create_map(*[F.lit(v) for p in TAG_LETTERS.items() for v in p]), F.lower(F.regexp_extract("x.match", tag, 1)))
    d = d.select("file", "namespace", F.regexp_extract("x.match", tag, 2).alias("id"), letter.alias("letter"), F.regexp_replace(body, r"\s+", " ").alias("sql"), F.col("x.line").alias("line_no"))
    last = lambda t: F.upper(F.trim(F.substring_index(t, ".", -1)))
    lists = F.flatten(F.transform(F.regexp_extract_all("sql", F.lit(rf"(?i)\bFROM\s+({_TABLE}(?:\s*,\s*{_TABLE})*)"), 1), lambda s: F.split(s, ",")))
    one = F.regexp_extract_all("sql", F.lit(rf"(?i)\b(?:JOIN|INTO|UPDATE)\s+({_TABLE})"), 1)
    tables = F.filter(F.transform(F.concat(lists, one), last), lambda t: ~t.isin(*SQL_WORDS))
    into = F.split(F.regexp_extract("sql", rf"(?i)\bINTO\s+{_NAME}\s*\(([^)]*)\)", 1), ",")
    assigned = F.regexp_extract_all(F.regexp_extract("sql", r"(?i) SET (.*?)(?: WHERE |$)", 1), F.lit(rf"({_NAME})\s*="), 1)
    columns = F.when(F.col("letter") == "C", into).when(F.col("letter") == "U", assigned).otherwise(F.array().cast("array<string>"))
    columns = F.filter(F.transform(columns, lambda c: F.upper(F.trim(c))), lambda c: c.rlike("^[A-Z_]"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return d.select("file", "namespace", "id", "letter", joined(tables).alias("tables"), joined(columns).alias("columns"), "line_no")


def policy_items(lines: DataFrame) -> DataFrame:
    """``lines(file, line_no, line)`` -> ``(file, subject, statement, line_no)``: rows of tables (the first cell, and
    the others joined by slashes without those that only tell confidence or evidence) and bullets
    ``subject: statement``, the first of a subject whatever its case."""
    w = Window.partitionBy("file").orderBy("line_no")
    clean = lambda c: F.trim(F.regexp_replace(c, r"\*\*|`", ""))
    d = lines.withColumn("bar", F.contains("line", F.lit("|"))).withColumn("next", F.lead("line").over(w))
    d = d.withColumn("head", F.col("line").rlike(r"^\s*\|.*\|\s*$") & F.col("next").rlike(r"^\s*\|?\s*:?-{2,}"))
    d = d.withColumn("broken", F.sum((~F.col("bar")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the first header since the last line without a bar rules the table
    t = Window.partitionBy("file", "broken").orderBy("line_no")
    cells = lambda c: F.transform(F.slice(F.split(c, r"\|"), F.lit(2), F.greatest(F.size(F.split(c, r"\|")) - 2, F.lit(0))), clean)
    first = F.min(F.when(F.col("head"), F.struct("line_no", "line"))).over(t.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("table", F.when(F.col("bar"), first))
    rows = d.where(F.col("line_no") > F.col("table.line_no") + 1).select("file", "line_no", cells(F.col("line")).alias("c"), cells(F.col("table.line")).alias("h"))
    keep = F.filter(F.transform("h", lambda h, i: F.when((i > 0) & ~F.lower(h).isin(*META_COLUMNS), F.coalesce(F.get("c", i), F.lit("")))), lambda x: x.isNotNull() & (x != ""))
    rows = rows.select("file", "line_no", F.get("c", F.lit(0)).alias("subject"), F.array_join(keep, " / ").alias("statement"))
    bullet = r"^\s*[-*]\s+(?:\*\*(.+?)\*\*|(.+?))\s*[:：]\s*(.+?)\s*$"
    part = lambda i: F.regexp_extract("line", bullet, i)
    free = d.where(F.col("table").isNull() & F.col("line").rlike(bullet)).select("file", "line_no", clean(F.when(part(1) != "", part(1)).otherwise(part(2))).alias("subject"), clean(part(3)).alias("statement"))
    both = rows.union(free).where("subject <> ''").withColumn("key", F.lower("subject"))
    return both.groupBy("file", "key").agg(F.min(F.struct("line_no", "subject", "statement")).alias("x")).select("file", "x.subject", "x.statement", "x.line_no")


def table_signals(tables: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """``tables(tbl, comment)``, ``columns(tbl, col, nullable, comment)`` and ``keys(tbl, kind, cols, ref, detail)``
    (kinds primary-key, unique, fk, check) -> ``(category, kind, subject, detail, confidence)``."""
    row = lambda d, category, kind, subject, detail, sure: d.select(F.lit(category).alias("category"), F.lit(kind).alias("kind"), subject.alias("subject"), detail.alias("detail"), sure.alias("confidence"))
    yes, at = F.lit("CONFIRMED"), F.concat("tbl", F.lit("."), "col")
    told = F.col("comment").isNotNull() & (F.col("comment") != "")
    out = [row(tables, "glossary", "table", F.col("tbl"), F.when(told, F.col("comment")).otherwise("(no comment)"), F.when(told, "CONFIRMED").otherwise("INFERRED"))]
    out.append(row(columns.where(told), "glossary", "column-comment", at, F.col("comment"), yes))
    out.append(row(columns.where(~F.col("nullable")), "data", "not-null", at, F.lit("NOT NULL"), yes))
    listed = F.concat("tbl", F.lit("("), F.array_join("cols", ", "), F.lit(")"))
    of = lambda kind: keys.where(F.col("kind") == kind)
    out.append(row(of("primary-key").where(F.size("cols") > 0), "data", "primary-key", F.col("tbl"), F.concat(F.lit("PRIMARY KEY ("), F.array_join("cols", ", "), F.lit(")")), yes))
    out.append(row(of("unique"), "data", "unique", listed, F.lit("UNIQUE"), yes))
    out.append(row(of("fk"), "data", "fk", listed, F.concat(F.lit("FK → "), "ref"), yes))
    out.append(row(of("check"), "data", "check", F.col("tbl"), F.col("detail"), yes))
    return reduce(DataFrame.union, out)


def structure_changes(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Fingerprints of two times, each with ``files(path, hash, analysed)``, ``functions(path, name, params, returns,
    exported, lines)``, ``classes(path, name, methods, properties, exported)``, ``imports(path, source, names)`` and
    ``exports(path, name)`` -> ``(path, level, detail)`` of files that both have: NONE for equal hashes, STRUCTURAL with a
    row for each difference (also where a side was not analysed), COSMETIC if there is none."""
    c = F.col
    files = after["files"].join(before["files"].select("path", c("hash").alias("h0"), c("analysed").alias("a0")), "path")
    files = materialize(files.select("path", F.when(c("hash").eqNullSafe(c("h0")), "same").when(~c("analysed") | ~c("a0"), "blind").otherwise("open").alias("state")), "compared")
    open_ = files.where("state = 'open'").select("path")

    def both(name: str, *values: str) -> DataFrame:
        a, b = (x[name].join(open_, "path", "left_semi").groupBy("path", "name").agg(F.first(F.struct(*values)).alias(side)) for x, side in ((before, "old"), (after, "new")))
        return materialize(a.join(b, ["path", "name"], "full_outer"), f"{name}-pairs")

    detail = lambda d, text: d.select("path", text.alias("detail"))
    say = lambda text: F.concat(F.lit(text), "name")
    out = []
    fns = both("functions", "params", "returns", "exported", "lines")
    cls = both("classes", "methods", "properties", "exported")
    for d, word in ((fns, "function"), (cls, "class")):
        out.append(detail(d.where("old is null"), say(f"new {word}: ")))
        out.append(detail(d.where("new is null"), say(f"removed {word}: ")))
    pair = fns.where("old is not null and new is not null")
    differ = lambda f: ~c(f"old.{f}").eqNullSafe(c(f"new.{f}"))
    out += [detail(pair.where(differ(f)), say(text)) for f, text in (("params", "params changed: "), ("returns", "return type changed: "), ("exported", "export status changed: "))]
    ratio = c("new.lines") / c("old.lines")
    out.append(detail(pair.where((c("old.lines") > 0) & ((ratio > 1.5) | (ratio < 0.5))), F.concat(say("significant size change: "), F.lit(" ("), c("old.lines").cast("string"), F.lit(" → "), c("new.lines").cast("string"), F.lit(" lines)"))))
    pair = cls.where("old is not null and new is not null")
    unlike = lambda f: ~F.array_sort(f"old.{f}").eqNullSafe(F.array_sort(f"new.{f}"))
    out += [detail(pair.where(unlike("methods")), say("methods changed: ")), detail(pair.where(unlike("properties")), say("properties changed: ")), detail(pair.where(differ("exported")), say("export status changed: "))]
    key = {"imports": F.concat("source", F.lit(":"), F.array_join(F.array_sort("names"), ",")), "exports": c("name")}
    for name, column in key.items():
        a, b = (x[name].join(open_, "path", "left_semi").groupBy("path", column.alias("k")).agg(F.count("*").alias(side)) for x, side in ((before, "old"), (after, "new")))
        out.append(detail(a.join(b, ["path", "k"], "full_outer").where("not old <=> new").select("path").distinct(), F.lit(f"{name} changed")))
    found = materialize(reduce(DataFrame.union, out).distinct(), "details")
    row = lambda d, level, text: d.select("path", F.lit(level).alias("level"), text.alias("detail"))
    plain = open_.join(found.select("path"), "path", "left_anti")
    return row(files.where("state = 'same'"), "NONE", F.lit("")).union(row(files.where("state = 'blind'"), "STRUCTURAL", F.lit("no structural analysis"))).union(row(found, "STRUCTURAL", c("detail"))).union(row(plain, "COSMETIC", F.lit("internal logic changed")))


def requirement_coverage(functions: DataFrame, requirements: DataFrame, targets: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``functions(fn, state, tested)``, ``requirements(req, type, status, approved)``, ``targets(req, fn)`` (of a
    non-functional one its scope) and ``tests(req, ac, fn, result)``, a row for each function of a criterion and test
    (result null: a criterion without tests) -> per requirement ``(req, targets, built, acs, passed, implemented,
    verified, signed)`` and gaps ``(gap, key)``.

    Implemented: all targets are, and there is one; a non-functional requirement without a scope if it
    is signed off. Verified: all criteria passed a test; without criteria, all targets are verified, by a
    test of their own or by a passed criterion."""
    c = F.col
    built = c("state").isin("IMPLEMENTED", "CHANGED")
    passed = tests.where("result = 'PASS'").select("fn").where("fn is not null").distinct().withColumn("by_ac", F.lit(True))
    f = functions.join(passed, "fn", "left").select("fn", "state", built.alias("built"), (F.coalesce("tested", F.lit(False)) | c("by_ac").isNotNull()).alias("verified"))
    f = materialize(f, "functions")
    t = targets.select("req", "fn").distinct().join(f.select("fn", c("built").alias("b"), c("verified").alias("v")), "fn", "left")
    t = t.groupBy("req").agg(F.count("*").alias("targets"), F.count("b").alias("known"), F.count_if(F.coalesce("b", F.lit(False))).alias("built"), F.count_if(F.coalesce("v", F.lit(False))).alias("ok"))
    acs = tests.groupBy("req", "ac").agg(F.bool_or(F.coalesce(c("result") == "PASS", F.lit(False))).alias("pass")).groupBy("req").agg(F.count("*").alias("acs"), F.count_if("pass").alias("passed"))
    zero = F.lit(0).cast("long")
    d = requirements.join(t, "req", "left").join(acs, "req", "left").select("req", "type", "status", F.coalesce("approved", F.lit(False)).alias("signed"), *[F.coalesce(x, zero).alias(x) for x in ("targets", "known", "built", "ok", "acs", "passed")])
    # of a non-functional scope only functions count
    scope = F.when(c("known") == 0, c("signed")).otherwise(c("built") == c("known"))
    implemented = F.when(c("type") == "nonfunctional", scope).otherwise((c("targets") > 0) & (c("built") == c("targets")))
    verified = F.when(c("acs") > 0, c("passed") == c("acs")).otherwise((c("targets") > 0) & (c("ok") == c("targets")))
    d = materialize(d.select("req", "status", "targets", "built", "acs", "passed", implemented.alias("implemented"), verified.alias("verified"), "signed"), "coverage")
    gap = lambda d, name, key: d.select(F.lit(name).alias("gap"), F.col(key).alias("key"))
    gaps = gap(d.where("status = 'ACTIVE' and not implemented"), "unimplemented", "req").union(gap(f.where("state = 'ORPHANED'"), "orphan-code", "fn")).union(gap(f.where("built and not verified"), "unverified", "fn"))
    return d.drop("status"), gaps


def chart_errors(nodes: DataFrame, edges: DataFrame, flows: DataFrame) -> DataFrame:
    """Q8: ``nodes(chart, seq, node, kind, flow)``, ``edges(chart, source, target, label)``, ``flows(flow)`` -> ``(chart, error,
    node)``: duplicate nodes, unknown ends, nodes without an edge, no start or end, unknown flows, decisions
    with fewer than two branches or with one that has no label."""
    row = lambda d, error, node: d.select("chart", F.lit(error).alias("error"), node.alias("node"))
    c, none = F.col, F.lit("")
    ids = nodes.select("chart", "node").distinct()
    again = nodes.withColumn("k", F.row_number().over(Window.partitionBy("chart", "node").orderBy("seq"))).where("k > 1")
    out = [row(again, "duplicate-node", c("node"))]
    for end in ("source", "target"):
        out.append(row(edges.select("chart", c(end).alias("node")).join(ids, ["chart", "node"], "left_anti"), f"unknown-{end}", c("node")))
    ends = edges.select("chart", F.explode(F.array("source", "target")).alias("node"))
    out.append(row(nodes.join(ends, ["chart", "node"], "left_anti"), "orphan-node", c("node")))
    kinds = nodes.groupBy("chart").agg(F.bool_or(c("kind") == "start").alias("s"), F.bool_or(c("kind") == "end").alias("e"))
    out += [row(kinds.where("not s"), "no-start", none), row(kinds.where("not e"), "no-end", none)]
    out.append(row(nodes.where("flow is not null and flow <> ''").join(flows, "flow", "left_anti"), "unknown-flow", c("node")))
    branches = edges.groupBy("chart", c("source").alias("node")).agg(F.count("*").alias("n"), F.bool_or(F.coalesce(c("label") == "", F.lit(True))).alias("bare"))
    decisions = nodes.where("kind = 'decision'").join(branches, ["chart", "node"], "left")
    out += [row(decisions.where("coalesce(n, 0) < 2"), "few-branches", c("node")), row(decisions.where("bare"), "unlabelled-branch", c("node"))]
    return reduce(DataFrame.union, out)


def _pick(column: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (column + 1).cast("int"))


@query(
    "x2_mapper_tables",
    """f AS (SELECT path AS file, seq AS k, loc % 4 AS n FROM files WHERE lang = 'xml'), s AS (SELECT file, concat('ns', n) AS namespace, unnest([{'id': concat('a', k), 'letter': 'R', 'tables': concat('AA', n, ',B,C'), 'columns': '', 'line_no': 3}, {'id': 'b', 'letter': 'C', 'tables': 'T', 'columns': 'Y,Z', 'line_no': 6}, {'id': 'c', 'letter': 'U', 'tables': 'U', 'columns': 'P,Q', 'line_no': 7}]) AS x FROM f) SELECT file, namespace, x.* FROM s""",
    ("files",),
)
def _x2(t: Tables) -> DataFrame:
    k, n = F.col("seq").cast("string"), (F.col("loc") % 4).cast("string")
    text = F.concat(F.lit('<?xml version="1.0"?>\n<mapper namespace="ns'), n, F.lit('">\n<select id="a'), k, F.lit('">\n select * from db.aa'), n, F.lit(" , b <!-- from x -->\n join C on 1=1 where z=#{from y}</select>\n<insert id=\"b\">insert into t (z, y) values (1, 2)</insert>\n<update flush=\"1\" id=\"c\"><![CDATA[update u SET p = 1, q=#{q} WHERE r = 2]]></update>\n</mapper>"))
    other = F.lit('<beans><select id="no">from q</select></beans>')
    d = t.files.where("lang in ('xml', 'sql')").select(F.col("path").alias("file"), F.when(F.col("lang") == "xml", text).otherwise(other).alias("text"))
    return mapper_statements(d)


@query(
    "x3_database_links",
    """f AS (SELECT path AS file, lang, loc % 5 AS n FROM files WHERE lang IN ('xml', 'sql')), s AS (SELECT file, unnest(CASE lang WHEN 'xml' THEN [{'line_no': 3, 'tbl': 'k', 'link': concat('L', n)}] ELSE [{'line_no': 1, 'tbl': concat('a', n), 'link': 'erp'}, {'line_no': 1, 'tbl': 'b', 'link': 'crm'}, {'line_no': 5, 'tbl': 'd', 'link': 'x'}, {'line_no': 6, 'tbl': NULL, 'link': concat('L', n)}] END) AS x FROM f) SELECT file, x.* FROM s""",
    ("files",),
)
def _x3(t: Tables) -> DataFrame:
    n = (F.col("loc") % 5).cast("string")
    sql = F.concat(F.lit("select * from a"), n, F.lit("@erp, b@crm -- from c@no\n/* join\n x@no */\n-- /* open\njoin d@x on 1=1\ncreate public database link L"), n, F.lit(";"))
    xml = F.concat(F.lit("<m><!-- from\n q@no -->\n from k@L"), n, F.lit("</m>"))
    return database_links(t.files.where("lang in ('xml', 'sql')").select(F.col("path").alias("file"), "lang", F.when(F.col("lang") == "xml", xml).otherwise(sql).alias("text")))


@query(
    "x9_policy_items",
    """f AS (SELECT path AS file, loc % 6 AS n FROM files), s AS (SELECT file, unnest([{'subject': 'Name', 'statement': concat('is ', n), 'line_no': 2}, {'subject': concat('row', n), 'statement': 'v1 / v3', 'line_no': 6}, {'subject': 'Next', 'statement': 'x', 'line_no': 8}, {'subject': 'plain', 'statement': 'text', 'line_no': 10}]) AS x FROM f) SELECT file, x.* FROM s""",
    ("files",),
)
def _x9(t: Tables) -> DataFrame:
    n = (F.col("loc") % 6).cast("string")
    text = F.concat(F.lit("# T\n- **Name**: is "), n, F.lit("\n\n| a | b | Confidence | d |\n|---|---|---|---|\n| **row"), n, F.lit("** | v1 | v2 | v3 |\n|  |  |  |  |\n| Next | x | y | |\n- name: again\n* plain : text "))
    d = spread(t.files.select(F.col("path").alias("file"), text.alias("text")), 10 * t.rows("part"), "file").select("file", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("file", (F.col("pos") + 1).alias("line_no"), "line")
    return policy_items(d)


_SIGNALS = """ta AS (SELECT concat('t', p_partkey) AS tbl, CASE WHEN p_size % 3 > 0 THEN p_name END AS comment, p_partkey AS k FROM part)"""


@query(
    "c12_table_signals",
    f"""{_SIGNALS} SELECT 'glossary' AS category, 'table' AS kind, tbl AS subject, coalesce(comment, '(no comment)') AS detail, CASE WHEN comment IS NULL THEN 'INFERRED' ELSE 'CONFIRMED' END AS confidence FROM ta
UNION ALL SELECT 'glossary', 'column-comment', concat(tbl, '.a'), concat('of ', k), 'CONFIRMED' FROM ta WHERE k % 2 = 0 UNION ALL SELECT 'data', 'not-null', concat(tbl, '.b'), 'NOT NULL', 'CONFIRMED' FROM ta WHERE k % 3 = 0
UNION ALL SELECT 'data', 'primary-key', tbl, 'PRIMARY KEY (a, b)', 'CONFIRMED' FROM ta WHERE k % 4 = 0 UNION ALL SELECT 'data', 'unique', concat(tbl, '(a, b)'), 'UNIQUE', 'CONFIRMED' FROM ta WHERE k % 4 = 1
UNION ALL SELECT 'data', 'fk', concat(tbl, '(a, b)'), concat('FK → t', k + 1, '(a)'), 'CONFIRMED' FROM ta WHERE k % 4 = 2 UNION ALL SELECT 'data', 'check', tbl, concat('a > ', k), 'CONFIRMED' FROM ta WHERE k % 4 = 3""",
)
def _c12(t: Tables) -> DataFrame:
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    tbl = F.concat(F.lit("t"), text).alias("tbl")
    tables = t.part.select(tbl, F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("comment"))
    columns = t.part.select(tbl, F.lit("a").alias("col"), F.lit(True).alias("nullable"), F.when(k % 2 == 0, F.concat(F.lit("of "), text)).alias("comment")).union(t.part.select(tbl, F.lit("b"), k % 3 > 0, F.lit(None)))
    keys = t.part.select(tbl, _pick(k % 4, "primary-key", "unique", "fk", "check").alias("kind"), F.array(F.lit("a"), F.lit("b")).alias("cols"), F.concat(F.lit("t"), (k + 1).cast("string"), F.lit("(a)")).alias("ref"), F.concat(F.lit("a > "), text).alias("detail"))
    return table_signals(tables, columns, keys)


@query(
    "c18_structure_changes",
    """f AS (SELECT path, seq AS k, loc % 10 AS n, seq % 5 = 0 AS same, seq % 7 = 0 AS blind FROM files), o AS (SELECT * FROM f WHERE NOT same AND NOT blind),
d AS (SELECT path, unnest(CASE n WHEN 0 THEN ['new function: g', 'removed function: f'] WHEN 1 THEN ['params changed: f'] WHEN 2 THEN ['return type changed: f'] WHEN 3 THEN ['export status changed: f'] WHEN 4 THEN ['significant size change: f (10 → 16 lines)'] WHEN 5 THEN ['new class: D', 'removed class: C'] WHEN 6 THEN ['methods changed: C'] WHEN 7 THEN ['imports changed'] WHEN 8 THEN ['exports changed'] ELSE [] END) AS detail FROM o)
SELECT path, 'NONE' AS level, '' AS detail FROM f WHERE same UNION ALL SELECT path, 'STRUCTURAL', 'no structural analysis' FROM f WHERE NOT same AND blind UNION ALL SELECT path, 'STRUCTURAL', detail FROM d UNION ALL SELECT path, 'COSMETIC', 'internal logic changed' FROM o WHERE n = 9""",
    ("files",),
)
def _c18(t: Tables) -> DataFrame:
    n, s = F.col("loc") % 10, F.col("seq")

    def side(new: bool) -> dict[str, DataFrame]:
        at = lambda k: (n == k) & F.lit(new)
        f = t.files
        return {
            "files": f.select("path", F.when(F.lit(new) & (s % 5 > 0), "y").otherwise("x").alias("hash"), (F.lit(not new) | (s % 7 > 0)).alias("analysed")),
            "functions": f.select("path", F.when(at(0), "g").otherwise("f").alias("name"), F.when(at(1), F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("params"), F.when(at(2), "int").alias("returns"), at(3).alias("exported"), F.when(at(4), 16).otherwise(F.when(F.lit(new), 15).otherwise(10)).alias("lines")),
            "classes": f.select("path", F.when(at(5), "D").otherwise("C").alias("name"), F.when(at(6), F.array(F.lit("m"))).otherwise(F.array(F.lit("m"), F.lit("k"))).alias("methods"), F.array(F.lit("p")).alias("properties"), F.lit(True).alias("exported")),
            "imports": f.select("path", F.lit("lib").alias("source"), F.when(at(7), F.array(F.lit("z"))).otherwise(F.array(F.lit("y"), F.lit("z"))).alias("names")),
            "exports": f.select("path", F.when(at(8), "q").otherwise("r").alias("name")),
        }

    return structure_changes(side(False), side(True))


_COVERAGE = """fu AS (SELECT p_partkey AS fn, ['IMPLEMENTED', 'CHANGED', 'PLANNED', 'ORPHANED', 'IMPLEMENTED', 'IMPLEMENTED'][p_partkey % 6 + 1] AS state, p_size % 4 = 0 AS tested FROM part), rq AS (SELECT o_orderkey AS req, CASE WHEN o_orderkey % 6 = 5 THEN 'nonfunctional' ELSE 'functional' END AS type, CASE WHEN o_orderstatus = 'F' THEN 'WITHDRAWN' ELSE 'ACTIVE' END AS status, o_custkey % 3 = 0 AS approved FROM orders),
tg AS (SELECT DISTINCT l_orderkey AS req, l_partkey + CASE WHEN l_linenumber = 4 THEN 90000000 ELSE 0 END AS fn FROM lineitem WHERE l_linenumber < 5 AND l_orderkey % 12 <> 5), te AS (SELECT l_orderkey AS req, l_linenumber AS ac, l_partkey AS fn, CASE WHEN l_suppkey % 5 = 0 THEN 'FAIL' WHEN l_suppkey % 5 < 4 THEN 'PASS' END AS result FROM lineitem WHERE l_orderkey % 4 = 1 AND l_linenumber < 3),
f1 AS (SELECT fn, state, state IN ('IMPLEMENTED', 'CHANGED') AS built, tested OR fn IN (SELECT fn FROM te WHERE result = 'PASS') AS verified FROM fu),
t1 AS (SELECT req, count(*) AS targets, count(built) AS known, count(*) FILTER (built) AS built, count(*) FILTER (verified) AS ok FROM tg LEFT JOIN f1 USING (fn) GROUP BY req), a1 AS (SELECT req, count(*) AS acs, count(*) FILTER (p) AS passed FROM (SELECT req, ac, bool_or(coalesce(result = 'PASS', FALSE)) AS p FROM te GROUP BY req, ac) GROUP BY req),
d AS (SELECT rq.req, type, status, approved AS signed, coalesce(targets, 0) AS targets, coalesce(known, 0) AS known, coalesce(built, 0) AS built, coalesce(ok, 0) AS ok, coalesce(acs, 0) AS acs, coalesce(passed, 0) AS passed FROM rq LEFT JOIN t1 USING (req) LEFT JOIN a1 USING (req)),
c AS (SELECT *, CASE WHEN type = 'nonfunctional' THEN CASE WHEN known = 0 THEN signed ELSE built = known END ELSE targets > 0 AND built = targets END AS implemented, CASE WHEN acs > 0 THEN passed = acs ELSE targets > 0 AND ok = targets END AS verified FROM d)"""


def _coverage(t: Tables) -> tuple[DataFrame, DataFrame]:
    k, o, line, s = F.col("p_partkey"), F.col("o_orderkey"), F.col("l_linenumber"), F.col("l_suppkey") % 5
    functions = t.part.select(k.alias("fn"), _pick(k % 6, "IMPLEMENTED", "CHANGED", "PLANNED", "ORPHANED", "IMPLEMENTED", "IMPLEMENTED").alias("state"), (F.col("p_size") % 4 == 0).alias("tested"))
    requirements = t.orders.select(o.alias("req"), F.when(o % 6 == 5, "nonfunctional").otherwise("functional").alias("type"), F.when(F.col("o_orderstatus") == "F", "WITHDRAWN").otherwise("ACTIVE").alias("status"), (F.col("o_custkey") % 3 == 0).alias("approved"))
    targets = t.lineitem.where("l_linenumber < 5 and l_orderkey % 12 <> 5").select(F.col("l_orderkey").alias("req"), (F.col("l_partkey") + F.when(line == 4, 90000000).otherwise(0)).alias("fn"))
    tests = t.lineitem.where("l_orderkey % 4 = 1 and l_linenumber < 3").select(F.col("l_orderkey").alias("req"), line.alias("ac"), F.col("l_partkey").alias("fn"), F.when(s == 0, "FAIL").when(s < 4, "PASS").alias("result"))
    return requirement_coverage(functions, requirements, targets, tests)


@query("c8_requirement_coverage", f"{_COVERAGE} SELECT req, targets, built, acs, passed, implemented, verified, signed FROM c")
def _c8(t: Tables) -> DataFrame:
    return _coverage(t)[0]


@query("c8_coverage_gaps", f"{_COVERAGE} SELECT 'unimplemented' AS gap, req AS key FROM c WHERE status = 'ACTIVE' AND NOT implemented UNION ALL SELECT 'orphan-code', fn FROM f1 WHERE state = 'ORPHANED' UNION ALL SELECT 'unverified', fn FROM f1 WHERE built AND NOT verified")
def _c8b(t: Tables) -> DataFrame:
    return _coverage(t)[1]


@query(
    "q8_chart_errors",
    """n AS (SELECT domain AS chart, seq, concat('n', seq % 70) AS node, ['start', 'activity', 'decision', 'end', 'activity', 'decision'][loc % 6 + 1] AS kind, CASE WHEN seq % 9 = 0 THEN concat('flow', seq % 4) END AS flow FROM files WHERE NOT (domain LIKE '%3' AND loc % 6 IN (0, 3))), e AS (SELECT source_domain AS chart, concat('n', seq % 71) AS source, concat('n', line * 11 % 72) AS target, CASE WHEN seq % 3 > 0 THEN kind ELSE '' END AS label FROM file_edges WHERE kind = 'import' AND source_domain = target_domain),
i AS (SELECT DISTINCT chart, node FROM n), b AS (SELECT chart, source AS node, count(*) AS n, bool_or(label = '') AS bare FROM e GROUP BY chart, source), k AS (SELECT chart, bool_or(kind = 'start') AS s, bool_or(kind = 'end') AS e FROM n GROUP BY chart)
SELECT chart, 'duplicate-node' AS error, node FROM (SELECT *, row_number() OVER (PARTITION BY chart, node ORDER BY seq) AS r FROM n) WHERE r > 1
UNION ALL SELECT chart, 'unknown-source', source FROM e WHERE (chart, source) NOT IN (SELECT (chart, node) FROM i) UNION ALL SELECT chart, 'unknown-target', target FROM e WHERE (chart, target) NOT IN (SELECT (chart, node) FROM i)
UNION ALL SELECT chart, 'orphan-node', node FROM n WHERE (chart, node) NOT IN (SELECT (chart, source) FROM e UNION SELECT (chart, target) FROM e) UNION ALL SELECT chart, 'no-start', '' FROM k WHERE NOT s UNION ALL SELECT chart, 'no-end', '' FROM k WHERE NOT e
UNION ALL SELECT chart, 'unknown-flow', node FROM n WHERE flow IN ('flow2', 'flow3') UNION ALL SELECT n.chart, 'few-branches', n.node FROM n LEFT JOIN b ON b.chart = n.chart AND b.node = n.node WHERE kind = 'decision' AND coalesce(b.n, 0) < 2 UNION ALL SELECT n.chart, 'unlabelled-branch', n.node FROM n JOIN b ON b.chart = n.chart AND b.node = n.node WHERE kind = 'decision' AND bare""",
    ("files", "file_edges"),
)
def _q8(t: Tables) -> DataFrame:
    s, text = F.col("seq"), lambda c: c.cast("string")
    nodes = t.files.where("not (domain like '%3' and loc % 6 in (0, 3))").select(F.col("domain").alias("chart"), "seq", F.concat(F.lit("n"), text(s % 70)).alias("node"), _pick(F.col("loc") % 6, "start", "activity", "decision", "end", "activity", "decision").alias("kind"), F.when(s % 9 == 0, F.concat(F.lit("flow"), text(s % 4))).alias("flow"))
    edges = t.file_edges.where("kind = 'import' and source_domain = target_domain").select(F.col("source_domain").alias("chart"), F.concat(F.lit("n"), text(s % 71)).alias("source"), F.concat(F.lit("n"), text(F.col("line") * 11 % 72)).alias("target"), F.when(s % 3 > 0, F.col("kind")).otherwise("").alias("label"))
    flows = t.spark.createDataFrame([("flow0",), ("flow1",)], "flow string")
    return chart_errors(nodes, edges, flows)
