"""Handlers of actions, histories, persistence impact, topics, file summaries, table rows, labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.functions import text as fn
from factloom.operators.joins import suffix_index
from factloom.operators.knowledge import containment
from factloom.operators.lookups import site_path
from factloom.plans.shared import materialize, shuffled
from factloom.registry import query

# Kinds of edges to mappers, shortest names of topics and codes, words that are no table.
MAPPER_KINDS = ("mapper",)
SHORTEST_TOPIC, SHORTEST_CODE = 4, 3
NO_TABLES = ("select", "set", "where", "values")


def action_handlers(actions: DataFrame, routes: DataFrame, context: str | None = None) -> DataFrame:
    """``actions(id, kind, name, form, href)`` and ``routes(seq, path, handler, file, line)`` -> ``(id, handler, file,
    line)``. An action that submits a form is looked up as its path with its own name, with each name of
    the query, and alone; then its link likewise. The first route of each path counts, and of the
    candidates the first whose route has a handler. Paths are absolute URLs or begin with a slash."""
    first = routes.groupBy("path").agg(F.min_by(F.struct("handler", "file", "line"), "seq").alias("r")).where("r.handler is not null and r.handler <> ''").select("path", "r.*")
    whole = lambda u: F.when(u.startswith("/"), F.concat(F.lit("http://site"), u)).otherwise(u)

    def paths(url: Column, name: Column | None) -> Column:
        path = F.concat(F.lit("/"), site_path(whole(url), context))
        own = [F.when(name.isNotNull() & (name != ""), F.array(F.concat(path, F.lit("?"), name))).otherwise(F.array().cast("array<string>"))] if name is not None else []
        found = F.concat(*own, F.transform(fn.query_keys(url), lambda k: F.concat(path, F.lit("?"), k)), F.array(path))
        return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(found)

    form = F.when((F.col("kind") == "action") & F.col("form").isNotNull(), paths(F.col("form"), F.col("name"))).otherwise(F.array().cast("array<string>"))
    tried = actions.select("id", F.posexplode(F.concat(form, paths(F.col("href"), None))).alias("at", "path"))
    return tried.join(first, "path").groupBy("id").agg(F.min_by(F.struct("handler", "file", "line"), "at").alias("x")).select("id", "x.*")


def resolve_suffixes(names: DataFrame, paths: DataFrame, rows: int = 0) -> DataFrame:
    """``names(name)`` with dots -> ``(name, n, path)``: how many files have the name as their path's last
    segments, without the extension, and the file if it is one."""
    suffixes = suffix_index(paths, rows).groupBy(F.col("suffix").alias("whole")).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    d = names.select("name", F.replace("name", F.lit("."), F.lit("/")).alias("whole")).distinct().join(shuffled(suffixes), "whole", "left")
    return d.select("name", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("path")).alias("path"))


def impact_history(ledger: DataFrame, intake: DataFrame, incidents: DataFrame, most: int) -> DataFrame:
    """``(job, finished, query, kind, source)`` of the newest ``most`` rows: derived rows of intakes and
    incidents, and ledger rows of other jobs, of which the newest of a job counts. A ledger row's source
    is told by its kind, else by its root slot and the mark of its query. A missing time comes last."""
    derived = intake.select("job", "finished", "query", F.lit("intake").alias("kind"), F.lit("intake").alias("source")).union(incidents.select("job", "finished", "query", F.lit("incident").alias("kind"), F.lit("incident").alias("source")))
    slot = F.coalesce(F.col("root_slot"), F.lit(True))
    source = F.when((F.col("kind") == "incident") | (F.col("kind").isNull() & ~slot & F.col("query").startswith("[장애]")), "incident").when((F.col("kind") == "intake") | ~slot, "intake").otherwise("change")
    one = ledger.groupBy("job").agg(F.max_by(F.struct("finished", "query", "kind", "root_slot"), F.struct(F.coalesce("finished", F.lit("")), "query")).alias("x")).select("job", "x.*")
    rest = one.join(derived.select("job"), "job", "left_anti").select("job", "finished", "query", "kind", source.alias("source"))
    return rest.union(derived).orderBy(F.desc(F.coalesce("finished", F.lit(""))), "job", "source").limit(most)


def persistence_impact(impacted: DataFrame, edges: DataFrame, files: DataFrame, entities: DataFrame, repositories: DataFrame) -> DataFrame:
    """``impacted(path)`` -> ``(kind, path, name, cited, line)``: ``mapper`` files that a mapper edge comes to,
    cited by the least line, then file; ``sql`` files; ``table``s of entities that are impacted or whose
    repository is, one for each file, by ``entities(name, path, tbl, line)`` and ``repositories(path, entity)``."""
    inside = materialize(impacted.select("path").distinct(), "impacted")
    hit = edges.where(F.col("kind").isin(*MAPPER_KINDS)).join(inside.toDF("target"), "target", "left_semi")
    cite = F.min(F.when(F.col("line").isNotNull(), F.struct("line", "source")))
    mappers = hit.groupBy("target").agg(cite.alias("c")).select(F.lit("mapper").alias("kind"), F.col("target").alias("path"), F.lit(None).cast("string").alias("name"), F.col("c.source").alias("cited"), F.col("c.line").alias("line"))
    sql = files.where("lang = 'sql'").join(inside, "path", "left_semi").select(F.lit("sql"), "path", F.lit(None), F.lit(None), F.lit(None))
    direct = entities.join(inside, "path", "left_semi").select("path", "tbl", "line", "name", F.lit(0).alias("way"))
    by_repo = repositories.join(inside, "path", "left_semi").select(F.col("entity").alias("name")).distinct().join(entities.groupBy("name").agg(F.min(F.struct("path", "tbl", "line")).alias("e")), "name").select("e.path", "e.tbl", "e.line", "name", F.lit(1))
    tables = direct.union(by_repo).groupBy("path").agg(F.min(F.struct("way", "line", "tbl")).alias("x"))
    return mappers.union(sql).union(tables.select(F.lit("table"), "path", "x.tbl", "path", F.col("x.line").cast("long")))


def split_topics(branches: DataFrame, codes: DataFrame) -> DataFrame:
    """C14: ``branches(domain, branch, text)`` and ``codes(domain, grp, code)`` -> ``(domain, branch, topic)``: the first group
    by name, of the domain's, whose name of four characters or more or whose code of three or more is in
    the branch's text, ignoring case; ``rest`` where none is, and null in domains where no branch has one."""
    hay = branches.select(F.concat_ws("\0", "domain", "branch").alias("hay_id"), F.lower("text").alias("hay"))
    names = codes.where(F.length("grp") >= SHORTEST_TOPIC).select("domain", "grp", F.lower("grp").alias("needle"))
    words = codes.where(F.length("code") >= SHORTEST_CODE).select("domain", "grp", F.lower("code").alias("needle"))
    both = materialize(names.union(words).distinct(), "topics")
    met = containment(both.select(F.col("needle").alias("needle_id"), "needle").distinct(), hay)
    parts = F.split("hay_id", "\0")
    ties = met.select(parts[0].alias("domain"), parts[1].alias("branch"), F.col("needle_id").alias("needle")).join(both, ["domain", "needle"]).groupBy("domain", "branch").agg(F.min("grp").alias("topic"))
    d = branches.select("domain", F.col("branch").cast("string").alias("branch")).join(ties, ["domain", "branch"], "left")
    some = ties.select("domain").distinct().withColumn("tied", F.lit(True))
    return d.join(some, "domain", "left").select("domain", "branch", F.coalesce("topic", F.when(F.col("tied"), "rest")).alias("topic"))


def file_facts(files: DataFrame) -> DataFrame:
    """``files(path, category, text)`` -> ``(path, lines, filled, complexity, what, names)``: lines (a last line break
    not counted), those with text, and by the kind of file: statements and the three commonest tables of
    SQL, keys of property files, the title of a page, the first five columns of a table of data."""
    t, low = F.col("text"), F.lower("path")
    rows = F.split(t, "\n", -1)
    lines = fn.line_count(t)
    filled = F.size(F.filter(rows, lambda s: F.trim(F.regexp_replace(s, r"\s", " ")) != ""))
    sql, page = (F.col("category") == "data") & low.endswith(".sql"), low.rlike(r"\.html?$")
    statements = F.regexp_count(t, F.lit(r"(?i)(?:^|;)\s*(?:create|insert|update|delete|select|alter|drop)\b"))
    keys = F.size(F.filter(rows, lambda s: s.rlike(r"^[ \t]*[^#!;\[\s][^=:]*[=:]")))
    table = r"(?i)(?<!<)\b(?:from|join|into|update|(?:create|alter|drop)\s+table(?:\s+if\s+not\s+exists)?)\s+([A-Za-z_][A-Za-z0-9_.$]*)"
    found = files.where(sql).select("path", F.explode(F.regexp_extract_all(t, F.lit(table), 1)).alias("t")).select("path", F.upper("t").alias("t")).where(~F.lower("t").isin(*NO_TABLES))
    often = found.groupBy("path", "t").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "t"))).where("k <= 3")
    often = often.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), ",").alias("tables"))
    header = F.slice(F.filter(F.transform(F.split(rows[0], F.when(low.endswith(".tsv"), "\t").otherwise(",")), lambda s: F.trim(s)), lambda s: s != ""), F.lit(1), F.lit(5))
    data = (F.col("category") == "data") & ~sql
    what = F.when(sql, statements).when((F.col("category") == "config") & low.rlike(r"\.(properties|ini|env)$"), keys).when(data, F.greatest(lines - 1, F.lit(0)))
    title = F.trim(F.regexp_extract(t, r"(?i)<title[^>]*>([^<]*)</title>", 1))
    names = F.when(sql, F.coalesce("tables", F.lit(""))).when(page, title).when(data, F.array_join(header, ","))
    return files.join(often, "path", "left").select("path", lines.alias("lines"), filled.alias("filled"), fn.band(filled, 50, 200).alias("complexity"), what.alias("what"), names.alias("names"))


def _tuples(text: str) -> Iterator[tuple[str, list[str] | None, list[str], int]]:
    """Rows of insert statements: table, columns, values and line."""

    def split(inner: str) -> list[str]:
        out, depth, quoted, start = [], 0, False, 0
        for i, c in enumerate(inner):
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                if c == "," and not depth:
                    out.append(inner[start:i].strip())
                    start = i + 1
        return [*out, inner[start:].strip()]

    def close(at: int) -> int:
        depth, quoted = 0, False
        for i in range(at, len(text)):
            c = text[i]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                if not depth:
                    return i
        return -1

    plain = lambda v: v[1:-1].replace("''", "'") if len(v) > 1 and v[0] == v[-1] == "'" else v
    bare = lambda s: s.split(".")[-1].strip().strip('`"[]')
    for m in re.finditer(r"(?i)INSERT\s+(?:IGNORE\s+)?INTO\s+([`\"\[\]\w.]+)\s*(\([^)]*\))?\s*VALUES\s*", text):
        at, columns = m.end(), [bare(c) for c in split(m[2][1:-1])] if m[2] else None
        while True:
            while at < len(text) and text[at] in " \t\r\n,":
                at += 1
            end = close(at) if text[at : at + 1] == "(" else -1
            if end < 0:
                break
            yield bare(m[1]), columns, [plain(v) for v in split(text[at + 1 : end])], text.count("\n", 0, at) + 1
            at = end + 1


def insert_rows(files: DataFrame) -> DataFrame:
    """``files(file, text)`` -> ``(file, seq, tbl, columns, values, line)``, a row for each tuple of an insert, quoted
    commas and brackets not splitting. Splitting is sequential, so it is a small function over texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32()]
        for batch in batches:
            rows = [(file, i, *x) for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, x in enumerate(_tuples(text or ""))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "seq", "tbl", "columns", "values", "line"])

    return files.select("file", "text").mapInArrow(run, "file string, seq int, tbl string, columns array<string>, values array<string>, line int")


def label_blanks(nodes: DataFrame, edges: DataFrame, blank: str) -> DataFrame:
    """``nodes(id, type, name, summary, tag, entry, entry_type, path, layer)`` with blank names filled: a domain by its
    key in title case with counts of flows and nodes, a flow by its entry, a step by its file's stem."""
    flows = edges.where("type = 'contains_flow'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("flows"))
    tags = nodes.where("tag is not null").groupBy("tag").agg(F.count("*").alias("total"))
    bare = F.regexp_replace("id", "^(domain|flow|step):", "")
    d = nodes.join(flows, "id", "left").join(tags.withColumnRenamed("tag", "key"), F.regexp_replace("id", "^domain:", "") == F.col("key"), "left")
    words = F.filter(F.split(bare, "[-_]"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    name = F.when(F.col("type") == "domain", title).when(F.col("type") == "flow", F.coalesce(F.nullif("entry", F.lit("")), bare)).when(F.col("type") == "step", F.coalesce(fn.stem(F.col("path")), bare)).otherwise(F.col("name"))
    counts = F.concat(F.coalesce("flows", F.lit(0)).cast("string"), F.lit(" flows, "), F.coalesce("total", F.lit(1)).cast("string"), F.lit(" nodes"))
    about = F.when(F.col("type") == "domain", counts).when(F.col("type") == "flow", F.coalesce(F.concat(F.lit("entry: "), F.nullif("entry_type", F.lit(""))), F.col("summary"))).when(F.col("type") == "step", F.coalesce(F.concat(F.lit("layer: "), F.nullif("layer", F.lit(""))), F.col("summary"))).otherwise(F.col("summary"))
    is_blank = F.col("name") == blank
    return d.select("id", "type", F.when(is_blank, name).otherwise(F.col("name")).alias("name"), F.when(is_blank, about).otherwise(F.col("summary")).alias("summary"))


def ancestors(path: Column) -> Column:
    """Folders of a path from its own up to the top."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


@query(
    "j11_action_handlers",
    """r AS (SELECT seq, CASE seq % 4 WHEN 0 THEN concat('/a/', seq % 90, '?save') WHEN 1 THEN concat('/a/', seq % 90) ELSE concat('/a/', seq % 90, '?k', seq % 3) END AS path, CASE WHEN seq % 5 > 0 THEN concat('H', seq) END AS handler FROM files), f AS (SELECT path, arg_min(CASE WHEN handler IS NULL THEN '' ELSE handler END, seq) AS handler, min(seq) AS seq FROM r GROUP BY path),
c AS (SELECT page_id AS id, p.pos, p.path FROM (SELECT page_id, unnest(CASE WHEN page_id % 3 = 0 THEN [{'pos': 0, 'path': concat('/a/', page_id % 90, '?save')}, {'pos': 1, 'path': concat('/a/', page_id % 90, '?k1')}, {'pos': 2, 'path': concat('/a/', page_id % 90)}] WHEN page_id % 3 = 1 THEN [{'pos': 0, 'path': concat('/a/', page_id % 90, '?k2')}, {'pos': 1, 'path': concat('/a/', page_id % 90)}] ELSE [{'pos': 0, 'path': concat('/a/', page_id % 90)}] END) AS p FROM pages))
SELECT id, arg_min(handler, pos) AS handler, concat('f', arg_min(f.seq, pos)) AS file, arg_min(f.seq, pos) AS line FROM c JOIN f USING (path) WHERE handler <> '' GROUP BY id""",
    ("files",),
)
def _j11(t: Tables) -> DataFrame:
    s, n, text = F.col("seq"), F.col("page_id"), lambda c: c.cast("string")
    path = F.concat(F.lit("/a/"), text(s % 90), F.when(s % 4 == 0, "?save").when(s % 4 == 1, "").otherwise(F.concat(F.lit("?k"), text(s % 3))))
    routes = t.files.select("seq", path.alias("path"), F.when(s % 5 > 0, F.concat(F.lit("H"), text(s))).alias("handler"), F.concat(F.lit("f"), text(s)).alias("file"), s.alias("line"))
    url = F.concat(F.lit("/shop/a/"), text(n % 90))
    actions = t.pages.select(n.alias("id"), F.when(n % 3 == 0, "action").otherwise("link").alias("kind"), F.lit("save").alias("name"), F.when(n % 3 == 0, F.concat(url, F.lit("?k1=2"))).alias("form"), F.when(n % 3 == 1, F.concat(url, F.lit("?k2="))).when(n % 3 == 2, F.concat(F.lit("https://x.org"), url)).alias("href"))
    return action_handlers(actions, routes, "/shop")


@query(
    "j15_suffixes",
    r"""n AS (SELECT DISTINCT CASE seq % 3 WHEN 0 THEN replace(regexp_replace(path, '\.[^./]*$', ''), '/', '.') WHEN 1 THEN regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') ELSE concat('no.', seq) END AS name FROM files WHERE seq % 2 = 0 UNION SELECT 'Mapper'),
s AS (SELECT suffix, count(*) AS n, min(path) AS path FROM (SELECT path, array_to_string(p[i:], '/') AS suffix FROM (SELECT path, string_split(regexp_replace(path, '\.[^./]*$', ''), '/') AS p FROM files), range(1, 9) r(i) WHERE i <= len(p)) GROUP BY suffix) SELECT name, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN path END AS path FROM n LEFT JOIN s ON suffix = replace(name, '.', '/')""",
    ("files",),
)
def _j15(t: Tables) -> DataFrame:
    s = F.col("seq")
    name = F.when(s % 3 == 0, F.replace(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("/"), F.lit("."))).when(s % 3 == 1, fn.stem(F.col("path"))).otherwise(F.concat(F.lit("no."), s.cast("string")))
    names = t.files.where("seq % 2 = 0").select(name.alias("name"))
    return resolve_suffixes(names.union(t.spark.createDataFrame([("Mapper",)], "name string")), t.files, 4 * t.rows("part"))


@query(
    "j24_impact_history",
    """l AS (SELECT concat('j', user_id) AS job, CASE WHEN event_id % 50 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS finished, CASE WHEN event_id % 7 = 0 THEN concat('[장애] q', event_id) ELSE concat('q', event_id) END AS query, CASE event_id % 5 WHEN 0 THEN 'incident' WHEN 1 THEN 'intake' WHEN 2 THEN 'other' END AS kind, event_id % 3 > 0 AS root_slot FROM events),
o AS (SELECT job, x.* FROM (SELECT job, arg_max({'finished': finished, 'query': query, 'kind': kind, 'root_slot': root_slot}, (coalesce(finished, ''), query)) AS x FROM l GROUP BY job)), d AS (SELECT concat('j', o_custkey) AS job, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS finished, 'asked' AS query, CASE WHEN o_custkey % 2 = 0 THEN 'intake' ELSE 'incident' END AS source FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey),
a AS (SELECT job, finished, query, kind, CASE WHEN kind = 'incident' OR (kind IS NULL AND NOT root_slot AND starts_with(query, '[장애]')) THEN 'incident' WHEN kind = 'intake' OR NOT root_slot THEN 'intake' ELSE 'change' END AS source FROM o WHERE job NOT IN (SELECT job FROM d) UNION ALL SELECT job, finished, query, source, source FROM d)
SELECT * FROM a ORDER BY coalesce(finished, '') DESC, job, source LIMIT 60""",
)
def _j24(t: Tables) -> DataFrame:
    e, when = F.col("event_id"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    ledger = t.events.select(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job"), F.when(e % 50 > 0, when("ts")).alias("finished"), F.concat(F.when(e % 7 == 0, "[장애] q").otherwise("q"), e.cast("string")).alias("query"), F.when(e % 5 == 0, "incident").when(e % 5 == 1, "intake").when(e % 5 == 2, "other").alias("kind"), (e % 3 > 0).alias("root_slot"))
    made = t.orders.where("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.min("o_orderdate").alias("at")).select(F.concat(F.lit("j"), F.col("o_custkey").cast("string")).alias("job"), when("at").alias("finished"), F.lit("asked").alias("query"), "o_custkey")
    return impact_history(ledger, made.where("o_custkey % 2 = 0"), made.where("o_custkey % 2 = 1"), 60)


@query(
    "j26_persistence_impact",
    """im AS (SELECT path FROM files WHERE seq % 3 = 0), ed AS (SELECT source, target, CASE WHEN kind = 'data' THEN 'mapper' ELSE kind END AS kind, CASE WHEN seq % 4 > 0 THEN line END AS line FROM file_edges), en AS (SELECT concat('E', seq) AS name, path, concat('t', loc) AS tbl, loc AS line FROM files WHERE lang = 'java'), re AS (SELECT path, concat('E', seq - 1) AS entity FROM files WHERE lang = 'typescript'),
m AS (SELECT target AS path, min((line, source)) FILTER (line IS NOT NULL) AS c FROM ed WHERE kind = 'mapper' AND target IN (SELECT path FROM im) GROUP BY target),
tb AS (SELECT path, min((way, line, tbl)) AS x FROM (SELECT path, tbl, line, 0 AS way FROM en WHERE path IN (SELECT path FROM im) UNION ALL SELECT e.path, tbl, line, 1 FROM en e WHERE name IN (SELECT entity FROM re WHERE path IN (SELECT path FROM im))) GROUP BY path)
SELECT 'mapper' AS kind, path, NULL AS name, c[2] AS cited, coalesce(c[1], -1) AS line FROM m UNION ALL SELECT 'sql', path, NULL, NULL, -1 FROM files WHERE lang = 'sql' AND path IN (SELECT path FROM im) UNION ALL SELECT 'table', path, x[3], path, x[2] FROM tb""",
    ("files", "file_edges"),
)
def _j26(t: Tables) -> DataFrame:
    s, text = F.col("seq"), lambda c: c.cast("string")
    edges = t.file_edges.select("source", "target", F.when(F.col("kind") == "data", "mapper").otherwise(F.col("kind")).alias("kind"), F.when(s % 4 > 0, F.col("line")).alias("line"))
    entities = t.files.where("lang = 'java'").select(F.concat(F.lit("E"), text(s)).alias("name"), "path", F.concat(F.lit("t"), text(F.col("loc"))).alias("tbl"), F.col("loc").alias("line"))
    repositories = t.files.where("lang = 'typescript'").select("path", F.concat(F.lit("E"), text(s - 1)).alias("entity"))
    return persistence_impact(t.files.where("seq % 3 = 0"), edges, t.files, entities, repositories).fillna(-1, ["line"])


@query(
    "c14_topics",
    """b AS (SELECT domain, seq AS branch, concat('if ', CASE seq % 5 WHEN 0 THEN 'ORDER' WHEN 1 THEN 'code PX1' WHEN 2 THEN 'ab' WHEN 3 THEN 'stock and order' ELSE 'none' END, ' then ', loc) AS text FROM files), c AS (SELECT DISTINCT domain, x.* FROM (SELECT domain, unnest([{'grp': 'Order', 'code': 'ab'}, {'grp': 'Pay', 'code': 'px1'}, {'grp': 'Stock', 'code': 'zz9'}]) AS x FROM files WHERE domain NOT LIKE '%5')),
n AS (SELECT domain, grp, lower(grp) AS w FROM c WHERE length(grp) >= 4 UNION SELECT domain, grp, lower(code) FROM c WHERE length(code) >= 3), t AS (SELECT b.domain, branch, min(grp) AS topic FROM b JOIN n ON n.domain = b.domain AND contains(lower(text), w) GROUP BY b.domain, branch)
SELECT b.domain, CAST(b.branch AS VARCHAR) AS branch, coalesce(topic, CASE WHEN b.domain IN (SELECT domain FROM t) THEN 'rest' END) AS topic FROM b LEFT JOIN t ON t.domain = b.domain AND t.branch = b.branch""",
    ("files",),
)
def _c14(t: Tables) -> DataFrame:
    s = F.col("seq") % 5
    branches = t.files.select("domain", F.col("seq").alias("branch"), F.concat(F.lit("if "), F.when(s == 0, "ORDER").when(s == 1, "code PX1").when(s == 2, "ab").when(s == 3, "stock and order").otherwise("none"), F.lit(" then "), F.col("loc").cast("string")).alias("text"))
    codes = F.inline(F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(c).alias("code")) for g, c in (("Order", "ab"), ("Pay", "px1"), ("Stock", "zz9"))]))
    return split_topics(branches, t.files.where("domain not like '%5'").select("domain").distinct().select("domain", codes))


@query(
    "x14_file_facts",
    """f AS (SELECT path, seq AS k, loc, lang FROM files) SELECT path, CAST(CASE lang WHEN 'sql' THEN 4 WHEN 'xml' THEN 3 WHEN 'python' THEN 2 WHEN 'java' THEN 3 ELSE loc END AS INT) AS lines, CAST(CASE lang WHEN 'sql' THEN 3 WHEN 'xml' THEN 3 WHEN 'python' THEN 2 WHEN 'java' THEN 3 ELSE loc END AS INT) AS filled, CASE WHEN lang NOT IN ('sql', 'xml', 'python', 'java') AND loc > 50 THEN 'moderate' ELSE 'simple' END AS complexity,
CAST(CASE lang WHEN 'sql' THEN 3 WHEN 'xml' THEN 2 WHEN 'java' THEN 2 ELSE -1 END AS INT) AS what, CASE lang WHEN 'sql' THEN concat('B,A', k % 4, ',D') WHEN 'python' THEN concat('Page ', k) WHEN 'java' THEN 'a,b,c,d,e' END AS names FROM f""",
    ("files",),
)
def _x14(t: Tables) -> DataFrame:
    k, lang = F.col("seq").cast("string"), F.col("lang")
    sql = F.concat(F.lit("select * from a"), (F.col("seq") % 4).cast("string"), F.lit(" join b on 1=1;\n\ninsert into b values (1);\nupdate d set x = 1"))
    text = F.when(lang == "sql", sql).when(lang == "xml", "# c\n a.b = 1\nk: v").when(lang == "python", F.concat(F.lit("<html>\n<TITLE> Page "), k, F.lit(" </TITLE>\n"))).when(lang == "java", "a,b, c,,d,e,f\n1\n2\n").otherwise(F.array_join(F.array_repeat(F.lit("x"), F.col("loc").cast("int")), "\n"))
    suffix = F.when(lang == "sql", ".sql").when(lang == "xml", ".properties").when(lang == "python", ".html").when(lang == "java", ".csv").otherwise(".ts")
    category = F.when(lang.isin("sql", "java"), "data").when(lang == "xml", "config").when(lang == "python", "markup").otherwise("code")
    found = file_facts(t.files.select(F.concat("path", F.lit("|"), suffix).alias("path"), category.alias("category"), text.alias("text")))
    return found.withColumn("path", F.substring_index("path", "|", 1)).fillna(-1, ["what"])


@query(
    "x13_insert_rows",
    """f AS (SELECT path AS file, seq AS k FROM files WHERE lang = 'sql'), r AS (SELECT file, unnest([{'seq': 0, 'tbl': 't1', 'columns': 'id,nm', 'vals': concat(k, '|it''s, (', k, ')'), 'line': 2}, {'seq': 1, 'tbl': 't1', 'columns': 'id,nm', 'vals': 'NULL|f(1, 2)', 'line': 3}, {'seq': 2, 'tbl': 'T2', 'columns': NULL, 'vals': 'x', 'line': 4}]) AS x FROM f) SELECT file, x.* FROM r""",
    ("files",),
)
def _x13(t: Tables) -> DataFrame:
    k = F.col("seq").cast("string")
    text = F.concat(F.lit("-- d\nINSERT INTO `t1` (id, \"nm\") VALUES ("), k, F.lit(", 'it''s, ("), k, F.lit(")'),\n (NULL, f(1, 2));\ninsert ignore into db.[T2] values ('x');"))
    rows = insert_rows(t.files.where("lang = 'sql'").select(F.col("path").alias("file"), text.alias("text")))
    return rows.select("file", "seq", "tbl", F.array_join("columns", ",").alias("columns"), F.array_join("values", "|").alias("vals"), "line")


@query(
    "n19_labels",
    """d AS (SELECT DISTINCT domain FROM files), n AS (SELECT concat('domain:', domain, '-side_one') AS id, 'domain' AS type, CASE WHEN domain LIKE '%7' THEN 'Kept' ELSE concat(upper(left(domain, 1)), substr(domain, 2), ' Side One') END AS name, CASE WHEN domain LIKE '%7' THEN '?' ELSE concat((SELECT count(*) FROM files f WHERE f.domain = d.domain AND seq % 2 = 0), ' flows, ', 1 + (SELECT count(*) FROM files f WHERE f.domain = d.domain), ' nodes') END AS summary FROM d
UNION ALL SELECT concat('flow:', seq), 'flow', CASE WHEN seq % 4 = 0 THEN concat('GET /', seq) ELSE CAST(seq AS VARCHAR) END, CASE WHEN seq % 6 = 0 THEN 'entry: http' ELSE '?' END FROM files WHERE seq % 2 = 0 UNION ALL SELECT concat('step:', seq), 'step', regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), CASE WHEN seq % 3 = 0 THEN 'layer: dao' ELSE '?' END FROM files WHERE seq % 2 = 1) SELECT * FROM n""",
    ("files",),
)
def _n19(t: Tables) -> DataFrame:
    s, text = F.col("seq"), lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    key = F.concat("domain", F.lit("-side_one"))
    domains = t.files.select("domain").distinct().select(F.concat(F.lit("domain:"), key).alias("id"), F.lit("domain").alias("type"), F.when(F.col("domain").like("%7"), "Kept").otherwise("?").alias("name"), F.lit("?").alias("summary"), key.alias("tag"), none.alias("entry"), none.alias("entry_type"), none.alias("path"), none.alias("layer"))
    flows = t.files.where("seq % 2 = 0").select(F.concat(F.lit("flow:"), text(s)), F.lit("flow"), F.lit("?"), F.lit("?"), key, F.when(s % 4 == 0, F.concat(F.lit("GET /"), text(s))), F.when(s % 6 == 0, "http"), none, none)
    steps = t.files.where("seq % 2 = 1").select(F.concat(F.lit("step:"), text(s)), F.lit("step"), F.lit("?"), F.lit("?"), key, none, none, "path", F.when(s % 3 == 0, "dao"))
    edges = t.files.where("seq % 2 = 0").select(F.concat(F.lit("domain:"), key).alias("source"), F.concat(F.lit("flow:"), text(s)).alias("target"), F.lit("contains_flow").alias("type"))
    return label_blanks(domains.union(flows).union(steps), edges, "?")


@query("n6_ancestors", "SELECT path, array_to_string(list_transform(range(len(string_split(path, '/')) - 1, 0, -1), lambda k: array_to_string(string_split(path, '/')[1:k], '/')), ' ') AS folders FROM legacy_files", ("legacy_files",))
def _n6(t: Tables) -> DataFrame:
    return t.legacy_files.select("path", F.array_join(ancestors(F.col("path")), " ").alias("folders"))
