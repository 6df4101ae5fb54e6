"""Screens, policies of documents, wiki graphs and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.functions import text as fn
from factloom.operators.resolve import key_cardinality
from factloom.operators.windows import half_up
from factloom.plans.shared import broadcast_if_small, materialize
from factloom.registry import query


def domain_cards(flows: DataFrame, claims: DataFrame) -> DataFrame:
    """Per domain its flows, a form's flow counted with its primary, and grounded claims."""
    own = flows.withColumn("main", F.coalesce("form_of", "flow"))
    d = own.groupBy("domain").agg(F.count_distinct("main").alias("flows"), F.sum("steps").alias("steps"))
    c = claims.join(own.select("flow", "domain"), "flow").groupBy("domain").agg(F.count_if("grounded").alias("grounded"), F.count("*").alias("claims"))
    return d.join(c, "domain", "left").select("domain", "flows", "steps", F.coalesce("grounded", F.lit(0)).alias("grounded"), F.coalesce("claims", F.lit(0)).alias("claims"))


def screen_statistics(screens: DataFrame) -> DataFrame:
    """Rates over all screens, NULL where there is no base."""
    rate = lambda part, base: half_up(F.count_if(part) / F.nullif(F.count_if(base), F.lit(0)) * 100, 1)
    return screens.agg(rate(F.col("confirmed") & F.col("action"), F.col("action")).alias("confirmed_pct"), rate(F.col("described"), F.lit(True)).alias("described_pct"), rate(F.col("mapped") & F.col("reached"), F.col("reached")).alias("mapped_pct"))


def work_counts(steps: DataFrame) -> DataFrame:
    """Steps and different files of each flow."""
    return steps.groupBy("flow").agg(F.count("*").alias("steps"), F.count_distinct("path").alias("files"))


def mentioned_terms(texts: DataFrame, terms: DataFrame, shortest: int = 4) -> DataFrame:
    """Terms (of ``shortest`` characters or more) that occur as words of a domain's text,
    the first of each code. Words meet terms by equality."""
    words = texts.select("domain", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9_]+"))).alias("word"))
    t = terms.where(F.length("term") >= shortest).select(F.lower("term").alias("word"), "code", "label", "seq")
    return words.join(t, "word").groupBy("domain", "word", "code").agg(F.min_by("label", "seq").alias("label"))


def candidate_routes(missing: DataFrame, routes: DataFrame) -> DataFrame:
    """C20: for a missing page the route of its directory with the most common words; none if two
    are level. ``missing(page, dir, tokens)``, ``routes(route, dir, tokens)``."""
    # pages and routes with equal words are level, so that only the sets of words of a directory meet, by a common word
    words = F.array_sort(F.array_distinct("tokens")).alias("words")
    pages = missing.select("page", "dir", words)
    sets = routes.select("route", "dir", words).groupBy("dir", "words").agg(F.count("*").alias("n"), F.min("route").alias("route"))
    asked = pages.select("dir", "words").distinct().select("dir", "words", F.explode("words").alias("word"))
    given = sets.select("dir", F.col("words").alias("other"), "n", "route", F.explode("words").alias("same"))
    met = asked.join(given, (asked.dir == given.dir) & asked.word.eqNullSafe(given.same)).drop(given.dir)
    met = met.groupBy("dir", "words", "other").agg(F.count("*").alias("common"), F.first("n").alias("n"), F.first("route").alias("route"))
    level = met.groupBy("dir", "words", "common").agg(F.sum("n").alias("n"), F.min("route").alias("route"))
    best = level.groupBy("dir", "words").agg(F.max(F.struct("common", "n", "route")).alias("best"))
    tops = pages.join(best, ["dir", "words"]).groupBy("page", "best.common").agg(F.sum("best.n").alias("n"), F.min("best.route").alias("route"))
    top = tops.groupBy("page").agg(F.max(F.struct("common", "n", "route")).alias("top"))
    return top.where("top.n = 1").select("page", "top.route", F.col("top.common").cast("int").alias("common"))


def document_index(docs: DataFrame) -> DataFrame:
    """Documents of a semantic key in other methodologies: how many, and the first."""
    d = docs.select("doc", "key", "methodology").where("key is not null and methodology is not null")
    groups = materialize(d.groupBy("key", "methodology").agg(F.count("*").alias("n"), F.min("doc").alias("first")), "groups")
    # a key's first document is the first of all but its own methodology, which takes the first of the others
    keys = groups.groupBy("key").agg(F.sum("n").alias("all"), F.min(F.struct("first", "methodology")).alias("least"))
    others = groups.join(keys, "key").where("methodology <> least.methodology").groupBy("key").agg(F.min("first").alias("next"))
    first = F.when(F.col("methodology") == F.col("least.methodology"), F.col("next")).otherwise(F.col("least.first"))
    table = groups.join(keys, "key").join(others, "key").select("key", "methodology", (F.col("all") - F.col("n")).alias("links"), first.alias("first"))
    table = broadcast_if_small(materialize(table, "links"))
    return d.join(table, ["key", "methodology"]).groupBy("doc").agg(F.sum("links").alias("links"), F.min("first").alias("first"))


def onboarding(memberships: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """Names of a layer's first members and how many are complex."""
    d = memberships.join(nodes.select(F.col("id").alias("node_id"), "name", "complexity"), "node_id")
    place = F.row_number().over(Window.partitionBy("layer").orderBy("pos", "node_id", "name"))
    first = d.withColumn("place", place).where(F.col("place") <= most).groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("first"))
    first = first.select(F.col("layer").alias("of"), F.array_join(F.transform("first", lambda x: x["name"]), ",").alias("members"))
    counts = d.groupBy("layer").agg(F.count_if(F.col("complexity") == "complex").alias("complex"))
    return counts.join(first, F.col("layer").eqNullSafe(F.col("of"))).select("layer", "members", "complex")


def wiki_graph(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links resolved by whole path, else by a base name that only one page has; a row a pair
    of different pages."""
    base = F.substring_index("path", "/", -1)
    one = pages.groupBy(base.alias("target")).agg(F.count("*").alias("n"), F.min("path").alias("named")).where("n = 1").drop("n")
    d = links.join(pages.select(F.col("path").alias("target"), F.col("path").alias("exact")), "target", "left").join(one, "target", "left")
    d = d.select("file", F.coalesce("exact", "named").alias("to")).where("to is not null and to <> file")
    return d.groupBy("file", "to").agg(F.count("*").alias("n"))


def screen_errors(screens: DataFrame) -> DataFrame:
    """Q5: duplicate keys, confirmed ones without evidence, hashes that do not fit their content."""
    dup = screens.groupBy("key").count().where("count > 1").select("key", F.lit("duplicate").alias("error"))
    bare = screens.where(F.col("confirmed") & F.col("evidence").isNull()).select("key", F.lit("no-evidence"))
    wrong = screens.where(fn.signature(F.col("title"), F.col("elements")) != F.col("hash")).select("key", F.lit("hash"))
    return dup.union(bare).union(wrong).distinct()


@query(
    "a9_domain_cards",
    """f AS (SELECT path AS flow, domain, CASE WHEN seq % 6 = 0 THEN 'main' END AS form_of, loc AS steps, seq FROM files), c AS (SELECT source AS flow, line > 2 AS grounded FROM file_edges)
SELECT d.domain, flows, steps, coalesce(grounded, 0) AS grounded, coalesce(claims, 0) AS claims FROM (SELECT domain, count(DISTINCT coalesce(form_of, flow)) AS flows, CAST(sum(steps) AS BIGINT) AS steps FROM f GROUP BY 1) d
LEFT JOIN (SELECT domain, count(*) FILTER (WHERE grounded) AS grounded, count(*) AS claims FROM c JOIN f USING (flow) GROUP BY 1) x ON x.domain = d.domain""",
    ("files", "file_edges"),
)
def _a9(t: Tables) -> DataFrame:
    flows = t.files.select(F.col("path").alias("flow"), "domain", F.when(F.col("seq") % 6 == 0, "main").alias("form_of"), F.col("loc").alias("steps"))
    return domain_cards(flows, t.file_edges.select(F.col("source").alias("flow"), (F.col("line") > 2).alias("grounded")))


@query(
    "a25_screen_statistics",
    "SELECT floor(count(*) FILTER (WHERE page_id % 3 = 0 AND page_id % 2 = 0) * 1e0 / count(*) FILTER (WHERE page_id % 2 = 0) * 100 * 10 + 0.5) / 10 AS confirmed_pct, floor(count(*) FILTER (WHERE page_id % 7 > 1) * 1e0 / count(*) * 100 * 10 + 0.5) / 10 AS described_pct, CAST(NULL AS DOUBLE) AS mapped_pct FROM pages",
)
def _a25(t: Tables) -> DataFrame:
    n = F.col("page_id")
    return screen_statistics(t.pages.select((n % 3 == 0).alias("confirmed"), (n % 2 == 0).alias("action"), (n % 7 > 1).alias("described"), (n % 5 == 0).alias("mapped"), (n < 0).alias("reached")))


@query("a28_work_counts", "SELECT source AS flow, count(*) AS steps, count(DISTINCT target) AS files FROM file_edges GROUP BY source", ("file_edges",))
def _a28(t: Tables) -> DataFrame:
    return work_counts(t.file_edges.select(F.col("source").alias("flow"), F.col("target").alias("path")))


@query(
    "c13_mentioned_terms",
    r"""w AS (SELECT DISTINCT doc_id AS domain, unnest(string_split_regex(lower(line), '[^a-z0-9_]+')) AS word FROM lines), t AS (SELECT unnest(['that', 'this', 'the', 'from']) AS word, unnest([1, 2, 3, 4]) AS k)
SELECT domain, word, concat('c', k) AS code, concat('label', k) AS label FROM w JOIN t USING (word) WHERE length(word) >= 4""",
    ("lines",),
)
def _c13(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([(w, f"c{i}", f"label{i}", i) for i, w in enumerate(("THAT", "this", "the", "from"), 1)] + [("that", "c1", "later", 9)], "term string, code string, label string, seq int")
    return mentioned_terms(t.documents.select(F.col("doc_id").alias("domain"), "text"), terms)


@query(
    "c20_candidate_routes",
    """m AS (SELECT path AS page, domain AS dir, lang, loc % 3 AS a, seq FROM files WHERE seq % 4 = 0), r AS (SELECT path AS route, domain AS dir, lang, loc % 3 AS a FROM files WHERE seq % 4 = 1),
d AS (SELECT page, route, CAST(m.lang = r.lang AS INT) + CAST(m.a = r.a AS INT) AS common FROM m JOIN r USING (dir)), b AS (SELECT *, max(common) OVER (PARTITION BY page) AS best FROM d WHERE common > 0)
SELECT page, min(route) AS route, any_value(common) AS common FROM b WHERE common = best GROUP BY page HAVING count(*) = 1""",
    ("files",),
)
def _c20(t: Tables) -> DataFrame:
    tokens = F.array("lang", (F.col("loc") % 3).cast("string")).alias("tokens")
    return candidate_routes(t.files.where("seq % 4 = 0").select(F.col("path").alias("page"), F.col("domain").alias("dir"), tokens), t.files.where("seq % 4 = 1").select(F.col("path").alias("route"), F.col("domain").alias("dir"), tokens))


@query("c24_document_index", "SELECT a.path AS doc, count(*) AS links, min(b.path) AS first FROM files a JOIN files b ON a.domain = b.domain AND a.lang <> b.lang GROUP BY a.path", ("files",))
def _c24(t: Tables) -> DataFrame:
    return document_index(t.files.select(F.col("path").alias("doc"), F.col("domain").alias("key"), F.col("lang").alias("methodology")))


@query(
    "c27_onboarding",
    "m AS (SELECT layer, name, complexity, row_number() OVER (PARTITION BY layer ORDER BY pos, node_id, name) AS place FROM memberships JOIN nodes ON id = node_id) SELECT layer, string_agg(name, ',' ORDER BY place) FILTER (WHERE place <= 5) AS members, count(*) FILTER (WHERE complexity = 'complex') AS complex FROM m GROUP BY layer",
    ("memberships", "nodes"),
)
def _c27(t: Tables) -> DataFrame:
    return onboarding(t.memberships, t.nodes)


@query(
    "x7_wiki_graph",
    """l AS (SELECT source AS file, CASE seq % 3 WHEN 0 THEN target WHEN 1 THEN regexp_extract(target, '[^/]*$') ELSE concat('gone', seq) END AS target FROM file_edges), b AS (SELECT regexp_extract(path, '[^/]*$') AS target, min(path) AS named FROM files GROUP BY 1 HAVING count(*) = 1),
d AS (SELECT file, coalesce(f.path, named) AS "to" FROM l LEFT JOIN files f ON f.path = l.target LEFT JOIN b ON b.target = l.target) SELECT file, "to", count(*) AS n FROM d WHERE "to" IS NOT NULL AND "to" <> file GROUP BY 1, 2""",
    ("files", "file_edges"),
)
def _x7(t: Tables) -> DataFrame:
    k = F.col("seq") % 3
    links = t.file_edges.select(F.col("source").alias("file"), F.when(k == 0, F.col("target")).when(k == 1, F.substring_index("target", "/", -1)).otherwise(F.concat(F.lit("gone"), F.col("seq").cast("string"))).alias("target"))
    return wiki_graph(links, t.files.select("path"))


@query(
    "j22_key_cardinality",
    "SELECT path AS fk, CASE WHEN seq % 3 = 0 OR seq % 4 = 0 THEN 'one' ELSE 'many' END AS child, seq % 5 = 0 AS optional FROM files",
    ("files",),
)
def _j22(t: Tables) -> DataFrame:
    n = F.col("seq")
    text = lambda *c: F.array(*map(F.lit, c))
    return key_cardinality(
        t.files.select(F.col("path").alias("fk"), text("b", "a").alias("cols"), F.when(n % 3 == 0, text("a", "b")).otherwise(text("id")).alias("pk"), F.when(n % 4 == 0, F.array(text("x"), text("a", "b"))).otherwise(F.array(text("a"))).alias("uniques"), F.when(n % 5 == 0, text("a", "b", "c")).otherwise(text("a")).alias("nullable"))
    )


@query(
    "q5_screen_errors",
    """s AS (SELECT domain AS key, seq, seq % 4 = 0 AS confirmed, CASE WHEN seq % 8 > 0 THEN lang END AS evidence FROM files)
SELECT key, 'duplicate' AS error FROM s GROUP BY key HAVING count(*) > 1 UNION SELECT key, 'no-evidence' FROM s WHERE confirmed AND evidence IS NULL UNION SELECT key, 'hash' FROM s WHERE seq % 6 = 0""",
    ("files",),
)
def _q5(t: Tables) -> DataFrame:
    n = F.col("seq")
    parts = F.array("lang", "path", "lang")
    d = t.files.select(F.col("domain").alias("key"), F.col("path").alias("title"), parts.alias("elements"), (n % 4 == 0).alias("confirmed"), F.when(n % 8 > 0, F.col("lang")).alias("evidence"), "seq")
    return screen_errors(d.withColumn("hash", F.when(n % 6 == 0, "no").otherwise(fn.signature(F.col("title"), F.col("elements")))))
