"""Aggregations (A1-A32 without A27)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.operators.filters import is_generated
from factloom.operators.windows import half_up
from factloom.plans.shared import spread
from factloom.registry import query

# Weights of function points by kind.
POINTS = {"EI": 4.0, "EQ": 3.9, "ILF": 7.5, "EIF": 5.4}


def fan(edges: DataFrame, by: str, other: str, kinds: tuple[str, ...]) -> DataFrame:
    """A1, A2: distinct ``other`` ends of each ``by`` end over the kinds, no self edges."""
    return linked(edges, kinds).groupBy(F.col(by).alias("id")).agg(F.count(other).alias("fan"))


def linked(edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Pairs ``(source, target)`` over the kinds, once each, no self edges."""
    return edges.where(F.col("kind").isin(*kinds) & (F.col("source") != F.col("target"))).select("source", "target").distinct()


def churn(log: DataFrame) -> DataFrame:
    """A3: commits and changed lines of each path."""
    once = log.groupBy("path", "sha").agg(F.sum(F.col("added") + F.col("deleted")).alias("lines"))
    return once.groupBy("path").agg(F.count("sha").alias("commits"), F.sum("lines").alias("lines"))


def work_totals(log: DataFrame) -> DataFrame:
    """A4: one row of totals, generated files apart."""
    made = is_generated(F.col("path"))
    lines = F.col("added") + F.col("deleted")
    return log.agg(
        F.count_distinct("sha").alias("commits"),
        F.count_distinct(F.when(F.col("is_merge"), F.col("sha"))).alias("merges"),
        F.count_distinct("author").alias("authors"),
        F.count_distinct(F.when(~made, F.col("path"))).alias("files"),
        F.sum(F.when(~made, lines).otherwise(0)).alias("lines"),
        F.sum(F.when(made, lines).otherwise(0)).alias("generated_lines"),
    )


def module_rollup(log: DataFrame, domains: DataFrame, top: int = 3) -> DataFrame:
    """A5: per domain (else first directory) distinct commits and files, lines, and the ``top``
    files by lines, then path."""
    d = log.join(domains.select("path", "domain"), "path", "left").withColumn("domain", F.coalesce("domain", F.substring_index("path", "/", 1)))
    each = d.groupBy("domain", "path").agg(F.sum(F.col("added") + F.col("deleted")).alias("n"))
    commits = d.select("domain", "sha").distinct().groupBy("domain").agg(F.count("sha").alias("commits"))
    totals = commits.join(each.groupBy("domain").agg(F.count("path").alias("files"), F.sum("n").alias("lines")), "domain")
    files = each.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "path"))).where(F.col("place") <= top)
    best = files.groupBy("domain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), ",").alias("top_files"))
    return totals.join(best, "domain")


def cross_domain(edges: DataFrame) -> DataFrame:
    """File edges lifted to pairs of different domains: edges, distinct file pairs and
    the smallest citing file."""
    lifted = edges.where("source_domain <> target_domain").groupBy(F.col("source_domain").alias("from"), F.col("target_domain").alias("to"))
    return lifted.agg(F.count("*").alias("weight"), F.count_distinct("source", "target").alias("pairs"), F.min("source").alias("evidence"))


def layer_complexity(memberships: DataFrame, nodes: DataFrame, share: float = 0.3) -> DataFrame:
    """Complex if over ``share`` of the resolvable members are, else moderate, else simple."""
    d = memberships.join(nodes.select(F.col("id").alias("node_id"), "complexity"), "node_id").groupBy("layer")
    part = lambda c: F.sum(F.when(F.col("complexity") == c, 1).otherwise(0)) / F.count("*")
    out = d.agg(F.count("*").alias("members"), part("complex").alias("x"), part("moderate").alias("y"))
    return out.select("layer", "members", F.when(F.col("x") > share, "complex").when(F.col("y") > share, "moderate").otherwise("simple").alias("complexity"))


def group_cards(files: DataFrame, groups: DataFrame) -> DataFrame:
    """A10: files and lines per named group, with an "unclassified" rest and a grand total."""
    d = files.join(groups, "domain", "left").withColumn("grp", F.coalesce("grp", F.lit("unclassified")))
    return d.rollup("grp").agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).withColumn("grp", F.coalesce("grp", F.lit("total")))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """A12, A24."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def impact_sizes(up: DataFrame, down: DataFrame, files: DataFrame) -> DataFrame:
    """Upstream, downstream and total files per domain and language."""
    both = up.select("path", F.lit("up").alias("dir")).union(down.select("path", F.lit("down").alias("dir")))
    d = both.join(files.select("path", "domain", "lang"), "path", "left").withColumn("domain", F.coalesce("domain", F.lit("unclassified")))
    count = lambda c: F.sum(F.when(F.col("dir") == c, 1).otherwise(0)).alias(c)
    return d.groupBy("domain", "lang").agg(count("up"), count("down"), F.count_distinct("path").alias("total"))


def grounded_summary(claims: DataFrame) -> DataFrame:
    """Per domain and over all: claims, grounded ones and their percentage (100 if none)."""
    ok = F.sum(F.when(F.col("grounded"), 1).otherwise(0))
    d = claims.rollup("domain").agg(F.count("*").alias("claims"), ok.alias("ok"), F.grouping_id().alias("all"))
    pct = F.when(F.col("claims") == 0, 100.0).otherwise(half_up(F.col("ok") / F.col("claims") * 100, 1))
    return d.select(F.when(F.col("all") == 1, "*").otherwise(F.col("domain")).alias("domain"), "claims", "ok", pct.alias("pct"))


def evidence_rates(claims: DataFrame, limit: float = 0.6) -> DataFrame:
    """Confirmed and inferred shares of each document and the approval gate."""
    share = lambda c: half_up(F.avg(F.when(F.col("confidence") == c, 1.0).otherwise(0.0)), 4)
    d = claims.groupBy("doc").agg(share("CONFIRMED").alias("confirmed"), share("INFERRED").alias("inferred"))
    return d.withColumn("blocked", F.col("inferred") > limit)


def usage(events: DataFrame) -> DataFrame:
    """Value sums and counts by agent, by kind, and over all, in one pass."""
    return events.cube("entity", "event").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping_id().alias("g")).where("g > 0").select(F.coalesce("entity", F.lit("*")).alias("entity"), F.coalesce("event", F.lit("*")).alias("event"), "n", "total")


def interface_groups(signals: DataFrame) -> DataFrame:
    """Signals by direction, protocol and endpoint (an unresolved one by its call site);
    distinct sorted call sites and a hashed id."""
    key = F.coalesce("endpoint", F.concat(F.lit("@"), "site"))
    d = signals.groupBy("direction", "protocol", key.alias("key")).agg(F.array_join(F.array_sort(F.collect_set("site")), ",").alias("sites"), F.bool_and(F.col("endpoint").isNull()).alias("unresolved"))
    return d.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "direction", "protocol", "key"), 256), 1, 8))


def coverage(files: DataFrame, reached: DataFrame) -> DataFrame:
    """Files per language, and the share of them that is reached, one decimal."""
    hit = reached.select("path").distinct().withColumn("hit", F.lit(1))
    d = files.join(hit, "path", "left").groupBy("lang").agg(F.count("*").alias("files"), F.count("hit").alias("reached"))
    return d.withColumn("pct", F.when(F.col("files") == 0, 0.0).otherwise(half_up(F.col("reached") / F.col("files") * 100, 1)))


def language_support(files: DataFrame, matrix: DataFrame) -> DataFrame:
    """Files per language with its best capability tier; NULL where none is known."""
    best = matrix.groupBy("lang").agg(F.max("tier").alias("best"))
    return files.groupBy("lang").agg(F.count("*").alias("files")).join(best, "lang", "left").withColumn("support", F.when(F.col("best") >= 2, "full").when(F.col("best") == 1, "partial").otherwise("none"))


def function_points(routes: DataFrame) -> DataFrame:
    """Points by kind; reads are EQ, writes EI, the rest is not scored."""
    kind = F.when(F.col("method").isin("GET", "HEAD"), "EQ").when(F.col("method").isin("POST", "PUT", "PATCH", "DELETE"), "EI")
    weight = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])
    d = routes.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))
    return d.withColumn("points", half_up(F.col("n") * weight[F.col("kind")], 1))


def common_chrome(links: DataFrame, share: float = 0.25, least: int = 3) -> DataFrame:
    """Elements on at least max(least, ceil(share of the screens)) screens."""
    total = links.agg(F.greatest(F.lit(least), F.ceil(F.count_distinct("screen") * share)).alias("bound"))
    d = links.groupBy("element").agg(F.count_distinct("screen").alias("screens"))
    return d.join(F.broadcast(total)).where("screens >= bound").select("element", "screens")


def majority(votes: DataFrame) -> DataFrame:
    """Per screen the key with at least half of the votes; the smallest of equals."""
    d = votes.groupBy("screen", "key").agg(F.count("*").alias("n"))
    top = d.groupBy("screen").agg(F.max("n").alias("most"), F.sum("n").alias("total"))
    first = d.join(top, "screen").where("n = most").groupBy("screen", "total", "most").agg(F.min("key").alias("key"))
    return first.where("most * 2 >= total").select("screen", "key", F.col("most").alias("votes"))


def crud_matrix(accesses: DataFrame) -> DataFrame:
    """Flow x table with letters in CRUD order."""
    letters = F.array_join(F.array_intersect(F.array(*map(F.lit, "CRUD")), F.collect_set("letter")), "")
    return accesses.groupBy("flow", "tbl").agg(letters.alias("crud"))


def undirected(edges: DataFrame) -> DataFrame:
    """Domain pairs in both directions as one row, weights summed, directions kept."""
    d = edges.where("source_domain <> target_domain").select(F.least("source_domain", "target_domain").alias("a"), F.greatest("source_domain", "target_domain").alias("b"), F.when(F.col("source_domain") < F.col("target_domain"), "a>b").otherwise("b>a").alias("way"))
    return d.groupBy("a", "b").agg(F.count("*").alias("weight"), F.array_join(F.array_sort(F.collect_set("way")), ",").alias("ways"))


def bubble_marks(marks: DataFrame, owners: DataFrame) -> DataFrame:
    """The strongest mark of a domain's files; changed beats affected."""
    d = owners.join(marks, "path").groupBy("domain").agg(F.max(F.when(F.col("mark") == "changed", 2).otherwise(1)).alias("m"))
    return d.select("domain", F.when(F.col("m") == 2, "changed").otherwise("affected").alias("mark"))


def shared_files(owned: DataFrame) -> DataFrame:
    """Pairs of owners with common files, counted. The join is by file, so only pairs that
    share one meet."""
    a, b = owned.select(F.col("owner").alias("a"), "path").distinct(), owned.select(F.col("owner").alias("b"), "path").distinct()
    return a.join(b, "path").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"), F.min("path").alias("first"))


for _name, _by, _other in (("a1_fan_in", "target", "source"), ("a2_fan_out", "source", "target")):

    @query(_name, f"SELECT {_by} AS id, count(DISTINCT {_other}) AS fan FROM edges WHERE kind IN ('call', 'data') AND source <> target GROUP BY {_by}", ("edges",))
    def _fan(t: Tables, by: str = _by, other: str = _other) -> DataFrame:
        return fan(t.edges, by, other, ("call", "data"))


@query("a3_churn", "SELECT path, count(DISTINCT sha) AS commits, CAST(sum(added + deleted) AS BIGINT) AS lines FROM commits GROUP BY path", ("commits",))
def _a3(t: Tables) -> DataFrame:
    return churn(spread(t.commits, t.rows("lineitem"), "path", "sha"))


@query(
    "a4_work_totals",
    """SELECT count(DISTINCT sha) AS commits, count(DISTINCT sha) FILTER (WHERE is_merge) AS merges, count(DISTINCT author) AS authors, count(DISTINCT path) FILTER (WHERE path NOT LIKE '%/build/%') AS files,
  CAST(sum(CASE WHEN path NOT LIKE '%/build/%' THEN added + deleted ELSE 0 END) AS BIGINT) AS lines, CAST(sum(CASE WHEN path LIKE '%/build/%' THEN added + deleted ELSE 0 END) AS BIGINT) AS generated_lines FROM commits""",
    ("commits",),
)
def _a4(t: Tables) -> DataFrame:
    return work_totals(t.commits)


@query(
    "a5_module_rollup",
    """d AS (SELECT c.*, CASE WHEN f.seq % 11 = 0 THEN 'src' ELSE f.domain END AS domain FROM commits c JOIN files f USING (path)),
p AS (SELECT domain, path, sum(added + deleted) AS n, row_number() OVER (PARTITION BY domain ORDER BY sum(added + deleted) DESC, path) AS place FROM d GROUP BY domain, path),
b AS (SELECT domain, string_agg(path, ',' ORDER BY place) AS top_files FROM p WHERE place <= 3 GROUP BY domain)
SELECT domain, count(DISTINCT sha) AS commits, count(DISTINCT path) AS files, CAST(sum(added + deleted) AS BIGINT) AS lines, any_value(top_files) AS top_files FROM d JOIN b USING (domain) GROUP BY domain""",
    ("files", "commits"),
)
def _a5(t: Tables) -> DataFrame:
    return module_rollup(spread(t.commits, t.rows("lineitem"), "path", "sha"), t.files.where("seq % 11 <> 0"))


@query("a6_cross_domain", 'SELECT source_domain AS "from", target_domain AS "to", count(*) AS weight, count(DISTINCT (source, target)) AS pairs, min(source) AS evidence FROM file_edges WHERE source_domain <> target_domain GROUP BY ALL', ("file_edges",))
def _a6(t: Tables) -> DataFrame:
    return cross_domain(t.file_edges)


@query(
    "a8_layer_complexity",
    """d AS (SELECT layer, count(*) AS members, avg(CASE WHEN complexity = 'complex' THEN 1e0 ELSE 0e0 END) AS x, avg(CASE WHEN complexity = 'moderate' THEN 1e0 ELSE 0e0 END) AS y FROM memberships JOIN nodes ON id = node_id GROUP BY layer)
SELECT layer, members, CASE WHEN x > 0.3e0 THEN 'complex' WHEN y > 0.3e0 THEN 'moderate' ELSE 'simple' END AS complexity FROM d""",
    ("nodes", "memberships"),
)
def _a8(t: Tables) -> DataFrame:
    return layer_complexity(t.memberships, t.nodes)


@query(
    "a10_group_cards",
    """d AS (SELECT CASE WHEN domain < 'brand3' THEN 'low' WHEN domain < 'brand5' THEN 'mid' ELSE 'unclassified' END AS grp, loc FROM files)
SELECT grp, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM d GROUP BY grp UNION ALL SELECT 'total', count(*), CAST(sum(loc) AS BIGINT) FROM d""",
    ("files",),
)
def _a10(t: Tables) -> DataFrame:
    groups = t.files.select("domain").distinct().where("domain < 'brand5'").withColumn("grp", F.when(F.col("domain") < "brand3", "low").otherwise("mid"))
    return group_cards(t.files, groups)


@query("a12_frequency", "SELECT lang, count(*) AS n FROM files GROUP BY lang", ("files",))
def _a12(t: Tables) -> DataFrame:
    return frequency(t.files, "lang")


@query("a24_graph_statistics", "SELECT type AS what, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT kind, count(*) FROM edges GROUP BY kind", ("nodes", "edges"))
def _a24(t: Tables) -> DataFrame:
    return frequency(t.nodes, "type").union(frequency(t.edges, "kind")).toDF("what", "n")


@query(
    "a13_impact_sizes",
    """u AS (SELECT DISTINCT source AS path FROM file_edges WHERE target LIKE '%Item1%'), v AS (SELECT DISTINCT target AS path FROM file_edges WHERE source LIKE '%Item1%'),
b AS (SELECT path, 'up' AS dir FROM u UNION ALL SELECT path, 'down' FROM v)
SELECT domain, lang, count(*) FILTER (WHERE dir = 'up') AS up, count(*) FILTER (WHERE dir = 'down') AS down, count(DISTINCT path) AS total FROM b JOIN files USING (path) GROUP BY domain, lang""",
    ("files", "file_edges"),
)
def _a13(t: Tables) -> DataFrame:
    e = t.file_edges
    up = e.where("target like '%Item1%'").select(F.col("source").alias("path")).distinct()
    return impact_sizes(up, e.where("source like '%Item1%'").select(F.col("target").alias("path")).distinct(), t.files)


@query(
    "a14_grounded_summary",
    """c AS (SELECT domain, seq % 4 <> 0 AS grounded FROM files), d AS (SELECT coalesce(domain, '*') AS domain, count(*) AS claims, count(*) FILTER (WHERE grounded) AS ok FROM c GROUP BY ROLLUP (domain))
SELECT domain, claims, ok, floor(ok * 1e0 / claims * 100 * 10 + 0.5) / 10 AS pct FROM d""",
    ("files",),
)
def _a14(t: Tables) -> DataFrame:
    return grounded_summary(t.files.select("domain", (F.col("seq") % 4 != 0).alias("grounded")))


@query(
    "a15_evidence_rates",
    """c AS (SELECT domain AS doc, CASE WHEN loc % 3 = 0 THEN 'CONFIRMED' ELSE 'INFERRED' END AS confidence FROM files),
d AS (SELECT doc, floor(avg(CASE WHEN confidence = 'CONFIRMED' THEN 1e0 ELSE 0e0 END) * 10000 + 0.5) / 10000 AS confirmed, floor(avg(CASE WHEN confidence = 'INFERRED' THEN 1e0 ELSE 0e0 END) * 10000 + 0.5) / 10000 AS inferred FROM c GROUP BY doc)
SELECT *, inferred > 0.6e0 AS blocked FROM d""",
    ("files",),
)
def _a15(t: Tables) -> DataFrame:
    return evidence_rates(t.files.select(F.col("domain").alias("doc"), F.when(F.col("loc") % 3 == 0, "CONFIRMED").otherwise("INFERRED").alias("confidence")))


@query(
    "a16_usage",
    "SELECT coalesce(entity, '*') AS entity, coalesce(event, '*') AS event, count(*) AS n, round(sum(value), 4) AS total FROM ledger GROUP BY GROUPING SETS ((entity), (event), ())",
    ("ledger",),
)
def _a16(t: Tables) -> DataFrame:
    return usage(t.ledger)


@query(
    "a17_interface_groups",
    """s AS (SELECT CASE page_id % 2 WHEN 0 THEN 'in' ELSE 'out' END AS direction, split_part(url, ':', 1) AS protocol, CASE WHEN page_id % 5 > 0 THEN split_part(url, '/', 3) END AS endpoint, concat('f', page_id % 30) AS site FROM pages),
d AS (SELECT direction, protocol, coalesce(endpoint, concat('@', site)) AS key, string_agg(DISTINCT site, ',' ORDER BY site) AS sites, bool_and(endpoint IS NULL) AS unresolved FROM s GROUP BY 1, 2, 3)
SELECT *, substr(sha256(concat_ws('|', direction, protocol, key)), 1, 8) AS id FROM d""",
)
def _a17(t: Tables) -> DataFrame:
    n = F.col("page_id")
    return interface_groups(
        t.pages.select(F.when(n % 2 == 0, "in").otherwise("out").alias("direction"), F.split_part("url", F.lit(":"), F.lit(1)).alias("protocol"), F.when(n % 5 > 0, F.split_part("url", F.lit("/"), F.lit(3))).alias("endpoint"), F.concat(F.lit("f"), (n % 30).cast("string")).alias("site"))
    )


@query(
    "a18_coverage",
    """h AS (SELECT DISTINCT target AS path FROM file_edges WHERE kind = 'call')
SELECT lang, count(*) AS files, count(h.path) AS reached, floor(count(h.path) * 1e0 / count(*) * 100 * 10 + 0.5) / 10 AS pct FROM files LEFT JOIN h USING (path) GROUP BY lang""",
    ("files", "file_edges"),
)
def _a18(t: Tables) -> DataFrame:
    return coverage(t.files, t.file_edges.where("kind = 'call'").select(F.col("target").alias("path")))


@query("a19_language_support", "SELECT lang, count(*) AS files, CASE lang WHEN 'java' THEN 'full' WHEN 'python' THEN 'partial' ELSE 'none' END AS support FROM files GROUP BY lang", ("files",))
def _a19(t: Tables) -> DataFrame:
    matrix = t.files.where("lang in ('java', 'python')").select("lang", F.explode(F.when(F.col("lang") == "java", F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1)))).alias("tier")).distinct()
    return language_support(t.files, matrix).drop("best")


@query(
    "a21_function_points",
    """m AS (SELECT CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'ANY' ELSE 'DELETE' END AS method FROM pages),
k AS (SELECT CASE WHEN method IN ('GET', 'HEAD') THEN 'EQ' WHEN method IN ('POST', 'DELETE') THEN 'EI' END AS kind FROM m)
SELECT kind, count(*) AS n, floor(count(*) * CASE kind WHEN 'EQ' THEN 3.9e0 ELSE 4e0 END * 10 + 0.5) / 10 AS points FROM k WHERE kind IS NOT NULL GROUP BY kind""",
)
def _a21(t: Tables) -> DataFrame:
    n = F.col("page_id") % 4
    return function_points(t.pages.select(F.when(n == 0, "GET").when(n == 1, "POST").when(n == 2, "ANY").otherwise("DELETE").alias("method")))


@query(
    "a22_common_chrome",
    """l AS (SELECT DISTINCT path AS element, author AS screen FROM commits), b AS (SELECT greatest(3, ceil(count(DISTINCT screen) * 0.25e0)) AS bound FROM l)
SELECT element, count(DISTINCT screen) AS screens FROM l GROUP BY element HAVING count(DISTINCT screen) >= (SELECT bound FROM b)""",
    ("commits",),
)
def _a22(t: Tables) -> DataFrame:
    return common_chrome(t.commits.select(F.col("path").alias("element"), F.col("author").alias("screen")))


@query(
    "a23_majority",
    """v AS (SELECT concat(entity, '@', strftime(ts, '%Y-%m-%d')) AS screen, event AS key, count(*) AS n FROM ledger GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY screen) AS total, row_number() OVER (PARTITION BY screen ORDER BY n DESC, key) AS place FROM v)
SELECT screen, key, n AS votes FROM m WHERE place = 1 AND n * 2 >= total""",
    ("ledger",),
)
def _a23(t: Tables) -> DataFrame:
    screen = F.concat("entity", F.lit("@"), F.date_format("ts", "yyyy-MM-dd"))
    return majority(t.ledger.select(screen.alias("screen"), F.col("event").alias("key")))


@query(
    "a26_crud_matrix",
    """a AS (SELECT author AS flow, concat('t', sha % 9) AS tbl, CASE CAST(added AS BIGINT) % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'R' WHEN 2 THEN 'U' ELSE 'D' END AS letter FROM commits WHERE deleted < 3),
g AS (SELECT flow, tbl, bool_or(letter = 'C') AS c, bool_or(letter = 'R') AS r, bool_or(letter = 'U') AS u, bool_or(letter = 'D') AS d FROM a GROUP BY flow, tbl)
SELECT flow, tbl, concat(CASE WHEN c THEN 'C' END, CASE WHEN r THEN 'R' END, CASE WHEN u THEN 'U' END, CASE WHEN d THEN 'D' END) AS crud FROM g""",
    ("commits",),
)
def _a26(t: Tables) -> DataFrame:
    n = F.col("added") % 4
    return crud_matrix(t.commits.where("deleted < 3").select(F.col("author").alias("flow"), F.concat(F.lit("t"), (F.col("sha") % 9).cast("string")).alias("tbl"), F.when(n == 0, "C").when(n == 1, "R").when(n == 2, "U").otherwise("D").alias("letter")))


@query(
    "a30_undirected",
    """SELECT least(source_domain, target_domain) AS a, greatest(source_domain, target_domain) AS b, count(*) AS weight, string_agg(DISTINCT CASE WHEN source_domain < target_domain THEN 'a>b' ELSE 'b>a' END, ',' ORDER BY CASE WHEN source_domain < target_domain THEN 'a>b' ELSE 'b>a' END) AS ways
FROM file_edges WHERE source_domain <> target_domain GROUP BY 1, 2""",
    ("file_edges",),
)
def _a30(t: Tables) -> DataFrame:
    return undirected(t.file_edges)


@query(
    "a31_bubble_marks",
    "SELECT domain, CASE WHEN bool_or(seq % 37 = 0) THEN 'changed' ELSE 'affected' END AS mark FROM files WHERE seq % 37 = 0 OR seq % 5 = 0 GROUP BY domain",
    ("files",),
)
def _a31(t: Tables) -> DataFrame:
    marks = t.files.where("seq % 37 = 0 or seq % 5 = 0").select("path", F.when(F.col("seq") % 37 == 0, "changed").otherwise("affected").alias("mark"))
    return bubble_marks(marks, t.files.select("path", "domain"))


@query(
    "a32_shared_files",
    "o AS (SELECT DISTINCT author AS owner, path FROM commits WHERE deleted < 2) SELECT x.owner AS a, y.owner AS b, count(*) AS weight, min(x.path) AS first FROM o x JOIN o y ON x.path = y.path AND x.owner < y.owner GROUP BY 1, 2",
    ("commits",),
)
def _a32(t: Tables) -> DataFrame:
    return shared_files(t.commits.where("deleted < 2").select(F.col("author").alias("owner"), "path"))
