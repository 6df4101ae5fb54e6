"""Requirement matrix of flows (C6) and communities with levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.functions import text as fn
from factloom.operators.windows import chunks
from factloom.plans.ranges import number_rows
from factloom.plans.shared import discard, materialize
from factloom.registry import query


def requirement_matrix(flows: DataFrame, steps: DataFrame, routes: DataFrame, data: DataFrame, tests: DataFrame) -> DataFrame:
    """One row for each flow, numbered ``FN-001`` on by domain (none last), then flow, with four cells and
    how sure each is.

    * entry: the first route, by ``seq``, of the flow's handler as method and path, else the handler;
    * implementation: the classes of the flow's file and of its steps;
    * data: tables with letters in the order CRUD, from mappers (tier 1) if the project has any, else
      from raw SQL (tier 2); where that gives none, from the ORM (tier 3);
    * test: test classes of these classes; if any is linked by naming, only those.

    ``flows(flow, domain, path, entry)``, ``steps(flow, path)``, ``routes(seq, handler, method, path)``, ``data(tier, flow,
    tbl, letter)``, ``tests(prod, test_file, test, line, convention)``."""
    c = F.col
    first = routes.where("handler <> ''").groupBy(c("handler").alias("entry")).agg(F.min_by(F.concat("method", F.lit(" "), "path"), "seq").alias("route"))
    files = flows.select("flow", "path").union(steps.select("flow", "path")).where("path is not null").select("flow", fn.stem(c("path")).alias("name")).distinct()
    files = materialize(files, "classes")
    impl = files.groupBy("flow").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("implementation"))

    mapped = data.agg(F.coalesce(F.bool_or(c("tier") == 1), F.lit(False)).alias("mapped"))
    used = data.join(F.broadcast(mapped)).where((c("tier") == 3) | (c("tier") == F.when(c("mapped"), 1).otherwise(2)))
    best = used.groupBy("flow").agg(F.min("tier").alias("tier"))
    letters = F.array_join(F.array_intersect(F.array(*map(F.lit, "CRUD")), F.collect_set("letter")), "")
    cells = used.join(best, ["flow", "tier"]).groupBy("flow", "tbl").agg(F.concat("tbl", F.lit("("), letters, F.lit(")")).alias("cell"))
    tables = cells.groupBy("flow").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tbl", "cell"))), lambda x: x["cell"]), " · ").alias("data"))

    linked = files.join(tests.withColumnRenamed("prod", "name"), "name").groupBy("flow", "test_file").agg(F.bool_or("convention").alias("convention"), F.min_by("test", F.struct(~c("convention"), "line")).alias("test"))
    linked = linked.groupBy("flow").agg(F.bool_or("convention").alias("named"), F.collect_set(F.struct("convention", "test")).alias("all"))
    chosen = F.filter("all", lambda x: x["convention"] | ~c("named"))
    linked = linked.select("flow", "named", F.array_join(F.array_sort(F.array_distinct(F.transform(chosen, lambda x: x["test"]))), ", ").alias("test"))

    d = flows.select("flow", "domain", "path", "entry").join(first, "entry", "left").join(impl, "flow", "left").join(tables, "flow", "left").join(linked, "flow", "left")
    sure = lambda ok: F.when(ok, "CONFIRMED").otherwise("INFERRED")
    has_entry = c("entry").isNotNull() & (c("entry") != "")
    d = d.select(
        "flow",
        "domain",
        F.when(has_entry, F.coalesce("route", "entry")).otherwise("").alias("entry"),
        sure(has_entry & (c("route").isNotNull() | c("path").isNotNull())).alias("entry_is"),
        F.coalesce("implementation", F.lit("")).alias("implementation"),
        F.when(c("implementation").isNotNull(), "IMPLEMENTED").otherwise("PLANNED").alias("state"),
        F.coalesce("data", F.lit("")).alias("data"),
        sure(c("data").isNotNull()).alias("data_is"),
        F.coalesce("test", F.lit("")).alias("test"),
        F.when(c("test").isNull(), "UNVERIFIED").otherwise(sure(c("named"))).alias("test_is"),
    )
    numbered = number_rows(d, [c("domain").isNull(), "domain", "flow"], "place")
    return numbered.withColumn("feature", F.concat(F.lit("FN-"), F.lpad(c("place").cast("string"), F.greatest(F.lit(3), F.length(c("place").cast("string"))), F.lit("0")))).drop("place")


def _moves(both: DataFrame, rounds: int) -> DataFrame:
    """One level: ``both(id, other, w)``, each edge in both directions and loops once with twice their
    weight -> ``(id, community)``."""
    total = both.agg(F.sum("w")).first()[0] or 1.0
    degree = both.groupBy("id").agg(F.sum("w").alias("k"))
    between = materialize(both.where("id <> other"), "between")
    table = materialize(degree.select("id", "k", F.col("id").alias("community"), F.lit(False).alias("moved")), "labels")
    for r in range(rounds):
        busy = False
        for half in (0, 1):  # so that two neighbours do not just change places; the halves change
            label = table.drop("moved")
            mass = label.groupBy(F.col("community").alias("to")).agg(F.sum("k").alias("mass"))
            links = between.join(label.select(F.col("id").alias("other"), F.col("community").alias("to")), "other").groupBy("id", "to").agg(F.sum("w").alias("links"))
            turn = label.where(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == half)
            stay = turn.select("id", F.col("community").alias("to"), F.lit(0.0).alias("links"))
            options = links.union(stay).groupBy("id", "to").agg(F.sum("links").alias("links")).join(turn, "id").join(mass, "to")
            others = F.col("mass") - F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("links") - F.col("k") * others / F.lit(float(total)), 9)
            # of equal gains the own community, then the least
            best = options.groupBy("id").agg(F.min_by("to", F.struct(-gain, F.col("to") != F.col("community"), "to")).alias("to"))
            moved = label.join(best, "id", "left").select("id", "k", F.coalesce("to", "community").alias("community"), (F.coalesce("to", "community") != F.col("community")).alias("moved"))
            last, table = table, materialize(moved, "labels")
            discard(last)
            busy |= not table.where("moved").isEmpty()
        if not busy:
            break
    return table.select("id", "community")


def community_levels(edges: DataFrame, levels: int = 10, rounds: int = 8) -> DataFrame:
    """``edges(source, target)``, taken undirected and once each -> ``(id, community)``: modularity moves until
    nobody moves, then the same among the communities as nodes, with the weights between them, until
    a level joins nothing. A community is named by its least member. Isolated nodes have no row."""
    pairs = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()
    pairs = materialize(pairs.withColumn("w", F.lit(1.0)), "pairs")
    label = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("community", F.col("id")), "members")
    for _ in range(levels):
        both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w")).alias("w"))
        both = materialize(both.union(pairs.where("a <> b").select("b", "a", "w")), "level")
        found = _moves(both, rounds)
        if found.where("id <> community").isEmpty():
            break
        name = found.groupBy("community").agg(F.min("id").alias("least"))
        found = materialize(found.join(name, "community").select("id", F.col("least").alias("to")), "joined")
        last, label = label, materialize(label.join(found.withColumnRenamed("id", "community"), "community").select("id", F.col("to").alias("community")), "members")
        discard(last)
        ends = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b")
        last, pairs = pairs, materialize(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")), "pairs")
        discard(last)
    least = label.groupBy("community").agg(F.min("id").alias("least"))
    return label.join(least, "community").select("id", F.col("least").alias("community"))


_FLOWS = """fl AS (SELECT concat('flow:', seq) AS flow, CASE WHEN seq % 6 > 0 THEN domain END AS domain, CASE WHEN seq % 9 > 0 THEN path END AS path, CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('h', seq % 30) ELSE concat('x', seq) END AS entry, seq FROM files WHERE path LIKE '%/controller/%' OR path LIKE '%/service/%'),
st AS (SELECT concat('flow:', a.seq) AS flow, b.path FROM files a JOIN files b ON b.seq = a.seq + 1 OR b.seq = a.seq + 3 WHERE a.seq % 5 > 1), ro AS (SELECT page_id AS seq, concat('h', page_id % 50) AS handler, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, url AS path FROM pages),
da AS (SELECT l_linenumber % 3 + 1 AS tier, concat('flow:', l_partkey) AS flow, concat('T', l_suppkey % 7) AS tbl, CASE l_orderkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'R' WHEN 2 THEN 'U' ELSE 'D' END AS letter FROM lineitem WHERE l_partkey % 3 > 0 AND NOT (l_partkey % 5 = 0 AND l_linenumber % 3 = 0)),
te AS (SELECT regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS prod, concat('test/', seq % 400, '.java') AS test_file, concat('Test', seq % 400) AS test, loc AS line, seq % 8 = 3 AS convention FROM files WHERE seq % 3 > 0)"""


@query(
    "c6_requirement_matrix",
    f"""{_FLOWS}, fr AS (SELECT handler AS entry, arg_min(concat(method, ' ', path), seq) AS route FROM ro GROUP BY handler),
fi AS (SELECT DISTINCT flow, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS name FROM (SELECT flow, path FROM fl UNION ALL SELECT flow, path FROM st) WHERE path IS NOT NULL), im AS (SELECT flow, string_agg(name, ', ' ORDER BY name) AS implementation FROM fi GROUP BY flow),
us AS (SELECT * FROM da WHERE tier = 3 OR tier = 1), be AS (SELECT flow, min(tier) AS tier FROM us GROUP BY flow), ce AS (SELECT flow, tbl, list_distinct(list(letter)) AS l FROM us JOIN be USING (flow, tier) GROUP BY flow, tbl),
dt AS (SELECT flow, string_agg(concat(tbl, '(', CASE WHEN list_contains(l, 'C') THEN 'C' END, CASE WHEN list_contains(l, 'R') THEN 'R' END, CASE WHEN list_contains(l, 'U') THEN 'U' END, CASE WHEN list_contains(l, 'D') THEN 'D' END, ')'), ' · ' ORDER BY tbl) AS data FROM ce GROUP BY flow),
tf AS (SELECT flow, test_file, bool_or(convention) AS convention, arg_min(test, (NOT convention, line)) AS test FROM fi JOIN te ON prod = name GROUP BY flow, test_file), tn AS (SELECT flow, bool_or(convention) AS named FROM tf GROUP BY flow),
tt AS (SELECT flow, any_value(named) AS named, string_agg(DISTINCT test, ', ' ORDER BY test) AS test FROM tf JOIN tn USING (flow) WHERE convention OR NOT named GROUP BY flow)
SELECT fl.flow, domain, CASE WHEN fl.entry IS NULL THEN '' ELSE coalesce(route, fl.entry) END AS entry, CASE WHEN fl.entry IS NOT NULL AND (route IS NOT NULL OR path IS NOT NULL) THEN 'CONFIRMED' ELSE 'INFERRED' END AS entry_is, coalesce(implementation, '') AS implementation, CASE WHEN implementation IS NULL THEN 'PLANNED' ELSE 'IMPLEMENTED' END AS state,
  coalesce(data, '') AS data, CASE WHEN data IS NULL THEN 'INFERRED' ELSE 'CONFIRMED' END AS data_is, coalesce(test, '') AS test, CASE WHEN test IS NULL THEN 'UNVERIFIED' WHEN named THEN 'CONFIRMED' ELSE 'INFERRED' END AS test_is, concat('FN-', CASE WHEN place < 1000 THEN lpad(CAST(place AS VARCHAR), 3, '0') ELSE CAST(place AS VARCHAR) END) AS feature
FROM (SELECT *, row_number() OVER (ORDER BY domain IS NULL, domain, flow) AS place FROM fl) fl LEFT JOIN fr USING (entry) LEFT JOIN im ON im.flow = fl.flow LEFT JOIN dt ON dt.flow = fl.flow LEFT JOIN tt ON tt.flow = fl.flow""",
    ("files",),
)
def _c6(t: Tables) -> DataFrame:
    s, text = F.col("seq"), lambda c: c.cast("string")
    roots = t.files.where("path like '%/controller/%' or path like '%/service/%'")
    flow = F.concat(F.lit("flow:"), text(s))
    flows = roots.select(flow.alias("flow"), F.when(s % 6 > 0, F.col("domain")).alias("domain"), F.when(s % 9 > 0, F.col("path")).alias("path"), F.when(s % 4 == 0, None).when(s % 4 == 1, F.concat(F.lit("h"), text(s % 30))).otherwise(F.concat(F.lit("x"), text(s))).alias("entry"))
    next_ = t.files.where("seq % 5 > 1").select(flow.alias("flow"), F.explode(F.array(s + 1, s + 3)).alias("to"))
    steps = next_.join(t.files.select(s.alias("to"), "path"), "to").select("flow", "path")
    n, line = F.col("page_id"), F.col("l_linenumber") % 3 + 1
    routes = t.pages.select(n.alias("seq"), F.concat(F.lit("h"), text(n % 50)).alias("handler"), F.when(n % 2 == 0, "GET").otherwise("POST").alias("method"), F.col("url").alias("path"))
    data = t.lineitem.where("l_partkey % 3 > 0 and not (l_partkey % 5 = 0 and l_linenumber % 3 = 0)").select(line.alias("tier"), F.concat(F.lit("flow:"), text(F.col("l_partkey"))).alias("flow"), F.concat(F.lit("T"), text(F.col("l_suppkey") % 7)).alias("tbl"), F.element_at(F.array(*map(F.lit, "CRUD")), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("letter"))
    tests = t.files.where("seq % 3 > 0").select(fn.stem(F.col("path")).alias("prod"), F.concat(F.lit("test/"), text(s % 400), F.lit(".java")).alias("test_file"), F.concat(F.lit("Test"), text(s % 400)).alias("test"), F.col("loc").alias("line"), (s % 8 == 3).alias("convention"))
    return requirement_matrix(flows, steps, routes, data, tests)


@query(
    "g10_levels",
    """b AS (SELECT path, seq // 6 AS g FROM files) SELECT path AS id, min(path) OVER (PARTITION BY g) AS community, 0 AS part FROM b WHERE g IN (SELECT g FROM b GROUP BY g HAVING count(*) > 1)""",
    ("files",),
)
def _g10(t: Tables) -> DataFrame:
    """Groups of six files that all import each other, given in one direction and some twice."""
    f = t.files.select("path", "seq", F.floor(F.col("seq") / 6).alias("g"))
    other = f.select(F.col("path").alias("target"), F.col("seq").alias("to"), "g")
    edges = f.join(other, "g").where("seq < to").select(F.col("path").alias("source"), "target")
    both = edges.union(edges.select("target", "source"))
    return chunks(community_levels(both), "community", ["id"], 35).select("id", "community", F.col("chunk").cast("int").alias("part"))
