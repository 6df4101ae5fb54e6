"""Resolution of views and handlers, graph merges, table loads, annotation numbers, URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.functions import text as fn
from factloom.operators.graph import key_component
from factloom.operators.joins import suffix_index
from factloom.plans.shared import left_join, materialize, shuffled
from factloom.registry import query

# What is too small to annotate, the height of a row, the rows of a table that are kept.
SMALLEST, BAND, ROW_CAP = 4, 8, 50


def resolve_views(names: DataFrame, configs: DataFrame, files: DataFrame) -> DataFrame:
    """``names(owner, view)`` (all views that an owner may show) and ``configs(place, root, prefix,
    suffix)`` -> ``(owner, path, status)``. A view is the first of root/prefix/view+suffix, in order of the
    configurations, that is in ``files(path)``; names with a colon are none. An owner whose views come
    to one file is ``filled``, to several ``ambiguous`` (no path), to none ``unresolved``."""
    strip = lambda c: F.regexp_replace(c, "^/|/$", "")
    views = names.select("owner", "view").distinct()
    plain = views.where((F.col("view") != "") & ~F.contains("view", F.lit(":")))
    # configurations are few and read whole: each name meets each once
    table = configs.agg(F.array_sort(F.collect_list(F.struct("place", "root", strip("prefix").alias("prefix"), "suffix"))).alias("configs"))
    path = lambda c: F.array_join(F.filter(F.array(strip(c["root"]), c["prefix"], F.concat(F.regexp_replace("view", "^/", ""), c["suffix"])), lambda s: s != ""), "/")
    tried = plain.join(F.broadcast(table)).select("owner", "view", F.posexplode(F.transform("configs", path)).alias("place", "path"))
    hits = tried.join(files.select("path").distinct(), "path").groupBy("owner", "view").agg(F.min_by("path", "place").alias("path"))
    found = hits.groupBy("owner").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    d = views.select("owner").distinct().join(found, "owner", "left")
    status = F.when(F.col("n") == 1, "filled").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return d.select("owner", F.when(F.col("n") == 1, F.col("path")).alias("path"), status.alias("status"))


def resolve_handlers(entries: DataFrame, beans: DataFrame, files: DataFrame) -> DataFrame:
    """``entries(entry, handler)`` with ``bean#method`` handlers and ``beans(bean, class, target, job)`` ->
    ``(entry, class, path)``. A bean that invokes a method stands for its target's class, one that is a job
    detail for its job's; the class is the one file with its whole name as path suffix, else the one
    with its simple name, else null."""
    wanted = entries.select("entry", F.split("handler", "#")[0].alias("bean"))
    d = left_join(wanted, "bean", beans.select(F.col("bean").alias("its"), "class", "target", "job"), "its")
    d = left_join(d, "target", beans.select(F.col("bean").alias("its"), F.col("class").alias("target_class")), "its")
    kind = F.when(F.col("class").rlike("MethodInvokingJobDetailFactoryBean$"), F.col("target_class")).when(F.col("class").rlike("JobDetail(FactoryBean|Bean)$"), F.col("job")).otherwise(F.col("class"))
    d = materialize(d.select("entry", kind.alias("class")), "handlers")
    d = d.select("entry", "class", F.replace("class", F.lit("."), F.lit("/")).alias("whole"), F.substring_index("class", ".", -1).alias("simple"))
    # only suffixes that a class asks for are counted
    asked = d.select(F.explode(F.array("whole", "simple")).alias("suffix")).distinct()
    one = suffix_index(files).join(shuffled(asked), "suffix", "left_semi").groupBy("suffix").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")
    one = materialize(one, "suffixes")
    d = left_join(d, "whole", one.toDF("suffix", "p1"), "suffix")
    d = left_join(d, "simple", one.toDF("suffix", "p2"), "suffix")
    return d.select("entry", "class", F.coalesce("p1", "p2").alias("path"))


def merge_parts(nodes: DataFrame, edges: DataFrame, layers: DataFrame, tour: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parts of a graph, each row with its ``part`` and its place ``seq`` in it, made one: nodes keep the
    last row of an id, edges the greatest weight of a key (the first of equals), layers and tour
    steps the union of their nodes, steps of one title the longest description (the first of
    equals) and a new order. References to nodes that are not there go. Also a report of counts.

    ``nodes(part, seq, id, type, ...)``, ``edges(part, seq, source, target, type, weight)``, ``layers(part, seq,
    layer, node_id)``, ``tour(part, seq, title, description, node_id)``."""
    at = F.struct("part", "seq")
    n = nodes.where("id is not null and id <> ''").withColumn("at", at)
    last = n.groupBy("id").agg(F.max_by(F.struct(*[c for c in nodes.columns if c != "id"]), "at").alias("x")).select("id", "x.*")
    last = materialize(last.drop("part", "seq"), "merged_nodes")
    ids = last.select("id")
    heavy = F.struct(F.coalesce("weight", F.lit(0.0)).alias("w"), (-F.col("part")).alias("p"), (-F.col("seq")).alias("s"))
    keyed = materialize(edges.groupBy("source", "target", "type").agg(F.max_by("weight", heavy).alias("weight")), "merged_edges")
    kept = keyed.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi").select("source", "target", "type", "weight")
    union = lambda d, *keys: d.groupBy(*keys, "node_id").agg(F.min(at).alias("first"))
    in_layers = union(layers, "layer")
    out_layers = in_layers.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select("layer", "node_id")
    steps = tour.groupBy("title").agg(F.min(at).alias("first"), F.max_by("description", F.struct(F.char_length("description"), (-F.col("part")).alias("p"), (-F.col("seq")).alias("s"))).alias("description"))
    in_tour = union(tour, "title").where("node_id is not null")
    out_tour = in_tour.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
    # titles are few: people make them
    ordered = steps.withColumn("place", F.row_number().over(Window.orderBy("first")))
    out_tour = ordered.select("place", "title", "description").join(out_tour.select("title", "node_id"), "title", "left")
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    report = count(nodes, "nodes-in").union(count(last, "nodes-out")).union(count(nodes.where("id is null or id = ''"), "nodes-without-id")).union(count(edges, "edges-in"))
    report = report.union(count(keyed, "edges-merged")).union(count(kept, "edges-out")).union(count(in_layers.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_anti"), "layer-refs-dropped")).union(count(in_tour.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_anti"), "tour-refs-dropped"))
    return last, kept, out_layers, out_tour, report


def load_rows(tables: DataFrame, inserts: DataFrame, cap: int = ROW_CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``tables(tbl, columns)`` and ``inserts(seq, tbl, columns, values)`` (columns null: all of the table's)
    -> tables, with those that only inserts name added from their first one, and how many rows each
    has; the first ``cap`` rows of each as ``(tbl, seq, values)`` maps; and ``(tbl)`` that were added."""
    key = F.lower("tbl")
    known = tables.groupBy(key.alias("key")).agg(F.min(F.struct("tbl", "columns")).alias("t")).select("key", "t.tbl", "t.columns")
    ins = inserts.select("seq", key.alias("key"), F.col("tbl").alias("named"), F.col("columns").alias("own"), "values")
    made = ins.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by(F.struct("named", "own", "values"), "seq").alias("x"))
    names = F.coalesce(F.col("x.own"), F.transform(F.sequence(F.lit(0), F.size("x.values") - 1), lambda i: F.concat(F.lit("col"), i.cast("string"))))
    made = made.select("key", F.col("x.named").alias("tbl"), names.alias("columns"))
    all_ = materialize(known.withColumn("origin", F.lit("ddl")).unionByName(made.withColumn("origin", F.lit("data"))), "tables")
    counts = ins.groupBy("key").agg(F.count("*").alias("rows"))
    out = all_.join(counts, "key", "left").select("tbl", "columns", "origin", F.coalesce("rows", F.lit(0)).alias("rows"))
    first = ins.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).where(F.col("k") <= cap)
    heads = F.coalesce("own", "columns")
    # a value behind the last column has a name by its place
    label = F.transform("values", lambda v, i: F.coalesce(F.get(heads, i), F.concat(F.lit("col"), i.cast("string"))))
    rows = first.join(all_.select("key", "tbl", "columns"), "key").select("tbl", "seq", F.map_from_entries(F.array_distinct(F.zip_with(label, "values", lambda a, b: F.struct(a, b)))).alias("values"))
    return out, rows, made.select("tbl")


def number_annotations(elements: DataFrame) -> DataFrame:
    """``elements(screen, seq, kind, selector, x, y, width, height, visible, disabled)`` -> ``(screen, selector,
    kind, no)``. Elements without a kind, invisible, disabled, smaller than four pixels either way, and
    all but the first of a selector are left out; fields and regions are counted together, actions and
    links each by themselves, in order of eight-pixel rows, then x, then selector."""
    fit = F.col("visible") & ~F.col("disabled") & (F.col("width") >= SMALLEST) & (F.col("height") >= SMALLEST) & F.col("kind").isNotNull()
    first = elements.where(fit).groupBy("screen", "selector").agg(F.min_by(F.struct("kind", "x", "y"), "seq").alias("e")).select("screen", "selector", "e.*")
    counter = F.when(F.col("kind").isin("field", "region"), "field").otherwise(F.col("kind"))
    # halves go up
    place = Window.partitionBy("screen", "counter").orderBy(F.floor(F.col("y") / BAND + 0.5), "x", "selector")
    return first.withColumn("counter", counter).select("screen", "selector", "kind", F.row_number().over(place).alias("no"))


def same_site(url: Column, base: str) -> Column:
    """``url``, absolute or from the root, without fragment and session id if it is of the base's scheme,
    host and port; else null."""
    root = F.regexp_extract(F.lit(base), r"^(https?://[^/?#]+)", 1)
    whole = F.when(url.startswith("/") & ~url.startswith("//"), F.concat(root, url)).otherwise(url)
    bare = F.regexp_replace(F.regexp_replace(whole, "#.*$", ""), r"(?i);jsessionid=[^/?#]*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"([?&])jsessionid=[^&]*(&|$)", "$1"), r"[?&]$", "")
    origin = F.regexp_extract(bare, r"^(https?://[^/?#]+)", 1)
    return F.when((origin != "") & (F.lower(origin) == F.lower(root)), bare)


def site_path(url: Column, context: str | None = None) -> Column:
    """A URL's path without the context path and the leading slash."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    if context and context.rstrip("/"):
        c = context.rstrip("/")
        path = F.when((path == c) | path.startswith(f"{c}/"), F.substring(path, len(c) + 1, 1 << 30)).otherwise(path)
    return F.regexp_replace(path, "^/", "")


def screen_id(url: Column, context: str | None = None) -> Column:
    """``screen:`` with the path and the sorted distinct names of the query."""
    path, keys = site_path(url, context), fn.query_keys(url)
    rel = F.when(path == "", "(root)").otherwise(path)
    return F.when(F.size(keys) > 0, F.concat(F.lit("screen:"), rel, F.lit("__"), F.array_join(keys, "_"))).otherwise(F.concat(F.lit("screen:"), rel))


@query(
    "j12_views",
    """cf AS (SELECT * FROM (VALUES (1, 'app/src/main/webapp', '/WEB-INF/jsp/', '.jsp'), (2, 'app/src/main/webapp/', '/WEB-INF/jsp/brand1/', '.jsp'), (3, '', 'tools', '')) c(place, root, prefix, suffix)),
nm AS (SELECT CONCAT('o', seq % 61) AS owner, CASE seq % 4 WHEN 0 THEN replace(replace(path, 'app/src/main/webapp/WEB-INF/jsp/', '/'), '.jsp', '') WHEN 1 THEN 'redirect:/home' WHEN 2 THEN replace(path, 'tools/', '') ELSE replace(regexp_extract(path, '[^/]*$'), '.jsp', '') END AS view FROM legacy_files),
tr AS (SELECT owner, view, place, CASE place WHEN 1 THEN concat('app/src/main/webapp/WEB-INF/jsp/', ltrim(view, '/'), '.jsp') WHEN 2 THEN concat('app/src/main/webapp/WEB-INF/jsp/brand1/', ltrim(view, '/'), '.jsp') ELSE concat('tools/', ltrim(view, '/')) END AS path FROM (SELECT DISTINCT owner, view FROM nm) x, cf WHERE NOT contains(view, ':')),
hi AS (SELECT owner, view, arg_min(path, place) AS path FROM tr WHERE path IN (SELECT path FROM legacy_files) GROUP BY owner, view), ou AS (SELECT owner, count(DISTINCT path) AS n, min(path) AS path FROM hi GROUP BY owner)
SELECT owner, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n = 1 THEN 'filled' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM (SELECT DISTINCT owner FROM nm) LEFT JOIN ou USING (owner)""",
    ("legacy_files",),
)
def _j12(t: Tables) -> DataFrame:
    s, p = F.col("seq"), F.col("path")
    view = F.when(s % 4 == 0, F.replace(F.replace(p, F.lit("app/src/main/webapp/WEB-INF/jsp/"), F.lit("/")), F.lit(".jsp"), F.lit(""))).when(s % 4 == 1, "redirect:/home").when(s % 4 == 2, F.replace(p, F.lit("tools/"), F.lit(""))).otherwise(F.replace(F.substring_index(p, "/", -1), F.lit(".jsp"), F.lit("")))
    configs = t.spark.createDataFrame([(1, "app/src/main/webapp", "/WEB-INF/jsp/", ".jsp"), (2, "app/src/main/webapp/", "/WEB-INF/jsp/brand1/", ".jsp"), (3, "", "tools", "")], "place int, root string, prefix string, suffix string")
    return resolve_views(t.legacy_files.select(F.concat(F.lit("o"), (s % 61).cast("string")).alias("owner"), view.alias("view")), configs, t.legacy_files)


@query(
    "j33_bean_handlers",
    r"""be AS (SELECT concat('b', seq) AS bean, CASE seq % 6 WHEN 0 THEN 'org.job.MethodInvokingJobDetailFactoryBean' WHEN 1 THEN 'org.job.JobDetailBean' ELSE c END AS class, CASE WHEN seq % 12 = 0 THEN concat('b', seq + 2) WHEN seq % 6 = 0 THEN 'lost' END AS target, c AS job FROM (SELECT *, replace(CASE WHEN seq % 4 = 0 THEN concat('other.', n) ELSE regexp_replace(path, '\.[^./]*$', '') END, '/', '.') AS c FROM (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS n FROM legacy_files))),
en AS (SELECT concat('e', seq) AS entry, concat('b', seq + CASE WHEN seq % 17 = 0 THEN 10000000 ELSE 0 END) AS bean FROM legacy_files),
k AS (SELECT entry, CASE WHEN b.class LIKE '%MethodInvokingJobDetailFactoryBean' THEN x.class WHEN b.class LIKE '%JobDetailBean' THEN b.job ELSE b.class END AS class FROM en LEFT JOIN be b USING (bean) LEFT JOIN be x ON x.bean = b.target),
su AS (SELECT suffix, min(path) AS path FROM (SELECT path, array_to_string(p[i:], '/') AS suffix FROM (SELECT path, string_split(regexp_replace(path, '\.[^./]*$', ''), '/') AS p FROM legacy_files), range(1, 12) r(i) WHERE i <= len(p)) GROUP BY suffix HAVING count(*) = 1)
SELECT entry, class, coalesce(a.path, b.path) AS path FROM k LEFT JOIN su a ON a.suffix = replace(class, '.', '/') LEFT JOIN su b ON b.suffix = regexp_extract(class, '[^.]*$')""",
    ("legacy_files",),
)
def _j33(t: Tables) -> DataFrame:
    s, text = F.col("seq"), lambda c: c.cast("string")
    real = F.replace(F.when(s % 4 == 0, F.concat(F.lit("other."), fn.stem(F.col("path")))).otherwise(F.regexp_replace("path", r"\.[^./]*$", "")), F.lit("/"), F.lit("."))
    kind = F.when(s % 6 == 0, "org.job.MethodInvokingJobDetailFactoryBean").when(s % 6 == 1, "org.job.JobDetailBean").otherwise(real)
    target = F.when(s % 12 == 0, F.concat(F.lit("b"), text(s + 2))).when(s % 6 == 0, "lost")
    beans = t.legacy_files.select(F.concat(F.lit("b"), text(s)).alias("bean"), kind.alias("class"), target.alias("target"), real.alias("job"))
    entries = t.legacy_files.select(F.concat(F.lit("e"), text(s)).alias("entry"), F.concat(F.lit("b"), text(s + F.when(s % 17 == 0, 10000000).otherwise(0)), F.lit("#run")).alias("handler"))
    return resolve_handlers(entries, beans, t.legacy_files)


_PARTS = """nd AS (SELECT seq % 3 AS part, seq, CASE WHEN seq % 31 > 0 THEN id ELSE '' END AS id, lower(type) AS type, name FROM raw_nodes), ed AS (SELECT seq % 4 AS part, seq, source, target, lower(type) AS type, TRY_CAST(weight AS DOUBLE) AS weight FROM raw_edges),
la AS (SELECT pos % 3 AS part, pos AS seq, layer, replace(node_id, 'part:', 'file:') AS node_id FROM memberships), tu AS (SELECT page_id % 3 AS part, page_id AS seq, concat('Step ', page_id % 12) AS title, repeat('x', CAST(page_id * 7 % 23 AS INT)) AS description, concat('file:', page_id * 2) AS node_id FROM pages),
mn AS (SELECT id, arg_max(type, (part, seq)) AS type, arg_max(name, (part, seq)) AS name FROM nd WHERE id <> '' GROUP BY id), me AS (SELECT source, target, type, arg_max({'w': weight}, (coalesce(weight, 0), -part, -seq)).w AS weight FROM ed GROUP BY source, target, type),
ke AS (SELECT * FROM me WHERE source IN (SELECT id FROM mn) AND target IN (SELECT id FROM mn))"""


def _parts(t: Tables):
    s, n = F.col("seq"), F.col("page_id")
    nodes = t.raw_nodes.select((s % 3).alias("part"), "seq", F.when(s % 31 > 0, F.col("id")).otherwise("").alias("id"), F.lower("type").alias("type"), "name")
    edges = t.raw_edges.select((s % 4).alias("part"), "seq", "source", "target", F.lower("type").alias("type"), F.col("weight").try_cast("double").alias("weight"))
    layers = t.memberships.select((F.col("pos") % 3).alias("part"), F.col("pos").alias("seq"), "layer", F.replace("node_id", F.lit("part:"), F.lit("file:")).alias("node_id"))
    tour = t.pages.select((n % 3).alias("part"), n.alias("seq"), F.concat(F.lit("Step "), (n % 12).cast("string")).alias("title"), F.repeat(F.lit("x"), (n * 7 % 23).cast("int")).alias("description"), F.concat(F.lit("file:"), (n * 2).cast("string")).alias("node_id"))
    return merge_parts(nodes, edges, layers, tour)


@query("u3_merged_nodes", f"{_PARTS} SELECT * FROM mn", ("raw_nodes", "raw_edges", "memberships"))
def _u3n(t: Tables) -> DataFrame:
    return _parts(t)[0]


@query("u3_merged_edges", f"{_PARTS} SELECT * FROM ke", ("raw_nodes", "raw_edges", "memberships"))
def _u3e(t: Tables) -> DataFrame:
    return _parts(t)[1]


@query(
    "u3_merged_tour",
    f"""{_PARTS}, st AS (SELECT title, min((part, seq)) AS first, arg_max(description, (length(description), -part, -seq)) AS description FROM tu GROUP BY title), nn AS (SELECT DISTINCT title, node_id FROM tu WHERE node_id IN (SELECT id FROM mn))
SELECT place, title, description, node_id FROM (SELECT *, row_number() OVER (ORDER BY first) AS place FROM st) LEFT JOIN nn USING (title)""",
    ("raw_nodes", "raw_edges", "memberships"),
)
def _u3t(t: Tables) -> DataFrame:
    return _parts(t)[3]


@query(
    "u3_merge_report",
    f"""{_PARTS} SELECT 'nodes-in' AS what, count(*) AS n FROM nd UNION ALL SELECT 'nodes-out', count(*) FROM mn UNION ALL SELECT 'nodes-without-id', count(*) FROM nd WHERE id = '' UNION ALL SELECT 'edges-in', count(*) FROM ed UNION ALL SELECT 'edges-merged', count(*) FROM me UNION ALL SELECT 'edges-out', count(*) FROM ke
UNION ALL SELECT 'layer-refs-dropped', count(*) FROM (SELECT DISTINCT layer, node_id FROM la) WHERE node_id NOT IN (SELECT id FROM mn) UNION ALL SELECT 'tour-refs-dropped', count(*) FROM (SELECT DISTINCT title, node_id FROM tu) WHERE node_id NOT IN (SELECT id FROM mn)""",
    ("raw_nodes", "raw_edges", "memberships"),
)
def _u3r(t: Tables) -> DataFrame:
    return _parts(t)[4]


@query(
    "w10_annotations",
    """e AS (SELECT o_orderkey AS seq, concat('s', o_custkey % 40) AS screen, CASE o_orderkey % 5 WHEN 0 THEN 'field' WHEN 1 THEN 'region' WHEN 2 THEN 'action' WHEN 3 THEN 'link' END AS kind, concat('#e', o_orderkey % 90) AS selector, o_orderkey * 13 % 700 AS x, o_orderkey * 7 % 501 AS y, o_orderkey % 11 AS width, o_orderkey % 23 AS height, o_orderkey % 9 > 0 AS visible, o_orderkey % 14 = 3 AS disabled FROM orders),
f AS (SELECT screen, selector, arg_min(kind, seq) AS kind, arg_min(x, seq) AS x, arg_min(y, seq) AS y FROM e WHERE visible AND NOT disabled AND width >= 4 AND height >= 4 AND kind IS NOT NULL GROUP BY screen, selector)
SELECT screen, selector, kind, row_number() OVER (PARTITION BY screen, CASE WHEN kind = 'region' THEN 'field' ELSE kind END ORDER BY floor(y / 8e0 + 0.5), x, selector) AS no FROM f""",
)
def _w10(t: Tables) -> DataFrame:
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    kind = F.when(k % 5 == 0, "field").when(k % 5 == 1, "region").when(k % 5 == 2, "action").when(k % 5 == 3, "link")
    return number_annotations(
        t.orders.select(
            k.alias("seq"), F.concat(F.lit("s"), text(F.col("o_custkey") % 40)).alias("screen"), kind.alias("kind"), F.concat(F.lit("#e"), text(k % 90)).alias("selector"),
            (k * 13 % 700).alias("x"), (k * 7 % 501).alias("y"), (k % 11).alias("width"), (k % 23).alias("height"), (k % 9 > 0).alias("visible"), (k % 14 == 3).alias("disabled"),
        )
    )


_LOADS = """tb AS (SELECT DISTINCT concat('T', p_size) AS tbl, ['id', concat('c', p_size % 3)] AS columns FROM part), ins AS (SELECT event_id AS seq, concat('t', event_id % 60) AS tbl, CASE WHEN event_id % 2 = 0 THEN ['id', 'kind'] END AS columns, [CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR)] AS vals FROM events),
mk AS (SELECT tbl, coalesce(arg_min(columns, seq) FILTER (seq = first), ['col0', 'col1', 'col2']) AS columns FROM (SELECT *, min(seq) OVER (PARTITION BY tbl) AS first FROM ins) WHERE upper(tbl) NOT IN (SELECT tbl FROM tb) GROUP BY tbl)"""


def _loads(t: Tables):
    e, text = F.col("event_id"), lambda c: c.cast("string")
    tables = t.part.select(F.concat(F.lit("T"), text(F.col("p_size"))).alias("tbl"), F.array(F.lit("id"), F.concat(F.lit("c"), text(F.col("p_size") % 3))).alias("columns")).distinct()
    inserts = t.events.select(e.alias("seq"), F.concat(F.lit("t"), text(e % 60)).alias("tbl"), F.when(e % 2 == 0, F.array(F.lit("id"), F.lit("kind"))).alias("columns"), F.array(text(e), F.col("event_type"), text(F.col("user_id"))).alias("values"))
    return load_rows(tables, inserts)


@query(
    "u12_loaded_tables",
    f"""{_LOADS}, al AS (SELECT tbl, columns, 'ddl' AS origin FROM tb UNION ALL SELECT tbl, columns, 'data' FROM mk) SELECT al.tbl, array_to_string(columns, ',') AS columns, origin, (SELECT count(*) FROM ins WHERE lower(ins.tbl) = lower(al.tbl)) AS rows FROM al""",
)
def _u12(t: Tables) -> DataFrame:
    return _loads(t)[0].withColumn("columns", F.array_join("columns", ","))


@query(
    "u12_loaded_rows",
    f"""{_LOADS}, al AS (SELECT tbl, columns FROM tb UNION ALL SELECT tbl, columns FROM mk), r AS (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY seq) AS k FROM ins)
SELECT al.tbl, seq, concat(coalesce(r.columns, al.columns)[1], '=', vals[1], ',', coalesce(r.columns, al.columns)[2], '=', vals[2], ',', coalesce(coalesce(r.columns, al.columns)[3], 'col2'), '=', vals[3]) AS vals FROM r JOIN al ON lower(al.tbl) = r.tbl WHERE k <= 50""",
)
def _u12b(t: Tables) -> DataFrame:
    pairs = F.transform(F.map_entries("values"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return _loads(t)[1].select("tbl", "seq", F.array_join(pairs, ",").alias("vals"))


_LINKS = """lk AS (SELECT a.path AS source, b.path AS target FROM files a JOIN files b ON b.seq = a.seq + 1 WHERE a.seq % 100 > 0 UNION ALL SELECT a.path, b.path FROM files a JOIN files b ON b.seq = a.seq * 2 WHERE a.seq < 10)"""


@query(
    "g12_capped_component",
    f"""{_LINKS}, b AS (SELECT source, target FROM lk UNION SELECT target, source FROM lk), st AS (SELECT path AS id FROM files WHERE seq = 40), r AS (SELECT id, 0 AS depth FROM st UNION SELECT b.target, r.depth + 1 FROM r JOIN b ON b.source = r.id WHERE depth < 3) SELECT DISTINCT id FROM r""",
    ("files",),
    recursive=True,
)
def _g12(t: Tables) -> DataFrame:
    to = t.files.select(F.col("seq").alias("to"), F.col("path").alias("target"))
    link = lambda kept, seq: t.files.where(kept).select(F.col("path").alias("source"), seq.alias("to")).join(to, "to").select("source", "target")
    links = materialize(link("seq % 100 > 0", F.col("seq") + 1).union(link("seq < 10", F.col("seq") * 2)), "links")
    return key_component(links, t.files.where("seq = 40").first()["path"])


@query(
    "n7_urls",
    r"""u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('/shop/a', page_id, ';JSESSIONID=1F?b=1&a=2&b=3#top') WHEN 1 THEN concat('https://shop.example.com/shop/x/', page_id, '?jsessionid=7&z=1') WHEN 2 THEN 'https://shop.example.com/shop' WHEN 3 THEN concat('https://shop.example.com/shopping/', page_id, '?jsessionid=8') ELSE url END AS url FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('https://shop.example.com/shop/a', page_id, '?b=1&a=2&b=3') WHEN 1 THEN concat('https://shop.example.com/shop/x/', page_id, '?z=1') WHEN 2 THEN 'https://shop.example.com/shop' WHEN 3 THEN concat('https://shop.example.com/shopping/', page_id) END AS site,
CASE page_id % 5 WHEN 0 THEN concat('screen:a', page_id, '__a_b') WHEN 1 THEN concat('screen:x/', page_id, '__z') WHEN 2 THEN 'screen:(root)' WHEN 3 THEN concat('screen:shopping/', page_id) END AS screen FROM u""",
)
def _n7(t: Tables) -> DataFrame:
    n, text = F.col("page_id"), F.col("page_id").cast("string")
    url = F.when(n % 5 == 0, F.concat(F.lit("/shop/a"), text, F.lit(";JSESSIONID=1F?b=1&a=2&b=3#top"))).when(n % 5 == 1, F.concat(F.lit("https://shop.example.com/shop/x/"), text, F.lit("?jsessionid=7&z=1"))).when(n % 5 == 2, "https://shop.example.com/shop").when(n % 5 == 3, F.concat(F.lit("https://shop.example.com/shopping/"), text, F.lit("?jsessionid=8"))).otherwise(F.col("url"))
    site = same_site(url, "https://shop.example.com/shop/start")
    return t.pages.select("page_id", site.alias("site"), screen_id(site, "/shop/").alias("screen"))
