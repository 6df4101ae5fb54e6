"""Layers and tour of a knowledge base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.plans.shared import materialize, shuffled
from factloom.registry import query

#: Lengths of the runs that are looked up: a needle takes the greatest that it is as long as.
GRAMS = (1, 2, 3, 6, 12)


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct runs of ``size`` characters."""
    n = F.char_length(text) - size + 1
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(size) if isinstance(size, int) else size)))


def containment(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """``needles(needle_id, needle)`` and ``hays(hay_id, hay)`` -> ``(needle_id, hay_id)`` where the needle is
    part of the hay; empty needles are in none.

    An inverted index of runs of characters, longer ones for longer needles, so that hays that are alike
    do not all meet: each needle looks up the run that the fewest hays have, and what it meets there
    is compared.
    """
    n = needles.where(F.char_length("needle") > 0).withColumn("size", F.greatest(*[F.when(F.char_length("needle") >= g, g) for g in GRAMS], F.lit(GRAMS[0])))
    asked = materialize(n.select("needle_id", "needle", F.explode(_grams(F.col("needle"), F.col("size"))).alias("gram")), "asked")
    wanted = asked.select("gram").distinct()
    index = hays.select("hay_id", "hay", F.explode(F.array(*map(F.lit, GRAMS))).alias("size")).select("hay_id", F.explode(_grams(F.col("hay"), F.col("size"))).alias("gram"))
    index = materialize(index.join(shuffled(wanted), "gram", "left_semi"), "grams")
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    # a run that no hay has settles a needle: it is in none
    rare = asked.join(shuffled(often), "gram", "left").groupBy("needle_id", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    rare = rare.where("least.n > 0").select("needle_id", "needle", F.col("least.gram").alias("gram"))
    met = rare.join(shuffled(index), "gram").join(shuffled(hays), "hay_id")
    return met.where(F.contains("hay", F.col("needle"))).select("needle_id", "hay_id").distinct()


def parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(seq, id, type, name, content)`` and ``edges(seq, source, target, type)`` -> ``(child, article,
    tier, seq)`` for entities and claims, by the first that holds: an edge to or from an article; the
    bare name of an article that is the stem of the child's id; a bare name that holds the stem or
    is held by it; an article whose name holds the child's name, or whose content does if the name
    has three characters. Of several the first edge or article. Each tier looks only at what the
    ones before left open."""
    nodes = materialize(nodes, "wiki")
    articles = nodes.where("type = 'article'").select(F.col("id").alias("article"), "seq", F.lower(F.coalesce("name", F.lit(""))).alias("title"), F.lower(F.coalesce("content", F.lit(""))).alias("content"))
    kids = nodes.where("type in ('entity', 'claim')").select(F.col("id").alias("child"), "seq", F.lower("name").alias("name"), F.split(F.when(F.contains("id", F.lit(":")), F.expr("substring(id, instr(id, ':') + 1)")).otherwise(F.col("id")), ":")[0].alias("stem"))
    to_article = edges.join(shuffled(articles.select(F.col("article").alias("target"))), "target", "left_semi").join(shuffled(kids.select(F.col("child").alias("source"))), "source", "left_semi").select("seq", F.col("source").alias("child"), F.col("target").alias("article"))
    from_article = edges.join(shuffled(articles.select(F.col("article").alias("source"))), "source", "left_semi").join(shuffled(kids.select(F.col("child").alias("target"))), "target", "left_semi").select("seq", F.col("target").alias("child"), F.col("source").alias("article"))
    linked = to_article.union(from_article).groupBy("child").agg(F.min_by("article", "seq").alias("article"), F.min("seq").alias("seq")).withColumn("tier", F.lit(0))
    open_ = materialize(kids.join(shuffled(linked), "child", "left_anti"), "open")

    # only ids spelled as articles have a bare name; of equal ones the last article has it, in the place of the first
    bare = nodes.where(F.col("id").startswith("article:")).select(F.when(F.contains("id", F.lit("/")), F.substring_index("id", "/", -1)).otherwise(F.replace("id", F.lit("article:"), F.lit(""))).alias("bare"), "id", "seq")
    bare = materialize(bare.groupBy("bare").agg(F.max_by("id", "seq").alias("article"), F.min("seq").alias("place")), "bare")
    exact = open_.join(shuffled(bare), open_.stem == bare.bare).select("child", "article", "seq", F.lit(1).alias("tier"))
    open_ = materialize(open_.join(shuffled(exact), "child", "left_anti"), "open")

    inside = containment(open_.select(F.col("child").alias("needle_id"), F.col("stem").alias("needle")), bare.select(F.col("bare").alias("hay_id"), F.col("bare").alias("hay"))).select(F.col("needle_id").alias("child"), F.col("hay_id").alias("bare"))
    around = containment(bare.select(F.col("bare").alias("needle_id"), F.col("bare").alias("needle")), open_.select(F.col("child").alias("hay_id"), F.col("stem").alias("hay"))).select(F.col("hay_id").alias("child"), F.col("needle_id").alias("bare"))
    # an empty stem is in every name, and an empty name in every stem
    first = bare.agg(F.min_by("bare", "place").alias("bare")).where("bare is not null")
    hollow = open_.where("stem = ''").select("child").join(F.broadcast(first))
    near = inside.union(around).union(hollow).join(shuffled(bare), "bare").groupBy("child").agg(F.min_by("article", "place").alias("article"))
    near = open_.select("child", "seq").join(shuffled(near), "child").select("child", "article", "seq", F.lit(2).alias("tier"))
    open_ = materialize(open_.join(shuffled(near), "child", "left_anti").where("name is not null and name <> ''"), "open")

    needles = open_.select(F.col("child").alias("needle_id"), F.col("name").alias("needle"))
    told = containment(needles, articles.select(F.col("article").alias("hay_id"), F.col("title").alias("hay")))
    told = told.union(containment(needles.where(F.char_length("needle") >= 3), articles.select(F.col("article").alias("hay_id"), F.col("content").alias("hay"))))
    told = told.join(shuffled(articles.select(F.col("article").alias("hay_id"), F.col("seq").alias("place"))), "hay_id").groupBy(F.col("needle_id").alias("child")).agg(F.min_by("hay_id", "place").alias("article"))
    told = open_.select("child", "seq").join(shuffled(told), "child").select("child", "article", "seq", F.lit(3).alias("tier"))
    columns = ("child", "article", "tier", "seq")
    return reduce(DataFrame.union, [d.select(*columns) for d in (linked, exact, near, told)])


def _slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def _sorted_under(edges: DataFrame, categories: DataFrame) -> DataFrame:
    """``(place, slug, id, seq)`` of what is put under a category's topic."""
    topics = categories.select("place", _slug(F.col("name")).alias("slug")).withColumn("target", F.concat(F.lit("topic:"), "slug"))
    return edges.where("type = 'categorized_under'").join(topics, "target").select("place", "slug", F.col("source").alias("id"), "seq")


def knowledge_layers(nodes: DataFrame, edges: DataFrame, categories: DataFrame) -> DataFrame:
    """With ``categories(place, name)`` -> ``(layer, node_id, tier, seq)``: a category's layer has what is
    put under its topic (tier 0), the topic (1), and the entities and claims of its articles, linked
    by an edge (2) or by name (3); ``layer:other`` has the rest (4). In a layer the order is that of
    tier and ``seq``, so that no task numbers a layer. An article under several topics gives its
    children to the last one's layer."""
    under = materialize(_sorted_under(edges, categories), "under")
    topics = categories.select("place", _slug(F.col("name")).alias("slug")).withColumn("id", F.concat(F.lit("topic:"), "slug"))
    topics = topics.join(shuffled(nodes.select("id").distinct()), "id", "left_semi").select("place", "slug", "id", F.lit(0).cast("long").alias("seq"))
    home = under.select("id", "place", "slug").union(topics.select("id", "place", "slug")).groupBy(F.col("id").alias("article")).agg(F.max_by("slug", "place").alias("slug"))
    kids = materialize(parents(nodes, edges), "kids").join(shuffled(home), "article").select("slug", F.col("child").alias("id"), F.when(F.col("tier") == 0, 2).otherwise(3).alias("tier"), "seq")
    members = under.select("slug", "id", F.lit(0).alias("tier"), "seq").union(topics.select("slug", "id", F.lit(1), "seq")).union(kids)
    members = members.groupBy("slug", "id").agg(F.min(F.struct("tier", "seq")).alias("first")).select(F.concat(F.lit("layer:"), "slug").alias("layer"), F.col("id").alias("node_id"), "first.tier", "first.seq")
    members = materialize(members, "members")
    rest = nodes.join(shuffled(members.select(F.col("node_id").alias("id"))), "id", "left_anti").select(F.lit("layer:other").alias("layer"), F.col("id").alias("node_id"), F.lit(4).alias("tier"), "seq")
    return members.union(rest)


def knowledge_tour(nodes: DataFrame, edges: DataFrame, categories: DataFrame, most: int = 3) -> DataFrame:
    """``(place, node_id, k)``: the first ``most`` of what is put under each category's topic, else the topic."""
    ranked = _sorted_under(edges, categories).withColumn("k", F.row_number().over(Window.partitionBy("place").orderBy("seq", "id"))).where(F.col("k") <= most).select("place", F.col("id").alias("node_id"), "k")
    bare = categories.join(ranked.select("place"), "place", "left_anti").select("place", F.concat(F.lit("topic:"), _slug(F.col("name"))).alias("id"))
    return ranked.union(bare.join(shuffled(nodes.select("id").distinct()), "id", "left_semi").select("place", F.col("id").alias("node_id"), F.lit(1)))


_WIKI = """cat AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS place, concat('Brand ', substr(p_brand, 7)) AS name FROM part),
art AS (SELECT * FROM wiki_nodes WHERE type = 'article'), kid AS (SELECT seq, id AS child, lower(name) AS name, string_split(CASE WHEN contains(id, ':') THEN substr(id, instr(id, ':') + 1) ELSE id END, ':')[1] AS stem FROM wiki_nodes WHERE type IN ('entity', 'claim')),
lk AS (SELECT child, arg_min(article, seq) AS article, min(seq) AS seq, 0 AS tier FROM (SELECT e.seq, source AS child, target AS article FROM wiki_edges e WHERE source IN (SELECT child FROM kid) AND target IN (SELECT id FROM art) UNION ALL SELECT e.seq, target, source FROM wiki_edges e WHERE target IN (SELECT child FROM kid) AND source IN (SELECT id FROM art)) GROUP BY child),
ba AS (SELECT bare, arg_max(id, seq) AS article, min(seq) AS place FROM (SELECT *, CASE WHEN contains(id, '/') THEN regexp_extract(id, '[^/]*$') ELSE replace(id, 'article:', '') END AS bare FROM wiki_nodes WHERE starts_with(id, 'article:')) GROUP BY bare),
t1 AS (SELECT child, article, seq, 1 AS tier FROM kid JOIN ba ON bare = stem WHERE child NOT IN (SELECT child FROM lk)),
t2 AS (SELECT child, arg_min(article, place) AS article, any_value(seq) AS seq, 2 AS tier FROM kid JOIN ba ON contains(bare, stem) OR contains(stem, bare) WHERE child NOT IN (SELECT child FROM lk UNION SELECT child FROM t1) GROUP BY child),
t3 AS (SELECT child, arg_min(art.id, art.seq) AS article, any_value(kid.seq) AS seq, 3 AS tier FROM kid JOIN art ON contains(lower(art.name), kid.name) OR (length(kid.name) >= 3 AND contains(lower(art.content), kid.name)) WHERE kid.name <> '' AND child NOT IN (SELECT child FROM lk UNION SELECT child FROM t1 UNION SELECT child FROM t2) GROUP BY child),
pa AS (SELECT * FROM lk UNION ALL SELECT child, article, seq, tier FROM t1 UNION ALL SELECT child, article, seq, tier FROM t2 UNION ALL SELECT child, article, seq, tier FROM t3),
un AS (SELECT place, lower(replace(c.name, ' ', '-')) AS slug, source AS id, e.seq FROM wiki_edges e JOIN cat c ON target = concat('topic:', lower(replace(c.name, ' ', '-'))) WHERE e.type = 'categorized_under'),
tp AS (SELECT place, lower(replace(cat.name, ' ', '-')) AS slug, id FROM cat JOIN wiki_nodes ON id = concat('topic:', lower(replace(cat.name, ' ', '-'))))"""


def _wiki(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    number = F.substring("p_brand", 7, 9)
    return t.wiki_nodes, t.wiki_edges, t.part.select(number.cast("int").alias("place"), F.concat(F.lit("Brand "), number).alias("name")).distinct()


@query("x8_parents", f"{_WIKI} SELECT child, article, tier, seq FROM pa", ("wiki_nodes", "wiki_edges"))
def _x8(t: Tables) -> DataFrame:
    return parents(t.wiki_nodes, t.wiki_edges)


@query(
    "x8_layers",
    f"""{_WIKI}, ho AS (SELECT id, arg_max(slug, place) AS slug FROM (SELECT id, slug, place FROM un UNION ALL SELECT id, slug, place FROM tp) GROUP BY id),
me AS (SELECT slug, id, 0 AS tier, seq FROM un UNION ALL SELECT slug, id, 1, 0 FROM tp UNION ALL SELECT slug, child, CASE WHEN tier = 0 THEN 2 ELSE 3 END, seq FROM pa JOIN ho ON ho.id = article),
fi AS (SELECT slug, id, min((tier, seq)) AS f FROM me GROUP BY slug, id), ou AS (SELECT concat('layer:', slug) AS layer, id AS node_id, f[1] AS tier, f[2] AS seq FROM fi)
SELECT * FROM ou UNION ALL SELECT 'layer:other', id, 4, seq FROM wiki_nodes WHERE id NOT IN (SELECT node_id FROM ou)""",
    ("wiki_nodes", "wiki_edges"),
)
def _x8b(t: Tables) -> DataFrame:
    return knowledge_layers(*_wiki(t))


@query(
    "x8_tour",
    f"""{_WIKI}, ra AS (SELECT place, id AS node_id, row_number() OVER (PARTITION BY place ORDER BY seq, id) AS k FROM un) SELECT * FROM ra WHERE k <= 3 UNION ALL SELECT place, id, 1 FROM tp WHERE place NOT IN (SELECT place FROM ra)""",
    ("wiki_nodes", "wiki_edges"),
)
def _x8c(t: Tables) -> DataFrame:
    return knowledge_tour(*_wiki(t))
