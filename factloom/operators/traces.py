"""Method-level reach, traced flow steps and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.operators.graph import frontier, strides
from factloom.operators.windows import half_up
from factloom.plans import walks
from factloom.plans.ranges import number_rows
from factloom.plans.shared import discard, materialize, shuffled
from factloom.registry import query

# Fixed value: steps of a flow that are kept.
STEP_CAP = 8


def strong_components(edges: DataFrame) -> DataFrame:
    """``(component, node)`` of every node on a cycle; the component is named by its greatest
    node. A node with an edge to itself alone is a component of one.

    Rounds: nodes without an incoming or an outgoing edge are trimmed; the greatest node that
    reaches a node colours it; what reaches the node that named a colour, inside the colour, is a
    component, and edges between colours can be on no cycle. Every step joins the newest changes
    and ends in a table in the shared folder.
    """
    e = materialize(edges.select("source", "target").where("source is not null and target is not null").distinct(), "scc")
    loops = materialize(e.where("source = target").select(F.col("source").alias("node")), "loops")
    e = materialize(e.where("source <> target"), "scc")
    parts: list[DataFrame] = []
    while True:
        e = _trimmed(e)
        if e.isEmpty():
            break
        colour = _coloured(e)
        near = e.join(colour.toDF("source", "a"), "source").join(colour.toDF("target", "b"), "target").where("a = b")
        near = materialize(near.select("source", "target", F.col("a").alias("colour")), "inside")
        back = near.select(F.struct("colour", F.col("target").alias("id")).alias("node"), F.struct("colour", F.col("source").alias("id")).alias("next"))
        starts = colour.where("node = colour").select(F.struct("colour", F.col("node").alias("id")).alias("node"))
        found = materialize(frontier(starts, back, ["node"], None).select("node.colour", "node.id"), "component")
        parts.append(found)
        gone = found.select("id")
        rest = near.join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti")
        last, e = e, materialize(rest.select("source", "target"), "scc")
        discard(last)
    both = [p.select(F.col("colour").alias("component"), F.col("id").alias("node")) for p in parts]
    if not both:
        return loops.select(F.col("node").alias("component"), "node")
    out = both[0]
    for p in both[1:]:
        out = out.union(p)
    large = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    out = out.join(large, "component", "left_semi").select("component", "node")
    alone = loops.join(out.select("node"), "node", "left_anti")
    return out.union(alone.select(F.col("node").alias("component"), "node"))


def has_cycle(edges: DataFrame) -> bool:
    """Whether any node reaches itself. An edge from a node to itself and two nodes with edges both
    ways are looked for first; only without them components are."""
    e = edges.where("source is not null and target is not null")
    if not e.where("source = target").isEmpty():
        return True
    ends = e.groupBy(F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high"))
    both = ends.agg(F.min("source").alias("a"), F.max("source").alias("b")).where("a <> b")
    return not both.isEmpty() or not strong_components(e).isEmpty()


def _trimmed(e: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges between nodes that have both an incoming and an outgoing one, a few times over; long
    tails that remain only cost colours of their own."""
    for _ in range(rounds):
        inner = e.select(F.col("source").alias("id")).intersect(e.select(F.col("target").alias("id")))
        kept = e.join(inner.toDF("source"), "source", "left_semi").join(inner.toDF("target"), "target", "left_semi")
        last, e = e, materialize(kept, "trim")
        before, after = last.count(), e.count()
        discard(last)
        if before == after:
            break
    return e


def _coloured(e: DataFrame) -> DataFrame:
    """``(node, colour)``: the greatest node that reaches each node, itself included."""
    colour = materialize(e.select(F.col("source").alias("node")).union(e.select("target")).distinct().withColumn("colour", F.col("node")), "colour")
    fresh = colour
    while True:
        sent = fresh.withColumnRenamed("node", "source").join(e, "source").groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("better"))
        wins = materialize(sent.join(colour, "node").where("better > colour").select("node", F.col("better").alias("colour")), "wins")
        if wins.isEmpty():
            return colour
        merged = colour.join(wins.withColumnRenamed("colour", "better"), "node", "left").select("node", F.coalesce("better", "colour").alias("colour"))
        colour, fresh = materialize(merged, "colour"), wins


def _resolved(calls: DataFrame) -> DataFrame:
    """Calls whose callee is a file of the project."""
    return calls.where("caller_file is not null and callee_file is not null")


def method_reach(calls: DataFrame, roots: DataFrame) -> DataFrame:
    """``calls(caller_file, caller_method, callee_file, callee_method)`` and ``roots(root, file,
    method)`` -> ``(root, file, method)`` of all that is called from a root, directly or not. A call
    without a callee's file ends there; the root itself is among them just if it is called back."""
    starts, steps, places = _numbered(calls, roots)
    size = places.count() + 1
    if walks.walkable(steps, size, steps.count()):
        return walks.called(walks.Walks(steps, starts, size)).join(shuffled(places), "node").select("root", "file", "method")
    first = starts.join(steps.hint("merge"), "node").select("root", F.col("next").alias("node"))
    return strides(first, steps).join(places.hint("merge"), "node").select("root", "file", "method")


def _numbered(calls: DataFrame, roots: DataFrame, ordered: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``starts(root, node)``, ``steps(node, next)``, with the least ``seq`` if ``ordered``, and ``places(node, file,
    method)``, nodes as numbers in order of file and method."""
    pair = lambda side: F.struct(F.col(f"{side}_file").alias("file"), F.col(f"{side}_method").alias("method")).alias("place")
    pairs = _resolved(calls).select(pair("caller").alias("caller"), pair("callee").alias("callee"), *(["seq"] if ordered else [])).groupBy("caller", "callee")
    pairs = pairs.agg(F.min("seq").alias("seq")) if ordered else pairs.agg(F.count("*").alias("n")).drop("n")
    known = pairs.select(F.col("caller").alias("place")).union(pairs.select("callee")).union(roots.select(F.struct("file", "method"))).distinct()
    named = materialize(number_rows(known, ["place"], "node"), "places")
    ends = lambda place, node: named.select(F.col("place").alias(place), F.col("node").alias(node)).hint("merge")
    steps = materialize(pairs.join(ends("caller", "node"), "caller").join(ends("callee", "next"), "callee").select("node", "next", *(["seq"] if ordered else [])), "steps")
    starts = materialize(roots.select("root", F.struct("file", "method").alias("place")).join(ends("place", "node"), "place").select("root", "node").distinct(), "starts")
    return starts, steps, named.select("node", "place.file", "place.method")


def reached_files(calls: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, n)``: how many files calls from a root come to, its own included."""
    starts, steps, places = _numbered(calls, roots)
    files = places.groupBy("file").agg(F.min("node").alias("in_file")).hint("merge")
    places = materialize(places.join(files, "file").select("node", "in_file"), "files")
    return strides(starts, steps).join(places.hint("merge"), "node").select("root", "in_file").distinct().groupBy("root").agg(F.count("*").alias("n"))


def traced_files(calls: DataFrame, roots: DataFrame, cap: int | None = None) -> DataFrame:
    """``roots(flow, file, method)`` -> ``(flow, file, place)``: the files that calls from the
    handler come to, in the order of discovery: nearer calls first, then by the place of the caller
    among those found before, then by ``seq`` of the call. The root's file is in place 1. A flow that
    has ``cap`` files is traced no further: later ones come behind them."""
    steps = materialize(_resolved(calls).select(F.col("caller_file").alias("file"), F.col("caller_method").alias("method"), "callee_file", "callee_method", "seq"), "calls")
    front = materialize(roots.select("flow", "file", "method").distinct().select("*", F.lit(0).alias("rank"), F.lit(0).alias("depth")), "front")
    seen = front
    depth = 0
    while True:
        depth += 1
        hits = front.select("flow", "file", "method", "rank").join(steps, ["file", "method"])
        hits = hits.groupBy("flow", F.col("callee_file").alias("file"), F.col("callee_method").alias("method")).agg(F.min(F.struct("rank", "seq")).alias("order"))
        new = hits.join(seen.select("flow", "file", "method"), ["flow", "file", "method"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("flow").orderBy("order", "file", "method"))
        front = materialize(new.select("flow", "file", "method", rank.alias("rank"), F.lit(depth).alias("depth")), "front")
        if front.isEmpty():
            break
        seen = seen.union(front)
        if cap is not None:
            full = seen.groupBy("flow").agg(F.countDistinct("file").alias("n")).where(F.col("n") >= cap).select("flow")
            front = front.join(full, "flow", "left_anti")
    first = seen.groupBy("flow", "file").agg(F.min(F.struct("depth", "rank")).alias("order"))
    return first.select("flow", "file", F.row_number().over(Window.partitionBy("flow").orderBy("order")).alias("place"))


def _searched(calls: DataFrame, handlers: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """``traced_files`` and, of flows that met the cap, ``(flow, n)``, how many there are in all."""
    traced = materialize(traced_files(calls, handlers, cap), "traced")
    full = traced.groupBy("flow").agg(F.count("*").alias("n")).where(F.col("n") >= cap).select("flow")
    counted = reached_files(calls, handlers.join(full, "flow", "left_semi").withColumnRenamed("flow", "root"))
    return traced, materialize(counted.withColumnRenamed("root", "flow"), "counted")


def _walked(calls: DataFrame, handlers: DataFrame, cap: int) -> tuple[DataFrame, DataFrame] | None:
    """The same by ``walks``, counts being of all flows; None where a task has no room for the calls, or a flow has
    several handlers."""
    once = handlers.distinct()
    if not once.groupBy("flow").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return None
    starts, steps, places = _numbered(calls, once.withColumnRenamed("flow", "root"), True)
    size = places.count() + 1
    if not walks.walkable(steps, size, steps.count()):
        return None
    file_of = places.join(shuffled(places.groupBy("file").agg(F.min("node").alias("in_file"))), "file").select("node", F.col("in_file").alias("file"))
    found = materialize(walks.traced(walks.Walks(steps, starts, size), file_of, cap), "traced")
    traced = found.join(shuffled(places), "node").select(F.col("root").alias("flow"), "file", "place")
    return materialize(traced, "traced"), found.where("place = 1").select(F.col("root").alias("flow"), F.col("whole").cast("long").alias("n"))


def traced_steps(flows: DataFrame, calls: DataFrame, reached: DataFrame, cap: int = STEP_CAP) -> DataFrame:
    """``flows(flow, root, method, declared)`` -> ``(flow, place, path, weight, dropped)``: a flow's
    first ``cap`` steps, weights rising to 1 in equal steps, and how many more there are. The steps
    are the traced files; where the trace ends at the root and the handler is not declared there,
    they are the root and what ``reached(root, path)`` has, by path."""
    handlers = flows.where("method is not null").select("flow", F.col("root").alias("file"), "method")
    traced, counted = _walked(calls, handlers, max(cap, 2)) or _searched(calls, handlers, max(cap, 2))
    sizes = traced.groupBy("flow").agg(F.count("*").alias("n"))
    sizes = materialize(sizes.join(counted.withColumnRenamed("n", "whole"), "flow", "left").select("flow", F.coalesce("whole", "n").alias("n")), "sizes")
    known = flows.join(sizes, "flow", "left").withColumn("traces", (F.coalesce("n", F.lit(0)) > 1) | (F.col("n").isNotNull() & F.coalesce("declared", F.lit(False))))
    exact = known.where("traces").select("flow").join(traced, "flow").select("flow", F.col("file").alias("path"), "place")
    loose = known.where("not traces").select("flow", "root")
    files = loose.select("flow", "root", F.col("root").alias("path")).union(loose.join(reached.select("root", "path").where("root <> path").distinct(), "root").select("flow", "root", "path"))
    w = Window.partitionBy("flow").orderBy(F.col("path") != F.col("root"), "path")
    steps = exact.union(files.select("flow", "path", F.row_number().over(w).alias("place")))
    listed = steps.groupBy("flow").agg(F.count("*").alias("found"))
    steps = steps.join(listed, "flow").join(counted, "flow", "left").withColumn("n", F.greatest("found", "n")).where(F.col("place") <= cap)
    kept = F.least("n", F.lit(cap))
    return steps.select("flow", "place", "path", half_up(F.col("place") / kept, 4).alias("weight"), (F.col("n") - kept).alias("dropped"))


def step_calls(steps: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """``(flow, source, target, methods)``: edges between steps of one flow, with the methods that
    are called along them in order of their first call, null without any."""
    pairs = edges.select("source", "target").where("source <> target").distinct()
    d = steps.select("flow", F.col("path").alias("source")).join(pairs, "source").join(steps.select("flow", F.col("path").alias("target")), ["flow", "target"], "left_semi")
    first = _resolved(calls).groupBy(F.col("caller_file").alias("source"), F.col("callee_file").alias("target"), "callee_method").agg(F.min("seq").alias("seq"))
    label = first.groupBy("source", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "callee_method"))), lambda x: x["callee_method"]), " → ").alias("methods"))
    return d.join(label, ["source", "target"], "left").select("flow", "source", "target", "methods")


_JUMPS = """jumps AS (SELECT a.path AS source, b.path AS target FROM files a JOIN files b ON b.seq = a.seq * 7 % (SELECT count(*) FROM part) + 1 WHERE a.seq % 3 > 0
UNION SELECT a.path, b.path FROM files a JOIN files b ON b.seq = a.seq * 5 % (SELECT count(*) FROM part) + 1 WHERE a.seq % 4 = 0)"""


@query(
    "g9_cycles",
    f"""{_JUMPS}, r AS (SELECT source AS root, target AS id FROM jumps UNION SELECT r.root, j.target FROM r JOIN jumps j ON j.source = r.id),
p AS (SELECT root, id FROM r), b AS (SELECT x.root AS node, max(x.id) AS component FROM p x JOIN p y ON y.root = x.id AND y.id = x.root GROUP BY x.root) SELECT component, node FROM b""",
    ("files",),
    recursive=True,
)
def _g9(t: Tables) -> DataFrame:
    n = t.part.count()
    f = t.files.select(F.col("seq").alias("to"), F.col("path").alias("target"))
    jump = lambda times, kept: t.files.where(kept).select(F.col("path").alias("source"), (F.col("seq") * times % n + 1).alias("to")).join(f, "to").select("source", "target")
    return strong_components(jump(7, "seq % 3 > 0").union(jump(5, "seq % 4 = 0")))


_FLOWS = """flows AS (SELECT concat('flow:', seq) AS flow, path AS root, CASE seq % 3 WHEN 0 THEN 'zz' WHEN 1 THEN 'm0' ELSE 'm1' END AS method, seq % 3 > 0 AS declared FROM files WHERE path LIKE '%/controller/%')"""


def _flows(t: Tables) -> DataFrame:
    n = F.col("seq") % 3
    return t.files.where("path like '%/controller/%'").select(F.concat(F.lit("flow:"), F.col("seq").cast("string")).alias("flow"), F.col("path").alias("root"), F.when(n == 0, "zz").when(n == 1, "m0").otherwise("m1").alias("method"), (n > 0).alias("declared"))


@query(
    "g3_method_pairs",
    f"""{_FLOWS}, c AS (SELECT caller_file, caller_method, callee_file AS file, callee_method AS method FROM method_calls WHERE callee_file IS NOT NULL),
r AS (SELECT flow AS root, file, c.method FROM flows JOIN c ON caller_file = root AND caller_method = flows.method UNION SELECT r.root, c.file, c.method FROM r JOIN c ON caller_file = r.file AND caller_method = r.method) SELECT root, file, method FROM r""",
    ("files", "method_calls"),
    recursive=True,
)
def _g3(t: Tables) -> DataFrame:
    return method_reach(t.method_calls, _flows(t).select(F.col("flow").alias("root"), F.col("root").alias("file"), "method"))


# the order of discovery is that of the shortest paths' call numbers, compared one by one
_STEPS = f"""{_FLOWS}, c AS (SELECT caller_file, caller_method, callee_file AS file, callee_method AS method, seq FROM method_calls WHERE callee_file IS NOT NULL),
r AS (SELECT flow, root AS file, method, CAST([] AS BIGINT[]) AS key, [concat(root, '#', method)] AS path FROM flows
  UNION ALL SELECT r.flow, c.file, c.method, list_append(key, c.seq), list_append(path, concat(c.file, '#', c.method)) FROM r JOIN c ON caller_file = r.file AND caller_method = r.method WHERE NOT list_contains(path, concat(c.file, '#', c.method))),
f AS (SELECT flow, file, min((len(key), key)) AS key FROM r GROUP BY flow, file),
tr AS (SELECT flow, file AS path, row_number() OVER (PARTITION BY flow ORDER BY key) AS place, count(*) OVER (PARTITION BY flow) AS n FROM f),
ok AS (SELECT flow FROM flows WHERE declared OR flow IN (SELECT flow FROM tr WHERE n > 1)),
rc AS (SELECT DISTINCT source AS root, target AS path FROM file_edges WHERE kind = 'import' AND source <> target),
ls AS (SELECT flow, path, row_number() OVER (PARTITION BY flow ORDER BY path <> root, path) AS place, count(*) OVER (PARTITION BY flow) AS n FROM (SELECT flow, root, root AS path FROM flows WHERE flow NOT IN (SELECT flow FROM ok) UNION ALL SELECT flow, root, rc.path FROM flows JOIN rc USING (root) WHERE flow NOT IN (SELECT flow FROM ok))),
steps AS (SELECT flow, place, path, round(place / least(n, 8) + 1e-12, 4) AS weight, n - least(n, 8) AS dropped FROM (SELECT * FROM tr WHERE flow IN (SELECT flow FROM ok) UNION ALL SELECT * FROM ls) WHERE place <= 8)"""


def _steps(t: Tables) -> DataFrame:
    reached = t.file_edges.where("kind = 'import'").select(F.col("source").alias("root"), F.col("target").alias("path"))
    return traced_steps(_flows(t), t.method_calls, reached)


@query("g13_traced_steps", f"{_STEPS} SELECT * FROM steps", ("files", "file_edges", "method_calls"), recursive=True)
def _g13(t: Tables) -> DataFrame:
    return _steps(t)


@query(
    "g13_step_calls",
    f"""{_STEPS}, e AS (SELECT caller_file AS source, callee_file AS target FROM method_calls WHERE callee_file IS NOT NULL UNION SELECT source, target FROM file_edges WHERE kind = 'import'),
m AS (SELECT caller_file AS source, callee_file AS target, callee_method, min(seq) AS seq FROM method_calls WHERE callee_file IS NOT NULL GROUP BY ALL), l AS (SELECT source, target, string_agg(callee_method, ' → ' ORDER BY seq) AS methods FROM m GROUP BY ALL)
SELECT a.flow, e.source, e.target, methods FROM steps a JOIN e ON e.source = a.path JOIN steps b ON b.flow = a.flow AND b.path = e.target LEFT JOIN l ON l.source = e.source AND l.target = e.target WHERE e.source <> e.target""",
    ("files", "file_edges", "method_calls"),
    recursive=True,
)
def _g13b(t: Tables) -> DataFrame:
    edges = t.method_calls.select(F.col("caller_file").alias("source"), F.col("callee_file").alias("target")).where("target is not null").union(t.file_edges.where("kind = 'import'").select("source", "target"))
    return step_calls(materialize(_steps(t), "steps"), edges, t.method_calls)
