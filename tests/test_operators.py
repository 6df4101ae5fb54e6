"""Literal cases and invariants of operators."""

import json

from pyspark.sql import functions as F

from factloom.functions import text as fn
from factloom.operators import documents, filters, graph, joins, search, windows
from factloom.operators.merge import table_hash
from factloom.plans.components import connected_components
from factloom.sources import files
from factloom.streaming import upkeep


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "call", i + 1, i) for i, (a, b) in enumerate(pairs)], "source string, target string, kind string, line long, seq long")


def test_reach_counts_least_depth_and_ignores_seeds(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "y"))
    seeds = spark.createDataFrame([("c",)], "id string")
    got = {r.id: (r.depth, r.line, r.file) for r in graph.reach_closure(e, seeds, cap=5).collect()}
    assert got == {"a": (1, 1, "a"), "b": (1, 2, "b")}
    assert {r.id for r in graph.reach_closure(e, seeds, cap=5, reverse=False).collect()} == {"a", "b"}


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_cyclic_core_and_levels(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("p", "q"), ("q", "r"))
    assert {r.id for r in graph.cyclic_core(e).collect()} == {"b", "c"}
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate("abcdpqr")], "id string, seq long")
    assert {r.id: r.level for r in graph.topological_levels(nodes, e).collect()} == {"a": 0, "p": 0, "q": 1, "r": 2, "b": None, "c": None, "d": None}


def test_communities_beat_no_grouping(spark):
    ring = [(f"{g}{i}", f"{g}{j}") for g in "xyz" for i in range(5) for j in range(i)] + [("x0", "y0"), ("y1", "z1")]
    e = edges(spark, *ring)
    label = graph.communities(e)
    assert label.count() == 15
    assert graph.modularity(e, label).first().modularity > 0.5
    parts = graph.split_communities(label, 2).groupBy("community", "part").count()
    assert parts.agg(F.max("count")).first()[0] <= 2


def test_mid_rank_ties_nulls_and_flat_metrics(spark):
    d = spark.createDataFrame([(1, 10, 5), (2, 10, 5), (3, 30, 5), (4, None, 5)], "id int, m int, f int")
    got = {r.id: (r.m_rank, r.m_flat, r.f_rank, r.f_flat) for r in windows.mid_rank(d, ["m", "f"]).collect()}
    assert got[1][:2] == (0.25, False) and got[3][0] == 1.0 and got[4][0] is None and got[1][2:] == (0.5, True)


def test_natural_order(spark):
    d = spark.createDataFrame([("R10",), ("R9",), ("A2b10",), ("A2b9",)], "id string")
    assert [r.id for r in d.orderBy(windows.natural_key(F.col("id"))).collect()] == ["A2b9", "A2b10", "R9", "R10"]


def test_normalisers_are_idempotent(spark):
    d = spark.createDataFrame([("proj:file:a.ts",), ("file:file:a.ts",), ("file:a.ts",), ("other:x",)], "id string")
    once = d.select(fn.node_id(F.col("id")).alias("id"))
    assert [r.id for r in once.collect()] == ["file:a.ts", "file:a.ts", "file:a.ts", "other:x"]
    assert once.select(fn.node_id(F.col("id"))).collect() == once.collect()
    got = d.limit(1).select(fn.derived_columns(F.lit("findByFirstNameAndAgeGreaterThanOrderByIdDesc")).alias("c"), fn.crud_verb(F.lit("saveAll")).alias("v"), fn.query_keys(F.lit("/a?b=1&a=2&JSESSIONID=3#x")).alias("q"), fn.identifier_tokens(F.lit("HTTPServerError2Log")).alias("t")).first()
    assert got.c == ["age", "first_name"] and got.v == "C" and got.q == ["a", "b"] and got.t == ["http", "server", "error", "log"]


def test_filters(spark):
    d = spark.createDataFrame([("src/test/A.java",), ("src/FooTest.java",), ("src/node_modules/x.js",), ("Dockerfile",)], "path string")
    p = F.col("path")
    assert [tuple(r) for r in d.select(filters.is_test(p), filters.has_skipped_segment(p), filters.language(p)).collect()] == [(True, False, "java"), (True, False, "java"), (False, True, "unknown"), (False, False, "dockerfile")]


def test_route_links_match_segments(spark):
    calls = spark.createDataFrame([(1, "GET", "/a/7"), (2, None, "/a/7/b"), (3, "POST", "/a/7"), (4, "GET", "/f/x/y")], "call int, method string, path string")
    routes = spark.createDataFrame([("r1", "GET", "/a/{id}"), ("r2", "ANY", "/a/{id}/b"), ("r3", "ANY", "/f/*"), ("r4", "ANY", "/f/x/y/*")], "route string, method string, pattern string")
    assert {(r.call, r.route) for r in joins.route_links(calls, routes).collect()} == {(1, "r1"), (2, "r2"), (4, "r3")}


def test_fuzzy_search(spark):
    nodes = spark.createDataFrame([("1", "OrderController"), ("2", "order controler"), ("3", "unrelated")], "id string, name string")
    assert [r.id for r in search.fuzzy_search(nodes, "controller").collect()] == ["1", "2"]
    assert search.fuzzy_search(nodes, "  ").collect() == []


def test_table_hash_ignores_order(spark):
    d = spark.range(100).selectExpr("id", "id % 7 as k")
    assert table_hash(d).first() == table_hash(d.orderBy(F.desc("id")).repartition(5)).first() != table_hash(d.where("id > 0")).first()


def test_sources_and_sinks(spark, tmp_path):
    g = {"nodes": [{"id": "a", "type": "file", "name": "A", "filePath": "/r/src/a.ts"}, {"id": "b", "type": "file", "filePath": "/x/b.ts"}], "edges": [{"source": "a", "target": "b", "type": "imports", "weight": 0.5}], "layers": []}
    (tmp_path / "g").mkdir()
    (tmp_path / "g/ok.json").write_text(json.dumps(g))
    (tmp_path / "g/bad.json").write_text("{ not json")
    read = files.read_graphs(spark, str(tmp_path / "g"))
    assert read["nodes"].count() == 2 and read["edges"].first().weight == 0.5 and read["rejects"].count() == 1
    files.write_graph(read["nodes"], str(tmp_path / "out"), "/r")
    assert {r.filePath for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"src/a.ts", "b.ts"}
    for out in ("one", "two"):
        files.write_report(spark.range(50).repartition(3), str(tmp_path / out), ["id"])
    text = lambda n: "".join(p.read_text() for p in sorted((tmp_path / n).glob("part-*")))
    assert text("one") == text("two") != ""
    (tmp_path / "log").write_text("\x1eabc\x1f2024-01-02T03:04:05Z\x1fdev\n3\t1\tsrc/a.ts\n-\t-\timg.png\n\x1edef\x1f2024-01-03T00:00:00Z\x1fdev\n")
    assert [(r.sha, r.path, r.added, r.deleted) for r in files.commit_log(spark, str(tmp_path / "log")).collect()] == [("abc", "src/a.ts", 3, 1), ("abc", "img.png", 0, 0)]
    (tmp_path / "src/dist").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x\ny\n")
    (tmp_path / "src/dist/b.py").write_text("x")
    (tmp_path / "src/r.md").write_text("# t\n\ntext")
    assert [(r.path, r.lang, r.lines) for r in files.census(spark, str(tmp_path / "src")).orderBy("path").collect()] == [("a.py", "python", 2), ("r.md", "markdown", 3)]
    assert files.markdown(spark, str(tmp_path / "src")).count() == 3
    (tmp_path / "u.jsonl").write_text('{"type":"assistant","timestamp":"2024-01-01T00:00:00Z","message":{"model":"m","usage":{"input_tokens":3}}}\nnot json\n{"type":"user"}\n')
    assert [r.input_tokens for r in files.usage_events(spark, str(tmp_path / "u.jsonl")).collect()] == [3]


def test_document_states_reject_illegal_moves(spark):
    e = spark.createDataFrame([("d", 1, 1, "purchase"), ("d", 2, 2, "view"), ("d", 3, 3, "purchase"), ("d", 4, 4, "other")], "entity string, ts long, seq long, event string")
    assert tuple(upkeep.document_states(e).first()) == ("d", "approved", 1)


def test_onboarding_keeps_few_members_ahead_of_the_shuffle(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"name{i}", "complex" if i % 4 == 0 else "simple") for i in range(300)], "id string, name string, complexity string")
    members = spark.createDataFrame([(None if i % 3 == 0 else "a", 300 - i // 2, f"n{i}") for i in range(300)], "layer string, pos long, node_id string")
    d = documents.onboarding(members, nodes)
    got = {r.layer: (r.members, r.complex) for r in d.collect()}
    want = {}
    for layer in (None, "a"):
        own = sorted((300 - i // 2, f"n{i}", f"name{i}") for i in range(300) if (i % 3 == 0) == (layer is None))
        want[layer] = (",".join(x[2] for x in own[:5]), sum(int(x[1][1:]) % 4 == 0 for x in own))
    assert got == want
    assert "WindowGroupLimit" in d._jdf.queryExecution().executedPlan().toString()


def test_packing_streams_the_rows_of_a_key(spark):
    rows = [(None if i % 3 == 0 else f"k{i % 3}", i * 37 % 400, None if i == 7 else i % 11) for i in range(400)]
    d = windows.packed(spark.createDataFrame(rows, "k string, pos long, n long"), "k", ["pos"], "n", 60)
    want = []
    for key in (None, "k1", "k2"):
        used = 0
        for _, p, n in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            kept = None if n is None else used + n <= 60
            used += n if kept else 0
            want.append((key, p, n, kept))
    assert sorted(map(tuple, d.collect()), key=str) == sorted(want, key=str)
    assert "collect_list" not in d._jdf.queryExecution().executedPlan().toString()
