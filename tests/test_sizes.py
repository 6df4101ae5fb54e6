"""Queries and their SQL on copies of the smallest tables that are repeated with shifted keys."""

import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom import catalog
from factloom.fixtures import Tables, named
from factloom.operators import batches, documents, extract, graph, impacts, joins, knowledge, lookups, measures, reports, resolve, traces, triage, windows
from factloom.plans import shared, sweeps, walks
from factloom.streaming import graphs
from tests.test_oracles import rows

KEYS = {"part": ["p_partkey"], "lineitem": ["l_partkey"]}


@pytest.fixture
def copies(sf_dir, tmp_path):
    def make(*shifts):
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for name in os.listdir(sf_dir):
            table = name.removesuffix(".parquet")
            moved = ", ".join(f"{c} + d AS {c}" for c in KEYS.get(table, ()))
            some = f"SELECT * REPLACE ({moved}) FROM '{sf_dir}/{name}', (SELECT unnest({list(shifts)}) AS d) s" if moved else f"SELECT * FROM '{sf_dir}/{name}'"
            con.execute(f"COPY (SELECT * {'EXCLUDE (d)' if moved else ''} FROM ({some})) TO '{tmp_path}/{name}' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{name}'")
        return str(tmp_path), con

    return make


def same(spark, made, name):
    folder, con = made
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert rows(got) == rows(want)
    return got


def test_flows_beyond_a_thousand_keep_their_numbers(spark, copies):
    got = same(spark, copies(*range(0, 5000, 200)), "c6_requirement_matrix")
    assert "FN-001" in set(got.feature) and f"FN-{len(got)}" in set(got.feature) and len(got) > 1000


@pytest.mark.parametrize("name", ["u2_batch_nodes", "u2_batch_edges", "u2_batch_report"])
def test_batches_of_files_numbered_beyond_a_million(spark, copies, name):
    assert len(same(spark, copies(0, 1000000), name))


def test_indexes_of_documents_match_pairs(spark):
    rng = random.Random(7)
    docs = [(f"d{i}", rng.choice(["k1", "k2", "k3", None]), rng.choice(["a", "b", None])) for i in range(60)] + [("d99", "k9", "a")]
    got = {tuple(r) for r in documents.document_index(spark.createDataFrame(docs, "doc string, key string, methodology string")).collect()}
    met = {d: [e for e, l, n in docs if k and l == k and m and n and m != n] for d, k, m in docs}
    assert got == {(d, len(v), min(v)) for d, v in met.items() if v}


def test_candidate_routes_match_pairs(spark):
    rng = random.Random(8)
    words = lambda: [rng.choice("abc") for _ in range(rng.randrange(4))]
    pages, routes = [(f"p{i}", rng.choice("xy"), words()) for i in range(40)], [(f"r{i}", rng.choice("xy"), words()) for i in range(8)]
    got = {tuple(r) for r in documents.candidate_routes(spark.createDataFrame(pages, "page string, dir string, tokens array<string>"), spark.createDataFrame(routes, "route string, dir string, tokens array<string>")).collect()}
    want = set()
    for page, folder, mine in pages:
        common = {r: len(set(mine) & set(w)) for r, f, w in routes if f == folder}
        most = [r for r, n in common.items() if n and n == max(common.values())]
        if len(most) == 1:
            want.add((page, most[0], common[most[0]]))
    assert got == want and want


def test_calls_match_pairs(spark):
    rng = random.Random(9)
    functions = [(f"f{i:02}", f"file{rng.randrange(12)}", rng.choice(["Or", "Order", "OrderLine", "Item", "", None]), rng.choice("mnop")) for i in range(24)] + [("f99", "file0", "Item", "only")]
    calls = [(i, f"file{rng.randrange(12)}", rng.choice([None, "order", "OrderLineX", "o", "item", "zz", ""]), rng.choice(["m", "n", "o", "p", "only", "none"])) for i in range(150)]
    imports = [(f"file{rng.randrange(12)}", f"file{rng.randrange(12)}") for _ in range(30)]
    make = spark.createDataFrame
    got = resolve.resolve_calls(make(calls, "call long, file string, receiver string, name string"), make(functions, "fn string, file string, cls string, name string"), make(imports, "file string, target string")).collect()
    want = {}
    for call, file, receiver, name in calls:
        met = [(fn, f, c) for fn, f, c, n in functions if n == name]
        if not met:
            want[call] = (None, "unknown")
        elif receiver is not None:
            low = receiver.lower()
            size = {fn: min(len(c), len(low)) for fn, _, c in met if c is not None and (c.lower().startswith(low) or low.startswith(c.lower()))}
            top = [fn for fn, n in size.items() if n == max(size.values())]
            want[call] = (top[0], "strong") if len(top) == 1 else (None, "ambiguous" if top else "weak")
        else:
            near = [fn for fn, f, _ in met if (file, f) in imports]
            want[call] = (met[0][0], "unique") if len(met) == 1 else (near[0], "imported") if len(near) == 1 else (None, "ambiguous")
    assert {r.call: (r.fn, r.outcome) for r in got} == want


def test_no_join_of_whole_groups(spark):
    """Groups of equal keys grow with the table, so that a join of them would make pairs of their rows."""
    n = 20000
    files = spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("doc"), F.lit("k").alias("key"), (F.col("id") % 2).cast("string").alias("methodology"))
    start = time.time()
    assert documents.document_index(files).agg(F.sum("links")).first()[0] == n * n // 2
    routes = files.select(F.col("doc").alias("route"), F.lit("d").alias("dir"), F.array("methodology").alias("tokens"))
    assert documents.candidate_routes(routes.withColumnRenamed("route", "page"), routes).count() == 0
    functions = files.select(F.col("doc").alias("fn"), F.col("doc").alias("file"), F.lit("Order").alias("cls"), F.lit("m").alias("name"))
    calls = files.select(F.col("doc").alias("call"), F.col("doc").alias("file"), F.lit("ord").alias("receiver"), F.lit("m").alias("name"))
    assert resolve.resolve_calls(calls, functions, functions.select("file", F.col("file").alias("target"))).where("outcome = 'ambiguous'").count() == n
    assert time.time() - start < 60  # 400 million pairs, three times over, take minutes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_are_not_built_in_the_driver(spark):
    make = spark.createDataFrame
    files = make([("src/a/One.java",), ("src/b/Two.java",)], "path string")
    entries = make([("e1", "b1#run"), ("e2", "b2"), ("e3", "gone"), ("e4", None)], "entry string, handler string")
    beans = make([("b1", "a.One", None, None), ("b2", "x.MethodInvokingJobDetailFactoryBean", "b1", None)], "bean string, class string, target string, job string")
    found = lookups.resolve_handlers(entries, beans, files)
    assert "BroadcastExchange" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {("e1", "a.One", "src/a/One.java"), ("e2", "a.One", "src/a/One.java"), ("e3", None, None), ("e4", None, None)}
    needles, hays = make([("n", "bc")], "needle_id string, needle string"), make([("h", "abcd")], "hay_id string, hay string")
    met = knowledge.containment(needles, hays)
    assert "BroadcastExchange" not in plan(met) and [tuple(r) for r in met.collect()] == [("n", "h")]


def test_runs_of_long_needles_tell_alike_texts_apart(spark):
    n = 30000
    hays = spark.range(n).select(F.col("id").alias("hay_id"), F.format_string("n%08d", F.col("id") * 3001).alias("hay"))
    got = knowledge.containment(hays.toDF("needle_id", "needle"), hays)
    assert got.count() == n and got.where("needle_id <> hay_id").isEmpty()


def test_a_row_holds_the_bits_of_many_roots(spark, monkeypatch):
    rng = random.Random(13)
    pairs = [(f"f{rng.randrange(200)}", f"f{rng.randrange(200)}") for _ in range(600)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    names = [f"f{i}" for i in range(150)] + ["alone"]
    roots = spark.createDataFrame([(r,) for r in names], "root string")
    two = {r: {r} | {t for s, t in pairs if s in {r} | {t for s, t in pairs if s == r}} for r in names}
    held, _, _, words = graph._reached_bits(edges, roots, 2)
    assert len(words) == 3 and held.count() == held.select("id", "depth").distinct().count()
    monkeypatch.setattr(graph, "BLOCK_WORDS", 1)  # three blocks of 64 roots
    want = {(r, len(two[r] | {t for s, t in pairs if s == r}), len(two[r] | {t for s, t in pairs if s == r}) - 1) for r in names}
    assert {tuple(r) for r in graph.reach_counts(edges, roots, 2).collect()} == want


def test_long_ways_take_few_rounds(spark, monkeypatch):
    """Two rings, one of them with a tail and a way back: as many rounds as their length would be hundreds."""
    rounds = []
    kept = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: rounds.append(name) or kept(df, name))
    ways = [(i, (i + 1) % 300) for i in range(300)] + [(i, 1000 + (i + 1) % 45) for i in (7, 200)] + [(1000 + i, 1000 + (i + 1) % 45) for i in range(45)]
    starts = spark.createDataFrame([("a", 3), ("b", 1011), ("c", 5000)], "root string, node long")
    steps = spark.createDataFrame(ways, "node long, next long")
    got = [tuple(r) for r in graph.strides(starts, steps).collect()]
    small = {("b", 1000 + i) for i in range(45)} | {("a", 1000 + i) for i in range(45)} | {("c", 5000)}
    assert set(got) == small | {("a", i) for i in range(300)} and len(got) == len(set(got)) and len(rounds) < 40


def test_counts_of_long_traces(spark):
    rows_ = [(f"F{i:03}", "m", f"F{i + 1:03}", "m", i) for i in range(120)] + [("F120", "m", "F000", "n", 120)]
    calls = spark.createDataFrame(rows_, "caller_file string, caller_method string, callee_file string, callee_method string, seq long")
    flows = spark.createDataFrame([("f", "F000", "m", True), ("g", "F117", "m", True)], "flow string, root string, method string, declared boolean")
    got = sorted(tuple(r) for r in traces.traced_steps(flows, calls, spark.createDataFrame([], "root string, path string"), cap=3).select("flow", "place", "path", "dropped").collect())
    assert got == [("f", 1, "F000", 118), ("f", 2, "F001", 118), ("f", 3, "F002", 118), ("g", 1, "F117", 2), ("g", 2, "F118", 2), ("g", 3, "F119", 2)]


def test_keys_match_pairs(spark):
    rng = random.Random(19)
    some = lambda n: [(rng.choice(["a", "b", "c", "d", None]), rng.choice(["x", "X", "y", "z", "w", None]), rng.choice(["int", "text", None])) for _ in range(n)]
    for n in (6, 12):
        columns, keys = some(14), some(n)
        make = lambda rows_: spark.createDataFrame(rows_, "tbl string, col string, type string")
        met = {}
        for tbl, col, kind in columns:
            for parent, key, other in keys:
                if None not in (tbl, col, kind, parent, key) and kind == other and col.lower() == key.lower() and tbl != parent:
                    met.setdefault((tbl, col), []).append(parent)
        one = {k: v[0] for k, v in met.items() if len(v) == 1}
        pairs = {(tbl, parent) for (tbl, _), parent in one.items()}
        want = {(tbl, col, parent) for (tbl, col), parent in one.items() if (parent, tbl) not in pairs or tbl < parent}
        assert {tuple(r) for r in joins.infer_keys(make(columns), make(keys)).collect()} == want


def test_rows_alike_do_not_meet_one_by_one(spark):
    n = 20000
    t = spark.range(n).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tbl"), F.lit("k").alias("col"), F.lit("int").alias("type"))
    start = time.time()
    assert joins.infer_keys(t, t).count() == 0
    missing = spark.range(n).select("id", F.concat(F.lit("/shop/orderList"), F.lit(".do?x="), F.col("id").cast("string")).alias("url"), F.lit("http-404").alias("reason"))
    routes = spark.range(n).select(F.col("id").alias("seq"), F.lit("/shop/orderListView.do").alias("path"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("handler"))
    found = triage.triage_missing(missing, routes)
    assert found.where("class = 'dead-menu' and route is null").count() == n
    found = triage.triage_missing(missing, routes.where("seq = 7"))
    assert found.where("class = 'stale-url' and handler = 'h7'").count() == n
    assert time.time() - start < 60


def test_accesses_of_a_table_are_not_brought_together(spark):
    lines = spark.createDataFrame([(1, 1, "select * from A join b"), (1, 2, "delete from a"), (2, 1, "insert into c"), (1, 3, "SELECT 1 FROM a")], "file long, line_no long, line string")
    found = extract.sql_accesses(lines, spark.createDataFrame([("A",), ("a",), ("B",)], "tbl string"))
    assert "hashpartitioning(tbl" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, "a", "R", 1), (1, "b", "R", 1), (1, "a", "D", 2)}


def test_a_batch_reads_nothing_of_the_graph(spark):
    """What a batch writes does not grow with the graph; a stream longer than its graph is merged into it."""
    make = spark.createDataFrame
    n = spark.range(3000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("f"), (F.col("id") % 50).cast("string")).alias("file_path"))
    e = n.select(F.col("id").alias("source"), F.lit("n7").alias("target"))
    store = graphs.GraphStore(spark, n, e, buckets=4)
    store.apply(make([("f3",)], "file_path string"), make([("x", "f3")], n.schema), make([("x", "n8")], e.schema), 0)
    assert store.edges().count() == 2941 and store.nodes().count() == 2941 and store.bases == [-1] and store.held[0] < 8000
    store.held[0] = 1 << 30  # more than the base
    store.apply(make([("f7",)], "file_path string"), make([("y", "f9")], n.schema), make([("y", "n9")], e.schema), 1)
    assert store.bases == [-1, 0] and store.nodes().count() == 2882
    assert {tuple(r) for r in store.edges().collect()} == {("x", "n8"), ("y", "n9")}


def test_stream_on_copies(spark, copies):
    made = copies(0, 200, 400)
    for name in ("t1_stream_nodes", "t1_stream_edges"):
        same(spark, made, name)


def test_communities_go_over_numbers(spark, monkeypatch):
    """Rounds carry numbers instead of ids, and choose as a plain search over the ids does."""
    kept, stored = graph.materialize, {}
    monkeypatch.setattr(graph, "materialize", lambda df, name: stored.setdefault(name, dict(df.dtypes)) and None or kept(df, name))
    rng = random.Random(24)
    pairs = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(150)}
    edges = spark.createDataFrame(sorted(pairs), "source string, target string")
    got = dict(tuple(r) for r in graph.communities(edges).collect())
    assert "string" not in stored["undirected"].values() and "string" not in stored["labels"].values()
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    turn = {r.id: r.turn for r in spark.createDataFrame([(i,) for i in near], "id string").select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("turn")).collect()}
    label, total = {i: i for i in near}, sum(map(len, near.values()))
    for r in range(8):
        mass = {}
        for i, c in label.items():
            mass[c] = mass.get(c, 0) + len(near[i])
        moved = dict(label)
        for i in near:
            if turn[i] == r % 2:
                links = [label[j] for j in near[i]]
                gain = lambda c: round(links.count(c) - len(near[i]) * (mass[c] - (len(near[i]) if c == label[i] else 0)) / total, 9)  # noqa: B023, E731
                moved[i] = min((-gain(c), c) for c in links)[1]
        label = moved
    assert got == label


@pytest.mark.parametrize("name", ["a3_churn", "a5_module_rollup", "j13_first_candidate", "j15_suffixes", "j16_unique_name", "q3_requirement_diagnostics", "w8_step_weight", "x9_policy_items"])
def test_a_task_holds_so_many_rows(spark, copies, monkeypatch, name):
    monkeypatch.setattr(shared, "TASK_ROWS", 256)
    made = copies(0, 200, 400)
    assert "REPARTITION_BY_NUM" in plan(catalog.QUERIES[name](spark, made[0]))
    same(spark, made, name)


def test_suffixes_and_candidates_are_not_built_in_the_driver(spark):
    make = spark.createDataFrame
    files = make([("src/a/One.java",), ("src/b/Two.java",)], "path string")
    found = joins.unique_name(make([("a.One",), ("x.Two",), ("gone",)], "name string"), files)
    assert "BroadcastExchange" not in plan(found) and {tuple(r) for r in found.collect()} == {("a.One", "src/a/One.java"), ("x.Two", "src/b/Two.java"), ("gone", None)}
    found = impacts.resolve_suffixes(make([("b.Two",), ("gone",)], "name string"), files)
    assert "BroadcastExchange" not in plan(found) and {tuple(r) for r in found.collect()} == {("b.Two", 1, "src/b/Two.java"), ("gone", 0, None)}
    found = joins.first_candidate(make([("o", 1, "x"), ("o", 2, "src/a/One.java")], "owner string, pos int, path string"), files, "owner", "path")
    assert "BroadcastExchange" not in plan(found) and [tuple(r) for r in found.collect()] == [("o", "src/a/One.java")]


@pytest.mark.parametrize("module, operator, name", [(windows, "cap_neighbours", "k4_cap_neighbours"), (graph, "key_component", "g12_key_component"), (graph, "cyclic_core", "g9_cyclic_core")])
def test_file_edges_go_by_numbers(spark, sf_dir, monkeypatch, module, operator, name):
    seen, plain = [], getattr(module, operator)
    monkeypatch.setattr(module, operator, lambda edges, *args, **more: seen.append(edges) or plain(edges, *args, **more))
    got = catalog.QUERIES[name](spark, sf_dir)
    assert {dict(seen[0].dtypes)[c] for c in ("source", "target")} == {"bigint"}
    assert {t for _, t in got.drop("degree", "place").dtypes} == {"string"}


def test_paths_of_repeated_files_have_one_number(spark, copies):
    folder, _ = copies(0, 0)
    edges, names = Tables(spark, folder).numbered_edges()
    files, plain = Tables(spark, folder).files, Tables(spark, folder).file_edges
    assert names.count() == names.select("path").distinct().count() == files.select("path").distinct().count()
    back = named(edges, names, "source", "target").select("source", "target", "kind", "line", "seq")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, plain.select("source", "target", "kind", "line", "seq").collect()))
    assert [r.path for r in names.orderBy("number").collect()] == sorted(r.path for r in names.collect())


def test_risk_reads_its_programs_once(spark):
    read = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: read.add(1) or x, "long").asNondeterministic()
    programs = spark.range(200).select(F.concat(F.lit("p"), "id").alias("path"), count("id").alias("loc"), *[(F.col("id") % k).alias(m) for k, m in ((7, "complexity"), (5, "churn"), (11, "fan_in"), (3, "fan_out"))])
    assert reports.risk(programs).count() == 200
    assert read.value == 200


def test_cycles_of_one_and_two_need_no_components(spark, monkeypatch):
    edges = lambda *pairs: spark.createDataFrame(pairs, "source string, target string")
    assert traces.has_cycle(edges(("a", "b"), ("b", "c"), ("c", "a")))
    assert not traces.has_cycle(edges(("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", None), (None, "a")))
    assert not traces.has_cycle(edges(("a", "b")).limit(0))
    monkeypatch.setattr(traces, "strong_components", None)
    assert traces.has_cycle(edges(("a", "b"), ("c", "c")))
    assert traces.has_cycle(edges(("a", "b"), ("b", "c"), ("c", "b")))


def test_node_context_deals_by_the_edges(spark, sf_dir, monkeypatch):
    dealt, plain = [], measures.spread
    monkeypatch.setattr(measures, "spread", lambda df, rows, *keys: dealt.append((rows, keys)) or plain(df, rows, *keys))
    t = Tables(spark, sf_dir)
    nodes, edges, _ = measures._nested(t)
    catalog.QUERIES["g6_node_context"](spark, sf_dir)
    assert {(edges.count(), ("source",)), (edges.count(), ("other",)), (nodes.select("id").distinct().count(), ("id",))} <= set(dealt)


@pytest.mark.parametrize("name", ["g4_reach_counts", "c19_hotspots", "c4_batch_report", "g2_slices", "g2_ownership"])
def test_bits_of_roots_are_not_shuffled(spark, copies, monkeypatch, name):
    made = copies(0, 200, 400, 600)
    monkeypatch.setattr(graph, "_reached_bits", None)
    assert len(same(spark, made, name)) > 1


def test_sweeps_match_rounds(spark, monkeypatch):
    rng = random.Random(31)
    make = spark.createDataFrame
    names = make([(i + 1, f"f{i:03}") for i in range(200)], "number long, path string")
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(500)] + [(0, 1)] * 9
    by_name, by_number = make([(f"f{a:03}", f"f{b:03}") for a, b in pairs], "source string, target string"), make([(a + 1, b + 1) for a, b in pairs] + [(None, 3), (3, None)], "source long, target long")
    roots = make([(f"f{i:03}",) for i in range(150)] + [("f007",), ("alone",), (None,)], "root string")
    got = lambda d: sorted(map(tuple, d.collect()))
    for words, cap in ((1, 3), (16, 12)):
        monkeypatch.setattr(sweeps, "SWEEP_WORDS", words)
        monkeypatch.setattr(sweeps, "BATCH_ROWS", 16 * words)
        assert got(graph.reach_counts(by_number, roots, cap, names)) == got(graph.reach_counts(by_name, roots, cap))
        pairs_ = got(graph.slices(by_number, roots, cap, names))
        assert pairs_ == got(graph.slices(by_name, roots, cap)) and len(pairs_) == len(set(pairs_))
        files = make([(f"f{i:03}",) for i in range(200)] + [("f003",), ("other",), (None,)], "path string")
        assert got(graph.owned(files, by_number, roots, names, cap).fillna("-")) == got(graph.ownership(files, graph.slices(by_name, roots, cap)).fillna("-"))
    # more nodes than a task has room for
    monkeypatch.setattr(sweeps, "SWEEP_BYTES", 800)
    assert got(graph.reach_counts(by_number, roots, 3, names)) == got(graph.reach_counts(by_name, roots, 3))


def test_batches_merge_edges_by_ids(spark):
    make = spark.createDataFrame
    nodes = make([(1, "file:file:a", "file", "a", "a", "LOW"), (2, "b", "class", "B", "b", "odd"), (3, "file:a", "file", "z", "a", None), (4, "", "file", "n", None, None), (5, None, "widget", "n", None, None)], "seq long, id string, type string, name string, path string, complexity string")
    edges = make([(1, "file:file:a", "b", "call", "Both", "0.2"), (2, "file:a", "class:b:B", "call", "mutual", "0.7"), (3, "b", "b", "call", None, "x"), (4, None, "b", "call", None, None), (5, "b", "gone", "call", None, None), (6, "gone", None, "call", None, None)], "seq long, source string, target string, type string, direction string, weight string")
    last, out, report = batches.merge_batches(nodes, edges)
    assert {tuple(r) for r in last.collect()} == {("file:a", "file", "z", "a", "moderate"), ("class:b:B", "class", "B", "b", "moderate")}
    assert {tuple(r) for r in out.collect()} == {("file:a", "class:b:B", "call", "bidirectional", 0.7), ("class:b:B", "class:b:B", "call", "forward", None)}
    got = {(r.part, r.pattern): r.n for r in report.collect()}
    assert [got[k] for k in (("fixed", "edge references rewritten"), ("open", "edge without source"), ("open", "edge without target"), ("fixed", "duplicate node ids removed"), ("open", "node without id"))] == [4, 2, 1, 1, 2]


@pytest.mark.parametrize("name", ["u2_batch_edges", "u2_batch_nodes", "u2_batch_report"])
def test_batches_store_no_edges_by_ids(spark, copies, monkeypatch, name):
    kept, stored = batches.materialize, {}
    monkeypatch.setattr(batches, "materialize", lambda df, name: stored.setdefault(name, set(df.columns)) and None or kept(df, name))
    same(spark, copies(0, 200), name)
    assert not any({"source", "target"} & columns for columns in stored.values()) and (stored or name == "u2_batch_nodes")


def test_walks_match_strides(spark, monkeypatch):
    rng = random.Random(37)
    make = spark.createDataFrame
    ways = [(f"F{rng.randrange(30):02}", f"m{rng.randrange(2)}", f"F{rng.randrange(30):02}", f"m{rng.randrange(2)}") for _ in range(80)] + [("F00", "m0", None, "x"), (None, "m0", "F01", "m1")]
    calls = make([(*w, i) for i, w in enumerate(ways)], "caller_file string, caller_method string, callee_file string, callee_method string, seq long")
    roots = make([(f"r{i}", f"F{i:02}", f"m{i % 2}") for i in range(30)] + [("r3", "F20", "m1"), ("none", "G", "m0")], "root string, file string, method string")
    monkeypatch.setattr(walks, "PAIRS", 64)
    monkeypatch.setattr(walks, "TASK_ROOTS", 8)
    got = sorted(map(tuple, traces.method_reach(calls, roots).collect()))
    flows = make([(f"r{i}", f"F{i:02}", f"m{i % 2}", i % 3 > 0) for i in range(30)] + [("none", "G", "m0", False), ("null", "G", None, True)], "flow string, root string, method string, declared boolean")
    reached = make([("G", "F07"), ("F03", "F04")], "root string, path string")
    steps = [sorted(map(tuple, traces.traced_steps(flows, calls, reached, cap).collect())) for cap in (3, 8)]
    monkeypatch.setattr(walks, "walkable", lambda *_: False)
    assert steps == [sorted(map(tuple, traces.traced_steps(flows, calls, reached, cap).collect())) for cap in (3, 8)]
    assert got == sorted(map(tuple, traces.method_reach(calls, roots).collect())) and len(got) > 64


@pytest.mark.parametrize("name", ["g3_method_pairs", "g13_traced_steps", "g13_step_calls"])
def test_calls_are_walked_without_rounds(spark, copies, monkeypatch, name):
    made = copies(0, 200, 400)
    monkeypatch.setattr(traces, "strides", None)
    assert len(same(spark, made, name))
