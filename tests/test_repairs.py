"""Literal cases and brute force: validation, traces, knowledge, markup, budgets, lookups, streams, analyzers."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as fn
from factloom.operators import aggregates, analyzers, classes, knowledge, listings, lookups, markup, measures, search, traces, validation, windows
from factloom.streaming import approvals, graphs, upkeep


def test_weight_without_a_number_is_a_half(spark):
    d = spark.createDataFrame([(None,), ("x",), ("NaN",), ("0.25",), ("7",), ("-1",)], "w string")
    assert [r[0] for r in d.select(fn.weight(F.col("w"))).collect()] == [0.5, 0.5, 0.5, 0.25, 1.0, 0.0]


def test_plans_keep_nulls_and_refuse_unknown_keys(spark):
    plan = spark.createDataFrame([("a", "r1", None), (None, "r2", None), ("b", "r3", None)], "domain string, root string, grp string")
    rows = lambda ops: {r.root: (r.domain, r.grp, r.alias_keys) for r in listings.apply_plan(plan, ops).collect()}
    assert rows([("exclude", "a")]) == {"r2": (None, None, ""), "r3": ("b", None, "")}
    assert rows([("merge", ("a",), "b"), ("rename", "b", "c"), ("group", "g", ("c",))]) == {"r1": ("c", "g", "a,b"), "r2": (None, None, ""), "r3": ("c", "g", "a,b")}
    for bad in (("exclude", "z"), ("merge", ("a",), "a"), ("move", "nowhere", "a"), ("ungroup", "g"), ("rename", "a", "b")):
        with pytest.raises(ValueError):
            rows([bad])


def test_grades_keep_rows_without_a_score(spark):
    d = spark.createDataFrame([(i, float(i) if i else None) for i in range(11)], "id int, s double")
    got = {r.id: r.grade for r in windows.grade_bands(d, "s").collect()}
    assert got == {0: None, 10: "high", 9: "medium", 8: "medium"} | {i: "low" for i in range(1, 8)}


def test_majority_wants_half(spark):
    v = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", "a"), ("t", "b"), ("t", "c")], "screen string, key string")
    assert [tuple(r) for r in aggregates.majority(v).collect()] == [("s", "a", 2)]


def components(edges):
    """Strongly connected components by closure."""
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for i in nodes:
            if k in reach[i]:
                reach[i] |= reach[k]
    return {(max(m for m in nodes if m in reach[n] and n in reach[m]), n) for n in nodes if n in reach[n]}


def test_components_match_brute_force(spark):
    rng = random.Random(4)
    cases = [[("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("y", "c"), ("c", "d"), ("d", "c")], [("a", "a"), ("a", "b")], [("a", "b"), ("b", "c")]]
    cases += [[(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(rng.choice([10, 18]))] for _ in range(3)]
    for edges in cases:
        d = spark.createDataFrame(edges, "source string, target string")
        assert {tuple(r) for r in traces.strong_components(d).collect()} == components(edges)
    assert traces.strong_components(d.limit(0)).collect() == []


def calls(spark, *rows):
    return spark.createDataFrame([(a, b, c, d, i) for i, (a, b, c, d) in enumerate(rows)], "caller_file string, caller_method string, callee_file string, callee_method string, seq long")


def test_method_reach_stops_at_externals_and_admits_a_root_called_back(spark):
    c = calls(spark, ("A", "go", "B", "x"), ("B", "x", None, "log"), ("B", "x", "C", "y"), ("C", "y", "A", "go"), ("C", "z", "D", "w"))
    roots = spark.createDataFrame([("r", "A", "go"), ("q", "C", "z")], "root string, file string, method string")
    got = {tuple(r) for r in traces.method_reach(c, roots).collect()}
    assert got == {("r", "B", "x"), ("r", "C", "y"), ("r", "A", "go"), ("q", "D", "w")}


def test_traced_steps_follow_discovery_and_fall_back(spark):
    c = calls(spark, ("A", "go", "C", "x"), ("A", "go", "B", "y"), ("B", "y", "E", "p"), ("C", "x", "D", "q"), ("D", "q", "A", "go"), ("A", "go", "C", "x2"))
    flows = spark.createDataFrame([("f", "A", "go", True), ("g", "Z", "alone", True), ("h", "Z", "lost", False), ("i", "Z", None, None)], "flow string, root string, method string, declared boolean")
    reached = spark.createDataFrame([("Z", "m"), ("Z", "k"), ("Z", "Z")], "root string, path string")
    steps = {}
    for r in traces.traced_steps(flows, c, reached, cap=4).collect():
        steps.setdefault(r.flow, []).append((r.place, r.path, r.weight, r.dropped))
    assert [p for _, p, _, _ in sorted(steps["f"])] == ["A", "C", "B", "D"] and {d for *_, d in steps["f"]} == {1}
    assert sorted(steps["g"]) == [(1, "Z", 1.0, 0)]
    assert sorted(steps["h"]) == [(1, "Z", 0.3333, 0), (2, "k", 0.6667, 0), (3, "m", 1.0, 0)] == sorted(steps["i"])
    edges = spark.createDataFrame([("A", "C"), ("A", "C"), ("C", "E"), ("A", "A")], "source string, target string")
    d = spark.createDataFrame([("f", "A"), ("f", "C")], "flow string, path string")
    assert [tuple(r) for r in traces.step_calls(d, edges, c).collect()] == [("f", "A", "C", "x → x2")]


def test_repairs_of_a_graph(spark):
    nodes = spark.createDataFrame(
        [(1, "a", "FUNC", "A", "HARD", ["t"], "s"), (2, "b", None, "B", None, None, None), (3, "c", "widget", "C", "low", [], "s"), (4, None, "file", "D", "low", [], "s")],
        "seq long, id string, type string, name string, complexity string, tags array<string>, summary string",
    )
    edges = spark.createDataFrame(
        [(1, "a", "b", "INVOKES", "Both", "1.5x"), (2, "a", "b", None, None, None), (3, "a", "c", "calls", "to", "0.5"), (4, "z", "c", "calls", "forward", "bad"), (5, "a", "b", "odd", "forward", "-1")],
        "seq long, source string, target string, type string, direction string, weight string",
    )
    n, e, issues = validation.repair_graph(nodes, edges)
    assert {(r.id, r.type, r.complexity, r.summary) for r in n.collect()} == {("a", "function", "complex", "s"), ("b", "file", "moderate", "B")}
    assert {(r.seq, r.type, r.direction, r.weight) for r in e.collect()} == {(1, "calls", "bidirectional", 1.0), (2, "depends_on", "forward", 0.5)}
    found = {(r.level, r.category, r.part, r.seq, r.field) for r in issues.collect()}
    assert {("dropped", "invalid-node", "nodes", 3, ""), ("dropped", "invalid-node", "nodes", 4, ""), ("dropped", "invalid-edge", "edges", 5, ""), ("dropped", "invalid-reference", "edges", 3, "target"), ("dropped", "invalid-reference", "edges", 4, "source")} == {f for f in found if f[0] == "dropped"}
    assert ("auto-corrected", "alias", "edges", 1, "direction") in found and ("auto-corrected", "out-of-range", "edges", 1, "weight") in found and ("auto-corrected", "type-coercion", "edges", 4, "weight") in found
    assert [r.category for r in validation.repair_graph(nodes.where("seq > 2"), edges)[2].collect() if r.level == "fatal"] == ["no-valid-nodes"]
    # numbers need no coercion
    assert not [r for r in validation.repair_graph(nodes, edges.withColumn("weight", F.lit(0.5)))[2].collect() if r.field == "weight"]


def test_containment_matches_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    needles = [(f"n{i}", word(rng.randrange(0, 6))) for i in range(60)] + [("nul", None), ("x", "zzz")]
    hays = [(f"h{i}", word(rng.randrange(0, 12))) for i in range(60)] + [("nul", None)]
    got = knowledge.containment(spark.createDataFrame(needles, "needle_id string, needle string"), spark.createDataFrame(hays, "hay_id string, hay string"))
    assert {tuple(r) for r in got.collect()} == {(a, b) for a, n in needles for b, h in hays if n and h and n in h}


def test_yaml_levels(spark):
    text = "# c\na:\n  b:\n    c: 'x'\n  d: y\ne : 1\n- item\n---\nf:\nlist:\n  - z\n  g: \"q\""
    lines = spark.createDataFrame([("f.yml", i, x) for i, x in enumerate(text.split("\n"), 1)] + [("g.yml", 1, None), ("g.yml", 2, "a.b.c: later")], "file string, line_no long, line string")
    got = {(r.file, r.line_no): (r.key, r.value) for r in markup.yaml_properties(lines).collect()}
    assert got == {("f.yml", 4): ("a.b.c", "x"), ("f.yml", 5): ("a.d", "y"), ("f.yml", 6): ("e", "1"), ("f.yml", 12): ("list.g", "q"), ("g.yml", 2): ("a.b.c", "later")}
    index = markup.property_index(spark.createDataFrame([("a.properties", 1, "a.d = first"), ("a.properties", 2, "! a.x=1"), ("z.properties", 1, "e: 2")], "file string, line_no long, line string"), lines)
    assert {r.key: (r.value, r.file) for r in index.collect()} == {"a.b.c": ("x", "f.yml"), "a.d": ("first", "a.properties"), "e": ("1", "f.yml"), "list.g": ("q", "f.yml")}


def test_report_parts(spark):
    text = "---\nrunId: 7\nservice: s:1\n---\n## Cause\n```\n## no\n```\nfirst\n\n## Cause\nagain"
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(text.split("\n"), 1)] + [("bare", 1, "text")], "file string, line_no long, line string")
    assert {(r.key, r.value) for r in markup.front_matter(lines).collect()} == {("runId", "7"), ("service", "s:1")}
    assert [(r.title, r.text) for r in markup.titled_sections(lines).collect()] == [("Cause", "```\n## no\n```\nfirst")]
    got = {r.file: (r.parseable, r.reasons) for r in markup.report_verdicts(lines, section="Cause").collect()}
    assert got == {"r": (True, ""), "bare": (False, "no-front-matter,no-section")}


def filled(demand, floor, weight, available):
    need = [min(d, f) for d, f in zip(demand, floor)]
    if sum(need) > available and sum(need):
        return [n * available // sum(need) for n in need]
    got, left = need, available - sum(need)
    while True:
        hungry = [i for i in range(len(got)) if demand[i] > got[i]]
        if not hungry or left <= 0:
            return got
        w = sum(weight[i] for i in hungry)
        take = [min(left * weight[i] // w, demand[i] - got[i]) if i in hungry else 0 for i in range(len(got))]
        if not sum(take):
            return got
        got, left = [a + b for a, b in zip(got, take)], left - sum(take)


def test_budgets_match_brute_force(spark):
    rng = random.Random(6)
    cases = [([rng.randrange(0, 200) for _ in range(5)], [rng.randrange(0, 60) for _ in range(5)], [rng.randrange(1, 5) for _ in range(5)], rng.randrange(0, 600)) for _ in range(40)]
    rows = [(f"r{i}", f"a{k}", d[k], f[k], w[k]) for i, (d, f, w, _) in enumerate(cases) for k in range(5)]
    got = search.fill_budget(spark.createDataFrame(rows, "request string, axis string, demand long, floor long, weight long"), spark.createDataFrame([(f"r{i}", c[3]) for i, c in enumerate(cases)], "request string, available long"))
    units = {(r.request, r.axis): r.units for r in got.collect()}
    for i, (d, f, w, a) in enumerate(cases):
        assert [units[(f"r{i}", f"a{k}")] for k in range(5)] == filled(d, f, w, a)


def test_stream_of_batches_equals_upserts(spark, tmp_path):
    """A graph kept up batch by batch, one batch run twice, against whole-table upserts."""
    rng = random.Random(1)
    nodes = [(f"n{i}", f"f{i % 9}" if i % 7 else None) for i in range(40)]
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(80)]
    n = spark.createDataFrame(nodes, "id string, file_path string")
    e = spark.createDataFrame(edges, "source string, target string")
    store = graphs.GraphStore(spark, n, e, buckets=4)
    for number in range(4):
        changed = spark.createDataFrame([(f"f{rng.randrange(10)}",) for _ in range(2)], "file_path string")
        fresh = [(f"b{number}{i}", f"f{rng.randrange(10)}") for i in range(2)]
        new_nodes = spark.createDataFrame(fresh, "id string, file_path string")
        new_edges = spark.createDataFrame([(fresh[0][0], "n7"), (f"n{rng.randrange(40)}", fresh[1][0])], "source string, target string")
        store.apply(changed, new_nodes, new_edges, number)
        if number == 2:
            store.apply(changed, new_nodes, new_edges, number)
        n, e = upkeep.upsert(n, e, changed, new_nodes, new_edges)
        assert sorted(map(tuple, store.nodes().collect()), key=str) == sorted(map(tuple, n.select("id", "file_path").collect()), key=str)
        assert sorted(map(tuple, store.edges().collect())) == sorted(map(tuple, e.select("source", "target").collect()))
        n, e = spark.createDataFrame(n.collect(), n.schema), spark.createDataFrame(e.collect(), e.schema)


def test_approval_gate(spark):
    claims = spark.createDataFrame([("a", "CONFIRMED", 1), ("b", "CONFIRMED", 0), ("c", "INFERRED", 0), ("c", "INFERRED", 0), ("c", "CONFIRMED", 1), ("d", "INFERRED", 0), ("d", "INFERRED", 0), ("d", "INFERRED", 0), ("d", "CONFIRMED", 1), ("d", "CONFIRMED", 2)], "doc string, confidence string, evidence int")
    gate = approvals.evidence_gate(claims)
    assert {r.doc: r.ok for r in gate.collect()} == {"a": True, "b": False, "c": False, "d": True}
    log = [("a", "approve"), ("a", "submit"), ("a", "approve"), ("a", "check"), ("a", "approve"), ("a", "return"), ("b", "submit"), ("b", "approve"), ("b", "submit"), ("z", "submit"), ("z", "approve"), ("z", "check")]
    events = spark.createDataFrame([(d, i, e, f"u{i}") for i, (d, e) in enumerate(log)], "doc string, seq long, event string, by string")
    stale = spark.createDataFrame([("a", 2)], "doc string, n int")
    got = {r.seq: (r.before, r.after, r.approver, r.accepted) for r in approvals.approve_documents(approvals.judged_events(events, gate, stale)).collect()}
    assert got[0] == ("DRAFT", "DRAFT", None, False) and got[2] == ("UNDER_REVIEW", "APPROVED", "u2", True)
    assert got[3] == ("APPROVED", "UNDER_REVIEW", None, True) and got[4] == ("UNDER_REVIEW", "APPROVED", "u4", True) and got[5] == ("APPROVED", "APPROVED", "u4", False)
    assert got[7] == ("UNDER_REVIEW", "RETURNED", None, True) and got[8] == ("RETURNED", "UNDER_REVIEW", None, True)
    assert got[11] == ("APPROVED", "APPROVED", "u10", True)  # nothing stale


def test_analyzers_can_be_added(spark):
    files = spark.createDataFrame([("a.x", "x", "one two"), ("b.py", "python", "def f(:"), ("c.y", "y", "t"), ("d.x", "x", None)], "path string, lang string, text string")
    got = analyzers.analyze(files, analyzers.ANALYZERS | {"x": lambda path, text: ((("word"), w, 1, path) for w in text.split())})
    assert {(r.path, r.seq, r.kind, r.name, r.detail) for r in got.collect()} == {("a.x", 0, "word", "one", "a.x"), ("a.x", 1, "word", "two", "a.x"), ("b.py", 0, "error", "SyntaxError", "")}


def test_secret_carriers_and_languages(spark):
    d = spark.createDataFrame([(p,) for p in ("x/id_rsa.bak", "id_rsa.pub", "a.env.sample", ".env", "keystore.md", "k.keystore.old", "s.key.bak", "Dockerfile.x", "deploy/k8s/a.yml", "m.H")], "path string")
    rows = d.select("path", classes.is_secret_carrier(F.col("path")).alias("s"), classes.language_of(F.col("path")).alias("l"), classes.category_of(F.col("path")).alias("c")).collect()
    assert [r.s for r in rows] == [True, False, False, True, False, True, True, False, False, False]
    assert {r.path: (r.l, r.c) for r in rows if r.path in ("Dockerfile.x", "deploy/k8s/a.yml", "m.H", ".env")} == {"Dockerfile.x": ("dockerfile", "infra"), "deploy/k8s/a.yml": ("yaml", "infra"), "m.H": ("c", "code"), ".env": ("config", "config")}


def test_contained_nodes_come_in_edge_order(spark):
    nodes = spark.createDataFrame([("p", "f", 1), ("a", None, 2), ("b", None, 3), ("c", None, 4)], "id string, file_path string, seq long")
    edges = spark.createDataFrame([("a", "b", "contains", 1), ("p", "a", "contains", 2), ("a", "c", "contains", 3), ("b", "p", "calls", 4)], "source string, target string, kind string, seq long")
    layers = spark.createDataFrame([("l", "c"), ("m", "zz")], "layer string, node_id string")
    changed = spark.createDataFrame([("f",), ("gone",)], "file_path string")
    got = {tuple(r) for r in measures.change_context(nodes, edges, layers, changed).collect()}
    assert got == {("changed", "p"), ("changed", "a"), ("changed", "c"), ("affected", "b"), ("layer", "l"), ("unmapped", "gone")}


def test_annotations(spark):
    row = lambda seq, kind, sel, x, y, w=9, h=9, v=True, d=False: ("s", seq, kind, sel, x, y, w, h, v, d)
    data = [row(1, "field", "b", 5, 3), row(2, "region", "a", 1, 4), row(3, "action", "c", 0, 90), row(4, "field", "tiny", 0, 0, 3), row(5, "field", "hid", 0, 0, v=False), row(6, "field", "b", 0, 0), row(7, None, "n", 0, 0), row(8, "field", "z", 0, 3)]
    d = spark.createDataFrame(data, "screen string, seq int, kind string, selector string, x int, y int, width int, height int, visible boolean, disabled boolean")
    assert {r.selector: r.no for r in lookups.number_annotations(d).collect()} == {"z": 1, "b": 2, "a": 3, "c": 1}


def test_levels_beat_single_moves(spark):
    """Rings of small cliques: levels find the cliques or unions of them, and no worse a division."""
    from factloom.operators import graph, matrices

    ring = [(f"{g:02}-{i}", f"{g:02}-{j}") for g in range(12) for i in range(4) for j in range(i)] + [(f"{g:02}-0", f"{(g + 1) % 12:02}-1") for g in range(12)]
    e = spark.createDataFrame(ring, "source string, target string")
    label = matrices.community_levels(e)
    parts = {}
    for r in label.collect():
        parts.setdefault(r.community, set()).add(r.id)
    assert sum(map(len, parts.values())) == 48 and all(min(p) == c for c, p in parts.items())
    # no clique is cut
    assert all(len({r for r in p if r.startswith(x)}) == 4 for p in parts.values() for x in {r[:2] for r in p})
    assert graph.modularity(e, label).first().modularity > 0.7
    assert matrices.community_levels(e.limit(0)).collect() == []


def test_vector_search_matches_brute_force(spark):
    import math

    rng = random.Random(3)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4 if i % 9 else 3)]) for i in range(60)] + [(60, [0.0] * 4), (61, None), (62, [1.0, 0.0, 0.0, 0.0]), (63, [2.0, 0.0, 0.0, 0.0])]
    queries = [(i, x) for i, x in vectors if i % 7 == 0 or i > 59]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    q = spark.createDataFrame(queries, "query long, q array<double>")

    def cosine(a, b):
        size = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    want = set()
    for k, x in queries:
        near = sorted((round(1 - cosine(x, y), 6), i) for i, y in vectors if x and y and len(x) == len(y) and cosine(x, y) >= 0.1) if x else []
        want |= {(k, i, s, p) for p, (s, i) in enumerate(near[:3], 1)}
    for rows in ((1 << 13, 1 << 10), (7, 3)):
        got = search.semantic_search(v, q, 0.1, 3, *rows)
        assert {(r.query, r.vec_id, round(r.score, 6), r.place) for r in got.collect()} == want
    assert search.semantic_search(v.limit(0), q, 0.1).collect() == []


def test_slices_of_many_roots(spark):
    """More roots than bits of one word, against breadth-first search."""
    from factloom.operators import graph

    rng = random.Random(12)
    edges = [(f"f{rng.randrange(200)}", f"f{rng.randrange(200)}") for _ in range(260)]
    roots = [f"f{i}" for i in range(150)] + ["alone", None]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    want = set()
    for root in roots[:-1]:
        depth, level = {root: 0}, [root]
        for k in range(1, 5):
            level = [b for b in {b for a in level for b in after.get(a, ())} if b not in depth]
            depth |= dict.fromkeys(level, k)
        want |= {(root, p, d) for p, d in depth.items()}
    got = graph.slices(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([(r,) for r in roots] + [("f1",)], "root string"), 4)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert graph.slices(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([], "root string")).collect() == []
