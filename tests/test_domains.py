"""Literal cases of domain candidates, folder groups and screen domains."""

from factloom.operators import domains


def candidates(spark, paths, roots, owned):
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    seeds = spark.createDataFrame([(r, 1) for r in roots], "path string, entries long")
    own = spark.createDataFrame([(p, *owned.get(p, ("unreached", None))) for p in paths], "path string, status string, owners string")
    return {(r.kind, r.path): (r.key, r.note) for r in domains.domain_candidates(files, seeds, own).collect()}


def test_feature_folders_are_keys_and_split_where_prefixes_divide_them(spark):
    web = [f"src/main/java/com/acme/{d}/web/{n}Controller.java" for d, n in (("order", "Order"), ("order", "Cart"), ("stock", "StockList"), ("member", "Member"), ("member", "MemberJoin"))]
    extra = ["src/main/java/com/acme/order/OrderService.java", "src/main/java/com/acme/stock/View.java", "README", "src/main/java/com/acme/member/Join.java"]
    got = candidates(spark, web + extra, web, {extra[0]: ("sole", web[0]), extra[1]: ("sole", web[3]), extra[3]: ("shared", f"{web[0]},{web[3]}"), **{w: ("sole", w) for w in web}})
    # two prefixes halve the order folder's seeds; cart is taken back, since its folder is another root's key
    assert got[("root", web[0])] == ("order", "medium") and got[("root", web[1])] == ("order", "medium")
    assert got[("root", web[2])] == ("stock", "high") and got[("root", web[4])] == ("member", "high")
    assert got[("member", extra[0])] == ("order", "reachability")
    assert got[("ambiguous", extra[1])] == ("member", "stock")
    assert got[("common", extra[3])] == (None, f"{web[0]},{web[3]}")
    assert got[("unresolved", "README")] == (None, None)


def test_one_crowded_folder_falls_back_to_prefixes(spark):
    paths = [f"app/{n}Action.java" for n in ("Order", "Account", "Catalog")] + ["app/OrderView.java"]
    got = candidates(spark, paths, paths[:3], {p: ("sole", p) for p in paths[:3]})
    assert {k: v for k, v in got.items() if k[0] == "root"} == {("root", paths[0]): ("order", "low"), ("root", paths[1]): ("account", "low"), ("root", paths[2]): ("catalog", "low")}
    assert got[("member", paths[3])] == ("order", "prefix")


def test_weak_seeds_are_quarantined_only_if_few(spark):
    strong = [f"m/{d}/{d.title()}Controller{i}.java" for d in ("one", "two", "six") for i in range(3)]
    got = candidates(spark, [*strong, "m/Impl.java", "m/test/xTest.java"], [*strong, "m/Impl.java", "m/test/xTest.java"], {})
    assert got[("quarantined", "m/Impl.java")] == ("impl", "weak-signal")
    assert ("root", "m/test/xTest.java") not in got and ("quarantined", "m/test/xTest.java") not in got


def test_empty_tables(spark):
    assert candidates(spark, [], [], {}) == {}
    assert domains.folder_depth(spark.createDataFrame([], "path string"), 3) is None


def test_folder_depth(spark):
    depth = lambda paths, cap=24: domains.folder_depth(spark.createDataFrame([(p,) for p in paths], "path string"), cap)
    pages = [f"web/jsp/{d}/p{i}.jsp" for d in ("order", "stock") for i in range(3)]
    assert depth(pages) == 2
    # one shallow page does not pull the prefix up
    assert depth([*pages, "web/index.html", None, "bare"]) == 2
    # too many groups: one level less deep
    assert depth([f"web/jsp/d{i}/p.jsp" for i in range(30)], 24) == 1
    assert depth([f"r{i}/p" for i in range(30)], 24) is None


def screens(spark, rows, notes=(), plan=(), owned=(), overrides=()):
    s = spark.createDataFrame(rows, "screen string, jsp string, node string, scenario string")
    make = lambda data, schema: spark.createDataFrame(list(data), schema)
    got = domains.assign_screens(s, make(notes, "screen string, link string, file string"), make(plan, "root string, domain string"), make(owned, "path string, owner string"), make(overrides, "screen string, domain string"))
    return {r.screen: (r.domain, r.method) for r in got.collect()}


def test_screen_tiers(spark):
    plan = [("a/OrderCtl.java", "order"), ("a/StockCtl.java", "stock"), ("a/X.java", "sym.tbm")]
    rows = [
        ("screen:one", None, None, None), ("screen:sym/tbm/list", None, None, None), ("screen:(root)__s_order-done", None, None, None),
        ("screen:h", None, None, None), ("screen:v", None, "file:a/StockCtl.java", None), ("screen:t", None, None, "x.stock"), ("screen:lost", None, None, None),
        ("screen:j", "w/jsp/sym/tbm/v.jsp", None, None),
    ]
    notes = [("screen:h", "/go", "b/Shared.java"), ("screen:h", None, "a/OrderCtl.java"), ("screen:lost", "/go2", "b/Many.java")]
    owned = [("b/Shared.java", "a/StockCtl.java")]
    got = screens(spark, rows, notes, plan, owned, [("screen:one", "forced")])
    assert got["screen:one"] == ("forced", "override")
    assert got["screen:sym/tbm/list"] == ("sym.tbm", "url-folder")
    assert got["screen:(root)__s_order-done"] == ("order", "scenario")
    assert got["screen:h"] == ("order", "handler")  # a direct vote beats one by owners
    assert got["screen:v"] == ("stock", "view-file")
    assert got["screen:t"] == ("stock", "scenario")
    assert got["screen:lost"] == (None, "unassigned")
    assert got["screen:j"] == ("sym.tbm", "view-folder")


def test_common_links_do_not_vote(spark):
    plan = [("a/Home.java", "home"), ("a/Order.java", "order")]
    rows = [(f"screen:s{i}", None, None, None) for i in range(4)]
    notes = [(f"screen:s{i}", "/home", "a/Home.java") for i in range(4)] + [("screen:s0", "/order", "a/Order.java")]
    got = screens(spark, rows, notes, plan)
    assert got["screen:s0"] == ("order", "handler") and got["screen:s1"] == (None, "unassigned")
