"""Domain candidates of a code base, folder groups, and domains of screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.functions import text as fn
from factloom.operators.filters import is_root_ineligible
from factloom.operators.graph import ownership, slices
from factloom.plans.shared import materialize
from factloom.registry import query

# Path segments that name no domain, tokens of file names that do not either, and the bounds of the rules.
STRUCTURE_SEGMENTS = ("src", "main", "java", "test", "resources", "webapp", "com", "org", "net", "io", "web-inf", "meta-inf")
LAYER_SEGMENTS = ("controller", "service", "dao", "repository", "mapper", "model", "domain", "dto", "vo", "entity", "util", "config", "web", "api", "common", "jsp")
STOP_TOKENS = (
    "impl", "abstract", "base", "default", "controller", "service", "dao", "repository", "mapper", "manager",
    "helper", "util", "test", "action", "bean", "handler", "listener", "filter", "interceptor", "exception",
    "dto", "vo", "bo", "form", "view", "page", "config", "factory", "builder", "provider",
    "resolver", "validator", "converter",
)
NAMESPACE_TENTHS, PARTITION_TENTHS, QUARANTINE_TENTHS, CONVENTION_GROUPS = 9, 7, 3, 3
OWNER_CAP, GROUP_CAP = 3, 24


def _folders(path: Column) -> Column:
    """Segments of the folder of a path; none for a bare name."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def name_tokens(path: Column) -> Column:
    """Words of a file's stem that may name a domain, in order."""
    spaced = F.regexp_replace(F.regexp_replace(fn.stem(path), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.transform(F.split(spaced, r"[\s_\-.]+"), lambda w: F.regexp_replace(F.lower(w), r"[\[\]()@{}]", ""))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_TOKENS) & ~w.rlike(r"^\d+$"))


def directory_tokens(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files(path)`` -> ``(path, token)`` of every file, null without one, and one row
    ``degenerate``. The common prefix is left as deep as one segment holds over half of all files;
    behind it the first segment counts that is no structure, layer, digit run or single letter and
    no namespace: one that nine tenths of its parent's files share (or, where the parent has a
    single file, one that is a namespace elsewhere).

    Everything is counted over distinct folders, so that a file is a row of one join only."""
    placed = files.select("path", F.transform(_folders(F.col("path")), lambda s: F.lower(s)).alias("segments"))
    folders = materialize(placed.groupBy("segments").agg(F.count("*").alias("n")), "folders")
    parts = folders.select("segments", "n", F.posexplode("segments").alias("at", "segment")).withColumn("parent", F.array_join(F.slice("segments", F.lit(1), F.col("at")), "/"))
    total = folders.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    heaviest = parts.groupBy("at", "segment").agg(F.sum("n").alias("n")).groupBy("at").agg(F.max("n").alias("n"))
    ends = heaviest.join(F.broadcast(total)).agg(F.coalesce(F.min(F.when(F.col("n") * 2 <= F.col("total"), F.col("at"))), F.max("at") + 1, F.lit(0)).alias("depth"))
    branch = parts.groupBy("parent", "segment").agg(F.sum("n").alias("n"))
    branch = branch.join(branch.groupBy("parent").agg(F.sum("n").alias("all")), "parent")
    branch = branch.withColumn("dominant", (F.col("all") >= 2) & (F.col("n") * 10 >= F.col("all") * NAMESPACE_TENTHS))
    names = branch.where("dominant").select("segment").distinct().withColumn("named", F.lit(True))
    branch = branch.join(names, "segment", "left").select("parent", "segment", F.when(F.col("all") >= 2, F.col("dominant")).otherwise(F.col("named").isNotNull()).alias("namespace"))
    plain = F.col("segment").isin(*STRUCTURE_SEGMENTS, *LAYER_SEGMENTS) | (F.length("segment") == 1) | F.col("segment").rlike(r"^\d+$")
    named = parts.where(~plain).join(F.broadcast(ends)).where("at >= depth").join(branch, ["parent", "segment"]).where(~F.col("namespace"))
    tokens = materialize(folders.join(named.groupBy("segments").agg(F.min_by("segment", "at").alias("token")), "segments", "left").select("segments", "n", "token"), "tokens")
    clusters = tokens.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).agg(F.count("*").alias("clusters"), F.max("n").alias("most"))
    degenerate = clusters.join(F.broadcast(total)).select(((F.col("clusters") < 2) | (F.col("most") * 2 > F.col("total"))).alias("degenerate"))
    return placed.join(tokens.select("segments", "token"), "segments").select("path", "token"), degenerate


def domain_candidates(files: DataFrame, roots: DataFrame, owned: DataFrame) -> DataFrame:
    """``files(path)``, ``roots(path, entries)`` and ``owned(path, status, owners)`` (as of
    ``ownership``, owners joined by commas) -> ``(kind, path, key, note)``:

    * ``root``: an entry point that is a seed of domain ``key``; note is its confidence, high by a
      folder token, medium by a name prefix that splits the token's seeds or by being taken back
      into a domain named like its folder, low by its name alone;
    * ``quarantined``: a low seed, where they are at most three tenths of all;
    * ``member``: a file of domain ``key`` by reachability, directory or prefix (the note);
    * ``common``, ``ambiguous`` (key by reach, note the folder's) and ``unresolved`` files.
    """
    tokens, degenerate = directory_tokens(files)
    tokens = tokens.join(F.broadcast(degenerate)).select("path", F.when(~F.col("degenerate"), F.col("token")).alias("token"), "degenerate", name_tokens(F.col("path")).alias("words"))
    tokens = materialize(tokens, "file_tokens")
    seeds = roots.where(~is_root_ineligible(F.col("path"))).select("path").distinct().join(tokens, "path")
    seeds = materialize(seeds.withColumn("prefix", F.get("words", F.lit(0))), "seeds")
    spread = seeds.where("token is not null and prefix is not null").groupBy("token", "prefix").agg(F.count("*").alias("n"))
    split = spread.groupBy("token").agg(F.count("*").alias("prefixes"), F.sum("n").alias("all"), F.max("n").alias("most"))
    split = split.where((F.col("prefixes") >= 2) & (F.col("most") * 10 < F.col("all") * PARTITION_TENTHS)).select("token", F.lit(True).alias("split"))
    habit = spread.groupBy("prefix").agg(F.count("*").alias("groups")).where(F.col("groups") >= CONVENTION_GROUPS).select(F.col("prefix").alias("word"))
    # the first word of a name that is no convention
    words = tokens.select("path", F.posexplode("words").alias("at", "word")).join(habit, "word", "left_anti").groupBy("path").agg(F.min_by("word", "at").alias("prefix"))
    tokens = materialize(tokens.select("path", "token", "degenerate").join(words, "path", "left"), "named_files")

    first = seeds.select("path").join(tokens, "path").join(split, "token", "left")
    whole = F.col("token").isNotNull() & F.col("split").isNull()
    key = F.when(whole, F.col("token")).otherwise(F.coalesce("prefix", F.lower(fn.stem(F.col("path")))))
    sure = F.when(whole, "high").when(F.col("prefix").isNotNull() & F.col("token").isNotNull(), "medium").otherwise("low")
    first = materialize(first.select("path", "token", "degenerate", key.alias("key"), sure.alias("sure")), "keyed")
    known = first.select(F.col("key").alias("token")).distinct().withColumn("known", F.lit(True))
    back = (F.col("sure") != "high") & F.col("known") & (F.col("token") != F.col("key"))
    second = first.join(known, "token", "left").select("path", "degenerate", F.when(back, F.col("token")).otherwise(F.col("key")).alias("key"), F.when(back, "medium").otherwise(F.col("sure")).alias("sure"))
    counts = second.agg(F.count("*").alias("all"), F.count_if(F.col("sure") == "low").alias("low"))
    weak = (F.col("sure") == "low") & ~F.col("degenerate") & (F.col("low") * 10 <= F.col("all") * QUARANTINE_TENTHS)
    third = materialize(second.join(F.broadcast(counts)).select("path", "key", "sure", weak.alias("weak")), "seeded")

    kept = third.where("not weak").select("path", "key", "sure")
    keys = kept.select("key").distinct()
    by = lambda column, name: keys.select(F.col("key").alias(column), F.col("key").alias(name))
    d = owned.select("path", "status", F.when(F.col("status") == "sole", F.col("owners")).alias("owner"), "owners")
    d = d.join(kept.select("path", F.lit(True).alias("root")), "path", "left").join(kept.select(F.col("path").alias("owner"), F.col("key").alias("reach")), "owner", "left")
    d = d.join(tokens.select("path", "token", "prefix"), "path", "left").join(by("token", "folder"), "token", "left").join(by("prefix", "named"), "prefix", "left")
    d = d.where(~(F.col("status").isin("shared", "sole") & F.col("root").isNotNull()))
    clash = F.col("folder").isNotNull() & (F.col("folder") != F.col("reach"))
    kind = F.when(F.col("status") == "shared", "common").when(F.col("reach").isNotNull() & clash, "ambiguous").when(F.coalesce("reach", "folder", "named").isNotNull(), "member").otherwise("unresolved")
    via = F.when(F.col("reach").isNotNull(), "reachability").when(F.col("folder").isNotNull(), "directory").otherwise("prefix")
    note = F.when(kind == "common", F.col("owners")).when(kind == "ambiguous", F.col("folder")).when(kind == "member", via)
    members = d.select(kind.alias("kind"), "path", F.when(kind.isin("member", "ambiguous"), F.coalesce("reach", "folder", "named")).alias("key"), note.alias("note"))
    seeded = third.select(F.when(F.col("weak"), "quarantined").otherwise("root").alias("kind"), "path", "key", F.when(F.col("weak"), "weak-signal").otherwise(F.col("sure")).alias("note"))
    return seeded.unionByName(members)


def candidate_cards(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Per candidate its roots, entries of the roots, members and best confidence."""
    best = F.max(F.when(F.col("note") == "high", 2).when(F.col("note") == "medium", 1).otherwise(0))
    seeds = found.where("kind = 'root'").join(roots.select("path", "entries"), "path").groupBy("key").agg(F.count("*").alias("roots"), F.sum("entries").alias("entries"), best.alias("rank"))
    members = found.where("kind = 'member'").groupBy("key").agg(F.count("*").alias("files"))
    return seeds.join(members, "key", "left").select("key", "roots", "entries", F.coalesce("files", F.lit(0)).alias("files"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("rank") + 1).alias("confidence"))


def folder_depth(paths: DataFrame, cap: int) -> int | None:
    """At which depth the folders of ``paths(path)`` group best: behind their common prefix,
    where paths that end within the prefix do not count if half of all go deeper, and less deep
    as long as there are over ``cap`` groups or fewer than half of the paths have one. Null paths
    and bare names have no folder. None if no depth fits.

    Only counts for each depth come to the driver, one round for each time paths are left out."""
    pool = materialize(paths.select(_folders(F.array_join(F.filter(F.split("path", "/"), lambda s: s != ""), "/")).alias("dirs")).where(F.size("dirs") > 0).groupBy("dirs").agg(F.count("*").alias("n")), "dirs")
    parts = pool.select("n", "dirs", F.posexplode("dirs").alias("at", "segment"))
    named = {r["at"]: r for r in parts.groupBy("at").agg(F.sum("n").alias("n"), F.count_distinct("segment").alias("groups")).collect()}
    if not named:
        return None
    all_ = named[0]["n"]
    least = 0
    while True:
        some = parts.where(F.size("dirs") > least)
        same = {r["at"]: r for r in some.groupBy("at").agg(F.sum("n").alias("n"), F.count_distinct(F.slice("dirs", F.lit(1), F.col("at") + 1)).alias("prefixes")).collect()}
        size = same[0]["n"]
        common = next((k for k in range(len(same)) if same[k]["prefixes"] > 1 or same[k]["n"] < size), len(same))
        deeper = same[common]["n"] if common in same else 0
        if deeper < size and deeper * 2 >= all_:
            least = common
            continue
        break
    return next((k for k in range(common, -1, -1) if k in named and named[k]["groups"] <= cap and named[k]["n"] * 2 >= all_), None)


def folder_of(path: Column, depth: int | None) -> Column:
    """The segment of a path's folder at a depth; null without one."""
    if depth is None:
        return F.lit(None).cast("string")
    return F.get(_folders(F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/")), F.lit(depth))


def _window_key(rows: DataFrame, words: Column, keys: DataFrame, name: str) -> DataFrame:
    """``(screen, name)``: of all runs of words joined by dots that are keys, the one that starts
    first and is longest."""
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(n, a, F.lit(-1)), lambda b: F.array_join(F.slice(words, a, b - a + 1), "."))))
    d = rows.where(n > 0).select("screen", F.posexplode(runs).alias("at", "key"))
    return d.join(keys, "key").groupBy("screen").agg(F.min_by("key", "at").alias(name))


def _majority(votes: DataFrame, name: str) -> DataFrame:
    """``votes(screen, domain, direct)`` -> ``(screen, name)``: the domain with half of the votes at
    least, counting direct ones alone where there are any; of equals the first by name."""
    n = votes.groupBy("screen", "domain").agg(F.count_if("direct").alias("direct"), F.count("*").alias("all"))
    per = n.groupBy("screen").agg(F.sum("direct").alias("d"), F.sum("all").alias("a"))
    n = n.join(per, "screen").withColumn("n", F.when(F.col("d") > 0, F.col("direct")).otherwise(F.col("all"))).withColumn("of", F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("a")))
    top = n.where("n > 0").groupBy("screen").agg(F.min_by(F.struct("domain", "n", "of"), F.struct(-F.col("n"), "domain")).alias("top"))
    return top.where(F.col("top.n") * 2 >= F.col("top.of")).select("screen", F.col("top.domain").alias(name))


def assign_screens(screens: DataFrame, notes: DataFrame, plan: DataFrame, owned: DataFrame, overrides: DataFrame) -> DataFrame:
    """``screens(screen, jsp, node, scenario)``, ``notes(screen, link, file)`` (handlers' evidence),
    ``plan(root, domain)``, ``owned(path, owner)`` and ``overrides(screen, domain)`` -> ``(screen, domain,
    method)``. The first that holds: an override; the view's folder if it is a planned domain, or a
    run of its path's segments that is; the majority of the handlers' files, links left out that a
    quarter of all screens (three at least) share; that of the view's own files; the view's folder;
    a planned run, then the folder, of the screen's own path; a planned run of the scenario's words.
    Files vote for the domain of which they are a root, else for those of their owners if they
    are three at most."""
    screens = materialize(screens, "screens")
    keys = materialize(plan.select(F.col("domain").alias("key")).distinct(), "plan_keys")
    cap = max(GROUP_CAP, keys.count())
    raw = F.split(F.regexp_replace("screen", "^screen:", ""), "__")[0]
    own_path = F.when((raw != "") & (raw != "(root)"), raw)
    view = folder_of(F.col("jsp"), folder_depth(screens.select(F.col("jsp").alias("path")), cap))
    site = folder_of(own_path, folder_depth(screens.select(own_path.alias("path")), cap))
    clean = lambda p: F.filter(_folders(F.array_join(F.filter(F.split(p, "/"), lambda s: s != ""), "/")), lambda s: s != "")

    # votes of a file: by itself, else by its owners
    direct = plan.select(F.col("root").alias("file"), "domain").withColumn("direct", F.lit(True))
    owners = owned.join(plan.select(F.col("root").alias("owner"), "domain"), "owner").select(F.col("path").alias("file"), "domain").distinct()
    few = owners.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") <= OWNER_CAP).select("file")
    via = owners.join(few, "file").join(direct.select("file"), "file", "left_anti").withColumn("direct", F.lit(False))
    ballot = materialize(direct.unionByName(via), "ballot")
    bound = F.greatest(F.lit(3), F.ceil(F.col("all") * 0.25))
    chrome = notes.where("link is not null").groupBy("link").agg(F.count_distinct("screen").alias("n")).join(F.broadcast(screens.agg(F.count("*").alias("all")))).where(F.col("n") >= bound).select("link")
    handlers = notes.join(chrome, "link", "left_anti").select("screen", "file")
    files = screens.select("screen", F.explode(F.array("jsp", F.regexp_replace("node", "^file:", ""))).alias("file")).where("file is not null")

    words = lambda s: F.filter(F.split(s, r"[-_./]+"), lambda w: w != "")
    suffix = F.regexp_replace(F.when(F.contains("screen", F.lit("__")), F.regexp_replace("screen", "^.*?__", "")).otherwise(""), "^s_", "")
    d = screens.select("screen", view.alias("view"), site.alias("site"))
    d = d.join(overrides.select("screen", F.col("domain").alias("forced")), "screen", "left")
    d = d.join(keys.select(F.col("key").alias("view"), F.col("key").alias("planned")), "view", "left")
    tiers = [
        _window_key(screens, clean(F.coalesce("jsp", F.lit(""))), keys, "view_run"),
        _majority(handlers.join(ballot, "file"), "handler"),
        _majority(files.join(ballot, "file"), "file"),
        _window_key(screens, clean(F.coalesce(own_path, F.lit(""))), keys, "site_run"),
        _window_key(screens, words(F.coalesce("scenario", F.lit(""))), keys, "told"),
        _window_key(screens, words(suffix), keys, "suffix"),
    ]
    for tier in tiers:
        d = d.join(tier, "screen", "left")
    order = [("forced", "override"), ("planned", "view-folder"), ("view_run", "view-folder"), ("handler", "handler"), ("file", "view-file"), ("view", "view-folder"), ("site_run", "url-folder"), ("site", "url-folder"), ("told", "scenario"), ("suffix", "scenario")]
    method = F.lit(None).cast("string")
    for column, name in reversed(order):
        method = F.when(F.col(column).isNotNull(), name).otherwise(method)
    return d.select("screen", F.coalesce(*[c for c, _ in order]).alias("domain"), F.coalesce(method, F.lit("unassigned")).alias("method"))


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_SEGMENTS = r"""f AS (SELECT path, string_split(lower(path), '/')[:-2] AS segs FROM legacy_files), n AS (SELECT count(*) AS n FROM f),
p AS (SELECT path, d, segs[d] AS seg, array_to_string(segs[1:d - 1], '/') AS parent FROM (SELECT path, segs, unnest(range(1, len(segs) + 1)) AS d FROM f))"""
_TOKENS = rf"""{_SEGMENTS},
top AS (SELECT d, max(c) AS c FROM (SELECT d, seg, count(*) AS c FROM p GROUP BY d, seg) GROUP BY d),
dep AS (SELECT coalesce(min(CASE WHEN c * 2 <= n THEN d END), max(d) + 1, 1) AS d FROM top, n),
br AS (SELECT parent, seg, count(*) AS c, sum(count(*)) OVER (PARTITION BY parent) AS a FROM p GROUP BY parent, seg),
nv AS (SELECT DISTINCT seg FROM br WHERE a >= 2 AND c * 10 >= a * 9),
tok AS (SELECT path, arg_min(seg, d) AS token FROM p JOIN br USING (parent, seg) WHERE d >= (SELECT d FROM dep) AND seg NOT IN ({_listed(STRUCTURE_SEGMENTS + LAYER_SEGMENTS)}) AND length(seg) > 1 AND NOT regexp_matches(seg, '^\d+$')
  AND NOT CASE WHEN a >= 2 THEN c * 10 >= a * 9 ELSE seg IN (SELECT seg FROM nv) END GROUP BY path),
cl AS (SELECT count(*) AS k, max(c) AS m FROM (SELECT token, count(*) AS c FROM tok GROUP BY token)),
w AS (SELECT path, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[\s_\-.]+'), lambda x: lower(x)), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^\d+$') AND x NOT IN ({_listed(STOP_TOKENS)})) AS words FROM legacy_files),
t0 AS (SELECT w.path, CASE WHEN k >= 2 AND m * 2 <= n THEN token END AS token, words, k < 2 OR m * 2 > n AS bad FROM w LEFT JOIN tok USING (path), cl, n),
own AS (SELECT path, count(DISTINCT root) AS n, string_agg(DISTINCT root, ',' ORDER BY root) AS owners FROM (
  WITH RECURSIVE r AS (SELECT path AS root, path, 0 AS depth FROM entries UNION SELECT r.root, i.target, r.depth + 1 FROM r JOIN includes i ON i.source = r.path WHERE r.depth < 12) SELECT root, path FROM r) GROUP BY path),
owned AS (SELECT path, CASE WHEN n = 1 THEN 'sole' WHEN n > 1 THEN 'shared' ELSE 'unreached' END AS status, owners FROM legacy_files LEFT JOIN own USING (path)),
s0 AS (SELECT t0.path, token, words[1] AS raw FROM entries JOIN t0 USING (path) WHERE NOT regexp_matches(path, '(^|/)tests?/|Test\d*\.java$|\.(xml|html?|jsp|css)$')),
sp AS (SELECT token, raw, count(*) AS n FROM s0 WHERE token IS NOT NULL AND raw IS NOT NULL GROUP BY ALL),
cut AS (SELECT token FROM sp GROUP BY token HAVING count(*) >= 2 AND max(n) * 10 < sum(n) * 7),
hab AS (SELECT raw FROM sp GROUP BY raw HAVING count(*) >= 3),
ws AS (SELECT path, i, words[i] AS word FROM (SELECT path, words, unnest(range(1, len(words) + 1)) AS i FROM t0)),
pf AS (SELECT path, arg_min(word, i) AS prefix FROM ws WHERE word NOT IN (SELECT raw FROM hab) GROUP BY path),
t1 AS (SELECT path, token, bad, prefix FROM t0 LEFT JOIN pf USING (path)),
k1 AS (SELECT s0.path, t1.token, bad, CASE WHEN t1.token IS NOT NULL AND t1.token NOT IN (SELECT token FROM cut) THEN t1.token ELSE coalesce(prefix, lower(regexp_replace(regexp_extract(s0.path, '[^/]*$'), '\.[^.]*$', ''))) END AS key,
  CASE WHEN t1.token IS NOT NULL AND t1.token NOT IN (SELECT token FROM cut) THEN 'high' WHEN prefix IS NOT NULL AND t1.token IS NOT NULL THEN 'medium' ELSE 'low' END AS sure FROM s0 JOIN t1 USING (path)),
k2 AS (SELECT path, bad, CASE WHEN sure <> 'high' AND token IN (SELECT key FROM k1) AND token <> key THEN token ELSE key END AS key, CASE WHEN sure <> 'high' AND token IN (SELECT key FROM k1) AND token <> key THEN 'medium' ELSE sure END AS sure FROM k1),
k3 AS (SELECT path, key, sure, sure = 'low' AND NOT bad AND (SELECT count(*) FILTER (WHERE sure = 'low') * 10 <= count(*) * 3 FROM k2) AS weak FROM k2),
ky AS (SELECT DISTINCT key FROM k3 WHERE NOT weak),
m0 AS (SELECT o.path, o.status, o.owners, r.key AS root_key, q.key AS reach, CASE WHEN token IN (SELECT key FROM ky) THEN token END AS folder, CASE WHEN prefix IN (SELECT key FROM ky) THEN prefix END AS named
  FROM owned o LEFT JOIN k3 r ON r.path = o.path AND NOT r.weak LEFT JOIN k3 q ON o.status = 'sole' AND q.path = o.owners AND NOT q.weak JOIN t1 ON t1.path = o.path),
m1 AS (SELECT CASE WHEN status = 'shared' THEN 'common' WHEN reach IS NOT NULL AND folder <> reach THEN 'ambiguous' WHEN coalesce(reach, folder, named) IS NULL THEN 'unresolved' ELSE 'member' END AS kind, *
  FROM m0 WHERE root_key IS NULL OR status = 'unreached'),
found AS (SELECT CASE WHEN weak THEN 'quarantined' ELSE 'root' END AS kind, path, key, CASE WHEN weak THEN 'weak-signal' ELSE sure END AS note FROM k3
  UNION ALL SELECT kind, path, CASE WHEN kind IN ('member', 'ambiguous') THEN coalesce(reach, folder, named) END,
  CASE kind WHEN 'common' THEN owners WHEN 'ambiguous' THEN folder WHEN 'member' THEN CASE WHEN reach IS NOT NULL THEN 'reachability' WHEN folder IS NOT NULL THEN 'directory' ELSE 'prefix' END END FROM m1)"""
_CANDIDATES = f"entries AS (SELECT path, loc AS entries FROM legacy_files WHERE seq % 7 IN (0, 1)), {_TOKENS}"


def _entries(t: Tables) -> DataFrame:
    return t.legacy_files.where("seq % 7 in (0, 1)").select("path", F.col("loc").alias("entries"))


def _found(t: Tables) -> DataFrame:
    roots = _entries(t)
    owned = ownership(t.legacy_files, slices(t.includes, roots.select(F.col("path").alias("root"))))
    return domain_candidates(t.legacy_files.select("path"), roots, owned)


@query("g14_domain_candidates", f"{_CANDIDATES} SELECT * FROM found", ("legacy_files", "includes"))
def _g14(t: Tables) -> DataFrame:
    return _found(t)


@query(
    "g14_candidate_cards",
    f"""{_CANDIDATES}, c AS (SELECT key, count(*) AS roots, sum(entries)::BIGINT AS entries, max(CASE note WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS rank FROM found JOIN entries USING (path) WHERE kind = 'root' GROUP BY key)
SELECT key, roots, entries, (SELECT count(*) FROM found WHERE kind = 'member' AND found.key = c.key) AS files, ['low', 'medium', 'high'][rank + 1] AS confidence FROM c""",
    ("legacy_files", "includes"),
)
def _g14b(t: Tables) -> DataFrame:
    return candidate_cards(_found(t), _entries(t))


def _depth(x: str, paths: str, cap: str) -> str:
    """CTEs ending in ``{x}k(k)``, the depth, and ``{x}d(screen, dirs)``; ``paths`` gives (screen, p)."""
    return f"""{x}d AS (SELECT screen, list_filter(string_split(p, '/'), lambda s: s <> '')[:-2] AS dirs FROM ({paths}) WHERE p IS NOT NULL),
{x}u AS (SELECT screen, dirs, unnest(range(0, len(dirs))) AS pos FROM {x}d),
{x}l AS (SELECT least, pos, count(*) AS n, count(DISTINCT array_to_string(dirs[1:pos + 1], '/')) AS pre, count(DISTINCT dirs[pos + 1]) AS grp FROM {x}u JOIN range(0, 20) r(least) ON len(dirs) > least GROUP BY least, pos),
{x}c AS (SELECT a.least, any_value(s.n) AS size, coalesce(min(a.pos) FILTER (a.pre > 1 OR a.n < s.n), max(a.pos) + 1) AS common FROM {x}l a JOIN {x}l s ON s.least = a.least AND s.pos = 0 GROUP BY a.least),
{x}s AS (SELECT c.least, common, size, coalesce(n, 0) AS deeper FROM {x}c c LEFT JOIN {x}l l ON l.least = c.least AND pos = common),
{x}w AS (SELECT CAST(0 AS BIGINT) AS least UNION SELECT common FROM {x}w JOIN {x}s USING (least) WHERE deeper < size AND deeper * 2 >= (SELECT n FROM {x}l WHERE least = 0 AND pos = 0)),
{x}k AS (SELECT max(pos) AS k FROM {x}l WHERE least = 0 AND pos <= (SELECT common FROM {x}s WHERE least = (SELECT max(least) FROM {x}w)) AND grp <= ({cap}) AND n * 2 >= (SELECT n FROM {x}l WHERE least = 0 AND pos = 0))"""


_PLAN = "plan AS (SELECT path AS root, CASE WHEN path LIKE '%/event/%' THEN 'event' WHEN path LIKE '%/actions/%' THEN 'order' ELSE domain END AS domain FROM legacy_files WHERE seq % 7 = 1 AND seq % 35 <> 1)"
_CAP = "SELECT greatest(24, count(DISTINCT domain)) FROM plan"


def _runs(x: str, words: str) -> str:
    """CTE ``{x}(screen, key)`` of the first, longest run of words that is a planned domain; ``words`` gives (screen, w)."""
    return f"""{x} AS (SELECT screen, arg_min(key, (a, -b)) AS key FROM (SELECT screen, a, b, array_to_string(w[a:b], '.') AS key FROM ({words}) t(screen, w), range(1, 30) i(a), range(1, 30) j(b) WHERE a <= b AND b <= len(w)) WHERE key IN (SELECT domain FROM plan) GROUP BY screen)"""


def _votes(x: str, files: str) -> str:
    """CTE ``{x}(screen, domain)`` of majorities; ``files`` gives (screen, file)."""
    return f"""{x}v AS (SELECT screen, domain, direct, count(*) AS n FROM ({files}) JOIN ballot USING (file) GROUP BY ALL),
{x}m AS (SELECT screen, domain, sum(n) AS n FROM {x}v v WHERE direct OR screen NOT IN (SELECT screen FROM {x}v WHERE direct) GROUP BY ALL),
{x} AS (SELECT screen, arg_min(domain, (-n, domain)) AS domain FROM {x}m GROUP BY screen HAVING max(n) * 2 >= sum(n))"""


_SCREENS = f"""{_PLAN}, {_depth('jv', "SELECT screen, jsp AS p FROM screens", _CAP)},
own AS (SELECT screen, CASE WHEN raw NOT IN ('', '(root)') THEN raw END AS p FROM (SELECT screen, string_split(regexp_replace(screen, '^screen:', ''), '__')[1] AS raw FROM screens)), {_depth('iv', 'SELECT * FROM own', _CAP)},
ow AS (SELECT DISTINCT target AS file, domain FROM includes JOIN plan ON root = source),
ballot AS (SELECT root AS file, domain, TRUE AS direct FROM plan UNION ALL SELECT file, domain, FALSE FROM ow WHERE file NOT IN (SELECT root FROM plan) AND file IN (SELECT file FROM ow GROUP BY file HAVING count(*) <= 3)),
chrome AS (SELECT link FROM screen_notes WHERE link IS NOT NULL GROUP BY link HAVING count(DISTINCT screen) >= greatest(3, (SELECT ceil(count(*) * 0.25) FROM screens))),
{_votes('hv', 'SELECT screen, file FROM screen_notes WHERE link IS NULL OR link NOT IN (SELECT link FROM chrome)')},
{_votes('fv', "SELECT screen, jsp AS file FROM screens WHERE jsp IS NOT NULL UNION ALL SELECT screen, regexp_replace(node, '^file:', '') FROM screens WHERE node IS NOT NULL")},
{_runs('vr', 'SELECT screen, dirs FROM jvd')}, {_runs('sr', 'SELECT screen, dirs FROM ivd')},
{_runs('tr', "SELECT screen, list_filter(string_split_regex(scenario, '[-_./]+'), lambda x: x <> '') FROM screens WHERE scenario IS NOT NULL")},
{_runs('ur', "SELECT screen, list_filter(string_split_regex(regexp_replace(regexp_replace(screen, '^.*?__', ''), '^s_', ''), '[-_./]+'), lambda x: x <> '') FROM screens WHERE contains(screen, '__')")},
al AS (SELECT s.screen, CASE WHEN seq % 13 = 0 THEN 'brand1' END AS c0, jvd.dirs[(SELECT k FROM jvk) + 1] AS c5, vr.key AS c2, hv.domain AS c3, fv.domain AS c4, sr.key AS c6, ivd.dirs[(SELECT k FROM ivk) + 1] AS c7, tr.key AS c8, ur.key AS c9
  FROM screens s LEFT JOIN jvd USING (screen) LEFT JOIN ivd USING (screen) LEFT JOIN vr USING (screen) LEFT JOIN hv USING (screen) LEFT JOIN fv USING (screen) LEFT JOIN sr USING (screen) LEFT JOIN tr USING (screen) LEFT JOIN ur USING (screen)),
am AS (SELECT *, CASE WHEN c5 IN (SELECT domain FROM plan) THEN c5 END AS c1 FROM al)"""


def _plan(t: Tables) -> DataFrame:
    p = F.col("path")
    domain = F.when(p.contains("/event/"), "event").when(p.contains("/actions/"), "order").otherwise(F.col("domain"))
    return t.legacy_files.where("seq % 7 = 1 and seq % 35 <> 1").select(p.alias("root"), domain.alias("domain"))


@query(
    "g16_screen_domains",
    f"""{_SCREENS} SELECT screen, coalesce(c0, c1, c2, c3, c4, c5, c6, c7, c8, c9) AS domain, CASE WHEN c0 IS NOT NULL THEN 'override' WHEN coalesce(c1, c2) IS NOT NULL THEN 'view-folder' WHEN c3 IS NOT NULL THEN 'handler' WHEN c4 IS NOT NULL THEN 'view-file' WHEN c5 IS NOT NULL THEN 'view-folder'
  WHEN coalesce(c6, c7) IS NOT NULL THEN 'url-folder' WHEN coalesce(c8, c9) IS NOT NULL THEN 'scenario' ELSE 'unassigned' END AS method FROM am""",
    ("legacy_files", "includes", "screens", "screen_notes"),
    recursive=True,
)
def _g16(t: Tables) -> DataFrame:
    owned = t.includes.select(F.col("target").alias("path"), F.col("source").alias("owner"))
    overrides = t.screens.where("seq % 13 = 0").select("screen", F.lit("brand1").alias("domain"))
    return assign_screens(t.screens.drop("seq"), t.screen_notes, _plan(t), owned, overrides)


@query("g15_derived_folders", f"{_depth('fd', 'SELECT path AS screen, path AS p FROM legacy_files', '24')} SELECT path, dirs[(SELECT k FROM fdk) + 1] AS folder FROM legacy_files LEFT JOIN fdd ON screen = path", ("legacy_files",), recursive=True)
def _g15(t: Tables) -> DataFrame:
    return t.legacy_files.select("path", folder_of(F.col("path"), folder_depth(t.legacy_files.select("path"), 24)).alias("folder"))
