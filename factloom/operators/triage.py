"""Missing screens by class with their best route, batch jobs with suspects, levels of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.operators.graph import DEPTH_CAP, reach_counts, topological_levels
from factloom.plans.shared import materialize
from factloom.registry import query

# Tokens that do not tell routes apart, tags of triggers, triggers whose handler is a bean, samples of suspects.
GENERIC_TOKENS = ("select", "list", "view", "detail", "inqire", "inquire", "info", "infs", "manage", "main", "index")
TRIGGER_TAGS = {"scheduled": "SCHED", "main": "MAIN", "quartz": "QUARTZ", "task-xml": "TASK", "spring-batch": "SB", "quartz-java": "QJAVA", "executor": "EXEC", "timer": "TIMER", "shell": "SHELL", "crontab": "CRON"}
BEAN_TRIGGERS = ("quartz", "task-xml", "spring-batch")
SUSPECT_SAMPLES = 10


def bare_path(url: Column) -> Column:
    """A URL's path without query, fragment and leading slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "^/+", "")


def _dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def leaf_tokens(path: Column) -> Column:
    """Words of a path's last part in lower case, split at capitals, underscores, dashes and dots."""
    leaf = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[A-Za-z0-9]+$", "")
    return F.filter(F.transform(F.split(leaf, r"(?=[A-Z])|[_\-.]"), lambda w: F.lower(w)), lambda w: (w != "") & (w != "egov"))


def triage_missing(missing: DataFrame, routes: DataFrame, login_paths: tuple[str, ...] = ()) -> DataFrame:
    """C20: ``missing(id, url, reason)`` and ``routes(seq, path, handler)`` -> ``(id, class, exists, route, handler)``; the
    class by the first rule that holds. A missing address of which no route is left is ``stale-url`` with the
    route of its folder that has most of its last part's words (half at least, one of them not generic),
    then the greatest share of own words, then an own list entry; if two are level there is none and it
    is a ``dead-menu``.

    Routes meet addresses by folder and a word that is not generic, not by folder alone; addresses
    and routes that are alike in what is compared meet once."""
    c = F.col
    m = missing.select("id", "url", "reason", bare_path(c("url")).alias("path"))
    known = routes.select(bare_path(c("path")).alias("path")).distinct().withColumn("known", F.lit(True))
    m = m.join(known, "path", "left").withColumn("exists", c("known").isNotNull())
    status, target = F.regexp_extract("reason", r"^http-(\d{3})$", 1), bare_path(F.regexp_replace("reason", "^redirected-to:", ""))
    gone = status.startswith("4") & ~c("exists")
    logins = [p.split("?")[0].split("#")[0].lstrip("/") for p in login_paths]
    kind = (
        F.when(c("url").startswith("scenario:"), "unknown")
        .when((status == "400") & c("exists"), "param-required")
        .when(status.startswith("5"), "server-error")
        .when(status.isin("401", "403") & c("exists"), "auth-gated")
        .when(c("reason").startswith("redirected-to:"), F.when(target.isin(*logins) if logins else F.lit(False), "auth-gated").otherwise("redirect-other"))
        .when(status.startswith("4") & c("exists"), "route-missing-hit")
        .when(gone, "gone")
        .otherwise("unknown")
    )
    m = materialize(m.select("id", "path", kind.alias("class"), (c("exists") & ~c("url").startswith("scenario:")).alias("exists")), "missing")
    asked = materialize(m.where("class = 'gone'").select("id", _dir(c("path")).alias("dir"), leaf_tokens(c("path")).alias("words")), "asked")
    r = routes.select("seq", c("path").alias("route"), "handler", bare_path(c("path")).alias("p"))
    r = r.select("seq", "route", "handler", _dir(c("p")).alias("dir"), F.array_sort(F.array_distinct(leaf_tokens(c("p")))).alias("own"), F.regexp_replace(F.substring_index("p", "/", -1), r"\.[A-Za-z0-9]+$", "").rlike("(?i)list(view)?$").alias("listing"))
    r = r.distinct().groupBy("dir", "own", "listing").agg(F.count("*").alias("level"), F.min(F.struct("seq", "route", "handler")).alias("x"))
    telling = lambda w: F.array_except(w, F.array(*map(F.lit, GENERIC_TOKENS)))
    pairs = asked.select("dir", "words").distinct().select("dir", "words", F.explode(telling(c("words"))).alias("word")).join(r.select("*", F.explode(telling(c("own"))).alias("word")), ["dir", "word"]).drop("word").distinct()
    common = F.size(F.filter("words", lambda w: F.array_contains("own", w)))
    met = pairs.select("dir", "words", "level", "x", "listing", common.alias("common"), F.size("words").alias("n"), F.size("own").alias("k")).where(c("common") * 2 >= c("n"))
    rank = F.struct((c("common") / c("n")).alias("recall"), (c("common") / c("k")).alias("precision"), "listing")
    ranks = met.groupBy("dir", "words", rank.alias("rank")).agg(F.sum("level").alias("level"), F.min("x").alias("x"))
    best = ranks.groupBy("dir", "words").agg(F.max(F.struct("rank", "level", "x")).alias("best")).select("dir", "words", "best.*")
    top = asked.distinct().join(best, ["dir", "words"]).groupBy("id", "rank").agg(F.sum("level").alias("level"), F.min("x").alias("x"))
    top = top.groupBy("id").agg(F.max(F.struct("rank", "level", "x")).alias("best")).where("best.level = 1").select("id", "best.x.route", "best.x.handler")
    d = m.join(top, "id", "left")
    return d.select("id", F.when(c("class") == "gone", F.when(c("route").isNotNull(), "stale-url").otherwise("dead-menu")).otherwise(c("class")).alias("class"), "exists", "route", "handler")


def batch_jobs(entries: DataFrame, edges: DataFrame, cap: int = DEPTH_CAP) -> DataFrame:
    """C4: ``entries(seq, trigger, entry, handler, schedule, file, handler_file)`` -> ``(id, name, trigger, unresolved, root,
    reached)``. The id hashes trigger, handler, schedule and file, repeats of them numbered by ``seq``. The
    name is the job's own for spring batch, the command's base name for cron and shell, else the handler.
    Files reached from the handler's file (else the entry's) count with it."""
    c = F.col
    base = F.concat_ws("|", "trigger", F.coalesce("handler", F.lit("")), F.coalesce("schedule", F.lit("")), "file")
    d = entries.withColumn("base", base).withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("seq")))
    seed = F.when(c("k") == 1, c("base")).otherwise(F.concat("base", F.lit("|dup"), c("k").cast("string")))
    tag = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in TRIGGER_TAGS.items() for v in p]), c("trigger")), F.upper("trigger"))
    tail = F.expr("substring(entry, instr(entry, '#') + 1)")
    command = F.split(F.trim(F.coalesce("handler", tail)), r"\s+")[0]
    short = F.coalesce(F.nullif(F.substring_index(command, "/", -1), F.lit("")), command)
    name = F.when(c("trigger") == "spring-batch", tail).when(c("trigger").isin("crontab", "shell"), short).otherwise(F.coalesce("handler", tail))
    d = d.select(F.concat(F.lit("BAT-"), tag, F.lit("-"), F.substring(F.sha2(seed, 256), 1, 8)).alias("id"), name.alias("name"), "trigger", (c("trigger").isin(*BEAN_TRIGGERS) & c("handler_file").isNull()).alias("unresolved"), F.coalesce("handler_file", "file").alias("root"))
    d = materialize(d, "jobs")
    reach = reach_counts(edges, d.select("root").distinct(), cap).select("root", c("with_root").alias("reached"))
    return d.join(reach, "root", "left").select("id", "name", "trigger", "unresolved", "root", F.coalesce("reached", F.lit(1)).cast("long").alias("reached"))


def batch_suspects(files: DataFrame, entries: DataFrame, ignored: DataFrame, most: int = SUSPECT_SAMPLES) -> DataFrame:
    """C4: ``files(path, lang, text)``: Java files of no entry that look like jobs by what they use or by their
    name, tests and ``ignored(path)`` left out -> ``(path, kind, total)``, the first ``most`` with the count of all."""
    covered = entries.select(F.explode(F.array("file", "handler_file")).alias("path")).where("path is not null")
    d = files.where("lang = 'java'").join(covered, "path", "left_anti").join(ignored, "path", "left_anti").where(~F.exists(F.split("path", "/"), lambda s: s.isin("test", "tests")))
    uses = F.col("text").rlike(r"org\.quartz|QuartzJobBean|JobExecutionContext|springframework\.batch")
    d = d.select("path", F.when(uses, "job-structure").when(F.col("path").rlike(r"(Job|Batch|Tasklet)\.java$"), "job-named-class").alias("kind")).where("kind is not null")
    total = d.agg(F.count("*").alias("total"))
    return d.orderBy("kind", "path").limit(most).join(F.broadcast(total))


_MISSING = """r AS (SELECT seq, concat('/', domain, '/', ['select', 'view', ''][seq % 3 + 1], CASE WHEN seq % 3 = 2 THEN 'order' ELSE 'Order' END, ['List', 'Info', 'Item'][loc % 3 + 1], loc % 4, '.do') AS path, CASE WHEN seq % 4 > 0 THEN concat('H', seq) END AS handler FROM files WHERE path LIKE '%/controller/%'),
m AS (SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN concat('/brand', page_id % 26, '/selectOrderList', page_id % 5, '.do?x=1') WHEN 1 THEN concat('brand', page_id % 26, '/viewOrderItem', page_id % 4, '.do') WHEN 2 THEN concat('/brand', page_id % 26, '/selectList.do') WHEN 3 THEN 'scenario:a' ELSE concat('/no/where', page_id) END AS url, CASE page_id % 8 WHEN 0 THEN 'http-404' WHEN 1 THEN 'http-400' WHEN 2 THEN 'http-404' WHEN 3 THEN 'http-503' WHEN 4 THEN 'redirected-to:/login?b' WHEN 5 THEN 'redirected-to:/x' WHEN 6 THEN 'http-403' ELSE 'timeout' END AS reason FROM pages)"""


def _missing(t: Tables) -> tuple[DataFrame, DataFrame]:
    s, n, text = F.col("seq"), F.col("page_id"), lambda c: c.cast("string")
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))
    route = F.concat(F.lit("/"), "domain", F.lit("/"), pick(s % 3, "select", "view", ""), F.when(s % 3 == 2, "order").otherwise("Order"), pick(F.col("loc") % 3, "List", "Info", "Item"), text(F.col("loc") % 4), F.lit(".do"))
    routes = t.files.where("path like '%/controller/%'").select("seq", route.alias("path"), F.when(s % 4 > 0, F.concat(F.lit("H"), text(s))).alias("handler"))
    brand = F.concat(F.lit("brand"), text(n % 26))
    url = F.when(n % 6 == 0, F.concat(F.lit("/"), brand, F.lit("/selectOrderList"), text(n % 5), F.lit(".do?x=1"))).when(n % 6 == 1, F.concat(brand, F.lit("/viewOrderItem"), text(n % 4), F.lit(".do"))).when(n % 6 == 2, F.concat(F.lit("/"), brand, F.lit("/selectList.do"))).when(n % 6 == 3, "scenario:a").otherwise(F.concat(F.lit("/no/where"), text(n)))
    reason = pick(n % 8, "http-404", "http-400", "http-404", "http-503", "redirected-to:/login?b", "redirected-to:/x", "http-403", "timeout")
    return t.pages.select(n.alias("id"), url.alias("url"), reason.alias("reason")), routes


def _tokens(path: str) -> str:
    # a space before every capital stands for the split between characters
    return f"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_extract({path}, '[^/]*$'), '\\.[A-Za-z0-9]+$', ''), '([A-Z])', ' \\1', 'g'), '[ _.-]'), lambda w: lower(w)), lambda w: w <> '' AND w <> 'egov')"


@query(
    "c20_triage",
    f"""{_MISSING}, b AS (SELECT id, url, reason, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^/+', '') AS path FROM m), q AS (SELECT seq, path AS route, handler, substr(path, 2) AS p FROM r),
k AS (SELECT *, path IN (SELECT p FROM q) AS known, regexp_extract(reason, '^http-([0-9]+)$', 1) AS st FROM b),
z AS (SELECT id, path, known AND NOT starts_with(url, 'scenario:') AS exists, CASE WHEN starts_with(url, 'scenario:') THEN 'unknown' WHEN st = '400' AND known THEN 'param-required' WHEN starts_with(st, '5') THEN 'server-error' WHEN st IN ('401', '403') AND known THEN 'auth-gated' WHEN reason LIKE 'redirected-to:%' THEN CASE WHEN reason LIKE '%/login?b' THEN 'auth-gated' ELSE 'redirect-other' END WHEN starts_with(st, '4') AND known THEN 'route-missing-hit' WHEN starts_with(st, '4') THEN 'gone' ELSE 'unknown' END AS cls FROM k),
a AS (SELECT id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, {_tokens('path')} AS w FROM z WHERE cls = 'gone'), o AS (SELECT seq, route, handler, regexp_replace(p, '/[^/]*$', '') AS dir, list_distinct({_tokens('p')}) AS own, regexp_matches(lower(regexp_replace(p, '\\.[A-Za-z0-9]+$', '')), 'list(view)?$') AS listing FROM q),
x AS (SELECT id, seq, route, handler, (len(list_filter(w, lambda v: list_contains(own, v))) * 1e0 / len(w), len(list_filter(w, lambda v: list_contains(own, v))) * 1e0 / len(own), listing) AS rank FROM a JOIN o ON o.dir = a.dir WHERE len(w) > 0 AND len(own) > 0 AND len(list_filter(w, lambda v: list_contains(own, v))) * 2 >= len(w) AND len(list_filter(w, lambda v: list_contains(own, v) AND v NOT IN ({', '.join(f"'{g}'" for g in GENERIC_TOKENS)}))) > 0),
y AS (SELECT id, arg_min(route, seq) AS route, any_value(handler) AS handler FROM x WHERE (id, rank) IN (SELECT (id, max(rank)) FROM x GROUP BY id) GROUP BY id HAVING count(*) = 1)
SELECT z.id, CASE WHEN cls = 'gone' THEN CASE WHEN route IS NULL THEN 'dead-menu' ELSE 'stale-url' END ELSE cls END AS class, exists, route, handler FROM z LEFT JOIN y ON y.id = z.id""",
    ("files",),
)
def _c20(t: Tables) -> DataFrame:
    return triage_missing(*_missing(t), login_paths=("/login",))


_JOBS = """e AS (SELECT seq, ['quartz', 'crontab', 'spring-batch', 'scheduled', 'shell'][seq % 5 + 1] AS trigger, concat('x#job', seq) AS entry, CASE WHEN seq % 5 IN (1, 4) THEN concat(' /opt/bin/run', loc % 5, '.sh -a ', loc) WHEN seq % 6 > 0 THEN concat('Bean', loc % 7, '#go') END AS handler, CASE WHEN seq % 2 = 0 THEN '0 1 * * *' END AS schedule, concat('f', seq % 40) AS file, CASE WHEN seq % 4 > 0 THEN path END AS handler_file FROM legacy_files WHERE seq % 3 = 1)"""


def _jobs(t: Tables) -> DataFrame:
    s, text = F.col("seq"), lambda c: c.cast("string")
    trigger = F.element_at(F.array(*map(F.lit, ("quartz", "crontab", "spring-batch", "scheduled", "shell"))), (s % 5 + 1).cast("int"))
    handler = F.when((s % 5).isin(1, 4), F.concat(F.lit(" /opt/bin/run"), text(F.col("loc") % 5), F.lit(".sh -a "), text(F.col("loc")))).when(s % 6 > 0, F.concat(F.lit("Bean"), text(F.col("loc") % 7), F.lit("#go")))
    return t.legacy_files.where("seq % 3 = 1").select("seq", trigger.alias("trigger"), F.concat(F.lit("x#job"), text(s)).alias("entry"), handler.alias("handler"), F.when(s % 2 == 0, "0 1 * * *").alias("schedule"), F.concat(F.lit("f"), text(s % 40)).alias("file"), F.when(s % 4 > 0, F.col("path")).alias("handler_file"))


@query(
    "c4_jobs",
    f"""{_JOBS}, g AS (SELECT *, concat_ws('|', trigger, coalesce(handler, ''), coalesce(schedule, ''), file) AS base FROM e), h AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS k, coalesce(handler_file, file) AS root FROM g),
w AS (SELECT DISTINCT root, root AS path, 0 AS depth FROM h UNION SELECT w.root, i.target, depth + 1 FROM w JOIN includes i ON i.source = w.path WHERE depth < 12), n AS (SELECT root, count(DISTINCT path) AS reached FROM w GROUP BY root)
SELECT concat('BAT-', CASE trigger WHEN 'quartz' THEN 'QUARTZ' WHEN 'crontab' THEN 'CRON' WHEN 'spring-batch' THEN 'SB' WHEN 'scheduled' THEN 'SCHED' ELSE 'SHELL' END, '-', substr(sha256(CASE WHEN k = 1 THEN base ELSE concat(base, '|dup', k) END), 1, 8)) AS id,
  CASE WHEN trigger = 'spring-batch' THEN concat('job', seq) WHEN trigger IN ('crontab', 'shell') THEN regexp_extract(handler, 'run[0-9]\\.sh') ELSE coalesce(handler, concat('job', seq)) END AS name, trigger, trigger IN ('quartz', 'spring-batch') AND handler_file IS NULL AS unresolved, root, reached FROM h JOIN n USING (root)""",
    ("legacy_files", "includes"),
    recursive=True,
)
def _c4(t: Tables) -> DataFrame:
    return batch_jobs(_jobs(t), t.includes)


@query(
    "c4_suspects",
    f"""{_JOBS}, f AS (SELECT CASE WHEN seq % 9 = 4 THEN replace(path, '.java', 'Job.java') ELSE path END AS path, seq % 8 = 1 AS uses FROM legacy_files WHERE path LIKE '%.java'), s AS (SELECT path, CASE WHEN uses THEN 'job-structure' WHEN path LIKE '%Job.java' THEN 'job-named-class' END AS kind FROM f WHERE path NOT IN (SELECT file FROM e) AND path NOT IN (SELECT handler_file FROM e WHERE handler_file IS NOT NULL) AND path NOT LIKE '%/test/%' AND path NOT LIKE '%9Job.java')
SELECT path, kind, (SELECT count(*) FROM s WHERE kind IS NOT NULL) AS total FROM s WHERE kind IS NOT NULL ORDER BY kind, path LIMIT 10""",
    ("legacy_files",),
)
def _c4b(t: Tables) -> DataFrame:
    s, p = F.col("seq"), F.col("path")
    path = F.when(s % 9 == 4, F.replace(p, F.lit(".java"), F.lit("Job.java"))).otherwise(p)
    files = t.legacy_files.where("path like '%.java'").select(path.alias("path"), F.lit("java").alias("lang"), F.when(s % 8 == 1, "import org.quartz.Job;").otherwise("class A {}").alias("text"))
    return batch_suspects(files, _jobs(t), files.where("path like '%9Job.java'").select("path"))


@query(
    "g8_levels",
    """e AS (SELECT source, target FROM includes UNION SELECT b.path, a.path FROM legacy_files a JOIN legacy_files b ON b.seq = a.seq + 2 WHERE a.seq % 70 = 15), r AS (SELECT path AS id, 0 AS depth FROM legacy_files UNION SELECT e.target, depth + 1 FROM r JOIN e ON e.source = r.id WHERE depth < 60), d AS (SELECT id, max(depth) AS depth FROM r GROUP BY id)
SELECT id, seq, CASE WHEN depth < 60 THEN depth ELSE -1 END AS level FROM d JOIN legacy_files ON path = id""",
    ("legacy_files", "includes"),
    recursive=True,
)
def _g8(t: Tables) -> DataFrame:
    """Levels by the longest way from a start; -1 on and behind cycles."""
    back = t.legacy_files.where("seq % 70 = 15").select(F.col("path").alias("target"), (F.col("seq") + 2).alias("to")).join(t.legacy_files.select(F.col("seq").alias("to"), F.col("path").alias("source")), "to").select("source", "target")
    nodes = t.legacy_files.select(F.col("path").alias("id"), "seq")
    return topological_levels(nodes, t.includes.union(back)).select("id", "seq", F.coalesce("level", F.lit(-1)).alias("level"))
