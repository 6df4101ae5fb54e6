"""Text extraction over a table of lines: corpus in, fact table out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.plans.shared import broadcast_if_small, materialize
from factloom.registry import query

# What marks each kind of table access.
ACCESSES = {"C": r"(?i)\binsert\s+into\s+(\w+)", "R": r"(?i)\b(?:from|join)\s+(\w+)", "U": r"(?i)\bupdate\s+(\w+)", "D": r"(?i)\bdelete\s+from\s+(\w+)"}


def sql_accesses(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Earliest line of each (file, table, letter) for known tables; a delete is no read.

    Accesses of one table are not brought together: they would be a task of their own."""
    text = F.col("line")
    reads = F.regexp_replace(text, r"(?i)\bdelete\s+from\b", "delete")

    def access(letter: str, pattern: str) -> Column:
        names = F.regexp_extract_all(reads if letter == "R" else text, F.lit(pattern), 1)
        return F.transform(names, lambda m: F.struct(F.lit(letter).alias("letter"), F.lower(m).alias("tbl")))

    found = F.concat(*[access(*a) for a in ACCESSES.items()])
    d = lines.select("file", "line_no", F.explode(found).alias("x")).select("file", "line_no", "x.letter", "x.tbl")
    known = materialize(known.select(F.lower("tbl").alias("tbl")).distinct(), "known")
    return d.join(broadcast_if_small(known), "tbl", "left_semi").groupBy("file", "tbl", "letter").agg(F.min("line_no").alias("line_no"))


def references(lines: DataFrame) -> DataFrame:
    """``path.ext:line`` references outside of URLs, the first of each."""
    bare = F.regexp_replace("line", r"\w+://\S+", " ")
    refs = F.regexp_extract_all(bare, F.lit(r"([\w./-]+\.\w+:\d+)"), 1)
    d = lines.select("file", "line_no", F.explode(refs).alias("ref"))
    return d.groupBy("file", "ref").agg(F.min("line_no").alias("line_no"))


def link_targets(lines: DataFrame) -> DataFrame:
    """Wiki links ``[[target|label]]`` and how often each file has them."""
    marks = F.regexp_extract_all("line", F.lit(r"\[\[([^\]|#]+)[^\]]*\]\]"), 1)
    return lines.select("file", F.explode(marks).alias("target")).groupBy("file", F.trim("target").alias("target")).count()


def sections(lines: DataFrame) -> DataFrame:
    """Section number of every line: headings count only outside of fences. Windows run per
    file."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").startswith("```")
    d = lines.withColumn("fenced", F.sum(fence.cast("int")).over(w) % 2 == 1)
    return d.withColumn("section", F.sum((F.col("line").rlike(r"^#{1,6} ") & ~F.col("fenced")).cast("int")).over(w))


def policy_rows(lines: DataFrame) -> DataFrame:
    """``- **subject**: statement`` bullets, the first of a subject."""
    d = lines.select("file", "line_no", F.regexp_extract("line", r"^\s*[-*]\s+\*\*(.+?)\*\*\s*[::]\s*(.+)$", 1).alias("subject"), F.regexp_extract("line", r"^\s*[-*]\s+\*\*(.+?)\*\*\s*[::]\s*(.+)$", 2).alias("statement")).where("subject <> ''")
    return d.groupBy("file", "subject").agg(F.min_by("statement", "line_no").alias("statement"))


def properties(lines: DataFrame) -> DataFrame:
    """``key=value`` lines, comments left out; the first of a key wins."""
    d = lines.where(~F.ltrim("line").rlike("^[#!]") & F.col("line").contains("=")).select("file", "line_no", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"))
    return d.where("key <> ''").groupBy("key").agg(F.min_by("value", F.struct("file", "line_no")).alias("value"))


def suspects(lines: DataFrame, explained: DataFrame, most: int) -> DataFrame:
    """X11, K6: lines with an http or jdbc literal, comments and explained ones left out, capped
    per file with the count of all."""
    d = lines.where(F.col("line").rlike(r"(?i)\b(https?://|jdbc:)") & ~F.ltrim("line").rlike(r"^(//|#|\*)")).join(explained, ["file", "line_no"], "left_anti")
    total = d.groupBy("file").agg(F.count("*").alias("total"))
    kept = d.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where(F.col("place") <= most)
    return kept.join(total, "file").select("file", "line_no", "total")


def verify_citations(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """A citation holds if its file is there, its line in range and its snippet, white space
    made single, in that line."""
    count = lines.groupBy("file").agg(F.max("line_no").alias("last"))
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    d = citations.join(count, "file", "left").join(lines.select("file", "line_no", "line"), ["file", "line_no"], "left")
    status = F.when(F.col("last").isNull(), "no-file").when((F.col("line_no") < 1) | (F.col("line_no") > F.col("last")), "out-of-range").when(one(F.col("line")).contains(one(F.col("snippet"))), "ok").otherwise("mismatch")
    return d.select("claim", "file", "line_no", status.alias("status"))


def summaries(lines: DataFrame) -> DataFrame:
    """Per file its non-empty lines, characters and first non-empty line."""
    d = lines.where(F.trim("line") != "")
    return d.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"), F.min_by("line", "line_no").alias("title"))


def windows(anchors: DataFrame, lines: DataFrame, before: int = 10, size: int = 80) -> DataFrame:
    """The lines from ``before`` ahead of each anchor, ``size`` of them, and if more follow."""
    a = anchors.select("file", F.col("line_no").alias("anchor")).withColumn("start", F.greatest(F.col("anchor") - before, F.lit(1)))
    # frames over the file's lines in order, one for every place a window can start at
    here = Window.partitionBy("file").orderBy("line_no")
    frame = here.rangeBetween(0, size - 1)
    frames = lines.select("file", F.col("line_no").alias("start"), F.count("*").over(frame).alias("lines"), F.sum(F.char_length("line")).over(frame).alias("chars"), (F.max("line_no").over(here.rangeBetween(0, size)) >= F.col("line_no") + size).alias("truncated"))
    return a.join(frames, ["file", "start"]).select("file", "anchor", "lines", "truncated", "chars")


def split_statements(files: DataFrame) -> DataFrame:
    """Column definitions of ``create table`` bodies, commas inside of brackets not
    splitting; a fold over characters, so a small Arrow helper per batch of files."""

    def columns(text: str) -> list[str]:
        out, depth, at = [], 0, 0
        for i, c in enumerate(text):
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                out.append(text[at:i].strip())
                at = i + 1
        return [*out, text[at:].strip()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, i, c) for f, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(columns(body or "")) if c]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["file", "pos", "definition"])

    body = F.regexp_extract("text", r"(?is)create\s+table\s+\w+\s*\((.*)\)", 1)
    return files.select("file", body.alias("body")).where("body <> ''").mapInArrow(run, "file string, pos long, definition string")


def _lines(t: Tables) -> DataFrame:
    return t.lines.withColumnRenamed("doc_id", "file")


_SQL_LINES = "q AS (SELECT o_orderkey AS file, l_linenumber AS line_no, concat(CASE l_linenumber % 4 WHEN 0 THEN 'INSERT INTO ' WHEN 1 THEN 'select * from ' WHEN 2 THEN 'update ' ELSE 'DELETE FROM ' END, CASE l_partkey % 3 WHEN 0 THEN 'T_Order' WHEN 1 THEN 'item' ELSE 'nowhere' END, CASE WHEN l_linenumber = 1 THEN ' join ITEM on 1' ELSE '' END) AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _sql_lines(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 4
    verb = F.when(n == 0, "INSERT INTO ").when(n == 1, "select * from ").when(n == 2, "update ").otherwise("DELETE FROM ")
    tbl = F.when(F.col("l_partkey") % 3 == 0, "T_Order").when(F.col("l_partkey") % 3 == 1, "item").otherwise("nowhere")
    return t.lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line_no"), F.concat(verb, tbl, F.when(F.col("l_linenumber") == 1, " join ITEM on 1").otherwise("")).alias("line"))


@query(
    "x1_sql_accesses",
    f"""{_SQL_LINES}, x AS (SELECT file, line_no, CASE line_no % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'R' WHEN 2 THEN 'U' ELSE 'D' END AS letter, lower(regexp_extract(line, '(into|from|update|FROM|INTO) (\\w+)', 2)) AS tbl FROM q UNION ALL SELECT file, line_no, 'R', 'item' FROM q WHERE line LIKE '% join ITEM%')
SELECT file, tbl, letter, CAST(min(line_no) AS BIGINT) AS line_no FROM x WHERE tbl IN ('t_order', 'item') GROUP BY file, tbl, letter""",
)
def _x1(t: Tables) -> DataFrame:
    return sql_accesses(_sql_lines(t), t.spark.createDataFrame([("T_ORDER",), ("Item",)], "tbl string"))


@query(
    "x5_sections",
    r"""h AS (SELECT doc_id AS file, line_no, CASE line_no % 7 WHEN 0 THEN concat('# ', line) WHEN 3 THEN '```' ELSE line END AS line FROM lines), f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) % 2 = 1 AS fenced FROM h)
SELECT file, line_no, CAST(sum(CASE WHEN regexp_matches(line, '^#{1,6} ') AND NOT fenced THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS section FROM f""",
    ("lines",),
)
def _x5(t: Tables) -> DataFrame:
    n = F.col("line_no") % 7
    return sections(_lines(t).withColumn("line", F.when(n == 0, F.concat(F.lit("# "), "line")).when(n == 3, "```").otherwise(F.col("line")))).select("file", "line_no", "section")


@query(
    "x9_policy_rows",
    """b AS (SELECT doc_id AS file, line_no, regexp_extract(line, '^[^ ]+') AS s, line FROM lines WHERE regexp_matches(line, '^[A-Za-z]+ ')) SELECT file, s AS subject, arg_min(line, line_no) AS statement FROM b GROUP BY file, s""",
    ("lines",),
)
def _x9(t: Tables) -> DataFrame:
    d = _lines(t).where(F.col("line").rlike("^[A-Za-z]+ "))
    return policy_rows(d.withColumn("line", F.concat(F.lit("- **"), F.substring_index("line", " ", 1), F.lit("**: "), "line")))


@query(
    "x10_properties",
    "SELECT concat('k', user_id) AS key, arg_min(concat(event_type, '=', event_id), struct_pack(f := event_type, n := event_id)) AS value FROM events WHERE event_id % 3 > 0 GROUP BY user_id",
)
def _x10(t: Tables) -> DataFrame:
    line = F.concat(F.when(F.col("event_id") % 3 == 0, " # ").otherwise(" "), F.lit("k"), F.col("user_id").cast("string"), F.lit(" = "), "event_type", F.lit("="), F.col("event_id").cast("string"))
    return properties(t.events.select(F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), line.alias("line")))


@query(
    "x11_suspects",
    "s AS (SELECT page_id % 20 AS file, page_id AS line_no FROM pages WHERE page_id % 3 > 0 AND page_id % 7 > 0 AND url LIKE 'http%') SELECT file, line_no, total FROM (SELECT *, count(*) OVER (PARTITION BY file) AS total, row_number() OVER (PARTITION BY file ORDER BY line_no) AS place FROM s) WHERE place <= 4",
)
def _x11(t: Tables) -> DataFrame:
    d = t.pages.select((F.col("page_id") % 20).alias("file"), F.col("page_id").alias("line_no"), F.concat(F.when(F.col("page_id") % 3 == 0, "// ").otherwise("u = "), "url").alias("line"))
    return suspects(d, d.where("line_no % 7 = 0").select("file", "line_no"), 4)


@query(
    "x12_verify_citations",
    r"""c AS (SELECT doc_id AS claim, CASE WHEN doc_id % 5 = 0 THEN doc_id + 1000000 ELSE doc_id END AS file, line_no + CASE WHEN doc_id % 7 = 0 THEN 100000 ELSE 0 END AS line_no, CASE WHEN doc_id % 3 = 0 THEN 'nowhere at all' ELSE substr(line, 2, 15) END AS snippet FROM lines), l AS (SELECT doc_id AS file, max(line_no) AS last FROM lines GROUP BY 1)
SELECT claim, c.file, c.line_no, CASE WHEN last IS NULL THEN 'no-file' WHEN c.line_no > last THEN 'out-of-range' WHEN contains(trim(regexp_replace(line, '\s+', ' ', 'g')), trim(regexp_replace(snippet, '\s+', ' ', 'g'))) THEN 'ok' ELSE 'mismatch' END AS status
FROM c LEFT JOIN l USING (file) LEFT JOIN lines ON doc_id = c.file AND lines.line_no = c.line_no""",
    ("lines",),
)
def _x12(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    c = t.lines.select(n.alias("claim"), F.when(n % 5 == 0, n + 1000000).otherwise(n).alias("file"), (F.col("line_no") + F.when(n % 7 == 0, 100000).otherwise(0)).alias("line_no"), F.when(n % 3 == 0, "nowhere at all").otherwise(F.substring("line", 2, 15)).alias("snippet"))
    return verify_citations(c, _lines(t))


@query("x14_summaries", "SELECT doc_id AS file, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, arg_min(line, line_no) AS title FROM lines WHERE trim(line, ' ') <> '' GROUP BY doc_id", ("lines",))
def _x14(t: Tables) -> DataFrame:
    return summaries(_lines(t))


@query(
    "x15_windows",
    "a AS (SELECT doc_id AS file, line_no AS anchor, greatest(line_no - 10, 1) AS start FROM lines) SELECT file, anchor, count(*) FILTER (WHERE line_no < start + 80) AS lines, bool_or(line_no >= start + 80) AS truncated, CAST(sum(length(line)) FILTER (WHERE line_no < start + 80) AS BIGINT) AS chars FROM a JOIN lines ON doc_id = file AND line_no BETWEEN start AND start + 80 GROUP BY file, anchor",
    ("lines",),
)
def _x15(t: Tables) -> DataFrame:
    return windows(_lines(t), _lines(t))


@query("x13_definitions", "SELECT concat('t', p_partkey) AS file, i AS pos, CASE i WHEN 0 THEN concat('id number(', p_size, ', 2)') WHEN 1 THEN concat('name ', p_brand) ELSE 'check (a in (1, 2))' END AS definition FROM part, range(3) r(i)")
def _x13(t: Tables) -> DataFrame:
    text = F.concat(F.lit("CREATE TABLE x (id number("), F.col("p_size").cast("string"), F.lit(", 2), name "), "p_brand", F.lit(" , check (a in (1, 2)))"))
    return split_statements(t.part.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("file"), text.alias("text")))
