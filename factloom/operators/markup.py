"""Front matter, titled sections and verdicts of Markdown reports; YAML properties."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.registry import query

# What a report must have.
REQUIRED_KEYS, REQUIRED_SECTION = ("runId", "service"), "근본 원인"


def _front(lines: DataFrame) -> DataFrame:
    """``(file, end)``: the line that closes the front matter, for files that begin with one."""
    mark = F.rtrim("line") == "---"
    d = lines.groupBy("file").agg(F.bool_or((F.col("line_no") == 1) & mark).alias("opens"), F.min(F.when(mark & (F.col("line_no") > 2), F.col("line_no"))).alias("end"))
    return d.where("opens and end is not null").select("file", "end")


def front_matter(lines: DataFrame) -> DataFrame:
    """``lines(file, line_no, line)`` -> ``(file, key, value)`` of the ``key: value`` lines between a first
    line of three dashes and the next such line; the last of a key wins."""
    inside = lines.join(_front(lines), "file").where("line_no > 1 and line_no < end")
    d = inside.where(F.instr("line", ":") > 1).select("file", "line_no", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    return d.groupBy("file", "key").agg(F.max_by("value", "line_no").alias("value"))


def titled_sections(lines: DataFrame) -> DataFrame:
    """``(file, title, line_no, text)`` of the second-level headings outside of fences and behind the
    front matter; the first of a title wins. A section's text is one row, so it must fit in memory."""
    body = lines.join(_front(lines), "file", "left").where("end is null or line_no > end")
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("fenced", F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(so_far) % 2 == 1)
    title = F.when(~F.col("fenced") & F.col("line").rlike(r"^##\s+\S"), F.regexp_extract("line", r"^##\s+(.+?)\s*$", 1))
    body = body.withColumn("title", title).withColumn("section", F.count("title").over(so_far)).where("section > 0")
    heads = body.where("title is not null").select("file", "section", "title", "line_no")
    heads = heads.groupBy("file", "title").agg(F.min(F.struct("section", "line_no")).alias("first")).select("file", "title", "first.section", "first.line_no")
    texts = body.where("title is null").groupBy("file", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    return heads.join(texts, ["file", "section"], "left").select("file", "title", "line_no", text.alias("text"))


def report_verdicts(lines: DataFrame, keys: Sequence[str] = REQUIRED_KEYS, section: str = REQUIRED_SECTION) -> DataFrame:
    """``(file, parseable, reasons, title)``: whether a report has its front matter, the keys in it and
    the section, what it lacks, and the section's first non-empty line."""
    held = front_matter(lines).where(F.col("key").isin(*keys) & (F.col("value") != "")).groupBy("file").agg(F.collect_set("key").alias("held"))
    cause = titled_sections(lines).where(F.col("title") == section).select("file", F.trim(F.split("text", "\n")[0]).alias("head"), F.lit(True).alias("has"))
    d = lines.select("file").distinct().join(_front(lines), "file", "left").join(held, "file", "left").join(cause, "file", "left")
    front = F.col("end").isNotNull()
    lacks = [F.when(~front, F.lit("no-front-matter"))]
    lacks += [F.when(front & ~F.coalesce(F.array_contains("held", k), F.lit(False)), F.lit(f"no-{k}")) for k in keys]
    lacks += [F.when(F.col("has").isNull(), F.lit("no-section"))]
    reasons = F.array_join(F.array_compact(F.array(*lacks)), ",")
    return d.select("file", (reasons == "").alias("parseable"), reasons.alias("reasons"), F.when(F.col("head") != "", F.col("head")).alias("title"))


_KEY = re.compile(r"^(\s*)([A-Za-z0-9_.-]+)\s*:\s*(.*?)\s*$")


def yaml_properties(lines: DataFrame) -> DataFrame:
    """``lines(file, line_no, line)`` -> ``(file, line_no, key, value)`` of the scalars of indented YAML
    maps, keys joined by dots. A key without a value opens a level; deeper or equal levels are closed
    by the next key; ``---`` closes all. Lists, comments and what is no key are passed over.

    A fold with a stack of open keys; a file's lines are read in order and never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stack = None, []
        for batch in batches:
            out: list[tuple] = []
            for name, line_no, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != file:
                    file, stack = name, []
                if line is None or re.match(r"^\s*(#|$)", line):
                    continue
                if re.match(r"^---\s*$", line):
                    stack = []
                    continue
                found = _KEY.match(line)
                if not found:
                    continue
                indent, key, value = len(found[1]), found[2], found[3]
                while stack and stack[-1][0] >= indent:
                    stack.pop()
                if value == "":
                    stack.append((indent, key))
                else:
                    out.append((name, line_no, ".".join([*(k for _, k in stack), key]), re.sub(r"^[\"']|[\"']$", "", value)))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["file", "line_no", "key", "value"])

    d = lines.select(F.col("file").cast("string").alias("file"), F.col("line_no").cast("long").alias("line_no"), "line")
    return d.repartition("file").sortWithinPartitions("file", "line_no").mapInArrow(run, "file string, line_no long, key string, value string")


def property_index(property_lines: DataFrame, yaml_lines: DataFrame) -> DataFrame:
    """``(key, value, file, line_no)``: the first definition of each key, by file, then by line, over
    property files (``key=value`` or ``key: value``) and YAML files."""
    pattern = r"^\s*([A-Za-z0-9_.\-\[\]]+)\s*[=:]\s*(.*?)\s*$"
    plain = property_lines.where(~F.col("line").rlike(r"^\s*[#!]") & F.col("line").rlike(pattern))
    plain = plain.select("file", F.col("line_no").cast("long").alias("line_no"), F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_extract("line", pattern, 2).alias("value"))
    both = plain.unionByName(yaml_properties(yaml_lines))
    first = both.groupBy("key").agg(F.min(F.struct("file", "line_no", "value")).alias("first"))
    return first.select("key", "first.value", "first.file", "first.line_no")


_YAML = """yaml AS (SELECT concat('conf/', domain, '.yml') AS file, seq AS line_no, CASE WHEN seq % 13 = 0 THEN '---' WHEN seq % 11 = 0 THEN '  # note' WHEN seq % 17 = 0 THEN '- item' ELSE concat(repeat(' ', CAST(loc % 4 * 2 AS INT)), 'k', loc % 5, CASE seq % 3 WHEN 0 THEN ':' WHEN 1 THEN concat(': "v', seq, '"') ELSE concat(' : ', seq, ' ') END) END AS line FROM files)"""


def _yaml(t: Tables) -> DataFrame:
    s, text = F.col("seq"), lambda c: c.cast("string")
    key = F.concat(F.repeat(F.lit(" "), (F.col("loc") % 4 * 2).cast("int")), F.lit("k"), text(F.col("loc") % 5), F.when(s % 3 == 0, ":").when(s % 3 == 1, F.concat(F.lit(': "v'), text(s), F.lit('"'))).otherwise(F.concat(F.lit(" : "), text(s), F.lit(" "))))
    line = F.when(s % 13 == 0, "---").when(s % 11 == 0, "  # note").when(s % 17 == 0, "- item").otherwise(key)
    return t.files.select(F.concat(F.lit("conf/"), "domain", F.lit(".yml")).alias("file"), s.alias("line_no"), line.alias("line"))


# the stack's indents rise, so taking off its end is keeping what is less indented
_FOLD = f"""{_YAML}, o AS (SELECT file, line_no, line, row_number() OVER (PARTITION BY file ORDER BY line_no) AS n FROM yaml),
m AS (SELECT file, line_no, n, line = '---' AS ends, CASE WHEN regexp_matches(line, '^ *k') THEN length(line) - length(ltrim(line)) END AS indent, regexp_extract(line, 'k[0-9]+') AS key, trim(regexp_extract(line, ':(.*)$', 1)) AS value FROM o),
r AS (SELECT DISTINCT file, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS line_no, CAST([] AS STRUCT(i BIGINT, k VARCHAR)[]) AS stack, CAST(NULL AS VARCHAR) AS path, '' AS value FROM yaml
  UNION ALL SELECT m.file, m.n, m.line_no, CASE WHEN ends THEN [] WHEN indent IS NULL THEN stack WHEN m.value = '' THEN list_append(list_filter(stack, lambda x: x.i < indent), {{'i': indent, 'k': key}}) ELSE list_filter(stack, lambda x: x.i < indent) END,
    CASE WHEN indent IS NOT NULL AND m.value <> '' THEN array_to_string(list_append(list_transform(list_filter(stack, lambda x: x.i < indent), lambda x: x.k), key), '.') END, trim(m.value, '"') FROM r JOIN m ON m.file = r.file AND m.n = r.n + 1)"""


@query("x10_yaml_keys", f"{_FOLD} SELECT file, line_no, path AS key, value FROM r WHERE path IS NOT NULL", ("files",), recursive=True)
def _x10(t: Tables) -> DataFrame:
    return yaml_properties(_yaml(t))


@query(
    "x10_property_index",
    f"""{_FOLD}, p AS (SELECT concat('conf/z', user_id % 20, '.properties') AS file, event_id AS line_no, concat('k', user_id % 7, '.k', event_id % 9) AS key, concat(event_type, '=', event_id) AS value FROM events WHERE event_id % 3 > 0 UNION ALL SELECT file, line_no, path, value FROM r WHERE path IS NOT NULL),
f AS (SELECT key, min((file, line_no, value)) AS x FROM p GROUP BY key) SELECT key, x[3] AS value, x[1] AS file, x[2] AS line_no FROM f""",
    ("files",),
    recursive=True,
)
def _x10b(t: Tables) -> DataFrame:
    e, text = F.col("event_id"), lambda c: c.cast("string")
    key = F.concat(F.lit("k"), text(F.col("user_id") % 7), F.lit(".k"), text(e % 9))
    line = F.concat(F.when(e % 3 == 0, " ! ").otherwise(" "), key, F.when(e % 2 == 0, " = ").otherwise(" : "), "event_type", F.lit("="), text(e))
    return property_index(t.events.select(F.concat(F.lit("conf/z"), text(F.col("user_id") % 20), F.lit(".properties")).alias("file"), e.alias("line_no"), line.alias("line")), _yaml(t))


_REPORT = """rep AS (SELECT doc_id AS file, line_no, CASE WHEN line_no = 1 AND doc_id % 6 > 0 THEN '---' WHEN line_no = 2 AND doc_id % 3 > 0 THEN concat('runId: r', doc_id) WHEN line_no = 3 AND doc_id % 4 > 0 THEN 'service : shop:main ' WHEN line_no = 4 AND doc_id % 5 > 0 THEN '---'
  WHEN line_no > 4 AND line_no % 5 = 0 THEN CASE WHEN line_no % 2 = 0 THEN '## notes' ELSE '##  근본 원인 ' END WHEN line_no > 5 AND line_no % 13 = 6 THEN '  ```' ELSE replace(replace(line, chr(13), ' '), chr(9), ' ') END AS line FROM lines),
fr AS (SELECT file, min(line_no) FILTER (line_no > 2 AND rtrim(line) = '---') AS stop FROM rep GROUP BY file HAVING bool_or(line_no = 1 AND rtrim(line) = '---') AND stop IS NOT NULL),
fm AS (SELECT file, trim(split_part(line, ':', 1)) AS key, arg_max(trim(substr(line, instr(line, ':') + 1)), line_no) AS value FROM rep JOIN fr USING (file) WHERE line_no > 1 AND line_no < stop AND instr(line, ':') > 1 GROUP BY 1, 2),
bo AS (SELECT rep.*, sum(CASE WHEN regexp_matches(line, '^[ ]*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) % 2 = 1 AS fenced FROM rep LEFT JOIN fr USING (file) WHERE stop IS NULL OR line_no > stop),
ti AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(line, '^##[ ]+[^ ]') THEN trim(substr(line, 3)) END AS title FROM bo), se AS (SELECT *, count(title) OVER (PARTITION BY file ORDER BY line_no) AS section FROM ti),
he AS (SELECT file, title, min(section) AS section, min(line_no) AS line_no FROM se WHERE title IS NOT NULL GROUP BY file, title),
tx AS (SELECT file, section, string_agg(line, chr(10) ORDER BY line_no) AS text FROM se WHERE title IS NULL GROUP BY file, section),
sec AS (SELECT file, title, he.line_no, trim(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS text FROM he LEFT JOIN tx USING (file, section))"""


def _report(t: Tables) -> DataFrame:
    n, d = F.col("line_no"), F.col("doc_id")
    line = F.when((n == 1) & (d % 6 > 0), "---").when((n == 2) & (d % 3 > 0), F.concat(F.lit("runId: r"), d.cast("string"))).when((n == 3) & (d % 4 > 0), "service : shop:main ").when((n == 4) & (d % 5 > 0), "---")
    line = line.when((n > 4) & (n % 5 == 0), F.when(n % 2 == 0, "## notes").otherwise("##  근본 원인 ")).when((n > 5) & (n % 13 == 6), "  ```").otherwise(F.translate("line", "\r\t", "  "))
    return t.lines.select(d.alias("file"), "line_no", line.alias("line"))


@query("x5_front_matter", f"{_REPORT} SELECT * FROM fm", ("lines",))
def _x5(t: Tables) -> DataFrame:
    return front_matter(_report(t))


@query("x5_titled_sections", f"{_REPORT} SELECT file, title, line_no, text FROM sec", ("lines",))
def _x5b(t: Tables) -> DataFrame:
    return titled_sections(_report(t))


@query(
    "x5_report_verdicts",
    f"""{_REPORT}, v AS (SELECT DISTINCT rep.file, stop IS NOT NULL AS front, EXISTS (SELECT 1 FROM fm WHERE fm.file = rep.file AND key = 'runId' AND value <> '') AS a, EXISTS (SELECT 1 FROM fm WHERE fm.file = rep.file AND key = 'service' AND value <> '') AS b FROM rep LEFT JOIN fr USING (file)),
w AS (SELECT v.file, array_to_string(list_filter([CASE WHEN NOT front THEN 'no-front-matter' END, CASE WHEN front AND NOT a THEN 'no-runId' END, CASE WHEN front AND NOT b THEN 'no-service' END, CASE WHEN title IS NULL THEN 'no-section' END], lambda x: x IS NOT NULL), ',') AS reasons, trim(split_part(text, chr(10), 1)) AS head FROM v LEFT JOIN sec ON sec.file = v.file AND title = '근본 원인')
SELECT file, reasons = '' AS parseable, reasons, CASE WHEN head <> '' THEN head END AS title FROM w""",
    ("lines",),
)
def _x5c(t: Tables) -> DataFrame:
    return report_verdicts(_report(t))
