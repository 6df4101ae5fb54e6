"""Analyzers: from a file's text to fact rows, by language (F1); queries of text functions."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.functions import text as fn
from factloom.operators.extract import references
from factloom.operators.merge import table_hash
from factloom.operators.resolve import frameworks
from factloom.registry import query

#: ``(kind, name, line, detail)``: kinds are class, function, import, call, table and column.
Fact = tuple[str, str, int, str]
Analyzer = Callable[[str, str], Iterator[Fact]]
ANALYZERS: dict[str, Analyzer] = {}


def analyzer(*languages: str) -> Callable[[Analyzer], Analyzer]:
    """Registers a function of a file's path and text for some languages."""

    def add(f: Analyzer) -> Analyzer:
        for language in languages:
            ANALYZERS[language] = f
        return f

    return add


@analyzer("python")
def python_facts(path: str, text: str) -> Iterator[Fact]:
    """Classes, functions (of a class with its name), imports and calls of names."""

    def walk(node: ast.AST, owner: str) -> Iterator[Fact]:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, ast.ClassDef):
                yield "class", child.name, child.lineno, ",".join(ast.unparse(b) for b in child.bases)
                inner = child.name
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield "function", f"{owner}.{child.name}" if owner else child.name, child.lineno, ",".join(a.arg for a in child.args.args)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield "import", a.name, child.lineno, a.asname or ""
            elif isinstance(child, ast.ImportFrom):
                yield "import", "." * child.level + (child.module or ""), child.lineno, ",".join(a.name for a in child.names)
            elif isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
                yield "call", ast.unparse(child.func), child.lineno, ""
            yield from walk(child, inner)

    yield from walk(ast.parse(text), "")


_JAVA = (
    ("import", re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;()")),
    ("class", re.compile(r"^\s*(?:public\s+|abstract\s+|final\s+)*(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+([\w.]+))?")),
    ("function", re.compile(r"^\s*(?:public|protected|private)\s+(?:static\s+|final\s+)*[\w<>\[\],.]+\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w.,\s]+)?\{?")),
)
_JAVA_CALL = re.compile(r"\b(\w+\.\w+)\s*\(")


@analyzer("java")
def java_facts(path: str, text: str) -> Iterator[Fact]:
    """Imports, classes, methods and calls on a receiver, line by line; comment lines are passed over."""
    for number, line in enumerate(text.split("\n"), 1):
        if re.match(r"\s*(//|/?\*)", line):
            continue
        for kind, pattern in _JAVA:
            found = pattern.match(line)
            if found:
                yield kind, found[1], number, " ".join((found[2] or "").split())
                break
        else:
            for call in _JAVA_CALL.finditer(line):
                yield "call", call[1], number, ""


@analyzer("sql")
def sql_facts(path: str, text: str) -> Iterator[Fact]:
    """Tables that are created, and their columns with their types."""
    for table in re.finditer(r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)\s*\(", text):
        yield "table", table[1].lower(), text.count("\n", 0, table.start()) + 1, ""
        depth, at, start = 1, table.end(), table.end()
        while at < len(text) and depth:
            c = text[at]
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or not depth:
                column = re.match(r"\s*(\w+)\s+(\w+(?:\s*\([^)]*\))?)", text[start:at])
                if column and column[1].lower() not in ("primary", "foreign", "unique", "constraint", "check", "key"):
                    yield "column", f"{table[1].lower()}.{column[1].lower()}", text.count("\n", 0, start + column.start(1)) + 1, column[2].lower()
                start = at + 1
            at += 1


_FACTS = "path string, seq int, kind string, name string, line int, detail string"


def analyze(files: DataFrame, analyzers: dict[str, Analyzer] | None = None) -> DataFrame:
    """``files(path, lang, text)`` -> ``(path, seq, kind, name, line, detail)``, what the analyzer of each
    file's language says, in its order. A file that an analyzer cannot read gives one row of kind
    ``error``; one of a language without an analyzer gives none, as does a null text. The registry
    travels with the tasks; a file is a row, so it must fit in memory."""
    known = dict(ANALYZERS if analyzers is None else analyzers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    facts = list(known[lang](path, text))
                except (ValueError, SyntaxError, RecursionError) as error:
                    facts = [("error", type(error).__name__, 0, "")]
                rows += [(path, i, *fact) for i, fact in enumerate(facts)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "seq", "kind", "name", "line", "detail"])

    return files.where(F.col("text").isNotNull() & F.col("lang").isin(*known)).select("path", "lang", "text").mapInArrow(run, _FACTS)


def _sources(t: Tables) -> DataFrame:
    """Texts in three languages over the files."""
    k, n = F.col("seq").cast("string"), (F.col("loc") % 5).cast("string")
    java = F.concat(F.lit("import com.acme.T"), n, F.lit(";\n// import no.No;\npublic class C"), k, F.lit(" extends Base"), n, F.lit(" {\n  public int m"), n, F.lit("(int a, String b) {\n    return t.run"), n, F.lit("(a);\n  }\n}"))
    python = F.concat(F.lit("import os"), n, F.lit(" as o\n\nclass C"), k, F.lit("(B):\n    def m"), n, F.lit("(self, a):\n        return helper.f"), n, F.lit("(a)\n"))
    broken = F.concat(F.lit("def ("), k)
    sql = F.concat(F.lit("-- t\nCREATE TABLE T"), k, F.lit(" (\n  id INT,\n  c"), n, F.lit(" DECIMAL(8, 2),\n  PRIMARY KEY (id)\n);"))
    text = F.when(F.col("lang") == "java", java).when(F.col("lang") == "python", F.when(F.col("seq") % 7 == 0, broken).otherwise(python)).when(F.col("lang") == "sql", sql).otherwise("x")
    return t.files.select("path", "lang", text.alias("text"))


@query(
    "f1_facts",
    """f AS (SELECT path, lang, seq AS k, loc % 5 AS n FROM files), r AS (
SELECT path, lang, k, x.* FROM (SELECT *, unnest(CASE lang
  WHEN 'java' THEN [{'seq': 0, 'kind': 'import', 'name': concat('com.acme.T', n), 'line': 1, 'detail': ''}, {'seq': 1, 'kind': 'class', 'name': concat('C', k), 'line': 3, 'detail': concat('Base', n)}, {'seq': 2, 'kind': 'function', 'name': concat('m', n), 'line': 4, 'detail': 'int a, String b'}, {'seq': 3, 'kind': 'call', 'name': concat('t.run', n), 'line': 5, 'detail': ''}]
  WHEN 'python' THEN CASE WHEN k % 7 = 0 THEN [{'seq': 0, 'kind': 'error', 'name': 'SyntaxError', 'line': 0, 'detail': ''}] ELSE [{'seq': 0, 'kind': 'import', 'name': concat('os', n), 'line': 1, 'detail': 'o'}, {'seq': 1, 'kind': 'class', 'name': concat('C', k), 'line': 3, 'detail': 'B'}, {'seq': 2, 'kind': 'function', 'name': concat('C', k, '.m', n), 'line': 4, 'detail': 'self,a'}, {'seq': 3, 'kind': 'call', 'name': concat('helper.f', n), 'line': 5, 'detail': ''}] END
  WHEN 'sql' THEN [{'seq': 0, 'kind': 'table', 'name': concat('t', k), 'line': 2, 'detail': ''}, {'seq': 1, 'kind': 'column', 'name': concat('t', k, '.id'), 'line': 3, 'detail': 'int'}, {'seq': 2, 'kind': 'column', 'name': concat('t', k, '.c', n), 'line': 4, 'detail': 'decimal(8, 2)'}] END) AS x FROM f))
SELECT path, seq, kind, name, line, detail FROM r""",
    ("files",),
)
def _f1(t: Tables) -> DataFrame:
    return analyze(_sources(t))


@query(
    "f4_frameworks",
    """m AS (SELECT concat('doc', page_id) AS file, string_split_regex(lower(concat(html, CASE page_id % 3 WHEN 0 THEN ' Spring-Boot ' WHEN 1 THEN ' react, "@nestjs/core" ' ELSE ' nothing ' END)), '[^a-z0-9@_/-]+') AS w FROM pages),
k AS (SELECT * FROM (VALUES ('spring-boot', 'Spring'), ('react', 'React'), ('@nestjs/core', 'Nest')) v(keyword, framework)) SELECT file, string_agg(DISTINCT framework, ',' ORDER BY framework) AS frameworks FROM m JOIN k ON list_contains(w, keyword) GROUP BY file""",
)
def _f4(t: Tables) -> DataFrame:
    n = F.col("page_id") % 3
    tail = F.when(n == 0, " Spring-Boot ").when(n == 1, ' react, "@nestjs/core" ').otherwise(" nothing ")
    keywords = t.spark.createDataFrame([("spring-boot", "Spring"), ("react", "React"), ("@nestjs/core", "Nest")], "keyword string, framework string")
    return frameworks(t.pages.select(F.concat(F.lit("doc"), F.col("page_id").cast("string")).alias("file"), F.concat("html", tail).alias("text")), keywords)


@query(
    "n8_n9_names",
    """d AS (SELECT path, CASE loc % 4 WHEN 0 THEN 'findBy' WHEN 1 THEN 'saveAll' WHEN 2 THEN 'deleteOrderBy' ELSE 'zip' END AS head, loc % 3 AS n FROM files), m AS (SELECT path, concat(head, CASE n WHEN 0 THEN 'FirstNameAndAgeGreaterThan' WHEN 1 THEN 'StatusOrCreatedAtBetweenOrderByName' ELSE 'Id' END) AS method, head, n FROM d)
SELECT path, method, CASE head WHEN 'findBy' THEN 'R' WHEN 'saveAll' THEN 'C' WHEN 'deleteOrderBy' THEN 'D' END AS verb, CASE WHEN head NOT IN ('findBy', 'deleteOrderBy') THEN '' WHEN n = 0 THEN 'age,first_name' WHEN n = 1 THEN 'created_at,status' ELSE 'id' END AS columns FROM m""",
    ("files",),
)
def _n8(t: Tables) -> DataFrame:
    l4, l3 = F.col("loc") % 4, F.col("loc") % 3
    head = F.when(l4 == 0, "findBy").when(l4 == 1, "saveAll").when(l4 == 2, "deleteOrderBy").otherwise("zip")
    d = t.files.select("path", F.concat(head, F.when(l3 == 0, "FirstNameAndAgeGreaterThan").when(l3 == 1, "StatusOrCreatedAtBetweenOrderByName").otherwise("Id")).alias("method"))
    return d.select("path", "method", fn.crud_verb(F.col("method")).alias("verb"), F.array_join(fn.derived_columns(F.col("method")), ",").alias("columns"))


@query("n12_n19_lines_titles", "SELECT doc_id, CAST(len(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS BIGINT) AS lines, concat('Order ', upper(left(source, 1)), lower(substr(source, 2))) AS title FROM documents")
def _n12(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.line_count(F.col("text")).cast("long").alias("lines"), fn.title_case(F.concat(F.lit("order-_"), F.col("source"))).alias("title"))


@query(
    "x4_references",
    r"""r AS (SELECT doc_id AS file, line_no, concat('src/a', line_no % 5, '.java:', doc_id % 9 + 1) AS ref FROM lines WHERE line_no % 3 = 0 UNION ALL SELECT doc_id, line_no, 'b.ts:7' FROM lines) SELECT file, ref, min(line_no) AS line_no FROM r GROUP BY file, ref""",
    ("lines",),
)
def _x4(t: Tables) -> DataFrame:
    n = F.col("line_no")
    line = F.concat(F.lit("see http://host/x.html:80/y "), F.when(n % 3 == 0, F.concat(F.lit("at src/a"), (n % 5).cast("string"), F.lit(".java:"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" "))).otherwise(""), F.lit("(b.ts:7)"))
    return references(t.lines.select(F.col("doc_id").alias("file"), "line_no", line.alias("line")))


def page_outline(lines: DataFrame) -> DataFrame:
    """``lines(file, line_no, line)`` -> ``(file, kind, line_no, value)``: headings with their level, code fences
    with their language, wiki links with their label, and the first paragraph: the first line outside
    of fences that is no heading, list, table or quote, cut at 200 characters. Headings and links in
    fences do not count."""
    from pyspark.sql import Window

    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("line").rlike(r"^\s*```")
    d = lines.withColumn("mark", mark).withColumn("fences", F.sum(mark.cast("int")).over(so_far)).withColumn("inside", F.col("fences") % 2 == 1)
    out = lambda d, kind, value: d.select("file", F.lit(kind).alias("kind"), "line_no", value.alias("value"))
    plain = d.where("not inside and not mark")
    heads = out(plain.where(F.col("line").rlike(r"^#{1,6}\s+\S")), "heading", F.concat(F.length(F.regexp_extract("line", "^(#+)", 1)).cast("string"), F.lit(":"), F.trim(F.regexp_replace("line", r"^#+\s+", ""))))
    codes = out(d.where("mark and inside"), "code", F.regexp_extract("line", r"^\s*```\s*(\w*)", 1))
    found = plain.select("file", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\[\[([^\]]+)\]\]"), 1)).alias("link"))
    label = F.when(F.contains("link", F.lit("|")), F.substring_index("link", "|", -1))
    links = out(found, "link", F.concat_ws("|", F.trim(F.substring_index(F.substring_index("link", "|", 1), "#", 1)), F.trim(label)))
    text = plain.where((F.trim("line") != "") & ~F.col("line").rlike(r"^\s*(#|[-*+] |>|\||\d+\. )"))
    first = text.groupBy("file").agg(F.min(F.struct("line_no", "line")).alias("p")).select("file", "p.line_no", "p.line")
    return heads.union(codes).union(links).union(out(first, "paragraph", F.substring(F.trim("line"), 1, 200)))


@query(
    "x6_page_outline",
    r"""p AS (SELECT doc_id AS file, line_no, CASE line_no % 6 WHEN 1 THEN concat(repeat('#', CAST(doc_id % 3 + 1 AS INT)), ' Part ', line_no) WHEN 3 THEN concat('```', CASE WHEN line_no % 4 = 3 THEN 'sql' ELSE '' END) WHEN 4 THEN concat('go [[Page ', doc_id % 7, '#top| the page]] and [[Other]]') ELSE translate(line, chr(13) || chr(9), '  ') END AS line FROM lines),
d AS (SELECT *, regexp_matches(line, '^[ ]*```') AS mark, sum(CASE WHEN regexp_matches(line, '^[ ]*```') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) % 2 = 1 AS inside FROM p), q AS (SELECT * FROM d WHERE NOT inside AND NOT mark)
SELECT file, 'heading' AS kind, line_no, concat(length(regexp_extract(line, '^(#+)', 1)), ':', trim(regexp_replace(line, '^#+[ ]+', ''))) AS value FROM q WHERE regexp_matches(line, '^#{1,6}[ ]+[^ ]')
UNION ALL SELECT file, 'code', line_no, regexp_extract(line, '^[ ]*```[ ]*(\w*)', 1) FROM d WHERE mark AND inside
UNION ALL SELECT file, 'link', line_no, v FROM (SELECT file, line_no, unnest([concat('Page ', file % 7, '|the page'), 'Other']) AS v FROM q WHERE starts_with(line, 'go [['))
UNION ALL SELECT file, 'paragraph', f[1], substr(trim(f[2]), 1, 200) FROM (SELECT file, min((line_no, line)) AS f FROM q WHERE trim(line) <> '' AND NOT regexp_matches(line, '^[ ]*(#|[-*+] |>|\||\d+\. )') GROUP BY file)""",
    ("lines",),
)
def _x6(t: Tables) -> DataFrame:
    n, d = F.col("line_no"), F.col("doc_id")
    line = F.when(n % 6 == 1, F.concat(F.repeat(F.lit("#"), (d % 3 + 1).cast("int")), F.lit(" Part "), n.cast("string"))).when(n % 6 == 3, F.concat(F.lit("```"), F.when(n % 4 == 3, "sql").otherwise(""))).when(n % 6 == 4, F.concat(F.lit("go [[Page "), (d % 7).cast("string"), F.lit("#top| the page]] and [[Other]]"))).otherwise(F.translate("line", "\r\t", "  "))
    return page_outline(t.lines.select(d.alias("file"), "line_no", line.alias("line")))


@query("q7_same_runs", "SELECT 'graph' AS artifact, count(*) AS rows, TRUE AS equal FROM files UNION ALL SELECT 'edges', count(*), FALSE FROM file_edges", ("files", "file_edges"))
def _q7(t: Tables) -> DataFrame:
    """Two runs of each artifact, the second in other order and partitions; of edges one row differs."""
    pairs = {"graph": (t.files, t.files.repartition(5, "seq").orderBy(F.desc("path"))), "edges": (t.file_edges, t.file_edges.withColumn("line", F.col("line") + F.when(F.col("seq") == t.file_edges.agg(F.min("seq")).first()[0], 1).otherwise(0)))}
    parts = [table_hash(a).select(F.lit(name).alias("artifact"), "rows", "hash").join(table_hash(b).select(F.col("hash").alias("other")), F.lit(True)).select("artifact", "rows", (F.col("hash") == F.col("other")).alias("equal")) for name, (a, b) in pairs.items()]
    return parts[0].union(parts[1])
