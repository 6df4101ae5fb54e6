"""Graph documents, file census, event and commit logs, Markdown, deterministic sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import line_count
from factloom.operators.filters import SKIPPED_SEGMENTS, category, language

NODE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "type", "name", "filePath", "summary", "complexity")] + [T.StructField("tags", T.ArrayType(T.StringType()))])
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "target", "type", "direction")] + [T.StructField("weight", T.DoubleType())])
LAYER = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "description")] + [T.StructField("nodeIds", T.ArrayType(T.StringType()))])
GRAPH = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE)), T.StructField("layers", T.ArrayType(LAYER)), T.StructField("_corrupt", T.StringType())])
EVENT = "type string, timestamp timestamp, isSidechain boolean, message struct<model:string,usage:struct<input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long>>"


def read_graphs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One graph document a file -> nodes, edges and layers with their place ``seq`` and
    ``file``; files that cannot be read are in ``rejects``."""
    raw = spark.read.schema(GRAPH).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"))
    good = raw.where("_corrupt is null")
    rows = lambda c: good.select("file", F.posexplode(c).alias("seq", "x")).select("file", "seq", "x.*")
    return {c: rows(c) for c in ("nodes", "edges", "layers")} | {"rejects": raw.where("_corrupt is not null and nodes is null").select("file")}


def census(spark: SparkSession, root: str) -> DataFrame:
    """S3: files under ``root`` with language, category and lines; vendored folders are left out."""
    raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rel = F.expr(f"substring(path, instr(path, '{root.rstrip('/')}') + {len(root.rstrip('/')) + 1})")
    d = raw.select(rel.alias("path"), "value").where(~F.exists(F.split("path", "/"), lambda s: s.isin(*SKIPPED_SEGMENTS)))
    return d.select("path", language(F.col("path")).alias("lang"), category(F.col("path")).alias("category"), line_count(F.col("value")).alias("lines"))


def usage_events(spark: SparkSession, path: str) -> DataFrame:
    """Assistant rows that carry usage; lines that cannot be read are dropped."""
    d = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)
    return d.where("type = 'assistant' and message.usage is not null").select("timestamp", "isSidechain", "message.model", "message.usage.*")


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Records parted by 0x1E, fields by 0x1F, then numstat lines -> a row a changed file."""
    raw = spark.read.option("lineSep", "\x1e").text(path).where("trim(value) <> ''")
    lines = raw.select(F.split("value", "\n").alias("l"))
    head = F.split(F.element_at("l", 1), "\x1f")
    d = lines.select(head[0].alias("sha"), head[1].cast("timestamp").alias("ts"), head[2].alias("author"), F.explode(F.slice("l", 2, 1 << 30)).alias("stat")).where("stat like '%\t%\t%'")
    part = lambda i: F.split("stat", "\t")[i]
    number = lambda c: F.when(c == "-", 0).otherwise(c.cast("long"))
    return d.select("sha", "ts", "author", part(2).alias("path"), number(part(0)).alias("added"), number(part(1)).alias("deleted"))


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """Lines of every Markdown file."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def write_report(df: DataFrame, path: str, keys: list[str]) -> None:
    """JSON rows in order of a total key, columns by name: equal inputs give equal bytes."""
    df.select(*sorted(df.columns)).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, path: str, root: str) -> None:
    """Nodes with file paths relative to ``root``, by type; of an outer file only the name is kept."""
    p = F.col("filePath")
    inner = F.when(p.startswith(f"{root}/"), F.expr(f"substring(filePath, {len(root) + 2})")).when(p.startswith("/"), F.substring_index(p, "/", -1)).otherwise(p)
    nodes.withColumn("filePath", inner).write.mode("overwrite").partitionBy("type").parquet(path)
