"""Sources and sinks over files that Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.plans.shared import scratch_dir
from factloom.registry import query
from factloom.sources import files


def _place(t: Tables, name: str) -> str:
    return f"{scratch_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _graph(t: Tables) -> DataFrame:
    """A graph document for each domain: its files, the imports that leave them, and itself as a layer."""
    nodes = t.files.groupBy("domain").agg(F.collect_list(F.struct("id", F.lit("file").alias("type"), F.col("path").alias("name"), F.col("path").alias("filePath"))).alias("nodes"), F.collect_list("id").alias("ids"))
    edges = t.file_edges.where("kind = 'import'").groupBy(F.col("source_domain").alias("domain")).agg(F.collect_list(F.struct("source", "target", F.lit("imports").alias("type"))).alias("edges"))
    layers = F.array(F.struct("domain", F.col("domain").alias("name"), F.col("ids").alias("nodeIds")))
    return nodes.join(edges, "domain", "left").select("domain", "nodes", F.coalesce("edges", F.array().cast("array<struct<source: string, target: string, type: string>>")).alias("edges"), F.transform(layers, lambda x: F.struct(x["domain"].alias("id"), x["name"].alias("name"), x["nodeIds"].alias("nodeIds"))).alias("layers"))


def _graphs(t: Tables) -> dict[str, DataFrame]:
    place = _place(t, "graphs")
    _graph(t).repartition("domain").write.option("maxRecordsPerFile", 1).json(place)
    return files.read_graphs(t.spark, place)


@query("s1_graph_nodes", "SELECT id, type, path AS name, path FROM (SELECT id, 'file' AS type, path FROM files)", ("files",))
def _s1(t: Tables) -> DataFrame:
    return _graphs(t)["nodes"].select("id", "type", "name", F.col("filePath").alias("path"))


@query("s2_fragment_edges", "SELECT source, target, 'imports' AS type FROM file_edges WHERE kind = 'import'", ("files", "file_edges"))
def _s2(t: Tables) -> DataFrame:
    return _graphs(t)["edges"].select("source", "target", "type")


@query("s3_census", "SELECT domain AS folder, 'unknown' AS lang, 'code' AS category, count(*) AS lines FROM files WHERE domain <> 'brand7' GROUP BY domain", ("files",))
def _s3(t: Tables) -> DataFrame:
    """One text file for each domain; one domain is in a vendored folder and is left out."""
    place = _place(t, "census")
    folder = F.when(F.col("domain") == "brand7", "node_modules").otherwise("src")
    rows = t.files.select("path", folder.alias("a"), "domain").repartition("domain")
    for name in ("src", "node_modules"):
        rows.where(F.col("a") == name).select("path", "domain").write.partitionBy("domain").text(f"{place}/{name}")
    found = files.census(t.spark, place)
    lang = F.when(F.col("lang") == "txt", "unknown").otherwise(F.col("lang"))
    return found.where(F.col("path").contains("/part-")).select(F.regexp_extract("path", "domain=([^/]+)/", 1).alias("folder"), lang.alias("lang"), "category", F.col("lines").cast("long").alias("lines"))


@query(
    "s4_usage_events",
    "SELECT event_id % 4 = 0 AS side, CASE WHEN event_id % 5 > 0 THEN event_type ELSE '' END AS model, event_id AS input_tokens, user_id AS output_tokens FROM events WHERE event_id % 3 > 0 AND event_id % 7 > 0",
)
def _s4(t: Tables) -> DataFrame:
    """JSON lines: rows of users, rows without use, and lines cut short are dropped."""
    e, place = F.col("event_id"), _place(t, "usage")
    use = F.struct(e.alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    row = F.to_json(F.struct(F.when(e % 3 == 0, "user").otherwise("assistant").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), (e % 4 == 0).alias("isSidechain"), F.struct(F.when(e % 5 > 0, F.col("event_type")).otherwise("").alias("model"), F.when(e % 14 > 0, use).alias("usage")).alias("message")))
    t.events.select(F.when((e % 7 == 0) & (e % 14 > 0), F.substring(row, 1, 40)).otherwise(row).alias("value")).write.text(place)
    return files.usage_events(t.spark, place).select(F.col("isSidechain").alias("side"), "model", "input_tokens", "output_tokens")


@query(
    "s5_commit_log",
    "SELECT CAST(o_orderkey AS VARCHAR) AS sha, o_orderdate AS ts, concat('dev', o_custkey) AS author, concat('p', l_partkey) AS path, CASE WHEN l_linenumber = 3 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS added, CAST(l_discount * 100 AS BIGINT) AS deleted FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
)
def _s5(t: Tables) -> DataFrame:
    """Records of a log with counts of lines; of binary files the count is a dash."""
    place, text = _place(t, "log"), lambda c: c.cast("string")
    added = F.when(F.col("l_linenumber") == 3, "-").otherwise(text(F.col("l_quantity").cast("long")))
    stat = F.concat_ws("\t", added, text((F.col("l_discount") * 100).cast("long")), F.concat(F.lit("p"), text(F.col("l_partkey"))))
    stats = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(stat), "\n").alias("stats"))
    head = F.concat_ws("\x1f", text(F.col("o_orderkey")), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.concat(F.lit("dev"), text(F.col("o_custkey"))))
    t.orders.join(stats, "o_orderkey").select(F.concat(F.lit("\x1e"), head, F.lit("\n"), "stats").alias("value")).write.text(place)
    return files.commit_log(t.spark, place)


@query("s6_report", "SELECT concat('{\"loc\":', loc, ',\"path\":\"', path, '\",\"seq\":', seq, '}') AS line FROM files", ("files",))
def _s6(t: Tables) -> DataFrame:
    place = _place(t, "report")
    files.write_report(t.files.select("seq", "path", "loc"), place, ["path"])
    return t.spark.read.text(place).select(F.col("value").alias("line"))


@query("s7_relative_graph", "SELECT id, CASE WHEN seq % 5 = 0 THEN regexp_extract(path, '[^/]*$') ELSE path END AS path, CASE WHEN seq % 2 = 0 THEN 'file' ELSE 'config' END AS type FROM files", ("files",))
def _s7(t: Tables) -> DataFrame:
    """Files within the root get relative paths; of those outside only the name stays."""
    place = _place(t, "saved")
    root = F.when(F.col("seq") % 5 == 0, "/elsewhere/").when(F.col("seq") % 5 == 1, "").otherwise("/home/app/")
    nodes = t.files.select("id", F.concat(root, "path").alias("filePath"), F.when(F.col("seq") % 2 == 0, "file").otherwise("config").alias("type"))
    files.write_graph(nodes, place, "/home/app")
    return t.spark.read.parquet(place).select("id", F.col("filePath").alias("path"), "type")


@query("s8_markdown_lines", "SELECT domain AS folder, row_number() OVER (PARTITION BY domain ORDER BY seq) AS line_no, concat('- ', seq) AS line FROM files", ("files",))
def _s8(t: Tables) -> DataFrame:
    """A Markdown file for each domain, which ends in a line break."""
    place = _place(t, "notes")
    rows = t.files.select("seq", F.concat(F.lit("- "), F.col("seq").cast("string")).alias("line"), "domain")
    # Spark names text files .txt: the notes are written by a format whose suffix can be set
    rows.repartition("domain").sortWithinPartitions("domain", "seq").select("line", "domain").write.partitionBy("domain").option("extension", ".md").csv(place)
    return files.markdown(t.spark, place).where("line <> ''").select(F.regexp_extract("file", "domain=([^/]+)/", 1).alias("folder"), F.col("line_no").cast("long").alias("line_no"), "line")
