"""A graph kept up by change batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from factloom.fixtures import Tables
from factloom.plans.shared import delete_path, folder_bytes, materialize, scratch_dir, shuffled
from factloom.registry import query

#: Fewest hash buckets in which rows meet the changes, and bytes of the base for each: a bucket is a task.
BUCKETS, BUCKET_BYTES = 32, 16 << 20
#: Files that the changes of a stream are dealt to; a file is a micro-batch.
BATCHES = 8


class GraphStore:
    """Nodes and edges in a base, and beside it what the batches brought.

    ``apply`` takes one batch: it writes the batch's changed files, new nodes and new edges under
    its number and reads nothing of the graph, so that a batch costs what it holds. ``nodes`` and
    ``edges`` merge: a node goes with the next change of its file, an edge with the next time that
    a node at one of its ends goes. Once the batches hold more bytes than the base, the base is
    written anew before the next batch, so that all writing grows with the input and the batches.
    A batch that is run again after a failure overwrites what it wrote; the base before the last
    and what went into it are deleted.
    """

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, buckets: int = BUCKETS, place: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.place = place or f"{scratch_dir(spark)}/graph-{uuid.uuid4().hex}"
        self.schemas = {"nodes": nodes.schema, "edges": edges.schema, "changed": nodes.select("file_path").schema}
        self.bases, self.latest, self.held = [], -1, {}
        self._write_base(nodes, edges, -1)

    def _write_base(self, nodes: DataFrame, edges: DataFrame, number: int) -> None:
        for kind, rows in (("nodes", nodes), ("edges", edges)):
            rows.select(*self.schemas[kind].names).write.mode("overwrite").parquet(f"{self.place}/base/{number}/{kind}")
        self.bases.append(number)

    def _path(self, kind: str, number: int) -> str:
        return f"{self.place}/batches/{kind}/batch={number}"

    def _dealt(self, rows: DataFrame, kind: str, key: str) -> DataFrame:
        """What the rows of a kind meet, in so many buckets that one stays small."""
        size = folder_bytes(self.spark, f"{self.place}/base/{self.bases[-1]}/{kind}")
        return shuffled(rows.repartition(max(self.buckets, -(-size // BUCKET_BYTES)), key))

    def _read(self, kind: str) -> DataFrame:
        """Rows of the base and of the batches after it, under the number of what brought them."""
        base, schema = self.bases[-1], self.schemas[kind]
        paths = [self._path(kind, n) for n in range(base + 1, self.latest + 1)]
        reader = self.spark.read.schema(StructType(schema.fields + [StructField("batch", IntegerType())]))
        brought = reader.option("basePath", f"{self.place}/batches/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], schema).withColumn("batch", F.lit(base))
        if kind == "changed":
            return brought
        return self.spark.read.schema(schema).parquet(f"{self.place}/base/{base}/{kind}").withColumn("batch", F.lit(base)).union(brought)

    def _filed(self) -> DataFrame:
        """Nodes of files, ``gone`` being the first batch after their own that changed the file."""
        changes = self._read("changed").groupBy("file_path").agg(F.collect_set("batch").alias("batches"))
        rows = self._read("nodes").where("file_path is not null").join(self._dealt(changes, "nodes", "file_path"), "file_path", "left")
        return rows.withColumn("gone", F.array_min(F.filter("batches", lambda b: b > F.col("batch")))).drop("batches")

    def apply(self, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, number: int) -> None:
        """One batch, numbered in order: nodes of the ``changed(file_path)`` files and the edges that touch
        them go, the new rows come."""
        self.latest = number - 1
        if sum(b for n, b in self.held.items() if self.bases[-1] < n < number) > folder_bytes(self.spark, f"{self.place}/base/{self.bases[-1]}"):
            self._compact()
        rows = {"changed": changed.select("file_path").where("file_path is not null").distinct(), "nodes": new_nodes, "edges": new_edges}
        for kind, df in rows.items():
            df.select(*self.schemas[kind].names).write.mode("overwrite").parquet(self._path(kind, number))
        self.held[number] = sum(folder_bytes(self.spark, self._path(kind, number)) for kind in rows)
        self.latest = number

    def _compact(self) -> None:
        """The graph as it is becomes the base; the base before the last one goes with its batches."""
        self._write_base(self.nodes(), self.edges(), self.latest)
        if len(self.bases) > 2:
            old = self.bases.pop(0)
            delete_path(self.spark, f"{self.place}/base/{old}")
            for n in range(old + 1, self.bases[0] + 1):
                for kind in self.schemas:
                    delete_path(self.spark, self._path(kind, n))

    def nodes(self) -> DataFrame:
        names = self.schemas["nodes"].names
        # a node without a file stays, and meets no change
        return self._read("nodes").where("file_path is null").select(*names).union(self._filed().where("gone is null").select(*names))

    def edges(self) -> DataFrame:
        if self.latest == self.bases[-1]:
            return self._read("edges").select(*self.schemas["edges"].names)
        gone = self._filed().where("gone is not null").groupBy("id").agg(F.max("gone").alias("gone"))
        gone, rows = materialize(gone, "gone"), self._read("edges")
        for end in ("source", "target"):
            rows = rows.join(self._dealt(gone, "edges", "id"), (rows[end] == gone["id"]) & (gone["gone"] > rows["batch"]), "left_anti")
        return rows.select(*self.schemas["edges"].names)


def stream_graph(changes: DataFrame, nodes: DataFrame, edges: DataFrame, fresh: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], buckets: int = BUCKETS) -> GraphStore:
    """Applies every micro-batch that is there. ``fresh(batch)`` gives the changed files, the new
    nodes and the new edges of a batch."""
    store = GraphStore(changes.sparkSession, nodes, edges, buckets)
    writer = changes.writeStream.foreachBatch(lambda batch, number: store.apply(*fresh(batch), number))
    writer.option("checkpointLocation", f"{store.place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store


_STREAM = """ch AS (SELECT DISTINCT f.path, n.id FROM events JOIN files f ON f.seq = user_id % (SELECT count(*) FROM part) + 1 JOIN nodes n ON n.file_path = f.path WHERE event_type = 'purchase')"""


def _stream(t: Tables) -> GraphStore:
    files = t.files.select("seq", F.col("path").alias("file_path"), "id")
    changes = t.events.where("event_type = 'purchase'").select("event_id", (F.col("user_id") % t.part.count() + 1).alias("seq")).join(files, "seq")
    changes = materialize(changes.repartition(BATCHES, "event_id"), "changes")
    stream = t.spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(changes._shared_path)

    def fresh(batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        hit = batch.select("file_path", "id").distinct()
        new_edges = hit.select(F.col("id").alias("source"), F.lit("region:0").alias("target"), F.lit("fresh").alias("kind"))
        return hit.select("file_path"), hit.select("id", F.concat("file_path", F.lit("!")).alias("name"), "file_path"), new_edges

    return stream_graph(stream, t.nodes.select("id", "name", "file_path"), t.edges.select("source", "target", "kind"), fresh)


@query("t1_stream_nodes", f"{_STREAM} SELECT n.id, CASE WHEN ch.id IS NULL THEN name ELSE concat(ch.path, '!') END AS name, file_path FROM nodes n LEFT JOIN ch ON ch.id = n.id", ("files", "nodes"))
def _t1n(t: Tables) -> DataFrame:
    return _stream(t).nodes()


@query("t1_stream_edges", f"{_STREAM} SELECT source, target, kind FROM edges WHERE source NOT IN (SELECT id FROM ch) AND target NOT IN (SELECT id FROM ch) UNION ALL SELECT id, 'region:0', 'fresh' FROM ch", ("files", "nodes", "edges"))
def _t1e(t: Tables) -> DataFrame:
    return _stream(t).edges()
