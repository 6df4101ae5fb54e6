"""Graph upserts, job and step reconciliation, sessions, document states, ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.operators.joins import replace_changed
from factloom.plans.shared import materialize, scratch_dir
from factloom.registry import query

# Grace of pending jobs, slack of artifact times, legal moves between states.
GRACE_S, SLACK_S = 1800, 1
MOVES = {"view": ("draft", "review"), "purchase": ("review", "approved"), "error": ("approved", "draft")}


def upsert(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One batch of changes: what belongs to changed files goes, the new rows come."""
    kept_nodes, kept_edges = replace_changed(nodes, edges, changed)
    return kept_nodes.unionByName(new_nodes), kept_edges.unionByName(new_edges)


def newest(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(id, version)``: each id once, with its greatest version, so that batches may come
    in any order and again."""
    return nodes.select("id", "version").union(fresh.select("id", "version")).groupBy("id").agg(F.max("version").alias("version"))


def stream_upserts(changes: DataFrame, nodes: DataFrame, fresh) -> DataFrame:
    """Upserts every micro-batch that is there into the node table, and returns the table.

    ``fresh(batch)`` gives a batch's ``(id, version)``. Each batch reads the last version of the
    table and writes the next one to the shared folder under the batch's number, so a batch that
    is run again after a failure writes the same version again.
    """
    spark = changes.sparkSession
    place = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    nodes.select("id", "version").write.parquet(f"{place}/table/-1")
    done = [-1]

    def apply(batch: DataFrame, number: int) -> None:
        newest(spark.read.parquet(f"{place}/table/{number - 1}"), fresh(batch)).write.mode("overwrite").parquet(f"{place}/table/{number}")
        done.append(number)

    changes.writeStream.foreachBatch(apply).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/table/{max(done)}")


def reconcile_jobs(jobs: DataFrame, artifacts: DataFrame, as_of: str) -> DataFrame:
    """A pending job is recorded once an artifact is no older than it (a second of slack),
    failed after the grace, else still pending."""
    fresh = artifacts.groupBy("job").agg(F.max("ts").alias("made"))
    d = jobs.join(fresh, "job", "left")
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    status = F.when(seconds(F.col("made")) >= seconds(F.col("ts")) - SLACK_S, "recorded").when(seconds(F.lit(as_of)) - seconds(F.col("ts")) > GRACE_S, "failed").otherwise("pending")
    return d.select("job", status.alias("status"))


def sessions(events: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """T4: idle-gap sessions per entity, for batch and (with a watermark) streaming input."""
    w = F.session_window("ts", gap)
    return events.groupBy("entity", w.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).select("entity", "n", "first", "last")


def document_states(events: DataFrame) -> DataFrame:
    """T5: state of each document after its events in order; a move that its state does not allow
    is rejected and counted. A fold over each document's own events."""
    moves = F.map_from_arrays(F.array(*map(F.lit, MOVES)), F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in MOVES.values()]))
    start = F.struct(F.lit("draft").alias("state"), F.lit(0).cast("long").alias("rejected"))

    def step(s, e):
        move = F.try_element_at(moves, e["event"])
        legal = move.isNotNull() & (move["a"] == s["state"])
        return F.struct(F.when(legal, move["b"]).otherwise(s["state"]).alias("state"), (s["rejected"] + F.when(move.isNotNull() & ~legal, 1).otherwise(0)).alias("rejected"))

    d = events.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "event"))).alias("log"))
    return d.withColumn("fold", F.aggregate("log", start, step)).select("entity", "fold.state", "fold.rejected")


def latest(log: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each entity."""
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("ts"), F.desc("seq")))
    return log.withColumn("place", place).where(F.col("place") <= keep)


@query(
    "t1_upsert",
    """g AS (SELECT nodes.id FROM nodes JOIN files f ON f.path = file_path WHERE f.seq % 9 = 0)
SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT concat(id, '*') FROM g""",
    ("files", "nodes"),
)
def _t1(t: Tables) -> DataFrame:
    changed = t.files.where("seq % 9 = 0").select(F.col("path").alias("file_path"))
    new = t.nodes.join(changed, "file_path", "left_semi").select("id", "type", "name", "file_path", "complexity", "seq").withColumn("id", F.concat("id", F.lit("*")))
    return upsert(t.nodes, t.edges, changed, new, t.edges.limit(0))[0].select("id")


@query(
    "t1_stream_upsert",
    "SELECT path AS id, coalesce(max(event_id), 0) AS version FROM files LEFT JOIN events ON seq = user_id % (SELECT count(*) FROM part) + 1 GROUP BY path",
    ("files",),
)
def _t1b(t: Tables) -> DataFrame:
    files = t.part.count()
    changes = materialize(t.events.select("event_id", (F.col("user_id") % files + 1).alias("seq")), "changes")
    stream = t.spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 3).parquet(changes._shared_path)
    names = t.files.select("seq", F.col("path").alias("id"))
    return stream_upserts(stream, t.files.select(F.col("path").alias("id"), F.lit(0).cast("long").alias("version")), lambda batch: batch.join(names, "seq").select("id", F.col("event_id").alias("version")))


@query(
    "t2_reconcile_jobs",
    """j AS (SELECT concat('doc', user_id) AS job, min(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1), a AS (SELECT concat('doc', user_id) AS job, max(ts) AS made FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT job, CASE WHEN epoch(made)::BIGINT >= epoch(ts)::BIGINT - 1 THEN 'recorded' WHEN epoch(TIMESTAMP '2024-01-20')::BIGINT - epoch(ts)::BIGINT > 1800 THEN 'failed' ELSE 'pending' END AS status FROM j LEFT JOIN a USING (job)""",
)
def _t2(t: Tables) -> DataFrame:
    e = t.ledger.withColumnRenamed("entity", "job")
    return reconcile_jobs(e.where("event = 'view'").groupBy("job").agg(F.min("ts").alias("ts")), e.where("event = 'purchase'"), "2024-01-20")


@query(
    "t4_sessions",
    """g AS (SELECT entity, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY entity ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM ledger), s AS (SELECT entity, ts, sum(fresh) OVER (PARTITION BY entity ORDER BY ts) AS k FROM g)
SELECT entity, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY entity, k""",
    ("ledger",),
)
def _t4(t: Tables) -> DataFrame:
    return sessions(t.ledger, "2 hours")


@query(
    "t5_document_states",
    """e AS (SELECT entity, event, row_number() OVER (PARTITION BY entity ORDER BY ts, seq) AS n FROM ledger),
m AS (SELECT * FROM (VALUES ('view', 'draft', 'review'), ('purchase', 'review', 'approved'), ('error', 'approved', 'draft')) m(event, a, b)),
r AS (SELECT DISTINCT entity, CAST(0 AS BIGINT) AS n, 'draft' AS state, CAST(0 AS BIGINT) AS rejected FROM e
  UNION ALL SELECT r.entity, e.n, CASE WHEN m.a = r.state THEN m.b ELSE r.state END, r.rejected + CASE WHEN m.a <> r.state THEN 1 ELSE 0 END FROM r JOIN e ON e.entity = r.entity AND e.n = r.n + 1 LEFT JOIN m ON m.event = e.event)
SELECT entity, arg_max(state, n) AS state, arg_max(rejected, n) AS rejected FROM r GROUP BY entity""",
    ("ledger",),
    recursive=True,
)
def _t5(t: Tables) -> DataFrame:
    return document_states(t.ledger)


@query("t6_latest", "SELECT entity, seq, place FROM (SELECT entity, seq, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, seq DESC) AS place FROM ledger) WHERE place <= 4", ("ledger",))
def _t6(t: Tables) -> DataFrame:
    return latest(t.ledger, 4).select("entity", "seq", "place")
