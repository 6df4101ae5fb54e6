"""Document approval with an evidence gate and re-approval of stale claims (T5)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.fixtures import Tables
from factloom.plans.shared import materialize, scratch_dir
from factloom.registry import query

# The share of inferred claims that blocks an approval; states and what each event asks for.
INFERRED_BLOCK = 0.6
FROM = {"submit": ("DRAFT", "RETURNED"), "approve": ("UNDER_REVIEW",), "return": ("UNDER_REVIEW",), "check": ("DRAFT", "UNDER_REVIEW", "APPROVED", "RETURNED")}


def evidence_gate(claims: DataFrame) -> DataFrame:
    """T5: ``claims(doc, confidence, evidence)`` -> ``(doc, ok, bare, inferred)``: a document passes if no
    confirmed claim is without evidence and at most six tenths of its claims are inferred."""
    bare = F.count_if((F.col("confidence") == "CONFIRMED") & (F.col("evidence") == 0))
    share = F.count_if(F.col("confidence") == "INFERRED") / F.count("*")
    d = claims.groupBy("doc").agg(bare.alias("bare"), share.alias("inferred"))
    return d.select("doc", ((F.col("bare") == 0) & (F.col("inferred") <= INFERRED_BLOCK)).alias("ok"), "bare", "inferred")


def judged_events(events: DataFrame, gate: DataFrame, stale: DataFrame) -> DataFrame:
    """``events(doc, seq, event, by)`` with what a transition looks at: ``ok`` of the document's evidence (a
    document without claims passes) and the number of its stale claims, ``stale(doc, n)``."""
    d = events.join(gate.select("doc", "ok"), "doc", "left").join(stale.select("doc", F.col("n").alias("stale")), "doc", "left")
    return d.select("doc", "seq", "event", "by", F.coalesce("ok", F.lit(True)).alias("ok"), F.coalesce("stale", F.lit(0)).cast("long").alias("stale"))


def _legal(event: Column, state: Column) -> Column:
    out = F.lit(False)
    for name, states in FROM.items():
        out = F.when(event == name, state.isin(*states)).otherwise(out)
    return out


def approve_documents(judged: DataFrame) -> DataFrame:
    """T5: ``(doc, seq, event, before, after, approver, accepted)``, a row for each event of ``judged_events``:
    the audit log with the rejected transitions marked. Submitting is for drafts and returned
    documents; approving, for those under review, returns the document if its evidence does not
    pass; a check of stale claims puts a document that has any back under review. Only an approved
    document has an approver.

    A document's events are folded in order of ``seq`` in one row: people make them, so there are few."""
    start = F.struct(F.lit("DRAFT").alias("state"), F.lit(None).cast("string").alias("approver"), F.array().cast("array<struct<seq: bigint, event: string, before: string, after: string, approver: string, accepted: boolean>>").alias("log"))

    def step(s: Column, e: Column) -> Column:
        legal = _legal(e["event"], s["state"])
        idle = (e["event"] == "check") & (e["stale"] == 0)
        after = F.when(e["event"] == "submit", "UNDER_REVIEW").when(e["event"] == "approve", F.when(e["ok"], "APPROVED").otherwise("RETURNED")).when(e["event"] == "return", "RETURNED").otherwise("UNDER_REVIEW")
        state = F.when(legal & ~idle, after).otherwise(s["state"])
        approver = F.when(~legal | idle, s["approver"]).when(state == "APPROVED", e["by"])
        entry = F.struct(e["seq"].alias("seq"), e["event"].alias("event"), s["state"].alias("before"), state.alias("after"), approver.alias("approver"), legal.alias("accepted"))
        return F.struct(state.alias("state"), approver.alias("approver"), F.concat(s["log"], F.array(entry)).alias("log"))

    d = judged.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("seq", "event", "by", "ok", "stale"))).alias("events"))
    return d.select("doc", F.explode(F.aggregate("events", start, step)["log"]).alias("x")).select("doc", "x.*")


def _advance(state: str, approver: str | None, event: str, by: str, ok: bool, stale: int) -> tuple[str, str | None, bool]:
    if state not in FROM.get(event, ()):
        return state, approver, False
    if event == "check" and not stale:
        return state, approver, True
    if event == "approve":
        return ("APPROVED", by, True) if ok else ("RETURNED", None, True)
    return {"submit": "UNDER_REVIEW", "return": "RETURNED", "check": "UNDER_REVIEW"}[event], None, True


_LOG = "doc string, seq long, event string, before string, after string, approver string, accepted boolean"


def stream_approvals(judged: DataFrame) -> DataFrame:
    """T5 as a stream: the same rows as ``approve_documents``, from a streaming ``judged``. A document's
    state is its state and approver alone; events of one document must come in order of ``seq``
    from batch to batch, and are put in order within one."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, approver = held.get if held.exists else ("DRAFT", None)
        events = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in events.itertuples():
            after, approver, accepted = _advance(state, approver, r.event, r.by, bool(r.ok), int(r.stale))
            out.append((key[0], r.seq, r.event, state, after, approver, accepted))
            state = after
        held.update((state, approver))
        yield pd.DataFrame(out, columns=["doc", "seq", "event", "before", "after", "approver", "accepted"])

    return judged.groupBy("doc").applyInPandasWithState(fold, _LOG, "state string, approver string", "append", "NoTimeout")


def _judged(t: Tables, events: DataFrame) -> DataFrame:
    """Approval events of the ledger, claims from lines of orders, stale counts from parts."""
    claims = t.lineitem.select(F.concat(F.lit("doc"), (F.col("l_orderkey") % t.events.agg(F.max("user_id") + 1).first()[0]).cast("string")).alias("doc"), F.when(F.col("l_returnflag") == "A", "CONFIRMED").when((F.col("l_returnflag") == "N") | (F.col("l_linenumber") > 2), "INFERRED").otherwise("CONFIRMED").alias("confidence"), F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") < 1.5), 0).otherwise(1).alias("evidence"))
    stale = t.files.where("seq % 3 = 0").select(F.concat(F.lit("doc"), F.col("seq").cast("string")).alias("doc"), (F.col("loc") % 3).alias("n"))
    return judged_events(events, evidence_gate(claims), stale)


def _events(t: Tables) -> DataFrame:
    kind = F.element_at(F.create_map(*map(F.lit, ("view", "submit", "click", "approve", "purchase", "approve", "error", "return"))), F.col("event_type"))
    return t.events.select(F.concat(F.lit("doc"), F.col("user_id").cast("string")).alias("doc"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "check").otherwise(F.coalesce(kind, F.lit("submit"))).alias("event"), F.concat(F.lit("u"), (F.col("event_id") % 4).cast("string")).alias("by"))


_APPROVALS = """mx AS (SELECT max(user_id) + 1 AS m FROM events), ev AS (SELECT concat('doc', user_id) AS doc, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'check' ELSE CASE event_type WHEN 'view' THEN 'submit' WHEN 'click' THEN 'approve' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'return' ELSE 'submit' END END AS event, concat('u', event_id % 4) AS who FROM events),
cl AS (SELECT concat('doc', l_orderkey % m) AS doc, CASE WHEN l_returnflag = 'A' THEN 'CONFIRMED' WHEN l_returnflag = 'N' OR l_linenumber > 2 THEN 'INFERRED' ELSE 'CONFIRMED' END AS confidence, l_returnflag = 'A' AND l_quantity < 1.5 AS bare FROM lineitem, mx),
ga AS (SELECT doc, NOT bool_or(confidence = 'CONFIRMED' AND bare) AND count(*) FILTER (confidence = 'INFERRED') * 10 <= count(*) * 6 AS ok FROM cl GROUP BY doc), st AS (SELECT concat('doc', seq) AS doc, loc % 3 AS n FROM files WHERE seq % 3 = 0),
j AS (SELECT ev.*, coalesce(ok, TRUE) AS ok, coalesce(n, 0) AS stale, row_number() OVER (PARTITION BY ev.doc ORDER BY ev.seq) AS k FROM ev LEFT JOIN ga ON ga.doc = ev.doc LEFT JOIN st ON st.doc = ev.doc),
r AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seq, '' AS event, '' AS before, 'DRAFT' AS after, CAST(NULL AS VARCHAR) AS approver, TRUE AS accepted FROM j
  UNION ALL SELECT doc, k, seq, event, before, after, CASE WHEN NOT legal OR idle THEN old WHEN after = 'APPROVED' THEN who END, legal FROM (
    SELECT *, CASE WHEN NOT legal OR idle THEN before WHEN event IN ('submit', 'check') THEN 'UNDER_REVIEW' WHEN event = 'approve' AND ok THEN 'APPROVED' ELSE 'RETURNED' END AS after FROM (
      SELECT j.doc, j.k, j.seq, j.event, r.after AS before, r.approver AS old, j.who, j.ok, j.event = 'check' AND j.stale = 0 AS idle,
        CASE j.event WHEN 'submit' THEN r.after IN ('DRAFT', 'RETURNED') WHEN 'check' THEN TRUE ELSE r.after = 'UNDER_REVIEW' END AS legal FROM r JOIN j ON j.doc = r.doc AND j.k = r.k + 1)))
SELECT doc, seq, event, before, after, approver, accepted FROM r WHERE k > 0"""


@query("t5_approvals", _APPROVALS, ("files",), recursive=True)
def _t5(t: Tables) -> DataFrame:
    return approve_documents(_judged(t, _events(t)))


@query("t5_stream_approvals", _APPROVALS, ("files",), recursive=True)
def _t5s(t: Tables) -> DataFrame:
    source = materialize(_judged(t, _events(t)).withColumn("day", F.lit(0)), "judged")
    stream = t.spark.readStream.schema(source.schema).parquet(source._shared_path)
    place = f"{scratch_dir(t.spark)}/approvals-{source._shared_path.rsplit('-', 1)[1]}"
    stream_approvals(stream.drop("day")).writeStream.format("parquet").option("path", f"{place}/log").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(_LOG).parquet(f"{place}/log")
