"""SimHash near-duplicate groups, found with sharded BK-trees.

A fingerprint is the bitwise majority of the XXH64 values of a text's 3-word shingles.
Two fingerprints within ``radius`` bits agree on all but ``radius`` of b blocks of bits,
so each fingerprint goes to one bucket per choice of the agreeing blocks and every link
lies in some bucket. In a bucket, BK-trees (children keyed by their integer Hamming
distance to the parent) answer the radius queries, following only edges within the
radius. A bucket of more than ``shard`` fingerprints is cut into shards, and each pair of
shards is a task of its own; no tree or group is ever larger. Trees are not broadcast:
they grow with the corpus, so the queries go to the trees.

Defined results: null or blank text has fingerprint zero and is linked like any other;
repeated rows and equal texts share a fingerprint and so a component; rows with a null
doc_id get a component as others do but never name one, so one of such rows alone is null;
an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.rows import drop_rows, join_crowded
from factloom.plans.components import connected_components
from factloom.plans.shared import broadcast_if_small, materialize

RADIUS = 3
SHARD = 2048
WORDS = 3
#: For ``keep_one``: shingles of five words, and bits that texts of which nine tenths of the
#: shingles agree differ in about every second time; unrelated texts do once in 10 ** 11.
KEEP_WORDS, KEEP_RADIUS = 5, 6
_ROWS = 1 << 15


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; 0 if it has no word."""
    parts = text.lower().split()
    if not parts:
        return 0
    line, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    ends = list(itertools.accumulate(len(p) + 1 for p in parts))
    if len(parts) <= words:
        values = [hashed(line, 42)]
    else:
        values = [hashed(line[a : b - 1], 42) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]
    h = np.array(values, ">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), _ROWS):
        ones += np.unpackbits(h[k : k + _ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, text_id, fp)``, a row for each row; ``text_id`` is a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py() or b"", words) for t in texts]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], ["doc_id", "text_id", "fp"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_id"))
    return rows.mapInArrow(run, "doc_id long, text_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Trees:
    """BK-trees over many groups of fingerprints at once; group ids are 0, 1, ..."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        n = len(values)
        self.values, self.parent, self.edge = values, np.full(n, -1), np.zeros(n, np.int64)
        _, self.root = np.unique(groups, return_index=True)
        waiting = np.setdiff1d(np.arange(n), self.root, assume_unique=True)
        at = self.root[groups[waiting]]
        while len(waiting):
            d = distance(values[waiting], values[at]).astype(np.int64)
            _, lead, slot = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            self.parent[waiting[lead]], self.edge[waiting[lead]] = at[lead], d[lead]
            rest = np.ones(len(waiting), bool)
            rest[lead] = False
            at, waiting = waiting[lead][slot[rest]], waiting[rest]
        inner = np.flatnonzero(self.parent >= 0)
        order = inner[np.lexsort((self.edge[inner], self.parent[inner]))]
        self.child, self.key = order, self.parent[order] * 65 + self.edge[order]

    def within(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) places at most ``radius`` apart."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(queries), SHARD):
            q = np.arange(lo, min(lo + SHARD, len(queries)))
            node = self.root[groups[q]]
            while len(q):
                d = distance(queries[q], self.values[node]).astype(np.int64)
                hit = d <= radius
                found.append((q[hit], node[hit]))
                a = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
                b = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
                n = b - a
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, node = np.repeat(q, n), self.child[np.repeat(a, n) + step]
        return np.concatenate([x for x, _ in found] or [np.empty(0, int)]), np.concatenate([y for _, y in found] or [np.empty(0, int)])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable over the links a-b, for each of n places."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, key, i, j, side, fp) sorted by the first four -> links, at most one a row."""

    def links(t: pa.Table) -> pa.RecordBatch:
        cols = [t.column(c).to_numpy() for c in ("k", "key", "i", "j")]
        fresh = np.zeros(t.num_rows, bool)
        fresh[0] = True
        for c in cols:
            fresh[1:] |= c[1:] != c[:-1]
        group = np.cumsum(fresh) - 1
        fp = t.column("fp").to_numpy().astype(np.uint64)
        side = t.column("side").to_numpy()
        tree = np.flatnonzero(side != 1)  # 0: in the tree alone, 1: a query alone, 2: both
        query = np.flatnonzero(side != 0)
        known, dense = np.unique(group[tree], return_inverse=True)
        query = query[np.isin(group[query], known)]
        q, node = Trees(fp[tree], dense).within(fp[query], np.searchsorted(known, group[query]), radius)
        a, b = query[q], tree[node]
        root = _roots(t.num_rows, a, b)
        own = np.flatnonzero(root != np.arange(t.num_rows))
        return pa.record_batch([pa.array(fp[own].astype(np.int64)), pa.array(fp[root[own]].astype(np.int64))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 1 << 16:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(t.num_rows, bool)
        for c in ("k", "key", "i", "j"):
            v = t.column(c).to_numpy()
            last &= v == v[-1]
        cut = int(np.argmax(last))
        if cut:
            yield links(t.slice(0, cut).combine_chunks())
        held = t.slice(cut).to_batches()
        rows = t.num_rows - cut
    if rows:
        yield links(pa.Table.from_batches(held).combine_chunks())


def block_masks(n: int, radius: int) -> list[int]:
    """Masks of the bits that a bucket's members share, for about n fingerprints.

    b blocks, all but ``radius`` of which agree: more blocks as n grows, so that a bucket
    of unrelated fingerprints holds 64 or fewer on average.
    """
    for b in range(radius + 1, radius + 5):
        kept = b - radius
        if n >> (64 * kept // b) <= 64:
            break
    cut = [64 * i // b for i in range(b + 1)]
    block = [(1 << cut[i + 1]) - (1 << cut[i]) for i in range(b)]
    whole = [sum(block[i] for i in c) for c in itertools.combinations(range(b), kept)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``(fp)``, all different -> links ``(a, b)`` that connect just the fingerprints which
    a chain of pairs within ``radius`` connects."""
    masks = block_masks(distinct.count(), radius)
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("x")).select("fp", "x.k", "x.key")
    sizes = rows.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    n = F.ceil(F.col("n") / shard).cast("int")
    rows = rows.join(sizes, ["k", "key"]).select("k", "key", "fp", n.alias("n"), F.pmod(F.xxhash64("fp"), n).cast("int").alias("c"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda o: F.struct(
            F.least("c", o).alias("i"),
            F.greatest("c", o).alias("j"),
            F.when(F.col("c") == o, 2).when(F.col("c") < o, 0).otherwise(1).alias("side"),
        ),
    )
    rows = rows.select("k", "key", "fp", F.explode(pairs).alias("p")).select("k", "key", "p.i", "p.j", "p.side", "fp")
    rows = rows.repartition("k", "key", "i", "j").sortWithinPartitions("k", "key", "i", "j")
    return rows.mapInArrow(lambda it: _search(it, radius), "a long, b long").distinct()


def _classes(docs: DataFrame, radius: int, shard: int, words: int = WORDS) -> DataFrame:
    """``(doc_id, text_id, fp, place, first, least)`` of each row: of its component the first place
    and the least doc_id. Components are settled on distinct fingerprints; a fingerprint that
    many rows have, and a component of many fingerprints, are joined from a small table."""
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")
    own = materialize(fingerprints(docs, words).withColumn("place", place), "fingerprints")
    fps = materialize(own.groupBy("fp").agg(F.min("place").alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct")
    roots = materialize(connected_components(link_fingerprints(fps.select("fp"), radius, shard)).withColumnRenamed("node", "fp"), "roots")
    linked = fps.join(broadcast_if_small(roots), "fp")
    parts = materialize(linked.groupBy("root").agg(F.min("first").alias("all_first"), F.min("least").alias("all_least")), "parts")
    linked = materialize(roots.join(broadcast_if_small(parts), "root").drop("root"), "linked")
    fps = fps.join(broadcast_if_small(linked), "fp", "left")
    fps = materialize(fps.select("fp", F.coalesce("all_first", "first").alias("first"), F.coalesce("all_least", "least").alias("least"), "rows"), "fingerprint-classes")
    return join_crowded(own, fps, "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fingerprint, component_id)``, a row for each row."""
    return _classes(docs, radius, shard).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = KEEP_RADIUS, shard: int = SHARD, words: int = KEEP_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their component, in
    order of doc_id (null last) and text hash."""
    own = _classes(docs, radius, shard, words)
    return drop_rows(docs, own.where(~F.col("place").eqNullSafe(F.col("first"))).select("doc_id", "text_id"))
