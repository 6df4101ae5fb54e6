"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased (A-Z) runs of bytes other than ASCII space and punctuation. Every
``SEED``-gram of every benchmark item is a possible seed. A fixed-size Bloom filter of them,
built by Spark, picks the passages of the documents that may hold one; a join on the n-gram
hash then finds (passage, item) pairs. A seed is rare for its item unless the corpus has it
more than ``COMMON`` times as often as the item's median seed (that much more only chance
explains), so each item keeps at least half of its seeds however often it was copied.
Passages of a pair are aligned word by word with Smith-Waterman; the score is the best local
alignment's over that of the item with itself, and a pair with ``MIN_SCORE`` or more is a leak.

Nothing of benchmark or corpus size is broadcast: the filter has ``BLOOM_BITS`` bits whatever
the benchmark's size (a fuller filter lets more passages through, and the join is exact), and
texts of items and passages meet by joins. A passage that holds a seed reaches one longest
item's length to both sides, so an alignment is never cut short.

Defined results: null and blank texts hold nothing; an item of fewer than ``SEED`` words has
itself as its one seed and is found where it comes whole; a null doc_id or item_id is kept as
null in the pair; of equal rows each is reported once per (doc_id, item_id), with the best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkernels as tk
from factloom.plans.shared import broadcast_if_small, materialize

SEED = 4
COMMON = 8
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOOM_BITS = 1 << 23
_GROUP = 1 << 22

_BREAK = tk.SPACE.copy()
_BREAK[[b for b in range(128) if not chr(b).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and each row's first."""
    data, offsets = tk.utf8(column)
    starts, ends, first = tk.word_spans(data, offsets, _BREAK)
    return tk.word_hashes(data, starts, ends, _FOLD), first


def _seeds(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes and first words' places, ascending by place."""
    h, at = tk.window_hashes(words, first, SEED)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SEED))
    if not len(short):
        return h, at
    more = []
    for r in short:
        n = first[r + 1] - first[r]
        more.append(tk.window_hashes(words[first[r] : first[r + 1]], np.array([0, n]), n, seed=int(n))[0][0])
    at = np.concatenate([at, first[short]])
    order = np.argsort(at, kind="stable")
    return np.concatenate([h, np.array(more, np.uint64)])[order], at[order]


def _possible_seeds(words: np.ndarray, first: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of ``SEED`` words and of the sizes of shorter items."""
    found = [tk.window_hashes(words, first, SEED), *(tk.window_hashes(words, first, n, seed=n) for n in sizes)]
    return np.concatenate([h for h, _ in found]), np.concatenate([a for _, a in found])


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(s)) % np.uint64(BLOOM_BITS) for s in (0, 20, 40)]


def item_seeds(items: DataFrame) -> DataFrame:
    """``(item, seed, size)`` of every seed of every item; ``size`` is the item's in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _words(batch.column(1))
            h, at = _seeds(words, first)
            row = np.searchsorted(first, at, "right") - 1
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(first[row + 1] - first[row], pa.int32())], ["item", "seed", "size"])

    return items.select("item", "text").mapInArrow(run, "item long, seed long, size int")


def _bloom(seeds: DataFrame) -> bytes:
    """The filter's bits: each task sets its own, a tree of bitwise ors joins them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            for slot in _slots(batch.column(0).to_numpy().view(np.uint64)):
                bits[slot] = True
        packed = np.packbits(bits).view(">u8")
        at = np.flatnonzero(packed)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(packed[at].astype(np.uint64).view(np.int64))], ["at", "bits"])

    words = seeds.select("seed").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    for r in words.collect():  # at most BLOOM_BITS / 64 rows
        out[r["at"]] = np.int64(r.bits).view(np.uint64)
    return out.astype(">u8").tobytes()


def passages(docs: DataFrame, bloom: bytes, reach: int, sizes: list[int]) -> DataFrame:
    """``(passage, doc_id, words array<long>, seeds array<long>)``: the surroundings of
    possible seeds, overlapping ones as one passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bloom, np.uint8)).astype(bool)
        for batch in batches:
            cut, held = [0], 0
            for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()):
                if held and held + n > _GROUP:
                    cut.append(i)
                    held = 0
                held += n
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                words, first = _words(part.column(1))
                h, at = _possible_seeds(words, first, sizes)
                s = _slots(h)
                hit = np.flatnonzero(bits[s[0]] & bits[s[1]] & bits[s[2]])
                hit = hit[np.argsort(at[hit], kind="stable")]
                h, at = h[hit], at[hit]
                row = np.searchsorted(first, at, "right") - 1
                lo, hi = np.maximum(at - reach, first[row]), np.minimum(at + reach + SEED, first[row + 1])
                fresh = np.ones(len(at), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])
                lead = np.flatnonzero(fresh)
                end = np.append(lead[1:], len(at))[: len(lead)]
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(row[lead])),
                        pa.array([words[lo[x] : hi[y - 1]].view(np.int64) for x, y in zip(lead, end, strict=True)], pa.list_(pa.int64())),
                        pa.array([h[x:y].view(np.int64) for x, y in zip(lead, end, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "words", "seeds"],
                )

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, words array<long>, seeds array<long>")
    return found.withColumn("passage", F.xxhash64("doc_id", "words", "seeds"))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score (Smith-Waterman, linear gaps) and its end in the passage.

    Row by row: a gap along the row is a running maximum, so each row is a few vector steps.
    """
    m = len(passage)
    ramp = np.arange(1, m + 1) * -GAP
    above = np.zeros(m + 1, np.int64)
    best, end = 0, 0
    for w in item:
        row = np.where(passage == w, MATCH, MISMATCH) + above[:-1]
        np.maximum(row, above[1:] + GAP, out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top + 1
        above = np.concatenate([[0], row])
    return best, end


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [align(np.array(i, np.int64), np.array(p, np.int64)) for i, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        size = np.array([len(i) for i in batch.column(2).to_pylist()])
        score = np.array([s for s, _ in found]) / np.maximum(MATCH * size, 1)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["doc_id", "item_id", "score"])


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs(doc_id, text, ...)`` and ``benchmark(item_id, text, ...)`` -> the leaks
    ``(doc_id, item_id, n_item_words, score)``."""
    text = F.col("text").cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).where("text is not null").distinct()
    items = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    seeds = materialize(item_seeds(items).distinct(), "seeds")
    longest = seeds.agg(F.max("size")).first()[0]
    if longest is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item_words int, score double")
    sizes = sorted(r["size"] for r in seeds.where(F.col("size") < SEED).select("size").distinct().collect())
    near = materialize(passages(docs, _bloom(seeds), 2 * longest, sizes), "passages")
    hits = near.select("passage", "doc_id", F.explode(F.array_distinct("seeds")).alias("seed"))
    counts = hits.groupBy("seed").agg(F.count("*").alias("n"))
    ranked = seeds.join(counts, "seed")
    median = ranked.groupBy("item").agg(F.percentile("n", 0.5).alias("median"))
    rare = materialize(ranked.join(median, "item").where(F.col("n") <= COMMON * F.col("median")).select("seed", "item"), "rare")
    pairs = hits.select("passage", "seed").join(broadcast_if_small(rare), "seed").select("passage", "item").distinct()
    words = materialize(_item_words(items), "items")
    pairs = pairs.join(broadcast_if_small(words), "item")
    pairs = pairs.join(near.select("passage", "doc_id", F.col("words").alias("own")), "passage")
    scored = pairs.select("doc_id", "item_id", "words", "own").mapInArrow(_align, "doc_id long, item_id long, score double")
    best = scored.where(F.col("score") >= min_score).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
    size = words.groupBy("item_id").agg(F.max(F.size("words")).alias("n_item_words"))
    return best.join(size, best.item_id.eqNullSafe(size.item_id)).select("doc_id", best.item_id, "n_item_words", "score")


def _item_words(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _words(batch.column(2))
            rows = [words[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64()))], ["item", "item_id", "words"])

    return items.select("item", "item_id", "text").mapInArrow(run, "item long, item_id long, words array<long>")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no leak is found."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = leaks(docs.select(key.alias("doc_id"), "text"), benchmark, min_score)
    found = materialize(found.select(F.col("doc_id").alias("leaked")).distinct(), "leaked")
    return docs.join(broadcast_if_small(found), key == F.col("leaked"), "left_anti")
