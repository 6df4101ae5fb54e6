"""Language-model scores by stupid backoff over the corpus's own n-gram counts.

Count tables of orders 1 to 3 are partitioned by n-gram hash. Each bucket of documents sends
its distinct n-grams with their counts to the hash ranges, which add up the tables and
answer with the corpus counts; each bucket joins them to its n-grams and sums per document.
Counts cover every document. A document is scored by those of all the others: what it counts
itself is taken off first, since every n-gram of the corpus is in its own tables at least once
and backoff would never be taken. With c so reduced, and N words in the other documents,

    S(w | u v) = c(u v w) / c(u v)  if c(u v w) > 0,  else 0.4 S(w | v)
    S(w | v)   = c(v w) / c(v)      if c(v w) > 0,    else 0.4 max(c(w), 1) / N

so a word that no other document has counts as one that comes once. n-grams are identified by
``HASH_BITS``-bit hashes. Defined results: a null or blank text has no words and score 0;
repeated rows are documents of their own, also with a null doc_id; N is 1 at least; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm import textkernels as tk
from factloom.llm.buckets import Bucket, count_buckets, deal, split
from factloom.llm.packed import pack, pack_sorted, unpack, unpack_sorted

BACKOFF = 0.4
#: Bits of an n-gram's hash that identify it, and text of a bucket of documents.
HASH_BITS = 56
BUCKET_BYTES = 8 << 20
ORDERS = (1, 2, 3)

_BLOBS = ", ".join(f"h{k} binary, c{k} binary" for k in ORDERS)
TABLES = f"bucket int, part int, words long, {_BLOBS}"
RESULT = "doc_id long, n_words long, n_order3 long, n_order2 long, n_order1 long, log_score double"


def _grams(bucket: Bucket, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, each n-gram's place among them, counts, and first words' places."""
    h, at = tk.window_hashes(bucket.hashes, bucket.first, order, seed=order)
    values, place, count = np.unique(h >> np.uint64(64 - HASH_BITS), return_inverse=True, return_counts=True)
    return values, place, count, at


def _ask(parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        out = {"bucket": pa.array([key[0].as_py()] * parts, pa.int32()), "part": pa.array(range(parts), pa.int32()), "words": pa.array([0] * parts, pa.int64())}
        for k in ORDERS:
            values, _, count, _ = _grams(bucket, k)
            cuts = split(values, parts, HASH_BITS)
            out[f"h{k}"] = pa.array([pack_sorted(values[a:b]) for a, b in cuts], pa.binary())
            out[f"c{k}"] = pa.array([pack(count[a:b].astype("<u4")) for a, b in cuts], pa.binary())
        return pa.table(out)

    return run


def _add(key: tuple, table: pa.Table) -> pa.Table:
    """Sums the counts of a hash range; answers each bucket in the order it asked."""
    n, words = table.num_rows, 0
    out = {"bucket": table.column("bucket"), "part": table.column("part")}
    blobs = {}
    for k in ORDERS:
        lists = [unpack_sorted(b) for b in table.column(f"h{k}").to_pylist()]
        counts = np.concatenate([unpack(b, "<u4") for b in table.column(f"c{k}").to_pylist()])
        if k == 1:
            words = int(counts.sum(dtype=np.int64))
        _, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(place, weights=counts).astype("<u8")[place]
        cut = np.cumsum([0, *map(len, lists)])
        blobs[f"h{k}"] = pa.array([b""] * n, pa.binary())
        blobs[f"c{k}"] = pa.array([pack(total[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
    return pa.table(out | {"words": pa.array([words] * n, pa.int64())} | blobs)


def _score(parts: int):
    def run(key: tuple, docs: pa.Table, tables: pa.Table) -> pa.Table:
        bucket = Bucket(docs)
        tables = tables.sort_by("part")
        total = sum(tables.column("words").to_pylist())
        n = len(bucket.hashes)
        count = {}
        for k in ORDERS:
            values, place, _, at = _grams(bucket, k)
            answer = np.concatenate([unpack(b, "<u8") for b in tables.column(f"c{k}").to_pylist()] or [np.empty(0, "<u8")])
            _, own, often = np.unique(bucket.doc[at] * max(len(values), 1) + place, return_inverse=True, return_counts=True)
            count[k] = np.zeros(n, np.float64)
            count[k][at] = answer[place].astype(np.int64) - often[own]  # in the other documents
        one, two, three = (count[k] for k in ORDERS)
        others = np.maximum(total - np.diff(bucket.first)[bucket.doc], 1)
        log = np.log(np.maximum(one, 1)) - np.log(others)
        order = np.ones(n, np.int64)
        log += 2 * np.log(BACKOFF)
        first = np.zeros(n, bool)
        first[bucket.first[:-1][np.diff(bucket.first) > 0]] = True
        second = np.zeros(n, bool)
        second[1:] = first[:-1] & ~first[1:]
        log[first] -= 2 * np.log(BACKOFF)
        log[second] -= np.log(BACKOFF)
        seen = np.flatnonzero(two > 0)  # first words of bigrams; the word scored is the next
        log[seen + 1] = np.log(two[seen]) - np.log(one[seen]) + np.where(second[seen + 1], 0.0, np.log(BACKOFF))
        order[seen + 1] = 2
        seen = np.flatnonzero(three > 0)
        log[seen + 2] = np.log(three[seen]) - np.log(two[seen])
        order[seen + 2] = 3
        rows = len(bucket.ids)
        by = [np.bincount(bucket.doc[order == k], minlength=rows) for k in ORDERS]
        return pa.table({"doc_id": bucket.ids, "n_words": pa.array(np.diff(bucket.first), pa.int64()), "n_order3": pa.array(by[2], pa.int64()), "n_order2": pa.array(by[1], pa.int64()), "n_order1": pa.array(by[0], pa.int64()), "log_score": pa.array(np.bincount(bucket.doc, weights=log, minlength=rows), pa.float64())})

    return run


def score(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: words scored at each order and the
    sum of log scores."""
    n = count_buckets(docs, BUCKET_BYTES)
    dealt = deal(docs, n)
    tables = dealt.groupBy("bucket").applyInArrow(_ask(n), TABLES).groupBy("part").applyInArrow(_add, TABLES)
    return dealt.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(_score(n), RESULT)
