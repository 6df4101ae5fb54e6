"""Documents dealt into memory-sized buckets, and the tables they exchange with hash ranges.

An operator over all n-grams of a corpus cannot afford a shuffled row for each of them.
Here a task owns a bucket of documents, reduces its n-grams to sorted distinct hashes,
and sends each of ``parts`` hash ranges one packed row. A range answers every bucket that
asked, in the bucket's own order. Buckets are dealt by a hash of doc_id, so a bucket that
is computed again after a lost executor holds the same rows in the same order.

``BUCKET_BYTES`` bounds a task's text. Buckets times parts rows are exchanged, so raise it
with the executors' memory on very large inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkernels as tk

BUCKET_BYTES = 4 << 20


def count_buckets(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """As many as the text needs, and no fewer than the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))


def deal(docs: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, doc_id, text)``; a null id is dealt by its text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    bucket = F.pmod(F.xxhash64(doc_id, F.when(doc_id.isNull(), text)), F.lit(buckets)).cast("int")
    return docs.select(bucket.alias("bucket"), doc_id.alias("doc_id"), text.alias("text"))


def bounds(parts: int, bits: int = 64) -> np.ndarray:
    """First value of each hash range but the first."""
    return np.array([(i << bits) // parts for i in range(1, parts)], np.uint64)


def split(values: np.ndarray, parts: int, bits: int = 64) -> list[tuple[int, int]]:
    """Places of ascending ``values`` in each hash range."""
    cut = [0, *np.searchsorted(values, bounds(parts, bits)).tolist(), len(values)]
    return list(zip(cut[:-1], cut[1:], strict=True))


class Bucket:
    """Words of a bucket's documents in order of (doc_id, text), null ids last."""

    def __init__(self, table: pa.Table):
        table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table.column("doc_id").combine_chunks()
        if isinstance(self.ids, pa.ChunkedArray):
            self.ids = pa.concat_arrays(self.ids.chunks) if self.ids.num_chunks else pa.array([], pa.int64())
        self.known = len(self.ids) - self.ids.null_count
        self.doc_ids = self.ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.data, self.offsets = tk.utf8(table.column("text"))
        self.starts, self.ends, self.first = tk.word_spans(self.data, self.offsets)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.hashes = tk.word_hashes(self.data, self.starts, self.ends)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words joined by single spaces, and each word's start and end there."""
        size = self.ends - self.starts
        end = np.cumsum(size + 1) - 1
        out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
        shift = np.repeat(end - size - self.starts, size)
        inside = np.repeat(self.starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[inside + shift] = self.data[inside]
        return out, end - size, end
