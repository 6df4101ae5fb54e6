"""Dropping rows of ``documents`` by what an operator decided about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.shared import broadcast_if_small, materialize

#: A key with more than this share of all rows is crowded; there are no more such keys than
#: its inverse.
CROWDED = 1e-4


def join_crowded(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``table(key, ..., rows)``, which has each key of ``rows`` once and says
    how many rows it has. Keys that many rows have are broadcast, so that no task gets them all."""
    least = CROWDED * (table.agg(F.sum("rows")).first()[0] or 0)
    crowded = table.where(F.col("rows") > least).drop("rows")
    others = table.where(F.col("rows") <= least).drop("rows")
    keys = F.broadcast(crowded.select(key))
    return rows.join(F.broadcast(crowded), key).unionByName(rows.join(keys, key, "left_anti").join(others, key))


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone(doc_id, text_id)``, where ``text_id`` is the XXH64
    of the text. Rows equal in id and text are one document: they go or stay together."""
    gone = materialize(gone.distinct().toDF("gone_doc", "gone_text"), "gone")
    same = F.xxhash64(docs["text"].cast("string")) == F.col("gone_text")
    return docs.join(broadcast_if_small(gone), same & docs["doc_id"].cast("long").eqNullSafe(F.col("gone_doc")), "left_anti")
