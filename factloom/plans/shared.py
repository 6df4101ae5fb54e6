"""Intermediate tables that survive lost executors.

Every iterative operator cuts its lineage by writing a table to the folder that
the cluster names in ``spark.checkpoint.dir`` and reading it back: the files are
shared, so a lost executor costs nothing but its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of Parquet, that is sent to every executor.
BROADCAST_BYTES = 16 << 20
#: Rows of a large table that a task is dealt by ``spread``.
TASK_ROWS = 1 << 18


def scratch_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path  # type: ignore[attr-defined]
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` returned and nothing reads any more."""
    delete_path(df.sparkSession, df._shared_path)  # type: ignore[attr-defined]


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table that ``materialize`` returned."""
    return folder_bytes(df.sparkSession, df._shared_path)  # type: ignore[attr-defined]


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark a materialized table for broadcast if its files are within ``BROADCAST_BYTES``.

    Beyond that the join is left to Spark, which shuffles both sides.
    """
    return F.broadcast(df) if stored_bytes(df) <= BROADCAST_BYTES else df


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a side of a join that grows with the input, so that Spark shuffles it.

    Spark guesses sizes from compressed files: a table of millions of short texts can look
    small enough to be built whole in the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows or to be joined with as many, dealt by ``keys`` to so many tasks that
    one gets ``TASK_ROWS`` of them, so that its memory does not grow with the table. Spark itself would
    deal by bytes, which tell little of texts that are packed well. Few rows are left as they are."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if tasks > 1 else df


def left_join(df: DataFrame, key: str, table: DataFrame, name: str) -> DataFrame:
    """``df`` left joined with ``table`` on ``key`` = ``name``, both sides shuffled; rows whose key is
    null are spread over the tasks."""
    empty, at = F.col(key).isNull(), F.coalesce(F.col(key).cast("string"), F.xxhash64(*df.columns).cast("string"))
    right = table.where(F.col(name).isNotNull()).withColumn("_empty", F.lit(False)).withColumn("_at", F.col(name).cast("string")).drop(name)
    return df.withColumn("_empty", empty).withColumn("_at", at).join(shuffled(right), ["_empty", "_at"], "left").drop("_empty", "_at")
