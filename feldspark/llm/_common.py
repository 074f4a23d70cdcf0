"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that one Arrow batch brings to a Python worker at most.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local one in local mode; an error on a cluster."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", named)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, written reliably to the shared folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a compressed Parquet table of the shared folder (by the session's codec, if none is named): smaller than checkpoint()."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


_CLEAR: list[Callable[[], None]] = []


def take_worker(clear: Callable[[], None]) -> None:
    """Called where a task of an operator with caches begins: a Python worker, which outlives its tasks, keeps those of one operator at a time."""
    if _CLEAR != [clear]:
        for other in _CLEAR:
            other()
        _CLEAR[:] = [clear]
