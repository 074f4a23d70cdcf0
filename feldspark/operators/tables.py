"""Intermediate tables that outlive the loss of an executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a local one only in local mode, where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Bytes of a method's code beyond which the JVM interprets it and never compiles it.
METHOD = 8000


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Within it, a projection of very many columns is evaluated by methods that the JVM compiles, instead of by one for the whole stage that it would interpret."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(METHOD, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder, so that all that is read from it agrees, by the columns that are asked for."""
    spark = df.sparkSession
    path = f"{shared(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
