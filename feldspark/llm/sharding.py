"""Shards by jump consistent hashing: stable keys, no ring table, few moves.

A row's shard depends on its key and the number of shards alone. With one shard more, about 1 in n + 1 rows moves,
and each of them into the new shard. Numbers within a shard have no gap: they are the sum of a small table of counts
by shard and sub-bucket, and the number within the sub-bucket, so no task holds a whole shard.

Defined cases: a null key is a key of its own; rows of one key share a shard, whatever their number, and get slots in
any order of theirs; null texts count 0 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import small_batches

#: Rows of a sub-bucket, about, and sub-buckets at most: the bound on the broadcast table of counts, with that on shards.
BUCKET_ROWS, MOST_BUCKETS, MOST_SHARDS = 200_000, 4096, 4096
#: The key that null stands for.
NULL_KEY = -(1 << 63)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of unsigned 64-bit keys."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = keys.astype(np.uint64)
    at = np.full(len(key), -1, np.int64)
    to = np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    while len(open_):
        at[open_] = to[open_]
        k = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        key[open_] = k
        to[open_] = ((at[open_] + 1) * (float(1 << 31) / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        open_ = open_[to[open_] < shards]
    return at


def mixed(keys: np.ndarray) -> np.ndarray:
    """Keys spread over 64 bits (splitmix64's finaliser), since jump() takes neighbouring keys for related ones."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def with_shards(df: DataFrame, key: Column, counts: dict[str, int]) -> DataFrame:
    """df with a column of shard numbers for each (name, number of shards) of counts; key gives a long (hash other keys first)."""
    small_batches(df.sparkSession)
    if max(counts.values()) > MOST_SHARDS:
        raise ValueError(f"over {MOST_SHARDS} shards")
    kept = [c for c in df.columns if c not in counts]
    schema = df.select(*[f"`{c}`" for c in kept]).schema
    for name in counts:
        schema.add(name, "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = mixed(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(jump(keys, n), pa.int32()) for n in counts.values())], names=[*kept, *counts])

    return df.select(*[f"`{c}`" for c in kept], F.coalesce(key.cast("long"), F.lit(NULL_KEY)).alias("__key")).mapInArrow(run, schema)


def with_slots(df: DataFrame, shard: str, key: str, into: str = "slot") -> DataFrame:
    """df with numbers from 0 without a gap in each shard. df is read twice: once to count."""
    rows = df.count()
    buckets = min(MOST_BUCKETS, 1 + rows // BUCKET_ROWS * 2)
    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(max(8, buckets))).cast("int"))
    sizes = bucketed.groupBy(shard, "__bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(shard).alias("__shard"), F.col("__bucket").alias("__b"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(key)) - 1
    numbered = bucketed.withColumn("__own", own)
    joined = numbered.join(F.broadcast(offsets), (F.col(shard) == F.col("__shard")) & (F.col("__bucket") == F.col("__b")))
    return joined.select(*[f"`{c}`" for c in df.columns if c != into], (F.col("__before") + F.col("__own")).cast("long").alias(into))


def shard_documents(documents: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row, by the law `key`; grown_shard is with one shard more."""
    raw = F.col(text).cast("string").cast("binary")
    rows = documents.select(
        F.col(key), (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("text_crc32"), F.lit("key").alias("law")
    )
    return with_slots(with_shards(rows, F.col(key), {"shard": shards, "grown_shard": shards + 1}), "shard", key).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
