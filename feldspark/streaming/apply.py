"""Structured Streaming: rows of a stream through frozen parameters, and running counts of cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.pipeline import stateless


def transform_stream(stream: DataFrame, params: dict) -> DataFrame:
    """The stateless part of the transform; it is the same for streams and tables."""
    return stateless(stream, params)


def card_activity(stream: DataFrame, time: str, card: str, amount: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window start, card, n, spent) of each card in tumbling windows, rows later than `late` left out."""
    per = stream.withWatermark(time, late).groupBy(F.window(time, window), card).agg(F.count("*").alias("n"), F.sum(amount).alias("spent"))
    return per.select(F.col("window.start").alias("start"), card, "n", "spent")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All available rows to Parquet, exactly once; the folder of checkpoints must outlive the executors."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
