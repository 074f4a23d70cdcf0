"""Split by time: position in time order, splits by position, windows of a fixed number of monitored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from . import stats

TRAIN, VAL, TEST, MONITOR = range(4)
NAMES = ("train", "val", "test", "monitor")
ORDER = ["TransactionDT", "TransactionID"]


def head_sample(df: DataFrame, n: int, order: list[str] = ORDER) -> DataFrame:
    """The first n rows in time."""
    return stats.first_rows(df, order, n)


def boundaries(df: DataFrame, cfg: Config, order: list[str] = ORDER) -> tuple[list[tuple], list[tuple]]:
    """The keys, in the order given, at which the validation, test and monitored rows begin, and those at which the windows do (and end).

    A list is shorter where the table has no row at a place: nothing begins there.
    """
    starts = [cfg.train_n, cfg.train_n + cfg.val_n, cfg.train_n + cfg.val_n + cfg.test_n]
    edges = [starts[-1] + i * cfg.window_rows for i in range(cfg.windows + 1)]
    found = stats.rows_at(df, order, [*starts, *edges])
    keys = lambda places: [tuple(found[p][c] for c in order) for p in places if p in found]
    return keys(starts), keys(edges)


def _reached(df: DataFrame, order: list[str], keys: list[tuple]) -> Column:
    """How many of the rising keys a row's own key has reached, by halving; nulls come first, as in sorts."""
    own = F.struct(*order)
    types = [df.schema[c].dataType for c in order]
    told = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(key, types, order, strict=True)]) for key in keys]

    def within(low: int, high: int) -> Column:
        """The count, if low to high of the keys are reached."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(own < told[middle], within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(keys))


def assign(df: DataFrame, cfg: Config, order: list[str] = ORDER) -> DataFrame:
    """df with split (0 to 3) and window_id (-1 but for the first `windows` windows of the monitored rows).

    The rows at which splits and windows begin are looked up by the order's columns alone; each row is then compared with
    them where it is, so the table is neither sorted nor shuffled. Rows that are equal in all of the order are in one split.
    """
    rows = df.drop("split", "window_id")
    starts, edges = boundaries(rows, cfg, order)
    split = _reached(rows, order, starts).cast("tinyint")
    window = _reached(rows, order, edges) - 1
    # a window of the last key's own rows, if all windows are full, is none
    window_id = F.when(window < cfg.windows, window).otherwise(-1).cast("int")
    return rows.select("*", split.alias("split"), window_id.alias("window_id"))


def train(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == TRAIN)


def sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def rates(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """(split, n, rate, off): off tells of a rate over half a percent point from that of all rows."""
    total = df.agg(F.avg(label).alias("overall"))
    per = df.groupBy("split").agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
    return per.crossJoin(F.broadcast(total)).select("split", "n", "rate", (F.abs(F.col("rate") - F.col("overall")) > 0.005).alias("off"))


def time_order(df: DataFrame, time: str = "TransactionDT") -> DataFrame:
    """(split, first, last, in_order): whether a split begins no earlier than the one before it ends."""
    per = df.groupBy("split").agg(F.min(time).alias("first"), F.max(time).alias("last"))
    return per.withColumn("in_order", F.coalesce(F.col("first") >= F.lag("last").over(Window.orderBy("split")), F.lit(True)))
