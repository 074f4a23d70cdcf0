"""Features of a row and of its card's history. All windows share one partitioning and one order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..config import Config
from ..functions import scalars as S
from . import stats
from .tables import kept

# Columns whose missing values are counted together.
CRUCIAL = ("card1", "card2", "card3", "card4", "card5", "card6", "addr1", "addr2", "P_emaildomain")
KEY_PARTS = ("card1", "card2", "card3", "card5", "addr1")
#: Units of an amount: sums of amounts are taken in whole millionths.
UNITS = 1_000_000


def temporal(df: DataFrame, cfg: Config = Config(), time: str = "TransactionDT") -> DataFrame:  # noqa: B008
    """transaction_hour, _dayofweek, _part_of_day, _month and _year, and is_weekend."""
    dt = F.col(time)
    hour, dow = S.hour(dt), S.day_of_week(dt, cfg.day_of_week_offset)
    return df.select(
        "*", hour.alias("transaction_hour"), dow.alias("transaction_dayofweek"), S.is_weekend(dow).alias("is_weekend"), S.part_of_day(hour).alias("transaction_part_of_day"),
        S.month(dt, cfg.reference_epoch).alias("transaction_month"), S.year(dt, cfg.reference_epoch).alias("transaction_year"),
    )


def amounts(df: DataFrame, amount: str = "TransactionAmt") -> DataFrame:
    c = F.col(amount).cast("double")
    return df.select("*", S.log_amount(c).alias("TransactionAmt_log"), S.cents(c).alias("amt_cents"), S.is_round(c).alias("amt_is_round"))


def card_key(df: DataFrame, cfg: Config = Config()) -> Column:  # noqa: B008
    """The text that stands for a card: its parts, and the day that its first use points to."""
    text = lambda c: S.whole_text(F.col(c)) if dict(df.dtypes)[c] not in ("string",) else S.text_of(F.col(c))
    parts = [text(c) if c in df.columns else F.lit("na") for c in KEY_PARTS]
    if cfg.use_d1_uid and "D1" in df.columns:
        parts.append((S.day(F.col("TransactionDT")) - F.coalesce(F.col("D1").cast("int"), F.lit(-9999))).cast("string"))
    return S.joined(parts)


def key_ids(df: DataFrame, key: Column, into: str = "card_key_id") -> DataFrame:
    """df with the number of each row's key among the distinct keys in their order, from 0.

    Distinct keys alone are sorted, in ranges of keys; the rows are then joined with them.
    """
    keyed = df.withColumn("__key", key)
    ids = stats.positions(keyed.select("__key").distinct(), ["__key"], "__id")
    return keyed.join(ids, "__key").select(*[F.col(f"`{c}`") for c in df.columns if c != into], F.col("__id").cast("int").alias(into))


def running_count(df: DataFrame, key: list[str], order: list[str], into: str) -> DataFrame:
    """df with how many rows of the same key come before each in the order given, which begins with a number; null keys are one key.

    Rows of a key that has more than a task sorts are parted by slices of that number.
    """
    sliced, before = _slices(df, key, order[0], {"n": F.count("*")}, {"__before_n": lambda earlier, _: F.sum("n").over(earlier)})
    own = F.row_number().over(_window(key, before).orderBy(*order)) - 1
    found = _joined(sliced.withColumn("__n", own), before, key, "__before_n")
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c != into], (F.col("__n") + F.coalesce("__before_n", F.lit(0))).cast("long").alias(into))


def previous(df: DataFrame, key: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """df with the value of the row before each of the same key, in an order that begins with a number; hot keys as in running_count."""
    last = {"last": F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))}
    sliced, before = _slices(df, key, order[0], last, {"__before": lambda earlier, _: F.last("last", ignorenulls=True).over(earlier)})
    w = _window(key, before).orderBy(*order)
    found = _joined(sliced.withColumns({"__at": F.row_number().over(w), "__lag": F.lag(value).over(w)}), before, key)
    own = F.col("__lag") if before is None else F.when(F.col("__at") > 1, F.col("__lag")).otherwise(F.col("__before")["v"])
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c != into], own.alias(into))


def units(amount: Column) -> Column:
    """An amount as a whole number of units, of which sums are exact in any order; missing ones are null."""
    return F.rint(amount.cast("double") * UNITS).cast("decimal(38,0)")


def ratio(own: Column, n: Column, spent: Column) -> Column:
    """An amount over the mean of n earlier ones that are `spent` in all, within [0, 100], and 1 if there is none.

    Both are whole units. Over earlier amounts of 0 in all it is what an infinite one is clipped to: 100, 0 for a negative amount.
    """
    over = S.clip(S.divide(own.cast("double") * n, spent.cast("double")), 0.0, 100.0)
    return F.when(n == 0, F.lit(1.0)).when(spent == 0, F.when(own < 0, 0.0).when(own >= 0, 100.0)).otherwise(over)


def history(df: DataFrame, key: list[str], time: str = "TransactionDT", row: str = "TransactionID", amount: str = "TransactionAmt") -> DataFrame:
    """card_prior_txn_count, card_is_first_seen, card_time_since_last, card_velocity and amt_to_avg_card_ratio.

    Each depends on the card's earlier rows alone: those before it in (time, row). Rows of a card that has more than a
    task sorts are parted by slices of time, and what lies in the slices before is added: numbers, times and exact sums,
    so the result is the same to the last bit for any slices. Missing amounts count as 0 in sums, and have no ratio.
    """
    sums = {"n": F.count("*"), "first": F.min(time), "last": F.max(time), "spent": F.sum(units(F.col(amount)))}
    sliced, before = _slices(df, key, time, sums, {
        "__before_n": lambda earlier, _: F.sum("n").over(earlier), "__before_last": lambda earlier, _: F.max("last").over(earlier),
        "__before_first": lambda _, every: F.min("first").over(every), "__before_spent": lambda earlier, _: F.sum("spent").over(earlier),
    })
    w = _window(key, before).orderBy(time, row)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("decimal(38,0)")
    found = sliced.select(
        "*", (F.row_number().over(w) - 1).cast("long").alias("__n"), F.lag(time).over(w).alias("__last"), F.first(time).over(w).alias("__first"), F.coalesce(F.sum(units(F.col(amount))).over(earlier), none).alias("__spent"),
    )
    found = _joined(found, before, key, "__before_n", "__before_last", "__before_first", "__before_spent").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("__n") + F.coalesce("__before_n", F.lit(0))).alias("__n"),
        F.coalesce("__last", "__before_last").alias("__last"), F.coalesce("__before_first", "__first").alias("__first"), (F.col("__spent") + F.coalesce("__before_spent", none)).alias("__spent"),
    )
    n, dt = F.col("__n"), F.col(time)
    return found.select(
        *df.columns, n.cast("int").alias("card_prior_txn_count"), (n == 0).cast("tinyint").alias("card_is_first_seen"), F.coalesce(F.log1p((dt - F.col("__last")).cast("double")), F.lit(-1.0)).alias("card_time_since_last"),
        (n / ((dt - F.col("__first")) / 86400.0 + 1)).alias("card_velocity"), ratio(units(F.col(amount)), n, F.col("__spent")).alias("amt_to_avg_card_ratio"),
    )


Before = Callable[[WindowSpec, WindowSpec], Column]


def _slices(df: DataFrame, key: list[str], order: str, sums: dict[str, Column], before: dict[str, Before]) -> tuple[DataFrame, DataFrame | None]:
    """df with __slice, the part of its key's rows by ranges of `order` that a row is in (0 where a task sorts them all), and a table of what lies before each slice; df as it is and None without hot keys.

    Keys are hot with over PART_ROWS rows, so they and their slices are few: rows over PART_ROWS. sums are aggregates of a slice;
    before makes columns of them, by windows over the slices before one and over all slices of its key.
    """
    names = [f"__k{i}" for i in range(len(key))]
    counts = df.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names, strict=True)]).count().where(F.col("count") > stats.PART_ROWS)
    slices = counts.select(*names, F.ceil(F.col("count") / stats.PART_ROWS).cast("int").alias("__slices"))
    most = slices.agg(F.max("__slices")).first()[0]
    if most is None:
        return df, None
    hot = kept(slices)
    same = _same(key)
    shares = [i / most for i in range(1, most)]
    edges = kept(df.join(F.broadcast(hot), same).groupBy(*names).agg(F.array_distinct(F.percentile_approx(F.col(order).cast("double"), shares, 10 * most)).alias("__edges")))
    # values of nothing come first, as in sorts
    marked = df.join(F.broadcast(edges), same, "left").withColumn("__slice", F.coalesce(stats.bucket_of(F.col(order).cast("double"), F.col("__edges")), F.lit(0)))
    found = marked.where("__edges IS NOT NULL").groupBy(*names, F.col("__slice").alias("__of")).agg(*[c.alias(n) for n, c in sums.items()])
    every = Window.partitionBy(*names)
    earlier = every.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    table = found.select(*names, "__of", *[make(earlier, every).alias(n) for n, make in before.items()])
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], "__slice"), kept(table)


def _same(key: list[str]) -> list[Column]:
    return [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]


def _window(key: list[str], before: DataFrame | None) -> WindowSpec:
    return Window.partitionBy(*key, *(["__slice"] if before is not None else []))


def _joined(sliced: DataFrame, before: DataFrame | None, key: list[str], *names: str) -> DataFrame:
    """sliced with the columns of what lies before each row's slice; null where nothing does."""
    if before is None:
        return sliced.withColumns({n: F.lit(None) for n in names})
    return sliced.join(F.broadcast(before), [*_same(key), F.col("__slice") == F.col("__of")], "left")


def row_flags(df: DataFrame) -> DataFrame:
    """missing_crucial_info (how many of nine are missing) and email_match, for the columns that there are."""
    out = df.withColumn("missing_crucial_info", S.null_count([F.col(c) for c in CRUCIAL if c in df.columns]).cast("tinyint"))
    if {"P_emaildomain", "R_emaildomain"} <= set(df.columns):
        out = out.withColumn("email_match", S.both_equal(F.col("P_emaildomain"), F.col("R_emaildomain")))
    return out


def transform(df: DataFrame, cfg: Config) -> DataFrame:
    """All features of the stage. The card's number is an identifier; the windows partition by the key's text."""
    out = amounts(temporal(df, cfg)).withColumn("__card", card_key(df, cfg))
    out = row_flags(history(out, ["__card"]))
    out = key_ids(out, F.col("__card")).drop("__card")
    if {"card1", "addr1"} <= set(out.columns):
        out = out.withColumn("card1_addr1", S.joined([S.text_of(F.col("card1")), S.text_of(F.col("addr1"))]))
    return out


def global_mean_ratio(df: DataFrame, key: list[str], amount: str = "TransactionAmt", into: str = "amt_to_mean_ratio") -> DataFrame:
    """df with the amount over the mean of all of the card's rows, later ones too; null where that is 0. Means are sums of exact units, combined before they are shuffled, and joined."""
    own = units(F.col(amount))
    names = [f"__k{i}" for i in range(len(key))]
    sums = df.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names, strict=True)]).agg(F.sum(own).alias("__sum"), F.count(own).alias("__n"))
    ratio = S.divide(own.cast("double") * F.col("__n"), F.col("__sum").cast("double"))
    return df.join(sums, _same(key), "left").select(*[F.col(f"`{c}`") for c in df.columns if c != into], ratio.alias(into))
