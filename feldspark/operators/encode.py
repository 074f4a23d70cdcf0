"""Encoders fitted on training rows: frequencies, ordinal codes, T/F maps and interactions.

A vocabulary is a table (column, value, count, code); all columns are counted in one pass. In the pipeline frequencies are
those of the `freq_top` most frequent values, codes those of all; a column's vocabulary is broadcast while its values, which are counted, are few, and joined by shuffle beyond.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import roles
from ..config import Config
from ..functions import scalars as S
from . import stats
from .tables import kept

UNKNOWN = "unknown"
# Which columns get which code.
FREQUENCY = ("card1", "card2", "card3", "card5", "addr1", "addr2", "P_emaildomain", "R_emaildomain", "DeviceInfo")
ORDINAL = ("ProductCD", "card4", "card6", "DeviceType")
TRUE_FALSE = tuple(f"M{i}" for i in range(1, 10))
#: Rows of a vocabulary that may be broadcast (about 60 bytes each).
BROADCAST_ROWS = 1_000_000
#: Values of a column that are looked up in a literal.
FEW = 64


def fit(train: DataFrame, columns: list[str], top: int | None = 50_000, missing: str = UNKNOWN, whole: Collection[str] = ()) -> DataFrame:
    """(column, value, count, code): the `top` most frequent values of each column, or all (None, and for columns in `whole`); code is the rank by count, then value.

    How many values have each count, of which there are few, tells the least count that is among the first `top`; values
    below it are left out before any ranking. Ranks are positions in ranges of the whole order, less that of the column's
    first value, so no task ranks all values of a column.
    """
    filled = train.select(*[S.text_of(F.col(f"`{c}`"), missing).alias(c) for c in columns])
    counts = kept(stats.value_counts(filled, columns))
    cut = [c for c in columns if c not in whole] if top is not None else []
    if cut:
        ladder = counts.where(F.col("column").isin(cut)).groupBy("column", "count").agg(F.count("*").alias("values"))
        above = F.coalesce(F.sum("values").over(Window.partitionBy("column").orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        least = ladder.withColumn("above", above).where(F.col("above") < top).groupBy("column").agg(F.min("count").alias("least"))
        counts = counts.join(F.broadcast(least), "column", "left").where(F.col("least").isNull() | (F.col("count") >= F.col("least"))).drop("least")
    placed = stats.positions(counts.withColumn("__down", -F.col("count")), ["column", "__down", "value"], "__position")
    first = placed.groupBy("column").agg(F.min("__position").alias("__first"))
    ranked = placed.join(F.broadcast(first), "column").select("column", "value", "count", (F.col("__position") - F.col("__first")).alias("code"))
    return ranked.where(~F.col("column").isin(cut) | (F.col("code") < top)) if cut else ranked


def sizes(vocabulary: DataFrame) -> dict[str, int]:
    """Values of each column, in one job."""
    return {r["column"]: r["count"] for r in vocabulary.groupBy("column").count().collect()}


def _lookup(df: DataFrame, vocabulary: DataFrame, column: str, of: str, into: str, missing: str, default: Column, size: int | None = None) -> DataFrame:
    words = vocabulary.where(F.col("column") == column).select(F.col("value").alias("__value"), F.col(of).alias("__found"))
    size = words.limit(BROADCAST_ROWS + 1).count() if size is None else size
    words = F.broadcast(words) if size <= BROADCAST_ROWS else words
    keyed = df.withColumn("__text", S.text_of(F.col(f"`{column}`"), missing))
    joined = keyed.join(words, F.col("__text") == F.col("__value"), "left")
    return joined.select(*[f"`{c}`" for c in df.columns if c != into], F.coalesce("__found", default).alias(into))


def apply_frequency(df: DataFrame, vocabulary: DataFrame, column: str, into: str | None = None, total: int | None = None, missing: str = UNKNOWN, size: int | None = None) -> DataFrame:
    """df with the training count of each row's value, 0 for one not seen; with `total`, its share of that."""
    into = into or f"{column}_freq"
    found = _lookup(df, vocabulary, column, "count", into, missing, F.lit(0).cast("long"), size)
    value = F.col(into).cast("double") if total is None else F.col(into) / F.lit(float(max(total, 1)))
    return found.withColumn(into, value)


def apply_ordinal(df: DataFrame, vocabulary: DataFrame, column: str, into: str | None = None, missing_code: int | None = None, missing: str = UNKNOWN, size: int | None = None) -> DataFrame:
    """df with the code of each row's value, -1 for one not seen. A missing value has the code of `unknown`, or missing_code if given."""
    into = into or column
    found = _lookup(df, vocabulary, column, "code", "__code", missing, F.lit(-1), size)
    code = F.col("__code") if missing_code is None else F.when(F.col(f"`{column}`").isNull(), missing_code).otherwise(F.col("__code"))
    return found.select(*[f"`{c}`" for c in df.columns if c != into], code.cast("int").alias(into))


def is_true_false(vocabulary: DataFrame, column: str) -> bool:
    """Whether all training values are T, F or missing."""
    return vocabulary.where((F.col("column") == column) & ~F.col("value").isin("T", "F", UNKNOWN)).isEmpty()


def plan(df: DataFrame) -> dict[str, list[str]]:
    """The columns of df by encoder; strings that none names are ordinal as id_ columns, else dropped."""
    frequency = [c for c in FREQUENCY if c in df.columns]
    flags = [c for c in TRUE_FALSE if c in df.columns]
    ids = [c for c in roles.strings(df) if roles.family(c) == "id" and c not in frequency]
    ordinal = [c for c in ORDINAL if c in df.columns] + ids
    pair = ["card1_addr1"] if "card1_addr1" in df.columns else []
    return {"frequency": frequency, "pair": pair, "true_false": flags, "ordinal": ordinal}


def _found(df: DataFrame, vocabulary: DataFrame, wanted: dict[str, tuple[str, str]], default: Column) -> tuple[DataFrame, dict[str, Column]]:
    """df joined with what the vocabulary has, and a column of it for each name: name -> (column, count or code).

    Columns of few values are looked up in a literal; the others' vocabularies are joined, broadcast while they are small.
    """
    known = sizes(vocabulary)
    of = {c: what for c, what in wanted.values()}
    few = [c for c in of if known.get(c, 0) <= FEW]
    words: dict[str, list] = {c: [] for c in few}
    for r in vocabulary.where(F.col("column").isin(few)).collect() if few else []:
        words[r["column"]] += [F.lit(r["value"]), F.lit(r[of[r["column"]]]).cast("long")]
    values: dict[str, Column] = {}
    for c, what in of.items():
        text = S.text_of(F.col(f"`{c}`"), UNKNOWN)
        if c in few:
            values[c] = F.coalesce(F.create_map(*words[c])[text], default) if words[c] else default
            continue
        own = vocabulary.where(F.col("column") == c).select(F.col("value").alias(f"__value_{c}"), F.col(what).cast("long").alias(f"__found_{c}"))
        df = df.join(F.broadcast(own) if known[c] <= BROADCAST_ROWS else own, text == F.col(f"__value_{c}"), "left")
        values[c] = F.coalesce(F.col(f"__found_{c}"), default)
    return df, {name: values[c] for name, (c, _) in wanted.items()}


def transform(df: DataFrame, vocabulary: DataFrame, columns: dict[str, list[str]], cfg: Config, flags_by_code: tuple[str, ...] = (), total: int | None = None) -> DataFrame:
    """All encodings of the plan in one projection; the strings they came from go. flags_by_code: M columns that aren't T and F alone."""
    counted = {f"{c}_freq": (c, "count") for c in columns["frequency"]} | {"card_addr_freq": (c, "count") for c in columns["pair"]}
    coded = {c: (c, "code") for c in columns["ordinal"] + list(flags_by_code)}
    out, counts = _found(df, vocabulary, counted, F.lit(0).cast("long"))
    out, codes = _found(out, vocabulary, coded, F.lit(-1).cast("long"))
    share = (lambda c: c / F.lit(float(max(total, 1)))) if cfg.freq_normalize and total is not None else (lambda c: c.cast("double"))
    mapped = {c: S.true_false(F.col(c)) for c in columns["true_false"] if c not in flags_by_code}
    code = lambda c: codes[c] if cfg.missing_code is None else F.when(F.col(f"`{c}`").isNull(), cfg.missing_code).otherwise(codes[c])
    own = [mapped[c].alias(c) if c in mapped else code(c).cast("int").alias(c) if c in codes else F.col(f"`{c}`") for c in df.columns if c not in counts]
    out = out.select(*own, *[share(c).alias(name) for name, c in counts.items()])
    added = []
    if "card1_freq" in out.columns:
        added.append(F.log1p("card1_freq").alias("card1_freq_log"))
    if {"card1_freq", "amt_to_avg_card_ratio"} <= set(out.columns):
        added.append((F.col("card1_freq") * F.col("amt_to_avg_card_ratio")).alias("card1_freq_x_ratio"))
    if {"addr1_freq", "TransactionAmt_log"} <= set(out.columns):
        added.append((F.col("addr1_freq") * F.col("TransactionAmt_log")).alias("addr1_freq_x_amt_log"))
    left = set(roles.strings(out))
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c not in left], *added)
