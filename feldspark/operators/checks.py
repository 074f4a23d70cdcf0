"""Checks of a run's outputs; each gives (check, ok, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from . import engineer, impute, split, stats

Result = tuple[str, bool, str]


def row_total(df: DataFrame, n: int) -> Result:
    found = df.count()
    return "row_total", found == n, f"{found} of {n}"


def splits_in_order(df: DataFrame, cfg: Config) -> Result:
    """Sizes as configured, and no split begins before the one before it ends."""
    rows = split.time_order(df).join(split.sizes(df), "split").orderBy("split").collect()
    want = {0: cfg.train_n, 1: cfg.val_n, 2: cfg.test_n}
    sizes_ok = all(r["n"] == want.get(r["split"], r["n"]) for r in rows)
    return "splits_in_order", sizes_ok and all(r["in_order"] for r in rows), ", ".join(f"{r['split']}: {r['n']}" for r in rows)


def all_float(features: DataFrame, key: str = "TransactionID") -> Result:
    bad = [f.name for f in features.schema if f.name != key and not isinstance(f.dataType, T.FloatType)]
    return "all_float", not bad, ", ".join(bad)


def null_grid(df: DataFrame) -> DataFrame:
    """(column, n_null, n_inf) of numeric columns, in one aggregation for each block."""
    own = [f.name for f in df.schema if stats.is_numeric(df, f.name)]
    out = None
    for part in stats.blocks(own):
        row = df.agg(*[F.struct(F.count_if(F.col(f"`{c}`").isNull()).alias("n_null"), F.count_if(F.abs(F.col(f"`{c}`").cast("double")) == float("inf")).alias("n_inf")).alias(c) for c in part])
        rows = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.n_null").alias("n_null"), F.col(f"`{c}`.n_inf").alias("n_inf")) for c in part])))
        out = rows if out is None else out.unionByName(rows)
    return out


def no_null_or_inf(df: DataFrame) -> Result:
    bad = [r["column"] for r in null_grid(df).where("n_null > 0 OR n_inf > 0").collect()]
    return "no_null_or_inf", not bad, ", ".join(bad)


def same_columns(parts: list[DataFrame]) -> Result:
    return "same_columns", all(p.columns == parts[0].columns for p in parts), f"{len(parts)} tables"


def spoiled(df: DataFrame, columns: list[str], where: Column) -> DataFrame:
    """df with other values in numeric columns of the rows told: twice the value plus one, and 1 for null."""
    other = lambda c: F.coalesce(F.col(f"`{c}`") * 2 + 1, F.lit(1.0))
    return df.select(*[F.when(where, other(c)).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def fitted_on_train(fit, df: DataFrame, columns: list[str]) -> Result:
    """No leakage: fit, which gets the whole table, finds the same parameters when all values outside the training split are others."""
    a, b = fit(df), fit(spoiled(df, columns, F.col("split") != split.TRAIN))
    return "fitted_on_train", a == b, ""


def monotonic(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """(n_decreasing): rows whose value is below that of the row before, within a key; keys of any number of rows."""
    found = engineer.previous(df.select(*key, order, "TransactionID", F.col(value).alias("__v")), key, [order, "TransactionID"], "__v", "__p")
    return found.agg(F.count_if(F.col("__v") < F.col("__p")).alias("n_decreasing"))


def causal(df: DataFrame, key: list[str], n: int = 1000, seed: int = 42) -> Result:
    """card_prior_txn_count of n rows, counted again by a join with the rows of their cards before them."""
    sample = df.select("TransactionID", "TransactionDT", *key, "card_prior_txn_count").orderBy(impute.hashed(F.col("TransactionID"), seed), "TransactionID").limit(n).alias("s")
    rows = df.select("TransactionID", "TransactionDT", *key).alias("r")
    earlier = F.expr("r.TransactionDT < s.TransactionDT OR (r.TransactionDT = s.TransactionDT AND r.TransactionID < s.TransactionID)")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    joined = rows.join(F.broadcast(sample), [*same, earlier], "inner")
    counted = joined.groupBy("s.TransactionID").agg(F.count("*").alias("again"))
    wrong = sample.join(counted, "TransactionID", "left").where(F.coalesce("again", F.lit(0)) != F.col("card_prior_txn_count")).count()
    return "causal", wrong == 0, f"{wrong} of {n} differ"


def uncorrelated(train: DataFrame, columns: list[str], cfg: Config) -> Result:
    """No pair of selected, unprotected columns at or over the threshold."""
    m = stats.correlations(train, columns)
    bad = [(a, b) for i, a in enumerate(columns) for j, b in enumerate(columns[:i]) if abs(m[i, j]) >= cfg.corr_thr and not {a, b} & set(cfg.protect)]
    return "uncorrelated", not bad, ", ".join(f"{a}-{b}" for a, b in bad[:5])


def scaled_medians(train: DataFrame, columns: list[str], tolerance: float = 1e-3) -> Result:
    found = stats.quantiles(train, columns, [0.5])
    bad = [c for c in columns if found[c] and abs(found[c][0]) > tolerance]
    return "scaled_medians", not bad, ", ".join(bad[:5])


def with_key(df: DataFrame, cfg: Config) -> DataFrame:
    return df.withColumn("__card", engineer.card_key(df, cfg))
