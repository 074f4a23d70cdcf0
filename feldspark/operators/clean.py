"""Cleaning: extreme values to null, and columns that are missing, constant or nearly so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import roles
from ..config import Config
from ..functions import scalars as S
from . import stats


def floating(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]


def normalise(df: DataFrame) -> DataFrame:
    """df with NaN, infinities and values beyond 1e30 as null in every floating column; one projection."""
    own = set(floating(df))
    return df.select(*[S.finite(F.col(f"`{c}`")).alias(c) if c in own else F.col(f"`{c}`") for c in df.columns])


def large_values(df: DataFrame) -> DataFrame:
    """(column, n_large) of floating columns with values beyond 1e9 (after normalisation)."""
    own = floating(df)
    counts = df.agg(*[F.count_if(S.is_large(F.col(f"`{c}`"))).alias(c) for c in own])
    return stats.long_form(counts, own, "long").where("value > 0").select("column", F.col("value").alias("n_large"))


def fit(train: DataFrame, cfg: Config) -> dict[str, list[str]]:
    """Columns to drop, by reason: missing, constant, near_constant."""
    columns = [c for c in train.columns if c not in cfg.never_drop and c not in roles.META]
    known = stats.profile(train, columns)
    missing = [c for c in columns if known[c]["rows"] and (known[c]["rows"] - known[c]["n"]) / known[c]["rows"] > cfg.drop_missing]
    left = [c for c in columns if c not in missing]
    constant = stats.constant(train, left, known)
    near = stats.dominated(train, [c for c in left if c not in constant], cfg.near_const_share)
    return {"missing": missing, "constant": constant, "near_constant": near}


def transform(df: DataFrame, params: dict[str, list[str]]) -> DataFrame:
    return df.drop(*[c for reason in params.values() for c in reason])
