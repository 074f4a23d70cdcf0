"""Roles of columns: what a stage does to a column depends on its role, not on its physical type."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names and families of the canonical schema.
META = ("TransactionID", "TransactionDT", "isFraud", "split", "window_id", "card_key_id", "transaction_month", "transaction_year")
STRINGS = ("ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo", *(f"M{i}" for i in range(1, 10)), *(f"id_{i}" for i in range(12, 39)))
TIME_PROXIES = ("transaction_month", "transaction_year")
TIME_PARTS = ("transaction_hour", "transaction_dayofweek", "is_weekend", "transaction_part_of_day")
FAMILIES = {"V": r"V\d+", "C": r"C\d+", "D": r"D\d+", "M": r"M\d+", "id": r"id_\d+"}

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def family(name: str) -> str | None:
    """V, C, D, M or id; None for a column of no family. Flags such as Vgrp1_missing are in none."""
    return next((k for k, p in FAMILIES.items() if re.fullmatch(p, name)), None)


def of_family(df: DataFrame, which: str) -> list[str]:
    return [c for c in df.columns if family(c) == which]


def numeric(df: DataFrame, but: tuple[str, ...] = META) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in but]


def strings(df: DataFrame, but: tuple[str, ...] = META) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in but]


def is_flag(name: str) -> bool:
    return name.endswith("_missing") or name in ("is_weekend", "card_is_first_seen", "email_match", "amt_is_round")


def continuous(df: DataFrame, ordinals: tuple[str, ...] = (), legacy_ordinals: bool = False) -> list[str]:
    """Numeric columns that are neither meta, flags, parts of time nor ordinal codes (which legacy_ordinals lets in)."""
    out = [c for c in numeric(df) if not is_flag(c) and c not in TIME_PARTS]
    return out if legacy_ordinals else [c for c in out if c not in ordinals]
