"""Scalar expressions: normalisation of missing values, time, amounts, keys and transforms. All are built-in columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first second of the reference date, 2017-12-01 UTC; values beyond EXTREME are missing, those beyond LARGE reported.
REFERENCE_EPOCH, EXTREME, LARGE = 1_512_086_400, 1e30, 1e9


def finite(c: Column) -> Column:
    """Null for NaN, infinities and values beyond EXTREME. NaN compares larger than all numbers, so one test covers all."""
    return F.when(F.abs(c) <= EXTREME, c)


def inf_to_null(c: Column) -> Column:
    return F.when(F.abs(c) != float("inf"), c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def is_large(c: Column) -> Column:
    """Whether a normalised value is beyond LARGE."""
    return F.coalesce(F.abs(finite(c)) > LARGE, F.lit(False))


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("tinyint")


def clip(c: Column, low: float, high: float) -> Column:
    """Within [low, high]; null stays null, which greatest and least alone would not keep."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def null_count(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.isNull().cast("int") for c in cs], F.lit(0))


def any_null(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in cs], F.lit(False))


def all_null(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNull() for c in cs], F.lit(True))


# time, from seconds since the reference date


def day(dt: Column) -> Column:
    return F.floor(dt / 86400)


def hour(dt: Column) -> Column:
    return F.pmod(F.floor(dt / 3600), F.lit(24)).cast("tinyint")


def day_of_week(dt: Column, offset: int = 4) -> Column:
    """0 for Monday; offset is the weekday of the reference date (4: a Friday)."""
    return F.pmod(day(dt) + offset, F.lit(7)).cast("tinyint")


def is_weekend(dow: Column) -> Column:
    return (dow >= 5).cast("tinyint")


def part_of_day(hour: Column) -> Column:
    return F.floor(hour / 6).cast("tinyint")


def timestamp(dt: Column, epoch: int = REFERENCE_EPOCH) -> Column:
    return F.timestamp_seconds(dt + F.lit(epoch))


def month(dt: Column, epoch: int = REFERENCE_EPOCH) -> Column:
    return F.month(timestamp(dt, epoch)).cast("tinyint")


def year(dt: Column, epoch: int = REFERENCE_EPOCH) -> Column:
    return F.year(timestamp(dt, epoch)).cast("smallint")


def part_of_day_name(hour: Column) -> Column:
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").when(hour.isNotNull(), "evening")


# amounts


def log_amount(c: Column) -> Column:
    return F.when(c > -1, F.log1p(c))


def cents(c: Column) -> Column:
    """The third of a thousandth: amount times 1000, the rest of 1000."""
    return (c * 1000) % 1000


def is_round(c: Column) -> Column:
    return F.coalesce(c % 1 == 0, F.lit(False)).cast("tinyint")


def signed_log1p(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a, b)


def yeo_johnson(c: Column, lam: float) -> Column:
    positive = F.log1p(c) if abs(lam) < 1e-12 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
    negative = -F.log1p(-c) if abs(lam - 2) < 1e-12 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, positive).when(c < 0, negative)


# strings


def text_of(c: Column, missing: str = "na") -> Column:
    return F.coalesce(c.cast("string"), F.lit(missing))


def whole_text(c: Column, missing: str = "na") -> Column:
    """A whole number as text without a decimal point, whatever its type."""
    return F.coalesce(c.cast("bigint").cast("string"), F.lit(missing))


def joined(parts: list[Column], sep: str = "_") -> Column:
    return F.concat_ws(sep, *parts)


def both_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False)).cast("tinyint")


def first_token(c: Column) -> Column:
    """The brand of a device: its first token in lower case."""
    return F.lower(F.split_part(F.trim(c), F.lit(" "), F.lit(1)))


def true_false(c: Column) -> Column:
    """T is 1, F is 0, all else -1."""
    return F.when(c == "T", 1).when(c == "F", 0).otherwise(-1).cast("tinyint")
