"""Robust scaling by median and quartiles, clipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import stats

CLIP, TINY = 10.0, 1e-8


def fit(train: DataFrame, columns: list[str], quartiles: dict[str, list[float] | None] | None = None) -> dict[str, dict]:
    """Center and scale of each column: the range between quartiles, or the deviation where that is nothing, or 1. quartiles: those of the columns, if known."""
    quartiles = quartiles or stats.quantiles(train, columns, [0.25, 0.5, 0.75])
    # deviations are asked for where there is no range alone
    spread = stats.moments(train, [c for c in columns if quartiles[c] and not quartiles[c][2] - quartiles[c][0] > TINY])
    out = {}
    for c in columns:
        if quartiles[c]:
            low, median, high = quartiles[c]
            deviation = spread[c]["std"] or 0.0 if c in spread else 0.0
            out[c] = {"center": median, "scale": high - low if high - low > TINY else deviation if deviation > TINY else 1.0, "clip": CLIP}
    return out


def transform(df: DataFrame, params: dict[str, dict]) -> DataFrame:
    scaled = lambda c, p: S.clip((F.col(f"`{c}`").cast("double") - F.lit(p["center"])) / F.lit(p["scale"]), -p["clip"], p["clip"])
    return df.select(*[scaled(c, params[c]).alias(c) if c in params else F.col(f"`{c}`") for c in df.columns])
