"""Clipping at training quantiles, and transforms of skewed columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalars as S
from . import stats
from .tables import kept


def fit(train: DataFrame, columns: list[str], cfg: Config, bounds: dict[str, list[float] | None] | None = None) -> dict[str, dict]:
    """For each column its bounds and, if it is skewed after clipping, the transform: log1p, signed_log1p or yeo_johnson with lambda. bounds: the quantiles, if known."""
    bounds = bounds or stats.quantiles(train, columns, list(cfg.winsor))
    params: dict[str, dict] = {c: {"low": bounds[c][0], "high": bounds[c][1]} for c in columns if bounds[c]}
    clipped = train.select(*[S.clip(F.col(f"`{c}`").cast("double"), p["low"], p["high"]).alias(c) for c, p in params.items()])
    shape = stats.moments(clipped, list(params))
    for c, p in params.items():
        if abs(shape[c]["skew"]) > cfg.skew_abs:
            p["transform"] = "yeo_johnson" if cfg.skew_method == "yeo_johnson" else "log1p" if (shape[c]["min"] or 0) >= 0 else "signed_log1p"
    wanted = [c for c, p in params.items() if p.get("transform") == "yeo_johnson"]
    for c, lam in best_lambdas(clipped, wanted).items():
        params[c]["lambda"] = lam
    return params


def apply(c: Column, p: dict) -> Column:
    c = S.clip(c.cast("double"), p["low"], p["high"])
    match p.get("transform"):
        case "log1p":
            return F.log1p(c)
        case "signed_log1p":
            return S.signed_log1p(c)
        case "yeo_johnson":
            return S.yeo_johnson(c, p["lambda"])
    return c


def transform(df: DataFrame, params: dict[str, dict]) -> DataFrame:
    return df.select(*[apply(F.col(f"`{c}`"), params[c]).alias(c) if c in params else F.col(f"`{c}`") for c in df.columns])


def _transformed(x: np.ndarray, lam: float) -> np.ndarray:
    """Yeo-Johnson of values, as functions.scalars.yeo_johnson has it."""
    out, up = np.empty_like(x), x >= 0
    out[up] = np.log1p(x[up]) if abs(lam) < 1e-12 else ((x[up] + 1) ** lam - 1) / lam
    out[~up] = -np.log1p(-x[~up]) if abs(lam - 2) < 1e-12 else -((1 - x[~up]) ** (2 - lam) - 1) / (2 - lam)
    return out


def likelihoods(values: DataFrame, lambdas: dict[str, list[float]]) -> dict[str, list[float]]:
    """Yeo-Johnson's profile log-likelihood of each column at its lambdas, up to a constant; values: (column, value, count), one pass.

    Sums of the transformed values and of their squares are taken from the transform of one value of the column.
    """
    names = list(lambdas)
    at = {c: i for i, c in enumerate(names)}
    shift = {r["column"]: r["v"] for r in values.where(F.col("column").isin(names)).groupBy("column").agg(F.percentile_approx("value", 0.5).alias("v")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((2, len(own))) for c, own in lambdas.items()}
        plain = np.zeros((len(names), 2))
        for b in batches:
            column, x, n = b.column(0).dictionary_encode(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.float64)
            for k, c in enumerate(column.dictionary.to_pylist()):
                own = column.indices.to_numpy() == k
                v, w = x[own], n[own]
                plain[at[c]] += w.sum(), (w * np.sign(v) * np.log1p(np.abs(v))).sum()
                with np.errstate(over="ignore", invalid="ignore"):
                    for j, lam in enumerate(lambdas[c]):
                        y = _transformed(v, lam) - _transformed(np.array([shift[c]]), lam)
                        sums[c][:, j] += (w * y).sum(), (w * y * y).sum()
        rows = [(c, plain[at[c]][0], plain[at[c]][1], j, *sums[c][:, j]) for c in names if plain[at[c]][0] for j in range(len(lambdas[c]))]
        made = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, kinds, strict=True)], names=["column", "n", "logs", "j", "s1", "s2"])

    told = values.where(F.col("column").isin(names) & F.col("value").isNotNull()).select("column", "value", "count").mapInArrow(run, "column string, n double, logs double, j int, s1 double, s2 double")
    out = {c: [-math.inf] * len(own) for c, own in lambdas.items()}
    for r in told.groupBy("column", "j").agg(*[F.sum(c).alias(c) for c in ("n", "logs", "s1", "s2")]).collect():
        variance = r["s2"] / r["n"] - (r["s1"] / r["n"]) ** 2
        if math.isfinite(variance):
            out[r["column"]][r["j"]] = (lambdas[r["column"]][r["j"]] - 1) * r["logs"] - r["n"] / 2 * math.log(max(variance, 1e-300))
    return out


def value_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) of the columns' numbers, stored."""
    return kept(stats.long_form(df, columns, "double").where("value IS NOT NULL AND NOT isnan(value)").groupBy("column", "value").count())


def best_lambdas(df: DataFrame, columns: list[str], low: float = -4.0, high: float = 6.0, rounds: int = 3, steps: int = 41) -> dict[str, float]:
    """Yeo-Johnson's lambda of each column by its likelihood, which has one peak: on a grid from low to high that is refined around its best step round by round. The values are counted once, and a round is one pass over the counts."""
    if not columns:
        return {}
    values, spans = value_table(df, columns), dict.fromkeys(columns, (low, high))
    for _ in range(rounds):
        grid = {c: [a + (b - a) * k / (steps - 1) for k in range(steps)] for c, (a, b) in spans.items()}
        for c, score in likelihoods(values, grid).items():
            k, width = max(range(steps), key=score.__getitem__), grid[c][1] - grid[c][0]
            spans[c] = grid[c][k] - width, grid[c][k] + width
    return {c: (a + b) / 2 for c, (a, b) in spans.items()}


def extra_logs(df: DataFrame, columns: list[str], limit: float = 1.0) -> DataFrame:
    """df with <column>_log1p, a signed logarithm, beside each column whose skewness is beyond limit."""
    skew = stats.skewness(df, columns)
    return df.select("*", *[S.signed_log1p(F.col(f"`{c}`")).alias(f"{c}_log1p") for c in columns if abs(skew[c]) > limit])
