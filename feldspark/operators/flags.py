"""Flags of missing values, one for each distinct pattern."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import roles
from ..config import Config
from ..functions import scalars as S


def candidates(columns: list[str], rates: dict[str, float], cfg: Config) -> list[str]:
    """Columns whose training rate of missing values is in (flag_min, drop_missing]; with flags_for_any_missing, C, D and id_ columns with any, too."""
    out = []
    for c in columns:
        r = rates.get(c, 0.0)
        if cfg.flag_min < r <= cfg.drop_missing or cfg.flags_for_any_missing and r > 0 and roles.family(c) in ("C", "D", "id"):
            out.append(c)
    return out


def patterns(df: DataFrame, columns: list[str], fitted: Column | None = None) -> tuple[list[list[str]], dict[str, float]]:
    """(columns that are missing in the very same rows, together, in the order of columns; their rates of missing values in the fitted rows), by one pass.

    A batch of rows has a bitmap of missing values for each column, over the rows' positions; columns of equal bitmaps get
    one number, and over batches and tasks numbers are told apart as soon as one bitmap differs. So a task gives a number
    for each column, of which there are few different lists, and counts; nothing is hashed.
    """
    if not columns:
        return [], {}
    asked = F.lit(True) if fitted is None else F.coalesce(fitted, F.lit(False))
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, missing, n = [0] * width, np.zeros(width, np.int64), 0
        for b in batches:
            own = np.packbits(b.column(width).to_numpy(zero_copy_only=False))
            n += int(np.bitwise_count(own).sum())
            known: dict[tuple[int, bytes], int] = {}
            for i in range(width):
                bits = np.packbits(b.column(i).to_numpy(zero_copy_only=False))
                missing[i] += int(np.bitwise_count(bits & own).sum())
                numbers[i] = known.setdefault((numbers[i], bits.tobytes()), len(known))
        yield pa.RecordBatch.from_arrays([pa.array([numbers] + [None] * (width + 1), pa.list_(pa.int32())), pa.array([-1, *range(width + 1)], pa.int32()), pa.array([0, *missing.tolist(), n])], names=["numbers", "i", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One list of numbers for those of a task, which tells columns apart if one of them does; counts as they are."""
        numbers: list[int] | None = None
        for b in batches:
            for own in b.column("numbers").drop_null().to_pylist():
                known: dict[tuple[int, int], int] = {}
                numbers = [known.setdefault(pair, len(known)) for pair in zip(numbers or [0] * width, own, strict=True)]
            yield b.filter(pc.is_null(b.column("numbers")))
        yield pa.RecordBatch.from_arrays([pa.array([numbers], pa.list_(pa.int32())), pa.array([-1], pa.int32()), pa.array([0])], names=["numbers", "i", "n"])

    told = df.select(*[F.col(f"`{c}`").isNull().alias(str(i)) for i, c in enumerate(columns)], asked.alias("own")).mapInArrow(run, "numbers array<int>, i int, n long")
    found = told.groupBy("i", "numbers").agg(F.sum("n").alias("n")).select("numbers", "i", "n").mapInArrow(merged, told.schema).collect()
    together: dict[tuple, list[str]] = {}
    lists = [r["numbers"] for r in found if r["numbers"] is not None]
    for i, c in enumerate(columns):
        together.setdefault(tuple(x[i] for x in lists), []).append(c)
    counts = {r["i"]: r["n"] for r in found if r["i"] >= 0}
    n = counts.get(width, 0)
    return list(together.values()), {c: counts[i] / n if n else 0.0 for i, c in enumerate(columns)}


def groups(df: DataFrame, columns: list[str]) -> list[list[str]]:
    """Columns that are missing in the very same rows, together; in the order of columns."""
    return patterns(df, columns)[0]


def name(group: list[str]) -> str:
    """A single column's name; Vgrp and numbers of three members for V columns alone; else the first D, C or amount column, or the first by name."""
    if len(group) == 1:
        return f"{group[0]}_missing"
    if all(c.startswith("V") for c in group):
        numbers = [re.search(r"\d+", c) for c in group]
        return f"Vgrp{'_'.join(sorted({m.group() for m in [m for m in numbers if m][:3]}))}_missing"
    preferred = [c for c in group if c.startswith(("D", "C", "TransactionAmt"))]
    return f"{preferred[0] if preferred else min(group)}_missing"


def fit(df: DataFrame, rates: dict[str, float], cfg: Config, fitted: Column | None = None) -> dict[str, str]:
    """Flag names with the column each is taken from; flags that are constant on the fitted rows (all, if none are told) are left out."""
    found, shares = patterns(df, candidates([c for c in df.columns if c not in roles.META], rates, cfg), fitted)
    out: dict[str, str] = {}
    for g in found:
        if 0 < shares[g[0]] < 1:
            out.setdefault(name(g), g[0])
    return out


def transform(df: DataFrame, params: dict[str, str]) -> DataFrame:
    return df.select("*", *[S.missing_flag(F.col(f"`{c}`")).alias(flag) for flag, c in params.items()])
