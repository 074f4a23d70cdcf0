"""Imputation: medians, and means of the nearest training rows by standardised anchor columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import neighbours, stats

# Columns that may be anchors, in the order of preference.
ANCHORS = ("TransactionAmt_log", "transaction_hour", "card1_freq", "addr1_freq", "card_prior_txn_count", "card_velocity", *(f"C{i}" for i in range(1, 15)))
#: Values of the reference rows that may be broadcast (8 bytes each), rows whose distances are held at a time.
REFERENCE_VALUES, ROWS = 16_000_000, 256
#: Keys of reference rows that are broadcast (some 50 bytes each).
BROADCAST_KEYS = 1_000_000
#: Reference rows from which on they are searched by blocks.
LARGE = 5000


def plan(rates: dict[str, float], columns: list[str], cfg: Config) -> dict[str, str]:
    """none, knn or median for each column, by its training rate of missing values."""
    return {c: "none" if not rates.get(c) else "knn" if rates[c] < cfg.knn_max else "median" for c in columns}


def medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    return {c: q[0] if q else 0.0 for c, q in stats.quantiles(train, columns, [0.5]).items()}


def fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    filled = lambda c: F.coalesce(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")), F.lit(float(values[c])))
    return df.select(*[filled(c).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns])


def anchors(train: DataFrame, rates: dict[str, float], cfg: Config, candidates: tuple[str, ...] = ANCHORS) -> dict[str, tuple[float, float]]:
    """Mean and deviation of the anchor columns: candidates with hardly a missing value and some variance."""
    own = [c for c in candidates if c in train.columns and rates.get(c, 0.0) < cfg.anchor_missing]
    found = stats.moments(train, own)
    used = [c for c in own if (found[c]["std"] or 0.0) > 1e-6][: cfg.knn_anchor_max]
    return {c: (found[c]["mean"], found[c]["std"]) for c in used}


def standardised(c: str, mean: float, std: float) -> Column:
    """The anchor's z-score, 0 where it is missing."""
    return F.coalesce((F.col(f"`{c}`").cast("double") - F.lit(mean)) / F.lit(std), F.lit(0.0))


def hashed(key: Column, seed: int) -> Column:
    """The hash by which rows are picked: md5 of key and seed, which any SQL has."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def reference(train: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n training rows: those with the least hashes of key and seed, whatever the partitioning. Keys are picked first, then joined."""
    md5 = hashed(F.col(key), seed)
    # the first 60 bits of the hash, which sort as it does
    first = F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")
    keys = stats.first_rows(train.select(first.alias("__first"), md5.alias("__md5"), key), ["__first", "__md5", key], n).select(key)
    return train.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, key)


def _distances(a: np.ndarray, b: np.ndarray, nan_aware: bool) -> np.ndarray:
    """Squared distances. nan_aware: over the coordinates that both have, scaled up to all of them; infinite if there is none."""
    if not nan_aware:
        return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0)
    has_a, has_b = ~np.isnan(a), ~np.isnan(b)
    x, y = np.where(has_a, a, 0.0), np.where(has_b, b, 0.0)
    both = has_a.astype(float) @ has_b.T.astype(float)
    d = (x**2) @ has_b.T - 2 * x @ y.T + has_a @ (y**2).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(both > 0, np.maximum(d, 0) * a.shape[1] / both, np.inf)


class Blocks:
    """Rows in blocks of SIZE, for exact searches of the nearest in which single precision leaves only a few blocks to look into.

    The k-th smallest of the blocks' least distances is no less than the k-th smallest distance. Blocks whose least distance
    is beyond that by more than single precision may err hold none of the nearest; the others' rows are compared in full.
    """

    #: Rows of a block, blocks of a tile, queries at a time, blocks that are looked into for each of them (on average, at most).
    SIZE, TILE, ROWS, MOST = 32, 128, 64, 128

    def __init__(self, base: np.ndarray):
        n, width = base.shape
        self.n, self.blocks = n, -(-n // self.SIZE)
        full = np.zeros((self.blocks * self.SIZE, width))
        full[:n] = base
        self.rows = full.reshape(self.blocks, self.SIZE, width)
        self.norms = (self.rows**2).sum(2)
        self.norms.reshape(-1)[n:] = np.inf
        self.longest = float(np.sqrt((base**2).sum(1).max())) if n else 0.0
        least = np.minimum(self.norms, np.finfo(np.float32).max / 4)
        # a block's rows lie apart in a tile, so that the least of each is taken over whole lines
        parts = np.concatenate([-2 * self.rows, least[:, :, None], np.ones_like(least)[:, :, None]], axis=2).astype(np.float32)
        self.tiles = [np.ascontiguousarray(parts[i : i + self.TILE].transpose(2, 1, 0).reshape(width + 2, -1)) for i in range(0, self.blocks, self.TILE)]

    def nearest(self, query: np.ndarray, k: int) -> np.ndarray:
        """As nearest(); the distances are the same but for the order of their sums."""
        out = np.empty((len(query), k), np.int64)
        for s in range(0, len(query), self.ROWS):
            part = query[s : s + self.ROWS]
            square = (part**2).sum(1)
            left = np.concatenate([part, np.ones((len(part), 1)), square[:, None]], axis=1).astype(np.float32)
            least = np.concatenate([(left @ t).reshape(len(part), self.SIZE, -1).min(1) for t in self.tiles], axis=1)
            error = 2 * (part.shape[1] + 5) * 2.0**-24 * (np.sqrt(square) + self.longest) ** 2
            at = min(k, self.blocks) - 1
            cut = np.partition(least, at, axis=1)[:, at] if k <= self.blocks else np.full(len(part), np.inf)
            q, b = np.nonzero(least <= (cut + 2 * error + 1e-8)[:, None])
            if len(q) > self.MOST * len(part):  # hardly any block is out
                out[s : s + self.ROWS] = nearest(part, self.rows.reshape(-1, part.shape[1])[: self.n], k)
                continue
            d = square[q][:, None] - 2 * np.einsum("pw,psw->ps", part[q], self.rows[b]) + self.norms[b]
            d = np.round(np.maximum(d, 0), 9).ravel()
            row = (b[:, None] * self.SIZE + np.arange(self.SIZE)).ravel()
            owner = np.repeat(q, self.SIZE)
            order = np.lexsort((row, d, owner))
            first = np.searchsorted(owner[order], np.arange(len(part)))
            out[s : s + self.ROWS] = row[order][first[:, None] + np.arange(k)]
        return out


def nearest(query: np.ndarray, base: np.ndarray, k: int, nan_aware: bool = False) -> np.ndarray:
    """Indexes of the k nearest rows of base for each query; ties go to the row that comes first."""
    k = min(k, len(base))
    out = np.empty((len(query), k), np.int64)
    for s in range(0, len(query), ROWS):
        d = np.round(_distances(query[s : s + ROWS], base, nan_aware), 9)
        if k < len(base):
            # every row no farther than the k-th smallest distance, then the first k by (distance, position)
            cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            for i in range(len(d)):
                near = np.flatnonzero(d[i] <= cut[i])
                out[s + i] = near[np.argsort(d[i, near], kind="stable")[:k]]
        else:
            out[s : s + ROWS] = np.argsort(d, axis=1, kind="stable")
    return out


def finder(base: np.ndarray, k: int, nan_aware: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """nearest() for many queries of one base; a large one is searched by blocks, where all coordinates are within single precision's range, or by patterns of what its rows have."""
    if nan_aware and len(base) >= LARGE and neighbours.Patterns.worth(base):
        index = neighbours.Patterns(base)
        return lambda query: index.nearest(query, k)
    within = lambda x: bool((np.abs(x) < 1e15).all())
    blocks = Blocks(base) if not nan_aware and len(base) >= LARGE and within(base) else None
    return lambda query: blocks.nearest(query, min(k, len(base))) if blocks and within(query) else nearest(query, base, k, nan_aware)


def _mean_of(targets: np.ndarray, near: np.ndarray) -> np.ndarray:
    values = targets[near]
    has = ~np.isnan(values)
    with np.errstate(invalid="ignore"):
        return np.where(has.any(1), np.where(has, values, 0.0).sum(1) / has.sum(1), np.nan)


def knn_fill(df: DataFrame, ref: DataFrame, key: str, anchor_columns: list[Column], targets: list[str], k: int, defaults: dict[str, float], nan_aware: bool = False) -> DataFrame:
    """df with missing targets as the mean of those that the k nearest reference rows have, or the default.

    A reference of REFERENCE_VALUES values at most is collected and broadcast: df passes through in Arrow batches, and only
    rows with a missing target are compared. A larger one stays where it is, and both sides meet in cells (neighbours.fill);
    for distances over shared coordinates alone, which have no such cells, it is an error.
    """
    spark = df.sparkSession
    names = [f"__a{i}" for i in range(len(anchor_columns))]
    own = [F.col(f"`{c}`").cast("double").alias(c) for c in targets]
    rows, width = ref.count(), 1 + len(names) + len(own)
    if rows * width > REFERENCE_VALUES:
        if nan_aware:
            raise ValueError(f"a reference of {rows} rows and {width} columns is too large; lower knn_ref")
        return neighbours.fill(df, ref, key, anchor_columns, targets, k, defaults)
    base = ref.select(F.col(key).alias("__key"), *[a.alias(n) for a, n in zip(anchor_columns, names, strict=True)], *own).orderBy("__key").toPandas()
    shared = spark.sparkContext.broadcast((base[names].to_numpy(np.float64), base[targets].to_numpy(np.float64)))
    rest = [c for c in df.columns if c not in targets]
    schema = df.select(*[f"`{c}`" for c in rest]).schema
    for c in targets:
        schema.add(c, "double")
    fallback = np.array([defaults.get(c, 0.0) for c in targets])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, known = shared.value
        find = finder(points, k, nan_aware)
        for b in batches:
            values = b[targets].to_numpy(np.float64)
            todo = np.flatnonzero(np.isnan(values).any(1))
            if len(todo):
                part = values[todo]
                if len(points):
                    near = find(b[names].to_numpy(np.float64)[todo])
                    part = np.where(np.isnan(part), _mean_of(known, near), part)
                values[todo] = np.where(np.isnan(part), fallback, part)
            yield pd.concat([b[rest], pd.DataFrame(values, columns=targets, index=b.index)], axis=1)

    source = df.select(*[f"`{c}`" for c in rest], *own, *[a.alias(n) for a, n in zip(anchor_columns, names, strict=True)])
    return source.mapInPandas(run, schema).select(*[f"`{c}`" for c in df.columns])


def knn_impute(df: DataFrame, train: DataFrame, targets: list[str], anchor_stats: dict[str, tuple[float, float]], defaults: dict[str, float], cfg: Config, key: str = "TransactionID") -> DataFrame:
    """Missing targets by the nearest reference rows of the training split, in the space of the standardised anchors."""
    points = [standardised(c, *s) for c, s in anchor_stats.items()]
    return knn_fill(df, reference(train, key, cfg.knn_ref, cfg.seed), key, points, targets, cfg.knn_k, defaults)


def knn_self_anchor(df: DataFrame, train: DataFrame, columns: list[str], k: int, n: int, seed: int, key: str = "TransactionID") -> DataFrame:
    """Variant: anchors are the columns themselves, the reference is rows without a missing value, and missing coordinates are their means."""
    complete = reference(train.dropna(subset=columns), key, n, seed)
    found = stats.moments(complete, columns)
    points = [standardised(c, found[c]["mean"] or 0.0, found[c]["std_pop"] or 1.0) for c in columns]
    return knn_fill(df, complete, key, points, columns, k, {c: found[c]["mean"] or 0.0 for c in columns})


def knn_nan_euclidean(df: DataFrame, train: DataFrame, columns: list[str], k: int, n: int, seed: int, key: str = "TransactionID") -> DataFrame:
    """Variant: distances over the coordinates that both rows have, scaled up to all."""
    means = stats.moments(train, columns)
    points = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns]
    return knn_fill(df, reference(train, key, n, seed), key, points, columns, k, {c: means[c]["mean"] or 0.0 for c in columns}, nan_aware=True)


def fit(train: DataFrame, columns: list[str], rates: dict[str, float], cfg: Config) -> dict:
    how = plan(rates, columns, cfg)
    return {"plan": how, "medians": medians(train, columns), "anchors": anchors(train, rates, cfg)}


def transform(df: DataFrame, params: dict, cfg: Config, ref: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Medians, then neighbours, then medians for what is left."""
    median = {c: v for c, v in params["medians"].items() if params["plan"][c] == "median"}
    out = fill(df, median)
    targets = [c for c, how in params["plan"].items() if how == "knn" and c not in params["anchors"]]
    if targets and params["anchors"]:
        points = [standardised(c, *s) for c, s in params["anchors"].items()]
        out = knn_fill(out, ref, key, points, targets, cfg.knn_k, params["medians"])
    return fill(out, params["medians"])
