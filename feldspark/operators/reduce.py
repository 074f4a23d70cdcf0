"""Reduction of features: pruning, ranking by AUC, stability, and components of the V blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import roles
from ..config import Config
from . import boost, split, stats


def features(df: DataFrame, cfg: Config = Config()) -> list[str]:  # noqa: B008
    """Numeric columns that aren't meta; month and year of the time only if the configuration lets them in."""
    return [c for c in roles.numeric(df, ()) if c not in roles.META or c in roles.TIME_PROXIES and not cfg.exclude_time_proxies]


def hard_prune(train: DataFrame, columns: list[str], cfg: Config) -> tuple[list[str], list[str]]:
    """(kept, dropped): columns of hardly any deviation or of one value nearly throughout go, unless protected."""
    spread, near = stats.moments(train, columns), stats.dominated(train, columns, cfg.near_const_share)
    bad = [c for c in columns if c not in cfg.protect and ((spread[c]["std"] or 0.0) < 1e-6 or c in near)]
    return [c for c in columns if c not in bad], bad


def duplicates(df: DataFrame, columns: list[str], key: str = "TransactionID") -> list[list[str]]:
    """Groups of columns that are equal in all rows, found by one pass of hashes."""
    sums: dict[tuple, list[str]] = {}
    for part in stats.blocks(columns):
        row = df.agg(*[F.sum(F.xxhash64(F.col(key), F.col(f"`{c}`").cast("double")).cast("decimal(38,0)")).alias(c) for c in part]).first()
        for c in part:
            sums.setdefault((row[c],), []).append(c)
    return [g for g in sums.values() if len(g) > 1]


def greedy_correlation(order: list[str], matrix: np.ndarray, names: list[str], threshold: float, protect: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(kept, dropped): in the order given, a column drops those after it that it correlates with, unless protected."""
    at = {c: i for i, c in enumerate(names)}
    gone: set[str] = set()
    for i, a in enumerate(order):
        if a not in gone:
            gone |= {b for b in order[i + 1 :] if b not in gone and b not in protect and abs(matrix[at[a], at[b]]) >= threshold}
    return [c for c in order if c not in gone], [c for c in order if c in gone]


def correlation_prune(columns: list[str], matrix: np.ndarray, aucs: dict[str, float], cfg: Config) -> tuple[list[str], list[str]]:
    """(kept, dropped) of columns, whose correlations are the matrix, those of the best AUC first."""
    order = sorted(columns, key=lambda c: -aucs[c])
    return greedy_correlation(order, matrix, columns, cfg.corr_thr, cfg.protect)


def gbt_importance(train: DataFrame, columns: list[str], label: str = "isFraud", seed: int = 42, rounds: int = 400, val: DataFrame | None = None) -> dict[str, float]:
    """Mean gain of the features' splits in boosted trees (boost.fit), nulls as 0 and classes weighted to balance.

    With validation rows, trees end when the area under their precision-recall curve hasn't grown for 30 rounds. 0 for all
    features if the training rows are of one class.
    """
    return boost.fit(train, columns, label, val, boost.Settings(rounds=rounds, seed=seed)).importance()


def select_top(columns: list[str], importance: dict[str, float], protect: tuple[str, ...], k: int) -> list[str]:
    """Protected columns first, then the most important ones, k in all (or as many as are protected)."""
    chosen = [c for c in dict.fromkeys(protect) if c in columns]
    rest = sorted((c for c in columns if c not in chosen), key=lambda c: -importance.get(c, 0.0))
    return chosen + rest[: max(0, k - len(chosen))]


def cap_track(columns: list[str], importance: dict[str, float], protect: tuple[str, ...], most: int) -> list[str]:
    if len(columns) <= most:
        return columns
    own = [c for c in columns if c in protect]
    return own + sorted((c for c in columns if c not in own), key=lambda c: -importance.get(c, 0.0))[: most - len(own)]


def psi_screen(train: DataFrame, val: DataFrame, columns: list[str], cfg: Config) -> tuple[list[str], dict[str, float]]:
    """(kept, psi): unstable columns go only if the drift filter is on, and never protected ones."""
    found = stats.psi(train, val, columns)
    high = [c for c in columns if found[c] > cfg.psi_high]
    return [c for c in columns if not cfg.drift_filter or c not in high or c in cfg.protect], found


def fit_components(train: DataFrame, columns: list[str], null_counts: dict[str, int], cfg: Config, most: int = 10, matrix: np.ndarray | None = None) -> list[dict]:
    """For each block of columns of equal null count (2 at least): mean, deviation and the components that are kept. matrix: correlations of the columns, if known.

    A block keeps the fewest components that explain pca_var of the variance, pca_max_per_block at most. The sign of a
    component is such that its largest loading is positive.
    """
    by_count: dict[int, list[str]] = {}
    for c in columns:
        by_count.setdefault(0 if cfg.pca_single_block else null_counts.get(c, 0), []).append(c)
    out = []
    used = [c for own in by_count.values() if len(own) > 1 for c in own]
    zero = train.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in used])
    known = stats.moments(zero, used)
    if matrix is None and used:
        matrix, columns = stats.correlations(zero, used), used
    at = {c: i for i, c in enumerate(columns)}
    for block, (_, own) in enumerate(sorted(by_count.items())):
        if len(own) < 2:
            continue
        std = np.array([(known[c]["std_pop"] or 0.0) + 1e-8 for c in own])
        real = np.array([known[c]["std_pop"] or 0.0 for c in own])
        # the covariance of standardised columns is their correlation, up to the 1e-8
        places = [at[c] for c in own]
        cov = matrix[np.ix_(places, places)] * np.outer(real / std, real / std)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][: min(most, len(own))]
        total = max(values.clip(0).sum(), 1e-12)
        share = np.cumsum(values.clip(0)[order]) / total
        keep = min(int((share < cfg.pca_var).sum()) + 1, cfg.pca_max_per_block, len(order))
        components = vectors[:, order[:keep]].T
        # of loadings that are as large, the first one counts
        loads = np.abs(components)
        signs = np.sign(components[np.arange(keep), (loads >= loads.max(1, keepdims=True) * (1 - 1e-9)).argmax(1)])
        out.append({"block": block, "columns": own, "mean": [known[c]["mean"] or 0.0 for c in own], "std": std.tolist(), "components": (components * signs[:, None]).tolist(), "explained": share[:keep].tolist()})
    return out


def project(df: DataFrame, blocks: list[dict]) -> DataFrame:
    """df with Vpca_b<block>_<k> for each component: dot products of standardised columns, without Python."""
    added = []
    for b in blocks:
        z = [(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s) for c, m, s in zip(b["columns"], b["mean"], b["std"], strict=True)]
        for k, weights in enumerate(b["components"]):
            dot = F.aggregate(F.zip_with(F.array(*z), F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
            added.append(dot.alias(f"Vpca_b{b['block']}_{k}"))
    return df.select("*", *added)


def fit(df: DataFrame, null_counts: dict[str, int], cfg: Config) -> dict:
    """Tracks A (selected) and B (with components in place of V columns), and what they were chosen by."""
    own_train = split.train(df) if cfg.fit_on == "train" else df
    val = df.where(F.col("split") == split.VAL)
    kept, dropped_hard = hard_prune(own_train, features(df, cfg), cfg)
    if cfg.drop_duplicates:
        again = [c for g in duplicates(own_train, kept) for c in g[1:] if c not in cfg.protect]
        kept, dropped_hard = [c for c in kept if c not in again], dropped_hard + again
    aucs = stats.auc(own_train, kept, "isFraud", cfg.auc_ties, split.ORDER)
    pruned, matrix = kept, stats.correlations(own_train, kept)
    kept, dropped_corr = correlation_prune(kept, matrix, aucs, cfg)
    importance = gbt_importance(own_train, kept, seed=cfg.seed, rounds=cfg.gbt_rounds, val=val) if cfg.importance == "gbt" else {c: aucs[c] for c in kept}
    track_a, psi = psi_screen(own_train, val, select_top(kept, importance, cfg.protect, cfg.k_sel), cfg)
    v = [c for c in kept if roles.family(c) == "V"]
    places = [pruned.index(c) for c in v]
    components = fit_components(own_train, v, null_counts, cfg, matrix=matrix[np.ix_(places, places)])
    names = [f"Vpca_b{b['block']}_{k}" for b in components for k in range(len(b["components"]))]
    track_b = cap_track([c for c in track_a if roles.family(c) != "V"] + names, importance, cfg.protect, cfg.track_b_max)
    return {"drop_hard": dropped_hard, "drop_corr": dropped_corr, "aucs": aucs, "importance": importance, "psi": psi, "track_a": track_a, "track_b": track_b, "components": components}


def transform(df: DataFrame, params: dict) -> DataFrame:
    """df with the components, and no null in a track."""
    out = project(df, params["components"])
    used = set(params["track_a"]) | set(params["track_b"])
    return out.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) if c in used else F.col(f"`{c}`") for c in out.columns])
