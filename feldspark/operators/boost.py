"""Gradient-boosted trees by histograms, for the gains of features: a pass over binned rows for each level of a tree.

Features are binned once, a byte each, by quantiles. A pass sums gradients and hessians of the loss by node, feature and bin
in each task; sums meet by feature, where the best cut of each node is searched, and the driver gets one cut for each feature
and node. Trees are grown level by level; a tree's leaves come from the sums of their parents' cuts. Margins of the rows are
replayed from the trees since they were last stored, every STORED rounds, so nothing but the binned table has to outlive an
executor. What a task holds is the sums: features x nodes of a level x bins.

The loss is logistic, positives weighted by negatives over positives. Each tree sees a share of the rows, picked by a hash of
row and round, and of the features. With validation rows, the area under their precision-recall curve is taken along with the
first level of the next tree (scores in AREA_BINS bins), and trees end when it hasn't grown for `patience` rounds.

Defined cases: nulls and NaN are 0; without rows of both classes all gains are 0; equal gains go to the feature named first
and the lower cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats
from .tables import kept

#: Bins of a feature at most, rounds after which margins are stored, bins of validation scores.
BINS, STORED, AREA_BINS = 128, 20, 1 << 14


@dataclass(frozen=True)
class Settings:
    """As usual for such rankings; least: the least sum of hessians of a node, smoothing: what is added to it."""

    rounds: int = 400
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.6
    patience: int = 30
    least: float = 1.0
    smoothing: float = 1.0
    seed: int = 42


class Tree:
    """Nodes as in a heap, the root at 1: the feature and cut of a split (rows of greater bins go right), -1 for a leaf, and a leaf's value."""

    def __init__(self, depth: int):
        self.feature = np.full(2 << depth, -1, np.int32)
        self.cut, self.value = np.zeros(2 << depth, np.int32), np.zeros(2 << depth)
        self.depth = depth

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        at, every = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            feature = self.feature[at]
            at = np.where(feature >= 0, 2 * at + (bins[every, np.maximum(feature, 0)] > self.cut[at]), at)
        return at


@dataclass
class Boosted:
    columns: list[str]
    gain: dict[str, float] = field(default_factory=dict)
    splits: dict[str, int] = field(default_factory=dict)
    areas: list[float] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)

    def importance(self) -> dict[str, float]:
        """The mean gain of each feature's splits."""
        return {c: self.gain[c] / self.splits[c] if self.splits.get(c) else 0.0 for c in self.columns}


def _clean(df: DataFrame, columns: list[str]) -> list:
    value = lambda c: F.coalesce(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")), F.lit(0.0))
    return [value(c).alias(str(i)) for i, c in enumerate(columns)]


def edges_of(train: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """The different quantiles of each column that part its bins, exact at any size."""
    own = train.select(*_clean(train, columns))
    found = stats.quantiles(own, own.columns, [k / bins for k in range(1, bins)])
    return [np.unique(found[c]) if found.get(c) else np.zeros(0) for c in own.columns]


def binned(df: DataFrame, columns: list[str], edges: list[np.ndarray], label: str, held: bool) -> DataFrame:
    """(y, held, bins): a byte for each column, how many of its edges are below the value."""
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = np.stack([np.searchsorted(e, b.column(i).to_numpy(), "left").astype(np.uint8) for i, e in enumerate(edges)], axis=1)
                rows = pa.Array.from_buffers(pa.binary(width), b.num_rows, [None, pa.py_buffer(np.ascontiguousarray(own))])
                yield pa.RecordBatch.from_arrays([b.column(width), pa.array(np.full(b.num_rows, held)), rows.cast(pa.binary())], names=["y", "held", "bins"])

    return df.select(*_clean(df, columns), F.col(label).cast("double").alias("y")).mapInArrow(run, "y double, held boolean, bins binary")


def _picked(row: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """Whether a tree sees a row."""
    with np.errstate(over="ignore"):
        x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((round_ * 1_000_003 + seed) % (1 << 63))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


def _features(width: int, round_: int, settings: Settings) -> np.ndarray:
    """The features that a tree sees."""
    n = max(1, int(width * settings.columns))
    return np.arange(width) if n == width else np.sort(np.random.default_rng([settings.seed, round_]).choice(width, n, replace=False))


def _rows(b: pa.RecordBatch, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """(bins, margins) of a batch of the state."""
    column = b.column("bins")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    bins = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(b.num_rows, -1)
    margin = b.column("margin").to_numpy().copy()
    for t in trees:
        margin += t.value[t.nodes(bins)]
    return bins, margin


def cuts(state: DataFrame, trees: list[Tree], tree: Tree, level: int, features: np.ndarray, weight: float, round_: int, settings: Settings, area: bool = False) -> tuple[list[dict], float | None]:
    """(the best cut of each feature in each open node of a level, by the state's rows; the validation rows' area, if asked for)."""
    first, nodes, scored = 1 << level, 1 << level, level == 0 and area

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(features), 2, nodes * BINS))
        counts = np.zeros((2, AREA_BINS))
        for b in batches:
            if not b.num_rows:
                continue
            bins, margin = _rows(b, trees)
            y, held = b.column("y").to_numpy(), b.column("held").to_numpy(zero_copy_only=False)
            p = 1 / (1 + np.exp(-margin))
            if scored and held.any():
                place = np.minimum((p[held] * AREA_BINS).astype(np.int64), AREA_BINS - 1)
                for k in (0, 1):
                    counts[k] += np.bincount(place[y[held] == k], minlength=AREA_BINS)
            use = ~held & _picked(b.column("row").to_numpy(), round_, settings.seed, settings.rows)
            at = tree.nodes(bins[use]) - first
            open_ = at >= 0
            use, at = np.flatnonzero(use)[open_], at[open_]
            w = np.where(y[use] == 1, weight, 1.0)
            g, h = w * (p[use] - y[use]), w * p[use] * (1 - p[use])
            for i, f in enumerate(features):
                place = at * BINS + bins[use, f]
                sums[i, 0] += np.bincount(place, g, nodes * BINS)
                sums[i, 1] += np.bincount(place, h, nodes * BINS)
        rows = [(int(f), sums[i].tobytes()) for i, f in enumerate(features)] + ([(-1, counts.tobytes())] if scored else [])
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["f", "sums"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for f, own in zip(b.column("f").to_pylist(), b.column("sums"), strict=True):
                x = np.frombuffer(own.as_py())
                sums[f] = sums[f] + x if f in sums else x
        out = []
        for f, own in sorted(sums.items()):
            if f < 0:
                out.append((f, 0, _area(*own.reshape(2, -1)), 0, 0.0, 0.0, 0.0, 0.0))
                continue
            g, h = own.reshape(2, nodes, BINS)
            below_g, below_h = g.cumsum(1), h.cumsum(1)
            total_g, total_h = below_g[:, -1:], below_h[:, -1:]
            score = lambda a, b: a * a / (b + settings.smoothing)
            gain = score(below_g, below_h) + score(total_g - below_g, total_h - below_h) - score(total_g, total_h)
            gain[(below_h < settings.least) | (total_h - below_h < settings.least)] = -np.inf
            gain[:, -1] = -np.inf
            cut = gain.argmax(1)
            for n in np.flatnonzero(total_h[:, 0] > 0):
                c = cut[n]
                out.append((f, int(n) + first, float(gain[n, c]), int(c), float(below_g[n, c]), float(below_h[n, c]), float(total_g[n, 0]), float(total_h[n, 0])))
        made = list(zip(*out, strict=True)) or [[]] * 8
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), *[pa.float64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, kinds, strict=True)], names=["f", "node", "gain", "cut", "left_g", "left_h", "g", "h"])

    found = state.mapInArrow(run, "f int, sums binary").repartition("f").mapInArrow(best, "f int, node int, gain double, cut int, left_g double, left_h double, g double, h double").collect()
    rows = [r.asDict() for r in found if r["f"] >= 0]
    return sorted(rows, key=lambda r: (r["node"], -r["gain"], r["f"])), next((r["gain"] for r in found if r["f"] < 0), None)


def _area(negative: np.ndarray, positive: np.ndarray) -> float:
    """Area under precision by recall, from counts by score: precision at each score, weighted by the positives there."""
    above, right = (positive + negative)[::-1].cumsum(), positive[::-1].cumsum()
    total = right[-1]
    with np.errstate(invalid="ignore"):
        precision = np.where(above > 0, right / above, 0.0)
    return float((precision * positive[::-1]).sum() / total) if total else 0.0


def fit(train: DataFrame, columns: list[str], label: str = "isFraud", val: DataFrame | None = None, settings: Settings = Settings(), edges: list[np.ndarray] | None = None) -> Boosted:  # noqa: B008
    """Trees over the training rows, and what their splits have gained by feature."""
    model = Boosted(columns, dict.fromkeys(columns, 0.0), dict.fromkeys(columns, 0))
    count = train.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    if not columns or not count["pos"] or not count["neg"]:
        return model
    edges = edges_of(train, columns) if edges is None else edges
    rows = binned(train, columns, edges, label, False)
    rows = rows if val is None else rows.unionByName(binned(val, columns, edges, label, True))
    state = kept(rows.withColumns({"row": F.monotonically_increasing_id(), "margin": F.lit(0.0)}))
    weight, since, best = count["neg"] / count["pos"], 0, -1
    for round_ in range(settings.rounds):
        trees, tree, features = model.trees[since:], Tree(settings.depth), _features(len(columns), round_, settings)
        for level in range(settings.depth):
            found, area = cuts(state, trees, tree, level, features, weight, round_, settings, val is not None)
            if area is not None and round_:
                model.areas.append(area)
                if best < 0 or area > model.areas[best]:
                    best = len(model.areas) - 1
                if len(model.areas) - 1 - best >= settings.patience:
                    return model
            seen: set[int] = set()
            grown = False
            for r in found:
                node = r["node"]
                if node in seen or tree.feature[node >> 1] < 0 and node > 1:
                    continue
                seen.add(node)
                leaf = lambda g, h: -settings.rate * g / (h + settings.smoothing)
                tree.value[node] = leaf(r["g"], r["h"])
                if not r["gain"] > 0:
                    continue
                grown = True
                tree.feature[node], tree.cut[node] = r["f"], r["cut"]
                tree.value[2 * node], tree.value[2 * node + 1] = leaf(r["left_g"], r["left_h"]), leaf(r["g"] - r["left_g"], r["h"] - r["left_h"])
                model.gain[columns[r["f"]]] += r["gain"]
                model.splits[columns[r["f"]]] += 1
            if not grown:
                break
        model.trees.append(tree)
        if len(model.trees) - since >= STORED and round_ + 1 < settings.rounds:
            state, since = kept(moved(state, model.trees[since:])), len(model.trees)
    return model


def moved(state: DataFrame, trees: list[Tree]) -> DataFrame:
    """The state with the margins that some more trees give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = dict(zip(b.schema.names, b.columns, strict=True)) | {"margin": pa.array(_rows(b, trees)[1])}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return state.mapInArrow(run, state.schema)


def first_gains(train: DataFrame, columns: list[str], label: str = "isFraud", settings: Settings = Settings()) -> dict[str, float]:  # noqa: B008
    """The gain of each feature's best cut of all rows, before any tree."""
    count = train.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    out = dict.fromkeys(columns, 0.0)
    if count["pos"] and count["neg"]:
        every = Settings(rows=1.0, columns=1.0, least=settings.least, smoothing=settings.smoothing)
        state = binned(train, columns, edges_of(train, columns), label, False).withColumns({"row": F.monotonically_increasing_id(), "margin": F.lit(0.0)})
        for r in cuts(state, [], Tree(1), 0, np.arange(len(columns)), count["neg"] / count["pos"], 0, every)[0]:
            out[columns[r["f"]]] = max(0.0, r["gain"])
    return out
