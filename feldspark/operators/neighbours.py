"""Nearest rows of a reference of any size: Voronoi cells around pivots, searched in two shuffled rounds, exactly.

Reference rows belong to the nearest of some pivots, which are reference rows themselves; a cell has a number of rows and a
radius. A query is first compared with the rows of its own cell; the distance of the k-th of them bounds how far the others
may be, and by the triangle inequality (radii, and the planes halfway between pivots) only some cells can hold a row within
that. The second round compares it with these. What goes through one task is a block of a cell's rows and a block of its
queries, whatever their number: cells with more are dealt out by hashes, and blocks meet in tasks of their own. All that is
broadcast are the pivots, MOST_PIVOTS at most.

Equal distances (rounded to 9 places) go to the smaller key. Queries are different points, so many rows of one point are one
query; of reference rows with one point the k of the least keys are enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept

#: Pivots at most; rows of a cell's block and queries of a block; parts in which equal points are thinned out first.
MOST_PIVOTS, ROWS, QUERIES, SALT = 2048, 20_000, 20_000, 64
#: Queries whose distances are held at a time.
HELD = 512


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0)


def thinned(ref: DataFrame, k: int) -> DataFrame:
    """The k rows of the least keys for each point; ranked in salted parts first, so that a hot point is in no task as a whole."""
    rank = lambda df, *by: df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("__n") <= k).drop("__n")
    salted = rank(ref.withColumn("__salt", F.pmod(F.xxhash64("key"), F.lit(SALT))), "point", "__salt")
    return rank(salted.drop("__salt"), "point")


class Pivots:
    """Pivots, and for each of their cells its rows and its radius."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.rows = np.zeros(len(points), np.int64)
        self.radius = np.zeros(len(points))
        self.apart = np.sqrt(_squares(points, points))

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of points, all cells taken."""
        d = _squares(x, self.points)
        cell = d.argmin(1)
        return cell, np.sqrt(d[np.arange(len(x)), cell])

    def slack(self, x: np.ndarray) -> np.ndarray:
        """What squares of distances may be wrong by."""
        return 1e-7 + 1e-11 * ((x**2).sum(1) + (self.points**2).sum(1).max() + self.radius.max() ** 2)

    def bound(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(own cell, a square that k rows are within) of queries: as many cells as have k rows, by the farthest that their rows can be."""
        d = np.sqrt(_squares(x, self.points))
        far = np.where(self.rows > 0, d + self.radius, np.inf)
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.rows[order], axis=1) >= k
        at = np.where(enough.any(1), enough.argmax(1), 0)
        most = np.where(enough.any(1), np.take_along_axis(far, order, 1)[np.arange(len(x)), at], np.inf)
        return np.where(self.rows > 0, d, np.inf).argmin(1), most**2 + self.slack(x)

    def others(self, x: np.ndarray, home: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) for all cells besides their own that may have a row within the squares given."""
        d = np.sqrt(_squares(x, self.points))
        own = d[np.arange(len(x)), home][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.nan_to_num((d**2 - own**2) / (2 * self.apart[home]), nan=0.0, posinf=0.0, neginf=0.0)
        least = np.maximum(np.maximum(d - self.radius, plane), 0.0)
        open_ = (least**2 <= (within + self.slack(x))[:, None]) & (self.rows > 0)
        open_[np.arange(len(x)), home] = False
        return np.nonzero(open_)


def nearest_rows(query: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares, indexes) of the k nearest points, those of the smaller index first where equally near."""
    k = min(k, len(points))
    squares, index = np.empty((len(query), k)), np.empty((len(query), k), np.int64)
    for s in range(0, len(query), HELD):
        d = np.round(_squares(query[s : s + HELD], points), 9)
        if k < len(points):
            cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            q, r = np.nonzero(d <= cut)
            order = np.lexsort((r, d[q, r], q))
            first = np.searchsorted(q[order], np.arange(len(d)))
            index[s : s + HELD] = r[order][first[:, None] + np.arange(k)]
        else:
            index[s : s + HELD] = np.argsort(d, axis=1, kind="stable")
        squares[s : s + HELD] = np.take_along_axis(d, index[s : s + HELD], 1)
    return squares, index


def _blocks(sizes: DataFrame, rows: int, name: str) -> DataFrame:
    """(cell, how many blocks) of counts by cell."""
    return sizes.select("cell", F.ceil(F.col("count") / rows).cast("int").alias(name))


def _compared(queries: DataFrame, ref: DataFrame, k: int, width: int) -> DataFrame:
    """(qid, best) for queries (qid, point, cell) and reference rows (key, point, t, cell) of the same cells; best has the k nearest of each block, as (d, key, t)."""
    own, other = _blocks(queries.groupBy("cell").count(), QUERIES, "nq"), _blocks(ref.groupBy("cell").count(), ROWS, "nr")
    # blocks of both sides: a row for each cell, of which there are MOST_PIVOTS at most
    sizes = F.broadcast(kept(own.join(other, "cell")))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, "cell").select("cell", part("qid", "nq").alias("q"), each("nr").alias("r"), "qid", "point")
    right = ref.join(sizes, "cell").select("cell", part("key", "nr").alias("r"), each("nq").alias("q"), "key", "point", "t")
    kind = ref.schema["key"].dataType
    schema = f"qid long, d double, key {kind.simpleString()}, t array<double>"

    def run(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["qid", "d", "key", "t"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), b["key"].combine_chunks()[:0], pa.array([], pa.list_(pa.float64()))], names=names)
        b = b.sort_by("key")
        d, index = nearest_rows(_matrix(a["point"], width), _matrix(b["point"], width), k)
        found = b.take(pa.array(index.ravel()))
        qid = np.repeat(a["qid"].to_numpy(), index.shape[1])
        return pa.table([pa.array(qid), pa.array(d.ravel()), found["key"].combine_chunks(), found["t"].combine_chunks()], names=names)

    by = ["cell", "q", "r"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)
    return found.select("qid", F.struct("d", "key", "t").alias("x"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """(qid, best): the k first of (d, key) for each query, of k rows from each of its blocks."""
    return found.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k).alias("best"))


def means_of_nearest(points: DataFrame, ref: DataFrame, k: int, width: int, targets: int) -> DataFrame:
    """(point, means) for each different point of points (point): means of what the k nearest reference rows (key, point, t) have; NaN is nothing.

    point is an array of `width` doubles, t one of `targets` doubles.
    """
    spark = points.sparkSession
    ref = kept(thinned(ref, k))
    queries = kept(points.select("point").distinct().withColumn("qid", F.monotonically_increasing_id()))
    n = ref.count()
    picked = ref.select("point").distinct().orderBy(F.xxhash64("point"), "point").limit(min(MOST_PIVOTS, max(1, round(n**0.5)))).collect()
    if not picked:
        return queries.select("point", F.array_repeat(F.lit(float("nan")), targets).alias("means"))
    pivots = Pivots(np.array([r["point"] for r in picked], np.float64).reshape(len(picked), width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, reach = pivots.homes(_matrix(b.column("point"), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(reach)], names=[*b.schema.names, "cell", "reach"])

    placed = kept(ref.mapInArrow(place, _with(ref, "cell int, reach double")))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("far")).collect():
        pivots.rows[r["cell"]], pivots.radius[r["cell"]] = r["n"], r["far"]
    shared = spark.sparkContext.broadcast(pivots)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("point"), width)
            for s in range(0, len(x), HELD):
                cell, bound = shared.value.bound(x[s : s + HELD], k)
                part = b.slice(s, HELD)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(bound)], names=[*b.schema.names, "cell", "within"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cell, within = _matrix(b.column("point"), width), b.column("cell").to_numpy(), b.column("within").to_numpy()
            for s in range(0, len(x), HELD):
                q, other = shared.value.others(x[s : s + HELD], cell[s : s + HELD], within[s : s + HELD])
                part = b.take(pa.array(q + s))
                yield pa.RecordBatch.from_arrays([part.column("qid"), part.column("point"), pa.array(other, pa.int32())], names=["qid", "point", "cell"])

    at_home = kept(queries.mapInArrow(home, _with(queries, "cell int, within double")))
    first = kept(_best(_compared(at_home.select("qid", "point", "cell"), placed.drop("reach"), k, width), k))
    last = F.element_at("best", -1)["d"]
    bounded = at_home.join(first, "qid", "left").select("qid", "point", "cell", F.when(F.size("best") == k, F.least("within", last)).otherwise(F.col("within")).alias("within"))
    second = _compared(kept(bounded.mapInArrow(rest, "qid long, point array<double>, cell int")), placed.drop("reach"), k, width)
    best = _best(first.select("qid", F.explode("best").alias("x")).unionByName(second), k)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("ts")
            values = _matrix(lists.flatten(), targets)
            starts = np.cumsum([0, *np.diff(lists.offsets.to_numpy())[:-1]])
            has = ~np.isnan(values)
            with np.errstate(invalid="ignore"):
                out = np.add.reduceat(np.where(has, values, 0.0), starts) / np.add.reduceat(has.astype(np.int64), starts)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * targets), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("qid"), made], names=["qid", "means"])

    means = best.select("qid", F.transform("best", lambda x: x["t"]).alias("ts")).mapInArrow(mean, "qid long, means array<double>")
    return means.join(queries, "qid").select("point", "means")


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [more])


def fill(df: DataFrame, ref: DataFrame, key: str, anchors: list[Column], targets: list[str], k: int, defaults: dict[str, float]) -> DataFrame:
    """df with missing targets as the mean of those that the k nearest rows of ref have by the anchors, or the default. Rows without a missing target stay where they are."""
    own = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in targets])
    point = F.array(*anchors)
    missing = F.forall(own, lambda v: ~F.isnan(v))
    base = ref.select(F.col(key).alias("key"), point.alias("point"), own.alias("t"))
    todo = df.where(~missing).withColumn("__point", point)
    found = means_of_nearest(todo.select(F.col("__point").alias("point")), base, k, len(anchors), len(targets)).select(F.col("point").alias("__of"), F.col("means").alias("__means"))
    real = lambda c: F.when(~F.isnan(c), c)
    filled = lambda c: F.coalesce(real(F.col(f"`{c}`").cast("double")), real(F.col("__means")[targets.index(c)]), F.lit(float(defaults.get(c, 0.0)))).alias(c)
    done = todo.join(found, F.col("__point") == F.col("__of"), "left").select(*[filled(c) if c in targets else F.col(f"`{c}`") for c in df.columns])
    whole = df.where(missing).select(*[F.col(f"`{c}`").cast("double").alias(c) if c in targets else F.col(f"`{c}`") for c in df.columns])
    return whole.unionByName(done)


class Patterns:
    """A reference with missing coordinates, for searches by the distance over shared coordinates: one index for each pattern of what its rows have.

    Rows of a pattern are dense; they lie in cells around some of them. A query and the rows of a pattern share the same
    coordinates, over which a cell's rows are no nearer than its centre less its radius, scaled as the distance is. Cells
    whose bound is beyond the k-th distance found so far, in any pattern, aren't looked into.
    """

    #: Rows that a pattern has on average at least, else an index of each isn't worth it.
    LEAST = 50

    def __init__(self, base: np.ndarray):
        self.n, self.width = base.shape
        self.looked = 0
        has = ~np.isnan(base)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        distinct, of = np.unique(has, axis=0, return_inverse=True)
        of = of.ravel()
        for g, mask in enumerate(distinct):
            rows = np.flatnonzero(of == g)
            own = np.where(mask, base[rows], 0.0)
            centres = own[np.random.default_rng(0).choice(len(rows), max(1, round(len(rows) ** 0.5)), replace=False)]
            cell, reach = np.empty(len(rows), np.int64), np.empty(len(rows))
            for s in range(0, len(rows), HELD):
                d = _squares(own[s : s + HELD], centres)
                cell[s : s + HELD] = d.argmin(1)
                reach[s : s + HELD] = d.min(1)
            order = np.argsort(cell, kind="stable")
            starts = np.searchsorted(cell[order], np.arange(len(centres) + 1))
            radius = np.zeros(len(centres))
            np.maximum.at(radius, cell, np.sqrt(reach))
            self.groups.append((mask, rows[order], own[order], centres, radius, starts))

    @classmethod
    def worth(cls, base: np.ndarray) -> bool:
        return len(np.unique(~np.isnan(base), axis=0)) * cls.LEAST <= len(base)

    def nearest(self, query: np.ndarray, k: int) -> np.ndarray:
        """Indexes of the k nearest rows of each query; equally near ones, and those that share no coordinate, in their order."""
        k = min(k, self.n)
        out = np.empty((len(query), k), np.int64)
        has = ~np.isnan(query)
        distinct, of = np.unique(has, axis=0, return_inverse=True)
        for a, mask in enumerate(distinct):
            own = np.flatnonzero(of.ravel() == a)
            for s in range(0, len(own), HELD):
                out[own[s : s + HELD]] = self._of_pattern(np.where(mask, query[own[s : s + HELD]], 0.0), mask, k)
        return out

    def _of_pattern(self, query: np.ndarray, has: np.ndarray, k: int) -> np.ndarray:
        best = np.full((len(query), k), np.inf)
        index = np.full((len(query), k), self.n, np.int64)
        bounds = []
        for mask, _, _, centres, radius, _ in self.groups:
            shared = mask & has
            if shared.any():
                d = np.sqrt(_squares(query[:, shared], centres[:, shared]))
                bounds.append((np.maximum(d - radius, 0.0) ** 2 * (self.width / shared.sum()), d.argmin(1)))
            else:
                bounds.append(None)
        # the nearest cell of each pattern first, which bounds the distances; then all cells that may hold a nearer row
        for first in (True, False):
            for bound, group in zip(bounds, self.groups, strict=True):
                if bound is None:
                    continue
                least, near = bound
                seen = np.zeros(least.shape, bool)
                seen[np.arange(len(query)), near] = True
                cut = best[:, -1]
                slack = np.where(np.isinf(cut), 0.0, 1e-7 + 1e-9 * cut)
                open_ = seen if first else ~seen & (least <= (cut + slack)[:, None])
                best, index = self._looked_into(query, has & group[0], group, open_, best, index, k)
        short = np.flatnonzero(np.isinf(best[:, -1]))
        if len(short):
            apart = np.sort(np.concatenate([g[1] for g, b in zip(self.groups, bounds, strict=True) if b is None] or [np.zeros(0, np.int64)]))
            for i in short:
                n = int(np.isfinite(best[i]).sum())
                index[i, n:] = apart[: k - n]
        return index

    def _looked_into(self, query: np.ndarray, shared: np.ndarray, group: tuple, open_: np.ndarray, best: np.ndarray, index: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        _, rows, points, _, _, starts = group
        scale = self.width / shared.sum()
        owners, distances, indexes = [np.repeat(np.arange(len(query)), k)], [best.ravel()], [index.ravel()]
        for c in np.flatnonzero(open_.any(0)):
            q, part = np.flatnonzero(open_[:, c]), slice(starts[c], starts[c + 1])
            d = np.round(_squares(query[np.ix_(q, shared)], points[part][:, shared]) * scale, 9)
            self.looked += d.size
            i, r = np.nonzero(d <= best[q, -1][:, None])
            owners.append(q[i])
            distances.append(d[i, r])
            indexes.append(rows[part][r])
        owner, distance, found = (np.concatenate(x) for x in (owners, distances, indexes))
        order = np.lexsort((found, distance, owner))
        at = order[np.searchsorted(owner[order], np.arange(len(query)))[:, None] + np.arange(k)]
        return distance[at], found[at]
