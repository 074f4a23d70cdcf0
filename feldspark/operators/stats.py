"""Statistics of columns: fused aggregates over the training rows, and order statistics that hold at any size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..roles import NUMERIC
from .tables import kept

#: Columns of one aggregation, different values of a bracket that one task orders, rows that one task sorts (about, at most and at least).
BLOCK, GATHER, PART_ROWS, SMALL_PART = 48, 200_000, 1_000_000, 10_000
#: Columns of a pass over (column, value) pairs; rows up to which a column's distinct values are held by one task.
PAIRED, HELD = 150, 500_000


def blocks(columns: list[str], size: int = BLOCK) -> Iterable[list[str]]:
    for i in range(0, len(columns), size):
        yield columns[i : i + size]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _per_column(df: DataFrame, columns: list[str], **makers) -> dict[str, dict]:
    """makers: name -> function of a column's name giving an aggregate; all of a block's columns in one job."""
    out: dict[str, dict] = {}
    for part in blocks(columns):
        row = df.agg(*[make(c).alias(f"{i}_{k}") for i, c in enumerate(part) for k, make in makers.items()]).first()
        for i, c in enumerate(part):
            out[c] = {k: row[f"{i}_{k}"] for k in makers}
    return out


def _grouped(df: DataFrame, columns: list[str], aggregates: dict[str, Column]) -> dict[str, dict]:
    """Aggregates of `value` by column, over (column, value) pairs that are combined before the shuffle: one small plan however many columns."""
    out: dict[str, dict] = {}
    for part in blocks(columns, PAIRED):
        for r in long_form(df, part, "double").groupBy("column").agg(*[a.alias(k) for k, a in aggregates.items()]).collect():
            out[r["column"]] = {k: r[k] for k in aggregates}
    return {c: out.get(c) or dict.fromkeys(aggregates) for c in columns}


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, named by their places; of those that aren't numbers only whether there is a value."""
    own = lambda c: _q(c).cast("double") if is_numeric(df, c) else F.when(_q(c).isNotNull(), F.lit(0.0))
    return df.select(*[own(c).alias(str(i)) for i, c in enumerate(columns)])


def _values(b: pa.RecordBatch, i: int) -> np.ndarray:
    return b.column(i).drop_null().to_numpy(zero_copy_only=False)


class Moments:
    """Numbers of rows and values, means, sums of squared and cubed deviations, and the least and greatest values of some columns, mergeable."""

    NAMES = ("i", "rows", "n", "mean", "m2", "low", "high", "m3")
    SCHEMA = "i int, rows double, n double, mean double, m2 double, low double, high double, m3 double"

    def __init__(self, width: int):
        self.rows, self.n, self.mean, self.m2, self.m3 = (np.zeros(width) for _ in range(5))
        self.low, self.high = np.full(width, np.inf), np.full(width, -np.inf)

    def add(self, i: int, rows: float, n: float, mean: float, m2: float, low: float, high: float, m3: float) -> None:
        self.rows[i] += rows
        if not n:
            return
        total, apart = self.n[i] + n, mean - self.mean[i]
        with np.errstate(invalid="ignore", over="ignore"):
            self.m3[i] += m3 + (apart**3 * self.n[i] * n * (self.n[i] - n) / total**2 + 3 * apart * (self.n[i] * m2 - n * self.m2[i]) / total if self.n[i] else 0.0)
            self.m2[i] += m2 + apart * apart * self.n[i] * n / total
            # the first mean as it is: nothing is taken off an infinite one
            self.mean[i] = self.mean[i] + apart * n / total if self.n[i] else mean
        self.n[i] = total
        self.low[i], self.high[i] = np.fmin(self.low[i], low), np.maximum(self.high[i], high)

    def told(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.rows)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(x[at]) for x in (self.rows, self.n, self.mean, self.m2, self.low, self.high, self.m3))], names=list(self.NAMES))


def profile(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """rows, n (values that aren't null), mean, std (of the sample), std_pop, skew, min and max of all columns, by one pass in Arrow batches; of columns that aren't numbers rows and n.

    A task gives a row for each column; rows of a column are merged in one task, and that is all that comes to the driver.
    """
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Moments(width)
        for b in batches:
            for i in range(width if b.num_rows else 0):
                v = _values(b, i)
                if len(v):
                    with np.errstate(invalid="ignore", over="ignore"):
                        mean = v.mean()
                        apart = v - mean
                        square = apart * apart
                        found.add(i, b.num_rows, len(v), mean, square.sum(), np.fmin.reduce(v), v.max(), (square * apart).sum())
                else:
                    found.add(i, b.num_rows, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
        yield found.told()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Moments(width)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found.add(*row)
        yield found.told()

    out = {c: {"rows": 0, "n": 0, "mean": None, "std": None, "std_pop": None, "skew": 0.0, "min": None, "max": None} for c in columns}
    if not columns:
        return out
    told = _numbers(df, columns).mapInArrow(run, Moments.SCHEMA).repartition("i").mapInArrow(merged, Moments.SCHEMA)
    for r in told.collect():
        c, n = columns[r["i"]], int(r["n"])
        out[c] |= {"rows": int(r["rows"]), "n": n}
        if n and is_numeric(df, c):
            out[c] |= {"mean": r["mean"], "std": math.sqrt(r["m2"] / (n - 1)) if n > 1 else None, "std_pop": math.sqrt(r["m2"] / n), "skew": _skew(n, r["m2"], r["m3"]), "min": r["low"], "max": r["high"]}
    return out


def _skew(n: int, m2: float, m3: float) -> float:
    """Third moment over the cubed deviation, as skewness() has it."""
    deviation = math.sqrt(m2 / n)
    return 0.0 if n < 3 or deviation < 1e-10 else m3 / n / deviation**3


def _summed(df: DataFrame, columns: list[str], width: int, sums: Callable[[int, np.ndarray], np.ndarray]) -> dict[str, list[float]]:
    """Sums over all rows of what `sums` gives for the values of each column (by its place), `width` numbers a column; one pass."""
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((k, width))
        for b in batches:
            for i in range(k):
                v = _values(b, i)
                if len(v):
                    found[i] += sums(i, v)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), width), pa.int32()), pa.array(np.tile(np.arange(width), k), pa.int32()), pa.array(found.ravel())], names=["i", "j", "x"])

    out = {c: [0.0] * width for c in columns}
    if k:
        for r in _numbers(df, columns).mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
            out[columns[r["i"]]][r["j"]] = r["x"]
    return out


def missing_rates(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return {c: (m["rows"] - m["n"]) / m["rows"] if m["rows"] else 0.0 for c, m in profile(df, columns).items()}


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, int]:
    """Distinct values without null. Exact counts come from one pass over (column, value) pairs, combined before the shuffle."""
    if approximate:
        return {c: v["n"] for c, v in _per_column(df, columns, n=lambda c: F.approx_count_distinct(_q(c))).items()}
    counts = value_counts(df, columns).where("value IS NOT NULL").groupBy("column").agg(F.count("*").alias("n")).collect()
    found = {r["column"]: r["n"] for r in counts}
    return {c: found.get(c, 0) for c in columns}


def long_form(df: DataFrame, columns: list[str], kind: str = "string", *keep: str) -> DataFrame:
    """(keep..., column, value), a row for each column of each row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast(kind).alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count); null is a value."""
    return long_form(df, columns).groupBy("column", "value").count()


def normalized_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count, share) of one column, shares of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return value_counts(df, [column]).crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") / F.col("total")).alias("share"))


def top_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Share of the most frequent value among all rows, those with null in the denominator alone."""
    n = df.count()
    found = {r["column"]: r["m"] for r in value_counts(df, columns).where("value IS NOT NULL").groupBy("column").agg(F.max("count").alias("m")).collect()}
    return {c: found.get(c, 0) / n if n else 0.0 for c in columns}


def moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """n, mean, std (of the sample), std_pop, min and max, nulls left out."""
    return profile(df, columns)


def skewness(df: DataFrame, columns: list[str], known: dict[str, dict] | None = None) -> dict[str, float]:
    """Third moment over the cubed deviation, both of the population; 0 for under 3 values or a deviation under 1e-10. known: moments() of the columns."""
    known = known or moments(df, columns)
    means = [known[c]["mean"] or 0.0 for c in columns]
    found = _summed(df, columns, 1, lambda i, v: ((v - means[i]) ** 3).sum())
    return {c: 0.0 if known[c]["n"] < 3 or (known[c]["std_pop"] or 0) < 1e-10 else found[c][0] / known[c]["n"] / known[c]["std_pop"] ** 3 for c in columns}


def dominated(df: DataFrame, columns: list[str], share: float) -> list[str]:
    """Columns of which one value takes `share` of all rows or more (over a half), nulls counted among the rows.

    Such a value is in the middle of a numeric column's values, where an approximate median finds it; it is then
    counted. Strings are counted by value.
    """
    if share <= 0.5:
        raise ValueError("a share of over a half is needed")
    numbers = [c for c in columns if is_numeric(df, c)]
    n = df.count()
    own = _numbers(df, numbers)
    grid = _grid(_sketches(own, dict.fromkeys(own.columns, (-_INF, _INF)))) if numbers else {}
    middle = [grid[str(i)][GRID // 2] if str(i) in grid else math.nan for i in range(len(numbers))]
    hits = _summed(df, numbers, 1, lambda i, v: (v == middle[i]).sum())
    shares = {c: hits[c][0] / n if n else 0.0 for c in numbers}
    words = [c for c in columns if c not in numbers]
    shares |= top_shares(df, words) if words else {}
    return [c for c in columns if shares.get(c, 0.0) >= share]


def constant(df: DataFrame, columns: list[str], known: dict[str, dict] | None = None) -> list[str]:
    """Columns of one value or none, nulls apart. known: profile() of the columns."""
    numbers = [c for c in columns if is_numeric(df, c)]
    known = known or profile(df, numbers)
    found = {c: not known[c]["n"] or known[c]["min"] == known[c]["max"] for c in numbers}
    found |= {c: r["one"] for c, r in _per_column(df, [c for c in columns if c not in numbers], one=lambda c: F.coalesce(F.min(_q(c)) == F.max(_q(c)), F.lit(True))).items()}
    return [c for c in columns if found[c] is not False]


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float] | None]:
    """Exact quantiles with linear interpolation; None for a column without values. NaN is no value.

    Up to HELD rows, the task of a column holds its distinct values. Beyond, one pass makes a sketch of each column, from
    which come brackets around the order statistics that are asked for, and one pass counts the values in the brackets by
    value and those between by number: the counts say which values the order statistics are. Only where a bracket has over
    GATHER different values, or a sketch was wrong, is it narrowed by a sketch of its own and counted again. What comes to the
    driver is a few numbers for each column, and no task holds more of a column than a bracket.
    """
    value = lambda c: F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double"))
    own = df.select(*[value(c).alias(str(i)) for i, c in enumerate(columns)])
    names = own.columns
    if df.count() <= HELD:
        found = _grouped(own, names, {"q": F.percentile("value", F.array(*map(F.lit, probabilities)))})
        return {c: list(found[i]["q"]) if found[i]["q"] is not None else None for c, i in zip(columns, names, strict=True)}
    sketches = _sketches(own, dict.fromkeys(names, (-_INF, _INF)))
    sizes = {r["c"]: r["n"] for r in sketches.select("c", F.kll_sketch_get_n_double("s").alias("n")).collect()}
    places = {c: sorted({r for p in probabilities for r in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))}) for c, n in sizes.items() if n}
    brackets = _around(own, {c: [(-_INF, _INF, 0, sizes[c], p)] for c, p in places.items()}, sketches)
    wanted: dict[str, dict[int, float]] = {c: {} for c in places}
    while brackets:
        brackets = _counted(own, brackets, wanted)
    return {c: [_interpolated(wanted[i], p, sizes[i]) for p in probabilities] if i in places else None for c, i in zip(columns, names, strict=True)}


_INF = float("inf")
#: Values that a sketch keeps (it is right within about 2.4 / SKETCH ** 0.94 of all values), how many times that brackets reach, and groups of parts whose sketches are merged first.
SKETCH, REACH, MERGED = 4000, 3.0, 256
#: Steps of the shares at which sketches are read.
GRID = 1000


def _sketches(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(c, s): a sketch of each column's values within a range, stored; one pass. Sketches of parts of the table are merged for all columns together first."""
    inside = lambda c, low, high: F.when((_q(c) >= F.lit(low)) & (_q(c) <= F.lit(high)), _q(c))
    parts = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGED)).alias("part")).agg(*[F.kll_sketch_agg_double(inside(c, *r), F.lit(SKETCH)).alias(c) for c, r in ranges.items()])
    listed = parts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), _q(c).alias("s")) for c in ranges])))
    return kept(listed.groupBy("c").agg(F.kll_merge_agg_double("s").alias("s")))


def _grid(sketches: DataFrame) -> dict[str, list[float]]:
    """Approximate quantiles of each column at GRID + 1 evenly spaced shares."""
    told = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    found = sketches.where(F.kll_sketch_get_n_double("s") > 0).select("c", F.kll_sketch_get_quantile_double("s", told).alias("q"))
    return {r["c"]: r["q"] for r in found.collect()}


def _around(df: DataFrame, zones: dict[str, list[tuple]], sketches: DataFrame | None = None) -> dict[str, list[tuple]]:
    """Brackets (low, high, least rank, number of values, ranks) within zones of the same form, around their ranks; zones of a column are sketched one pass after the other."""
    out: dict[str, list[tuple]] = {c: [] for c in zones}
    error = REACH * 2.446 / SKETCH**0.9433
    for k in range(max((len(z) for z in zones.values()), default=0)):
        own = {c: z[k] for c, z in zones.items() if len(z) > k}
        spans: dict[str, list[list[int]]] = {}
        for c, (_, _, _, n, ranks) in own.items():
            # ranks that are close to each other have one bracket
            groups = spans[c] = [[ranks[0]]]
            for r in ranks[1:]:
                if (r - groups[-1][-1]) / n <= 2 * error:
                    groups[-1].append(r)
                else:
                    groups.append([r])
        grid = _grid(sketches if sketches is not None else _sketches(df, {c: z[:2] for c, z in own.items()}))
        for c, (low, high, first, n, _) in own.items():
            for g in spans[c]:
                # a bracket that reaches over the end of the zone ends there
                from_, to = math.floor(((g[0] - first) / n - error) * GRID), math.ceil(((g[-1] + 1 - first) / n + error) * GRID)
                a = low if from_ <= 0 or c not in grid else grid[c][from_]
                b = high if to >= GRID or c not in grid else grid[c][to]
                if out[c] and a <= out[c][-1][1]:
                    last = out[c].pop()
                    a, b, g = last[0], max(b, last[1]), sorted(last[4] + g)
                out[c].append((a, b, first, n, g))
    return out


def _counted(df: DataFrame, brackets: dict[str, list[tuple]], wanted: dict[str, dict[int, float]]) -> dict[str, list[tuple]]:
    """The values at the brackets' ranks, by one pass that counts all values: those in a bracket by value, those between by zone. Gives brackets that are still open."""
    columns = [c for c in brackets if brackets[c]]
    lows = [np.array([b[0] for b in brackets[c]]) for c in columns]
    highs = [np.array([b[1] for b in brackets[c]]) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Zone 2i is below bracket i (and above the one before), zone 2i + 1 is bracket i."""
        between = [np.zeros(2 * len(x) + 1, np.int64) for x in lows]
        held: list[list[np.ndarray]] = [[] for _ in columns]
        n = 0

        def told() -> pa.RecordBatch:
            at, zone, value, count = [], [], [], []
            for i, own in enumerate(held):
                some, number = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0), np.zeros(0, np.int64))
                own.clear()
                outside = np.flatnonzero(between[i])
                at.append(np.full(len(some) + len(outside), i))
                zone.append(np.concatenate([2 * np.searchsorted(lows[i], some, "right") - 1, outside]))
                value.append(np.concatenate([some, np.zeros(len(outside))]))
                count.append(np.concatenate([number, between[i][outside]]))
                between[i][:] = 0
            made = [np.concatenate(x) for x in (at, zone, value, count)]
            return pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), pa.array(made[1], pa.int32()), pa.array(made[2]), pa.array(made[3], pa.int64())], names=["i", "zone", "value", "count"])

        for b in batches:
            for i in range(len(columns)):
                v = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                after = np.searchsorted(lows[i], v, "right")
                inside = (after > 0) & (v <= highs[i][after - 1])
                between[i] += np.bincount(2 * after[~inside], minlength=len(between[i]))
                held[i].append(v[inside] + 0.0)
                n += len(held[i][-1])
            if n > GATHER * 10:
                yield told()
                n = 0
        yield told()

    rows = df.select(*[_q(c) for c in columns]).mapInArrow(run, "i int, zone int, value double, count long")
    counts = kept(rows.groupBy("i", "zone", "value").agg(F.sum("count").alias("count")))
    sizes = {(columns[r["i"]], r["zone"]): (r["n"], r["different"]) for r in counts.groupBy("i", "zone").agg(F.sum("count").alias("n"), F.count("*").alias("different")).collect()}
    reading: dict[tuple[int, int], list[tuple[int, int]]] = {}
    left: dict[str, list[tuple]] = {}
    for i, c in enumerate(columns):
        below = 0
        for zone in range(2 * len(brackets[c]) + 1):
            n, different = sizes.get((c, zone), (0, 0))
            ranks = [r for b in brackets[c] for r in b[4] if below <= r < below + n]
            if ranks and zone % 2 and different <= GATHER:
                reading[i, zone] = [(r, r - below) for r in ranks]
            elif ranks:
                edge = [-_INF, *[x for b in brackets[c] for x in b[:2]], _INF]
                left.setdefault(c, []).append((edge[zone], edge[zone + 1], below, n, ranks))
            below += n
    if reading:
        places = df.sparkSession.createDataFrame([(i, z, [p for _, p in x]) for (i, z), x in reading.items()], "i int, zone int, places array<long>")
        after = F.sum("count").over(Window.partitionBy("i", "zone").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        summed = counts.join(F.broadcast(places), ["i", "zone"]).withColumn("after", after).withColumn("before", F.col("after") - F.col("count"))
        hit = F.filter("places", lambda r: (r >= F.col("before")) & (r < F.col("after")))
        for r in summed.select("i", "zone", "value", hit.alias("hit")).where(F.size("hit") > 0).collect():
            rank_of = {p: rank for rank, p in reading[r["i"], r["zone"]]}
            wanted[columns[r["i"]]] |= {rank_of[p]: r["value"] for p in r["hit"]}
    return _around(df, left) if left else {}


def _interpolated(values: dict[int, float], p: float, n: int) -> float:
    at = p * (n - 1)
    low = int(at)
    a, b = values[low], values[min(low + 1, n - 1)]
    return float(a + (b - a) * (at - low))


def bucket_of(value: Column, edges: Column) -> Column:
    """How many edges are at or below the value."""
    return F.size(F.filter(edges, lambda e: e <= value))


def parts_of(rows: int, spark: SparkSession) -> int:
    """Parts in which a task has PART_ROWS rows at most (about); of fewer rows as many as there are cores, if a task has some thousands then."""
    return max(1, -(-rows // PART_ROWS), min(spark.sparkContext.defaultParallelism, rows // SMALL_PART))


def positions(df: DataFrame, order: list[str], into: str = "position") -> DataFrame:
    """df with each row's number in the order given, from 0; nulls come first, rows that are equal in all of the order in any order.

    Rows are parted by ranges of the whole order, as many as their number asks for, so rows of one time may be in several
    parts; each part is sorted and numbered, and the numbers of rows in the parts before are added.
    """
    ranged = df.repartitionByRange(parts_of(df.count(), df.sparkSession), *order).sortWithinPartitions(*order)
    # the number of a row within its part, and the part's number above
    numbered = kept(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    offsets, total = [], 0
    for r in sorted(numbered.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], total))
        total += r["count"]
    told = df.sparkSession.createDataFrame(offsets, "__part int, __before long")
    own = (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(into)
    return numbered.join(F.broadcast(told), part == F.col("__part")).select(*[_q(c) for c in df.columns if c != into], own)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order that begins with a number; nulls come first, rows that are equal in all of it in any order.

    Up to SMALL_PART rows are merged by one task. More are cut off first: an approximate quantile of the first column leaves
    hardly more than n rows (those equal to it stay), which are numbered in ranges of the order.
    """
    if n <= SMALL_PART:
        return df.orderBy(*order).limit(n)
    total, first = df.count(), _q(order[0])
    share, own = 1.0 if not total else min(1.0, 1.02 * n / total + 0.001), df
    while share < 1:
        cut = df.agg(F.percentile_approx(first, share, 10_000).alias("cut")).first()["cut"]
        own = df.where(first.isNull() | (first <= F.lit(cut).cast(df.schema[order[0]].dataType)))
        if cut is not None and own.count() >= n:
            break
        share, own = share * 2, df
    placed = positions(own, order, "__place")
    return placed.where(F.col("__place") < n).drop("__place")


def rows_at(df: DataFrame, order: list[str], places: Iterable[int]) -> dict[int, Row]:
    """The values of the order's columns in the rows at some places of that order (from 0); places beyond the last row are left out.

    Nothing but these columns is read, parted by ranges and sorted.
    """
    found = positions(df.select(*order), order, "__place").where(F.col("__place").isin(sorted(set(places)))).collect()
    return {r["__place"]: r for r in found}


def auc(df: DataFrame, columns: list[str], label: str, ties: str = "average", order: list[str] | None = None) -> dict[str, float]:
    """Area under the curve of each column against a 0/1 label, the better of both directions; nulls and NaN are 0.

    ties "average" gives equal values their mean rank; "ordinal" numbers them in the order of `order`. 0.5 if a class is empty.
    Rows are counted by value first, and ranks are sums of the counts before. Counts are parted by ranges of values (and of
    the order, where that tells equal values apart), as many as the rows ask for.
    """
    out: dict[str, float] = {}
    zero = lambda c: F.coalesce(F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double")), F.lit(0.0))
    ordered = order or [] if ties == "ordinal" else []
    n = df.count()
    for part in blocks(columns, PAIRED):
        clean = df.select(F.col(label).cast("int").alias("__y"), *ordered, *[zero(c).alias(c) for c in part if c not in ordered])
        keys = ["column", "value", *ordered]
        counts = long_form(clean, part, "double", "__y", *ordered).groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("__y") == 1).cast("long")).alias("pos"))
        counts = kept(counts.repartitionByRange(parts_of(n * len(part), df.sparkSession), *keys).withColumn("bucket", F.spark_partition_id()))
        sizes = counts.groupBy("column", "bucket").agg(F.sum("n").alias("size"))
        before = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("column", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("column", "bucket").orderBy("value", *ordered).rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.withColumn("less", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), ["column", "bucket"])
        sums = ranked.groupBy("column").agg(F.sum(F.col("pos") * (F.col("offset") + F.col("less") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect()
        for r in sums:
            pos, neg = r["pos"] or 0, r["n"] - (r["pos"] or 0)
            a = (r["ranks"] - pos * (pos + 1) / 2) / (pos * neg) if pos and neg else 0.5
            out[r["column"]] = max(a, 1 - a)
    return {c: out.get(c, 0.5) for c in columns}


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bin, count) for every bin of explicit edges: closed on the left, the last one on both sides. Values outside are left out."""
    last = len(edges) - 2
    inner = F.array(*[F.lit(float(e)) for e in edges])
    at = F.least(bucket_of(_q(column), inner) - 1, F.lit(last))
    own = df.where(_q(column).between(edges[0], edges[-1])).groupBy(at.alias("bin")).count()
    grid = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(own, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def psi(base: DataFrame, other: DataFrame, columns: list[str], bins: int = 10, eps: float = 1e-6) -> dict[str, float]:
    """Population stability of other against base over base's distinct quantiles, the outer ones open; 0 with under 2 edges or no rows."""
    edges = {c: sorted(set(q or [])) for c, q in quantiles(base, columns, [i / bins for i in range(bins + 1)]).items()}
    used = [c for c in columns if len(edges[c]) >= 2]
    out = dict.fromkeys(columns, 0.0)
    inner = [np.array(edges[c][1:-1]) for c in used]
    most = max((len(e) + 1 for e in inner), default=0)

    def shares(df: DataFrame) -> dict[str, list[float]]:
        return _summed(df, used, most, lambda i, v: np.bincount(np.searchsorted(inner[i], v[~np.isnan(v)], "right"), minlength=most))

    a, b = shares(base), shares(other)
    for c in used:
        n, m = sum(a[c]), sum(b[c])
        if n and m:
            out[c] = sum(((x := a[c][k] / n + eps) - (y := b[c][k] / m + eps)) * math.log(x / y) for k in range(len(edges[c]) - 1))
    return out


def correlations(df: DataFrame, columns: list[str]):
    """Pearson's matrix as a numpy array, nulls as 0; 0 where a column is constant. Sums are added in a tree on the executors."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    zero = df.select(*[F.coalesce(F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double")), F.lit(0.0)).alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=columns, outputCol="__v").transform(zero).select("__v")
    matrix = np.nan_to_num(Correlation.corr(vectors, "__v").first()[0].toArray(), nan=0.0)
    np.fill_diagonal(matrix, 1.0)
    return matrix


def report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, type, n_null, null_rate, n_unique, band) of columns, most nulls first.

    Bands: >=90, 50-90, 0-50 and 0 percent missing.
    """
    columns = columns or df.columns
    types = dict(df.dtypes)
    counted = value_counts(df, columns).groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("n_null"), F.sum("count").alias("n"), F.count("value").alias("n_unique"))
    rate = F.col("n_null") / F.col("n")
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return counted.select("column", kinds[F.col("column")].alias("type"), "n_null", rate.alias("null_rate"), "n_unique", band(rate).alias("band")).orderBy(F.desc("null_rate"), "column")


def sketched(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(part, column, n, n_null, sketch), stored: for each value of `by` the rows, missing values and a sketch of the different values of each column; one pass."""
    own = lambda c: F.struct(F.count(_q(c)).alias("n"), F.hll_sketch_agg(F.when(_q(c).isNotNull(), F.xxhash64(_q(c))), F.lit(SKETCH_BITS)).alias("sketch"))
    parts = df.groupBy(_q(by).alias("part")).agg(F.count("*").alias("rows"), *[own(c).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}.n").alias("n"), F.col(f"c{i}.sketch").alias("sketch")) for i, c in enumerate(columns)])
    return kept(parts.select("part", "rows", F.inline(pairs)).select("part", "column", F.col("rows").alias("n"), (F.col("rows") - F.col("n")).alias("n_null"), "sketch"))


#: Bits of a sketch of different values: numbers up to an eighth of 2 ** SKETCH_BITS are all but exact, others within half a percent.
SKETCH_BITS = 16


def report_of(sketches: DataFrame, parts: list | None = None) -> DataFrame:
    """report() without types over some of the parts that sketched() was made by (all of them, if none are told), from the sketches alone: small numbers of different values are exact, others estimates."""
    own = sketches if parts is None else sketches.where(F.col("part").isin(parts))
    found = own.groupBy("column").agg(F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_unique"))
    rate = F.col("n_null") / F.col("n")
    return found.select("column", "n_null", rate.alias("null_rate"), "n_unique", band(rate).alias("band"))


def band(rate: Column) -> Column:
    return F.when(rate >= 0.9, ">=90").when(rate >= 0.5, "50-90").when(rate > 0, "0-50").otherwise("0")


def top_columns(df: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """(column, max) of the n columns with the largest values."""
    return long_form(df, columns, "double").groupBy("column").agg(F.max("value").alias("max")).orderBy(F.desc_nulls_last("max"), "column").limit(n)


def is_unique(df: DataFrame, key: str) -> bool:
    return df.groupBy(key).count().where("count > 1").isEmpty()


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NUMERIC)
