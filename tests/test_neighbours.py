"""Nearest rows of large references: the same as by all distances, whatever the cells and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feldspark.operators import impute, neighbours


def table(spark, points, targets, key="id"):
    width, more = points.shape[1], targets.shape[1]
    rows = [(i, *map(float, points[i]), *[None if np.isnan(v) else float(v) for v in targets[i]], "x") for i in range(len(points))]
    return spark.createDataFrame(rows, f"{key} long, " + ", ".join(f"a{j} double" for j in range(width)) + ", " + ", ".join(f"t{j} double" for j in range(more)) + ", cell string")


def points_of(kind, n, rnd):
    if kind == "grid":
        return rnd.integers(0, 4, (n, 3)).astype(float)
    if kind == "hot":
        x = rnd.normal(size=(n, 3))
        x[: n // 3] = 0.5
        return x
    return np.concatenate([rnd.normal(size=(n // 2, 3)), rnd.normal(size=(n - n // 2, 3)) * 0.01 + 5])


@pytest.mark.parametrize("kind", ["grid", "hot", "spread"])
@pytest.mark.parametrize("blocks", [40, 20_000])
def test_fill_without_a_broadcast(spark, monkeypatch, kind, blocks):
    rnd = np.random.default_rng(len(kind))
    points, targets = points_of(kind, 900, rnd), rnd.normal(size=(900, 2))
    targets[rnd.random((900, 2)) < 0.3] = np.nan
    df = table(spark, points, targets)
    ref = df.where("id % 2 = 0")
    anchors = [F.col(f"a{j}") for j in range(3)]
    monkeypatch.setattr(impute, "REFERENCE_VALUES", 0)
    monkeypatch.setattr(neighbours, "ROWS", blocks)
    monkeypatch.setattr(neighbours, "QUERIES", blocks)
    out = impute.knn_fill(df, ref, "id", anchors, ["t0", "t1"], 5, {"t0": 7.0, "t1": 8.0})
    assert out.columns == df.columns
    got = {r["id"]: (r["t0"], r["t1"]) for r in out.collect()}
    base, known = points[::2], targets[::2]
    assert len(got) == 900
    for i in range(900):
        near = np.argsort(np.round(((base - points[i]) ** 2).sum(1), 9), kind="stable")[:5]
        for c in range(2):
            own = known[near, c][~np.isnan(known[near, c])]
            want = targets[i, c] if not np.isnan(targets[i, c]) else own.mean() if len(own) else (7.0, 8.0)[c]
            assert got[i][c] == pytest.approx(want)


def test_odd_references(spark, monkeypatch):
    monkeypatch.setattr(impute, "REFERENCE_VALUES", 0)
    df = spark.createDataFrame([(1, 0.0, None), (2, 1.0, 4.0), (3, 1.0, None), (3, 1.0, None)], "id long, a double, t double")
    fill = lambda ref, k: sorted((r["id"], r["t"]) for r in impute.knn_fill(df, ref, "id", [F.col("a")], ["t"], k, {"t": 9.0}).collect())
    assert fill(df, 2) == [(1, 4.0), (2, 4.0), (3, 4.0), (3, 4.0)]
    assert fill(df.where("id = 1"), 3) == [(1, 9.0), (2, 4.0), (3, 9.0), (3, 9.0)]
    assert fill(df.where("false"), 3) == [(1, 9.0), (2, 4.0), (3, 9.0), (3, 9.0)]
    assert impute.knn_fill(df.where("false"), df, "id", [F.col("a")], ["t"], 2, {}).count() == 0


def test_hot_points(spark, monkeypatch):
    """With half of both sides at one point: it is one query, and of its rows those of the least keys are enough."""
    monkeypatch.setattr(neighbours, "ROWS", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 60)
    ref = spark.range(1000).select(F.col("id").alias("key"), F.array(F.lit(0.0), F.col("id") % 2 * F.col("id")).alias("point"), F.array(F.col("id").cast("double")).alias("t"))
    found = neighbours.means_of_nearest(ref.select("point"), ref, 3, 2, 1)
    assert {tuple(r["point"]): r["means"][0] for r in found.collect()}[0.0, 0.0] == pytest.approx((0 + 2 + 4) / 3)
    assert neighbours.thinned(ref, 3).count() == 503


def test_cells_that_cannot_hold_a_nearer_row_are_left_out():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(30, 4)) * 100
    rows = centres[rnd.integers(0, 30, 3000)] + rnd.normal(size=(3000, 4))
    pivots = neighbours.Pivots(centres)
    cell, reach = pivots.homes(rows)
    pivots.rows = np.bincount(cell, minlength=30)
    np.maximum.at(pivots.radius, cell, reach)
    query = rows[:200] + 0.1
    home, within = pivots.bound(query, 5)
    d = ((query[:, None] - rows[None]) ** 2).sum(2)
    kth = np.sort(d, axis=1)[:, 4]
    assert (kth <= within).all()
    q, other = pivots.others(query, home, kth)
    assert len(q) < 0.1 * 200 * 30
    visited = np.zeros((200, 30), bool)
    visited[np.arange(200), home] = visited[q, other] = True
    near = np.argsort(d, axis=1)[:, :5]
    assert visited[np.repeat(np.arange(200), 5), cell[near].ravel()].all()


@pytest.mark.parametrize("kind", ["grid", "spread"])
def test_patterns_of_missing_coordinates(monkeypatch, kind):
    """The same rows in the same order as by all distances, with queries that share no coordinate with some rows or with any."""
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 3, (2000, 5)).astype(float) if kind == "grid" else rnd.normal(size=(2000, 5)) * [1, 1, 5, 0.1, 1]
    masks = np.array([[0, 0, 0, 0, 0], [1, 0, 0, 0, 0], [0, 1, 1, 0, 0], [1, 1, 1, 1, 0], [0, 0, 0, 0, 1]], bool)
    base[masks[rnd.integers(0, 5, 2000)]] = np.nan
    query = np.concatenate([base[:150], np.where(rnd.random((100, 5)) < 0.5, np.nan, rnd.normal(size=(100, 5))), np.full((2, 5), np.nan), [[1, np.nan, np.nan, np.nan, np.nan]]])
    index = neighbours.Patterns(base)
    assert neighbours.Patterns.worth(base) and not neighbours.Patterns.worth(np.where(rnd.random((500, 12)) < 0.5, np.nan, 1.0))
    for k in (1, 5, 1500):
        assert (index.nearest(query, k) == impute.nearest(query, base, k, nan_aware=True)).all()
    monkeypatch.setattr(impute, "LARGE", 1)
    assert (impute.finder(base, 5, True)(query) == impute.nearest(query, base, 5, True)).all()
    few = np.array([[1.0, np.nan], [np.nan, 2.0]])
    assert neighbours.Patterns(few).nearest(np.array([[1.0, np.nan]]), 5).tolist() == [[0, 1]]


def test_patterns_look_into_few_rows():
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(50_000, 3)) @ rnd.normal(size=(3, 8))
    base[rnd.random(50_000) < 0.3, 2:4] = np.nan
    index = neighbours.Patterns(base)
    query = base[rnd.integers(0, 50_000, 300)] + 0.01
    index.nearest(query, 5)
    assert index.looked < 0.2 * 300 * 50_000
