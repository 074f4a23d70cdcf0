"""Boosted trees against a plain booster in memory, which searches every node's rows for every cut."""

import numpy as np
import pytest

from feldspark.operators import boost


def plain(bins, y, settings, picked, features):
    """(gain and number of splits by feature, margins), each tree grown node by node."""
    n, width = bins.shape
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    margin, gain, splits = np.zeros(n), np.zeros(width), np.zeros(width, int)

    def grow(rows, seen, depth, g, h, out):
        def leaf(own):
            return -settings.rate * g[own].sum() / (h[own].sum() + settings.smoothing)

        best = (0.0, None, None)
        if depth < settings.depth:
            score = lambda own: g[own].sum() ** 2 / (h[own].sum() + settings.smoothing)
            for f in seen:
                for c in range(boost.BINS - 1):
                    left, right = rows & (bins[:, f] <= c), rows & (bins[:, f] > c)
                    if h[left & picked_now].sum() >= settings.least and h[right & picked_now].sum() >= settings.least:
                        x = score(left & picked_now) + score(right & picked_now) - score(rows & picked_now)
                        if x > best[0] + 1e-9:
                            best = (x, f, c)
        if best[1] is None:
            out[rows] = leaf(rows & picked_now)
            return
        x, f, c = best
        gain[f] += x
        splits[f] += 1
        grow(rows & (bins[:, f] <= c), seen, depth + 1, g, h, out)
        grow(rows & (bins[:, f] > c), seen, depth + 1, g, h, out)

    for r in range(settings.rounds):
        picked_now = picked(r)
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(n)
        grow(np.ones(n, bool), features(r), 0, weight * (p - y), weight * p * (1 - p), out)
        margin = margin + out
    return gain, splits, margin


@pytest.mark.parametrize("stored", [2, 20])
def test_gains_equal_those_of_a_plain_booster(spark, monkeypatch, stored):
    monkeypatch.setattr(boost, "STORED", stored)
    rnd = np.random.default_rng(3)
    x = np.round(rnd.normal(size=(500, 3)) * 2) / 2
    y = (x[:, 0] + rnd.normal(size=500) > 0.8).astype(int)
    rows = [(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)]
    rows[7] = (None, float("nan"), 0.5, 1)
    x[7], y[7] = (0, 0, 0.5), 1
    df = spark.createDataFrame(rows, "a double, b double, c double, isFraud int").coalesce(1)
    settings = boost.Settings(rounds=5, depth=3, rows=1.0, columns=1.0, rate=0.3)
    edges = boost.edges_of(df, ["a", "b", "c"])
    bins = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1)
    model = boost.fit(df, ["a", "b", "c"], settings=settings)
    gain, splits, margin = plain(bins, y, settings, lambda r: np.ones(500, bool), lambda r: range(3))
    assert [model.gain[c] for c in "abc"] == pytest.approx(gain.tolist(), rel=1e-6)
    assert [model.splits[c] for c in "abc"] == splits.tolist()
    got = sum(t.value[t.nodes(bins.astype(np.uint8))] for t in model.trees)
    assert got == pytest.approx(margin, abs=1e-9)


def test_stops_on_validation_rows(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 2))
    y = (x[:, 0] > 0.5).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, isFraud int")
    model = boost.fit(df, ["a", "b"], val=df.limit(150), settings=boost.Settings(rounds=40, depth=2, patience=3))
    assert len(model.trees) < 40 and max(model.areas) > 0.99
    found = model.importance()
    assert found["a"] > 10 * found["b"]


def test_area_and_samples():
    score, y = np.array([3, 2, 2, 1, 0]), np.array([1, 0, 1, 0, 1])
    negative, positive = np.bincount(score[y == 0], minlength=4), np.bincount(score[y == 1], minlength=4)
    assert boost._area(negative, positive) == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 5) / 3)
    assert boost._area(negative, positive * 0) == 0.0
    rows = np.arange(100_000)
    a, b = boost._picked(rows, 1, 42, 0.8), boost._picked(rows, 2, 42, 0.8)
    assert abs(a.mean() - 0.8) < 0.01 and abs((a & b).mean() - 0.64) < 0.01
    assert len(boost._features(10, 3, boost.Settings())) == 6 and len({tuple(boost._features(10, r, boost.Settings())) for r in range(9)}) > 1


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, isFraud int")
    assert boost.fit(df, ["a"]).importance() == {"a": 0.0} == boost.first_gains(df, ["a"])
    assert boost.fit(df.where("false"), ["a"]).importance() == {"a": 0.0}


def test_edges_are_exact_beyond_the_rows_that_a_task_holds(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    x = np.round(np.exp(rnd.normal(size=6000) * 3), 3)
    df = spark.createDataFrame([(float(v), int(v > 2)) for v in x], "a double, isFraud int")
    shares = [k / boost.BINS for k in range(1, boost.BINS)]
    gains = boost.first_gains(df, ["a"])
    monkeypatch.setattr(boost.stats, "HELD", 100)
    monkeypatch.setattr(boost.stats, "SKETCH", 200)
    assert boost.edges_of(df, ["a"])[0] == pytest.approx(np.unique(np.quantile(x, shares)), rel=1e-12)
    assert boost.first_gains(df, ["a"]) == pytest.approx(gains, rel=1e-9)
