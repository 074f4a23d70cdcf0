import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feldspark.functions import scalars as S
from feldspark.operators import stats


def test_scalars(spark):
    rows = [(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (1e31,), (-1e31,), (0.0,), (-3.5,), (5e9,)]
    df = spark.createDataFrame(rows, "x double")
    x = F.col("x")
    got = df.select(S.finite(x), S.clip(S.finite(x), -1, 1), S.signed_log1p(S.finite(x)), S.is_large(x)).collect()
    assert [r[0] for r in got] == [None] * 6 + [0.0, -3.5, 5e9]
    assert [r[1] for r in got] == [None] * 6 + [0.0, -1.0, 1.0]
    assert got[7][2] == pytest.approx(-math.log(4.5))
    assert [r[3] for r in got] == [False] * 8 + [True]


def test_time(spark):
    df = spark.createDataFrame([(0,), (86400 * 2 + 3600 * 23,), (86400 * 400,)], "dt long")
    dt = F.col("dt")
    got = df.select(S.hour(dt), S.day_of_week(dt), S.month(dt), S.year(dt)).collect()
    # 2017-12-01 is a Friday, but the constant is that of midnight
    assert [tuple(r) for r in got] == [(0, 4, 12, 2017), (23, 6, 12, 2017), (0, (400 + 4) % 7, 1, 2019)]


def test_quantiles_by_brackets(spark, monkeypatch):
    rnd = random.Random(3)
    values = [rnd.choice([rnd.gauss(0, 5), 1.0, None, 2.5]) for _ in range(3000)]
    df = spark.createDataFrame([(v, 7.0, None, float(i)) for i, v in enumerate(values)], "a double, same double, none double, i double")
    probabilities = [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]
    known = np.array([v for v in values if v is not None])
    for gather in (100_000, 200, 20):
        monkeypatch.setattr(stats, "GATHER", gather)
        got = stats.quantiles(df, ["a", "same", "none", "i"], probabilities)
        assert got["a"] == pytest.approx(np.quantile(known, probabilities).tolist())
        assert got["same"] == [7.0] * 7 and got["none"] is None
        assert got["i"] == pytest.approx(np.quantile(np.arange(3000), probabilities).tolist())


def test_positions(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([0, 0, 0, rnd.randrange(50)]), i) for i in range(500)]
    got = stats.positions(spark.createDataFrame(rows, "t long, i long"), ["t", "i"], "p").collect()
    assert [(r.t, r.i) for r in sorted(got, key=lambda r: r.p)] == sorted(rows)
    assert sorted(r.p for r in got) == list(range(500))
    assert stats.positions(spark.createDataFrame([], "t long, i long"), ["t", "i"]).count() == 0


def test_auc(spark):
    rows = [(float(v), y) for v, y in [(1, 0), (1, 1), (2, 0), (2, 1), (3, 1), (3, 1), (0, 0)]] + [(None, 0)]
    df = spark.createDataFrame(rows, "x double, y int")
    filled = [(0.0 if v is None else v, y) for v, y in rows]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in filled if y for b, z in filled if not z]
    want = sum(pairs) / len(pairs)
    assert stats.auc(df, ["x"], "y")["x"] == pytest.approx(max(want, 1 - want))
    assert stats.auc(df.where("y = 1"), ["x"], "y")["x"] == 0.5


def test_psi(spark):
    rnd = np.random.default_rng(0)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "x double")
    base, same, shifted = (frame(rnd.normal(m, 1, 1000)) for m in (0, 0, 5))
    assert stats.psi(base, same, ["x"])["x"] < 0.1
    assert stats.psi(base, shifted, ["x"])["x"] > 0.25
    assert stats.psi(frame([1] * 9), same, ["x"])["x"] == 0
    assert stats.psi(base, same.where("false"), ["x"])["x"] == 0


def test_correlations_and_skew(spark):
    rnd = np.random.default_rng(1)
    a = rnd.normal(size=200)
    rows = [(float(x), float(2 * x + 1), 5.0, float(x**2) if x > 0 else None) for x in a]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    m = stats.correlations(df, ["a", "b", "c", "d"])
    assert m[0, 1] == pytest.approx(1) and m[0, 2] == 0
    assert m[0, 3] == pytest.approx(np.corrcoef(a, np.where(a > 0, a**2, 0))[0, 1])
    z = (a - a.mean()) / a.std()
    assert stats.skewness(df, ["a", "c"]) == pytest.approx({"a": (z**3).mean(), "c": 0.0})


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 3, 9)], "x double")
    assert [r["count"] for r in stats.histogram(df, "x", [0, 1, 2, 3]).orderBy("bin").collect()] == [1, 2, 2]


def test_shares_and_counts(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1), (None, 1)], "s string, n int")
    assert stats.top_shares(df, ["s", "n"]) == {"s": 0.5, "n": 0.5}
    assert stats.distinct_counts(df, ["s", "n"]) == {"s": 2, "n": 1}
    assert stats.missing_rates(df, ["s", "n"]) == {"s": 0.25, "n": 0.5}
    assert not stats.is_unique(df, "n") and stats.is_unique(df.where("s = 'b'"), "s")


def test_skew_by_the_pass_of_the_moments(spark):
    rnd = np.random.default_rng(4)
    x = np.exp(rnd.normal(size=3000)) - 5
    df = spark.createDataFrame([(float(v), 1.0) for v in x], "a double, b double").repartition(7)
    found = stats.moments(df, ["a", "b"])
    assert found["a"]["skew"] == pytest.approx(((x - x.mean()) ** 3).mean() / x.std() ** 3, rel=1e-9)
    assert found["b"]["skew"] == 0.0 == stats.moments(df.limit(2), ["a"])["a"]["skew"] == stats.moments(df.limit(0), ["a"])["a"]["skew"]


def test_leakage_check_passes_over_its_table(spark, sf_dir, monkeypatch):
    """Each of the four fits finds all its quantiles together, and its moments and skewness by one pass."""
    from feldspark.plans import queries

    calls = []
    for name in ("quantiles", "profile", "skewness"):
        monkeypatch.setattr(stats, name, lambda *a, _f=getattr(stats, name), _n=name, **k: (a[1] and calls.append(_n), _f(*a, **k))[1])
    got = {r["fitted_on"]: r["ok"] for r in queries.QUERIES["leakage_check"](spark, sf_dir).collect()}
    assert got == {"train": True, "all": False}
    assert {n: calls.count(n) for n in calls} == {"quantiles": 4, "profile": 4}
