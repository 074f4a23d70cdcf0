import hashlib

import numpy as np
import pytest

from feldspark.llm import sort_means as S


def brute(rows, k, rounds, seed=1):
    """(cluster, distance) of each kept row, and the centroids, by all distances."""
    kept = [(i, np.floor(np.array(x, float) * 64).astype(np.int64)) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    if not kept:
        return [], None
    named = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x.tolist()) for i, x in kept if i is not None))
    c = np.array([x for _, x in named[:k]], np.int64)
    m = np.array([x for _, x in kept], np.int64)
    for r in range(rounds + 1):
        d = ((m[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        for j in range(len(c)) if r < rounds else ():
            if (a == j).any():
                c[j] = m[a == j].sum(0) // (a == j).sum()
    return [(i, int(a[n]), int(d[n, a[n]])) for n, (i, _) in enumerate(kept)], c


def check(spark, rows, k=16, rounds=3):
    df = spark.createDataFrame([(i, x, 5, 6) for i, x in rows], "vec_id long, embedding array<float>, cluster int, x int")
    got = S.cluster_vectors(df, k=k, rounds=rounds).collect()
    want, c = brute(rows, k, rounds)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r["inertia"] == sum(d for _, _, d in want) and r["cluster_inertia"] == sum(d for _, j, d in want if j == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()
    return got


@pytest.mark.parametrize("grid", [0, 1])
def test_against_brute_force(spark, grid):
    """On a grid of few points distances tie all the time, and clusters get empty."""
    draw = np.random.default_rng(grid)
    x = draw.integers(-1, 2, (400, 64)) * (draw.random(64) < 0.05) / 64 if grid else draw.normal(size=(400, 64))
    check(spark, list(enumerate(x.astype(np.float32).tolist())))


def test_assign_by_every_start():
    draw = np.random.default_rng(3)
    x, c = draw.integers(-2, 3, (500, 3)), draw.integers(-2, 3, (20, 3))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    for before in (np.zeros(500, int), draw.integers(0, 20, 500), d.argmax(1)):
        best, distance = S.assign(x, before, c)
        assert (best == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_most_distances_are_left_out(monkeypatch):
    draw = np.random.default_rng(4)
    c = draw.integers(-9000, 9000, (16, 64))
    x = c[draw.integers(0, 16, 2000)] + draw.integers(-5, 6, (2000, 64))
    before = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    seen, plain = [], S.squared
    monkeypatch.setattr(S, "squared", lambda a, b: (seen.append(len(a)), plain(a, b))[1])
    S.assign(x, before, c)
    assert sum(seen) - 16 * 16 <= 1.1 * len(x)


def test_odd_rows(spark):
    zero, big = [0.0] * 64, [1e5] * 64
    rows = [(1, zero), (1, zero), (1, big), (2, None), (3, [1.0] * 63), (4, [None, *zero[1:]]), (5, [float("nan"), *zero[1:]]), (6, [float("inf"), *zero[1:]]), (None, [-0.01] * 64), (7, [])]
    check(spark, rows)
    check(spark, [(9, zero)] * 200 + [(i, [float(i)] * 64) for i in range(40)])
    assert check(spark, rows[3:6] + rows[6:8] + [(7, [])]) == []
    assert S.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="a component beyond"):
        S.cluster_vectors(spark.createDataFrame([(1, [3e9] * 64)], "vec_id long, embedding array<float>")).count()


def test_embeddings(spark, sf_dir):
    check(spark, [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()])
