"""K-means over integer vectors by sort-means: exact assignments, most distances left out.

Each round lists, for each centroid, the others by their distance from it. A vector's search begins with the centroid it was
assigned to before, at distance u, and goes down that centroid's list, stopping at the first one strictly farther than 2u
from it: by the triangle inequality no centroid from there on is nearer than u, or as near with a smaller number. All
arithmetic is on integers.

The vectors' state (components and assignment) is a table in the shared folder, made anew each round, so a lost executor
costs its tasks alone; a round sends the driver the centroids' sums and nothing else. Rows are independent: a vector that
is repeated any number of times burdens no task more than others.

Defined cases: vectors that are null, of another length, or hold a null or a non-finite component aren't kept and have no
row; rows with a null id are assigned, but begin no centroid, and without a centroid there is no result; repeated rows are vectors of their own, and of equal hashes
the one with the smaller components comes first; with fewer vectors than k there are as many centroids; an empty table
gives an empty result. A component whose squared distances wouldn't fit a long (beyond `LARGEST`) is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, stored

#: Components, clusters, rounds, and the seed of the first centroids.
DIMENSIONS, CLUSTERS, ROUNDS, SEED = 64, 16, 3, 1
SCALE = 64
#: The largest component, in absolute value: 64 squares of twice this fit a long.
LARGEST = 1 << 27


def prepared(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, x): the vectors that are kept, each component x as the integer floor(64 * x)."""
    own = F.col(vector)
    finite = F.forall(own, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    scaled = F.transform(own, lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall("x", lambda x: F.abs(x) <= LARGEST)
    rows = df.where((F.size(own) == dimensions) & finite).select(F.col(key).alias("id"), scaled.alias("x"))
    return rows.select("id", F.when(fits, F.col("x").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST}")).cast("array<int>")).alias("x"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes of `seed:<id>`, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.where("id IS NOT NULL").select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of all by their distance from it, itself first, and these squared distances."""
    apart = np.array([squared(centroids, c) for c in centroids])
    apart[np.arange(len(centroids)), np.arange(len(centroids))] = -1
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, axis=1)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number of equally near ones; before: its centroid of the round before."""
    order, apart = orders(centroids)
    best, distance = before.astype(np.int64), np.zeros(len(x), np.int64)
    for c in np.unique(before):
        own = np.flatnonzero(before == c)
        own_distance = distance[own] = squared(x[own], centroids[c])
        for j, gap in zip(order[c][1:], apart[c][1:], strict=True):
            # strictly beyond twice the distance: one at twice the distance may be as near
            open_ = gap <= 4 * own_distance
            if not open_.all():
                own, own_distance = own[open_], own_distance[open_]
            if not len(own):
                break
            d = squared(x[own], centroids[j])
            nearer = (d < distance[own]) | (d == distance[own]) & (j < best[own])
            best[own[nearer]], distance[own[nearer]] = j, d[nearer]
    return best, distance


def _batches(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            x = b.column("x").flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)
            yield b, x, *assign(x, b.column("cluster").to_numpy().astype(np.int64), centroids)


def reassigned(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """state (id, x, cluster, distance) with each vector's nearest centroid and its squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, best, distance in _batches(batches, centroids):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(best, pa.int32()), pa.array(distance)], names=["id", "x", "cluster", "distance"])

    return state.mapInArrow(run, state.schema)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors; one without vectors stays."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            if b.num_rows:
                own, x = b.column("cluster").to_numpy(), b.column("x").flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)
                n += np.bincount(own, minlength=len(n))
                for c in np.unique(own):
                    sums[c] += x[own == c].sum(axis=0)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there]), *(pa.array(sums[there, i]) for i in range(dimensions))], names=["cluster", "n", *(f"s{i}" for i in range(dimensions))])

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(dimensions)))
    # sums of sums, as decimals: no number of vectors is too large
    total = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(total("n"), *[total(f"s{i}") for i in range(dimensions)]).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(dimensions)]
    return out


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(state, centroids) after so many rounds and a last assignment; state is (id, x, cluster, distance), stored."""
    small_batches(vectors.sparkSession)
    state = stored(vectors.select("id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "sort_means")
    centroids = first_centroids(state, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        state = stored(reassigned(state, centroids), "sort_means")
        centroids = moved(state, centroids)
    return (stored(reassigned(state, centroids), "sort_means") if len(centroids) else state.limit(0)), centroids


def digest_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    state, centroids = fit(prepared(df, key, vector), k, rounds, seed)
    sums = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    told = [(c, sums.get(c, 0), sum(sums.values()), digest_of(x)) for c, x in enumerate(centroids)]
    by: Column = F.col("cluster") == F.col("__c")
    table = df.sparkSession.createDataFrame(told, "__c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(table), by).select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
