"""Operator 11: clustering around centroids with exact integers and partial distances.

Components are scaled to integers, so that distances and means don't depend on the order in which tasks are merged. A
vector is compared with a centroid over its high-variance dimensions first; the centroid is given up once what has been
added is strictly above the best distance so far, and only centroids that survive are compared over all dimensions. Each
round moves, of each task, one row for each centroid, dimension and limb; the centroids (k of them) are all that the
driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workspace, written

#: Integers below this size can be subtracted, squared and added over 128 dimensions in 64 bits; larger ones are Python's.
NARROW = 1 << 27
#: Sums are moved in limbs of so many bits, as they may be larger than 64.
LIMB = 40
#: The largest long: what a distance beyond it is returned as.
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Clustering:
    """k centroids, seeded by the smallest SHA-256 of seed:id, after so many rounds over vectors of dims components."""

    k: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    seed: int = 3
    #: Dimensions that are added up before the next comparison.
    step: int = 16


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers, or Python's where one of them is too large."""
    y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < NARROW:
        return y.astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in x.ravel()]
    return np.array(exact, dtype=object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance; the smaller number where distances are equal."""
    if x.dtype != centroids.dtype:
        x, centroids = x.astype(object), centroids.astype(object)
    x, c = x[:, order], centroids[:, order]
    added = lambda rows, j, a, b: ((x[rows, a:b] - c[j, a:b]) ** 2).sum(axis=1)
    every = np.arange(len(x))
    head = np.stack([added(every, j, 0, step) for j in range(len(c))], axis=1)
    first = head.argmin(axis=1)  # likely the nearest: it makes a best to beat
    best, who = ((x - c[first]) ** 2).sum(axis=1), first.copy()
    for j in range(len(c)):
        alive = np.flatnonzero((first != j) & (head[:, j] <= best))
        partial = head[alive, j]
        for a in range(step, x.shape[1], step):
            partial = partial + added(alive, j, a, a + step)
            within = partial <= best[alive]
            alive, partial = alive[within], partial[within]
        closer = (partial < best[alive]) | ((partial == best[alive]) & (j < who[alive]))
        best[alive[closer]], who[alive[closer]] = partial[closer], j
    return who, best


def components(batch: pa.RecordBatch, how: Clustering) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, how.dims)


def vectors(batch: pa.RecordBatch, how: Clustering) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors): those that 64 bits hold, then the others."""
    x = components(batch, how)
    with np.errstate(over="ignore"):
        wide = (np.abs(x * how.scale) >= NARROW - 1).any(axis=1)
    for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if len(rows):
            yield rows, scaled(x[rows], how.scale)


def limbs(value: int) -> list[int]:
    """value in digits of LIMB bits, the last of which has its sign."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def kept(df: DataFrame, how: Clustering, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v of the rows whose vector has exactly dims components, none of them null, NaN or infinite."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where((F.size(v) == how.dims) & fine).select(F.col(vec_id).alias("vec_id"), v.alias("v"))


def seeds(rows: DataFrame, how: Clustering) -> np.ndarray:
    """The first centroids; rows of one id go by their components, and a null id comes last."""
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{how.seed}:"), F.col("vec_id").cast("string")), 256))
    first = hashed.orderBy(F.asc_nulls_last("h"), "v").limit(how.k).collect()
    x = np.array([r.v for r in first], dtype=np.float64).reshape(-1, how.dims)
    return scaled(x, how.scale)


def variance_order(rows: DataFrame, how: Clustering) -> np.ndarray:
    """Dimensions by falling variance, from sums that each task makes. The order decides no result, so doubles will do."""

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((2, how.dims))
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                x = components(batch, how)
                n, sums = n + len(x), sums + np.stack([x.sum(axis=0), (x**2).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(how.dims), pa.int32()), pa.array([n] * how.dims, pa.int64()), pa.array(sums[0]), pa.array(sums[1])], ["dim", "n", "s", "ss"])

    total = rows.mapInArrow(moments, "dim int, n long, s double, ss double").groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    s, ss = np.zeros(how.dims), np.zeros(how.dims)
    for r in total.collect():
        s[r.dim], ss[r.dim] = r.s / max(r.n, 1), r.ss / max(r.n, 1)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.argsort(-np.nan_to_num(ss - s**2), kind="stable")


def moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray, how: Clustering) -> np.ndarray:
    """The centroids after one round: each the floor of its vectors' mean, or as it was if it has none."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in vectors(batch, how):
                who, _ = nearest(x, centroids, order, how.step)
                for j in np.unique(who):
                    own = x[who == j]
                    n, s = total.get(j, (0, 0))
                    total[j] = (n + len(own), s + own.sum(axis=0).astype(object))
        out = [(int(j), d, k, v) for j, (n, s) in total.items() for d, value in enumerate([*s, n]) for k, v in enumerate(limbs(int(value)))]
        columns = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "dim", "limb", "value"])

    found: dict[tuple[int, int], int] = {}
    for r in rows.mapInArrow(sums, "c int, dim int, limb int, value long").groupBy("c", "dim", "limb").agg(F.sum("value").alias("value")).collect():
        found[r.c, r.dim] = found.get((r.c, r.dim), 0) + (r.value << (LIMB * r.limb))
    new = [[found[j, d] // found[j, how.dims] for d in range(how.dims)] if (j, 0) in found else list(old) for j, old in enumerate(centroids)]
    fits = all(-NARROW < int(v) < NARROW for row in new for v in row)
    return np.array(new, dtype=np.int64 if fits else object).reshape(-1, how.dims)


def clustered(df: DataFrame, how: Clustering | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that kept() keeps.

    Vectors that it doesn't keep (null, another length, null or non-finite components) have no row; repeated rows and equal
    vectors count each. With fewer than k vectors there are fewer centroids, with none no rows. Equal vectors among the
    seeds leave the later of them empty, and it stays as it is. More columns of the table are ignored. Distances and sums
    beyond a long are returned as the largest one; what is nearest is exact beyond it too.
    """
    how, spark = how or Clustering(), df.sparkSession
    folder = workspace(spark, "centroids")
    rows = written(kept(df, how, vec_id, embedding), folder, "vectors")
    centroids = seeds(rows, how)
    order = variance_order(rows, how)
    for _ in range(how.rounds if len(centroids) else 0):
        centroids = moved(rows, centroids, order, how)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for at, x in vectors(batch, how):
                who, best = nearest(x, centroids, order, how.step)
                cluster[at], distance[at] = who, [min(int(d), MOST) for d in best]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    assigned = written(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), folder, "assigned")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(inertia.values()), MOST)
    named = [(j, min(inertia.get(j, 0), MOST), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    # k rows, whatever the table's size.
    ends = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
