import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from orbisect.llm import centroids as C

from ..compare import rows as plain_rows

VECTORS = "vec_id long, embedding array<double>"


def plain(table, how):
    """The contract, a vector and a centroid at a time, in Python's integers."""
    fine = [(i, [math.floor(Fraction(x) * how.scale) for x in v]) for i, v in table if v is not None and len(v) == how.dims and all(x is not None and math.isfinite(x) for x in v)]
    named = lambda i: (i is None, hashlib.sha256(f"{how.seed}:{i}".encode()).hexdigest() if i is not None else "")
    cents = [v for _, v in sorted(fine, key=lambda r: (*named(r[0]), r[1]))[: how.k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda: [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in fine]
    for _ in range(how.rounds if cents else 0):
        who = [j for _, j in near()]
        for j in range(len(cents)):
            own = [v for (_, v), w in zip(fine, who, strict=True) if w == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = near()
    most = (1 << 63) - 1
    sums = {j: min(sum(min(d, most) for d, w in got if w == j), most) for j in range(len(cents))}
    total = min(sum(sums.values()), most)
    return [(i, j, min(d, most), sums[j], total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(fine, got, strict=True)]


def same(df, want):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert df.columns == columns
    assert plain_rows(columns, [tuple(r) for r in df.collect()]) == plain_rows(columns, want)


def cloud(n, dims, seed=1):
    r = random.Random(seed)
    return [(k, [r.gauss(k % 4, 0.3 + d) for d in range(dims)]) for k in range(n)]


@pytest.mark.parametrize(("n", "how"), [(300, C.Clustering(k=5, rounds=4, dims=12, step=4)), (90, C.Clustering(k=8, rounds=10, dims=64)), (3, C.Clustering(k=8, rounds=2, dims=5, step=16))])
def test_as_brute_force(spark, n, how):
    table = cloud(n, how.dims)
    same(C.clustered(spark.createDataFrame(table, VECTORS).repartition(4), how), plain(table, how))


def test_odd_vectors(spark):
    how = C.Clustering(k=4, rounds=3, dims=3, step=2)
    table = [(k, [0.5, -0.25, k / 8]) for k in range(12)] + [(20, [0.5, -0.25, 0.0])] * 5 + [(None, [1.0, 2.0, 3.0]), (7, [9.0, 9.0, 9.0]), (7, [8.0, 8.0, 8.0])]
    odd = [(30, None), (31, []), (32, [1.0, 2.0]), (33, [1.0, None, 2.0]), (34, [1.0, float("nan"), 2.0]), (35, [float("inf"), 0.0, 0.0]), (36, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(table + odd, VECTORS)
    same(C.clustered(df, how), plain(table, how))
    assert C.clustered(df.where("vec_id between 30 and 36"), how).collect() == []
    assert C.clustered(spark.createDataFrame([], VECTORS), how).collect() == []
    from pyspark.sql import functions as F

    same(C.clustered(df.select("*", *(F.lit("x").alias(c) for c in ("v", "cluster", "h", "distance"))), how), plain(table, how))


def test_large_components_are_exact(spark):
    how = C.Clustering(k=3, rounds=3, dims=2, step=1)
    table = [(k, [1e5 + k, 3e17 * (k % 3)]) for k in range(9)] + [(50, [1e300, -1e300]), (51, [0.1, 0.2])]
    same(C.clustered(spark.createDataFrame(table, VECTORS), how), plain(table, how))


def test_equal_vectors_share_a_seed(spark):
    """All seeds equal: the first takes all, the others stay empty and as they are."""
    how = C.Clustering(k=3, rounds=2, dims=2)
    table = [(k, [1.0, 1.0]) for k in range(20)]
    got = C.clustered(spark.createDataFrame(table, VECTORS), how).collect()
    assert {(r.cluster, r.distance) for r in got} == {(0, 0)} and len(got) == 20


def test_partial_distances_decide_as_whole_ones():
    r = np.random.default_rng(3)
    for _ in range(20):
        x, c = r.integers(-9, 9, (200, 10)), r.integers(-9, 9, (6, 10))
        c[4] = c[1]
        who, best = C.nearest(x, c, r.permutation(10), 3)
        whole = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (who == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()
    assert [C.limbs(v) for v in (0, -5, 1 << 40, -(1 << 41))] == [[0], [-5], [0, 1], [0, -2]]
