"""Clustering against plain NumPy that measures every distance."""

import hashlib

import numpy as np
import pytest

from weftline.llm import clustering


def plain(rows, k=8, rounds=10):
    kept = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    x = np.stack([v for _, v in kept])
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), tuple(v), n) for n, (i, v) in enumerate(kept) if i is not None)
    c = x[[n for *_, n in order[:k]]]
    for last in [False] * rounds + [True]:
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if not last:
            c = np.stack([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    d = d[np.arange(len(x)), a]
    return sorted(((i, int(j), int(e), int(d[a == j].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), j, e in zip(kept, a, d)), key=str)


def cases():
    rng = np.random.default_rng(5)
    spread = [(i, rng.normal(size=64).tolist()) for i in range(700)]
    # Few distinct values: many vectors lie equally far from two centroids, and some centroids are equal.
    ties = [(i, (rng.integers(0, 2, 64) * (np.arange(64) < 4) / 1024).tolist()) for i in range(400)]
    groups = [(i, (rng.normal(size=64) * 0.01 + i % 8).tolist()) for i in range(900)]
    odd = [(1, None), (2, [0.5] * 63), (3, [0.5] * 63 + [None]), (4, [0.5] * 63 + [float("nan")]), (5, [float("inf")] + [0.5] * 63), (None, [0.25] * 64), (6, [0.25] * 64), (6, [0.25] * 64), (6, [-0.25] * 64), (7, [-1e5] * 64), (8, [1e5] * 64)]
    return {"spread": spread, "ties": ties, "groups": groups, "odd": odd, "few": odd[5:7], "none": odd[:5]}


@pytest.mark.parametrize("name", ["spread", "ties", "groups", "odd", "few", "none"])
def test_every_distance(spark, name):
    rows = cases()[name]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, sums string").repartition(3)
    got = sorted((tuple(r) for r in clustering.cluster_report(df).collect()), key=str)
    assert got == plain(rows)


def test_bounds_save_distances(spark):
    rows = cases()["groups"]
    found = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.measured[0] <= 8 * len(rows) and sum(found.measured[2:]) < 0.2 * 8 * len(rows) * len(found.measured[2:])


def test_components_beyond_the_limit(spark):
    df = spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no exact distance"):
        clustering.cluster_report(df).collect()


def test_bounds_hold():
    x = np.random.default_rng(1).uniform(0, 2**31, 10000)
    assert (clustering.down(x).astype(np.float64) < x).all() and (clustering.up(x).astype(np.float64) > x).all()
