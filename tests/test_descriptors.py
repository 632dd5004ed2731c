"""Point feature histograms against a plain version, and under rigid motion."""

import numpy as np
import pytest

from fusionframe.operators import descriptors, knn

POINT = "id long, x double, y double, z double, nx double, ny double, nz double"


def angles(p, n, q, m):
    d = (q - p) / np.linalg.norm(q - p)
    a, b = n @ d, m @ d
    lean = a
    if abs(a) < abs(b):
        n, m, d, lean = m, n, -d, -b
    v = np.cross(d, n)
    if not np.linalg.norm(v):
        return None
    v /= np.linalg.norm(v)
    w = np.cross(n, v)
    return np.arctan2(w @ m, n @ m), v @ m, lean


def plain(p, n, radius):
    size = len(p)
    near = [[j for j in range(size) if j != i and ((p[i] - p[j]) ** 2).sum() <= radius**2] for i in range(size)]
    first = np.zeros((size, 33))
    for i in range(size):
        got = [x for j in near[i] if ((p[i] - p[j]) ** 2).sum() and (x := angles(p[i], n[i], p[j], n[j]))]
        for x in got:
            for g, (v, low, high) in enumerate(zip(x, (-np.pi, -1, -1), (np.pi, 1, 1))):
                first[i, 11 * g + int(min(10, max(0, np.floor(11 * (v - low) / (high - low)))))] += 100 / len(got)
    out = {}
    for i in range(size):
        h = sum((first[j] / ((p[i] - p[j]) ** 2).sum() for j in near[i] if first[j].any() and ((p[i] - p[j]) ** 2).sum()), np.zeros(33)).reshape(3, 11)
        if h.any():
            out[i] = (100 * h / h.sum(1, keepdims=True)).ravel()
    return out


def table(spark, p, n):
    return spark.createDataFrame([(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, n))], POINT)


def neighbours(points, radius):
    from pyspark.sql import functions as F

    return knn.range_join(points.select("id", "x", "y", "z"), points.select("id", "x", "y", "z"), radius).where("a_id <> b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def test_fpfh(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(0, 3, (90, 3))
    p = np.r_[p, p[:2], [[40, 0, 0]]]  # two points twice, one alone
    n = rng.normal(size=p.shape)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    points = table(spark, p, n)
    got = {r.id: np.array(r.histogram) for r in descriptors.fpfh(points, neighbours(points, 1.0)).collect()}
    want = plain(p, n, 1.0)
    assert got.keys() == want.keys() and len(p) - 1 not in got
    assert all(np.allclose(got[i], want[i], atol=1e-9) for i in want)
    # A rigid motion changes nothing.
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    moved = table(spark, p @ q.T + [5, -3, 2], n @ q.T)
    again = {r.id: np.array(r.histogram) for r in descriptors.fpfh(moved, neighbours(points, 1.0)).collect()}
    assert sum(np.allclose(again[i], got[i], atol=1e-6) for i in got) >= len(got) - 2  # a value on the edge of two bins may fall into the other
    assert all(h.reshape(3, 11).sum(1) == pytest.approx([100] * 3) for h in got.values())
