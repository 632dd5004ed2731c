"""Robust plane models with planted ones, and the plain fits against SVDs."""

import numpy as np
import pytest

from fusionframe.operators import consensus

SCHEMA = "pair string, k long, px double, py double, qx double, qy double"
H = np.array([[1.1, 0.1, 3.0], [-0.2, 0.9, 1.0], [0.01, -0.02, 1.0]])


def moved(h, p):
    z = np.c_[p, np.ones(len(p))] @ h.T
    return z[:, :2] / z[:, 2:]


def plain_normalise(p):
    mid = p.mean(0)
    s = np.sqrt(2) / np.linalg.norm(p - mid, axis=1).mean()
    return np.c_[(p - mid) * s, np.ones(len(p))], np.array([[s, 0, -s * mid[0]], [0, s, -s * mid[1]], [0, 0, 1]])


def plain_homography(p, q):
    (a, t1), (b, t2) = plain_normalise(p), plain_normalise(q)
    rows = []
    for x, (u, v, w) in zip(a, b):
        rows += [np.r_[np.zeros(3), -w * x, v * x], np.r_[w * x, np.zeros(3), -u * x], np.r_[-v * x, u * x, np.zeros(3)]]
    return np.linalg.inv(t2) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ t1


def plain_fundamental(p, q):
    (a, t1), (b, t2) = plain_normalise(p), plain_normalise(q)
    f = np.linalg.svd(np.einsum("ni,nj->nij", b, a).reshape(-1, 9))[2][-1].reshape(3, 3)
    u, d, v = np.linalg.svd(f)
    return t2.T @ (u * [d[0], d[1], 0]) @ v @ t1


def same(a, b):
    a, b = (np.asarray(x, float).ravel() / np.linalg.norm(x) for x in (a, b))
    return min(np.abs(a - b).max(), np.abs(a + b).max())


def cameras(rng, n):
    """Two views of points in space."""
    x = rng.uniform(-1, 1, (n, 3)) + [0, 0, 4]
    c, s = np.cos(0.3), np.sin(0.3)
    r, t = np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]), np.array([1.0, 0.2, 0.1])
    y = x @ r.T + t
    return x[:, :2] / x[:, 2:], y[:, :2] / y[:, 2:]


def table(spark, groups):
    return spark.createDataFrame([(g, k, *map(float, row)) for g, (p, q) in groups.items() for k, row in enumerate(np.c_[p, q])], SCHEMA).repartition(5)


def test_plain_fits(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-5, 5, (40, 2))
    views = cameras(rng, 60)
    groups = {"h": (p, moved(H, p) + rng.normal(0, 0.01, (40, 2))), "v": tuple(x + rng.normal(0, 1e-3, x.shape) for x in views)}
    df = table(spark, groups)
    for fit, plain in ((consensus.homography, plain_homography), (consensus.fundamental, plain_fundamental)):
        got = {r.pair: r.params for r in fit(df, "pair").collect()}
        assert all(same(got[g], plain(*m)) < 1e-6 for g, m in groups.items())


@pytest.mark.parametrize("name,limit", [("homography", 0.01), ("fundamental", 1e-6)])
def test_planted_models(spark, name, limit):
    """40 % of the matches are wrong; one group is larger than a block, one is too small, one has no model."""
    rng = np.random.default_rng(2)
    groups, right = {}, {}
    for g, n in (("a", 60), ("b", 1500)):
        p = rng.uniform(-5, 5, (n, 2))
        p, q = (p, moved(H, p)) if name == "homography" else cameras(rng, n)
        q = q.copy()
        wrong = rng.permutation(n)[: int(0.4 * n)]
        q[wrong] += rng.uniform(2, 9, (len(wrong), 2)) * rng.choice([-1, 1], (len(wrong), 2))
        groups[g], right[g] = (p, q), np.setdiff1d(np.arange(n), wrong)
    groups["few"] = (p[:3], q[:3])
    model = {"homography": consensus.HOMOGRAPHY, "fundamental": consensus.FUNDAMENTAL}[name]
    run = lambda df: {r.pair: r for r in consensus.consensus(df, "pair", "k", model, limit, seed=3).collect()}
    got = run(table(spark, groups))
    plain = {"homography": plain_homography, "fundamental": plain_fundamental}[name]
    for g in "ab":
        p, q = (x[right[g]] for x in groups[g])
        assert len(right[g]) <= got[g].inliers <= len(right[g]) + (0 if name == "homography" else 0.05 * len(groups[g][0]))
        if got[g].inliers == len(right[g]):
            assert same(got[g].params, plain(p, q)) < 1e-5
        assert got[g].n == len(groups[g][0]) and got[g].trials >= 64
    assert got["few"].params is None and got["few"].inliers == 0 and got["few"].n == 3
    again = run(table(spark, groups).repartition(2))
    assert all((again[g].inliers, again[g].trials) == (got[g].inliers, got[g].trials) for g in groups)


def test_degenerate(spark):
    line = np.c_[np.arange(30.0), np.zeros(30)]
    got = consensus.consensus(table(spark, {"line": (line, line)}), "pair", "k", consensus.HOMOGRAPHY, 0.01, most=100).collect()
    assert [(r.params, r.inliers) for r in got] == [(None, 0)]
    assert consensus.consensus(table(spark, {"line": (line, line)}).limit(0), "pair", "k", consensus.HOMOGRAPHY, 0.01).count() == 0
