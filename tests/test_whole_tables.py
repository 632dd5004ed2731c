"""Geometry queries over whole tables, against brute force on tables made here."""

import numpy as np
import pytest

from fusionframe import queries as q


@pytest.fixture(scope="module")
def descriptors(spark, tmp_path_factory):
    """1,100 descriptors in 5 labels: more than one block."""
    at, rng = tmp_path_factory.mktemp("descriptors"), np.random.default_rng(2)
    v, label = (rng.normal(0, 4, (1100, 4)) + 0.5).astype(np.float32), rng.integers(0, 5, 1100)
    rows = [(i, [float(x) for x in v[i]], int(label[i])) for i in range(len(v))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    a, b = np.triu_indices(len(v), 1)
    return str(at), np.round(np.sqrt(((v[a].astype(float) - v[b].astype(float)) ** 2).sum(1)), 9), (label[a] == label[b]).astype(int)


def test_losses_take_all_pairs(spark, descriptors):
    at, d, y = descriptors
    row = q.queries()["contrastive_loss"](spark, at).first()
    assert row.n == len(d) == 1100 * 1099 // 2
    assert row.loss == pytest.approx(np.mean(0.5 * (y * d * d + (1 - y) * np.maximum(10 - d, 0) ** 2)), abs=2e-6)
    row, r = q.queries()["regression_losses"](spark, at).first(), d / 10 - y
    want = np.where(abs(r) < 1, r * r / 2, abs(r) - 0.5).mean(), (r * r / 2).mean(), abs(r).mean()
    assert (row.smooth_l1, row.sse, row.amean) == pytest.approx(want, abs=2e-6)
    row, p = q.queries()["log_loss"](spark, at).first(), 1 / (1 + np.exp(d - 9))
    assert (row.loss, row.accuracy) == pytest.approx((abs(np.log(np.where(y == 1, p, 1 - p))).mean(), ((p > 0.5) == (y == 1)).mean()), abs=2e-6)


def test_sweeps_take_all_pairs(spark, descriptors):
    at, d, y = descriptors
    got = {r.k: (r.tp, r.fp, r.fn, r.tn) for r in q.queries()["confusion_sweep"](spark, at).collect()}
    want = {k: tuple(int(((y == own) & ((d < k * (20 / 1000)) == under)).sum()) for under in (True, False) for own in (1, 0)) for k in range(1001)}
    assert got == want
    tp, fp, fn, tn = (np.array([want[k][x] for k in range(1001)]) for x in range(4))
    recall, fpr = tp / (tp + fn), fp / (fp + tn)
    rates = {r.k: (r.recall, r.fpr) for r in q.queries()["sweep_rates"](spark, at).collect()}
    assert all(rates[k] == pytest.approx((recall[k], fpr[k]), abs=2e-6) for k in range(1001))
    near = (recall > 0.949) & (recall < 0.951)
    assert near.any() and q.queries()["fpr_at_recall95"](spark, at).first().fpr == pytest.approx(fpr[near].mean(), abs=2e-6)


@pytest.fixture(scope="module")
def lattice(spark, tmp_path_factory):
    """2,012 parts, 40 to a row, and the faces of the height field."""
    at, rng = tmp_path_factory.mktemp("parts"), np.random.default_rng(3)
    z = rng.integers(1, 51, 2012)
    spark.createDataFrame([(k + 1, int(s)) for k, s in enumerate(z)], "p_partkey long, p_size int").write.parquet(f"{at}/part.parquet")
    k = np.arange(len(z))
    xyz = np.stack((k % 40, k // 40, z * 0.02), 1).astype(float)
    quad = k[(k % 40 < 39) & (k + 41 < len(z))]
    faces = np.concatenate((np.stack((quad, quad + 1, quad + 40), 1), np.stack((quad + 1, quad + 41, quad + 40), 1)))
    ends = np.unique(np.sort(np.concatenate((faces[:, :2], faces[:, 1:], faces[:, ::2])), 1), axis=0)
    return str(at), xyz, faces, ends


def test_mesh_queries_take_all_parts(spark, lattice):
    at, xyz, faces, ends = lattice
    run = lambda name: q.queries()[name](spark, at).collect()
    c = xyz[faces]
    area = np.linalg.norm(np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0]), axis=1) / 2
    around, angle = np.bincount(faces.ravel(), np.repeat(area, 3), len(xyz)), np.zeros(len(xyz))
    for k in range(3):
        u, v = c[:, (k + 1) % 3] - c[:, k], c[:, (k + 2) % 3] - c[:, k]
        np.add.at(angle, faces[:, k], np.arccos((u * v).sum(1) / np.linalg.norm(u, axis=1) / np.linalg.norm(v, axis=1)))
    used = np.unique(faces)
    (row,) = run("mesh_stats")
    want = [area.sum(), *(area[:, None] * c.mean(1)).sum(0) / area.sum(), np.linalg.norm(xyz[ends[:, 0]] - xyz[ends[:, 1]], axis=1).mean()]
    assert [row.area, row.x, row.y, row.z, row.mean_edge] == pytest.approx(want, abs=2e-6)
    assert {r.vid: r.area for r in run("vertex_area")} == pytest.approx({int(v): around[v] / 3 for v in used}, abs=2e-6)
    assert {r.vid: r.curvature for r in run("gauss_curvature")} == pytest.approx({int(v): 3 * (2 * np.pi - angle[v]) / around[v] for v in used}, abs=2e-5)
    assert {r.vid for r in run("delete_unused")} == set(used.tolist())
    near = [[] for _ in xyz]
    for a, b in ends.tolist():
        near[a].append(b)
        near[b].append(a)
    assert {r.vid for r in run("local_extrema")} == {v for v, o in enumerate(near) if o and xyz[v, 2] > xyz[o, 2].max()}
    smooth = {v: tuple((xyz[v] + xyz[o].mean(0)) / 2 if o else xyz[v]) for v, o in enumerate(near)}
    got = {r.vid: (r.x, r.y, r.z) for r in run("mesh_smooth")}
    assert set(got) == set(smooth) and all(got[v] == pytest.approx(smooth[v], abs=2e-6) for v in got)


def test_geodesic_reaches_all_parts(spark, lattice):
    from fusionframe.operators import mesh

    at, xyz, _, ends = lattice
    w, low = np.linalg.norm(xyz[ends[:, 0]] - xyz[ends[:, 1]], axis=1), np.full(len(xyz), np.inf)
    low[0] = 0
    for _ in range(len(xyz)):
        before = low.copy()
        for a, b in (ends.T, ends.T[::-1]):
            np.minimum.at(low, b, before[a] + w)
        if (before == low).all():
            break
    want = {v: x for v, x in enumerate(low.tolist()) if x < np.inf}
    assert max(want.values()) > 12
    assert {r.vid: r.dist for r in q.queries()["geodesic"](spark, at).collect()} == pytest.approx(want, abs=2e-6)
    v, f = q.surface_mesh(spark, at)
    got = mesh.geodesic(v, mesh.edges(f), v.where("vid = 0"), most=30.0, block=300).collect()  # paths run in and out of blocks
    assert {r.vid: r.dist for r in got} == pytest.approx({v: x for v, x in want.items() if x <= 30}, abs=2e-6)


@pytest.fixture(scope="module")
def clouds(spark, tmp_path_factory):
    """900 points of two clouds over their whole range, ids as in the queries, and distances from A to N."""
    at, rng = tmp_path_factory.mktemp("points"), np.random.default_rng(5)
    rows = [("AN"[int(c)], float(n), float(p), int(k) / 100) for c, n, p, k in zip(rng.integers(0, 2, 900), rng.integers(1, 51, 900), rng.integers(900, 20_000, 900), rng.integers(0, 11, 900))]
    spark.createDataFrame(rows, "l_returnflag string, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k, k % 5) for k in range(25)], "n_nationkey long, n_regionkey long").write.parquet(f"{at}/nation.parquet")
    p = sorted({(n * 0.02, x * 1e-5, k * 10.0, c) for c, n, x, k in rows})
    number = {x: i + 1 for i, x in enumerate(sorted({x[:3] for x in p}))}
    a, b = (np.array([x[:3] for x in p if x[3] == c]) for c in "AN")
    return str(at), [number[tuple(x)] for x in a], a, b


def test_cloud_queries_take_all_points(spark, clouds):
    at, ids, a, b = clouds
    run = lambda name: q.queries()[name](spark, at).collect()
    d2 = ((a[:, None] - b[None]) ** 2).sum(2)
    near = d2 <= 0.0401**2
    assert {r.a_id: r.n for r in run("range_pairs")} == {i: int(n) for i, n in zip(ids, near.sum(1)) if n}
    assert a[near.any(1)][:, 2].max() > 0.5  # none of the corner that was taken
    hit = (d2 <= 0.0101**2).any(1)
    assert {r.id for r in run("semi_within")} == {i for i, h in zip(ids, hit) if h}
    assert {r.id for r in run("anti_within")} == {i for i, h in zip(ids, hit) if not h}
    (row,) = run("overlap_ratio")
    assert row.n == len(a) and row.ratio == pytest.approx((d2 < 0.0101**2).any(1).mean(), abs=1e-6)
    own = ((a[:, None] - a[None]) ** 2).sum(2) <= 0.15**2
    assert {r.id: r.n for r in run("plane_normals")} == {i: int(n) for i, n in zip(ids, own.sum(1))}


def test_tdf_metric_takes_all_points(spark, clouds):
    at, _, a, b = clouds
    axis = np.arange(-2, 14)
    grid = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1).reshape(-1, 3)
    want = {}
    for cloud, p in (("A", a), ("N", b)):
        d = np.sqrt(((grid[:, None] * 0.1 - p[None]) ** 2).sum(2).min(1))
        want |= {(cloud, *map(int, g)): 1 - x / 0.09 for g, x in zip(grid, d) if x < 0.09 - 1e-9}
    got = {(r.grid, r.ix, r.iy, r.iz): r.value for r in q.queries()["tdf_metric"](spark, at).collect()}
    assert {k: v for k, v in got.items() if v > 1e-6} == pytest.approx({k: v for k, v in want.items() if v > 1e-6}, abs=2e-6)


def test_rigid_fits_take_all_points(spark, clouds):
    at, _, a, b = clouds
    assert q.moved_matches(spark, at).count() == len(a) + len(b)
    for name, digits in (("rigid_fit", 6), ("ransac_rigid", 5)):
        got = {r.cloud: (r.m00, r.ty) for r in q.queries()[name](spark, at).collect()}
        assert got == {"A": pytest.approx((np.cos(0.3), 0.15), abs=2 * 10**-digits), "N": pytest.approx((np.cos(0.7), 0.35), abs=2 * 10**-digits)}
