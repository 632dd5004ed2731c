"""Closed-form scenes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusionframe.functions import geom
from fusionframe.operators import evaluate, fusion, knn, mesh, mining, nn, registration, voxel
from fusionframe.streaming.fusion import fuse_stream

EYE = [float(i == j) for i in range(4) for j in range(4)]
K = (100.0, 100.0, 5.0, 5.0)


def moved(p, a=0.7, t=(0.1, -0.2, 0.3)):
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    return p @ r.T + np.array(t), r


def matches(spark, n=60, off=0):
    rng = np.random.default_rng(1)
    q = rng.uniform(-1, 1, (n, 3))
    p, r = moved(q)
    p[:off] += rng.uniform(1, 2, (off, 3))
    return spark.createDataFrame([("s", *map(float, a), *map(float, b)) for a, b in zip(p, q)], "k string, px double, py double, pz double, qx double, qy double, qz double"), r


def test_rigid_fit_recovers_motion(spark):
    m, r = matches(spark)
    row = registration.rigid_fit(m, "k").first()
    assert np.allclose(np.reshape(row.trans, (4, 4))[:3, :3], r, atol=1e-9) and row.rmsd < 1e-6


def test_ransac_keeps_inliers(spark):
    m, r = matches(spark, off=18)
    row = registration.ransac(m, "k").first()
    assert row.inliers == 42 and np.allclose(np.reshape(row.trans, (4, 4))[:3, :3], r, atol=1e-9)


@pytest.mark.parametrize("n,inliers", [(3, 3), (2, 0), (1, 0)])
def test_ransac_of_few(spark, n, inliers):
    m, _ = matches(spark, n)
    row = registration.ransac(m, "k").first()
    assert row.inliers == inliers and (inliers or row.trans == EYE)


def test_plane_frames_need_two_views(spark):
    pixels = [(f, x, y, 2.0) for f in (0, 1) for x in range(10) for y in range(10)]
    depth = spark.createDataFrame(pixels, "frame int, px int, py int, d double")
    poses = spark.createDataFrame([(0, EYE), (1, EYE)], "frame int, pose array<double>")
    vox = spark.createDataFrame([(i, 0.0, 0.0, 1.8 + 0.05 * i) for i in range(9)], "vox int, x double, y double, z double")
    out = {r.vox: r for r in fusion.fuse_dense(vox, depth, poses, K, 0.25, 10, 10).collect()}
    assert out[2].tsdf > 0 > out[6].tsdf and all(r.weight == 2 for r in out.values())
    one = fusion.fuse_dense(vox, depth.where("frame = 0"), poses, K, 0.25, 10, 10)
    assert fusion.surface(one).count() == 0
    assert [r.vox for r in fusion.surface(fusion.fuse_dense(vox, depth, poses, K, 0.25, 10, 10), 0.15).collect()] == [4]
    band = fusion.fuse_band(depth, poses, K, 0.05, 0.25)
    assert {round(r.tsdf, 6) for r in band.where("iz = 40").collect()} == {0.0}


def test_one_voxel_field(spark):
    v = spark.createDataFrame([("g", 0, 0, 0)], "grid string, ix long, iy long, iz long")
    out = {(r.ix, r.iy, r.iz): r.value for r in voxel.tdf_index(v, 5).collect()}
    assert out[0, 0, 0] == 1 and abs(out[3, 4, 0] - 0) < 1e-9 if (3, 4, 0) in out else True
    assert abs(out[1, 0, 0] - 0.8) < 1e-9 and (5, 0, 0) not in out


def test_ties_go_to_the_smallest_id(spark):
    q = spark.createDataFrame([(0, [0.0, 0.0])], "q long, v array<double>")
    t = spark.createDataFrame([(7, [1.0, 0.0]), (3, [0.0, 1.0]), (9, [5.0, 5.0])], "t long, v array<double>")
    assert knn.knn_join(q, t).first().t == 3
    assert [r.t for r in knn.knn_join(q, t, 3).orderBy("rank").collect()] == [3, 7, 9]
    assert knn.knn_join(q, t, block=1).first().t == 3


def test_mutual_correlation_ignores_scale(spark):
    a = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [3.0, 1.0, 2.0])], "q long, v array<double>").withColumn("t", F.col("q"))
    b = spark.createDataFrame([(5, [30.0, 10.0, 20.0]), (6, [10.0, 20.0, 30.0])], "q long, v array<double>").withColumn("t", F.col("q"))
    out = {(r.a, r.b): r.ncc for r in knn.mutual_max_correlation(a, b).collect()}
    assert set(out) == {(0, 6), (1, 5)} and all(abs(x - 1) < 1e-6 for x in out.values())


def test_registration_ignores_neighbours(spark):
    s = "scene string, i int, j int, trans array<double>"
    gt = spark.createDataFrame([("a", 0, 1, EYE), ("a", 0, 2, EYE)], s)
    info = gt.select("scene", "i", "j", F.array(*[F.lit(float(i == j)) for i in range(6) for j in range(6)]).alias("info"))
    row = registration.registration_pr(gt, info, gt).first()
    assert (row.n_gt, row.n_result, row.good) == (1, 1, 1)


def test_singular_pose_has_no_inverse(spark):
    df = spark.createDataFrame([([0.0] * 16,), (EYE,)], "m array<double>").select(geom.affine_inverse(F.col("m")).alias("i"))
    assert [r.i is None for r in df.collect()] == [True, False]


def test_perfect_threshold(spark):
    d = spark.createDataFrame([(0.1, 1)] * 50 + [(0.9, 0)] * 50, "d double, is_match int")
    sweep = evaluate.confusion_sweep(d, 1.0)
    at = {r.k: r for r in sweep.collect()}
    assert (at[100].tp, at[101].tp, at[900].fp, at[901].fp) == (0, 50, 0, 50)
    assert evaluate.fpr_at_recall(sweep).first().fpr is None


def test_components_and_distances(spark):
    cells = [("g", x, 0, 0, 1.0) for x in range(6)] + [("g", 9, 0, 0, 1.0), ("g", 0, 1, 1, 1.0)]
    v = spark.createDataFrame(cells, "grid string, ix long, iy long, iz long, value double")
    labels = {tuple(r.label) for r in voxel.components(v, 0.5).collect()}
    assert labels == {(0, 0, 0), (9, 0, 0), (0, 1, 1)}
    one = v.where("ix = 9")
    out = {(r.ix, r.iy, r.iz): r.value for r in voxel.squared_distance(one, (10, 3, 3)).collect()}
    assert out[0, 0, 0] == 81 and out[9, 2, 2] == 8
    assert voxel.dilate(one, 1.0, (10, 3, 3)).count() == 4


def test_geodesic_and_merge(spark):
    v = spark.createDataFrame([("m", i, float(i), 0.0, 0.0) for i in range(4)] + [("m", 9, 3.0, 0.0, 0.001)], "mesh string, vid long, x double, y double, z double")
    e = spark.createDataFrame([("m", i, i + 1) for i in range(3)], "mesh string, a long, b long")
    out = {r.vid: r.dist for r in mesh.geodesic(v, e, v.where("vid = 0").select("mesh", "vid")).collect()}
    assert out == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0}
    f = spark.createDataFrame([("m", 0, 0, 1, 9), ("m", 1, 3, 9, 1)], "mesh string, fid long, v0 long, v1 long, v2 long")
    kept, faces = mesh.merge_coincident(v, f, 0.1)
    assert kept.count() == 4 and [(r.v0, r.v1, r.v2) for r in faces.collect()] == [(0, 1, 3)]


def test_network(spark):
    x = np.arange(27.0).reshape(1, 1, 3, 3, 3)
    w = np.zeros((1, 1, 2, 2, 2))
    w[0, 0, 0, 0, 1] = 1
    assert np.allclose(nn.conv3d(x, w, np.array([0.5]))[0, 0], x[0, 0, :2, :2, 1:] + 0.5)
    assert nn.max_pool(x, 2, 2).shape == (1, 1, 2, 2, 2) and nn.max_pool(x, 2, 2).max() == 26
    patches = spark.createDataFrame([(i, [float(i)] * 27) for i in range(53)], "kp long, patch array<float>")
    out = nn.describe(patches, [("conv", w, np.array([0.0])), ("relu",), ("dense", np.ones((2, 8)), np.zeros(2))], 3)
    got = {r.kp: r.desc for r in out.collect()}
    assert len(got) == 53 and got[5] == [40.0, 40.0]


@pytest.mark.parametrize("kind", ["sgd", "nag", "adagrad", "rmsprop", "adadelta", "adam"])
def test_solvers_descend(spark, kind):
    w = spark.createDataFrame([("a", 2.0, 0.0, 0.0, 0.0)], "name string, w double, g double, h double, h2 double")
    row = nn.solver_step(w.withColumn("g", F.col("w")), kind, 0.1).first()
    assert row.w < 2.0


def test_matches_agree_in_depth(spark):
    depth = spark.createDataFrame([(0, f, x, 5, 2.0) for f in (0, 1) for x in range(60)], "scene int, frame int, px int, py int, d double")
    far = EYE.copy()
    far[3] = 1.0
    poses = spark.createDataFrame([(0, 0, EYE), (0, 1, far)], "scene int, frame int, pose array<double>")
    anchors = depth.where("frame = 0").withColumn("p1", F.col("px").cast("long"))
    out = mining.mine_matches(anchors, depth, poses, K).collect()
    assert {(r.p1, r.px) for r in out} == {(x, x - 50) for x in range(50, 60)}
    assert mining.mine_triplets(anchors, depth, poses, K).count() == 10


def test_triplets_of_crowded_scenes(spark):
    """Where nearly all pixels are within `far` of each other, anchors still get the few that are not; those without any get none."""
    k = (585.0, 585.0, 320.0, 240.0)
    rows = [(s, f, x % 40, 5 + x // 40, 2.0) for s in (0, 1) for f in (0, 1) for x in range(1200)] + [(0, 0, 639, 470, 2.0)]
    depth = spark.createDataFrame(rows, "scene int, frame int, px int, py int, d double")
    poses = spark.createDataFrame([(s, f, EYE) for s in (0, 1) for f in (0, 1)], "scene int, frame int, pose array<double>")
    anchors = depth.where("frame = 0 AND px < 40").selectExpr("*", "scene * 10000L + px * 100 + py AS p1")
    at = {r[:4]: np.array([(r[2] - k[2]) * r[4] / k[0], (r[3] - k[3]) * r[4] / k[1], r[4]]) for r in rows}
    points = {s: np.array([p for key, p in at.items() if key[0] == s]) for s in (0, 1)}
    for far in (0.2, 0.12):
        want = {s * 10000 + x * 100 + y for (s, f, x, y), w in at.items() if f == 0 and x < 40 and (((points[s] - w) ** 2).sum(1) > far * far).any()}
        got = mining.mine_triplets(anchors, depth, poses, k, far=far, baseline=0.0).collect()
        assert len(got) == len(want) and {r.p1 for r in got} == want
        for r in got:
            s, frame, x, y = r.p1 // 10000, 0, r.p1 % 10000 // 100, r.p1 % 100
            assert ((at[s, r.n_frame, r.n_px, r.n_py] - at[s, frame, x, y]) ** 2).sum() > far * far


def test_streaming_fusion(spark, tmp_path):
    pixels = spark.createDataFrame([(0, x, 5, 2.0) for x in range(10)], "frame int, px int, py int, d double")
    pixels.write.parquet(str(tmp_path / "in"))
    poses = spark.createDataFrame([(0, EYE)], "frame int, pose array<double>")
    stream = spark.readStream.schema(pixels.schema).parquet(str(tmp_path / "in"))
    q = fuse_stream(stream, poses, K, 0.05, 0.1).writeStream.format("memory").queryName("fused").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.ix, r.iy, r.iz): r.weight for r in spark.table("fused").collect()}
    want = {(r.ix, r.iy, r.iz): r.weight for r in fuse_stream(pixels, poses, K, 0.05, 0.1).collect()}
    assert got == want and got


def test_unique_asof_uses_each_once(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "u long, t int, e long").withColumn("ts", F.timestamp_seconds("t"))
    b = spark.createDataFrame([(1, 11, 7), (1, 30, 8)], "u long, t int, e long").withColumn("ts", F.timestamp_seconds("t"))
    plain = {r.e: r.match for r in knn.asof_nearest(a, b, "u", "ts", "e").collect()}
    once = {r.e: r.match for r in knn.asof_nearest(a, b, "u", "ts", "e", unique=True).collect()}
    assert plain == {1: 7, 2: 7} and once == {1: 7, 2: 8}


def test_normals_and_planes(spark):
    from fusionframe.operators import surface

    p = [("s", i * 10 + j, i * 0.1, j * 0.1, 0.2 * i * 0.1) for i in range(10) for j in range(10)]
    df = spark.createDataFrame(p, "k string, id long, x double, y double, z double")
    want = np.array([-0.2, 0, 1]) / np.linalg.norm([-0.2, 0, 1])
    for r in surface.normals(df, 0.25).collect():
        assert np.allclose([r.nx, r.ny, r.nz], want, atol=1e-6)
    off = df.union(spark.createDataFrame([("s", 1000 + i, 0.45, 0.2 + 0.25 * i, 1.2) for i in range(3)], df.schema))
    row = surface.refine_plane(off, "k", 0.3).first()
    assert row.n == 100 and np.allclose([row.nx, row.ny, row.nz], want, atol=1e-6)


def test_half_turns_have_quaternions(spark):
    turns = {"x": np.diag([1, -1, -1]), "y": np.diag([-1, 1, -1]), "z": np.diag([-1, -1, 1]), "none": np.eye(3)}
    a = 0.7
    turns["z40"] = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    rows = [(k, [float(x) for x in np.block([[r, np.zeros((3, 1))], [np.zeros((1, 3)), np.ones((1, 1))]]).ravel()]) for k, r in turns.items()]
    w, x, y, z = geom.matrix_to_quaternion(F.col("pose"))
    got = {r.k: (r.w, r.x, r.y, r.z) for r in spark.createDataFrame(rows, "k string, pose array<double>").select("k", w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z")).collect()}
    assert got["x"] == (0, 1, 0, 0) and got["y"] == (0, 0, 1, 0) and got["z"] == (0, 0, 0, 1) and got["none"] == (1, 0, 0, 0)
    assert got["z40"] == pytest.approx((math.cos(a / 2), 0, 0, math.sin(a / 2)))


def test_nothing_to_divide_by(spark):
    v = spark.createDataFrame([("m", k, 0.0, 0.0, 0.0) for k in range(3)], "mesh string, vid long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 1, 2)], "mesh string, fid long, v0 long, v1 long, v2 long")
    assert mesh.mesh_stats(v, f).first().area == 0 and {r.curvature for r in mesh.gauss_curvature(v, f).collect()} == {None}
    s = spark.createDataFrame([(1, 0.0, 0.0)], "k int, p0 double, r0 double")
    assert evaluate.segmentation_fscore(s, "k", "p0", "r0").first().f is None
    d = spark.createDataFrame([(1, 1, [1.0, 1.0]), (2, 2, [1.0, 3.0])], "q long, t long, v array<double>")
    other = d.select((F.col("q") + 2).alias("q"), (F.col("t") + 2).alias("t"), "v")
    assert [(r.a, r.b) for r in knn.mutual_max_correlation(d, other).collect()] == [(2, 4)]


def test_grid_filters_by_hand(spark):
    """One voxel of 6 in the middle of a 5-cube: what each derivative, filter and border cell has to be."""
    one = spark.createDataFrame([("g", 2, 2, 2, 6.0)], "grid string, ix long, iy long, iz long, value double")
    dims = (5, 5, 5)
    at = lambda df: {(r.ix, r.iy, r.iz): r.value for r in df.collect()}
    gx, gz = at(voxel.gradient(one, 0, dims)), at(voxel.gradient(one, 2, dims))
    assert gx[1, 2, 2] == gx[1, 1, 2] == pytest.approx(1.0) and gx[3, 3, 3] == pytest.approx(-0.5) and gx[1, 2, 1] == pytest.approx(0.5)
    assert gz[2, 1, 1] == pytest.approx(1.0) and gz[1, 1, 1] == pytest.approx(0.5)
    assert sum(w for o, w in voxel.gradient_kernel(1).items() if w > 0) == pytest.approx(1.0)
    corner = spark.createDataFrame([("g", 0, 0, 0, 26.0)], "grid string, ix long, iy long, iz long, value double")
    assert at(voxel.convolve(corner, voxel.LAPLACE, dims)) == {(1, 1, 1): pytest.approx(-1.0)}
    assert at(voxel.window_filter(one, 1, "max", dims))[1, 2, 2] == 6 and not at(voxel.window_filter(one, 1, "median", dims))
    low = spark.createDataFrame([("g", 0, 0, 0, -3.0)], "grid string, ix long, iy long, iz long, value double")
    assert at(voxel.window_filter(low, 1, "min", dims))[1, 0, 0] == -3 and not at(voxel.window_filter(low, 1, "max", dims))
    assert at(voxel.detect_edges(corner, dims)) == {(1, 1, 1): pytest.approx(1.0)}


def test_distances_go_along_the_ray(spark):
    """A voxel off the axis, 0.1 behind a depth of 1 along z, is further away along its ray."""
    vox = spark.createDataFrame([(1, 0.45, 0.0, 0.9)], "vox long, x double, y double, z double")
    depth = spark.createDataFrame([(0, 55, 5, 1.0)], "frame int, px int, py int, d double")
    poses = spark.createDataFrame([(0, EYE)], "frame int, pose array<double>")
    got = fusion.fuse_dense(vox, depth, poses, K, 0.5, 100, 100).first()
    assert got.tsdf == pytest.approx(0.1 * math.sqrt(1.25) / 0.5)
