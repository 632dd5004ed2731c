"""Round trips of the file formats."""

import numpy as np
from fusionframe.sources import formats as f


def put(path, data):
    with open(path, "wb") as h:
        h.write(data)
    return str(path)


def test_points(spark, tmp_path):
    p = np.arange(12, dtype=float).reshape(4, 3)
    put(tmp_path / "a.ply", f.ply_bytes(p))
    put(tmp_path / "k.bin", f.keypoint_bytes(p))
    for df in (f.scan_ply(spark, str(tmp_path)), f.scan_keypoints(spark, str(tmp_path / "k.bin"))):
        assert [(r.x, r.y, r.z) for r in df.orderBy("idx").collect()] == [tuple(x) for x in p]


def test_ascii_ply():
    out = f.parse_ply(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement face 0\nend_header\n1 2 3\n4 5 6\n")
    assert out["z"].tolist() == [3.0, 6.0]


def test_descriptors_grids_tensors(spark, tmp_path):
    d = np.arange(6, dtype=np.float32).reshape(3, 2)
    got = f.scan_descriptors(spark, put(tmp_path / "d.bin", f.descriptor_bytes(d))).orderBy("idx").collect()
    assert [r.desc for r in got] == d.tolist()
    g = np.zeros((2, 3, 4))
    g[1, 2, 3] = 0.5
    row = f.scan_tdf(spark, put(tmp_path / "t.bin", f.tdf_bytes(g, (1, 2, 3), np.eye(4))), True).first()
    assert (row.ix, row.iy, row.iz, row.value, row.origin) == (3, 2, 1, 0.5, [1.0, 2.0, 3.0]) and row.pose[0] == 1
    t = f.tensor_bytes("w", d, 1) + f.tensor_bytes("b", np.array([1.0, 2.0]), 2)
    rows = f.scan_tensors(spark, put(tmp_path / "w.bin", t)).collect()
    assert [(r.name, r.shape) for r in rows] == [("w", [3, 2]), ("b", [2])] and rows[1].data == [1.0, 2.0]
    raw = f.scan_raw_grid(spark, put(tmp_path / "r.raw", g.astype("<f4").tobytes()), f.parse_size("Float32(4,3,2,1)")).first()
    assert (raw.ix, raw.iy, raw.iz) == (3, 2, 1)
    v = f.scan_volumes(spark, put(tmp_path / "v.bin", np.array([2, 1, 1, 2, 5, 6, 7, 8], "<f4").tobytes())).orderBy("idx").collect()
    assert [r.patch for r in v] == [[5.0, 6.0], [7.0, 8.0]]


def test_depth(spark, tmp_path):
    put(tmp_path / "f.png", f.png16_bytes(np.array([[1000, 7000], [0, 1500]], np.uint16)))
    rows = {(r.px, r.py): r.d for r in f.scan_depth(spark, str(tmp_path)).collect()}
    assert rows == {(0, 0): 1.0, (1, 0): 0.0, (0, 1): 0.0, (1, 1): 1.5}


def test_off(spark, tmp_path):
    put(tmp_path / "m.off", b"OFF\n4 1 0\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n")
    v, faces = f.scan_off(spark, str(tmp_path))
    assert v.count() == 4 and [(r.v0, r.v1, r.v2) for r in faces.orderBy("fid").collect()] == [(0, 1, 2), (0, 2, 3)]


def test_text(spark, tmp_path):
    put(tmp_path / "l.txt", b"3\n1\n0\n1\n")
    assert [r.value for r in f.scan_labels(spark, str(tmp_path / "l.txt")).orderBy("idx").collect()] == [1.0, 0.0, 1.0]
    put(tmp_path / "m.txt", b"585 0 320\n0 585 240\n0 0 1\n")
    assert f.scan_matrix(spark, str(tmp_path / "m.txt")).first().m[2] == 320.0
    put(tmp_path / "k.tsv", b"# c\n1\ta\t5\t6\n")
    assert f.scan_keypoint_list(spark, str(tmp_path / "k.tsv")).first().y == 6
    eye = [float(i == j) for i in range(4) for j in range(4)]
    log = spark.createDataFrame([("s", 0, 2, 9, eye)], "scene string, i int, j int, n int, trans array<double>")
    f.write_text_log(log, str(tmp_path / "log"))
    row = f.scan_log(spark, str(tmp_path / "log")).first()
    assert (row.i, row.j, row.n, row.trans) == (0, 2, 9, eye)


def test_fragment_and_registration_text(spark, tmp_path):
    pose = [float(k) / 3 for k in range(16)]
    own = spark.createDataFrame([("lab", "seq-01", 0, 49, pose), ("lab", "seq-01", 50, 99, pose[::-1])], "scene string, seq string, first int, last int, pose array<double>")
    f.fragment_lines(own).select("scene", "first", "value").withColumnRenamed("scene", "s").write.partitionBy("s", "first").text(str(tmp_path / "info"))
    got = f.scan_fragment_info(spark, str(tmp_path / "info/*/*")).collect()
    assert sorted((r.scene, r.seq, r.first, r.last) for r in got) == [("lab", "seq-01", 0, 49), ("lab", "seq-01", 50, 99)]
    assert all(abs(a - b) < 1e-7 for r in got for a, b in zip(r.pose, pose if r.first == 0 else pose[::-1]))
    p = spark.createDataFrame([("cloud_bin_0", "cloud_bin_1", 12, 0.5, 0.25, 0.75, pose)], "fragment1 string, fragment2 string, inliers int, ratio double, overlap1 double, overlap2 double, trans array<double>")
    f.registration_lines(p).select("value").write.text(str(tmp_path / "rt"))
    r = f.scan_registration(spark, str(tmp_path / "rt")).first()
    assert (r.fragment1, r.fragment2, r.inliers, r.ratio, r.overlap1, r.overlap2) == ("cloud_bin_0", "cloud_bin_1", 12, 0.5, 0.25, 0.75) and len(r.trans) == 16
    (tmp_path / "short.txt").write_text("lab seq\n")
    short = f.scan_fragment_info(spark, str(tmp_path / "short.txt")).first()
    assert (short.scene, short.seq, short.first, short.pose) == ("lab", "seq", None, None)


def test_distances_in_order(spark, tmp_path):
    d = spark.createDataFrame([(k, k * 0.5) for k in range(30)], "k long, distance double").repartition(5)
    f.write_distances(d, str(tmp_path / "d"), "k")
    lines = [x for part in sorted((tmp_path / "d").glob("part-*")) for x in part.read_text().split()]
    assert lines[0] == "30" and [float(x) for x in lines[1:]] == [k * 0.5 for k in range(30)]
