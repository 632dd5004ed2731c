"""Operators whose work is not to grow with the square of a table: results over many blocks against brute force."""

import numpy as np
from pyspark.sql import functions as F

from fusionframe import queries
from fusionframe.operators import evaluate, knn, report


def test_nearest_instance_over_blocks(spark):
    """Two labels over many blocks, equal places, and instances without a place, which are near nothing."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 12, (500, 3)) / 10, rng.integers(0, 12, (300, 3)) / 10
    p = [(i, "s", f"o{i % 2}", *map(float, x)) for i, x in enumerate(a)]
    t = [(i, "a/s", f"o{i % 2}", *map(float, x)) for i, x in enumerate(b)]
    cols = "scene string, object string, x double, y double, z double"
    pred, truth = spark.createDataFrame(p, f"pred long, {cols}"), spark.createDataFrame([*t, (-2, "a/s", "o0", None, 0.0, 0.0), (-1, "a/s", "o1", float("nan"), 0.0, 0.0)], f"inst long, {cols}")
    d = a[:, None] - b[None]
    d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    d2[np.arange(500)[:, None] % 2 != np.arange(300) % 2] = np.inf
    want = {i: (int(x), float(np.sqrt(d2[i, x]))) for i, x in enumerate(d2.argmin(1))}
    assert {r.pred: (r.inst, r.distance) for r in report.nearest_instance(pred, truth).collect()} == want
    q = pred.select("pred", "object", *"xyz"), truth.where("inst >= 0").select("inst", "object", *"xyz")
    got = knn.nearest_points(*q, "object", "pred", "inst", q_block=32, t_block=8)
    assert {r.q: (r.t, float(np.sqrt(r.d2))) for r in got.collect()} == want


def test_geodesic_climbs_levels(spark, monkeypatch):
    """A long strip in many blocks, solved without rounds between them; the same where ids say nothing of place."""
    from fusionframe.operators import geodesics, mesh

    rng, n = np.random.default_rng(6), 300
    xyz = [(k % 3, k // 3, float(rng.integers(1, 9)) / 4) for k in range(n)]
    pairs = [(k, k + o) for k in range(n) for o in (1, 3) if k + o < n and (o == 3 or k % 3 < 2)]
    w = {(a, b): float(np.sqrt(sum((p - q) ** 2 for p, q in zip(xyz[a], xyz[b], strict=True)))) for a, b in pairs}
    low, fell = {0: 0.0, 170: 0.0}, True
    while fell:
        fell = False
        for (a, b), x in w.items():
            for p, q in ((a, b), (b, a)):
                if p in low and low[p] + x < low.get(q, np.inf) - 1e-12:
                    low[q], fell = low[p] + x, True
    rounds = []
    by_rounds = mesh._by_rounds
    monkeypatch.setattr(mesh, "_by_rounds", lambda *a: rounds.append(1) or by_rounds(*a))
    for name in (np.arange(n), rng.permutation(n)):
        vs = spark.createDataFrame([("m", int(name[k]), *map(float, p)) for k, p in enumerate(xyz)], "mesh string, vid long, x double, y double, z double")
        es = spark.createDataFrame([("m", *sorted((int(name[a]), int(name[b])))) for a, b in pairs], "mesh string, a long, b long")
        dist = mesh.geodesic(vs, es, vs.where(f"vid IN ({name[0]}, {name[170]})"), block=60 if name[1] == 1 else 100)
        got = {r.vid: r.dist for r in dist.collect()}
        assert got.keys() == {int(name[k]) for k in low} and all(abs(got[int(name[k])] - x) < 1e-9 for k, x in low.items())
        assert bool(rounds) == (name[1] != 1)
    rows = geodesics.trace_paths(geodesics.predecessors(dist, vs, es), dist)
    assert len(rows._jdf.queryExecution().logical().toString()) < 200_000  # the plan doesn't double with each step
    paths = {}
    for r in rows.collect():
        paths.setdefault(r.target, {})[r.hop] = r.vid, r.gone
    assert len(paths) == n
    for v, p in paths.items():
        assert sorted(p) == list(range(len(p))) and p[0] == (v, 0.0) and abs(p[len(p) - 1][1] - got[v]) < 1e-9 and p[len(p) - 1][0] in (name[0], name[170])


def test_paths_share_pieces(spark, monkeypatch):
    """Paths of a long strip, and of one that ends apart: each hop in order. The tables before the rows have some third root of the longest path an entry a vertex, and what Spark reckons of their sizes stays a small number."""
    from fusionframe.operators import geodesics

    kept = []
    checkpointed = geodesics.checkpointed
    monkeypatch.setattr(geodesics, "checkpointed", lambda *a, **more: kept.append(checkpointed(*a, **more)) or kept[-1])
    n = 600
    up = {k: k - 2 if k > 1 else None for k in range(n)} | {1000: None, 1001: 1000}
    pred = spark.createDataFrame([("m", k, u, None if u is None else 0.5 + k % 3) for k, u in up.items()], "mesh string, vid long, up long, w double")
    targets = spark.createDataFrame([("m", k) for k in (*range(0, n, 7), n - 1, 1001, 2000)], "mesh string, vid long")
    got = {}
    for r in geodesics.trace_paths(pred, targets).collect():
        assert got.setdefault(r.target, {}).setdefault(r.hop, (r.vid, r.gone)) == (r.vid, r.gone)
    assert len(got) == len(set(range(0, n, 7)) | {n - 1, 1001, 2000})
    for v, path in got.items():
        gone = 0.0
        for hop in range(len(path)):
            assert path[hop][0] == v and abs(path[hop][1] - gone) < 1e-9
            gone, v = gone + 0.5 + v % 3, up.get(v)
        assert v is None
    entries = [t.selectExpr("sum(size(path))").first()[0] or 0 for t in kept if "path" in t.columns]
    assert entries and max(entries) < 8 * n
    assert all(len(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 40 for t in kept)


def test_descriptor_blocks_are_few(spark, monkeypatch):
    """Copies of a row grow with the blocks, which stay as many while the rows grow; and the best of many blocks are those of all pairs, with copies and ranges."""
    assert {knn._count_blocks(spark.range(n), None) for n in (60_000, 120_000, 700_000)} == {knn.PARTS}
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(0, 1, (400, 6)), 1)
    v[50:150] = v[50]
    df = spark.createDataFrame([(i, i, x.tolist()) for i, x in enumerate(v)], "q long, t long, v array<double>")
    d2 = np.round(((v[:, None] - v[None]) ** 2).sum(2), 9)
    for k, far, low, high in ((1, False, 0.0, np.inf), (5, False, 0.0, np.inf), (3, True, 0.0, np.inf), (2, False, 0.5, 4.0), (2, True, 0.5, 4.0)):
        want = set()
        for i in range(400):
            ok = np.flatnonzero((d2[i] >= low) & (d2[i] <= high))
            best = ok[np.lexsort((ok, -d2[i, ok] if far else d2[i, ok]))[:k]]
            want |= {(i, int(t), float(d2[i, t]), n + 1) for n, t in enumerate(best)}
        got = knn.knn_join(df, df, k, furthest=far, min_d2=low, max_d2=high, block=None if k == 5 else 150)
        assert {tuple(r) for r in got.collect()} == want


def test_near_sums_make_no_pairs(spark):
    """Points on lines and points that lie anyhow: counts and sums of a ball against brute force, with distances that equal the radius."""
    rng = np.random.default_rng(9)
    for lines in (True, False):
        p = np.stack([rng.integers(0, 4, 400) * 0.02, rng.integers(0, 90, 400) / 100, rng.integers(0, 3, 400) * 0.1], 1) if lines else rng.random((400, 3))
        df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
        r = 0.15 if lines else 0.3
        d = p[:, None] - p[None]
        near = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] <= r * r
        out = knn.near_sums(df, df, r)
        got = {x.id: x for x in out.collect()}
        assert {i: x.n for i, x in got.items()} == dict(enumerate(near.sum(1).tolist()))
        for a, b in ("xx", "xy", "yz", "zz"):
            want = (near * d[..., "xyz".index(a)] * d[..., "xyz".index(b)]).sum(1)
            assert all(abs(got[i][f"s{a}{b}"] - x) < 1e-9 for i, x in enumerate(want))
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_near_sums_copies_travel_packed(spark, monkeypatch):
    """Dense lines: a row is many points of a cell, a point goes to few cells and takes few bytes, and balls over many packed rows and parts have the sums of brute force; points without a place are near nothing."""
    import pyarrow as pa

    rng = np.random.default_rng(15)
    p = np.stack([rng.integers(1, 51, 20_000) * 0.02, rng.random(20_000), rng.integers(0, 11, 20_000) * 0.1], 1)
    p = p[np.lexsort((p[:, 2], p[:, 1], p[:, 0]))]
    rows = [r for b in knn._spread(0.15, 0.3)([pa.record_batch([pa.array(c) for c in p.T], names=list("xyz"))]) for r in b["points"].to_pylist()]
    n = sum(len(c[0]) for r in rows for c in knn._unpack_lines([r], 10**9))
    assert len(rows) < 150 and n < 8.1 * len(p)
    assert sum(len(pa.compress(r, "lz4", asbytes=True)) for r in rows) < 8 * n
    got = np.concatenate([np.stack(c, 1) for c in knn._unpack_lines(rows, 1000)])
    assert {tuple(x) for x in got.tolist()} == {tuple(x) for x in p.tolist()}

    monkeypatch.setattr(knn, "GATHERED", 100)
    monkeypatch.setattr(knn, "AT_ONCE", 50)
    p = p[::10]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)] + [(-1, None, 0.5, 0.5), (-2, float("nan"), 0.5, 0.5)], "id long, x double, y double, z double")
    d = p[:, None] - p[None]
    near = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] <= 0.15 * 0.15
    out = knn.near_sums(df.repartition(3), df.repartition(5), 0.15)
    got = {x.id: x for x in out.collect()}
    assert {i: x.n for i, x in got.items()} == dict(enumerate(near.sum(1).tolist()))
    assert all(abs(got[i].syz - x) < 1e-9 for i, x in enumerate((near * d[..., 1] * d[..., 2]).sum(1)))
    assert "points#" in out._jdf.queryExecution().executedPlan().toString()  # packed points are shuffled


def test_numbers_leave_no_shuffle(spark):
    """Dense numbers come from the sort itself: reading them shuffles nothing."""
    from fusionframe.plans.numbering import dense_ids

    df = spark.createDataFrame([(float(x), k) for k, x in enumerate(np.random.default_rng(1).permutation(999))], "x double, k long")
    out = dense_ids(df.repartition(7), ["x"])
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and plan.count("Window") == 1
    assert [r.id for r in out.orderBy("x").collect()] == list(range(1, 1000))


def test_consensus_deals_groups_over_tasks(spark, monkeypatch):
    """A group over many spans of matches has the fit of the whole."""
    from fusionframe.operators import consensus

    monkeypatch.setattr(consensus, "SPAN", 1024)
    rng = np.random.default_rng(10)
    p = rng.random((2500, 2))
    q = p + 0.5 + (np.arange(2500) % 5 == 0)[:, None] * rng.random((2500, 2))
    df = spark.createDataFrame([("g", i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, q, strict=True))], "g string, k long, px double, py double, qx double, qy double")
    row = consensus.consensus(df, "g", "k", consensus.HOMOGRAPHY, 1e-8).first()
    h = np.array(row.params).reshape(3, 3) / row.params[8]
    assert row.inliers == 2000 and row.n == 2500 and np.allclose(h, [[1, 0, 0.5], [0, 1, 0.5], [0, 0, 1]], atol=1e-6)
    assert consensus._dealt(spark.createDataFrame([("g", 1)], "g string, x int"), spark.createDataFrame([("g", 1, 2500)], "g string, base long, n long"), "g").count() == 3


def test_ransac_deals_a_group_over_tasks(spark):
    """No task holds a group: large ones lie in blocks over many tasks, also where their matches are copies; the fit is that of the whole for any partitions, and a group without a name stays."""
    from fusionframe.operators import consensus, registration

    rng = np.random.default_rng(11)
    q = rng.random((4000, 3)) + 100
    r = np.array([[0.6, -0.8, 0], [0.8, 0.6, 0], [0, 0, 1.0]])
    p = q @ r.T + [1.0, 2.0, 3.0] + (np.arange(4000) % 4 == 0)[:, None] * rng.uniform(1, 2, (4000, 3))
    p[1000:3000], q[1000:3000] = p[1001], q[1001]
    far = rng.random((3, 6)) * 9
    rows = [("g", *map(float, (*a, *b))) for a, b in zip(p, q, strict=True)] + [(None, *map(float, x)) for x in far] + [("two", *map(float, x)) for x in far[:2]]
    df = spark.createDataFrame(rows, "g string, px double, py double, pz double, qx double, qy double, qz double")
    for parts in (3, 7):
        out = registration.ransac(df.repartition(parts), "g", limit=1e-6)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        got = {x.g: x for x in out.collect()}
        assert {g: (x.inliers, x.n) for g, x in got.items()} == {"g": (3500, 4000), None: (3, 3), "two": (0, 2)}
        t = np.reshape(got["g"].trans, (4, 4))
        assert np.allclose(t[:3, :3], r, atol=1e-9) and np.allclose(t[:3, 3], [1, 2, 3], atol=1e-6)
        assert np.allclose(np.reshape(got[None].trans, (4, 4)), registration.fit_rigid(far[:, :3], far[:, 3:]), atol=1e-9) and got["two"].trans == np.eye(4).ravel().tolist()
    m = list(registration.RIGID.columns)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 4,000 rows would become one partition
    try:
        blocks = consensus._packed(df.where("g = 'g'").repartition(5), "g", m, m).select("first", "m", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(b.m for b in blocks) <= consensus.BLOCK and len({b.task for b in blocks}) > 2
    assert sorted(i for b in blocks for i in range(b.first, b.first + b.m)) == list(range(1, 4001))


def test_all_pairs_copy_rows_equally_often(spark, tmp_path, monkeypatch):
    """A row goes to as many groups in a small table as in a large one, as it is stored, and a group leaves few partial rows; blocks over many tiles have the counts of all pairs."""
    assert {knn._count_pair_blocks(spark.range(n)) for n in (5_000, 100_000, 1_000_000)} == {knn.PAIR_PARTS}
    rng = np.random.default_rng(12)
    v, label = np.round(rng.normal(0, 4, (300, 3)), 1).astype(np.float32), rng.integers(0, 3, 300)
    v[40:60] = v[40]
    df = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    a, b = np.triu_indices(300, 1)
    d, y = np.round(np.sqrt(((v[a].astype(float) - v[b].astype(float)) ** 2).sum(1)), 9), (label[a] == label[b]).astype(int)
    want = {k: (int(((d < k * 0.02) & (y == 1)).sum()), int(((d < k * 0.02) & (y == 0)).sum())) for k in range(1001)}
    monkeypatch.setattr(knn, "TILE", 16)
    assert {r.k: (r.tp, r.fp) for r in queries.confusion_sweep(spark, str(tmp_path)).collect()} == want
    seen = []
    all_pairs = knn.all_pairs
    monkeypatch.setattr(knn, "all_pairs", lambda *a, **more: seen.append((*a, more)) or all_pairs(*a, **more))
    assert queries.contrastive_loss(spark, str(tmp_path)).first().n == len(d)
    (own, fold, schema, more), = seen
    assert dict(own.dtypes)["v"] == "array<float>"
    assert all_pairs(own, fold, schema, block=100, **more).count() == 6  # a row a pair of blocks


def test_first_thresholds_at_the_thresholds():
    """Distances at, just under and just over the thresholds, far ones and those that are not numbers."""
    for top, steps in ((20.0, 1001), (0.7, 11), (3.0, 2)):
        t = np.arange(steps) * (top / (steps - 1))
        d = np.concatenate([t, np.nextafter(t[1:], 0), np.nextafter(t, np.inf), [0.0, top * 5, np.inf, np.nan]])
        y = np.arange(len(d)) % 2
        got = {r.k: (r.p, r.n) for r in evaluate.first_thresholds(d, y, top, steps).itertuples()}
        k = np.searchsorted(t, d, "right")
        assert got == {x: (int(((k == x) & (y == 1)).sum()), int(((k == x) & (y == 0)).sum())) for x in np.unique(k)}
