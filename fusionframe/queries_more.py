"""More registered queries: sampling, the pose report, whole-grid operations, rotations and boxes, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geom
from .operators import mesh, report, sampling, voxel
from .plans.numbering import dense_ids
from .queries import _CAM, _PAIRS, DIMS, MESH, OFFSETS, PTS, VOX, K, descriptors, points, poses, query, rounded, surface_mesh, table, voxels, world_points  # noqa: F401

AX = voxel.AXES

# --- sampling and order ----------------------------------------------------------------------

_KEY = "md5(concat_ws('|', '{seed}', {keys}))"


@query("hash_sample_keypoints", VOX + " SELECT grid, ix, iy, iz FROM vox ORDER BY " + _KEY.format(seed=7, keys="grid, ix, iy, iz") + " LIMIT 500")
def hash_sample_keypoints(spark, d):
    return sampling.sample(voxels(spark, d).select("grid", *AX), 500, ["grid", *AX], 7)


@query("surface_keypoints", VOX + ", r AS (SELECT grid, ix, iy, iz, row_number() OVER (PARTITION BY grid ORDER BY " + _KEY.format(seed=3, keys="grid, ix, iy, iz") + ") AS k, count(*) OVER (PARTITION BY grid) AS n FROM vox WHERE value > 2) SELECT grid, ix, iy, iz FROM r WHERE k <= least(1000, floor(n / 50) * 50)")
def surface_keypoints(spark, d):
    return sampling.sample_each(voxels(spark, d).where("value > 2").select("grid", *AX), "grid", 1000, ["grid", *AX], 3, 50)


@query("pad_to_batch", VOX + ", s AS (SELECT grid, ix, iy, iz FROM vox WHERE value > 2), l AS (SELECT grid, count(*) AS n, max((ix, iy, iz)) AS m FROM s GROUP BY grid), p AS (SELECT grid, unnest(range(1, (50 - n % 50)::BIGINT + 1)) AS copy, m FROM l) SELECT grid, ix, iy, iz, 0::BIGINT AS copy FROM s UNION ALL SELECT grid, m[1], m[2], m[3], copy FROM p")
def pad_to_batch(spark, d):
    s = voxels(spark, d).where("value > 2").select("grid", *AX)
    return sampling.pad_to_batch(s, "grid", list(AX)).withColumn("copy", F.col("copy").cast("long"))


@query("random_permutation", "SELECT p_partkey, row_number() OVER (ORDER BY " + _KEY.format(seed=11, keys="p_partkey") + ", p_partkey) - 1 AS place FROM part")
def random_permutation(spark, d):
    return sampling.permutation(table(spark, d, "part").select("p_partkey"), ["p_partkey"], 11)


@query("argsort", "SELECT vec_id, row_number() OVER (ORDER BY embedding[1], vec_id) - 1 AS place FROM embeddings")
def argsort(spark, d):
    return sampling.argsort(table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].alias("v")), "v", "vec_id").select("vec_id", "place")


@query("argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS channel FROM embeddings")
def argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("channel"))


@query("uniform_numbers", "SELECT p_partkey, round(2e0 + ('0x' || substr(" + _KEY.format(seed=5, keys="p_partkey") + ", 1, 12))::BIGINT / 281474976710656e0 * (5e0 - 1e-4 - 2e0), 9) AS x FROM part")
def uniform_numbers(spark, d):
    return rounded(table(spark, d, "part").select("p_partkey", sampling.uniform(["p_partkey"], 5, 2.0, 5.0).alias("x")), "x", n=9)


@query("heap_smallest", "SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS pop FROM supplier QUALIFY pop <= 10")
def heap_smallest(spark, d):
    """The first ten that a heap on the balance gives."""
    top = table(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey").limit(10)
    return dense_ids(top, ["s_acctbal", "s_suppkey"], "pop").withColumn("pop", F.col("pop").cast("long"))


@query("scenario_numbers", "WITH s AS (SELECT s_nationkey, s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)) SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS scenario FROM s")
def scenario_numbers(spark, d):
    """Segments (suppliers) that have a file (a line of a large quantity), numbered in order."""
    has = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey").join(has, "s_suppkey", "left_semi")
    return dense_ids(s, ["s_nationkey", "s_suppkey"], "scenario").select("s_suppkey", (F.col("scenario") - 1).alias("scenario"))


# --- the pose report -------------------------------------------------------------------------

_TRUE = "t AS (SELECT s_suppkey AS inst, (CASE WHEN s_nationkey % 2 = 0 THEN 'office' ELSE 'warehouse' END) || '/' || (CASE WHEN s_nationkey % 3 = 0 THEN 'shelf' ELSE 'tote' END) || '/s' || (s_nationkey % 4) AS scene, 'obj' || (s_suppkey % 3) || 'x' AS object, s_acctbal / 1e4 AS x, (s_suppkey % 17) / 10e0 AS y, (s_suppkey % 13) / 10e0 AS z FROM supplier)"
_PRED = "p AS (SELECT c_custkey AS pred, CASE WHEN c_nationkey % 3 = 0 THEN 'shelf/s' ELSE 'tote/s' END || (c_nationkey % 4) AS scene, 'obj' || (c_custkey % 3) AS object, CASE WHEN c_custkey % 10 = 0 THEN 'nan'::DOUBLE ELSE c_acctbal / 1e4 END AS x, (c_custkey % 17) / 10e0 AS y, (c_custkey % 13) / 10e0 AS z FROM customer)"
_NEAREST = f"WITH {_TRUE}, {_PRED}, m AS (SELECT pred, inst, (p.x - t.x)**2 + (p.y - t.y)**2 + (p.z - t.z)**2 AS d2 FROM p JOIN t ON contains(t.scene || ' ' || t.object, p.scene || ' ' || p.object) WHERE NOT isnan(p.x)), n AS (SELECT pred, arg_min(inst, (d2, inst)) AS inst, sqrt(min(d2)) AS distance FROM m GROUP BY pred)"


def pose_tables(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    place = F.concat(F.when(F.col("s_nationkey") % 2 == 0, "office").otherwise("warehouse"), F.lit("/"), F.when(F.col("s_nationkey") % 3 == 0, "shelf").otherwise("tote"), F.lit("/s"), F.col("s_nationkey") % 4)
    truth = s.select(F.col("s_suppkey").alias("inst"), place.alias("scene"), F.concat(F.lit("obj"), F.col("s_suppkey") % 3, F.lit("x")).alias("object"), (F.col("s_acctbal") / 1e4).alias("x"), ((F.col("s_suppkey") % 17) / 10.0).alias("y"), ((F.col("s_suppkey") % 13) / 10.0).alias("z"))
    scene = F.concat(F.when(F.col("c_nationkey") % 3 == 0, "shelf/s").otherwise("tote/s"), F.col("c_nationkey") % 4)
    pred = c.select(F.col("c_custkey").alias("pred"), scene.alias("scene"), F.concat(F.lit("obj"), F.col("c_custkey") % 3).alias("object"), F.when(F.col("c_custkey") % 10 == 0, float("nan")).otherwise(F.col("c_acctbal") / 1e4).alias("x"), ((F.col("c_custkey") % 17) / 10.0).alias("y"), ((F.col("c_custkey") % 13) / 10.0).alias("z"))
    return pred, truth


@query("nearest_instance", _NEAREST + " SELECT pred, inst, round(distance, 6) AS distance FROM n")
def nearest_instance(spark, d):
    return rounded(report.nearest_instance(*pose_tables(spark, d)), "distance")


_SLICED = ", r AS (SELECT n.*, t.scene, pred % 8 AS objects, CASE WHEN pred % 9 = 0 THEN NULL ELSE (pred % 50)::DOUBLE END AS occlusion, pred % 4 = 0 AS deformable, pred % 5 = 0 AS no_depth, pred % 7 = 0 AS thin, (pred % 31)::DOUBLE AS rot, CASE WHEN pred % 11 = 0 THEN NULL ELSE (pred % 12) / 11e0 END AS prec, (pred % 14) / 13e0 AS rec FROM n JOIN t USING (inst) WHERE pred % 6 > 0), s AS (SELECT unnest(list_filter(['total', CASE WHEN contains(scene, 'competition') THEN 'competition' END, CASE WHEN contains(scene, 'office') THEN 'office' ELSE 'warehouse' END, CASE WHEN contains(scene, 'shelf') THEN 'shelf' ELSE 'tote' END, CASE WHEN objects IN (1, 2, 3) THEN 'clutter 1-3' WHEN objects IN (4, 5) THEN 'clutter 4-5' ELSE 'clutter 6+' END, CASE WHEN occlusion < 5 THEN 'occlusion low' WHEN occlusion < 30 THEN 'occlusion medium' ELSE 'occlusion high' END, CASE WHEN deformable THEN 'deformable' END, CASE WHEN no_depth THEN 'no depth' END, CASE WHEN thin THEN 'thin' END], lambda x: x IS NOT NULL)) AS slice, * FROM r)"


@query("pose_report", _NEAREST + _SLICED + " SELECT slice, count(*) AS n, round(avg((rot < 15)::INT), 6) AS rot_acc, round(avg((distance < 0.3e0)::INT), 6) AS trans_acc, round(avg(prec), 6) AS precision, round(avg(rec), 6) AS recall FROM s GROUP BY slice")
def pose_report(spark, d):
    pred, truth = pose_tables(spark, d)
    near = report.nearest_instance(pred, truth).join(truth.select("inst", "scene"), "inst")
    k = F.col("pred")
    rows = near.select(
        "scene", "distance", (k % 8).alias("objects"), F.when(k % 9 == 0, float("nan")).otherwise((k % 50).cast("double")).alias("occlusion"), (k % 4 == 0).alias("deformable"), (k % 5 == 0).alias("no_depth"), (k % 7 == 0).alias("thin"),
        (k % 31).cast("double").alias("rot_error"), (k % 6).alias("confidence"), F.when(k % 11 == 0, float("nan")).otherwise((k % 12) / 11.0).alias("precision"), ((k % 14) / 13.0).alias("recall"),
    )
    return rounded(report.pose_report(rows, translation=0.3), "rot_acc", "trans_acc", "precision", "recall")


@query("overlap_gate", VOX + ", n AS (SELECT grid, count(*) AS n FROM vox GROUP BY grid), c AS (SELECT a.grid AS a, b.grid AS b, count(*) AS shared FROM vox a JOIN vox b USING (ix, iy, iz) WHERE a.grid <> b.grid GROUP BY ALL) SELECT a, b, round(shared / n.n, 6) AS ratio FROM c JOIN n ON n.grid = a WHERE shared / n.n > 0.3e0")
def overlap_gate(spark, d):
    """Pairs of clouds that share over 0.3 of the first one's voxels."""
    v = voxels(spark, d).select("grid", *AX)
    shared = v.withColumnRenamed("grid", "a").join(v.withColumnRenamed("grid", "b"), list(AX)).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(v.groupBy(F.col("grid").alias("a")).agg(F.count("*").alias("n")), "a").withColumn("ratio", F.col("shared") / F.col("n"))
    return rounded(out.where(report.overlap_gate(F.col("ratio"))).select("a", "b", "ratio"), "ratio")


# --- whole grids -----------------------------------------------------------------------------

_PAIR = VOX + ", a AS (SELECT ix, iy, iz, value FROM vox WHERE grid = 'A'), b AS (SELECT ix, iy, iz, value FROM vox WHERE grid = 'N'), j AS (SELECT ix, iy, iz, coalesce(a.value, 0) AS p, coalesce(b.value, 0) AS q FROM a FULL JOIN b USING (ix, iy, iz))"
_HOWS = {"add": "p + q", "subtract": "p - q", "multiply": "p * q", "divide": "CASE WHEN q = 0 THEN 0 ELSE p / q END", "least": "least(p, q)", "greatest": "greatest(p, q)"}


@query("grid_combine", _PAIR + " " + " UNION ALL ".join(f"SELECT '{k}' AS how, ix, iy, iz, round({v}, 6) AS value FROM j WHERE {v} <> 0" for k, v in _HOWS.items()))
def grid_combine(spark, d):
    v = voxels(spark, d)
    a, b = (v.where(F.col("grid") == g).withColumn("grid", F.lit("both")) for g in "AN")
    out = None
    for how in _HOWS:
        one = voxel.combine(a, b, how).select(F.lit(how).alias("how"), *AX, "value")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "value")


@query("grid_transpose", VOX + " SELECT grid, iz AS ix, ix AS iy, iy AS iz, value FROM vox")
def grid_transpose(spark, d):
    return voxel.transpose(voxels(spark, d), (2, 0, 1))


@query("grid_plane", VOX + " SELECT grid, ix AS i, iz AS j, value FROM vox WHERE iy = 3")
def grid_plane(spark, d):
    return voxel.plane_of(voxels(spark, d), 1, 3)


@query("grid_pad", VOX + " SELECT grid, ix + 2 AS ix, iy + 1 AS iy, iz AS iz, value FROM vox WHERE ix + 2 < 30 AND iy + 1 < 30 AND iz < 30")
def grid_pad(spark, d):
    return voxel.pad(voxels(spark, d), DIMS, (30, 30, 30), (2, 1, 0))


_NEW = "(SELECT range AS k, CASE WHEN range = 14 THEN 21e0 ELSE range * (21e0 / 14e0) END AS at FROM range(15))"


@query("grid_resample", VOX + f" SELECT grid, p.k AS ix, q.k AS iy, r.k AS iz, round(sum(value * (1 - abs(p.at - vox.ix)) * (1 - abs(q.at - vox.iy)) * (1 - abs(r.at - vox.iz))), 6) AS value FROM vox JOIN {_NEW} p ON abs(p.at - vox.ix) < 1 JOIN {_NEW} q ON abs(q.at - vox.iy) < 1 JOIN {_NEW} r ON abs(r.at - vox.iz) < 1 GROUP BY ALL")
def grid_resample(spark, d):
    return rounded(voxel.resample(voxels(spark, d), DIMS, (15, 15, 15)), "value")


@query("grid_edges", VOX + OFFSETS.format(r=1) + ", c AS (SELECT grid, ix - ox AS ix, iy - oy AS iy, iz - oz AS iz, sum(value * CASE WHEN ox = 0 AND oy = 0 AND oz = 0 THEN 1e0 ELSE -1e0 / 26 END) AS value FROM vox, offs GROUP BY ALL) SELECT grid, ix, iy, iz, round(abs(value), 6) AS value FROM c WHERE ix BETWEEN 1 AND 20 AND iy BETWEEN 1 AND 20 AND iz BETWEEN 1 AND 20")
def grid_edges(spark, d):
    return rounded(voxel.detect_edges(voxels(spark, d), DIMS), "value")


_BOXED = PTS + ", s AS (SELECT DISTINCT cloud AS grid, round(x / 0.1e0)::BIGINT AS ix, round(y / 0.1e0)::BIGINT AS iy, round(z / 0.1e0)::BIGINT AS iz FROM pts), g AS (SELECT grid, p.range AS ix, q.range AS iy, r.range AS iz FROM (SELECT DISTINCT grid FROM s), range(12) p, range(12) q, range(12) r), e AS (SELECT * FROM g ANTI JOIN s USING (grid, ix, iy, iz))"


@query("grid_erode", _BOXED + " SELECT *, 1e0 AS value FROM s ANTI JOIN (SELECT DISTINCT grid, ix + o.a AS ix, iy + o.b AS iy, iz + o.c AS iz FROM e, (SELECT p.range - 1 AS a, q.range - 1 AS b, r.range - 1 AS c FROM range(3) p, range(3) q, range(3) r) o WHERE abs(o.a) + abs(o.b) + abs(o.c) <= 1) USING (grid, ix, iy, iz)")
def grid_erode(spark, d):
    return voxel.erode(voxel.occupancy(points(spark, d), 0.1).withColumn("value", F.lit(1.0)), 1.0, (12, 12, 12))


_SMALL = "WITH v AS (SELECT DISTINCT round(x / 0.2e0)::BIGINT AS ix, round(y / 0.2e0)::BIGINT AS iy, round(z / 0.2e0)::BIGINT AS iz FROM pts WHERE x * 7 - floor(x * 7) < 0.5e0 AND y > 0.5e0), g AS (SELECT p.range AS ix, q.range AS iy, r.range AS iz FROM range(8) p, range(8) q, range(8) r), e AS (SELECT * FROM g ANTI JOIN v USING (ix, iy, iz))"


_SPOTS = "q AS (SELECT range AS q, range * 0.021e0 AS gx, range * 0.017e0 AS gy, range * 0.025e0 AS gz FROM range(1000))"


@query("gaussian_value", VOX + f", {_SPOTS}, c AS (SELECT q, gx, gy, gz, unnest(range(greatest(0, trunc(gx - 2 + 0.5e0)::BIGINT), least(21, trunc(gx + 2 + 0.5e0)::BIGINT) + 1)) AS ix FROM q WHERE gx <= 21 AND gy <= 21 AND gz <= 21), e AS (SELECT *, unnest(range(greatest(0, trunc(gy - 2 + 0.5e0)::BIGINT), least(21, trunc(gy + 2 + 0.5e0)::BIGINT) + 1)) AS iy FROM c), f AS (SELECT *, unnest(range(greatest(0, trunc(gz - 2 + 0.5e0)::BIGINT), least(21, trunc(gz + 2 + 0.5e0)::BIGINT) + 1)) AS iz FROM e), w AS (SELECT q, ix, iy, iz, exp(-((gx - ix)**2 + (gy - iy)**2 + (gz - iz)**2) / (2 * 0.7e0 * 0.7e0)) AS w FROM f), s AS (SELECT q, sum(w * coalesce(value, 0)) / sum(w) AS value FROM w LEFT JOIN (SELECT * FROM vox WHERE grid = 'A') USING (ix, iy, iz) GROUP BY q) SELECT q.q, round(coalesce(value, 0), 6) AS value FROM q LEFT JOIN s USING (q)")
def gaussian_value(spark, d):
    i = F.col("id")
    q = spark.range(1000).select(F.lit("A").alias("grid"), i.alias("q"), (i * 0.021).alias("gx"), (i * 0.017).alias("gy"), (i * 0.025).alias("gz"))
    return rounded(voxel.gaussian_value(voxels(spark, d), q, 0.7, DIMS).select("q", "value"), "value")


@query("grid_bilateral", VOX + ", v AS (SELECT ix, iy, iz, value FROM vox WHERE grid = 'A'), g AS (SELECT p.range AS ix, q.range AS iy, r.range AS iz FROM range(22) p, range(22) q, range(22) r), a AS (SELECT g.*, coalesce(value, 0) AS value FROM g LEFT JOIN v USING (ix, iy, iz)), o AS (SELECT p.range - 2 AS x, q.range - 2 AS y, r.range - 2 AS z FROM range(5) p, range(5) q, range(5) r WHERE (p.range - 2)**2 + (q.range - 2)**2 + (r.range - 2)**2 <= 4), j AS (SELECT a.ix, a.iy, a.iz, exp(-(x*x + y*y + z*z) / (2 * 0.5e0 * 0.5e0)) * exp(-((a.value - b.value)**2) / (2 * 3e0 * 3e0)) AS w, b.value FROM a, o JOIN a b ON b.ix = a.ix + x AND b.iy = a.iy + y AND b.iz = a.iz + z), s AS (SELECT ix, iy, iz, sum(w * value) / sum(w) AS value FROM j GROUP BY ALL) SELECT ix, iy, iz, round(value, 6) AS value FROM s WHERE value <> 0")
def grid_bilateral(spark, d):
    return rounded(voxel.bilateral(voxels(spark, d).where("grid = 'A'"), 0.5, 3.0, DIMS).drop("grid"), "value")


@query("rasterize_solids", VOX + " SELECT DISTINCT grid, 'box' AS solid, p.range AS ix, q.range AS iy, r.range AS iz FROM vox, range(2, 6) p, range(1, 4) q, range(3, 9) r UNION ALL SELECT DISTINCT grid, 'sphere', p.range, q.range, r.range FROM vox, range(22) p, range(22) q, range(22) r WHERE (p.range - 9.5e0)**2 + (q.range - 10e0)**2 + (r.range - 4.25e0)**2 <= 3.5e0**2")
def rasterize_solids(spark, d):
    g = voxels(spark, d)
    box = voxel.rasterize_box(g, (2, 1, 3), (5, 3, 8)).select("grid", F.lit("box").alias("solid"), *AX)
    return box.unionByName(voxel.rasterize_sphere(g, (9.5, 10.0, 4.25), 3.5, DIMS).select("grid", F.lit("sphere").alias("solid"), *AX))


@query("field_normals", VOX + ", n AS (SELECT v.grid, v.ix, v.iy, v.iz, (a.value - b.value) / 2 AS dx, (c.value - e.value) / 2 AS dy, (f.value - g.value) / 2 AS dz FROM t v JOIN t a ON a.grid = v.grid AND a.ix = v.ix + 1 AND a.iy = v.iy AND a.iz = v.iz JOIN t b ON b.grid = v.grid AND b.ix = v.ix - 1 AND b.iy = v.iy AND b.iz = v.iz JOIN t c ON c.grid = v.grid AND c.ix = v.ix AND c.iy = v.iy + 1 AND c.iz = v.iz JOIN t e ON e.grid = v.grid AND e.ix = v.ix AND e.iy = v.iy - 1 AND e.iz = v.iz JOIN t f ON f.grid = v.grid AND f.ix = v.ix AND f.iy = v.iy AND f.iz = v.iz + 1 JOIN t g ON g.grid = v.grid AND g.ix = v.ix AND g.iy = v.iy AND g.iz = v.iz - 1), s AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS size FROM n) SELECT grid, ix, iy, iz, CASE WHEN size > 0 THEN round(dx / size, 6) + 0e0 END AS nx, CASE WHEN size > 0 THEN round(dy / size, 6) + 0e0 END AS ny, CASE WHEN size > 0 THEN round(dz / size, 6) + 0e0 END AS nz FROM s".replace(", n AS", ", t AS (SELECT cloud AS grid, round(x / 0.1e0)::BIGINT AS ix, round(y / 0.1e0)::BIGINT AS iy, round(z / 0.1e0)::BIGINT AS iz, count(*)::DOUBLE AS value FROM pts GROUP BY ALL), n AS"))
def field_normals(spark, d):
    i = [F.round(F.col(c) / 0.1).cast("long").alias(a) for c, a in zip("xyz", AX, strict=True)]
    v = points(spark, d).groupBy(F.col("cloud").alias("grid"), *i).agg(F.count("*").cast("double").alias("value"))
    return rounded(voxel.field_normals(v), "nx", "ny", "nz")


@query("near_surface", VOX + OFFSETS.format(r=2) + ", n AS (SELECT grid, ix + ox AS ix, iy + oy AS iy, iz + oz AS iz, min(ox*ox+oy*oy+oz*oz) AS o2 FROM vox, offs GROUP BY ALL) SELECT grid, ix, iy, iz, round(1 - sqrt(o2) / 2, 6) AS value FROM n WHERE 1 - sqrt(o2) / 2 > 0.4e0")
def near_surface(spark, d):
    return rounded(voxel.near_surface(voxel.tdf_index(voxel.occupancy(points(spark, d), 0.05), 2), 0.4), "value")


@query("keypoint_lookup", VOX + " SELECT k.grid, k.ix, k.iy, k.iz, v.value FROM (SELECT grid, ix, iy, iz FROM vox WHERE (ix + iy * 7 + iz * 13) % 50 = 0) k JOIN vox v ON v.grid = 'N' AND v.ix = k.ix AND v.iy = k.iy AND v.iz = k.iz")
def keypoint_lookup(spark, d):
    """Integer keypoints of each grid that are voxels of grid N."""
    v = voxels(spark, d)
    return v.where("(ix + iy * 7 + iz * 13) % 50 = 0").select("grid", *AX).join(v.where("grid = 'N'").select(*AX, "value"), list(AX))


# --- rotations, boxes, clouds ----------------------------------------------------------------


@query("quaternion_slerp", "SELECT n_nationkey AS frame, round(cos(0.05e0 * n_nationkey + 0.0125e0), 6) + 0e0 AS w, round(sin(0.05e0 * n_nationkey + 0.0125e0), 6) + 0e0 AS z, round(cos(0.1e0 * n_nationkey + 0.025e0) - 2 * sin(0.1e0 * n_nationkey + 0.025e0), 6) + 0e0 AS px, round(sin(0.1e0 * n_nationkey + 0.025e0) + 2 * cos(0.1e0 * n_nationkey + 0.025e0), 6) + 0e0 AS py FROM nation")
def quaternion_slerp(spark, d):
    """A quarter of the way from each frame's turn to one of 0.1 more, and a point turned by it."""
    k = table(spark, d, "nation").select(F.col("n_nationkey").alias("frame"), (0.05 * F.col("n_nationkey")).alias("h"))
    zero = F.lit(0.0)
    a, b = ((F.cos(x), zero, zero, F.sin(x)) for x in (F.col("h"), F.col("h") + 0.05))
    q = k.select("frame", *[c.alias(n) for c, n in zip(geom.slerp(a, b, 0.25), "wxyz", strict=True)])
    p = geom.rotate(tuple(F.col(c) for c in "wxyz"), (F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return rounded(q.select("frame", "w", "z", p[0].alias("px"), p[1].alias("py")), "w", "z", "px", "py")


@query("cross_matrix", PTS + " SELECT cloud, round(sum(-z * 2 + y * 3), 4) + 0e0 AS cx, round(sum(z * 1 - x * 3), 4) + 0e0 AS cy, round(sum(-y * 1 + x * 2), 4) + 0e0 AS cz, round(sum(CASE WHEN z > 0 THEN x / z END), 4) AS u, round(sum(exp(-(x * x) / 0.5e0)), 4) AS gauss, round(sum(greatest(0, 1 - abs(y) / 0.8e0)), 4) AS linear FROM pts GROUP BY cloud")
def cross_matrix(spark, d):
    """Sums over each cloud of p x (1, 2, 3), of a homogeneous coordinate, and of two kernels."""
    m, u = geom.cross_matrix(geom.xyz()), (1.0, 2.0, 3.0)
    c = [sum((m[3 * i + j] * u[j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    out = points(spark, d).groupBy("cloud").agg(*[F.sum(x).alias(f"c{n}") for x, n in zip(c, "xyz", strict=True)], F.sum(geom.homogeneous(F.col("x"), F.col("y"), F.col("z"))[0]).alias("u"), F.sum(geom.gaussian_kernel(F.col("x"), 0.5)).alias("gauss"), F.sum(geom.linear_kernel(F.col("y"), 0.8)).alias("linear"))
    return rounded(out, "cx", "cy", "cz", "u", "gauss", "linear", n=4)


_BOXES = PTS + ", b AS (SELECT cloud, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) + (cloud = 'N')::INT * 0.3e0 AS z0, max(z) AS z1 FROM pts GROUP BY cloud)"


@query("box_sets", _BOXES + " SELECT p.cloud AS a, q.cloud AS b, " + ", ".join(f"round(least(p.{c}0, q.{c}0), 9) AS u{c}0, round(greatest(p.{c}1, q.{c}1), 9) AS u{c}1, round(greatest(p.{c}0, q.{c}0), 9) AS i{c}0, round(least(p.{c}1, q.{c}1), 9) AS i{c}1" for c in "xyz") + " FROM b p JOIN b q ON p.cloud < q.cloud")
def box_sets(spark, d):
    b = voxel.bbox(points(spark, d)).withColumn("min_z", F.col("min_z") + (F.col("cloud") == "N").cast("int") * 0.3)
    p, q = (b.select(F.col("cloud").alias(s), *[F.col(f"{m}_{c}").alias(f"{s}{m}{c}") for m in ("min", "max") for c in "xyz"]) for s in "ab")
    j = p.join(q, F.col("a") < F.col("b"))
    ends = [tuple(F.col(f"{s}{m}{c}") for c in "xyz") for s in "ab" for m in ("min", "max")]
    cols = []
    for name, (low, high) in (("u", geom.box_union(*ends)), ("i", geom.box_intersection(*ends))):
        cols += [x.alias(f"{name}{c}{k}") for k, v in ((0, low), (1, high)) for x, c in zip(v, "xyz", strict=True)]
    return rounded(j.select("a", "b", *cols), *[f"{n}{c}{k}" for n in "ui" for c in "xyz" for k in (0, 1)], n=9)


@query("colored_union", PTS + " SELECT 0 AS r, 0 AS g, 255 AS b, count(*) AS n, round(sum(x), 4) AS x FROM pts WHERE cloud = 'A' UNION ALL SELECT 255, 0, 0, count(*), round(sum(x), 4) FROM pts WHERE cloud = 'N'")
def colored_union(spark, d):
    """Two clouds in one table, the first blue, the second red."""
    p = points(spark, d)
    paint = lambda cloud, r, b: p.where(F.col("cloud") == cloud).select("x", "y", "z", F.lit(r).alias("r"), F.lit(0).alias("g"), F.lit(b).alias("b"))
    return rounded(paint("A", 0, 255).unionByName(paint("N", 255, 0)).groupBy("r", "g", "b").agg(F.count("*").alias("n"), F.sum("x").alias("x")), "x", n=4)


@query("symmetric_box", _CAM + ", c AS (SELECT unnest([-0.1e0, 0.1e0]) AS o), b AS (SELECT frame, px, py, min(round(585e0 * (x + p.o) / (z + s.o) + 320)) AS u0, max(round(585e0 * (x + p.o) / (z + s.o) + 320)) AS u1, min(round(585e0 * (y + q.o) / (z + s.o) + 240)) AS v0, max(round(585e0 * (y + q.o) / (z + s.o) + 240)) AS v1 FROM cam, c p, c q, c s WHERE z - 0.1e0 > 0 GROUP BY ALL), r AS (SELECT frame, px, py, greatest(abs(px - u0), abs(u1 - px)) AS ru, greatest(abs(py - v0), abs(v1 - py)) AS rv FROM b) SELECT frame, px, py, px - ru AS u0, px + ru AS u1, py - rv AS v0, py + rv AS v1 FROM r WHERE px - ru > 0 AND px + ru <= 640 AND py - rv > 0 AND py + rv <= 480")
def symmetric_box(spark, d):
    """Pixel boxes of 0.2 around seen points, made symmetric to the pixel; those that leave the image go."""
    from .operators import fusion
    from .queries import depth

    p = geom.backproject(F.col("px"), F.col("py"), F.col("d"), K)
    cam = fusion.valid_depth(depth(spark, d)).select("frame", "px", "py", *[c.alias(n) for c, n in zip(p, "xyz", strict=True)]).where(F.col("z") - 0.1 > 0)
    sides = [(F.col("x") + a, F.col("y") + b, F.col("z") + c) for a in (-0.1, 0.1) for b in (-0.1, 0.1) for c in (-0.1, 0.1)]
    pixels = [geom.project(s, K) for s in sides]
    u = geom.symmetric_range(F.col("px"), F.least(*[x for x, _ in pixels]), F.greatest(*[x for x, _ in pixels]))
    v = geom.symmetric_range(F.col("py"), F.least(*[y for _, y in pixels]), F.greatest(*[y for _, y in pixels]))
    out = cam.select("frame", "px", "py", u[0].alias("u0"), u[1].alias("u1"), v[0].alias("v0"), v[1].alias("v1"))
    return out.where(geom.range_in_image(F.col("u0"), F.col("u1"), 640) & geom.range_in_image(F.col("v0"), F.col("v1"), 480))


@query("trajectory_plot", "WITH p AS (SELECT n_nationkey AS frame, 0.1e0 * n_regionkey AS tx, 0.02e0 * n_nationkey AS tz FROM nation), f AS (SELECT * FROM p WHERE frame = 0) SELECT p.frame, round(p.tx - f.tx, 6) + 0e0 AS x, round(p.tz - f.tz, 6) + 0e0 AS z FROM p, f")
def trajectory_plot(spark, d):
    """Positions relative to the first pose, x and z; the first pose is not turned."""
    p = poses(spark, d)
    first = p.orderBy("frame").limit(1).select(F.col("pose").alias("base"))
    m = geom.relative_pose(F.col("base"), F.col("pose"))
    return rounded(p.crossJoin(F.broadcast(first)).select("frame", m[3].alias("x"), m[11].alias("z")), "x", "z")


@query("tensor_range", "WITH a AS (SELECT generate_subscripts(embedding, 1) - 1 AS ch, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT ch::INT AS ch, round(min(v), 6) AS low, round(max(v), 6) AS high FROM a GROUP BY ch")
def tensor_range(spark, d):
    a = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("ch", "v"))
    return rounded(a.groupBy("ch").agg(F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high")), "low", "high")


@query("channel_concat", "SELECT a.vec_id, len(a.embedding) + len(b.embedding) AS n, round(list_sum(a.embedding::DOUBLE[]) + list_sum(b.embedding::DOUBLE[]), 5) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def channel_concat(spark, d):
    """Each descriptor followed by the next one's channels."""
    e = descriptors(spark, d).select("q", "v")
    both = e.join(e.select((F.col("q") - 1).alias("q"), F.col("v").alias("w")), "q").select(F.col("q").alias("vec_id"), F.concat("v", "w").alias("v"))
    return rounded(both.select("vec_id", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total")), "total", n=5)


# --- meshes ----------------------------------------------------------------------------------


@query("cloud_normalisation", PTS + ", c AS (SELECT cloud, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY cloud) SELECT cloud, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(1 / avg(sqrt((x - cx)**2 + (y - cy)**2 + (z - cz)**2)), 6) AS scale FROM pts JOIN c USING (cloud) GROUP BY ALL")
def cloud_normalisation(spark, d):
    return rounded(mesh.normalisation(points(spark, d), "cloud"), "cx", "cy", "cz", "scale")


_U = "('0x' || substr(" + "md5(concat_ws('|', '{seed}', fid))" + ", 1, 12))::BIGINT / 281474976710656e0 * (1 - 1e-4)"


@query("random_face_points", MESH + f", u AS (SELECT *, sqrt({_U.format(seed=1)}) AS r, {_U.format(seed=2)} AS s FROM m) SELECT 'part' AS mesh, fid, round(ax + r * (1 - s) * ux + r * s * wx, 6) AS x, round(ay + r * (1 - s) * uy + r * s * wy, 6) AS y, round(az + r * (1 - s) * uz + r * s * wz, 6) AS z FROM u")
def random_face_points(spark, d):
    v, f = surface_mesh(spark, d)
    return rounded(mesh.random_points(v, f, sampling.uniform(["fid"], 1), sampling.uniform(["fid"], 2)), "x", "y", "z")


@query("mesh_connected", MESH.replace("WITH v AS", "WITH RECURSIVE v AS") + ", n AS (SELECT a AS vid, b AS o FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT 0::BIGINT AS vid UNION SELECT n.o FROM r JOIN n ON n.vid = r.vid) SELECT 'part' AS mesh, vid FROM r")
def mesh_connected(spark, d):
    v, f = surface_mesh(spark, d)
    return mesh.connected(v, mesh.edges(f), v.where("vid = 0"))
