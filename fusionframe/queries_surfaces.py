"""Registered queries of surfaces and searches: distance fields with sources, level surfaces, nearest things, geodesics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import consensus, descriptors, distance, geodesics, isosurface, knn, mesh, meanshift, search, voxel
from .plans.checkpoint import checkpointed
from .queries import DIMS, MESH, PTS, VOX, points, query, rounded, surface_mesh, table, voxels

# --- distance fields -------------------------------------------------------------------------

_TALL = VOX + ", avgs AS (SELECT grid, avg(value) AS m FROM vox GROUP BY grid), tall AS (SELECT vox.* FROM vox JOIN avgs USING (grid) WHERE value > 1.6e0 * m)"


def tall(spark, d):
    """The voxels that hold over 1.6 times the mean of their grid."""
    v = voxels(spark, d)
    means = v.groupBy("grid").agg(F.avg("value").alias("m"))
    return v.join(means, "grid").where("value > 1.6 * m").drop("m")


@query("grid_voronoi", _TALL + ", c AS (SELECT g.grid, p.range AS ix, q.range AS iy, r.range AS iz FROM (SELECT DISTINCT grid FROM tall) g, range(22) p, range(22) q, range(22) r), j AS (SELECT c.grid, c.ix, c.iy, c.iz, min(((c.ix - t.ix)**2 + (c.iy - t.iy)**2 + (c.iz - t.iz)**2, t.ix, t.iy, t.iz, t.value)) AS m FROM c JOIN tall t ON t.grid = c.grid GROUP BY ALL) SELECT grid, ix, iy, iz, m[5]::DOUBLE AS value, m[1]::BIGINT AS d2 FROM j")
def grid_voronoi(spark, d):
    return distance.voronoi(tall(spark, d), DIMS)


_CELLS = ", c AS (SELECT g.grid, p.range AS ix, q.range AS iy, r.range AS iz FROM (SELECT DISTINCT grid FROM tall) g, range(22) p, range(22) q, range(22) r)"
_OUT = ", o AS (SELECT c.grid, c.ix, c.iy, c.iz, min((c.ix - t.ix)**2 + (c.iy - t.iy)**2 + (c.iz - t.iz)**2)::DOUBLE AS value FROM c JOIN tall t ON t.grid = c.grid GROUP BY ALL)"


@query("distance_transform", _TALL + _CELLS + _OUT + " SELECT * FROM o")
def distance_transform(spark, d):
    return voxel.squared_distance(tall(spark, d), DIMS)


@query("grid_dilate", _TALL + _CELLS + _OUT + " SELECT grid, ix, iy, iz, 1e0 AS value FROM o WHERE value <= 4")
def grid_dilate(spark, d):
    return voxel.dilate(tall(spark, d), 2.0, DIMS)


@query("signed_distance", _TALL + _CELLS + _OUT + ", low AS (SELECT c.* FROM c ANTI JOIN tall USING (grid, ix, iy, iz)), i AS (SELECT t.grid, t.ix, t.iy, t.iz, min((l.ix - t.ix)**2 + (l.iy - t.iy)**2 + (l.iz - t.iz)**2) AS inner FROM tall t JOIN low l ON l.grid = t.grid GROUP BY ALL) SELECT o.grid, o.ix, o.iy, o.iz, round(sqrt(value) - sqrt(coalesce(i.inner, 0)), 6) AS value FROM o LEFT JOIN i USING (grid, ix, iy, iz)")
def signed_distance(spark, d):
    return rounded(voxel.signed_distance(tall(spark, d), DIMS), "value")


def _grid_sql(spacing: float, border: float, most: int) -> str:
    """The grid around the mesh, its corners in cells, and the cells of the faces."""
    steps, last = "", f"{spacing}e0"
    for k, c in enumerate("xyz"):
        steps += f", g{k} AS (SELECT *, CASE WHEN (h{c} - l{c}) / {last} > {most} THEN (h{c} - l{c}) / {most} ELSE {last} END AS s{k} FROM {'g' + str(k - 1) if k else 'box'})"
        last = f"s{k}"
    full = {c: f"((h{c} + s2 * {border}) - (l{c} - s2 * {border}))" for c in "xyz"}
    sizes = ", ".join(f"trunc({full[c]} / s2 + 0.5e0)::BIGINT AS n{c}, {full[c]} AS f{c}, (l{c} + h{c}) / 2 AS c{c}" for c in "xyz")
    ends = ", ".join(f"min({c}) AS l{c}, max({c}) AS h{c}" for c in "xyz")
    at = ", ".join(f"trunc((v.{c} - c{c}) * scale + 0.5e0 * (n{c} - 1) + 0.5e0)::BIGINT" for c in "xyz")
    cut = lambda a, b, i, n: f"list_transform([1, 2, 3], lambda k: {a}[k] + sign({b}[k] - {a}[k])::BIGINT * ((abs({b}[k] - {a}[k]) * {i}) // {n}))"
    spread = [f"(greatest(p0[{k}], p1[{k}], p2[{k}]) - least(p0[{k}], p1[{k}], p2[{k}]))" for k in (1, 2, 3)]
    return (
        f", box AS (SELECT {ends} FROM v){steps}, gr AS (SELECT {sizes} FROM g2), sc AS (SELECT *, least((nx - 1) / fx, (ny - 1) / fy, (nz - 1) / fz) AS scale FROM gr), pv AS (SELECT vid, [{at}] AS p FROM v, sc)"
        + ", t0 AS (SELECT a.p AS p0, b.p AS p1, c.p AS p2 FROM f JOIN pv a ON a.vid = v0 JOIN pv b ON b.vid = v1 JOIN pv c ON c.vid = v2)"
        + f", t1 AS (SELECT *, CASE WHEN {spread[1]} > {spread[0]} AND {spread[1]} > {spread[2]} THEN 2 WHEN {spread[2]} > {spread[0]} THEN 3 ELSE 1 END AS d FROM t0)"
        + ", t2 AS (SELECT d, list_sort([{'o': -p0[d], 'k': 0, 'p': p0}, {'o': -p1[d], 'k': 1, 'p': p1}, {'o': -p2[d], 'k': 2, 'p': p2}]) AS q FROM t1), t3 AS (SELECT q[1].p AS a, q[2].p AS b, q[3].p AS c, q[1].p[d] - q[2].p[d] AS up, q[2].p[d] - q[3].p[d] AS down FROM t2)"
        + f", hi AS (SELECT *, unnest(range(0, up)) AS i FROM t3), lo AS (SELECT *, {cut('a', 'c', 'up', 'greatest(up + down, 1)')} AS side, unnest(range(0, down + 1)) AS i FROM t3)"
        + f", ends AS (SELECT {cut('a', 'b', 'i', 'up')} AS s, {cut('a', 'c', 'i', '(up + down)')} AS e FROM hi UNION ALL SELECT CASE WHEN down = 0 THEN b WHEN up = 0 THEN {cut('a', 'c', 'i', 'greatest(down, 1)')} ELSE {cut('b', 'c', 'i', 'greatest(down, 1)')} END, CASE WHEN down = 0 THEN c WHEN up = 0 THEN {cut('b', 'c', 'i', 'greatest(down, 1)')} ELSE {cut('side', 'c', 'i', 'greatest(down, 1)')} END FROM lo)"
        + ", steps AS (SELECT s, e, greatest(abs(e[1] - s[1]), abs(e[2] - s[2]), abs(e[3] - s[3])) AS m FROM ends), walk AS (SELECT s, e, m, unnest(range(0, m + 1)) AS i FROM steps)"
        + f", marks AS (SELECT DISTINCT {cut('s', 'e', 'i', 'greatest(m, 1)')} AS c FROM walk), cells AS (SELECT c[1] AS ix, c[2] AS iy, c[3] AS iz, nx, ny, nz FROM marks, sc WHERE c[1] BETWEEN 0 AND nx - 1 AND c[2] BETWEEN 0 AND ny - 1 AND c[3] BETWEEN 0 AND nz - 1)"
    )


@query(
    "mesh_to_df",
    MESH
    + _grid_sql(0.01, 4, 64)
    + ", lz AS (SELECT ix, iy, z.range AS iz, min((z.range - c.iz)**2) AS w FROM cells c, range(500) z WHERE z.range < nz GROUP BY ALL), ly AS (SELECT ix, y.range AS iy, iz, min(w + (y.range - l.iy)**2) AS w FROM lz l, sc, range(500) y WHERE y.range < ny GROUP BY ALL), lx AS (SELECT x.range AS ix, iy, iz, min(w + (x.range - l.ix)**2) AS w FROM ly l, sc, range(500) x WHERE x.range < nx GROUP BY ALL) SELECT ix, iy, iz, round(least(sqrt(w), 12e0), 6) AS value FROM lx",
)
def mesh_to_df(spark, d):
    """The height field as a distance grid of at most 64 cells a side and a border of 4, cut at 12 cells."""
    v, f = surface_mesh(spark, d)
    return rounded(distance.mesh_to_df(v, f, 0.01, 4, 64, 12.0).drop("grid"), "value")


# --- level surfaces --------------------------------------------------------------------------

_LEVEL = ", mean AS (SELECT avg(value) AS iso FROM vox WHERE grid = 'A')"


def level(spark, d) -> float:
    return voxels(spark, d).where("grid = 'A'").agg(F.avg("value")).first()[0] or 0.0


_FULL = VOX + _LEVEL + ", gs AS (SELECT DISTINCT grid FROM vox), cs AS (SELECT grid, p.range AS ix, q.range AS iy, r.range AS iz FROM gs, range(22) p, range(22) q, range(22) r), dense AS (SELECT cs.*, coalesce(value, 0e0) AS value, (cs.iz * 22 + cs.iy) * 22 + cs.ix AS n FROM cs LEFT JOIN vox USING (grid, ix, iy, iz))"


@query("isosurface_vertices", _FULL + ", ax AS (SELECT * FROM (VALUES (0, 1, 0, 0, 1), (1, 0, 1, 0, 22), (2, 0, 0, 1, 484)) t(axis, dx, dy, dz, step)) SELECT a.grid AS mesh, a.n * 3 + axis AS vid, round(a.ix + dx * (iso - a.value) / (b.value - a.value), 6) AS x, round(a.iy + dy * (iso - a.value) / (b.value - a.value), 6) AS y, round(a.iz + dz * (iso - a.value) / (b.value - a.value), 6) AS z FROM dense a, ax, mean, dense b WHERE b.grid = a.grid AND b.n = a.n + step AND b.ix = a.ix + dx AND b.iy = a.iy + dy AND b.iz = a.iz + dz AND (a.value >= iso) <> (b.value >= iso)")
def isosurface_vertices(spark, d):
    """Of the level of grid A's mean in all grids."""
    return rounded(isosurface.iso_vertices(voxels(spark, d), level(spark, d), DIMS), "x", "y", "z")


def _case_rows() -> str:
    step = [(c[2] * 22 + c[1]) * 22 + c[0] for c in isosurface.CORNERS]
    return ", ".join(f"({case}, {k}, {', '.join(str(3 * step[c] + a) for c, a in t)})" for case, triangles in enumerate(isosurface.case_table()) for k, t in enumerate(triangles))


_CORNER_ROWS = ", ".join(f"({k}, {x}, {y}, {z})" for k, (x, y, z) in enumerate(isosurface.CORNERS))


@query("isosurface_faces", _FULL + f", tri AS (SELECT * FROM (VALUES {_case_rows()}) t(c, k, e0, e1, e2)), co AS (SELECT * FROM (VALUES {_CORNER_ROWS}) t(k, dx, dy, dz)), cube AS (SELECT grid, ix - dx AS ix, iy - dy AS iy, iz - dz AS iz, sum((value >= iso)::INT << k)::INT AS c FROM dense, mean, co GROUP BY ALL HAVING count(*) = 8), num AS (SELECT grid, (iz * 22 + iy) * 22 + ix AS n, c FROM cube) SELECT grid AS mesh, n * 16 + k AS fid, n * 3 + e0 AS v0, n * 3 + e1 AS v1, n * 3 + e2 AS v2 FROM num JOIN tri USING (c)")
def isosurface_faces(spark, d):
    return isosurface.iso_faces(voxels(spark, d), level(spark, d), DIMS)


# --- searches --------------------------------------------------------------------------------


@query("nearest_fuller", VOX + ", a AS (SELECT (iz * 22 + iy) * 22 + ix AS id, ix * 0.05e0 AS x, iy * 0.05e0 AS y, iz * 0.05e0 AS z, value FROM vox WHERE grid = 'A'), b AS (SELECT (iz * 22 + iy) * 22 + ix AS id, ix * 0.05e0 AS x, iy * 0.05e0 AS y, iz * 0.05e0 AS z, value FROM vox WHERE grid = 'N'), m AS (SELECT a.id AS q, min((round((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z), 9), b.id)) AS m FROM a JOIN b ON b.value > a.value * 1.2e0 GROUP BY a.id) SELECT q, m[2] AS item, m[1] AS d2 FROM m")
def nearest_fuller(spark, d):
    """For each voxel of grid A the nearest voxel of grid N that holds over 1.2 times as much, however far."""
    v = voxels(spark, d).select("grid", ((F.col("iz") * 22 + F.col("iy")) * 22 + F.col("ix")).alias("id"), *[(F.col(f"i{c}") * 0.05).alias(c) for c in "xyz"], "value")
    return search.nearest(v.where("grid = 'A'").drop("grid"), v.where("grid = 'N'").drop("grid"), lambda a, b: b("value") > a("value") * 1.2)


def over_mesh(spark, d):
    """The voxels of all grids as points around the height field."""
    v = voxels(spark, d).select((F.col("ix") * 484 + F.col("iy") * 22 + F.col("iz")).alias("n"), "grid", (F.col("ix") * 1.9 + 0.3).alias("x"), (F.col("iy") * 2.3 + 0.2).alias("y"), (F.col("iz") * 0.15 - 0.9).alias("z"))
    return v.groupBy("n", "x", "y", "z").agg(F.count("*").alias("grids")).withColumnRenamed("n", "id")


@query("closest_on_mesh")
def closest_on_mesh(spark, d):
    return rounded(search.closest_on_mesh(over_mesh(spark, d), *surface_mesh(spark, d)), "d2", "u", "v", "w")


@query("ray_hits", VOX + MESH.replace("WITH v AS", ", v AS") + ", r AS (SELECT DISTINCT ix * 22 + iy AS q, ix * 1.9e0 + 0.3e0 AS x, iy * 2.3e0 + 0.2e0 AS y FROM vox), b AS (SELECT r.*, c.*, ux * wy - uy * wx AS det, (r.x - ax) * wy - (r.y - ay) * wx AS s, ux * (r.y - ay) - uy * (r.x - ax) AS t FROM r JOIN c ON r.x BETWEEN least(ax, ax + ux, ax + wx) AND greatest(ax, ax + ux, ax + wx) AND r.y BETWEEN least(ay, ay + uy, ay + wy) AND greatest(ay, ay + uy, ay + wy)), h AS (SELECT q, fid, s / det AS s, t / det AS t, 4 - (az + s / det * uz + t / det * wz) AS far FROM b), k AS (SELECT q, min((round(far, 9), fid)) AS m FROM h WHERE s >= -1e-9 AND t >= -1e-9 AND s + t <= 1 + 1e-9 GROUP BY q) SELECT q, m[2] AS face, round(m[1], 6) AS t FROM k")
def ray_hits(spark, d):
    """Straight down from above the columns of the voxels onto the height field."""
    down = voxels(spark, d).select((F.col("ix") * 22 + F.col("iy")).alias("id"), (F.col("ix") * 1.9 + 0.3).alias("x"), (F.col("iy") * 2.3 + 0.2).alias("y"), F.lit(4.0).alias("z"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1.0).alias("dz")).distinct()
    return rounded(search.ray_hits(down, *surface_mesh(spark, d)).select("q", "face", "t"), "t")


# --- neighbourhoods and paths ----------------------------------------------------------------

_HOPS = MESH + ", w AS (SELECT a, b, sqrt((p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2) AS w FROM e JOIN v p ON p.vid = a JOIN v q ON q.vid = b), n AS (SELECT a, b, w FROM w UNION ALL SELECT b, a, w FROM w), hops AS (SELECT vid AS a, vid AS b, 0e0 AS d FROM v UNION ALL SELECT a, b, w FROM n WHERE w <= 2.4e0 UNION ALL SELECT s.a, t.b, s.w + t.w FROM n s JOIN n t ON t.a = s.b WHERE s.w + t.w <= 2.4e0), hood AS (SELECT a, b, min(d) AS d FROM hops GROUP BY a, b)"


def _heights(v):
    return v.select("mesh", "vid", F.col("z").alias("value"))


@query("property_strength", _HOPS + ", g AS (SELECT a, sum(exp(-d * d / (2 * 0.8e0 * 0.8e0)) * z) / sum(exp(-d * d / (2 * 0.8e0 * 0.8e0))) AS m FROM hood JOIN v ON vid = b GROUP BY a) SELECT 'part' AS mesh, vid, round(z * abs(z - m), 6) AS value FROM v JOIN g ON g.a = vid")
def property_strength(spark, d):
    """Heights times the size of their difference of Gaussians (0.8 along edges); no path within the limit has over two edges."""
    v, f = surface_mesh(spark, d)
    return rounded(geodesics.strength(_heights(v), v, mesh.edges(f), 0.8), "value")


@query("suppress_non_maxima", _HOPS + ", g AS (SELECT a, max(z) AS top FROM (SELECT a, b FROM hood UNION SELECT a, b FROM n) JOIN v ON vid = b GROUP BY a) SELECT 'part' AS mesh, vid, CASE WHEN z >= top THEN round(z, 6) END AS value FROM v JOIN g ON g.a = vid")
def suppress_non_maxima(spark, d):
    """Heights that nothing within 2.4 along edges exceeds; the others are unknown."""
    v, f = surface_mesh(spark, d)
    return rounded(geodesics.extrema_within(_heights(v), v, mesh.edges(f), 2.4, minima=False), "value")


@query("geodesic_paths")
def geodesic_paths(spark, d):
    """The paths from all vertices back to the first one."""
    v, f = surface_mesh(spark, d)
    e = checkpointed(mesh.edges(f))
    dist = mesh.geodesic(v, e, v.where("vid = 0"))
    return rounded(geodesics.trace_paths(geodesics.predecessors(dist, v, e), dist), "gone")


# --- robust plane models ---------------------------------------------------------------------

_TURN = {"A": (0.9, 0.1, 0.2), "N": (1.1, -0.2, -0.1), "R": (1.0, 0.3, 0.4)}  # by cloud: scale, shear, shift
_PLANTED = PTS.replace("SELECT l_returnflag AS cloud", "SELECT DISTINCT l_returnflag AS cloud, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line") + ", h AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {a}e0, {b}e0, {s}e0)" for c, (a, b, s) in _TURN.items()) + ") t(cloud, a, b, s)), m AS (SELECT p.*, (p.x * h.a + p.y * h.b + h.s) / (0.05e0 * p.x - 0.04e0 * p.y + 1) AS u, (p.y * h.a - p.x * h.b) / (0.05e0 * p.x - 0.04e0 * p.y + 1) AS v FROM pts p JOIN h USING (cloud))"


def planted_matches(spark, d):
    """Points of each cloud with their places under a homography; those of lines 5 to 7 are moved away."""
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cloud"), (F.col("l_quantity") * 0.02).alias("px"), (F.col("l_extendedprice") * 1e-5).alias("py"), F.col("l_discount").alias("dz"), "l_partkey", "l_suppkey", "l_linenumber").distinct()
    pick = lambda k: F.coalesce(*[F.when(F.col("cloud") == c, F.lit(t[k])) for c, t in _TURN.items()])
    w = 0.05 * F.col("px") - 0.04 * F.col("py") + 1
    far = F.when(F.col("l_linenumber") > 4, 1.0 + F.col("l_partkey") % 7).otherwise(0.0)
    q = p.withColumns({"qx": (F.col("px") * pick(0) + F.col("py") * pick(1) + pick(2)) / w + far, "qy": (F.col("py") * pick(0) - F.col("px") * pick(1)) / w - far * 0.5})
    return q.withColumn("k", F.concat_ws(":", "l_partkey", "l_suppkey", "l_linenumber", "px", "py", "dz"))


@query("ransac_homography", _PLANTED + " SELECT cloud, count(*) AS n, count(*) FILTER (WHERE line <= 4) AS inliers, round(max(a), 4) AS h00, round(max(b), 4) AS h01, round(max(s), 4) AS h02, round(-max(b), 4) AS h10, round(max(a), 4) AS h11, 0.05e0 AS h20, -0.04e0 AS h21 FROM m JOIN h USING (cloud) GROUP BY cloud")
def ransac_homography(spark, d):
    got = consensus.consensus(planted_matches(spark, d), "cloud", "k", consensus.HOMOGRAPHY, 1e-6)
    h = [F.col("params")[i] / F.col("params")[8] for i in range(9)]
    return rounded(got.select("cloud", "n", "inliers", *[h[i].alias(f"h{i // 3}{i % 3}") for i in (0, 1, 2, 3, 4, 6, 7)]), "h00", "h01", "h02", "h10", "h11", "h20", "h21", n=4)


# --- modes and histograms --------------------------------------------------------------------


@query("grid_mean_shift")
def grid_mean_shift(spark, d):
    """The modes of the tall voxels of each grid."""
    return meanshift.mean_shift(tall(spark, d), DIMS)


@query("point_histograms")
def point_histograms(spark, d):
    """Histograms of the cells of the clouds with the normals of their fields; neighbours are those up to the corners of a cell away."""
    i = [F.round(F.col(c) / 0.1).cast("long").alias(a) for c, a in zip("xyz", voxel.AXES, strict=True)]
    v = points(spark, d).groupBy(F.col("cloud").alias("grid"), *i).agg(F.count("*").cast("double").alias("value"))
    cloud = F.ascii("grid").cast("bigint") * 1000  # the clouds beside each other, far apart
    n = voxel.field_normals(v).where("nx IS NOT NULL").select((cloud * 1_000_000 + (F.col("iz") * 1000 + F.col("iy")) * 1000 + F.col("ix")).alias("id"), (F.col("ix") + cloud).cast("double").alias("x"), *[F.col(f"i{c}").cast("double").alias(c) for c in "yz"], "nx", "ny", "nz")
    n = checkpointed(n)
    own = n.select("id", "x", "y", "z")
    pairs = knn.range_join(own, own, 1.75).where("a_id <> b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return descriptors.fpfh(n, pairs).withColumn("histogram", F.transform("histogram", lambda x: F.round(x, 6)))
