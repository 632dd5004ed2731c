"""Distance fields with sources, meshes as cells, and level surfaces, against plain versions."""

import collections
import random
from fractions import Fraction

import numpy as np
import pytest

from fusionframe.operators import distance, isosurface


def test_line_equals_brute_force():
    rng = np.random.default_rng(1)
    for n, m, top in ((1, 1, 3), (7, 3, 9), (64, 64, 40), (200, 30, 500), (333, 5, 4)):
        at = np.sort(rng.choice(n, m, replace=False))
        value = rng.integers(0, top, m)
        cost = value[None, :] + (np.arange(n)[:, None] - at[None, :]) ** 2
        assert (distance.nearest_on_line(at, value, n) == cost.argmin(1)).all()


def test_long_line():
    rng = np.random.default_rng(2)
    n = 100_000
    at, value = np.arange(n), rng.integers(0, 10_000, n)
    best = distance.nearest_on_line(at, value, n)
    assert (np.diff(best) >= 0).all()
    for i in rng.integers(0, n, 50):
        near = slice(max(0, i - 200), i + 201)
        assert value[best[i]] + (i - best[i]) ** 2 == (value[near] + (i - at[near]) ** 2).min()


def test_voronoi(spark):
    rng = random.Random(3)
    dims = (9, 70, 6)
    cells = {(rng.choice("ab"), rng.randrange(9), rng.randrange(70), rng.randrange(6)) for _ in range(14)}
    rows = [(*c, float(k + 1)) for k, c in enumerate(sorted(cells))] + [("a", 0, 0, 0, 0.0), ("empty", 1, 1, 1, 0.0)]
    got = distance.voronoi(spark.createDataFrame(rows, "grid string, ix long, iy long, iz long, value double"), dims).collect()
    assert len(got) == len({r[0] for r in rows[:-2]}) * 9 * 70 * 6
    value = {r[:4]: r[4] for r in rows}
    for r in got:
        d2, source = min(((r.ix - x) ** 2 + (r.iy - y) ** 2 + (r.iz - z) ** 2, (g, x, y, z)) for g, x, y, z in cells if g == r.grid)
        assert (r.d2, r.value) == (d2, value[source])


def plain_cells(p):
    """Cells of one triangle of whole corners, level by level, in fractions."""
    size = [max(c) - min(c) for c in zip(*p)]
    d = 1 if size[1] > max(size[0], size[2]) else 2 if size[2] > size[0] else 0
    top, mid, low = sorted(p, key=lambda c: -c[d])
    move = lambda a, b, i, n: [x + int(Fraction((y - x) * i, n)) for x, y in zip(a, b)]
    out = set()

    def line(a, b):
        n = max(abs(x - y) for x, y in zip(a, b))
        out.update(tuple(move(a, b, i, n)) for i in range(n + 1)) if n else out.add(tuple(a))

    n = top[d] - low[d]
    for i in range(top[d] - mid[d]):
        line(move(top, mid, i, top[d] - mid[d]), move(top, low, i, n))
    if mid[d] == low[d]:
        line(mid, low)
        return out
    side = top if top[d] == mid[d] else move(top, low, top[d] - mid[d], n)
    for i in range(mid[d] - low[d] + 1):
        a, b = move(mid, low, i, mid[d] - low[d]), move(side, low, i, mid[d] - low[d])
        line(*((b, a) if top[d] == mid[d] else (a, b)))
    return out


def test_triangle_cells(spark):
    rng = random.Random(4)
    tris = [[tuple(rng.randint(-3, s) for s in size) for _ in range(3)] for size in ((12, 12, 12), (30, 4, 4), (3, 40, 9), (5, 5, 25), (2, 2, 2), (0, 6, 6)) for _ in range(25)]
    tris += [[(1, 2, 3)] * 3, [(0, 0, 0), (0, 0, 0), (5, 3, 9)]]
    df = spark.createDataFrame([(str(k), *t) for k, t in enumerate(tris)], "grid string, " + ", ".join(f"p{k} struct<x:long,y:long,z:long>" for k in range(3)))
    got = collections.defaultdict(set)
    for r in distance.rasterize_triangles(df).collect():
        got[int(r.grid)].add((r.ix, r.iy, r.iz))
    assert all(got[k] == plain_cells(t) for k, t in enumerate(tris))
    # Every cell lies near its triangle: within a cell of its plane, and in its box.
    for k, t in enumerate(tris):
        c = np.array(sorted(got[k])) - t[0]
        normal = np.cross(np.subtract(t[1], t[0]), np.subtract(t[2], t[0])).astype(float)
        if normal.any():
            assert (abs(c @ normal) / np.linalg.norm(normal)).max() < 2
        assert (c >= np.min(t, 0) - t[0]).all() and (c <= np.max(t, 0) - t[0]).all()


def tetrahedra(spark):
    v = [("t", k, float(x), float(y), float(z)) for k, (x, y, z) in enumerate([(0, 0, 0), (3, 0, 0), (0, 2, 0), (0, 0, 1)])]
    v += [("flat", k, float(k), float(k * k), 0.0) for k in range(3)]
    f = [("t", 0, 0, 2, 1), ("t", 1, 0, 1, 3), ("t", 2, 0, 3, 2), ("t", 3, 1, 2, 3), ("flat", 0, 0, 1, 2)]
    return spark.createDataFrame(v, "mesh string, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh string, fid long, v0 long, v1 long, v2 long")


def test_mesh_to_df(spark):
    v, f = tetrahedra(spark)
    grids = distance.mesh_grid(v, 0.1, 3, 20).collect()
    assert [(g.grid, g.n_ix, g.n_iy, g.n_iz) for g in grids] == [("t", 26, 19, 13)] and grids[0].spacing == pytest.approx(0.15)
    g = grids[0]
    points = {r.vid: [int((c - m) * g.scale + 0.5 * (n - 1) + 0.5) for c, m, n in zip((r.x, r.y, r.z), (g.c_x, g.c_y, g.c_z), (26, 19, 13))] for r in v.where("mesh = 't'").collect()}
    cells = set().union(*[plain_cells([tuple(points[k]) for k in (r.v0, r.v1, r.v2)]) for r in f.where("mesh = 't'").collect()])
    got = {(r.ix, r.iy, r.iz): r.value for r in distance.mesh_to_df(v, f, 0.1, 3, 20, 4.5).collect()}
    at = np.array(sorted(cells))
    assert len(got) == 26 * 19 * 13
    for c, value in got.items():
        assert value == min(4.5, np.sqrt(((at - c) ** 2).sum(1).min()))


def test_case_table():
    table = isosurface.case_table()
    assert len(table) == 256 and not table[0] and not table[255] and max(map(len, table)) < 16
    for case, triangles in enumerate(table):
        high = lambda k: case >> k & 1  # noqa: E731, B023
        crossed = {(k, a) for k in range(8) for a in range(3) if not k >> a & 1 and high(k) != high(k | 1 << a)}
        assert {e for t in triangles for e in t} == crossed


def closed(faces):
    sides = collections.Counter((a, b) for f in faces for a, b in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])))
    return all(n == 1 and sides[b, a] == 1 for (a, b), n in sides.items())


@pytest.mark.parametrize("iso", [0.5, 2.0, -1.0])
def test_isosurface(spark, iso):
    """Of random values off the border: closed, each side in two faces, and every grid edge that passes the level has its vertex."""
    rng = random.Random(5)
    dims = (7, 6, 8)
    rows = [("g", x, y, z, rng.choice([-2.0, 1.0, 2.0, 3.0])) for x in range(1, 6) for y in range(1, 5) for z in range(1, 7) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "grid string, ix long, iy long, iz long, value double")
    v = {r.vid: (r.x, r.y, r.z) for r in isosurface.iso_vertices(df, iso, dims).collect()}
    f = [(r.v0, r.v1, r.v2) for r in isosurface.iso_faces(df, iso, dims).collect()]
    value = collections.defaultdict(float, {r[1:4]: r[4] for r in rows})
    want = {}
    for x in range(7):
        for y in range(6):
            for z in range(8):
                for a, (i, j, k) in enumerate(((1, 0, 0), (0, 1, 0), (0, 0, 1))):
                    p, q = value[x, y, z], value[x + i, y + j, z + k]
                    if x + i < 7 and y + j < 6 and z + k < 8 and (p >= iso) != (q >= iso):
                        t = (iso - p) / (q - p)
                        want[((z * 6 + y) * 7 + x) * 3 + a] = (x + t * i, y + t * j, z + t * k)
    assert v == want and {k for t in f for k in t} == set(v)
    assert closed(f)
    volume = sum(np.dot(v[a], np.cross(v[b], v[c])) for a, b, c in f) / 6
    assert volume > 0 if iso > 0 else volume < 0  # normals point away from high values; outside is 0


def test_isosurface_sphere(spark):
    n = 15
    rows = [("s", x, y, z, 5.0 - ((x - 7) ** 2 + (y - 7) ** 2 + (z - 7) ** 2) ** 0.5 + 10) for x in range(n) for y in range(n) for z in range(n)]
    df = spark.createDataFrame(rows, "grid string, ix long, iy long, iz long, value double")
    v = isosurface.iso_vertices(df, 10.0, (n, n, n)).collect()
    f = [(r.v0, r.v1, r.v2) for r in isosurface.iso_faces(df, 10.0, (n, n, n)).collect()]
    assert all(abs(np.linalg.norm(np.subtract((r.x, r.y, r.z), 7)) - 5) < 0.1 for r in v)
    assert closed(f) and len(v) - len({tuple(sorted(s)) for t in f for s in zip(t, t[1:] + t[:1])}) + len(f) == 2
    assert isosurface.iso_faces(df.limit(0), 1.0, (n, n, n)).count() == 0
