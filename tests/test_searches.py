"""Best-first searches, neighbourhoods along edges and traced paths, against plain loops."""

import heapq
import random

import numpy as np
import pytest

from fusionframe.operators import geodesics, mesh, search

POINT = "id long, x double, y double, z double, kind int"


def cloud(rng, n, spread):
    rows = []
    for i in range(n):
        c = rng.choice([(0.0, 0.0, 0.0), (10.0, 0.0, 0.0), (0.5, 0.5, 0.5)])
        rows.append((i, *[round(rng.gauss(m, spread), 3) for m in c], rng.randrange(9)))
    return rows + [(n + k, 1.0, 1.0, 1.0, k % 3) for k in range(60)] + [(n + 100, None, 0.0, 0.0, 1)]


@pytest.mark.parametrize("leaf,most,least,kinds", [(32, float("inf"), 0.0, None), (2, float("inf"), 0.0, "same"), (4, 3.0, 0.5, None), (3, float("inf"), 0.0, "rare")])
def test_nearest(spark, leaf, most, least, kinds):
    rng = random.Random(6)
    a, b = cloud(rng, 80, 2.0), cloud(rng, 300, 0.4)
    fits = {None: lambda p, q: True, "same": lambda p, q: p[4] == q[4], "rare": lambda p, q: q[0] % 97 == p[0] % 3}[kinds]
    match = {None: None, "same": lambda p, q: p("kind") == q("kind"), "rare": lambda p, q: q("id") % 97 == p("id") % 3}[kinds]
    got = {r.q: (r.item, r.d2) for r in search.nearest(spark.createDataFrame(a, POINT), spark.createDataFrame(b, POINT), match, least, most, leaf).collect()}
    want = {}
    for p in a:
        near = [(round(sum((s - t) ** 2 for s, t in zip(p[1:4], q[1:4])), 9), q[0]) for q in b if p[1] is not None and q[1] is not None and fits(p, q)]
        near = [x for x in near if least * least <= x[0] <= most * most]
        if near:
            want[p[0]] = min(near)[::-1]
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)


def test_nearest_empty(spark):
    rows = spark.createDataFrame(cloud(random.Random(1), 3, 1.0), POINT)
    assert search.nearest(rows, rows.limit(0)).count() == search.nearest(rows.limit(0), rows).count() == 0


def bumpy(spark, n=12):
    rng = random.Random(9)
    v = [("m", i * n + j, float(i), float(j), rng.random() * 2) for i in range(n) for j in range(n)]
    f = []
    for i in range(n - 1):
        for j in range(n - 1):
            a = i * n + j
            f += [("m", len(f), a, a + n, a + 1), ("m", len(f) + 1, a + n, a + n + 1, a + 1)]
    f.append(("m", len(f), 0, 0, 0))  # a face without area
    return v, f, spark.createDataFrame(v, "mesh string, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh string, fid long, v0 long, v1 long, v2 long")


def to_segment(p, a, b):
    s = b - a
    t = np.clip(np.dot(p - a, s) / np.dot(s, s), 0, 1) if s.any() else 0
    return a + t * s


def to_triangle(p, a, b, c):
    """The nearest point, by the foot on the plane or the sides."""
    n = np.cross(b - a, c - a)
    if n.any():
        foot = p - n * np.dot(p - a, n) / np.dot(n, n)
        if all(np.dot(np.cross(y - x, foot - x), n) >= 0 for x, y in ((a, b), (b, c), (c, a))):
            return foot
    return min((to_segment(p, x, y) for x, y in ((a, b), (b, c), (c, a))), key=lambda q: ((p - q) ** 2).sum())


@pytest.mark.parametrize("leaf", [2, 32])
def test_closest_on_mesh(spark, leaf):
    rng = random.Random(10)
    v, f, vs, fs = bumpy(spark)
    corner = {k[1]: np.array(k[2:]) for k in v}
    points = [(i, rng.uniform(-3, 14), rng.uniform(-3, 14), rng.uniform(-4, 6)) for i in range(60)] + [(99, 3.0, 4.0, float(corner[3 * 12 + 4][2])), (100, None, 0.0, 0.0)]
    got = {r.q: r for r in search.closest_on_mesh(spark.createDataFrame(points, "id long, x double, y double, z double"), vs, fs, leaf=leaf).collect()}
    assert len(got) == 61
    for i, *p in points[:-1]:
        d2 = {k[1]: ((p - to_triangle(np.array(p), *[corner[x] for x in k[2:]])) ** 2).sum() for k in f}
        r = got[i]
        assert r.d2 == pytest.approx(min(d2.values()), abs=2e-9) and d2[r.face] == pytest.approx(r.d2, abs=2e-9)
        at = sum(w * corner[x] for w, x in zip((r.u, r.v, r.w), f[r.face][2:]))
        assert ((at - p) ** 2).sum() == pytest.approx(r.d2, abs=1e-8) and min(r.u, r.v, r.w) >= -1e-9 and r.u + r.v + r.w == pytest.approx(1)
    near = search.closest_on_mesh(spark.createDataFrame(points, "id long, x double, y double, z double"), vs, fs, most=1.0).collect()
    assert {r.q for r in near} == {k for k, r in got.items() if r.d2 <= 1.0}


def test_ray_hits(spark):
    rng = random.Random(11)
    v, f, vs, fs = bumpy(spark)
    corner = {k[1]: np.array(k[2:]) for k in v}
    rays = [(i, rng.uniform(0, 11), rng.uniform(0, 11), 5.0, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice([-1.0, -0.2, 1.0])) for i in range(60)] + [(70, 5.3, 5.1, 9.0, 0.0, 0.0, -2.0), (71, 5.3, 5.1, 9.0, 0.0, 0.0, 0.0), (72, -5.0, 3.3, 0.9, 1.0, 0.0, 0.0)]
    got = {r.q: r for r in search.ray_hits(spark.createDataFrame(rays, "id long, x double, y double, z double, dx double, dy double, dz double"), vs, fs, leaf=3).collect()}
    for i, *o in rays:
        p, d = np.array(o[:3]), np.array(o[3:])
        hits = []
        for k in f:
            a, b, c = (corner[x] for x in k[2:])
            m = np.array([b - a, c - a, -d]).T
            if abs(np.linalg.det(m)) > 1e-12:
                s, t, r = np.linalg.solve(m, p - a)
                if s >= -1e-9 and t >= -1e-9 and s + t <= 1 + 1e-9 and r >= 0:
                    hits.append((r, k[1]))
        assert (i in got) == bool(hits)
        if hits:
            assert got[i].t == pytest.approx(min(hits)[0], abs=2e-9) and got[i].face in {k for t, k in hits if t < min(hits)[0] + 1e-8}
    assert 70 in got and 71 not in got and len(got) > 15


def dijkstra(edges, source, limit):
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, x = heapq.heappop(heap)
        if d > best[x]:
            continue
        for y, w in edges[x]:
            if d + w <= limit and d + w < best.get(y, float("inf")):
                best[y] = d + w
                heapq.heappush(heap, (d + w, y))
    return best


@pytest.fixture(scope="module")
def net(spark):
    v, f, vs, fs = bumpy(spark, 9)
    corner = {k[1]: np.array(k[2:]) for k in v}
    edges = {k[1]: {} for k in v}
    for _, _, *t in f[:-1]:
        for a, b in zip(t, t[1:] + t[:1]):
            edges[a][b] = edges[b][a] = float(np.linalg.norm(corner[a] - corner[b]))
    return {a: sorted(x.items()) for a, x in edges.items()}, vs, mesh.edges(fs.where("v0 <> v1"))


def test_neighbourhoods(spark, net):
    edges, vs, es = net
    got = {(r.source, r.vid): r.dist for r in geodesics.neighbourhoods(vs, es, 3.3).collect()}
    want = {(a, b): d for a in edges for b, d in dijkstra(edges, a, 3.3).items()}
    assert got == pytest.approx(want)


def test_property_filters(spark, net):
    edges, vs, es = net
    rng = random.Random(2)
    value = {a: None if rng.random() < 0.15 else rng.choice([0.0, 1.0, 2.5, -1.0, 4.0]) for a in edges}
    values = spark.createDataFrame([("m", a, x) for a, x in value.items()], "mesh string, vid long, value double")
    got = {r.vid: r.value for r in geodesics.strength(values, vs, es, 0.9).collect() if r.value is not None}
    for a, x in value.items():
        if x is not None:
            near = [(np.exp(-d * d / (2 * 0.81)), value[b]) for b, d in dijkstra(edges, a, 2.7).items() if value[b] is not None]
            assert got[a] == pytest.approx(x * abs(x - sum(w * y for w, y in near) / sum(w for w, _ in near)))
        else:
            assert a not in got
    for minima, maxima in ((True, True), (False, True)):
        kept = {r.vid: r.value for r in geodesics.extrema_within(values, vs, es, 2.2, minima, maxima).collect()}
        for a, x in value.items():
            near = [value[b] for b in {*dijkstra(edges, a, 2.2), *[b for b, _ in edges[a]]} if value[b] is not None]
            keeps = x is not None and ((minima and min(near) >= x) or (maxima and max(near) <= x))
            assert kept[a] == (x if keeps else None)


def test_paths(spark, net):
    edges, vs, es = net
    dist = mesh.geodesic(vs, es, vs.where("vid IN (0, 77)"))
    want = {r.vid: r.dist for r in dist.collect()}
    rows = geodesics.trace_paths(geodesics.predecessors(dist, vs, es), vs.select("mesh", "vid")).collect()
    paths = {}
    for r in sorted(rows, key=lambda r: r.hop):
        paths.setdefault(r.target, []).append((r.vid, r.gone))
    assert paths.keys() == want.keys()
    for t, p in paths.items():
        assert p[0] == (t, 0.0) and p[-1][0] in (0, 77) and p[-1][1] == pytest.approx(want[t])
        assert all(dict(edges[a])[b] == pytest.approx(e - d) for (a, d), (b, e) in zip(p, p[1:]))
