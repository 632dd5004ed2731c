"""Triangle meshes as tables: vertex (mesh, vid, x, y, z), face (mesh, fid, v0, v1, v2); per-vertex properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..plans.checkpoint import checkpointed

BLOCK = 4096


def property_stats(values: DataFrame, by: str, value: str, percent: float) -> DataFrame:
    """n, mean, low, high, stddev (by n), l1, l2, and the value at sorted index int(n * percent / 100)."""
    v = F.col(value)
    w = Window.partitionBy(by)
    s = values.withColumn("k", F.row_number().over(w.orderBy(value)) - 1).withColumn("size", F.count("*").over(w))
    pick = F.max(F.when(F.col("k") == F.floor(F.col("size") * percent / 100), v))
    return s.groupBy(by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("stddev"), F.sum(F.abs(v)).alias("l1"), F.sqrt(F.sum(v * v)).alias("l2"), pick.alias(f"p{int(percent)}"))


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    out = faces
    for k in range(3):
        own = vertices.select("mesh", F.col("vid").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
        out = out.join(own, ["mesh", f"v{k}"])
    return out


def _corner(k: int):
    return tuple(F.col(f"{c}{k}") for c in "xyz")


def face_measures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh, fid, area, normal and centre of each face."""
    c = corners(vertices, faces)
    a, b, d = (_corner(k) for k in range(3))
    area = geom.triangle_area(a, b, d)
    n = geom.cross(geom.sub(b, a), geom.sub(d, a))
    size = F.sqrt(geom.norm2(n))
    return c.select("mesh", "fid", "v0", "v1", "v2", area.alias("area"), *[F.when(size > 0, n[i] / size).alias(f"n{x}") for i, x in enumerate("xyz")], *[((a[i] + b[i] + d[i]) / 3).alias(f"c{x}") for i, x in enumerate("xyz")])


def mesh_stats(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh, area, area-weighted centroid, mean edge length."""
    f = face_measures(vertices, faces)
    out = f.groupBy("mesh").agg(F.sum("area").alias("area"), *[F.try_divide(F.sum(F.col("area") * F.col(f"c{x}")), F.sum("area")).alias(x) for x in "xyz"])
    e = edges(faces)
    ends = e
    for s in "ab":
        ends = ends.join(vertices.select("mesh", F.col("vid").alias(s), *[F.col(c).alias(f"{s}{c}") for c in "xyz"]), ["mesh", s])
    length = F.sqrt(geom.norm2([F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]))
    return out.join(ends.groupBy("mesh").agg(F.avg(length).alias("mean_edge")), "mesh", "left")


def edges(faces: DataFrame) -> DataFrame:
    """mesh, a < b: undirected edges, once each."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    return faces.select("mesh", F.explode(pairs).alias("e")).select("mesh", "e.a", "e.b").distinct()


def vertex_area(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """A third of the areas of the faces around each vertex."""
    f = face_measures(vertices, faces)
    return f.select("mesh", F.explode(F.array("v0", "v1", "v2")).alias("vid"), "area").groupBy("mesh", "vid").agg((F.sum("area") / 3).alias("area"))


def gauss_curvature(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """3 (2 pi - sum of angles) / sum of face areas at each vertex; null without area. Corners of faces without sides have no angle."""
    import math

    c = corners(vertices, faces)
    area = geom.triangle_area(*[_corner(k) for k in range(3)])
    rows = []
    for k in range(3):
        u, v = geom.sub(_corner((k + 1) % 3), _corner(k)), geom.sub(_corner((k + 2) % 3), _corner(k))
        cos = F.try_divide(geom.dot(u, v), F.sqrt(geom.norm2(u) * geom.norm2(v)))
        rows.append(F.struct(F.col(f"v{k}").alias("vid"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))).alias("angle"), area.alias("area")))
    around = c.select("mesh", F.explode(F.array(*rows)).alias("r")).groupBy("mesh", "r.vid").agg(F.sum("r.angle").alias("angle"), F.sum("r.area").alias("area"))
    return around.select("mesh", "vid", F.try_divide(3 * (2 * math.pi - F.col("angle")), F.col("area")).alias("curvature"))


def local_extrema(values: DataFrame, edge: DataFrame, maxima: bool = True) -> DataFrame:
    """Vertices strictly beyond every neighbour."""
    both = edge.union(edge.select("mesh", "b", "a")).toDF("mesh", "vid", "other")
    near = both.join(values.select("mesh", F.col("vid").alias("other"), F.col("value").alias("v")), ["mesh", "other"]).groupBy("mesh", "vid").agg((F.max if maxima else F.min)("v").alias("v"))
    j = values.join(near, ["mesh", "vid"])
    return j.where(F.col("value") > F.col("v") if maxima else F.col("value") < F.col("v")).select("mesh", "vid", "value")


def smooth(vertices: DataFrame, edge: DataFrame, amount: float = 0.5) -> DataFrame:
    """Moves each vertex towards the mean of its neighbours."""
    both = edge.union(edge.select("mesh", "b", "a")).toDF("mesh", "vid", "other")
    mean = both.join(vertices.select("mesh", F.col("vid").alias("other"), *"xyz"), ["mesh", "other"]).groupBy("mesh", "vid").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    return vertices.join(mean, ["mesh", "vid"], "left").select("mesh", "vid", *[F.coalesce(F.col(c) + amount * (F.col(f"m{c}") - F.col(c)), F.col(c)).alias(c) for c in "xyz"])


def merge_coincident(vertices: DataFrame, faces: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """One vertex for each cell (the smallest id), faces renamed, those that collapse dropped."""
    cell = [F.round(F.col(c) / size) for c in "xyz"]
    to = vertices.select("mesh", "vid", F.min("vid").over(Window.partitionBy("mesh", *cell)).alias("new"))
    kept = vertices.join(to.where("vid = new").select("mesh", "vid"), ["mesh", "vid"], "left_semi")
    out = faces
    for k in range(3):
        out = out.join(to.select("mesh", F.col("vid").alias(f"v{k}"), F.col("new").alias(f"n{k}")), ["mesh", f"v{k}"])
    out = out.select("mesh", "fid", *[F.col(f"n{k}").alias(f"v{k}") for k in range(3)]).where("v0 <> v1 AND v1 <> v2 AND v2 <> v0")
    return kept, out


def delete_unused(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    used = faces.select("mesh", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return vertices.join(used, ["mesh", "vid"], "left_semi")


def _shortest(out: dict, starts: dict, most: float) -> dict:
    """The distances that starts (vertex: distance) give along out (vertex: ways)."""
    import heapq

    low, heap = dict(starts), [(d, v) for v, d in starts.items()]
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if d > low[v]:
            continue
        for b, w in out.get(v, ()):
            new = d + w
            if new <= most and new < low.get(b, float("inf")):
                low[b] = new
                heapq.heappush(heap, (new, b))
    return low


def _of_block(known, ways, size: int) -> tuple[dict, dict, set]:
    """starts, the ways inside a block, and the vertices of ways that leave it, from the Arrow tables of a block."""
    starts: dict[int, float] = {}
    for v, d in zip(known["vid"].to_pylist(), known["dist"].to_pylist(), strict=True):
        starts[v] = min(d, starts.get(v, d))
    out: dict[int, list] = {}
    border = set()
    for a, b, w in zip(ways["a"].to_pylist(), ways["b"].to_pylist(), ways["w"].to_pylist(), strict=True):
        if a // size == b // size:
            out.setdefault(a, []).append((b, w))
        else:
            border.add(a)
    return starts, out, border


def geodesic(vertices: DataFrame, edge: DataFrame, sources: DataFrame, most: float = float("inf"), block: int = BLOCK) -> DataFrame:
    """mesh, vid, dist: shortest paths along edges from the nearest source (mesh, vid).

    Vertices are cut into blocks of `block` successive ids. The shortest ways inside a block between the vertices at its border stand for
    the block, and with the edges between blocks they make a smaller graph, whose blocks are larger; so the levels grow as the logarithm of
    the mesh. The smallest graph is solved, and each level hands its distances to the blocks below. A graph that doesn't
    get smaller, as its ids say little of who is near, is solved by rounds between its blocks.
    """
    ends = edge
    for s in "ab":
        ends = ends.join(vertices.select("mesh", F.col("vid").alias(s), *[F.col(c).alias(f"{s}{c}") for c in "xyz"]), ["mesh", s])
    ends = ends.select("mesh", "a", "b", F.sqrt(geom.norm2([F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"])).alias("w"))
    ways = checkpointed(ends.union(ends.select("mesh", "b", "a", "w")).select("mesh", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "w").where(F.col("w") <= most))
    known = checkpointed(sources.select("mesh", F.col("vid").cast("long").alias("vid"), F.lit(0.0).alias("dist")).distinct())
    kind = vertices.schema["mesh"].dataType.simpleString()

    def blocks(known: DataFrame, ways: DataFrame, size: int, f, schema: str) -> DataFrame:
        left = known.select("mesh", "vid", "dist", F.floor(F.col("vid") / size).alias("block"))
        right = ways.select(F.col("mesh").alias("own"), "a", "b", "w", F.floor(F.col("a") / size).alias("at"))
        return left.groupBy("mesh", "block").cogroup(right.groupBy("own", "at")).applyInArrow(f, schema)

    def climb(size: int):
        def run(key, known, ways):
            import pyarrow as pa

            starts, out, border = _of_block(known, ways, size)
            rows = [(None, v, d) for v, d in _shortest(out, starts, most).items() if v in border]
            for a in sorted(border):
                rows += [(a, b, d) for b, d in _shortest(out, {a: 0.0}, most).items() if b != a and b in border]
            a, b, w = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.table({"mesh": pa.array([key[0].as_py()] * len(rows), key[0].type), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "w": pa.array(w, pa.float64())})

        return run

    def settle(size: int):
        def run(key, known, ways):
            import pyarrow as pa

            starts, out, _ = _of_block(known, ways, size)
            low = _shortest(out, starts, most)
            return pa.table({"mesh": pa.array([key[0].as_py()] * len(low), key[0].type), "vid": pa.array(list(low), pa.int64()), "dist": pa.array(list(low.values()), pa.float64())})

        return run

    below, size = [], block
    while True:
        away = F.floor(F.col("a") / size) != F.floor(F.col("b") / size)
        n, borders = ways.groupBy("mesh", "a").agg(F.max(away).alias("away")).agg(F.count("*"), F.count_if("away")).first()
        if 2 * borders > n or not borders:
            break
        step = checkpointed(blocks(known, ways, size, climb(size), f"mesh {kind}, a bigint, b bigint, w double"))
        below.append((known, ways, size))
        known = step.where("a IS NULL").select("mesh", F.col("b").alias("vid"), F.col("w").alias("dist"))
        ways = step.where("a IS NOT NULL").unionByName(ways.where(away))
        size *= n // borders
    dist = f"mesh {kind}, vid bigint, dist double"
    known = checkpointed(blocks(known, ways, size, settle(size), dist)) if not borders else _by_rounds(known, ways, size, most, kind)
    for own, ways, size in reversed(below):
        known = checkpointed(blocks(own.unionByName(known), ways, size, settle(size), dist))
    return known


def _by_rounds(known: DataFrame, ways: DataFrame, block: int, most: float, kind: str) -> DataFrame:
    """mesh, vid, dist. A round follows all paths inside the blocks that a shorter way has come into, and hands on what leaves them, until nothing falls."""
    at = lambda c: F.floor(F.col(c) / block).cast("long").alias("block")
    ways = checkpointed(ways.select("mesh", "a", "b", "w", at("a")))
    dist = checkpointed(known.groupBy("mesh", "vid").agg(F.min("dist").alias("dist")).withColumn("fresh", F.lit(True)))

    def follow(known, ways):
        import heapq

        import pyarrow as pa

        types = pa.schema([known.schema.field("mesh"), ("vid", pa.int64()), ("new", pa.float64()), ("inside", pa.bool_())])
        if not len(known):
            return types.empty_table()
        known, ways = known.to_pydict(), ways.to_pydict()
        mine = known["vid"][0] // block
        low = dict(zip(known["vid"], known["dist"], strict=True))
        out: dict[int, list] = {}
        for a, b, w in zip(ways["a"], ways["b"], ways["w"], strict=True):
            out.setdefault(a, []).append((b, w))
        heap = [(d, v) for v, d, fresh in zip(known["vid"], known["dist"], known["fresh"], strict=True) if fresh]
        heapq.heapify(heap)
        fell: dict[int, float] = {}
        while heap:
            d, v = heapq.heappop(heap)
            if d > low[v]:
                continue
            for b, w in out.get(v, ()):
                new = d + w
                if new <= most and new < low.get(b, float("inf")):
                    low[b] = fell[b] = new
                    if b // block == mine:
                        heapq.heappush(heap, (new, b))
        rows = {"mesh": known["mesh"][:1] * len(fell), "vid": list(fell), "new": list(fell.values()), "inside": [b // block == mine for b in fell]}
        return pa.table(rows, schema=types)

    schema = f"mesh {kind}, vid bigint, new double, inside boolean"
    while not dist.where("fresh").isEmpty():
        own = dist.select("*", at("vid")).withColumn("open", F.max("fresh").over(Window.partitionBy("mesh", "block"))).where("open").drop("open")
        step = own.groupBy("mesh", "block").cogroup(ways.groupBy("mesh", "block")).applyInArrow(follow, schema)
        step = step.groupBy("mesh", "vid").agg(F.min(F.when(F.col("inside"), F.col("new"))).alias("here"), F.min(F.when(~F.col("inside"), F.col("new"))).alias("there"))
        low = F.least("dist", "here")
        dist = checkpointed(dist.join(step, ["mesh", "vid"], "full").select("mesh", "vid", F.least("dist", "here", "there").alias("dist"), (F.col("there").isNotNull() & (low.isNull() | (F.col("there") < low))).alias("fresh")))
    return dist.drop("fresh")


def random_points(vertices: DataFrame, faces: DataFrame, a: Column, b: Column) -> DataFrame:
    """A point on each face, evenly spread where a and b are two independent numbers in [0, 1) for it."""
    c = corners(vertices, faces)
    root = F.sqrt(a)
    shares = (1 - root, root * (1 - b), root * b)
    p = [sum((s * corner[i] for s, corner in zip(shares, [_corner(k) for k in range(3)], strict=True)), F.lit(0.0)) for i in range(3)]
    return c.select("mesh", "fid", *[x.alias(n) for x, n in zip(p, "xyz", strict=True)])


def connected(vertices: DataFrame, edge_table: DataFrame, seeds: DataFrame) -> DataFrame:
    """The vertices that paths from the seeds reach."""
    return geodesic(vertices, edge_table, seeds).where("dist IS NOT NULL").select("mesh", "vid")


def normalisation(points: DataFrame, by: str) -> DataFrame:
    """by, centroid and the inverse mean distance to it: what carries a cloud to the origin at unit mean radius."""
    c = points.groupBy(by).agg(*[F.avg(x).alias(f"c{x}") for x in "xyz"])
    r = F.sqrt(sum(((F.col(x) - F.col(f"c{x}")) * (F.col(x) - F.col(f"c{x}")) for x in "xyz"), F.lit(0.0)))
    return points.join(c, by).groupBy(by, "cx", "cy", "cz").agg(F.avg(r).alias("radius")).select(by, "cx", "cy", "cz", F.try_divide(F.lit(1.0), F.col("radius")).alias("scale"))
