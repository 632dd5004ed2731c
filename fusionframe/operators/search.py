"""Best-first searches: the nearest point without a radius, the closest point on a mesh, the first face that a ray meets.

Things lie in a tree of cells. A cell with more than `leaf` things is cut into 4 x 4 x 4, so dense places are cut
further by their counts and empty ones not at all. A cell knows the box of its things and one of them
to try. All queries go down together, a level a round: a cell stays with a query only while the lower bound of its box is
not beyond the best that the query has met, which is the exact stop rule of a best-first search. At the end the
things of the cells that are left are tried. Every round is a join on cells; no thing and no query is ever collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..plans.checkpoint import checkpointed
from . import mesh

DEPTH = 10  # levels of two bits an axis
LEAF = 32
SLACK = 1e-9  # values are compared at nine digits
CELL = ("ux", "uy", "uz")
LOW, HIGH = ("lo_x", "lo_y", "lo_z"), ("hi_x", "hi_y", "hi_z")


def _at(level: int) -> list[Column]:
    return [F.shiftright(c, 2 * (DEPTH - level)).alias(f"c{c[1]}") for c in CELL]


class Tree:
    """The cells of things, level by level, and the things of the cells that aren't cut.

    things: item (a key), centre mx, my, mz, the box lo_x to hi_z, and columns of their own. Each level is a written table.
    """

    def __init__(self, things: DataFrame, leaf: int = LEAF):
        ends = things.agg(*[f(c) for c in ("mx", "my", "mz") for f in (F.min, F.max)]).first()  # six numbers
        low = [x or 0.0 for x in ends[::2]]
        unit = max([b - a for a, b in zip(ends[::2], ends[1::2]) if a is not None] or [0.0]) / 4**DEPTH or 1.0
        put = [F.least(F.floor((F.col(c) - a) / unit).cast("bigint"), F.lit(4**DEPTH - 1)).alias(u) for c, a, u in zip(("mx", "my", "mz"), low, CELL, strict=True)]
        self.columns = things.columns
        rest, self.nodes, self.leaves = things.select("*", *put), [], None
        for level in range(1, DEPTH + 1):
            rest = checkpointed(rest)
            boxes = [F.min(c).alias(c) for c in LOW] + [F.max(c).alias(c) for c in HIGH]
            cells = rest.groupBy(*_at(level)).agg(F.count("*").alias("n"), *boxes, F.min(F.struct("item", *[c for c in self.columns if c != "item"])).alias("rep"))
            cells = checkpointed(cells.withColumn("last", (F.col("n") <= leaf) | F.lit(level == DEPTH)))
            self.nodes.append(cells)
            tagged = rest.select("*", *_at(level)).join(cells.select("cx", "cy", "cz", "last"), ["cx", "cy", "cz"])
            done = tagged.where("last").select(*self.columns, F.lit(level).alias("level"), "cx", "cy", "cz")
            self.leaves = done if self.leaves is None else self.leaves.unionByName(done)
            rest = tagged.where("NOT last").select(*self.columns, *CELL)
            if cells.where("NOT last").isEmpty():
                break


def best_first(queries: DataFrame, tree: Tree, bound: Column, exact: Callable[[Callable[[str], Column]], Column], keep: list[str] | None = None) -> DataFrame:
    """q, item, the fields of exact's struct, and the item's columns in `keep`: for each query the item of the least value.

    queries: q (a key) and columns of their own. `bound` reads them and the box; it is never over the value of anything in the box,
    and null where nothing there can be meant. `exact(i)` is a struct whose first field is `value`, from the
    query's columns and the item's, i(name); null where the item isn't meant. Ties (at nine digits) go to the
    smallest item. Queries that mean nothing have no row.
    """
    named, ready = queries.columns, None
    front = queries.crossJoin(F.broadcast(tree.nodes[0]))  # 64 cells at most
    for level, nodes in enumerate(tree.nodes, 1):
        if level > 1:
            parents = nodes.withColumns({f"up_{a}": F.shiftright(f"c{a}", 2) for a in "xyz"})
            front = front.join(parents, ["up_x", "up_y", "up_z"]).drop("up_x", "up_y", "up_z")
        front = front.withColumn("bound", bound).where("bound IS NOT NULL").withColumn("try", exact(lambda c: F.col(f"rep.{c}"))["value"]).drop("rep", "n", *LOW, *HIGH)
        front = checkpointed(front)
        known = front.groupBy("q").agg((F.least(F.min("try"), F.min("best")) if level > 1 else F.min("try")).alias("best"))
        front = (front.drop("best") if level > 1 else front).join(known, "q").where(F.col("best").isNull() | (F.col("bound") <= F.col("best") + SLACK)).drop("try")
        own = front.where("last").select(*named, "bound", "best", F.lit(level).alias("level"), "cx", "cy", "cz")
        ready = own if ready is None else ready.unionByName(own)
        front = front.where("NOT last").select(*named, "best", *[F.col(f"c{a}").alias(f"up_{a}") for a in "xyz"])
    least = ready.groupBy("q").agg(F.min("best").alias("least"))
    ready = ready.drop("best").join(least, "q").where(F.col("least").isNull() | (F.col("bound") <= F.col("least") + SLACK))
    met = ready.join(tree.leaves, ["level", "cx", "cy", "cz"]).withColumn("found", exact(F.col)).where("found IS NOT NULL")
    best = met.groupBy("q").agg(F.min(F.struct(F.col("found.value").alias("value"), "item", "found", *(keep or []))).alias("m"))
    return best.select("q", "m.item", "m.found.*", *[f"m.{c}" for c in keep or []])


def _square_to_box(p: list[Column]) -> Column:
    off = [F.greatest(F.col(a) - x, x - F.col(b), F.lit(0.0)) for x, a, b in zip(p, LOW, HIGH, strict=True)]
    return off[0] * off[0] + off[1] * off[1] + off[2] * off[2]


def nearest(a: DataFrame, b: DataFrame, match: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None, least: float = 0.0, most: float = float("inf"), leaf: int = LEAF) -> DataFrame:
    """q, item, d2: for each row of a (id, x, y, z, ...) the nearest row of b between the distances `least` and `most`, both included.

    `match(a, b)` says, from columns a(name) and b(name), which rows may be paired; any condition will do, and none
    costs exactness: where few rows fit, more cells are visited. d2 has nine digits; ties go to the smallest id
    of b. Rows with a null coordinate are never paired.
    """
    there = " AND ".join(f"{c} IS NOT NULL" for c in "xyz")
    q = a.where(there).select(F.col("id").alias("q"), *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "id"])
    things = b.where(there).select(F.col("id").alias("item"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "id"], *[F.col(c).alias(f"m{c}") for c in "xyz"], *[F.col(c).alias(f"{e}_{c}") for e in ("lo", "hi") for c in "xyz"])
    p = [F.col(f"a_{c}") for c in "xyz"]
    far = reduce(lambda x, y: x + y, [F.greatest(F.abs(F.col(lo) - x), F.abs(F.col(hi) - x)) ** 2 for x, lo, hi in zip(p, LOW, HIGH, strict=True)])
    near = _square_to_box(p)
    bound = F.when((near <= most * most + SLACK) & (far >= least * least - SLACK), near)

    def exact(i):
        d2 = F.round(geom.norm2([i(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"]), 9)
        ok = (d2 >= least * least) & (d2 <= most * most)
        if match:
            ok = ok & match(lambda c: F.col("q" if c == "id" else f"a_{c}"), lambda c: i("item" if c == "id" else f"b_{c}"))
        return F.when(ok, F.struct(d2.alias("value")))

    return best_first(q, Tree(things, leaf), bound, exact).withColumnRenamed("value", "d2")


# --- meshes ----------------------------------------------------------------------------------


def face_tree(vertices: DataFrame, faces: DataFrame, leaf: int = LEAF) -> Tree:
    """The faces of one mesh with their corners, each in the cell of its middle, with boxes of whole faces."""
    c = mesh.corners(vertices, faces)
    of = lambda f, x: f(*[F.col(f"{x}{k}") for k in range(3)])
    return Tree(c.select(F.col("fid").alias("item"), *[f"{x}{k}" for x in "xyz" for k in range(3)], *[(sum((F.col(f"{x}{k}") for k in range(1, 3)), F.col(f"{x}0")) / 3).alias(f"m{x}") for x in "xyz"], *[of(F.least, x).alias(f"lo_{x}") for x in "xyz"], *[of(F.greatest, x).alias(f"hi_{x}") for x in "xyz"]), leaf)


def _corner(i: Callable[[str], Column], k: int) -> list[Column]:
    return [i(f"{x}{k}") for x in "xyz"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def closest_on_triangle(p: list[Column], a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """struct(value: squared distance at nine digits, u, v, w: weights of the corners) of the point of a triangle nearest to p.

    It is the least of the foot of p on the plane, if that lies inside, and the nearest points of the three sides.
    """
    parts = F.struct(*[x.alias(f"{n}{k}") for n, y in (("e", geom.sub(b, a)), ("f", geom.sub(c, a)), ("g", geom.sub(p, a))) for k, x in enumerate(y)])
    vec = lambda s, n: [s[f"{n}{k}"] for k in range(3)]

    def from_dots(s: Column, t: Column) -> Column:
        det = t["ee"] * t["ff"] - t["ef"] * t["ef"]
        share = lambda x, y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(x, y), F.lit(0.0))))
        at = lambda v, w: F.struct(v.alias("v"), w.alias("w"))
        foot = _let(at(F.try_divide(t["ff"] * t["eg"] - t["ef"] * t["fg"], det), F.try_divide(t["ee"] * t["fg"] - t["ef"] * t["eg"], det)), lambda x: F.when((x["v"] >= 0) & (x["w"] >= 0) & (x["v"] + x["w"] <= 1), x))
        far = _let(share(t["fg"] - t["eg"] - t["ef"] + t["ee"], t["ee"] - 2 * t["ef"] + t["ff"]), lambda x: at(1 - x, x))
        places = F.array_compact(F.array(foot, at(share(t["eg"], t["ee"]), F.lit(0.0)), at(F.lit(0.0), share(t["fg"], t["ff"])), far))

        def found(x: Column) -> Column:
            off = [g - x["v"] * e - x["w"] * f for e, f, g in zip(vec(s, "e"), vec(s, "f"), vec(s, "g"), strict=True)]
            return F.struct(F.round(geom.norm2(off), 9).alias("value"), (1 - x["v"] - x["w"]).alias("u"), x["v"].alias("v"), x["w"].alias("w"))

        return F.array_min(F.transform(places, found))

    return _let(parts, lambda s: _let(F.struct(*[geom.dot(vec(s, x), vec(s, y)).alias(x + y) for x, y in ("ee", "ef", "ff", "eg", "fg")]), lambda t: from_dots(s, t)))


def closest_on_mesh(points: DataFrame, vertices: DataFrame, faces: DataFrame, most: float = float("inf"), leaf: int = LEAF) -> DataFrame:
    """q, face, d2, u, v, w: for each point (id, x, y, z) the nearest face of one mesh, the squared distance, and the weights of the face's corners there.

    Ties go to the smallest face. Points farther than `most` from every face have no row.
    """
    q = points.select(F.col("id").alias("q"), *[F.col(c).cast("double").alias(f"p{c}") for c in "xyz"]).where("px IS NOT NULL AND py IS NOT NULL AND pz IS NOT NULL")
    p = [F.col(f"p{c}") for c in "xyz"]
    near = _square_to_box(p)

    def exact(i):
        s = closest_on_triangle(p, *[_corner(i, k) for k in range(3)])
        return F.when(s["value"] <= most * most, s)

    out = best_first(q, face_tree(vertices, faces, leaf), F.when(near <= most * most + SLACK, near), exact)
    return out.select("q", F.col("item").alias("face"), F.col("value").alias("d2"), "u", "v", "w")


def ray_hits(rays: DataFrame, vertices: DataFrame, faces: DataFrame, most: float = float("inf"), leaf: int = LEAF) -> DataFrame:
    """q, face, t, u, v, w: for each ray (id, x, y, z, dx, dy, dz) the first face of one mesh that it meets, at origin + t * direction, 0 <= t <= most.

    Ties (at nine digits) go to the smallest face; faces that lie along the ray are not met. Rays that meet none have no row.
    """
    q = rays.select(F.col("id").alias("q"), *[F.col(c).cast("double").alias(f"p{c}") for c in "xyz"], *[F.col(f"d{c}").cast("double").alias(f"d{c}") for c in "xyz"])
    p, d = [F.col(f"p{c}") for c in "xyz"], [F.col(f"d{c}") for c in "xyz"]
    enter, leave = [], []
    for x, step, lo, hi in zip(p, d, LOW, HIGH, strict=True):
        a, b = F.try_divide(F.col(lo) - SLACK - x, step), F.try_divide(F.col(hi) + SLACK - x, step)
        held = F.when((x >= F.col(lo) - SLACK) & (x <= F.col(hi) + SLACK), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        enter.append(F.when(step == 0, -held).otherwise(F.least(a, b)))
        leave.append(F.when(step == 0, held).otherwise(F.greatest(a, b)))
    first, last = F.greatest(*enter, F.lit(0.0)), F.least(*leave, F.lit(most))
    bound = F.when(first <= last + SLACK, first)

    def exact(i):
        a, b, c = (_corner(i, k) for k in range(3))
        e, f, g = geom.sub(b, a), geom.sub(c, a), geom.sub(p, a)
        h = geom.cross(d, f)
        det = geom.dot(e, h)
        k = geom.cross(g, e)
        v, w, t = F.try_divide(geom.dot(g, h), det), F.try_divide(geom.dot(d, k), det), F.round(F.try_divide(geom.dot(f, k), det), 9)
        return F.when((v >= -SLACK) & (w >= -SLACK) & (v + w <= 1 + SLACK) & (t >= 0) & (t <= most), F.struct(t.alias("value"), (1 - v - w).alias("u"), v.alias("v"), w.alias("w")))

    out = best_first(q, face_tree(vertices, faces, leaf), bound, exact)
    return out.select("q", F.col("item").alias("face"), F.col("value").alias("t"), "u", "v", "w")
