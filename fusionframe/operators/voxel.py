"""Sparse voxel grids: one row per voxel (grid, ix, iy, iz, value); a missing row is 0.

Neighbourhoods are exploded from the occupied side and grouped, so they are equi-aggregations
with map-side combine and never theta joins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("ix", "iy", "iz")


def bbox(points: DataFrame, key: str = "cloud") -> DataFrame:
    return points.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


def occupancy(points: DataFrame, size: float, key: str = "cloud", floor: bool = False) -> DataFrame:
    index = (lambda c: F.floor(F.col(c) / size)) if floor else (lambda c: F.round(F.col(c) / size))
    return points.select(F.col(key).alias("grid"), *[index(c).cast("long").alias(a) for c, a in zip("xyz", AXES, strict=True)]).distinct()


def downsample(points: DataFrame, size: float, key: str = "cloud") -> DataFrame:
    """Mean point of each cell floor(p / size)."""
    cell = [F.floor(F.col(c) / size).cast("long").alias(a) for c, a in zip("xyz", AXES, strict=True)]
    return points.groupBy(F.col(key).alias("grid"), *cell).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n"))


def offsets(radius: int, ball: bool = False) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [(x, y, z) for x in r for y in r for z in r if not ball or x * x + y * y + z * z <= radius * radius]


def spread(voxels: DataFrame, around: list[tuple[int, int, int]], weights: list[float] | None = None, dims: tuple | None = None) -> DataFrame:
    """A row for every voxel and offset, moved by the offset, with o2 (squared offset length) and w."""
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.lit(float(w)).alias("w")) for (x, y, z), w in zip(around, weights or [1.0] * len(around), strict=True)])
    out = voxels.withColumn("o", F.explode(rows))
    out = out.select(*[c for c in voxels.columns if c not in AXES], *[(F.col(a) + F.col(f"o.{c}")).alias(a) for a, c in zip(AXES, "xyz", strict=True)], (F.col("o.x") * F.col("o.x") + F.col("o.y") * F.col("o.y") + F.col("o.z") * F.col("o.z")).alias("o2"), F.col("o.w").alias("w"))
    if dims:
        for a, n in zip(AXES, dims, strict=True):
            out = out.where((F.col(a) >= 0) & (F.col(a) < n))
    return out


def tdf_index(occupied: DataFrame, radius: int = 5) -> DataFrame:
    """Truncated field by distance in voxels over the cube of the radius: the largest of 1 - dist / radius, at least 0."""
    near = spread(occupied.select("grid", *AXES), offsets(radius))
    return near.groupBy("grid", *AXES).agg(F.greatest(F.lit(0.0), 1 - F.sqrt(F.min("o2").cast("double")) / radius).alias("value")).where("value > 0")


def tdf_metric(points: DataFrame, size: float, margin: float, key: str = "cloud") -> DataFrame:
    """Truncated field by metric distance from voxel centres (idx * size) to the nearest point; beyond the margin there is no row."""
    r = int(np.ceil(margin / size)) + 1
    near = spread(points.select(F.col(key).alias("grid"), *"xyz", *[F.round(F.col(c) / size).cast("long").alias(a) for c, a in zip("xyz", AXES, strict=True)]), offsets(r))
    d2 = sum(((F.col(a) * size - F.col(c)) * (F.col(a) * size - F.col(c)) for c, a in zip("xyz", AXES, strict=True)), F.lit(0.0))
    return near.groupBy("grid", *AXES).agg(F.min(d2).alias("d2")).where(F.col("d2") < margin * margin).select("grid", *AXES, (1 - F.sqrt("d2") / margin).alias("value"))


def patch_gather(voxels: DataFrame, keypoints: DataFrame, half: int) -> DataFrame:
    """Sparse patches [k - half, k + half) around integer keypoints (grid, kp, ix, iy, iz); cells of 2 * half make it an equi-join, missing voxels are 0."""
    n = 2 * half
    cell = [F.floor(F.col(a) / n).cast("long").alias(f"c{a}") for a in AXES]
    v = voxels.select("*", *cell)
    k = keypoints.select("grid", "kp", *[F.col(a).alias(f"k{a}") for a in AXES])
    for a in AXES:
        k = k.withColumn(f"c{a}", F.explode(F.array_distinct(F.array(F.floor((F.col(f"k{a}") - half) / n), F.floor((F.col(f"k{a}") + half - 1) / n)))))
    out = v.join(k, ["grid", *[f"c{a}" for a in AXES]])
    for a in AXES:
        out = out.withColumn(f"p{a}", F.col(a) - F.col(f"k{a}") + half).where((F.col(f"p{a}") >= 0) & (F.col(f"p{a}") < n))
    return out.select("grid", "kp", *[F.col(f"p{a}").cast("int").alias(a) for a in AXES], "value")


def inner(dims: tuple[int, int, int]):
    """Whether a cell isn't on the border of a grid."""
    out = F.lit(True)
    for a, n in zip(AXES, dims, strict=True):
        out = out & F.col(a).between(1, n - 2)
    return out


def convolve(voxels: DataFrame, kernel: dict[tuple[int, int, int], float], dims: tuple[int, int, int]) -> DataFrame:
    """Correlation with a 3 x 3 x 3 kernel: out(p) = sum of w(o) * v(p + o); border cells are 0, so they have no row."""
    moved = spread(voxels.select("grid", *AXES, "value"), [tuple(-c for c in o) for o in kernel], list(kernel.values())).where(inner(dims))
    return moved.groupBy("grid", *AXES).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


LAPLACE = {o: (1.0 if o == (0, 0, 0) else -1 / 26) for o in offsets(1)}


# The axis across which the weights of each derivative fall from 2/12 to 1/12; along the third axis they are equal.
FALLS_ALONG = {0: 2, 1: 2, 2: 0}


def gradient_kernel(axis: int) -> dict[tuple[int, int, int], float]:
    """Difference along an axis over all 18 cells beside the centre plane; the weights of each side sum to 1."""
    return {o: o[axis] * (2 / 12 if o[FALLS_ALONG[axis]] == 0 else 1 / 12) for o in offsets(1) if o[axis]}


def gradient(voxels: DataFrame, axis: int, dims: tuple[int, int, int]) -> DataFrame:
    return convolve(voxels, gradient_kernel(axis), dims)


def detect_edges(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Absolute Laplacian."""
    return convolve(voxels, LAPLACE, dims).withColumn("value", F.abs("value"))


def gradient_magnitude(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    kernels = [gradient_kernel(a) for a in range(3)]
    keys = sorted(set().union(*kernels))
    rows = F.array(*[F.struct(*[F.lit(-c).alias(n) for c, n in zip(o, "xyz", strict=True)], *[F.lit(k.get(o, 0.0)).alias(f"w{i}") for i, k in enumerate(kernels)]) for o in keys])
    moved = voxels.select("grid", *AXES, "value", F.explode(rows).alias("o")).select("grid", *[(F.col(a) + F.col(f"o.{c}")).alias(a) for a, c in zip(AXES, "xyz", strict=True)], *[(F.col("value") * F.col(f"o.w{i}")).alias(f"g{i}") for i in range(3)])
    sums = moved.where(inner(dims)).groupBy("grid", *AXES).agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(3)])
    return sums.select("grid", *AXES, F.sqrt(F.col("g0") * F.col("g0") + F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2")).alias("value"))


def window_filter(voxels: DataFrame, radius: int, kind: str, dims: tuple[int, int, int], p: float = 0.5) -> DataFrame:
    """min, max, median or percentile over all cells of the ball that are in the grid, missing ones as 0; value at index int(p * n) of the sorted n. Cells whose result is 0 have no row."""
    around = offsets(radius, True)
    moved = spread(voxels.select("grid", *AXES, "value"), around, None, dims)
    share = {"min": 0.0, "max": 1.0, "median": 0.5}.get(kind, p)
    values = moved.groupBy("grid", *AXES).agg(F.sort_array(F.collect_list("value")).alias("a"))  # at most a ball
    there = lambda o: F.lit(1) * reduce(lambda x, y: x * y, [(F.col(a) + c).between(0, n - 1).cast("int") for a, c, n in zip(AXES, o, dims, strict=True)])
    n = reduce(lambda x, y: x + y, [there(o) for o in around])
    values = values.withColumn("n", n).withColumn("zeros", F.col("n") - F.size("a")).withColumn("low", F.size(F.filter("a", lambda x: x < 0)))
    at = F.least(F.floor(F.col("n") * share).cast("int"), F.col("n") - 1)
    value = F.when(at < F.col("low"), F.get("a", at)).when(at < F.col("low") + F.col("zeros"), 0.0).otherwise(F.get("a", at - F.col("zeros")))
    return values.select("grid", *AXES, value.alias("value")).where("value <> 0")


def mask_non_extrema(voxels: DataFrame, radius: int, dims: tuple[int, int, int], maxima: bool = True) -> DataFrame:
    """Values that are not the greatest (or least) of their ball become 0."""
    best = window_filter(voxels, radius, "max" if maxima else "min", dims).withColumnRenamed("value", "m")
    kept = F.col("value") == F.coalesce("m", F.lit(0.0))
    return voxels.join(best, ["grid", *AXES], "left").select("grid", *AXES, F.when(kept, F.col("value")).otherwise(0.0).alias("value"))


def blur(voxels: DataFrame, sigma: float, dims: tuple[int, int, int]) -> DataFrame:
    """Separable Gaussian of radius int(3 sigma + 0.5), renormalised at the borders of the grid."""
    r = int(3 * sigma + 0.5)
    weight = [float(np.exp(-(o * o) / (2 * sigma * sigma))) for o in range(-r, r + 1)]
    out = voxels.select("grid", *AXES, "value")
    for k, (a, n) in enumerate(zip(AXES, dims, strict=True)):
        around = [tuple(o if i == k else 0 for i in range(3)) for o in range(-r, r + 1)]
        moved = spread(out, around, weight, dims)
        norm = sum((F.when((F.col(a) + o >= 0) & (F.col(a) + o < n), w).otherwise(0.0) for o, w in zip(range(-r, r + 1), weight, strict=True)), F.lit(0.0))
        out = moved.groupBy("grid", *AXES).agg(F.sum(F.col("w") * F.col("value")).alias("s")).select("grid", *AXES, (F.col("s") / norm).alias("value"))
    return out


def threshold(voxels: DataFrame, at: float, low: float | None, high: float | None) -> DataFrame:
    """Values up to `at` become low, the others high; None keeps a value."""
    v = F.col("value")
    return voxels.withColumn("value", F.when(v <= at, v if low is None else F.lit(float(low))).otherwise(v if high is None else F.lit(float(high))))


def stats(voxels: DataFrame) -> DataFrame:
    v = F.col("value")
    return voxels.groupBy("grid").agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("stddev"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v * v).alias("l2_squared"), F.count_if(v != 0).alias("cardinality"), *[(F.sum(v * F.col(a)) / F.sum(v)).alias(f"centroid_{a}") for a in AXES])


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """dot, l1, l2_squared of two grids of equal cells; missing voxels are 0."""
    j = a.select(*AXES, F.col("value").alias("p")).join(b.select(*AXES, F.col("value").alias("q")), list(AXES), "full").fillna(0.0, ["p", "q"])
    d = F.col("p") - F.col("q")
    return j.agg(F.sum(F.col("p") * F.col("q")).alias("dot"), F.sum(F.abs(d)).alias("l1"), F.sum(d * d).alias("l2_squared"), F.sqrt(F.sum(d * d)).alias("l2"))


def trilinear(voxels: DataFrame, queries: DataFrame) -> DataFrame:
    """q, value at real grid positions (grid, q, gx, gy, gz): the eight corners, weighted; missing corners are 0."""
    corners = F.explode(F.array(*[F.struct(*[F.lit(c >> k & 1).alias(a) for k, a in enumerate("xyz")]) for c in range(8)]))
    q = queries.withColumn("o", corners)
    w = F.lit(1.0)
    for a, c in zip(AXES, "xyz", strict=True):
        base = F.floor(F.col(f"g{c}"))
        part = F.col(f"g{c}") - base
        q = q.withColumn(a, (base + F.col(f"o.{c}")).cast("long"))
        w = w * F.when(F.col(f"o.{c}") == 1, part).otherwise(1 - part)
    return q.withColumn("w", w).join(voxels, ["grid", *AXES], "left").groupBy("grid", "q").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("value"))


def components(voxels: DataFrame, iso: float) -> DataFrame:
    """grid, voxel, component: 6-connected parts above the level, named by their smallest voxel (grid, ix, iy, iz); label propagation with pointer jumps, each round written to the checkpoint folder."""
    from ..plans.checkpoint import checkpointed

    own = voxels.where(F.col("value") > iso).select("grid", *AXES)
    name = F.struct("ix", "iy", "iz")
    state = checkpointed(own.withColumn("label", name))
    around = [o for o in offsets(1) if sum(map(abs, o)) == 1]
    rows = F.array(*[F.struct(*[F.lit(c).alias(n) for c, n in zip(o, "xyz", strict=True)]) for o in around])
    while True:
        told = state.select("grid", "label", *AXES, F.explode(rows).alias("o")).select("grid", "label", *[(F.col(a) + F.col(f"o.{c}")).alias(a) for a, c in zip(AXES, "xyz", strict=True)])
        best = told.groupBy("grid", *AXES).agg(F.min("label").alias("near"))
        new = state.join(best, ["grid", *AXES], "left").select("grid", *AXES, "label", F.least("label", "near").alias("low"))
        # Jump: take the label that the voxel of one's label has by now.
        jump = new.select("grid", F.struct("ix", "iy", "iz").alias("low"), F.col("low").alias("far"))
        new = checkpointed(new.join(jump, ["grid", "low"], "left").select("grid", *AXES, "label", F.least("low", "far").alias("low")))
        changed = not new.where("label != low").isEmpty()
        state = new.select("grid", *AXES, F.col("low").alias("label"))
        if not changed:
            return state


def squared_distance(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Exact squared distance to the nearest stored non-zero voxel over a dense grid; 3 (res + 1)^3 at most."""
    from . import distance

    far = float(3 * (max(dims) + 1) ** 3)
    near = distance.sources_of(voxels.where("value != 0"), distance.fixed(dims))
    return near.select("grid", *AXES, F.least(F.col("d2").cast("double"), F.lit(far)).alias("value"))


def dilate(voxels: DataFrame, radius: float, dims: tuple[int, int, int]) -> DataFrame:
    return squared_distance(voxels, dims).where(F.col("value") <= radius * radius).select("grid", *AXES, F.lit(1.0).alias("value"))


def rasterize_points(points: DataFrame, size: float, key: str = "cloud") -> DataFrame:
    """Trilinear splat of points into voxels."""
    p = points.select(F.col(key).alias("grid"), *[(F.col(c) / size).alias(f"g{c}") for c in "xyz"])
    corners = F.explode(F.array(*[F.struct(*[F.lit(c >> k & 1).alias(a) for k, a in enumerate("xyz")]) for c in range(8)]))
    p, w = p.withColumn("o", corners), F.lit(1.0)
    for a, c in zip(AXES, "xyz", strict=True):
        base = F.floor(F.col(f"g{c}"))
        part = F.col(f"g{c}") - base
        p = p.withColumn(a, (base + F.col(f"o.{c}")).cast("long"))
        w = w * F.when(F.col(f"o.{c}") == 1, part).otherwise(1 - part)
    return p.withColumn("w", w).groupBy("grid", *AXES).agg(F.sum("w").alias("value")).where("value > 0")


def percentile_rank(values: DataFrame, by: str, value: str, key: str) -> DataFrame:
    w = Window.partitionBy(by)
    return values.select(by, key, (100.0 * (F.row_number().over(w.orderBy(value, key)) - 1) / F.count("*").over(w)).alias("rank"))


def zscore(values: DataFrame, by: str, value: str, key: str) -> DataFrame:
    moments = values.groupBy(by).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return values.join(moments, by).select(by, key, F.when(F.col("s") == 0, 0.0).otherwise((F.col(value) - F.col("m")) / F.col("s")).alias("z"))


# --- whole-grid operations -------------------------------------------------------------------


def cells_of(grids: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """All cells of each grid, a plane at a time, so that no row holds a grid and planes are dealt out."""
    run = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    planes = grids.select("grid").distinct().withColumn("iz", run(dims[2])).repartition("grid", "iz")
    return planes.withColumn("iy", run(dims[1])).withColumn("ix", run(dims[0])).select("grid", *AXES)


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """add, subtract, multiply, divide, least or greatest of two grids of equal cells, missing voxels as 0; what is divided by 0 is 0. Cells of 0 have no row."""
    j = a.select("grid", *AXES, F.col("value").alias("p")).join(b.select("grid", *AXES, F.col("value").alias("q")), ["grid", *AXES], "full").fillna(0.0, ["p", "q"])
    p, q = F.col("p"), F.col("q")
    value = {"add": p + q, "subtract": p - q, "multiply": p * q, "divide": F.coalesce(F.try_divide(p, q), F.lit(0.0)), "least": F.least(p, q), "greatest": F.greatest(p, q)}[how]
    return j.select("grid", *AXES, value.alias("value")).where("value <> 0")


def transpose(voxels: DataFrame, order: tuple[int, int, int]) -> DataFrame:
    """Axis k of the result is axis order[k] of the grid."""
    return voxels.select("grid", *[F.col(AXES[o]).alias(a) for a, o in zip(AXES, order, strict=True)], "value")


def plane_of(voxels: DataFrame, axis: int, at: int) -> DataFrame:
    """The values of one plane, under the other two axes."""
    kept = [a for k, a in enumerate(AXES) if k != axis]
    return voxels.where(F.col(AXES[axis]) == at).select("grid", *[F.col(a).alias(n) for a, n in zip(kept, ("i", "j"), strict=True)], "value")


def pad(voxels: DataFrame, dims: tuple[int, int, int], new_dims: tuple[int, int, int], offset: tuple[int, int, int]) -> DataFrame:
    """A grid within a larger one of zeros; as it is if it is as large in each direction already. What falls outside goes."""
    if all(a >= b for a, b in zip(dims, new_dims, strict=True)):
        return voxels.select("grid", *AXES, "value")
    out = voxels.select("grid", *[(F.col(a) + o).alias(a) for a, o in zip(AXES, offset, strict=True)], "value")
    return out.where(reduce(lambda x, y: x & y, [F.col(a).between(0, n - 1) for a, n in zip(AXES, new_dims, strict=True)]))


def resample(voxels: DataFrame, dims: tuple[int, int, int], new_dims: tuple[int, int, int]) -> DataFrame:
    """The grid at another resolution, its corners kept: trilinear values between the cells. Every value is dealt to the new cells around it, so zeros cost nothing."""
    out = voxels.select("grid", *AXES, "value").withColumn("w", F.lit(1.0))
    for a, n, m in zip(AXES, dims, new_dims, strict=True):
        scale = (n - 1) / (m - 1)  # old cells to a new one
        low, high = F.greatest(F.lit(0), F.ceil((F.col(a) - 1) / scale)), F.least(F.lit(m - 1), F.floor((F.col(a) + 1) / scale))
        at = F.when(F.col("_new") == m - 1, float(n - 1)).otherwise(F.col("_new") * scale)
        out = out.withColumn("_new", F.explode(F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
        out = out.withColumn("w", F.col("w") * F.greatest(F.lit(0.0), 1 - F.abs(at - F.col(a)))).where("w > 0").withColumn(a, F.col("_new")).drop("_new")
    return out.groupBy("grid", *AXES).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def gaussian_value(voxels: DataFrame, queries: DataFrame, sigma: float, dims: tuple[int, int, int]) -> DataFrame:
    """grid, q, value at real positions (grid, q, gx, gy, gz): Gaussian weights over the cells of a box of 3 sigma that are in the grid, divided by their sum; 0 outside the grid."""
    f = int(3 * sigma + 0.5)
    q = queries
    for a, c, n in zip(AXES, "xyz", dims, strict=True):
        # The nearest cells are truncated towards zero.
        low = F.greatest(F.lit(0), (F.col(f"g{c}") - f + 0.5).cast("int"))
        high = F.least(F.lit(n - 1), (F.col(f"g{c}") + f + 0.5).cast("int"))
        q = q.withColumn(a, F.explode(F.when(F.col(f"g{c}").between(0, n - 1), F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array(F.lit(-1).cast("long")))))
    d2 = sum(((F.col(f"g{c}") - F.col(a)) * (F.col(f"g{c}") - F.col(a)) for a, c in zip(AXES, "xyz", strict=True)), F.lit(0.0))
    inside = reduce(lambda x, y: x & y, [F.col(a) >= 0 for a in AXES])
    q = q.withColumn("w", F.when(inside, F.exp(-d2 / (2 * sigma * sigma))).otherwise(0.0))
    out = q.join(voxels, ["grid", *AXES], "left").groupBy("grid", "q").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("s"), F.sum("w").alias("w"))
    return out.select("grid", "q", F.coalesce(F.try_divide("s", "w"), F.lit(0.0)).alias("value"))


def bilateral(voxels: DataFrame, sigma: float, value_sigma: float, dims: tuple[int, int, int]) -> DataFrame:
    """Means weighted by Gaussians of distance and of difference in value, over the ball of int(3 sigma + 1); at stored voxels, missing ones count as 0.

    A cell without a voxel changes only by voxels in its ball; these are dealt to it too. Cells whose result is 0 have no row.
    """
    r = int(3 * sigma + 1)
    around = offsets(r, True)
    near = spread(voxels.select("grid", *AXES, F.col("value").alias("sample")), around, None, dims)
    j = near.join(voxels.select("grid", *AXES, "value"), ["grid", *AXES], "left").fillna(0.0, ["value"])
    space = lambda o2: F.exp(-o2 / (2 * sigma * sigma))
    tone = lambda d: F.exp(-(d * d) / (2 * value_sigma * value_sigma))
    w = space(F.col("o2")) * tone(F.col("value") - F.col("sample"))
    sums = j.groupBy("grid", *AXES, "value").agg(F.sum(w * F.col("sample")).alias("s"), F.sum(w).alias("w"), F.sum(space(F.col("o2"))).alias("stored"))
    # What all cells of the ball that are in the grid weigh by distance, less those with a voxel, are zeros.
    full = reduce(lambda x, y: x + y, [reduce(lambda x, y: x * y, [(F.col(a) + c).between(0, n - 1).cast("double") for a, c, n in zip(AXES, o, dims, strict=True)], F.lit(float(np.exp(-sum(c * c for c in o) / (2 * sigma * sigma))))) for o in around])
    zeros = (full - F.col("stored")) * tone(F.col("value"))
    return sums.select("grid", *AXES, (F.col("s") / (F.col("w") + zeros)).alias("value")).where("value <> 0")


def erode(voxels: DataFrame, radius: float, dims: tuple[int, int, int]) -> DataFrame:
    """Cells of value 1 that are further than the radius from every cell of the grid whose value isn't over 0."""
    own = voxels.where("value > 0").select("grid", *AXES)
    empty = cells_of(own, dims).join(own, ["grid", *AXES], "left_anti")
    near = spread(empty, [o for o in offsets(int(radius)) if sum(c * c for c in o) <= radius * radius], None, dims).select("grid", *AXES).distinct()
    return own.join(near, ["grid", *AXES], "left_anti").withColumn("value", F.lit(1.0))


def signed_distance(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Distance of every cell to the nearest one over 0, less that to the nearest that isn't: positive outside, negative inside."""
    own = voxels.where("value > 0").select("grid", *AXES, F.lit(1.0).alias("value"))
    empty = cells_of(own, dims).join(own, ["grid", *AXES], "left_anti").withColumn("value", F.lit(1.0))
    out, inside = squared_distance(own, dims), squared_distance(empty, dims)
    j = out.join(inside.withColumnRenamed("value", "inner"), ["grid", *AXES], "left")
    return j.select("grid", *AXES, (F.sqrt("value") - F.sqrt(F.coalesce("inner", F.lit(0.0)))).alias("value"))


def rasterize_box(grids: DataFrame, low: tuple, high: tuple, value: float = 1.0) -> DataFrame:
    """The cells of a box, both ends included, in each grid."""
    out = grids.select("grid").distinct()
    for a, x, y in zip(AXES, low, high, strict=True):
        out = out.withColumn(a, F.explode(F.sequence(F.lit(int(x)).cast("long"), F.lit(int(y)).cast("long"))))
    return out.withColumn("value", F.lit(float(value)))


def rasterize_sphere(grids: DataFrame, centre: tuple, radius: float, dims: tuple[int, int, int], value: float = 1.0) -> DataFrame:
    """The cells within a radius of a point, in each grid."""
    r = int(np.ceil(radius))
    box = rasterize_box(grids, [max(0, int(c) - r) for c in centre], [min(n - 1, int(c) + r + 1) for c, n in zip(centre, dims, strict=True)], value)
    d2 = sum(((F.col(a) - float(c)) * (F.col(a) - float(c)) for a, c in zip(AXES, centre, strict=True)), F.lit(0.0))
    return box.where(d2 <= radius * radius)


def field_normals(field: DataFrame) -> DataFrame:
    """grid, cell, nx, ny, nz: the unit gradient of a field at its voxels, by central differences over stored neighbours; null where it is 0 or a neighbour is missing."""
    steps = [(s, a) for a in range(3) for s in (-1, 1)]
    rows = F.array(*[F.struct(*[F.lit(-s if k == a else 0).alias(n) for k, n in enumerate("xyz")], F.lit(a).alias("axis"), F.lit(s / 2).alias("w")) for s, a in steps])
    moved = field.select("grid", *AXES, "value", F.explode(rows).alias("o")).select("grid", *[(F.col(a) + F.col(f"o.{c}")).alias(a) for a, c in zip(AXES, "xyz", strict=True)], F.col("o.axis").alias("axis"), (F.col("value") * F.col("o.w")).alias("d"))
    sums = moved.groupBy("grid", *AXES).agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("axis") == k, F.col("d"))).alias(f"d{k}") for k in range(3)]).where("n = 6")
    size = F.sqrt(F.col("d0") * F.col("d0") + F.col("d1") * F.col("d1") + F.col("d2") * F.col("d2"))
    return sums.join(field.select("grid", *AXES), ["grid", *AXES], "left_semi").select("grid", *AXES, *[F.try_divide(F.col(f"d{k}"), size).alias(f"n{c}") for k, c in enumerate("xyz")])


def near_surface(field: DataFrame, least: float = 0.8) -> DataFrame:
    return field.where(F.abs("value") > least)
