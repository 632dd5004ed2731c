"""Exact distance fields with their sources, in three passes of lines, and distance fields of meshes.

A pass takes the lines of one axis. For all cells of a line it finds the stored cell with the least
(value + squared offset); the best source never goes back along a line, so halves of the line bound
each other's choices, and a line of n cells takes n log n steps in memory linear in n. Lines are
handled in groups of LINES neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mesh

AXES = ("ix", "iy", "iz")
LINES = 64


def nearest_on_line(at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each cell 0 to n - 1 the index of the entry (at ascending, value) with the least value + (cell - at)**2; ties go to the first entry."""
    best, last = np.zeros(n, np.int64), len(at) - 1
    step = 1 << max(n - 1, 1).bit_length()
    while step >= 1:
        cells = np.arange(step - 1, n, 2 * step)
        low = np.where(cells - step >= 0, best[np.maximum(cells - step, 0)], 0)
        high = np.where(cells + step < n, best[np.minimum(cells + step, n - 1)], last)
        size = high - low + 1
        first = np.concatenate(([0], np.cumsum(size)))
        own = np.repeat(np.arange(len(cells)), size)
        entry = low[own] + np.arange(first[-1]) - first[:-1][own]
        cost = value[entry] + (cells[own] - at[entry]) ** 2
        least = np.minimum.reduceat(cost, first[:-1]) if len(cells) else cost
        hit = np.flatnonzero(cost == least[own])
        best[cells] = entry[hit[np.searchsorted(hit, first[:-1])]] if len(cells) else entry
        step //= 2
    return best


def _pass(cells: DataFrame, axis: str, size: str) -> DataFrame:
    """One pass; cells: grid, axes, value (squared distance so far), source axes sx, sy, sz, and the grid's sizes."""
    a, b = (x for x in AXES if x != axis)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(b, "ascending"), (axis, "ascending")])
        n = table[size][0].as_py()
        line, at, value = (table[c].to_numpy() for c in (b, axis, "value"))
        cut = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1], [True])))
        best = [i + nearest_on_line(at[i:j], value[i:j], n) for i, j in zip(cut, cut[1:])]
        cell, entry = np.tile(np.arange(n), len(best)), np.concatenate(best)
        out = table.take(pa.array(entry))
        out = out.set_column(out.schema.get_field_index("value"), "value", pa.array(value[entry] + (cell - at[entry]) ** 2))
        return out.set_column(out.schema.get_field_index(axis), axis, pa.array(cell))

    return cells.groupBy("grid", a, F.floor(F.col(b) / LINES)).applyInArrow(run, cells.schema)


def sources_of(cells: DataFrame, sizes: dict[str, Column]) -> DataFrame:
    """grid, ix, iy, iz, d2, sx, sy, sz: for every cell of every grid the nearest given cell and its squared distance.

    cells: grid and axes of the sources, with what `sizes` (cells along ix, iy, iz) reads, equal in all rows of
    a grid. Ties go to the source that is first by (sx, sy, sz). A grid without sources has no rows.
    """
    own = cells.select("grid", *[F.col(a).cast("bigint").alias(a) for a in AXES], *[sizes[a].cast("bigint").alias(f"n_{a}") for a in AXES]).distinct()
    out = own.select("grid", *AXES, F.lit(0).cast("bigint").alias("value"), *[F.col(a).alias(s) for a, s in zip(AXES, ("sx", "sy", "sz"), strict=True)], *[f"n_{a}" for a in AXES])
    for a in reversed(AXES):
        out = _pass(out, a, f"n_{a}")
    return out.select("grid", *AXES, F.col("value").alias("d2"), "sx", "sy", "sz")


def fixed(dims: tuple[int, int, int]) -> dict[str, Column]:
    return {a: F.lit(n) for a, n in zip(AXES, dims, strict=True)}


def voronoi(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """grid, ix, iy, iz, value, d2: every cell of the grid with the value of the nearest non-zero voxel (ties: the first by axes) and the squared distance to it."""
    own = voxels.where("value <> 0").select("grid", *AXES, "value")
    near = sources_of(own, fixed(dims))
    return near.join(own.toDF("grid", "sx", "sy", "sz", "value"), ["grid", "sx", "sy", "sz"]).select("grid", *AXES, "value", "d2")


# --- triangles -------------------------------------------------------------------------------


def rasterize_triangles(triangles: DataFrame) -> DataFrame:
    """grid, ix, iy, iz: the cells of triangles (grid, p0, p1, p2: structs x, y, z of whole cells), each once a triangle.

    A triangle is cut into levels along its longest axis (x before z before y among equal ones, but y only where it
    is longer than both). On each level the two sides are met at the whole cells towards the upper
    corner, and the cells between them are those of a line along its own longest axis. Rows are the cells; no triangle is
    taken as a whole.
    """
    # Which axis wins where lengths are equal.
    spread = {c: F.greatest(*[F.col(f"p{k}.{c}") for k in range(3)]) - F.least(*[F.col(f"p{k}.{c}") for k in range(3)]) for c in "xyz"}
    along = F.when((spread["y"] > spread["x"]) & (spread["y"] > spread["z"]), 1).when(spread["z"] > spread["x"], 2).otherwise(0)
    vec = lambda p: F.array(*[F.col(f"{p}.{c}").cast("bigint") for c in "xyz"])
    t = triangles.select("grid", along.alias("d"), *[vec(f"p{k}").alias(f"p{k}") for k in range(3)])
    order = F.sort_array(F.array(*[F.struct((-F.get(f"p{k}", "d")).alias("o"), F.lit(k).alias("k"), F.col(f"p{k}").alias("p")) for k in range(3)]))
    t = t.withColumn("q", order).select("grid", "d", *[F.col("q")[k]["p"].alias(n) for k, n in enumerate(("top", "mid", "low"))])
    t = t.select("*", *[F.get(n, "d").alias(f"{n}_d") for n in ("top", "mid", "low")])

    def towards(a: Column, b: Column, i: Column, n: Column) -> Column:
        """a moved towards b by i of n levels, cut towards a."""
        return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] + F.call_function("div", (x["b"] - x["a"]) * i, n))

    # Where the long side passes the middle corner's level.
    t = t.withColumn("side", F.when(F.col("top_d") > F.col("low_d"), towards(F.col("top"), F.col("low"), F.col("top_d") - F.col("mid_d"), F.greatest(F.col("top_d") - F.col("low_d"), F.lit(1)))).otherwise(F.col("top")))
    none = F.array().cast("array<bigint>")
    upper, lower = F.col("top_d") - F.col("mid_d"), F.col("mid_d") - F.col("low_d")
    steps = F.concat(
        F.transform(F.when(upper > 0, F.sequence(F.lit(0).cast("bigint"), upper - 1)).otherwise(none), lambda i: F.struct(F.lit(0).alias("part"), i.alias("i"))),
        F.transform(F.sequence(F.lit(0).cast("bigint"), lower), lambda i: F.struct(F.lit(1).alias("part"), i.alias("i"))),
    )
    t = t.withColumn("s", F.explode(steps))
    i, up, down = F.col("s.i"), F.greatest(upper, F.lit(1)), F.greatest(lower, F.lit(1))
    whole = F.greatest(F.col("top_d") - F.col("low_d"), F.lit(1))
    flat = lower == 0  # the lower side lies on one level: it is the line between its corners
    one = F.when(F.col("s.part") == 0, towards(F.col("top"), F.col("mid"), i, up)).otherwise(towards(F.col("mid"), F.col("low"), i, down))
    two = F.when(F.col("s.part") == 0, towards(F.col("top"), F.col("low"), i, whole)).when(flat, F.col("low")).otherwise(towards(F.when(upper > 0, F.col("side")).otherwise(F.col("top")), F.col("low"), i, down))
    # With the middle corner on the upper level, the first side starts at it and the second at the top.
    first = F.when((F.col("s.part") == 1) & (upper == 0) & ~flat, towards(F.col("top"), F.col("low"), i, down)).otherwise(one)
    second = F.when((F.col("s.part") == 1) & (upper == 0) & ~flat, towards(F.col("mid"), F.col("low"), i, down)).otherwise(two)
    return _lines(t.select("grid", first.alias("a"), second.alias("b")))


def _lines(ends: DataFrame) -> DataFrame:
    """grid, ix, iy, iz: the cells of lines (grid, a, b: arrays of three whole numbers): one for each step of the longest axis, the others cut towards a."""
    length = F.transform(F.arrays_zip("a", "b"), lambda x: F.abs(x["b"] - x["a"]))
    n = F.array_max("len")
    rows = ends.withColumn("len", length).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), n)))
    move = lambda k: F.col("a")[k] + F.signum(F.col("b")[k] - F.col("a")[k]).cast("bigint") * F.call_function("div", F.col("len")[k] * F.col("i"), F.greatest(n, F.lit(1)))
    return rows.select("grid", *[move(k).alias(a) for k, a in enumerate(AXES)])


def mesh_grid(vertices: DataFrame, spacing: float = 0.01, border: float = 40, most_cells: int = 512) -> DataFrame:
    """grid, spacing, scale, and for each axis n (cells), c (middle of the box): the grid around each mesh.

    The spacing grows until no side has more than most_cells cells, then `border` cells are added on each side.
    A mesh whose box has no volume has no grid.
    """
    box = vertices.groupBy(F.col("mesh").alias("grid")).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))])
    size = {c: F.col(f"high_{c}") - F.col(f"low_{c}") for c in "xyz"}
    box = box.where((size["x"] > 0) & (size["y"] > 0) & (size["z"] > 0)).withColumn("spacing", F.lit(float(spacing or 0.01)))
    for c in "xyz":
        box = box.withColumn("spacing", F.when(size[c] / F.col("spacing") > most_cells, size[c] / most_cells).otherwise(F.col("spacing")))
    full = {c: (F.col(f"high_{c}") + F.col("spacing") * border) - (F.col(f"low_{c}") - F.col("spacing") * border) for c in "xyz"}
    out = box.select("grid", "spacing", *[(full[c] / F.col("spacing") + 0.5).cast("bigint").alias(f"n_{a}") for c, a in zip("xyz", AXES, strict=True)], *[full[c].alias(f"l_{c}") for c in "xyz"], *[((F.col(f"low_{c}") + F.col(f"high_{c}")) / 2).alias(f"c_{c}") for c in "xyz"])
    scale = F.least(*[(F.col(f"n_{a}") - 1) / F.col(f"l_{c}") for c, a in zip("xyz", AXES, strict=True)])
    return out.select("grid", "spacing", scale.alias("scale"), *[f"n_{a}" for a in AXES], *[f"c_{c}" for c in "xyz"])


def mesh_cells(vertices: DataFrame, faces: DataFrame, grids: DataFrame) -> DataFrame:
    """grid, ix, iy, iz and the columns of grids: the cells that the faces of each mesh pass, once each."""
    placed = vertices.join(grids.withColumnRenamed("grid", "mesh"), "mesh")
    at = [((F.col(c) - F.col(f"c_{c}")) * F.col("scale") + 0.5 * (F.col(f"n_{a}") - 1) + 0.5).cast("bigint").alias(c) for c, a in zip("xyz", AXES, strict=True)]
    t = mesh.corners(placed.select("mesh", "vid", *at), faces)
    t = t.select(F.col("mesh").alias("grid"), *[F.struct(*[F.col(f"{c}{k}").alias(c) for c in "xyz"]).alias(f"p{k}") for k in range(3)])
    inside = " AND ".join(f"{a} BETWEEN 0 AND n_{a} - 1" for a in AXES)
    return rasterize_triangles(t).distinct().join(grids, "grid").where(inside)


def mesh_to_df(vertices: DataFrame, faces: DataFrame, spacing: float = 0.01, border: float = 40, most_cells: int = 512, truncation: float | None = None) -> DataFrame:
    """grid, ix, iy, iz, value: the distance of every cell to the surface of its mesh, in cells, cut at `truncation`.

    `mesh_grid` has the grid of each mesh. A mesh without faces in its grid has no rows.
    """
    cells = mesh_cells(vertices, faces, mesh_grid(vertices, spacing, border, most_cells))
    out = sources_of(cells, {a: F.col(f"n_{a}") for a in AXES})
    value = F.sqrt(F.col("d2").cast("double"))
    return out.select("grid", *AXES, (value if truncation is None else F.least(value, F.lit(float(truncation)))).alias("value"))
