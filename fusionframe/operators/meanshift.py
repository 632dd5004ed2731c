"""Mean shift of the cells of a grid: every cell over 0 climbs to a mode.

Seeds move within blocks of BLOCK cells a side; a block knows the cells around it too, so a seed climbs there until it
converges or leaves the block, and only those that left take part in the next round. Which cell a seed
ends in is followed on by pointer doubling, until that cell's own seed stays where it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import checkpointed
from .voxel import AXES

BLOCK, HALO = 16, 4
_OFF = np.arange(-2, 3)
_KERNEL = np.exp(-(_OFF[:, None, None] ** 2 + _OFF[None, :, None] ** 2 + _OFF[None, None, :] ** 2) / 2.0)


def _climb(field: np.ndarray, p: np.ndarray, low: np.ndarray, done: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, converged, steps) of seeds at p, moved until they converge, leave the block at `low`, or have taken `most` steps; field holds the cells from low - HALO on."""
    p, still, converged = p.copy(), done < most, np.zeros(len(p), bool)
    done = done.copy()
    while still.any():
        at = np.flatnonzero(still)
        base = np.floor(p[at]).astype(int)
        f = p[at] - base
        first = base - low + HALO - 2
        k = np.arange(6)
        near = field[(first[:, 0, None] + k)[:, :, None, None], (first[:, 1, None] + k)[:, None, :, None], (first[:, 2, None] + k)[:, None, None, :]]
        for axis in range(3):  # values between cells, one axis after the other
            a, b = [slice(None)] * 4, [slice(None)] * 4
            a[axis + 1], b[axis + 1] = slice(0, 5), slice(1, 6)
            share = f[:, axis, None, None, None]
            near = near[tuple(a)] * (1 - share) + near[tuple(b)] * share
        w = np.where(near > 0, near, 0) * _KERNEL
        move = np.stack([(w * _OFF.reshape([-1 if i == axis else 1 for i in range(3)])).sum((1, 2, 3)) for axis in range(3)], 1)
        weight = w.sum((1, 2, 3))
        stays = (weight == 0) | ((move * move).sum(1) < 1e-6)
        converged[at[stays]] = True
        goes = at[~stays]
        p[goes] += move[~stays] / weight[~stays, None]
        done[goes] += 1
        still[at[stays]] = False
        out = ((p < low) | (p >= low + BLOCK)).any(1) | (done >= most)
        still &= ~out
    return p, converged, done


def mean_shift(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """grid, ix, iy, iz, mx, my, mz, steps, converged: the mode of each cell over 0, under a Gaussian of one cell cut at two, values between cells being trilinear.

    A seed takes as many steps as the longest side has cells at most; `converged` is false where it hadn't come to
    rest by then. Its cell is the nearest one; where that cell's own seed ends elsewhere the mode is
    that of the latter, so modes are cells that end in themselves (or have no value). Negative values count as 0.
    """
    most, fields = max(dims), [("ix", 0), ("iy", 1), ("iz", 2)]
    own = voxels.where("value > 0").select("grid", *[F.col(a).cast("bigint").alias(a) for a in AXES], F.col("value").cast("double").alias("value"))
    halo = own
    for a, _ in fields:  # a cell belongs to its block, and to those that it lies near to
        ends = F.array_distinct(F.array(F.floor((F.col(a) - HALO) / BLOCK), F.floor(F.col(a) / BLOCK), F.floor((F.col(a) + HALO) / BLOCK)))
        halo = halo.withColumn(f"b{a[1]}", F.explode(ends))
    halo = checkpointed(halo)
    seeds = own.select("grid", *AXES, *[F.col(a).cast("double").alias(f"p{a[1]}") for a in AXES], F.lit(0).cast("bigint").alias("steps"), F.lit(False).alias("converged"), F.lit(True).alias("open"))
    schema = f"grid {voxels.schema['grid'].dataType.simpleString()}, ix bigint, iy bigint, iz bigint, px double, py double, pz double, steps bigint, converged boolean, open boolean"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        moving = left.drop_columns(["bx", "by", "bz"])
        if not len(left):
            return moving
        low = np.array([left[c][0].as_py() for c in ("bx", "by", "bz")]) * BLOCK
        field = np.zeros((BLOCK + 2 * HALO + 2,) * 3)
        at = np.stack([right[a].to_numpy() for a in AXES], 1) - low + HALO
        inside = ((at >= 0) & (at < len(field))).all(1)
        field[tuple(at[inside].T)] = right["value"].to_numpy()[inside]
        p = np.stack([moving[f"p{c}"].to_numpy() for c in "xyz"], 1)
        p, converged, steps = _climb(field, p, low, moving["steps"].to_numpy(), most)
        new = {"px": p[:, 0], "py": p[:, 1], "pz": p[:, 2], "steps": steps, "converged": converged, "open": ~converged & (steps < most)}
        for name, x in new.items():
            moving = moving.set_column(moving.schema.get_field_index(name), name, pa.array(x))
        return moving

    rested = None
    while not (seeds := checkpointed(seeds)).isEmpty():
        here = seeds.withColumns({f"b{c}": F.floor(F.col(f"p{c}") / BLOCK) for c in "xyz"})
        keys = ["grid", "bx", "by", "bz"]
        moved = checkpointed(here.groupBy(*keys).cogroup(halo.groupBy(*keys)).applyInArrow(run, schema))
        still = moved.where("NOT open")
        rested = still if rested is None else rested.unionByName(still)
        seeds = moved.where("open")
    if rested is None:
        rested = seeds
    cell = [F.least(F.greatest(F.floor(F.col(f"p{a[1]}") + 0.5), F.lit(0)), F.lit(n - 1)).cast("bigint").alias(f"m{a[1]}") for a, n in zip(AXES, dims, strict=True)]
    flow = checkpointed(rested.select("grid", *AXES, "steps", "converged", *cell))
    target = ["mx", "my", "mz"]
    for _ in range(max(1, (dims[0] * dims[1] * dims[2]).bit_length())):
        nxt = flow.select("grid", *[F.col(a).alias(t) for a, t in zip(AXES, target, strict=True)], *[F.col(t).alias(f"n{t}") for t in target])
        hop = flow.join(nxt, ["grid", *target], "left")
        further = checkpointed(hop.select("grid", *AXES, "steps", "converged", *target, *[F.coalesce(f"n{t}", t).alias(f"n{t}") for t in target]))
        flow = further.select("grid", *AXES, "steps", "converged", *[F.col(f"n{t}").alias(t) for t in target])
        if further.where(" OR ".join(f"n{t} <> {t}" for t in target)).isEmpty():
            break
    return flow.select("grid", *AXES, *target, "steps", "converged")
