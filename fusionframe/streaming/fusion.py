"""Streaming fusion: the same band fusion over arriving depth pixels (an extension; the mean is a sum and a count, so the state is two numbers a voxel)."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..operators.fusion import band_samples, valid_depth


def fuse_stream(pixels: DataFrame, poses: DataFrame, k: tuple, size: float, trunc: float, most: float = 6.0) -> DataFrame:
    """Running tsdf and weight of the voxels in the band of each pixel; write it in update or complete mode. Every pixel counts, also two of one frame in one voxel."""
    seen = band_samples(valid_depth(pixels, most), k, size, trunc).join(poses, "frame")
    world = geom.transform(F.col("pose"), geom.backproject(F.col("px"), F.col("py"), F.col("z"), k))
    cell = [F.round(c / size).cast("long").alias(a) for c, a in zip(world, ("ix", "iy", "iz"), strict=True)]
    return seen.groupBy(*cell).agg(F.avg(F.least(F.lit(1.0), F.col("diff") / trunc)).alias("tsdf"), F.count("*").alias("weight"))


BLOCK = 16  # cells a side that share a state


def fuse_frames(pixels: DataFrame, poses: DataFrame, k: tuple, size: float, trunc: float, lag: int = 1, most: float = 6.0) -> DataFrame:
    """ix, iy, iz, tsdf, weight of the voxels that a batch has changed; write it in update mode. Weights count frames, as `fuse_band`'s do.

    The pixels of a frame may come in several batches. A voxel's frame stays open, as a sum and a count of pixels, until one
    more than `lag` frames later has come into its block of voxels; then its mean is added to the voxel and only that is kept. So
    the state of a voxel is two numbers and its open frames. Frames come in order but for `lag`; pixels of a frame that was closed
    before them are late, and are left out. The last row of each voxel is that of `fuse_band` over all pixels so far that weren't late.
    """
    seen = band_samples(valid_depth(pixels, most), k, size, trunc).join(poses, "frame")
    world = geom.transform(F.col("pose"), geom.backproject(F.col("px"), F.col("py"), F.col("z"), k))
    cell = [F.round(c / size).cast("long").alias(a) for c, a in zip(world, ("ix", "iy", "iz"), strict=True)]
    own = seen.select(F.col("frame").cast("long").alias("frame"), *cell, F.least(F.lit(1.0), F.col("diff") / trunc).alias("t"))
    own = own.withColumns({f"b{c}": F.floor(F.col(f"i{c}") / BLOCK) for c in "xyz"})
    cells = ["ix", "iy", "iz"]

    def update(key, frames, state):
        import pandas as pd

        new = pd.concat(list(frames))[["frame", *cells, "t"]]
        read = lambda x: pd.read_json(io.StringIO(x), orient="split", dtype=False, precise_float=True)
        closed, opened, last = (read(state.get[0]), read(state.get[1]), state.get[2]) if state.exists else (None, None, -1)
        done = last - lag  # frames before it are closed
        new = new[new.frame >= done]
        if new.empty:
            return
        touched = new[cells].drop_duplicates()
        sums = new.groupby([*cells, "frame"], as_index=False).agg(s=("t", "sum"), n=("t", "size"))
        opened = sums if opened is None else pd.concat([opened, sums]).groupby([*cells, "frame"], as_index=False).sum()
        last = max(last, int(new.frame.max()))
        old = opened[opened.frame < last - lag].assign(s=lambda x: x.s / x.n, n=1)[[*cells, "s", "n"]]
        opened = opened[opened.frame >= last - lag]
        closed = (old if closed is None else pd.concat([closed, old])).groupby(cells, as_index=False).sum()
        write = lambda x: x.to_json(orient="split", index=False, double_precision=15)
        state.update((write(closed), write(opened), last))
        full = pd.concat([closed, opened.assign(s=opened.s / opened.n, n=1)[[*cells, "s", "n"]]]).merge(touched, on=cells).groupby(cells, as_index=False).sum()
        yield pd.DataFrame({**{c: full[c].astype("int64") for c in cells}, "tsdf": full.s / full.n, "weight": full.n.astype("int64")})

    out = "ix bigint, iy bigint, iz bigint, tsdf double, weight bigint"
    return own.groupBy("bx", "by", "bz").applyInPandasWithState(update, out, "closed string, opened string, last bigint", "update", "NoTimeout")
