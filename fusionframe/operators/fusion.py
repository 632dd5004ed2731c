"""Depth-frame fusion into truncated signed distances, and surface extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom


def valid_depth(depth: DataFrame, most: float = 6.0) -> DataFrame:
    return depth.where((F.col("d") > 0) & (F.col("d") <= most))


def ray_length(x, y):
    """Length of a ray to the plane z = 1, through (x, y) on it; it turns distances along z into distances along the ray."""
    return F.sqrt(1 + F.pow(x, F.lit(2.0)) + F.pow(y, F.lit(2.0)))


def _observed(diff, trunc: float):
    return F.least(F.lit(1.0), diff / trunc)


def fuse_dense(voxels: DataFrame, depth: DataFrame, poses: DataFrame, k: tuple, trunc: float, width: int = 640, height: int = 480, most: float = 6.0) -> DataFrame:
    """tsdf and weight of every voxel (vox, x, y, z) that a frame (frame, pose) sees.

    Every voxel goes to every frame, as free space in front of a surface counts too; poses are few
    and pixels meet by an equi-join on (frame, px, py). The running mean with unit weights
    is the plain mean, so it is combined on the map side.
    """
    seen = voxels.crossJoin(F.broadcast(poses)) if poses.count() <= 10_000 else voxels.join(poses)
    p = geom.inverse_transform(F.col("pose"), geom.xyz())
    seen = seen.select("vox", "frame", *[c.alias(n) for c, n in zip(p, ("cx", "cy", "cz"), strict=True)]).where("cz > 0")
    u, v = geom.project((F.col("cx"), F.col("cy"), F.col("cz")), k)
    seen = seen.select("vox", "frame", u.cast("int").alias("px"), v.cast("int").alias("py"), "cz", ray_length(F.try_divide("cx", "cz"), F.try_divide("cy", "cz")).alias("ray")).where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))
    hit = seen.join(valid_depth(depth, most).select("frame", "px", "py", "d"), ["frame", "px", "py"]).withColumn("diff", (F.col("d") - F.col("cz")) * F.col("ray")).where(F.col("diff") > -trunc)
    return hit.groupBy("vox").agg(F.avg(_observed(F.col("diff"), trunc)).alias("tsdf"), F.count("*").alias("weight"))


def band_samples(pixels: DataFrame, k: tuple, size: float, trunc: float) -> DataFrame:
    """pixels with z and diff, at steps of `size` along z from the surface, as far as the band of `trunc` along the ray reaches."""
    steps = int(round(trunc / size))
    fx, fy, cx, cy = k
    ray = ray_length((F.col("px") - cx) / fx, (F.col("py") - cy) / fy)
    out = pixels.withColumn("s", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).withColumn("z", F.col("d") + F.col("s") * size).withColumn("diff", -F.col("s") * size * ray)
    return out.where((F.col("diff") > -trunc) & (F.col("diff") <= trunc))


def fuse_band(depth: DataFrame, poses: DataFrame, k: tuple, size: float, trunc: float, most: float = 6.0) -> DataFrame:
    """tsdf and weight of the voxels along each pixel's ray within the truncation band: work grows with the pixels, not with the volume. Distances are along the ray. Free space in front of the band isn't counted."""
    seen = band_samples(valid_depth(depth, most), k, size, trunc).join(poses, "frame")
    z = F.col("z")
    x, y, _ = geom.backproject(F.col("px"), F.col("py"), z, k)
    world = geom.transform(F.col("pose"), (x, y, z))
    cell = [F.round(c / size).cast("long").alias(a) for c, a in zip(world, ("ix", "iy", "iz"), strict=True)]
    one = seen.select("frame", *cell, _observed(F.col("diff"), trunc).alias("t")).groupBy("frame", "ix", "iy", "iz").agg(F.avg("t").alias("t"))
    return one.groupBy("ix", "iy", "iz").agg(F.avg("t").alias("tsdf"), F.count("*").alias("weight"))


def surface(tsdf: DataFrame, limit: float = 0.2, least: float = 1.0) -> DataFrame:
    return tsdf.where((F.abs("tsdf") < limit) & (F.col("weight") > least))


def fragment_windows(frames: DataFrame, by: str, order: str, size: int = 50, stride: int = 50) -> DataFrame:
    """Fragments of `size` frames: frame k is in fragments that begin at a multiple of the stride within the last `size` frames."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    low = F.greatest(F.lit(0), F.ceil((F.col("n") - size + 1) / stride)).cast("int")
    return frames.withColumn("n", n).withColumn("fragment", F.explode(F.sequence(low, F.floor(F.col("n") / stride).cast("int"))))
