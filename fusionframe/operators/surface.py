"""Local surface measures: normals, planes, outlier removal, projected boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from . import knn


def _moments(points: DataFrame, by: str) -> DataFrame:
    """n, sums and second sums of x, y, z by key."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return points.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"], *[F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in pairs])


def plane_pca(points: DataFrame, by: str) -> DataFrame:
    """by, n, centre (cx, cy, cz), normal (nx, ny, nz) with a positive largest entry, and the variances along the axes, smallest first. Sums are made on the cluster; one 3x3 matrix a key is solved."""
    return _planes(_moments(points, by), by)


def _planes(moments: DataFrame, by: str) -> DataFrame:
    """plane_pca from sums; where they are sums of offsets from a point (x, y, z), its place is added to the centre."""
    kind, about = moments.schema[by].dataType.simpleString(), "x" in moments.columns

    def solve(batches):
        import pandas as pd

        for r in batches:
            n = r["n"].to_numpy(float)[:, None]
            c = r[["sx", "sy", "sz"]].to_numpy(float) / n
            m = r[["sxx", "sxy", "sxz", "sxy", "syy", "syz", "sxz", "syz", "szz"]].to_numpy(float).reshape(-1, 3, 3) / n[:, :, None] - c[:, :, None] * c[:, None, :]
            w, v = np.linalg.eigh(m)
            first = v[:, :, 0]
            sign = np.sign(np.take_along_axis(first, np.abs(first).argmax(1)[:, None], 1))
            normal = first * np.where(sign == 0, 1.0, sign)
            if about:
                c = c + r[["x", "y", "z"]].to_numpy(float)
            out = pd.DataFrame(np.concatenate((c, normal, np.maximum(w, 0)), 1), columns=["cx", "cy", "cz", "nx", "ny", "nz", "v0", "v1", "v2"])
            yield pd.concat((r[[by, "n"]].reset_index(drop=True), out), axis=1)

    return moments.mapInPandas(solve, f"`{by}` {kind}, n bigint, " + ", ".join(f"{c} double" for c in ("cx", "cy", "cz", "nx", "ny", "nz", "v0", "v1", "v2")))


def normals(points: DataFrame, radius: float) -> DataFrame:
    """Plane of the neighbours within the radius of each point (id, x, y, z); ids are unique."""
    return _planes(knn.near_sums(points, points, radius), "id")


def refine_plane(points: DataFrame, by: str, tolerance: float, rounds: int = 3) -> DataFrame:
    """plane_pca of the points that lie within the tolerance of the plane before, a few times."""
    plane = plane_pca(points, by)
    for _ in range(rounds):
        j = points.join(plane.select(by, "cx", "cy", "cz", "nx", "ny", "nz"), by)
        off = F.abs(geom.total((F.col(c) - F.col(f"c{c}")) * F.col(f"n{c}") for c in "xyz"))
        plane = plane_pca(j.where(off <= tolerance).select(by, "x", "y", "z"), by)
    return plane


def denoise(vectors: DataFrame, k: int = 4, spread: float = 1.0) -> DataFrame:
    """q, mean_d of the vectors (q, t, v) whose mean distance to their k nearest others is at most the mean over all plus `spread` standard deviations."""
    near = knn.knn_join(vectors, vectors, k + 1).where("q <> t")
    ranked = near.groupBy("q").agg(F.sort_array(F.collect_list("d2")).alias("d")).select("q", F.slice("d", 1, k).alias("d"))  # at most k + 1 each
    mean = ranked.select("q", (F.aggregate("d", F.lit(0.0), lambda s, x: s + F.sqrt(x)) / F.size("d")).alias("mean_d"))
    level = mean.agg((F.avg("mean_d") + spread * F.stddev_samp("mean_d")).alias("level"))
    return mean.crossJoin(level).where("mean_d <= level").select("q", "mean_d")


def project_box(points: DataFrame, half: float, k: tuple, width: int = 640, height: int = 480) -> DataFrame:
    """Pixel box (u0, u1, v0, v1) of the cube around each camera point (key columns are kept), cut to the image; null where a corner isn't in front."""
    u, v = [], []
    for c in range(8):
        p = tuple(F.col(a) + (half if c >> i & 1 else -half) for i, a in enumerate("xyz"))
        a, b = geom.project(p, k)
        u.append(a)
        v.append(b)
    front = F.col("z") - half > 0
    cut = lambda x, most: F.when(front, F.greatest(F.lit(0.0), F.least(F.lit(float(most - 1)), x)))
    return points.select("*", cut(F.least(*u), width).alias("u0"), cut(F.greatest(*u), width).alias("u1"), cut(F.least(*v), height).alias("v0"), cut(F.greatest(*v), height).alias("v1"))
