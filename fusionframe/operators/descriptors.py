"""Fast point feature histograms: 33 numbers for each oriented point, from pairs of neighbours in two passes.

The first pass makes three histograms of eleven bins of the angles between a point's normal, its neighbours' normals and the
lines between them. The second adds up the neighbours' histograms, weighted by the inverse squared distance.
Neighbours are a table of pairs, so a range join or a nearest-neighbour join may make it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom

BINS = 11


def _bin(x: Column, low: float, high: float) -> Column:
    """The bin of x, values at the ends in the outer ones."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(BINS * (x - low) / (high - low)).cast("int")))


def pair_angles(pairs: DataFrame) -> DataFrame:
    """pairs (columns a_ and b_ of x, y, z, nx, ny, nz) with turn (-pi to pi), side and lean (-1 to 1) of each.

    Of the two points that whose normal is nearer to the line is the one that the frame stands on. Pairs in one place, or
    whose line is along that normal, have nulls.
    """
    vec = lambda s, n="": [F.col(f"{s}_{n}{c}") for c in "xyz"]
    line = geom.sub(vec("b"), vec("a"))
    far = F.sqrt(geom.norm2(line))
    out = pairs.withColumns({f"_l{k}": F.try_divide(x, far) for k, x in enumerate(line)})
    line = [F.col(f"_l{k}") for k in range(3)]
    out = out.withColumn("_p", geom.dot(vec("a", "n"), line)).withColumn("_q", geom.dot(vec("b", "n"), line))
    turned = F.abs("_p") < F.abs("_q")
    pick = lambda x, y: F.when(turned, y).otherwise(x)
    out = out.withColumns({f"_u{k}": pick(x, y) for k, (x, y) in enumerate(zip(vec("a", "n"), vec("b", "n"), strict=True))} | {f"_m{k}": pick(y, x) for k, (x, y) in enumerate(zip(vec("a", "n"), vec("b", "n"), strict=True))} | {f"_d{k}": pick(x, -x) for k, x in enumerate(line)} | {"lean": pick(F.col("_p"), -F.col("_q"))})
    u, m, d = ([F.col(f"_{n}{k}") for k in range(3)] for n in "umd")
    out = out.withColumns({f"_c{k}": x for k, x in enumerate(geom.cross(d, u))})
    size = F.sqrt(geom.norm2([F.col(f"_c{k}") for k in range(3)]))
    out = out.withColumns({f"_v{k}": F.try_divide(F.col(f"_c{k}"), size) for k in range(3)})
    v = [F.col(f"_v{k}") for k in range(3)]
    w = geom.cross(u, v)
    out = out.withColumns({"side": geom.dot(v, m), "turn": F.atan2(geom.dot(w, m), geom.dot(u, m))})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def fpfh(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, histogram (33 doubles): turn, side and lean, eleven bins each, every group summing to 100.

    points: id, x, y, z and unit normals nx, ny, nz; pairs: a, b, the ids of each point and its neighbours (in both
    directions, without itself). Points without a neighbour that has a histogram have no row.
    """
    full = pairs.select("a", "b")
    for s in "ab":
        full = full.join(points.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("x", "y", "z", "nx", "ny", "nz")]), s)
    d2 = geom.norm2([F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"])
    full = pair_angles(full.withColumn("d2", d2)).where("d2 > 0").select("a", "b", "d2", "turn", "side", "lean")
    at = [_bin(F.col("turn"), -math.pi, math.pi), _bin(F.col("side"), -1.0, 1.0), _bin(F.col("lean"), -1.0, 1.0)]
    there = full.where("side IS NOT NULL")
    counts = [F.sum(F.when(b == k, 1.0).otherwise(0.0)).alias(f"h{g}_{k}") for g, b in enumerate(at) for k in range(BINS)]
    first = there.groupBy("a").agg(F.count("*").alias("n"), *counts)
    names = [f"h{g}_{k}" for g in range(3) for k in range(BINS)]
    near = full.select("a", "b", "d2").join(first.select(F.col("a").alias("b"), *[(100.0 * F.col(c) / F.col("n")).alias(c) for c in names]), "b")
    sums = near.groupBy("a").agg(*[F.sum(F.col(c) / F.col("d2")).alias(c) for c in names])
    whole = [geom.total(F.col(f"h{g}_{k}") for k in range(BINS)) for g in range(3)]
    return sums.select(F.col("a").alias("id"), F.array(*[100.0 * F.col(f"h{g}_{k}") / whole[g] for g in range(3) for k in range(BINS)]).alias("histogram"))
