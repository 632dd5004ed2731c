"""Connected components of an edge table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

SALTS = 8


def _with_low(rows: DataFrame, key: str, low: DataFrame) -> DataFrame:
    """rows with m of low (u, m) where u is their key, null where there is none; the rows of a key are dealt over SALTS tasks by their other node. Never broadcast: Spark would judge the size before the copies."""
    other = "u" if key == "v" else "v"
    spread = low.select(F.col("u").alias(key), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")
    return rows.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(spread, [key, "salt"], "left").drop("salt")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node of it) for every node of an edge; alternating large-star and small-star steps.

    Each step points nodes at the smallest neighbour, so a star of any size needs few rounds and
    no group is gathered: all is min() and joins, and a join deals the edges of one node over several
    tasks. Edges with a null end are ignored.
    """
    e = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # Edges lead down from u to v. Large star: u goes to the smallest neighbour of v, or to v where none is smaller.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        large = _with_low(e, "v", low).select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: the smaller neighbours of u, and u, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_low(large, "u", least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small)
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        dropped(e)
        e = new
        if same:
            break
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
