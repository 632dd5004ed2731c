"""Dense numbers for sorted rows without a global window: ranges of the sort, numbered by offsets of their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoint import checkpointed


def dense_ids(distinct: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """distinct rows with `name` from 1 in sort order."""
    at = F.monotonically_increasing_id()  # the partition, and 33 bits of the row
    parts = checkpointed(distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.shiftright(at, 33), "own": at.bitwiseAND((1 << 33) - 1)}), clean=True)
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("base", F.lit(0)).alias("base"))  # one row a partition
    return parts.join(F.broadcast(before), "part").select(*distinct.columns, (F.col("base") + F.col("own") + 1).alias(name))
