"""Reliable checkpoints for iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame, clean: bool = False) -> DataFrame:
    """The rows in files of spark.checkpoint.dir; of a folder of our own only in local mode, where all share one machine. clean: the shuffle files that made them go at once, and so do estimates of their size, whose digits double whenever a table is joined with itself."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fusionframe-"))
    if not clean:
        return df.checkpoint()
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        out = df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False), spark)
