"""Benchmark reports: threshold sweeps, pose slices, segmentation scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_sweep(cmp: DataFrame, top: float, steps: int = 1001, d: str = "d", match: str = "is_match") -> DataFrame:
    """k, tp, fp, fn, tn for thresholds top * k / (steps - 1), where a distance under the threshold counts as a match.

    Distances are counted by the first threshold above them, and a running sum over the few counts
    gives the sweep, so the comparisons are read once and never meet the thresholds.
    """
    step = top / (steps - 1)
    first = F.greatest(F.floor(F.col(d) / step).cast("long") - 1, F.lit(0))
    # Rounding may put the first threshold above d one step off; test the neighbours exactly.
    k = F.when(F.col(d) < first * step, first).when(F.col(d) < (first + 1) * step, first + 1).when(F.col(d) < (first + 2) * step, first + 2).otherwise(first + 3)
    yes = F.col(match).cast("int")
    counts = cmp.select(k.alias("k"), yes.alias("y")).groupBy("k").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    return sweep_of_counts(counts, steps)


def sweep_of_counts(counts: DataFrame, steps: int = 1001) -> DataFrame:
    """The sweep from the p matches and n non-matches whose first threshold above the distance is k; k = steps is above them all."""
    from pyspark.sql import Window

    steps_and_rest = counts.sparkSession.range(steps + 1).withColumnRenamed("id", "k")
    by_k = counts.groupBy(F.least("k", F.lit(steps)).alias("k")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # one row a threshold
    total = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = steps_and_rest.join(by_k, "k", "left").fillna(0).select("k", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.sum("p").over(total).alias("all_p"), F.sum("n").over(total).alias("all_n"))
    return run.where(F.col("k") < steps).select("k", "tp", "fp", (F.col("all_p") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("fp")).alias("tn"))


def first_thresholds(d: np.ndarray, y: np.ndarray, top: float, steps: int = 1001):
    """k, p, n of many comparisons, as `sweep_of_counts` takes them."""
    import pandas as pd

    x = d * ((steps - 1) / top)
    with np.errstate(invalid="ignore"):
        near = ~(np.abs(x - np.rint(x)) > 1e-6)  # so near a threshold that rounding may count, or not a number
    x[near] = 0
    k = np.clip(np.floor(x), -1, steps - 1).astype(np.int64) + 1
    k[near] = np.searchsorted(np.arange(steps) * (top / (steps - 1)), d[near], "right")
    n, p = np.bincount(k + (steps + 1) * y, minlength=2 * steps + 2).reshape(2, -1)
    some = np.flatnonzero(p + n)
    return pd.DataFrame({"k": some, "p": p[some], "n": n[some]})


def rates(sweep: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sweep.select("k", share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tn, tn + fp).alias("tnr"), share(fp, fp + tn).alias("fpr"))


def fpr_at_recall(sweep: DataFrame, at: float = 0.95, slack: float = 0.001) -> DataFrame:
    """Mean false-positive rate where the recall is within the slack; null if no threshold is."""
    return rates(sweep).agg(F.avg(F.when((F.col("recall") > at - slack) & (F.col("recall") < at + slack), F.col("fpr"))).alias("fpr"))


def occlusion_bucket(occlusion: Column) -> Column:
    """low under 5, medium under 30, else high; a missing mean is high."""
    return F.when(occlusion < 5, "low").when(occlusion < 30, "medium").otherwise("high")


def sliced_accuracy(poses: DataFrame, slices: dict[str, Column], rot: str = "rot", trans: str = "trans", most_rot: float = 15.0, most_trans: float = 0.05) -> DataFrame:
    """slice, n, rot_acc, trans_acc; a pose counts in every slice whose condition holds."""
    marks = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in slices.items()]), lambda x: x.isNotNull())
    return poses.withColumn("slice", F.explode(marks)).groupBy("slice").agg(F.count("*").alias("n"), F.avg((F.col(rot) < most_rot).cast("double")).alias("rot_acc"), F.avg((F.col(trans) < most_trans).cast("double")).alias("trans_acc"))


def segmentation_fscore(poses: DataFrame, by: str, precision: str, recall: str) -> DataFrame:
    """Means without NaN, and their harmonic mean; null where both are 0."""
    clean = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    out = poses.groupBy(by).agg(clean(precision).alias("p"), clean(recall).alias("r"))
    return out.withColumn("f", F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
