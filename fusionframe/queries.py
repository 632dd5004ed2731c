"""Registered queries of the geometry operators, each with SQL that gives the same rows.

The tables at hand hold no geometry, so queries use views on them: descriptors from `embeddings`,
points and depth pixels from `lineitem`, poses from `nation`, frames from `events`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geom
from .operators import evaluate, fusion, knn, mesh, mining, registration, surface, voxel

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

K = (585.0, 585.0, 320.0, 240.0)
VOXEL = 0.05
DIMS = (22, 22, 22)

EMB = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), a AS (SELECT * FROM e WHERE vec_id % 2 = 0), b AS (SELECT * FROM e WHERE vec_id % 2 = 1), d AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d2 FROM a, b)"
PTS = "WITH pts AS (SELECT l_returnflag AS cloud, l_quantity * 0.02e0 AS x, l_extendedprice * 1e-5 AS y, l_discount * 10e0 AS z FROM lineitem)"
VOX = PTS + ", vox AS (SELECT cloud AS grid, round(x / 0.05e0)::BIGINT AS ix, round(y / 0.05e0)::BIGINT AS iy, round(z / 0.05e0)::BIGINT AS iz, count(*)::DOUBLE AS value FROM pts GROUP BY ALL)"
CMP = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), cmp AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(a.label = b.label AS INT) AS y, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) AS d FROM e a, e b WHERE a.vec_id < b.vec_id)"
DEPTH = "WITH depth AS (SELECT l_linenumber AS frame, l_partkey % 640 AS px, l_orderkey % 480 AS py, min((l_extendedprice % 8000) / 1000e0) AS d FROM lineitem GROUP BY ALL), pose AS (SELECT n_nationkey AS frame, cos(0.1e0 * n_nationkey) AS c, sin(0.1e0 * n_nationkey) AS s, 0.1e0 * n_regionkey AS tx, 0.05e0 * n_nationkey AS ty, 0.02e0 * n_nationkey AS tz FROM nation)"
OFFSETS = ", r AS (SELECT unnest(range(-{r}, {r} + 1)) AS o), offs AS (SELECT p.o AS ox, q.o AS oy, s.o AS oz FROM r p, r q, r s)"


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def descriptors(spark, d, half: int | None = None) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("q"), F.col("vec_id").alias("t"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return e if half is None else e.where(F.col("q") % 2 == half)


def points(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cloud"), (F.col("l_quantity") * 0.02).alias("x"), (F.col("l_extendedprice") * 1e-5).alias("y"), (F.col("l_discount") * 10.0).alias("z"))


def voxels(spark, d) -> DataFrame:
    i = [F.round(F.col(c) / VOXEL).cast("long").alias(a) for c, a in zip("xyz", voxel.AXES, strict=True)]
    return points(spark, d).groupBy(F.col("cloud").alias("grid"), *i).agg(F.count("*").cast("double").alias("value"))


def compared(spark, d, fold: Callable, schema: str, merge: Callable) -> DataFrame:
    """Partial results of all pairs of descriptors, made block by block; the vectors travel as they are stored."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"), "label")
    return knn.all_pairs(e, fold, schema, merge=merge)


def mean_over_pairs(spark, d, **of: Callable) -> DataFrame:
    """n, and the means of some functions of distance and label over all pairs of descriptors."""

    def sums(x, y):
        return pd.DataFrame({"n": [len(x)], **{name: [float(f(x, y).sum())] for name, f in of.items()}})

    add = lambda f: pd.DataFrame({c: [f[c].sum()] for c in f})
    part = compared(spark, d, sums, "n bigint" + "".join(f", {name} double" for name in of), add)
    n = F.coalesce(F.sum("n"), F.lit(0))
    return part.agg(n.alias("n"), *[F.when(n > 0, F.sum(name) / n).alias(name) for name in of])


def depth(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 640).alias("px"), (F.col("l_orderkey") % 480).alias("py")).agg(F.min((F.col("l_extendedprice") % 8000) / 1000.0).alias("d"))


def poses(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("double")
    c, s, zero, one = F.cos(0.1 * k), F.sin(0.1 * k), F.lit(0.0), F.lit(1.0)
    return n.select(F.col("n_nationkey").alias("frame"), F.array(c, -s, zero, 0.1 * F.col("n_regionkey"), s, c, zero, 0.05 * k, zero, zero, one, 0.02 * k, zero, zero, zero, one).alias("pose"))


def rounded(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) + 0.0 for c in columns})


# --- joins on descriptors --------------------------------------------------------------------


@query("mutual_nn", EMB + ", x AS (SELECT a, arg_min(b, (d2, b)) AS b, min(d2) AS d2 FROM d GROUP BY a), y AS (SELECT b, arg_min(a, (d2, a)) AS a FROM d GROUP BY b) SELECT x.a, x.b, round(x.d2, 6) AS d2 FROM x JOIN y ON x.a = y.a AND x.b = y.b")
def mutual_nn(spark, d):
    return rounded(knn.mutual_nn(descriptors(spark, d, 0), descriptors(spark, d, 1)), "d2")


@query("knn1", EMB + " SELECT a AS q, arg_min(b, (d2, b)) AS t, round(min(d2), 6) AS d2 FROM d GROUP BY a")
def knn1(spark, d):
    return rounded(knn.knn_join(descriptors(spark, d, 0), descriptors(spark, d, 1)), "d2").select("q", "t", "d2")


@query("knn_k", EMB + ", r AS (SELECT a AS q, b AS t, d2, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS rank FROM d) SELECT q, t, round(d2, 6) AS d2, rank FROM r WHERE rank <= 5")
def knn_k(spark, d):
    return rounded(knn.knn_join(descriptors(spark, d, 0), descriptors(spark, d, 1), 5), "d2").withColumn("rank", F.col("rank").cast("long"))


@query("find_furthest", EMB + " SELECT a AS q, arg_min(b, (-d2, b)) AS t, round(max(d2), 6) AS d2 FROM d GROUP BY a")
def find_furthest(spark, d):
    return rounded(knn.knn_join(descriptors(spark, d, 0), descriptors(spark, d, 1), 1, furthest=True), "d2").select("q", "t", "d2")


@query("bounded_nn", EMB + " SELECT a AS q, arg_min(b, (d2, b)) AS t, round(min(d2), 6) AS d2 FROM d WHERE d2 BETWEEN 0.5e0 AND 100e0 GROUP BY a")
def bounded_nn(spark, d):
    return rounded(knn.knn_join(descriptors(spark, d, 0), descriptors(spark, d, 1), 1, min_d2=0.5, max_d2=100.0), "d2").select("q", "t", "d2")


@query("descriptor_l2", EMB + " SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS l2, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS sq_l2 FROM a JOIN b ON b.vec_id = a.vec_id + 1")
def descriptor_l2(spark, d):
    a, b = descriptors(spark, d, 0).select("q", "v"), descriptors(spark, d, 1).select((F.col("t") - 1).alias("q"), F.col("v").alias("w"))
    return rounded(a.join(b, "q").select(F.col("q").alias("a"), (F.col("q") + 1).alias("b"), geom.l2(F.col("v"), F.col("w")).alias("l2"), geom.sq_l2(F.col("v"), F.col("w")).alias("sq_l2")), "l2", "sq_l2")


@query("trunc_similarity", EMB + ", m AS (SELECT a AS q, min(d2) AS d2 FROM d GROUP BY a) SELECT q, round(1 - least(sqrt(d2), 10e0) / 10e0, 6) AS sim FROM m")
def trunc_similarity(spark, d):
    near = knn.knn_join(descriptors(spark, d, 0), descriptors(spark, d, 1))
    return rounded(near.select("q", geom.trunc_similarity(F.sqrt("d2"), 10.0).alias("sim")), "sim")


# --- joins on points -------------------------------------------------------------------------

CLOUD_AB = PTS + ", p AS (SELECT cloud, x, y, z, (dense_rank() OVER (ORDER BY x, y, z)) AS id FROM (SELECT DISTINCT cloud, x, y, z FROM pts WHERE cloud IN ('A', 'N'))), a AS (SELECT * FROM p WHERE cloud = 'A'), b AS (SELECT * FROM p WHERE cloud = 'N')"


def two_clouds(spark, d):
    """Clouds A and N. Values of z are 0.1 apart, over twice any radius here, so SQL may join on them."""
    from .plans.numbering import dense_ids

    p = points(spark, d).where("cloud IN ('A', 'N')").groupBy("x", "y", "z").agg(*[F.max(F.col("cloud") == c).alias(c) for c in "AN"])
    p = dense_ids(p, ["x", "y", "z"]).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    return tuple(p.where(c).select("x", "y", "z", F.lit(c).alias("cloud"), "id") for c in "AN")


@query("range_pairs", CLOUD_AB + " SELECT a.id AS a_id, count(*) AS n, round(sum((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS d2 FROM a JOIN b ON round(a.z * 10) = round(b.z * 10) AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.0401e0*0.0401e0 GROUP BY a.id")
def range_pairs(spark, d):
    a, b = two_clouds(spark, d)
    return rounded(knn.near_sums(a, b, 0.0401).select(F.col("id").alias("a_id"), "n", (F.col("sxx") + F.col("syy") + F.col("szz")).alias("d2")), "d2")


_NEAR = "a.id IN (SELECT a.id FROM a JOIN b ON round(a.z * 10) = round(b.z * 10) AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.0101e0*0.0101e0)"


@query("semi_within", CLOUD_AB + f" SELECT id, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM a WHERE {_NEAR}")
def semi_within(spark, d):
    a, b = two_clouds(spark, d)
    return rounded(knn.within(a, b, 0.0101), "x", "y", "z", n=9).select("id", "x", "y", "z")


@query("anti_within", CLOUD_AB + f" SELECT id, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM a WHERE NOT {_NEAR}")
def anti_within(spark, d):
    a, b = two_clouds(spark, d)
    return rounded(knn.within(a, b, 0.0101, anti=True), "x", "y", "z", n=9).select("id", "x", "y", "z")


@query("overlap_ratio", CLOUD_AB + f" SELECT round(avg(CASE WHEN id IN (SELECT a.id FROM a JOIN b ON round(a.z * 10) = round(b.z * 10) AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.0101e0*0.0101e0) THEN 1e0 ELSE 0e0 END), 6) AS ratio, count(*) AS n FROM a")
def overlap_ratio(spark, d):
    a, b = two_clouds(spark, d)
    near = knn.range_join(a.select("id", "x", "y", "z"), b.select("x", "y", "z"), 0.0101, strict=True).select(F.col("a_id").alias("id")).distinct().withColumn("hit", F.lit(1.0))
    return rounded(a.join(near, "id", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("ratio"), F.count("*").alias("n")), "ratio")


@query("closest_to_shapes", PTS + " SELECT cloud, round(min(abs(x + 2 * y + 2 * z - 3) / 3), 6) AS plane, round(min(sqrt(greatest(0, x*x+y*y+z*z - (x+y+z)*(x+y+z)/3))), 6) AS line, round(avg(sqrt(greatest(0, 0.2e0-x, x-0.4e0)**2 + greatest(0, 0.2e0-y, y-0.4e0)**2 + greatest(0, 0.2e0-z, z-0.4e0)**2)), 6) AS box, round(avg(greatest(0, sqrt((x-0.5e0)**2+(y-0.5e0)**2+(z-0.5e0)**2) - 0.25e0)), 6) AS sphere, count(*) FILTER (WHERE x BETWEEN 0.2e0 AND 0.4e0 AND y BETWEEN 0.2e0 AND 0.4e0 AND z BETWEEN 0.2e0 AND 0.4e0) AS inside FROM pts GROUP BY cloud")
def closest_to_shapes(spark, d):
    p = geom.xyz()
    third = 3**-0.5
    unit = tuple(F.lit(third) for _ in range(3))
    zero = tuple(F.lit(0.0) for _ in range(3))
    plane = F.abs(geom.point_plane(p, tuple(F.lit(x) for x in (1 / 3, 2 / 3, 2 / 3)), -1.0))
    out = points(spark, d).groupBy("cloud").agg(
        F.min(plane).alias("plane"), F.min(F.sqrt(geom.point_line2(p, zero, unit))).alias("line"), F.avg(geom.point_box(p, (0.2,) * 3, (0.4,) * 3)).alias("box"),
        F.avg(geom.point_sphere(p, (0.5,) * 3, 0.25)).alias("sphere"), F.count_if(geom.in_box(p, (0.2,) * 3, (0.4,) * 3)).alias("inside"),
    )
    return rounded(out, "plane", "line", "box", "sphere")


@query("asof_nearest", "WITH f AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), j AS (SELECT f.event_id, f.user_id, arg_min(c.event_id, (abs(epoch_us(c.ts) - epoch_us(f.ts)), c.ts, c.event_id)) AS match FROM f LEFT JOIN c ON f.user_id = c.user_id GROUP BY ALL) SELECT user_id, event_id, match FROM j")
def asof_nearest(spark, d):
    e = table(spark, d, "events")
    return knn.asof_nearest(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "ts", "event_id").select("user_id", "event_id", "match")


@query("asof_unique")
def asof_unique(spark, d):
    e = table(spark, d, "events")
    return knn.asof_nearest(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "ts", "event_id", unique=True)


# --- losses and sweeps -----------------------------------------------------------------------


@query("contrastive_loss", CMP + " SELECT round(avg(0.5e0 * (y * d * d + (1 - y) * greatest(10e0 - d, 0) * greatest(10e0 - d, 0))), 6) AS loss, count(*) AS n FROM cmp")
def contrastive_loss(spark, d):
    loss = lambda x, y: 0.5 * np.where(y == 1, x * x, np.maximum(10.0 - x, 0) ** 2)
    return rounded(mean_over_pairs(spark, d, loss=loss), "loss").select("loss", "n")


@query("regression_losses", CMP + ", x AS (SELECT d / 10e0 - y AS r FROM cmp) SELECT round(avg(CASE WHEN abs(r) < 1 THEN 0.5e0 * r * r ELSE abs(r) - 0.5e0 END), 6) AS smooth_l1, round(avg(0.5e0 * r * r), 6) AS sse, round(avg(abs(r)), 6) AS amean FROM x")
def regression_losses(spark, d):
    r = lambda x, y: x / 10.0 - y
    smooth = lambda e: np.where(np.abs(e) < 1, 0.5 * e * e, np.abs(e) - 0.5)
    out = mean_over_pairs(spark, d, smooth_l1=lambda x, y: smooth(r(x, y)), sse=lambda x, y: 0.5 * r(x, y) ** 2, amean=lambda x, y: np.abs(r(x, y)))
    return rounded(out.drop("n"), "smooth_l1", "sse", "amean")


@query("log_loss", CMP + ", p AS (SELECT y, 1 / (1 + exp(d - 9e0)) AS p FROM cmp) SELECT round(avg(abs(ln(CASE WHEN y = 1 THEN p ELSE 1 - p END))), 6) AS loss, round(avg(CASE WHEN (p > 0.5e0) = (y = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM p")
def log_loss(spark, d):
    p = lambda x: 1 / (1 + np.exp(x - 9.0))
    loss = lambda x, y: np.abs(np.log(np.where(y == 1, p(x), 1 - p(x))))
    return rounded(mean_over_pairs(spark, d, loss=loss, accuracy=lambda x, y: ((p(x) > 0.5) == (y == 1)).astype(float)).drop("n"), "loss", "accuracy")


@query("lr_schedule", "SELECT range AS it, 0.001e0 AS fixed, round(0.001e0 * 0.1e0 ** floor(range / 1000), 9) AS step, round(0.001e0 * 0.999e0 ** range, 9) AS exp, round(0.001e0 * (1 + 0.001e0 * range) ** -0.75e0, 9) AS inv, round(0.001e0 * 0.1e0 ** ((range >= 2000)::INT + (range >= 4000)::INT), 9) AS multistep, round(0.001e0 * (1 - range / 10000e0) ** 0.75e0, 9) AS poly, round(0.001e0 / (1 + exp(-0.001e0 * (range - 1000))), 9) AS sigmoid FROM range(0, 5000, 50)")
def lr_schedule(spark, d):
    it, lr = F.col("it"), geom.learning_rate
    out = spark.range(0, 5000, 50).select(F.col("id").alias("it")).select("it", F.lit(0.001).alias("fixed"), lr("step", it, 0.001).alias("step"), lr("exp", it, 0.001, 0.999).alias("exp"), lr("inv", it, 0.001, 0.001).alias("inv"), lr("multistep", it, 0.001, steps=(2000, 4000)).alias("multistep"), lr("poly", it, 0.001).alias("poly"), lr("sigmoid", it, 0.001, 0.001).alias("sigmoid"))
    return rounded(out, *out.columns[2:], n=9)


SWEEP = CMP + ", t AS (SELECT unnest(range(1001)) AS k), s AS (SELECT k, count(*) FILTER (WHERE y = 1 AND d < k * (20e0 / 1000)) AS tp, count(*) FILTER (WHERE y = 0 AND d < k * (20e0 / 1000)) AS fp, count(*) FILTER (WHERE y = 1 AND NOT d < k * (20e0 / 1000)) AS fn, count(*) FILTER (WHERE y = 0 AND NOT d < k * (20e0 / 1000)) AS tn FROM t, cmp GROUP BY k)"


@query("confusion_sweep", SWEEP + " SELECT * FROM s")
def confusion_sweep(spark, d):
    part = compared(spark, d, lambda x, y: evaluate.first_thresholds(x, y, 20.0), "k bigint, p bigint, n bigint", lambda f: f.groupby("k", as_index=False).sum())
    return evaluate.sweep_of_counts(part)


@query("sweep_rates", SWEEP + " SELECT k, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS tnr, round(fp / (fp + tn), 6) AS fpr FROM s")
def sweep_rates(spark, d):
    return rounded(evaluate.rates(confusion_sweep(spark, d)), "accuracy", "precision", "recall", "tnr", "fpr")


@query("fpr_at_recall95", SWEEP + " SELECT round(avg(CASE WHEN tp / (tp + fn) > 0.949e0 AND tp / (tp + fn) < 0.951e0 THEN fp / (fp + tn) END), 6) AS fpr FROM s")
def fpr_at_recall95(spark, d):
    return rounded(evaluate.fpr_at_recall(confusion_sweep(spark, d)), "fpr")


# --- points and voxels -----------------------------------------------------------------------


@query("bbox", PTS + " SELECT cloud, round(min(x), 9) AS min_x, round(max(x), 9) AS max_x, round(min(y), 9) AS min_y, round(max(y), 9) AS max_y, round(min(z), 9) AS min_z, round(max(z), 9) AS max_z, count(*) AS n FROM pts GROUP BY cloud")
def bbox(spark, d):
    return rounded(voxel.bbox(points(spark, d)), *[f"{m}_{c}" for m in ("min", "max") for c in "xyz"], n=9)


@query("cloud_centroid", PTS + " SELECT cloud, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM pts GROUP BY cloud")
def cloud_centroid(spark, d):
    return rounded(points(spark, d).groupBy("cloud").agg(*[F.avg(c).alias(c) for c in "xyz"]), "x", "y", "z")


@query("voxel_occupancy", VOX + " SELECT grid, ix, iy, iz FROM vox")
def voxel_occupancy(spark, d):
    return voxel.occupancy(points(spark, d), VOXEL)


@query("grid_downsample", PTS + " SELECT cloud AS grid, floor(x / 0.1e0)::BIGINT AS ix, floor(y / 0.1e0)::BIGINT AS iy, floor(z / 0.1e0)::BIGINT AS iz, round(avg(x) + 1e-12, 10) AS x, round(avg(y) + 1e-12, 10) AS y, round(avg(z) + 1e-12, 10) AS z, count(*) AS n FROM pts GROUP BY ALL")
def grid_downsample(spark, d):
    """Means of 16 seven-digit numbers often end in a five; the shift keeps the order of summation out of their rounding."""
    means = voxel.downsample(points(spark, d), 0.1).withColumns({c: F.col(c) + 1e-12 for c in "xyz"})
    return rounded(means, "x", "y", "z", n=10)


@query("linear_index", VOX + " SELECT grid, iz * 900 + iy * 30 + ix AS lin, ix, iy, iz FROM vox")
def linear_index(spark, d):
    v = voxels(spark, d).select("grid", geom.linear_index(*[F.col(a) for a in voxel.AXES], 30, 30).alias("lin"))
    return v.select("grid", "lin", *[c.cast("long").alias(a) for c, a in zip(geom.unravel(F.col("lin"), 30, 30), voxel.AXES, strict=True)])


@query("tdf_index", VOX + OFFSETS.format(r=2) + ", n AS (SELECT grid, ix + ox AS ix, iy + oy AS iy, iz + oz AS iz, min(ox*ox+oy*oy+oz*oz) AS o2 FROM vox, offs GROUP BY ALL) SELECT grid, ix, iy, iz, round(greatest(0, 1 - sqrt(o2) / 2), 6) AS value FROM n WHERE 1 - sqrt(o2) / 2 > 0")
def tdf_index(spark, d):
    return rounded(voxel.tdf_index(voxel.occupancy(points(spark, d), VOXEL), 2), "value")


@query("tdf_metric", PTS + ", p AS (SELECT * FROM pts)" + OFFSETS.format(r=2).replace("{r}", "2") + ", n AS (SELECT cloud AS grid, round(x / 0.1e0)::BIGINT + ox AS ix, round(y / 0.1e0)::BIGINT + oy AS iy, round(z / 0.1e0)::BIGINT + oz AS iz, min(((round(x / 0.1e0) + ox) * 0.1e0 - x)**2 + ((round(y / 0.1e0) + oy) * 0.1e0 - y)**2 + ((round(z / 0.1e0) + oz) * 0.1e0 - z)**2) AS d2 FROM p, offs GROUP BY ALL) SELECT grid, ix, iy, iz, round(1 - sqrt(d2) / 0.09e0, 6) AS value FROM n WHERE d2 < 0.09e0 * 0.09e0")
def tdf_metric(spark, d):
    return rounded(voxel.tdf_metric(points(spark, d), 0.1, 0.09), "value")


KP = ", kp AS (SELECT DISTINCT grid, ix * 1000000 + iy * 1000 + iz AS kp, ix AS kx, iy AS ky, iz AS kz FROM vox WHERE (ix + iy * 7 + iz * 13) % 50 = 0)"


def keypoints(v):
    return v.where("(ix + iy * 7 + iz * 13) % 50 = 0").select("grid", (F.col("ix") * 1000000 + F.col("iy") * 1000 + F.col("iz")).alias("kp"), *voxel.AXES)


@query("patch_gather", VOX + KP + " SELECT k.grid, kp, count(*) AS n, round(sum(value), 6) AS value, round(sum(value * ((ix - kx + 3) + 6 * (iy - ky + 3) + 36 * (iz - kz + 3))), 6) AS moment FROM kp k JOIN vox v ON k.grid = v.grid AND ix >= kx - 3 AND ix < kx + 3 AND iy >= ky - 3 AND iy < ky + 3 AND iz >= kz - 3 AND iz < kz + 3 GROUP BY ALL")
def patch_gather(spark, d):
    v = voxels(spark, d)
    p = voxel.patch_gather(v, keypoints(v), 3)
    return rounded(p.groupBy("grid", "kp").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.sum(F.col("value") * (F.col("ix") + 6 * F.col("iy") + 36 * F.col("iz"))).alias("moment")), "value", "moment")


@query("grid_stats", VOX + " SELECT grid, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS stddev, min(value) AS low, max(value) AS high, round(sum(value * value), 6) AS l2_squared, count(*) FILTER (WHERE value <> 0) AS cardinality, round(sum(value * ix) / sum(value), 6) AS centroid_ix, round(sum(value * iy) / sum(value), 6) AS centroid_iy, round(sum(value * iz) / sum(value), 6) AS centroid_iz FROM vox GROUP BY grid")
def grid_stats(spark, d):
    return rounded(voxel.stats(voxels(spark, d)), "total", "mean", "variance", "stddev", "l2_squared", "centroid_ix", "centroid_iy", "centroid_iz")


@query("grid_dot", VOX + ", a AS (SELECT * FROM vox WHERE grid = 'A'), b AS (SELECT * FROM vox WHERE grid = 'N'), j AS (SELECT coalesce(a.value, 0) AS p, coalesce(b.value, 0) AS q FROM a FULL JOIN b USING (ix, iy, iz)) SELECT round(sum(p * q), 6) AS dot, round(sum(abs(p - q)), 6) AS l1, round(sum((p - q) * (p - q)), 6) AS l2_squared, round(sqrt(sum((p - q) * (p - q))), 6) AS l2 FROM j")
def grid_dot(spark, d):
    v = voxels(spark, d)
    return rounded(voxel.compare(v.where("grid = 'A'"), v.where("grid = 'N'")), "dot", "l1", "l2_squared", "l2")


@query("grid_threshold", VOX + " SELECT grid, ix, iy, iz, CASE WHEN value <= 3 THEN 0e0 ELSE value END AS value FROM vox")
def grid_threshold(spark, d):
    return voxel.threshold(voxels(spark, d), 3.0, 0.0, None)


_INNER = "ix BETWEEN 1 AND 20 AND iy BETWEEN 1 AND 20 AND iz BETWEEN 1 AND 20"
_NEXT = "SELECT grid, ix - ox AS ix, iy - oy AS iy, iz - oz AS iz, "


@query("grid_convolve", VOX + OFFSETS.format(r=1) + f", c AS ({_NEXT} sum(value * CASE WHEN ox = 0 AND oy = 0 AND oz = 0 THEN 1e0 ELSE -1e0 / 26 END) AS value FROM vox, offs GROUP BY ALL) SELECT grid, ix, iy, iz, round(value, 6) + 0e0 AS value FROM c WHERE {_INNER}")
def grid_convolve(spark, d):
    return rounded(voxel.convolve(voxels(spark, d), voxel.LAPLACE, DIMS), "value")


@query("grid_gradient", VOX + OFFSETS.format(r=1) + f", c AS ({_NEXT} sum(value * ox * CASE WHEN oz = 0 THEN 2e0 / 12 ELSE 1e0 / 12 END) AS gx, sum(value * oy * CASE WHEN oz = 0 THEN 2e0 / 12 ELSE 1e0 / 12 END) AS gy, sum(value * oz * CASE WHEN ox = 0 THEN 2e0 / 12 ELSE 1e0 / 12 END) AS gz FROM vox, offs WHERE NOT (ox = 0 AND oy = 0 AND oz = 0) GROUP BY ALL) SELECT grid, ix, iy, iz, round(sqrt(gx*gx + gy*gy + gz*gz), 6) AS value FROM c WHERE {_INNER}")
def grid_gradient(spark, d):
    return rounded(voxel.gradient_magnitude(voxels(spark, d), DIMS), "value")


_BALL = VOX + OFFSETS.format(r=1) + ", w AS (SELECT grid, ix + ox AS ix, iy + oy AS iy, iz + oz AS iz, value FROM vox, offs WHERE ox*ox+oy*oy+oz*oz <= 1 AND ix + ox BETWEEN 0 AND 21 AND iy + oy BETWEEN 0 AND 21 AND iz + oz BETWEEN 0 AND 21), b AS (SELECT grid, ix, iy, iz, list_sort(list(value)) AS a, 1 + (ix > 0)::INT + (ix < 21)::INT + (iy > 0)::INT + (iy < 21)::INT + (iz > 0)::INT + (iz < 21)::INT AS n FROM w GROUP BY ALL)"


@query("grid_maxfilter", _BALL + " SELECT grid, ix, iy, iz, a[len(a)] AS value FROM b")
def grid_maxfilter(spark, d):
    return voxel.window_filter(voxels(spark, d), 1, "max", DIMS)


@query("grid_medianfilter", _BALL + " SELECT grid, ix, iy, iz, a[floor(n * 0.5e0)::INT - (n - len(a)) + 1] AS value FROM b WHERE floor(n * 0.5e0) >= n - len(a)")
def grid_medianfilter(spark, d):
    return voxel.window_filter(voxels(spark, d), 1, "median", DIMS)


@query("grid_nonmaxima", _BALL + " SELECT grid, ix, iy, iz, CASE WHEN vox.value = a[len(a)] THEN vox.value ELSE 0 END AS value FROM vox JOIN b USING (grid, ix, iy, iz)")
def grid_nonmaxima(spark, d):
    return voxel.mask_non_extrema(voxels(spark, d), 1, DIMS)


def _blur_full() -> str:
    sql, src = VOX + ", oo AS (SELECT unnest(range(-2, 3)) AS o)", "vox"
    for k, a in enumerate(voxel.AXES):
        sql += f", s{k} AS (SELECT grid, {', '.join(f'{b} + o AS {b}' if b == a else b for b in voxel.AXES)}, sum(value * exp(-o * o / 0.5e0)) AS s FROM {src}, oo WHERE {a} + o BETWEEN 0 AND 21 GROUP BY ALL), b{k} AS (SELECT grid, ix, iy, iz, s / (SELECT sum(exp(-o * o / 0.5e0)) FROM oo WHERE s{k}.{a} + o BETWEEN 0 AND 21) AS value FROM s{k})"
        src = f"b{k}"
    return sql + " SELECT grid, ix, iy, iz, round(value, 6) AS value FROM b2"


@query("grid_blur", _blur_full())
def grid_blur(spark, d):
    return rounded(voxel.blur(voxels(spark, d), 0.5, (22, 22, 22)), "value")


@query("trilinear", PTS + ", c AS (SELECT p.o AS ox, q.o AS oy, s.o AS oz FROM (SELECT unnest([0, 1]) AS o) p, (SELECT unnest([0, 1]) AS o) q, (SELECT unnest([0, 1]) AS o) s), vox AS (SELECT cloud AS grid, round(x / 0.05e0)::BIGINT AS ix, round(y / 0.05e0)::BIGINT AS iy, round(z / 0.05e0)::BIGINT AS iz, count(*)::DOUBLE AS value FROM pts GROUP BY ALL), q AS (SELECT range AS q, range * 0.013e0 AS gx, range * 0.017e0 AS gy, range * 0.011e0 AS gz FROM range(1000)), e AS (SELECT q, floor(gx)::BIGINT + ox AS ix, floor(gy)::BIGINT + oy AS iy, floor(gz)::BIGINT + oz AS iz, (CASE WHEN ox = 1 THEN gx - floor(gx) ELSE 1 - gx + floor(gx) END) * (CASE WHEN oy = 1 THEN gy - floor(gy) ELSE 1 - gy + floor(gy) END) * (CASE WHEN oz = 1 THEN gz - floor(gz) ELSE 1 - gz + floor(gz) END) AS w FROM q, c) SELECT q, round(sum(w * coalesce(value, 0)), 6) AS value FROM e LEFT JOIN vox ON grid = 'A' AND e.ix = vox.ix AND e.iy = vox.iy AND e.iz = vox.iz GROUP BY q")
def trilinear(spark, d):
    q = spark.range(1000).select(F.lit("A").alias("grid"), F.col("id").alias("q"), (F.col("id") * 0.013).alias("gx"), (F.col("id") * 0.017).alias("gy"), (F.col("id") * 0.011).alias("gz"))
    return rounded(voxel.trilinear(voxels(spark, d), q).select("q", "value"), "value")


@query("rasterize_points", PTS + ", c AS (SELECT p.o AS ox, q.o AS oy, s.o AS oz FROM (SELECT unnest([0, 1]) AS o) p, (SELECT unnest([0, 1]) AS o) q, (SELECT unnest([0, 1]) AS o) s), g AS (SELECT cloud AS grid, x / 0.1e0 AS gx, y / 0.1e0 AS gy, z / 0.1e0 AS gz FROM pts), e AS (SELECT grid, floor(gx)::BIGINT + ox AS ix, floor(gy)::BIGINT + oy AS iy, floor(gz)::BIGINT + oz AS iz, (CASE WHEN ox = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE WHEN oy = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE WHEN oz = 1 THEN gz - floor(gz) ELSE 1 - (gz - floor(gz)) END) AS w FROM g, c) SELECT grid, ix, iy, iz, round(sum(w), 6) AS value FROM e GROUP BY ALL HAVING sum(w) > 0")
def rasterize_points(spark, d):
    return rounded(voxel.rasterize_points(points(spark, d), 0.1), "value")


@query("connected_components")
def connected_components(spark, d):
    c = voxel.components(voxels(spark, d), 6.0)
    return c.select("grid", *voxel.AXES, F.concat_ws(",", F.col("label.ix"), F.col("label.iy"), F.col("label.iz")).alias("component"))


# --- cameras and fusion ----------------------------------------------------------------------


@query("valid_depth", DEPTH + " SELECT frame, count(*) AS n, round(avg(d), 6) AS mean FROM depth WHERE d > 0 AND d <= 6 GROUP BY frame")
def valid_depth(spark, d):
    return rounded(fusion.valid_depth(depth(spark, d)).groupBy("frame").agg(F.count("*").alias("n"), F.avg("d").alias("mean")), "mean")


_CAM = DEPTH + ", cam AS (SELECT frame, px, py, (px - 320) * d / 585e0 AS x, (py - 240) * d / 585e0 AS y, d AS z FROM depth WHERE d > 0 AND d <= 6), world AS (SELECT frame, px, py, c * x - s * y + tx AS x, s * x + c * y + ty AS y, z + tz AS z FROM cam JOIN pose USING (frame))"


def world_points(spark, d):
    seen = fusion.valid_depth(depth(spark, d)).join(F.broadcast(poses(spark, d)), "frame")
    p = geom.transform(F.col("pose"), geom.backproject(F.col("px"), F.col("py"), F.col("d"), K))
    return seen.select("frame", "px", "py", "pose", *[c.alias(n) for c, n in zip(p, "xyz", strict=True)])


@query("backproject", _CAM + " SELECT frame, px, py, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z FROM cam")
def backproject(spark, d):
    p = geom.backproject(F.col("px"), F.col("py"), F.col("d"), K)
    return rounded(fusion.valid_depth(depth(spark, d)).select("frame", "px", "py", *[c.alias(n) for c, n in zip(p, "xyz", strict=True)]), "x", "y", "z")


@query("cam_to_world", _CAM + " SELECT frame, px, py, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z FROM world")
def cam_to_world(spark, d):
    return rounded(world_points(spark, d).drop("pose"), "x", "y", "z")


@query("project", _CAM + " SELECT frame, px, py, px::DOUBLE AS u, py::DOUBLE AS v FROM world")
def project(spark, d):
    w = world_points(spark, d)
    u, v = geom.project(geom.inverse_transform(F.col("pose"), geom.xyz()), K)
    return w.select("frame", "px", "py", u.alias("u"), v.alias("v"))


@query("relative_pose", "WITH p AS (SELECT n_nationkey AS i, 0.1e0 * n_nationkey AS a, 0.1e0 * n_regionkey AS tx, 0.05e0 * n_nationkey AS ty, 0.02e0 * n_nationkey AS tz FROM nation) SELECT p.i AS i, q.i AS j, round(cos(q.a - p.a), 6) + 0e0 AS m00, round(sin(q.a - p.a), 6) + 0e0 AS m10, round(cos(p.a) * (q.tx - p.tx) + sin(p.a) * (q.ty - p.ty), 6) + 0e0 AS tx, round(-sin(p.a) * (q.tx - p.tx) + cos(p.a) * (q.ty - p.ty), 6) + 0e0 AS ty, round(q.tz - p.tz, 6) + 0e0 AS tz FROM p JOIN p q ON p.i < q.i")
def relative_pose(spark, d):
    p = poses(spark, d)
    j = p.select(F.col("frame").alias("i"), F.col("pose").alias("a")).join(p.select(F.col("frame").alias("j"), F.col("pose").alias("b")), F.col("i") < F.col("j"))
    m = geom.relative_pose(F.col("a"), F.col("b"))
    return rounded(j.withColumn("m", m).select("i", "j", F.col("m")[0].alias("m00"), F.col("m")[4].alias("m10"), F.col("m")[3].alias("tx"), F.col("m")[7].alias("ty"), F.col("m")[11].alias("tz")), "m00", "m10", "tx", "ty", "tz")


_TSDF = DEPTH + ", v AS (SELECT p.i * 10000 + q.i * 100 + r.i AS vox, -1 + p.i * 0.2e0 AS x, -1 + q.i * 0.2e0 AS y, r.i * 0.2e0 AS z FROM (SELECT unnest(range(11)) AS i) p, (SELECT unnest(range(11)) AS i) q, (SELECT unnest(range(31)) AS i) r), s AS (SELECT vox, frame, c * (x - tx) + s * (y - ty) AS cx, -s * (x - tx) + c * (y - ty) AS cy, z - tz AS cz FROM v, pose), g AS (SELECT vox, (d - cz) * sqrt(1 + pow(cx / cz, 2) + pow(cy / cz, 2)) AS diff FROM s JOIN depth USING (frame) WHERE cz > 0 AND px = round(585e0 * cx / cz + 320) AND py = round(585e0 * cy / cz + 240) AND d > 0 AND d <= 6), h AS (SELECT * FROM g WHERE diff > -0.3e0), f AS (SELECT vox, avg(least(1, diff / 0.3e0)) AS tsdf, count(*) AS weight FROM h GROUP BY vox)"


def dense(spark, d):
    r = spark.range(11 * 11 * 31).select(F.floor(F.col("id") / 341).alias("p"), (F.floor(F.col("id") / 31) % 11).alias("q"), (F.col("id") % 31).alias("r"))
    v = r.select((F.col("p") * 10000 + F.col("q") * 100 + F.col("r")).alias("vox"), (-1 + F.col("p") * 0.2).alias("x"), (-1 + F.col("q") * 0.2).alias("y"), (F.col("r") * 0.2).alias("z"))
    return fusion.fuse_dense(v, depth(spark, d), poses(spark, d), K, 0.3)


@query("tsdf_dense", _TSDF + " SELECT vox, round(tsdf, 6) AS tsdf, weight FROM f")
def tsdf_dense(spark, d):
    return rounded(dense(spark, d), "tsdf")


@query("tsdf_surface", _TSDF + " SELECT vox, round(tsdf, 6) AS tsdf, weight FROM f WHERE abs(tsdf) < 0.2e0 AND weight > 1")
def tsdf_surface(spark, d):
    return rounded(fusion.surface(dense(spark, d)), "tsdf")


@query("tsdf_band", DEPTH + ", cam AS (SELECT frame, px, py, d + s * 0.1e0 AS z, -s * 0.1e0 * sqrt(1 + pow((px - 320e0) / 585e0, 2) + pow((py - 240e0) / 585e0, 2)) AS diff FROM depth, (SELECT unnest(range(-3, 4)) AS s) WHERE d > 0 AND d <= 6), k AS (SELECT frame, (px - 320e0) * z / 585e0 AS x, (py - 240e0) * z / 585e0 AS y, z, diff FROM cam WHERE diff > -0.3e0 AND diff <= 0.3e0), w AS (SELECT frame, round((c * x + -s * y + 0e0 * z + tx) / 0.1e0)::BIGINT AS ix, round((s * x + c * y + 0e0 * z + ty) / 0.1e0)::BIGINT AS iy, round((0e0 * x + 0e0 * y + z + tz) / 0.1e0)::BIGINT AS iz, least(1, diff / 0.3e0) AS t FROM k JOIN pose USING (frame)), o AS (SELECT frame, ix, iy, iz, avg(t) AS t FROM w GROUP BY ALL) SELECT ix, iy, iz, round(avg(t), 6) + 0e0 AS tsdf, count(*) AS weight FROM o GROUP BY ALL")
def tsdf_band(spark, d):
    return rounded(fusion.fuse_band(depth(spark, d), poses(spark, d), K, 0.1, 0.3), "tsdf")


@query("fragment_windows", "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS n FROM events) SELECT user_id, floor(n / 5)::INT AS fragment, count(*) AS frames, min(event_id) AS first_id, max(event_id) AS last_id FROM n GROUP BY ALL")
def fragment_windows(spark, d):
    return fusion.fragment_windows(table(spark, d, "events"), "user_id", "ts", 5, 5).groupBy("user_id", "fragment").agg(F.count("*").alias("frames"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("fragment_sliding", "WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS n FROM events), f AS (SELECT user_id, n, unnest(range(greatest(0, ceil((n - 5 + 1) / 2.0))::INT, floor(n / 2.0)::INT + 1)) AS fragment FROM n) SELECT user_id, fragment::INT AS fragment, count(*) AS frames FROM f GROUP BY ALL")
def fragment_sliding(spark, d):
    return fusion.fragment_windows(table(spark, d, "events"), "user_id", "ts", 5, 2).groupBy("user_id", "fragment").agg(F.count("*").alias("frames"))


# --- registration ----------------------------------------------------------------------------


@query("information_matrix", PTS + " SELECT cloud, count(*)::DOUBLE AS i00, round(sum(z), 4) AS i04, round(-sum(y), 4) AS i05, round(-sum(z), 4) AS i13, round(sum(x), 4) AS i15, round(sum(y), 4) AS i23, round(-sum(x), 4) AS i24, round(sum(y*y + z*z), 4) AS i33, round(-sum(x*y), 4) AS i34, round(-sum(x*z), 4) AS i35, round(sum(x*x + z*z), 4) AS i44, round(-sum(y*z), 4) AS i45, round(sum(x*x + y*y), 4) AS i55 FROM pts GROUP BY cloud")
def information_matrix(spark, d):
    return rounded(registration.information_matrix(points(spark, d), "cloud"), "i04", "i05", "i13", "i15", "i23", "i24", "i33", "i34", "i35", "i44", "i45", "i55", n=4)


def pairs_of_poses(spark, d):
    p = poses(spark, d)
    m = geom.relative_pose(F.col("a"), F.col("b"))
    j = p.select(F.col("frame").alias("i"), F.col("pose").alias("a")).join(p.select(F.col("frame").alias("j"), F.col("pose").alias("b")), F.col("i") < F.col("j"))
    return j.select(F.concat(F.lit("s"), F.col("i") % 2).alias("scene"), "i", "j", m.alias("trans"))


_PAIRS = "WITH p AS (SELECT n_nationkey AS i FROM nation), q AS (SELECT 's' || (p.i % 2) AS scene, p.i AS i, r.i AS j FROM p JOIN p r ON p.i < r.i)"


@query("all_pairs", _PAIRS + " SELECT scene, i, j FROM q")
def all_pairs(spark, d):
    return pairs_of_poses(spark, d).select("scene", "i", "j")


@query("gt_lookup", _PAIRS + " SELECT r.scene, r.i, r.j, g.i IS NOT NULL AS in_gt FROM q r LEFT JOIN (SELECT * FROM q WHERE (i + j) % 3 = 0) g USING (scene, i, j)")
def gt_lookup(spark, d):
    q = all_pairs(spark, d)
    return q.join(q.where("(i + j) % 3 = 0").withColumn("hit", F.lit(True)), ["scene", "i", "j"], "left").select("scene", "i", "j", F.col("hit").isNotNull().alias("in_gt"))


@query("gt_anti", _PAIRS + " SELECT scene, i, j FROM q WHERE (i + j) % 3 <> 0")
def gt_anti(spark, d):
    q = all_pairs(spark, d)
    return q.join(q.where("(i + j) % 3 = 0"), ["scene", "i", "j"], "left_anti")


@query("registration_pr", _PAIRS + ", g AS (SELECT * FROM q WHERE (i + j) % 3 = 0 AND j - i > 1), r AS (SELECT * FROM q WHERE (i * j) % 4 <> 1 AND j - i > 1), m AS (SELECT r.scene, r.i, r.j, g.i IS NULL AS missing, (r.i + 2 * r.j) % 5 <> 0 AS ok FROM r LEFT JOIN g USING (scene, i, j)) SELECT scene, (SELECT count(*) FROM g WHERE g.scene = m.scene) AS n_gt, count(*) AS n_result, count(*) FILTER (WHERE NOT missing AND ok) AS good, count(*) FILTER (WHERE NOT missing AND NOT ok) AS bad_pose, count(*) FILTER (WHERE missing) AS not_in_gt, round(count(*) FILTER (WHERE NOT missing AND ok) / (SELECT count(*) FROM g WHERE g.scene = m.scene), 6) AS recall, round(count(*) FILTER (WHERE NOT missing AND ok) / count(*), 6) AS precision FROM m GROUP BY scene")
def registration_pr(spark, d):
    """Results are the true poses, but moved by 0.3 where (i + 2 j) % 5 = 0; the information is the identity, so the squared error is 0.09."""
    q = pairs_of_poses(spark, d)
    eye = F.array(*[F.lit(float(i == j)) for i in range(6) for j in range(6)])
    gt = q.where("(i + j) % 3 = 0")
    moved = F.transform("trans", lambda x, k: F.when((k == 3) & ((F.col("i") + 2 * F.col("j")) % 5 == 0), x + 0.3).otherwise(x))
    result = q.where("(i * j) % 4 <> 1").withColumn("trans", moved)
    return rounded(registration.registration_pr(gt, gt.select("scene", "i", "j", eye.alias("info")), result), "recall", "precision")


@query("transform_error", "WITH p AS (SELECT n_nationkey AS i, 0.1e0 * n_nationkey AS a, 0.1e0 * n_regionkey AS tx, 0.05e0 * n_nationkey AS ty, 0.02e0 * n_nationkey AS tz FROM nation) SELECT i AS frame, round(tx*tx + ty*ty + tz*tz + sin(a / 2)**2, 6) AS err2 FROM p")
def transform_error(spark, d):
    eye = F.array(*[F.lit(float(i == j)) for i in range(6) for j in range(6)])
    return rounded(poses(spark, d).select("frame", registration.transform_error(F.col("pose"), eye).alias("err2")), "err2")


@query("align_rmsd", PTS + " SELECT cloud, round(sqrt(avg((x - y)**2 + (y - z)**2 + (z - x)**2)), 6) AS rmsd, count(*) AS n FROM pts GROUP BY cloud")
def align_rmsd(spark, d):
    m = points(spark, d).select("cloud", *[F.col(a).alias(f"p{b}") for a, b in zip("xyz", "xyz", strict=True)], *[F.col(a).alias(f"q{b}") for a, b in zip("yzx", "xyz", strict=True)])
    return rounded(registration.align_rmsd(m, "cloud"), "rmsd")


def moved_matches(spark, d):
    """Points of each cloud and their images under the pose of the cloud's frame; one in four is off."""
    p = points(spark, d).distinct()
    frame = F.when(F.col("cloud") == "A", 3).when(F.col("cloud") == "N", 7).otherwise(11)
    j = p.withColumn("frame", frame).join(F.broadcast(poses(spark, d)), "frame")
    q = geom.inverse_transform(F.col("pose"), geom.xyz())
    bad = F.when(F.pmod(F.xxhash64("x", "y", "z"), F.lit(4)) == 0, 0.7).otherwise(0.0)
    return j.select("cloud", *[F.col(c).alias(f"p{c}") for c in "xyz"], *[(v + (bad if n == "x" else 0.0)).alias(f"q{n}") for v, n in zip(q, "xyz", strict=True)], bad.alias("off"))


@query("rigid_fit", "SELECT * FROM (VALUES ('A', round(cos(0.3e0), 6), round(0.15e0, 6)), ('N', round(cos(0.7e0), 6), round(0.35e0, 6)), ('R', round(cos(1.1e0), 6), round(0.55e0, 6))) t(cloud, m00, ty)")
def rigid_fit(spark, d):
    fit = registration.rigid_fit(moved_matches(spark, d).where("off = 0"), "cloud")
    return rounded(fit.select("cloud", F.col("trans")[0].alias("m00"), F.col("trans")[7].alias("ty")), "m00", "ty")


@query("ransac_rigid", "SELECT * FROM (VALUES ('A', round(cos(0.3e0), 5), round(0.15e0, 5)), ('N', round(cos(0.7e0), 5), round(0.35e0, 5)), ('R', round(cos(1.1e0), 5), round(0.55e0, 5))) t(cloud, m00, ty)")
def ransac_rigid(spark, d):
    fit = registration.ransac(moved_matches(spark, d).drop("off"), "cloud")
    return rounded(fit.select("cloud", F.col("trans")[0].alias("m00"), F.col("trans")[7].alias("ty")), "m00", "ty", n=5)


@query("trajectory_rmse", "SELECT 0 AS by0, 25::BIGINT AS n, 0e0 AS rmse, 0e0 AS median")
def trajectory_rmse(spark, d):
    p = poses(spark, d).select(F.lit(0).alias("by0"), F.col("frame").alias("k"), F.col("pose")[3].alias("x"), F.col("pose")[7].alias("y"), (F.col("pose")[11] * F.col("pose")[3] + F.sin(F.col("frame"))).alias("z"))
    turned = p.select("by0", "k", (-F.col("y") + 1).alias("x"), F.col("x").alias("y"), (F.col("z") - 2).alias("z"))
    return rounded(registration.trajectory_rmse(p, turned, "by0"), "rmse", "median", n=5)


# --- poses and properties --------------------------------------------------------------------

_POSED = "WITH p AS (SELECT n_nationkey AS i, n_regionkey AS r, degrees(atan2(sin(0.1e0 * n_nationkey), cos(0.1e0 * n_nationkey))) AS e FROM nation), q AS (SELECT i, r, abs(e) AS plain, least(abs(e), 180 - abs(e)) AS half, least(abs(abs(e) - 90), 90 - abs(abs(e) - 90)) AS quarter FROM p)"


@query("rotation_error_sym", _POSED + " SELECT i, round(plain, 6) AS plain, round(half, 6) AS half, round(quarter, 6) AS quarter, 0e0 AS free FROM q")
def rotation_error_sym(spark, d):
    e = geom.euler_zyx(F.col("pose"))[0]
    return rounded(poses(spark, d).select(F.col("frame").alias("i"), *[geom.fold_symmetry(e, F.lit(s)).alias(n) for s, n in ((0, "plain"), (180, "half"), (90, "quarter"), (360, "free"))]), "plain", "half", "quarter", "free")


@query("pose_slices", _POSED + ", s AS (SELECT 'all' AS slice, * FROM q UNION ALL SELECT 'even', * FROM q WHERE i % 2 = 0 UNION ALL SELECT 'region2', * FROM q WHERE r = 2) SELECT slice, count(*) AS n, round(avg((half < 15)::INT), 6) AS rot_acc, round(avg((0.02e0 * i < 0.05e0)::INT), 6) AS trans_acc FROM s GROUP BY slice")
def pose_slices(spark, d):
    p = poses(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("frame"), "n_regionkey"), "frame")
    p = p.select("frame", "n_regionkey", geom.fold_symmetry(geom.euler_zyx(F.col("pose"))[0], F.lit(180)).alias("rot"), (0.02 * F.col("frame")).alias("trans"))
    return rounded(evaluate.sliced_accuracy(p, {"all": F.lit(True), "even": F.col("frame") % 2 == 0, "region2": F.col("n_regionkey") == 2}), "rot_acc", "trans_acc")


@query("occlusion_bucket", "WITH o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'nan'::DOUBLE ELSE s_acctbal / 100 END AS occ FROM supplier) SELECT CASE WHEN occ < 5 THEN 'low' WHEN occ < 30 THEN 'medium' ELSE 'high' END AS bucket, count(*) AS n FROM o GROUP BY ALL")
def occlusion_bucket(spark, d):
    s = table(spark, d, "supplier").withColumn("occ", F.when(F.col("s_suppkey") % 10 == 0, float("nan")).otherwise(F.col("s_acctbal") / 100))
    return s.groupBy(evaluate.occlusion_bucket(F.col("occ")).alias("bucket")).agg(F.count("*").alias("n"))


@query("segm_fscore", "WITH s AS (SELECT s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey % 11) / 10e0 END AS p, (s_suppkey % 13) / 12e0 AS r FROM supplier), g AS (SELECT s_nationkey, avg(p) AS p, avg(r) AS r FROM s GROUP BY 1) SELECT s_nationkey, round(p, 6) AS p, round(r, 6) AS r, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) END AS f FROM g")
def segm_fscore(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", F.when(F.col("s_suppkey") % 7 == 0, float("nan")).otherwise((F.col("s_suppkey") % 11) / 10.0).alias("pp"), ((F.col("s_suppkey") % 13) / 12.0).alias("rr"))
    out = evaluate.segmentation_fscore(s, "s_nationkey", "pp", "rr")
    return rounded(out.withColumn("f", F.when(F.col("p") + F.col("r") > 0, F.col("f"))), "p", "r", "f")


_PROP = "WITH p AS (SELECT vec_id AS vid, label AS prop, CAST(embedding[1] AS DOUBLE) AS value FROM embeddings)"


def prop(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("vid"), F.col("label").alias("prop"), F.col("embedding")[0].cast("double").alias("value"))


@query("percentile_rank", _PROP + " SELECT prop, vid, round(100e0 * (row_number() OVER (PARTITION BY prop ORDER BY value, vid) - 1) / count(*) OVER (PARTITION BY prop), 6) AS rank FROM p")
def percentile_rank(spark, d):
    return rounded(voxel.percentile_rank(prop(spark, d), "prop", "value", "vid"), "rank")


@query("property_zscore", _PROP + " SELECT prop, vid, round((value - avg(value) OVER (PARTITION BY prop)) / stddev_pop(value) OVER (PARTITION BY prop), 5) + 0e0 AS z FROM p")
def property_zscore(spark, d):
    return rounded(voxel.zscore(prop(spark, d), "prop", "value", "vid"), "z", n=5)


@query("property_stats", _PROP + ", s AS (SELECT prop, value, row_number() OVER (PARTITION BY prop ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY prop) AS n FROM p) SELECT prop, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(stddev_pop(value), 6) AS stddev, round(sum(abs(value)), 6) AS l1, round(sqrt(sum(value * value)), 6) AS l2, round(max(value) FILTER (WHERE k = floor(n * 90 / 100.0)), 6) AS p90 FROM s GROUP BY prop")
def property_stats(spark, d):
    return rounded(mesh.property_stats(prop(spark, d), "prop", "value", 90), "mean", "low", "high", "stddev", "l1", "l2", "p90")


@query("top_activations", "WITH a AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS ch, unnest(embedding)::DOUBLE AS v FROM embeddings), r AS (SELECT ch, vec_id, v, row_number() OVER (PARTITION BY ch ORDER BY v DESC, vec_id) AS rank FROM a) SELECT ch::INT AS ch, vec_id, round(v, 6) AS v, rank FROM r WHERE rank <= 5")
def top_activations(spark, d):
    from pyspark.sql import Window

    a = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("ch", "v"))
    r = F.row_number().over(Window.partitionBy("ch").orderBy(F.col("v").desc(), "vec_id"))
    return rounded(a.withColumn("v", F.col("v").cast("double")).withColumn("rank", r.cast("long")).where("rank <= 5").select("ch", "vec_id", "v", "rank"), "v")


# --- mining and meshes -----------------------------------------------------------------------


@query("triplet_mining")
def triplet_mining(spark, d):
    seen = fusion.valid_depth(depth(spark, d)).withColumn("scene", F.lit(0))
    p = poses(spark, d).withColumn("scene", F.lit(0))
    anchors = seen.withColumn("p1", F.xxhash64("frame", "px", "py"))
    return mining.mine_triplets(anchors, seen, p, K, baseline=0.1, agree=0.5)


def surface_mesh(spark, d):
    """A height field: part keys on a 40-wide lattice, heights by size; two faces a cell."""
    p = table(spark, d, "part").select(F.lit("part").alias("mesh"), (F.col("p_partkey") - 1).alias("vid"), F.col("p_size").cast("double").alias("z"))
    v = p.select("mesh", "vid", (F.col("vid") % 40).cast("double").alias("x"), F.floor(F.col("vid") / 40).cast("double").alias("y"), (F.col("z") * 0.02).alias("z"))
    keys = v.select("mesh", "vid")
    quads = keys.where("vid % 40 < 39")
    for off in (1, 40, 41):
        quads = quads.join(keys.select("mesh", (F.col("vid") - off).alias("vid")), ["mesh", "vid"], "left_semi")
    tri = F.explode(F.array(F.struct((F.col("vid") * 2).alias("fid"), F.col("vid").alias("v0"), (F.col("vid") + 1).alias("v1"), (F.col("vid") + 40).alias("v2")), F.struct((F.col("vid") * 2 + 1).alias("fid"), (F.col("vid") + 1).alias("v0"), (F.col("vid") + 41).alias("v1"), (F.col("vid") + 40).alias("v2"))))
    return v, quads.select("mesh", tri.alias("f")).select("mesh", "f.*")


MESH = "WITH v AS (SELECT p_partkey - 1 AS vid, ((p_partkey - 1) % 40)::DOUBLE AS x, floor((p_partkey - 1) / 40.0)::DOUBLE AS y, p_size * 0.02e0 AS z FROM part), q AS (SELECT vid FROM v WHERE vid % 40 < 39 AND vid + 1 IN (SELECT vid FROM v) AND vid + 40 IN (SELECT vid FROM v) AND vid + 41 IN (SELECT vid FROM v)), f AS (SELECT vid * 2 AS fid, vid AS v0, vid + 1 AS v1, vid + 40 AS v2 FROM q UNION ALL SELECT vid * 2 + 1, vid + 1, vid + 41, vid + 40 FROM q), c AS (SELECT fid, v0, v1, v2, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, d.x - a.x AS wx, d.y - a.y AS wy, d.z - a.z AS wz FROM f JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v d ON d.vid = v2), m AS (SELECT *, sqrt((uy*wz-uz*wy)**2 + (uz*wx-ux*wz)**2 + (ux*wy-uy*wx)**2) / 2 AS area FROM c), e AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM (SELECT v0 AS p, v1 AS q FROM f UNION ALL SELECT v1, v2 FROM f UNION ALL SELECT v2, v0 FROM f))"


@query("mesh_stats", MESH + " SELECT 'part' AS mesh, round(sum(area), 6) AS area, round(sum(area * (ax + (ux + wx) / 3)) / sum(area), 6) AS x, round(sum(area * (ay + (uy + wy) / 3)) / sum(area), 6) AS y, round(sum(area * (az + (uz + wz) / 3)) / sum(area), 6) AS z, round((SELECT avg(sqrt((p.x-q.x)**2 + (p.y-q.y)**2 + (p.z-q.z)**2)) FROM e JOIN v p ON p.vid = e.a JOIN v q ON q.vid = e.b), 6) AS mean_edge FROM m")
def mesh_stats(spark, d):
    return rounded(mesh.mesh_stats(*surface_mesh(spark, d)), "area", "x", "y", "z", "mean_edge")


@query("vertex_area", MESH + " SELECT 'part' AS mesh, vid, round(sum(area) / 3, 6) AS area FROM (SELECT unnest([v0, v1, v2]) AS vid, area FROM m) GROUP BY vid")
def vertex_area(spark, d):
    return rounded(mesh.vertex_area(*surface_mesh(spark, d)), "area")


@query("gauss_curvature", MESH + ", r AS (SELECT v0 AS vid, area, acos((ux*wx+uy*wy+uz*wz) / sqrt((ux*ux+uy*uy+uz*uz) * (wx*wx+wy*wy+wz*wz))) AS g FROM m UNION ALL SELECT v1, area, acos((-ux*(wx-ux)-uy*(wy-uy)-uz*(wz-uz)) / sqrt((ux*ux+uy*uy+uz*uz) * ((wx-ux)**2+(wy-uy)**2+(wz-uz)**2))) FROM m UNION ALL SELECT v2, area, acos((-wx*(ux-wx)-wy*(uy-wy)-wz*(uz-wz)) / sqrt((wx*wx+wy*wy+wz*wz) * ((ux-wx)**2+(uy-wy)**2+(uz-wz)**2))) FROM m) SELECT 'part' AS mesh, vid, round(3 * (2 * pi() - sum(g)) / sum(area), 5) + 0e0 AS curvature FROM r GROUP BY vid")
def gauss_curvature(spark, d):
    return rounded(mesh.gauss_curvature(*surface_mesh(spark, d)), "curvature", n=5)


@query("local_extrema", MESH + ", n AS (SELECT a AS vid, b AS o FROM e UNION ALL SELECT b, a FROM e), g AS (SELECT n.vid, max(v.z) AS z FROM n JOIN v ON v.vid = n.o GROUP BY 1) SELECT 'part' AS mesh, v.vid, round(v.z, 6) AS value FROM v JOIN g ON v.vid = g.vid WHERE v.z > g.z")
def local_extrema(spark, d):
    v, f = surface_mesh(spark, d)
    return rounded(mesh.local_extrema(v.select("mesh", "vid", F.col("z").alias("value")), mesh.edges(f)), "value")


@query("mesh_smooth", MESH + ", n AS (SELECT a AS vid, b AS o FROM e UNION ALL SELECT b, a FROM e), g AS (SELECT n.vid, avg(v.x) AS x, avg(v.y) AS y, avg(v.z) AS z FROM n JOIN v ON v.vid = n.o GROUP BY 1) SELECT 'part' AS mesh, v.vid, round(coalesce(v.x + 0.5e0 * (g.x - v.x), v.x), 6) AS x, round(coalesce(v.y + 0.5e0 * (g.y - v.y), v.y), 6) AS y, round(coalesce(v.z + 0.5e0 * (g.z - v.z), v.z), 6) AS z FROM v LEFT JOIN g ON v.vid = g.vid")
def mesh_smooth(spark, d):
    v, f = surface_mesh(spark, d)
    return rounded(mesh.smooth(v, mesh.edges(f)), "x", "y", "z")


@query("delete_unused", MESH + " SELECT 'part' AS mesh, vid FROM v WHERE vid IN (SELECT unnest([v0, v1, v2]) FROM f)")
def delete_unused(spark, d):
    return mesh.delete_unused(*surface_mesh(spark, d)).select("mesh", "vid")


@query("geodesic")
def geodesic(spark, d):
    v, f = surface_mesh(spark, d)
    return rounded(mesh.geodesic(v, mesh.edges(f), v.where("vid = 0")), "dist")


# --- more on grids and surfaces --------------------------------------------------------------


@query("grid_pointwise", VOX + " SELECT grid, ix, iy, iz, round(sqrt(value), 6) AS root, round(value * value, 6) AS square, -value AS negated, round(1 / value, 6) AS inverse, round(pow(abs(value), 1.5e0), 6) AS power, round(value / sqrt((SELECT sum(value * value) FROM vox o WHERE o.grid = vox.grid)), 6) AS normalized FROM vox")
def grid_pointwise(spark, d):
    v = voxels(spark, d)
    norm = v.groupBy("grid").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    x = F.col("value")
    out = v.join(norm, "grid").select("grid", *voxel.AXES, F.sqrt(x).alias("root"), (x * x).alias("square"), (-x).alias("negated"), F.when(x != 0, 1 / x).alias("inverse"), F.pow(F.abs(x), F.lit(1.5)).alias("power"), (x / F.col("norm")).alias("normalized"))
    return rounded(out, "root", "square", "inverse", "power", "normalized")


@query("grid_slice", VOX + " SELECT grid, iy AS ix, ix AS iy, value FROM vox WHERE iz = 4")
def grid_slice(spark, d):
    """One plane, transposed."""
    return voxels(spark, d).where("iz = 4").select("grid", F.col("iy").alias("ix"), F.col("ix").alias("iy"), "value")


@query("plane_moments", PTS + " SELECT cloud, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, round(var_pop(x) + var_pop(y) + var_pop(z), 6) AS spread FROM pts GROUP BY cloud")
def plane_moments(spark, d):
    p = surface.plane_pca(points(spark, d), "cloud")
    return rounded(p.select("cloud", "n", "cx", "cy", "cz", (F.col("v0") + F.col("v1") + F.col("v2")).alias("spread")), "cx", "cy", "cz", "spread")


@query("plane_normals")
def plane_normals(spark, d):
    a, _ = two_clouds(spark, d)
    return rounded(surface.normals(a, 0.15).select("id", "n", "nx", "ny", "nz"), "nx", "ny", "nz")


@query("denoise", EMB.replace("FROM a, b)", "FROM e a, e b WHERE a.vec_id <> b.vec_id)") + ", r AS (SELECT a AS q, sqrt(d2) AS d, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS k FROM d), m AS (SELECT q, avg(d) AS mean_d FROM r WHERE k <= 4 GROUP BY q) SELECT q, round(mean_d, 6) AS mean_d FROM m WHERE mean_d <= (SELECT avg(mean_d) + stddev_samp(mean_d) FROM m)")
def denoise(spark, d):
    return rounded(surface.denoise(descriptors(spark, d)), "mean_d")


@query("project_box", _CAM + ", c AS (SELECT unnest([-0.1e0, 0.1e0]) AS o), b AS (SELECT frame, px, py, min(round(585e0 * (x + p.o) / (z + s.o) + 320)) AS u0, max(round(585e0 * (x + p.o) / (z + s.o) + 320)) AS u1, min(round(585e0 * (y + q.o) / (z + s.o) + 240)) AS v0, max(round(585e0 * (y + q.o) / (z + s.o) + 240)) AS v1 FROM cam, c p, c q, c s WHERE z - 0.1e0 > 0 GROUP BY ALL) SELECT frame, px, py, greatest(0e0, least(639e0, u0)) AS u0, greatest(0e0, least(639e0, u1)) AS u1, greatest(0e0, least(479e0, v0)) AS v0, greatest(0e0, least(479e0, v1)) AS v1 FROM b")
def project_box(spark, d):
    p = geom.backproject(F.col("px"), F.col("py"), F.col("d"), K)
    cam = fusion.valid_depth(depth(spark, d)).select("frame", "px", "py", *[c.alias(n) for c, n in zip(p, "xyz", strict=True)]).where(F.col("z") - 0.1 > 0)
    return surface.project_box(cam, 0.1, K).drop("x", "y", "z")


@query("quaternion_matrix", "SELECT n_nationkey AS frame, round(cos(0.05e0 * n_nationkey), 6) AS w, round(sin(0.05e0 * n_nationkey), 6) + 0e0 AS z, round(cos(0.1e0 * n_nationkey), 6) + 0e0 AS m00, round(sin(0.1e0 * n_nationkey), 6) + 0e0 AS m10, 1e0 AS m22 FROM nation")
def quaternion_matrix(spark, d):
    w, x, y, z = geom.matrix_to_quaternion(F.col("pose"))
    q = poses(spark, d).select("frame", w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))
    m = geom.quaternion_to_matrix(*[F.col(c) for c in "wxyz"])
    return rounded(q.select("frame", "w", "z", m[0].alias("m00"), m[3].alias("m10"), m[8].alias("m22")), "w", "z", "m00", "m10", "m22")


@query("two_query_similarity", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT (SELECT v FROM e WHERE vec_id = 0) AS p, (SELECT v FROM e WHERE vec_id = 1) AS r), s AS (SELECT vec_id, 1 - least(sqrt(list_sum(list_transform(list_zip(v, p), lambda t: (t[1] - t[2]) * (t[1] - t[2])))), 20e0) / 20e0 AS a, 1 - least(sqrt(list_sum(list_transform(list_zip(v, r), lambda t: (t[1] - t[2]) * (t[1] - t[2])))), 20e0) / 20e0 AS b FROM e, q) SELECT vec_id, round(greatest(a, b), 6) AS sim, CASE WHEN a >= b THEN 1 ELSE 2 END AS which, round(greatest(a, b) / (SELECT max(greatest(a, b)) FROM s), 6) AS shade FROM s")
def two_query_similarity(spark, d):
    """Similarity to the nearer of two query descriptors, which of them it is, and the share of the largest."""
    e = descriptors(spark, d).select(F.col("q").alias("vec_id"), "v")
    q = e.where("vec_id < 2").agg(F.max(F.when(F.col("vec_id") == 0, F.col("v"))).alias("p"), F.max(F.when(F.col("vec_id") == 1, F.col("v"))).alias("r"))
    s = e.crossJoin(F.broadcast(q)).select("vec_id", geom.trunc_similarity(geom.l2(F.col("v"), F.col("p")), 20.0).alias("a"), geom.trunc_similarity(geom.l2(F.col("v"), F.col("r")), 20.0).alias("b"))
    s = s.select("vec_id", F.greatest("a", "b").alias("sim"), F.when(F.col("a") >= F.col("b"), 1).otherwise(2).alias("which"))
    return rounded(s.crossJoin(s.agg(F.max("sim").alias("top"))).select("vec_id", "sim", "which", (F.col("sim") / F.col("top")).alias("shade")), "sim", "shade")


from . import queries_more, queries_surfaces  # noqa: E402, F401  register their queries here


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
