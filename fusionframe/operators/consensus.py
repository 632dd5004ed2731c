"""Robust fits with any model: random samples are rows, scored against blocks of matches.

The matches are sorted once and lie in blocks of at most BLOCK from then on; where few groups are left, what meets the blocks is
broadcast and they stay where they are. A round draws a number of samples for every group that isn't sure yet. Samples are numbers of matches, drawn by hashes of
(group, trial, place), so results don't depend on partitions; the drawn matches are joined and fitted in Arrow
batches. Models go in chunks to the blocks, counts are summed by (group, trial), and the best trial of a group
is kept. So a group of any size is spread over tasks. Rounds double in size until the share of matches that fit says
that enough were drawn. The last fit is over all inliers, from sums made on the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoint import checkpointed

BLOCK = 1024
CHUNK = 64  # models that meet a block at once
SPAN = 65_536  # matches by whose numbers a group is dealt over tasks
FEW = 100_000  # drawn matches of a round that are broadcast, else they are joined
PLANE = ("px", "py", "qx", "qy")


@dataclass(frozen=True)
class Model:
    """What a fit needs: columns of a match, the size of a sample, and functions over many samples at once.

    fit: (samples, size, columns) to (samples, parameters); error: parameters (samples, k) and points (samples or 1, n, columns) to
    (samples, n), and a match fits where it is under the limit; bad: samples that determine nothing; finish: the last fit
    from a table of inliers (group, columns) to group, params, which may have bad params for groups with fewer inliers than a sample if `once`;
    once: finish reads its table once; direct: as many matches as a sample are fitted as they are, without a limit.
    """

    columns: tuple[str, ...]
    size: int
    fit: Callable[[np.ndarray], np.ndarray]
    error: Callable[[np.ndarray, np.ndarray], np.ndarray]
    bad: Callable[[np.ndarray], np.ndarray]
    finish: Callable[[DataFrame, str], DataFrame]
    once: bool = False
    direct: bool = False


# --- plane models ----------------------------------------------------------------------------


def normalisation(matches: DataFrame, by: str) -> DataFrame:
    """by, and for p and q the centroid and the scale that brings the mean distance from it to the root of 2."""
    mid = matches.groupBy(by).agg(*[F.avg(c).alias(f"c{c}") for c in PLANE])
    far = lambda s: F.avg(F.sqrt((F.col(f"{s}x") - F.col(f"c{s}x")) ** 2 + (F.col(f"{s}y") - F.col(f"c{s}y")) ** 2))
    return matches.join(mid, by).groupBy(by, *[f"c{c}" for c in PLANE]).agg(*[F.try_divide(F.lit(math.sqrt(2)), far(s)).alias(f"s{s}") for s in "pq"])


def normalised(matches: DataFrame, norms: DataFrame, by: str) -> DataFrame:
    """The matches about their centroids, at their scales."""
    return matches.join(norms, by).withColumns({c: (F.col(c) - F.col(f"c{c}")) * F.col(f"s{c[0]}") for c in PLANE}).drop(*norms.columns[1:])


def _denormaliser(cx: float, cy: float, s: float) -> np.ndarray:
    return np.array([[s, 0, -s * cx], [0, s, -s * cy], [0, 0, 1]])


def _square(x: Column | np.ndarray, y, one) -> list:
    """The six products of (x, y, 1)."""
    return [x * x, x * y, x, y * y, y, one]


_SIX = np.array([[0, 1, 2], [1, 3, 4], [2, 4, 5]])


def _homography_weights(x, y, one) -> list:
    """Of the products of the first point, by blocks of the 9 x 9 normal matrix: (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)."""
    return [one + y * y, -x * y, -x, one + x * x, -y, x * x + y * y]


def _normal(sums: np.ndarray) -> np.ndarray:
    """(n, 6, 6) sums, by block and product, to (n, 9, 9)."""
    out = np.zeros((len(sums), 9, 9))
    for i in range(3):
        for j in range(3):
            out[:, 3 * i : 3 * i + 3, 3 * j : 3 * j + 3] = sums[:, _SIX[i, j]][:, _SIX]
    return out


def _least(sums: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrices of least error."""
    return np.linalg.eigh(_normal(sums))[1][:, :, 0].reshape(-1, 3, 3)


def _rank_two(f: np.ndarray) -> np.ndarray:
    u, d, v = np.linalg.svd(f)
    d[:, 2] = 0
    return (u * d[:, None, :]) @ v


def _plane_fit(kind: str) -> Callable[[np.ndarray], np.ndarray]:
    def fit(m: np.ndarray) -> np.ndarray:
        mid = m.mean(1, keepdims=True)
        off = m - mid
        scale = [math.sqrt(2) / np.maximum(np.sqrt(off[:, :, 2 * k] ** 2 + off[:, :, 2 * k + 1] ** 2).mean(1), 1e-300) for k in (0, 1)]
        t = []
        for k in (0, 1):
            a = np.zeros((len(m), 3, 3))
            a[:, 0, 0] = a[:, 1, 1] = scale[k]
            a[:, 0, 2], a[:, 1, 2], a[:, 2, 2] = -scale[k] * mid[:, 0, 2 * k], -scale[k] * mid[:, 0, 2 * k + 1], 1
            t.append(a)
        px, py, qx, qy = (off[:, :, c] * scale[c // 2][:, None] for c in range(4))
        one = np.ones_like(px)
        weights = _homography_weights(qx, qy, one) if kind == "homography" else _square(qx, qy, one)
        model = _least(np.stack([np.stack([(w * x).sum(1) for x in _square(px, py, one)], 1) for w in weights], 1))
        if kind == "homography":
            return (np.linalg.solve(t[1], model @ t[0])).reshape(-1, 9)
        return (t[1].transpose(0, 2, 1) @ _rank_two(model) @ t[0]).reshape(-1, 9)

    return fit


def _moved(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = [h[:, i, 0, None] * x + h[:, i, 1, None] * y + h[:, i, 2, None] for i in range(3)]
    with np.errstate(divide="ignore", invalid="ignore"):
        return z[0] / z[2], z[1] / z[2]


def _transfer(params: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Squared distances in both images, added."""
    h = params.reshape(-1, 3, 3)
    flat = np.abs(np.linalg.det(h)) < 1e-12
    back = np.linalg.inv(np.where(flat[:, None, None], np.eye(3), h))
    ax, ay = _moved(h, m[..., 0], m[..., 1])
    bx, by = _moved(back, m[..., 2], m[..., 3])
    out = (ax - m[..., 2]) ** 2 + (ay - m[..., 3]) ** 2 + (bx - m[..., 0]) ** 2 + (by - m[..., 1]) ** 2
    out[flat] = np.inf
    return np.where(np.isfinite(out), out, np.inf)


def _sampson(params: np.ndarray, m: np.ndarray) -> np.ndarray:
    """First order of the squared distance to the epipolar lines."""
    f = params.reshape(-1, 3, 3)
    row = lambda a, i, x, y: a[:, i, 0, None] * x + a[:, i, 1, None] * y + a[:, i, 2, None]
    l = [row(f, i, m[..., 0], m[..., 1]) for i in range(3)]  # noqa: E741
    r = [row(f.transpose(0, 2, 1), i, m[..., 2], m[..., 3]) for i in range(2)]
    e = m[..., 2] * l[0] + m[..., 3] * l[1] + l[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = e * e / (l[0] ** 2 + l[1] ** 2 + r[0] ** 2 + r[1] ** 2)
    return np.where(np.isfinite(out), out, np.inf)


def _in_line(m: np.ndarray) -> np.ndarray:
    """Whether three of the four points of either image lie on a line."""
    out = np.zeros(len(m), bool)
    for k in (0, 2):
        for i, j, n in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
            a, b = m[:, j, k : k + 2] - m[:, i, k : k + 2], m[:, n, k : k + 2] - m[:, i, k : k + 2]
            out |= np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) < 2.2e-16
    return out


def _plane_solve(kind: str) -> Callable[[DataFrame, str], DataFrame]:
    def solve(matches: DataFrame, by: str) -> DataFrame:
        norms = normalisation(matches, by)
        p, q, one = (F.col("px"), F.col("py")), (F.col("qx"), F.col("qy")), F.lit(1.0)
        weights = _homography_weights(*q, one) if kind == "homography" else _square(*q, one)
        sums = normalised(matches, norms, by).groupBy(by).agg(F.array(*[F.sum(w * x) for w in weights for x in _square(*p, one)]).alias("sums"))

        def run(batches):
            for pdf in batches:
                out = []
                if len(pdf):
                    model = _least(np.array(pdf.sums.tolist()).reshape(-1, 6, 6))
                    if kind != "homography":
                        model = _rank_two(model)
                    for h, cpx, cpy, cqx, cqy, sp, sq in zip(model, *(pdf[c] for c in ("cpx", "cpy", "cqx", "cqy", "sp", "sq"))):
                        t1, t2 = _denormaliser(cpx, cpy, sp), _denormaliser(cqx, cqy, sq)
                        out.append((np.linalg.solve(t2, h @ t1) if kind == "homography" else t2.T @ h @ t1).ravel().tolist())
                pdf = pdf[[by]].copy()
                pdf["params"] = out
                yield pdf

        kept = " AND ".join(f"{s} IS NOT NULL" for s in ("sp", "sq"))
        return sums.join(norms, by).where(kept).mapInPandas(run, f"`{by}` {matches.schema[by].dataType.simpleString()}, params array<double>")

    return solve


#: q = H p of the plane; four matches.
HOMOGRAPHY = Model(PLANE, 4, _plane_fit("homography"), _transfer, _in_line, _plane_solve("homography"))
#: q' F p = 0; eight matches.
FUNDAMENTAL = Model(PLANE, 8, _plane_fit("fundamental"), _sampson, lambda m: np.zeros(len(m), bool), _plane_solve("fundamental"))


def homography(matches: DataFrame, by: str) -> DataFrame:
    """by, params: the homography of least algebraic error of all matches (px, py, qx, qy) of each group, row by row; defined up to a factor."""
    return HOMOGRAPHY.finish(matches, by)


def fundamental(matches: DataFrame, by: str) -> DataFrame:
    """by, params: the fundamental matrix of least algebraic error, of rank two, of each group; defined up to a factor."""
    return FUNDAMENTAL.finish(matches, by)


# --- the search ------------------------------------------------------------------------------


def _span(number: str | Column) -> Column:
    return F.floor(F.col(number) / SPAN if isinstance(number, str) else number / SPAN)


def _dealt(rows: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """A few rows a group, once for each span of the group's matches: joins on group and span don't bring a group to one task."""
    spans = sizes.select(by, F.explode(F.sequence(_span("base"), _span(F.col("base") + F.col("n") - 1))).alias("span"))
    return rows.join(spans, by)


def _packed(own: DataFrame, by: str, order: list[str], c: list[str]) -> DataFrame:
    """by, first, m, points, span: the matches by group and `order`, m of them from number `first` on, at most BLOCK. They are shuffled once, by the sort.

    Rows that are equal in `order` are told apart by where they came from, so copies don't end in one task.
    """

    def pack(batches):
        start = 0
        for batch in batches:
            if len(batch):
                group = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(batch))
                cuts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip([0, *ends[:-1]], ends, strict=True)])
                points = np.stack([batch.column(1 + k).to_numpy() for k in range(len(c))], 1).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(batch)) * len(c), pa.int32()), pa.array(points))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cuts)), pa.array(cuts + start), pa.array(np.diff(np.append(cuts, len(batch)))), lists], names=[by, "first", "m", "points"])
                start += len(batch)

    row = F.monotonically_increasing_id()
    ranged = own.withColumn("_row", row).repartitionByRange(by, *order, "_row").sortWithinPartitions(by, *order)
    parts = checkpointed(ranged.select(by, *c).mapInArrow(pack, f"`{by}` {own.schema[by].dataType.simpleString()}, first bigint, m bigint, points array<double>").withColumn("part", F.spark_partition_id()))
    before = F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    base = parts.groupBy("part").agg(F.sum("m").alias("m")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return parts.join(F.broadcast(base), "part").select(by, (F.col("base") + F.col("first") + 1).alias("first"), "m", "points").withColumn("span", _span("first"))


def consensus(matches: DataFrame, by: str, key: str | None, model: Model, limit: float, p: float = 0.99, least: int = 10, most: int = 50_000, seed: int = 0, first_round: int = 64) -> DataFrame:
    """by, params, inliers, n, trials: for each group the model with most matches under the limit, refitted over these.

    `key` tells the matches of a group apart (rows with equal keys are one match); without one every row is a match. Of equal counts the later trial wins. Rounds end when, with
    probability `p`, some sample was all inliers at the best share so far, after `least` to about `most` trials.
    Samples with a match twice and those that determine nothing count as drawn. Groups with
    fewer matches than a sample, or without a model that `size` matches fit, have null params and no inliers.
    """
    c = list(model.columns)
    kind = matches.schema[by].dataType.simpleString()
    own = matches.select(by, *([key] if key else []), *[F.col(x).cast("double").alias(x) for x in c]).dropna()
    blocks = _packed(own.dropDuplicates([by, key]), by, [key], c) if key else _packed(own, by, c, c)
    sizes = checkpointed(blocks.groupBy(by).agg(F.min("first").alias("base"), F.sum("m").alias("n")))
    slot = lambda number: F.floor(number / BLOCK)
    heads = checkpointed(blocks.select("first", "m", F.explode(F.sequence(slot(F.col("first")), slot(F.col("first") + F.col("m") - 1))).alias("slot")))
    whole = (F.col("n") == model.size) & F.lit(model.direct)
    state = checkpointed(sizes.withColumns({"best": F.lit(-1).cast("bigint"), "params": F.lit(None).cast("array<double>"), "trials": F.lit(0).cast("bigint"), "sure": (F.col("n") < model.size) | whole}))

    def fitted(batches):
        for batch in batches:
            m = np.array(batch.column(2).flatten()).reshape(-1, model.size, len(c))
            params = model.fit(m) if len(m) else np.zeros((0, 1))
            good = ~model.bad(m) & np.isfinite(params).all(1)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(params[good].tolist(), pa.list_(pa.float64()))], names=[by, "t", "params"])

    def scored(batches):
        for batch in batches:
            for k in range(len(batch)):
                trials, params = batch.column(1)[k].as_py(), np.array(batch.column(2)[k].as_py())
                points = np.array(batch.column(3)[k].values).reshape(1, -1, len(c))
                fit = (model.error(params, points) < limit).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(trials), batch.schema.field(0).type), pa.array(trials, pa.int64()), pa.array(fit, pa.int64())], names=[by, "t", "fit"])

    def met(rows: DataFrame, few: bool) -> DataFrame:
        return blocks.join(F.broadcast(rows), by) if few else blocks.join(_dealt(rows, sizes, by), [by, "span"])

    done, size = 0, first_round
    while done < most and (left := state.where("NOT sure").count()):
        few = left * size * model.size <= FEW
        draws = state.where("NOT sure").select(by, "base", "n", F.explode(F.sequence(F.lit(done), F.lit(done + size - 1))).alias("t"))
        draws = draws.withColumn("place", F.explode(F.array(*[F.lit(j) for j in range(model.size)])))
        draws = draws.withColumn("id", F.col("base") + F.pmod(F.xxhash64(F.lit(seed), by, "t", "place"), F.col("n"))).select(by, "t", "place", "id", slot(F.col("id")).alias("slot"))
        picks = draws.join(heads, "slot").where("id >= first AND id < first + m").select(by, "t", "place", "id", "first")
        drawn = blocks.select("first", "points").join(F.broadcast(picks) if few else picks, "first")
        drawn = drawn.withColumn("m", F.slice("points", ((F.col("id") - F.col("first")) * len(c) + 1).cast("int"), F.lit(len(c))))
        drawn = drawn.groupBy(by, F.col("t").cast("bigint").alias("t")).agg(F.count_distinct("id").alias("k"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "m"))), lambda x: x["m"])).alias("m"))
        models = checkpointed(drawn.where(F.col("k") == model.size).select(by, "t", "m").mapInArrow(fitted, f"`{by}` {kind}, t bigint, params array<double>"))
        chunks = models.groupBy(by, F.floor(F.col("t") / CHUNK).alias("c")).agg(F.collect_list(F.struct("t", "params")).alias("l")).select(by, F.transform("l", lambda x: x["t"]).alias("ts"), F.transform("l", lambda x: x["params"]).alias("ps"))
        counts = met(chunks, few).select(by, "ts", "ps", "points").mapInArrow(scored, f"`{by}` {kind}, t bigint, fit bigint")
        best = counts.groupBy(by, "t").agg(F.sum("fit").alias("fit")).groupBy(by).agg(F.max(F.struct("fit", "t")).alias("m")).select(by, F.col("m.t").alias("t"), F.col("m.fit").alias("fit"))
        best = best.join(models, [by, "t"]).select(by, "fit", F.col("params").alias("new"))
        done, size = done + size, size * 2
        better = F.coalesce(F.col("fit") >= F.col("best"), F.lit(False)) & ~F.col("sure")
        state = state.join(best, by, "left").withColumns({"params": F.when(better, F.col("new")).otherwise(F.col("params")), "trials": F.when(F.col("sure"), F.col("trials")).otherwise(F.lit(done)), "best": F.when(better, F.col("fit")).otherwise(F.col("best"))}).drop("fit", "new")
        share = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.pow(F.greatest("best", F.lit(0)) / F.col("n"), F.lit(float(model.size)))))
        state = checkpointed(state.withColumn("sure", F.col("sure") | (F.lit(done) >= F.greatest(F.lit(float(least)), math.log(1 - p) / F.log(1 - share)))))

    def fits(batches):
        for batch in batches:
            for k in range(len(batch)):
                params, points = batch.column(1)[k].as_py(), np.array(batch.column(2)[k].values).reshape(-1, len(c))
                # Without params the matches are as many as a sample.
                inside = points if params is None else points[model.error(np.array([params]), points[None])[0] < limit]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(inside), batch.schema.field(0).type), *[pa.array(inside[:, x]) for x in range(len(c))]], names=[by, *c])

    few = sizes.count() * model.size <= FEW
    near = met(state.where(F.col("params").isNotNull() | whole).select(by, "params"), few).select(by, "params", "points").mapInArrow(fits, f"`{by}` {kind}, " + ", ".join(f"{x} double" for x in c))
    near = near if model.once else checkpointed(near)
    counted = near.groupBy(by).agg(F.count("*").alias("inliers")).where(F.col("inliers") >= model.size)
    last = model.finish(near if model.once else near.join(counted.select(by), by, "left_semi"), by)
    out = sizes.select(by, "n").join(state.select(by, "trials"), by).join(counted.join(last, by), by, "left")
    return out.select(by, "params", F.coalesce("inliers", F.lit(0)).alias("inliers"), "n", "trials")
