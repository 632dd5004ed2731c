"""Rigid fits, robust search, and alignment measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from .consensus import Model, consensus

POSE = "array<double>"


def fit_rigid(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """4x4 that carries q to p with the least weighted squares, by the singular vectors of the cross moments; identity for fewer than three points."""
    if len(p) < 3:
        return np.eye(4)
    w = np.ones(len(p)) if w is None else w
    cp, cq = (w @ p) / w.sum(), (w @ q) / w.sum()
    return _from_moments((p - cp).T @ ((q - cq) * w[:, None]), cp, cq)


def _from_moments(m: np.ndarray, cp: np.ndarray, cq: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, cp - r @ cq
    return out


def rigid_fit(matches: DataFrame, by: str) -> DataFrame:
    """by, n, trans, rmsd from matches (px, py, pz, qx, qy, qz[, w]): moments are summed on the cluster, one small matrix a group is solved."""
    w = F.col("w") if "w" in matches.columns else F.lit(1.0)
    p, q = [F.col(f"p{c}") for c in "xyz"], [F.col(f"q{c}") for c in "xyz"]
    sums = [F.sum(w).alias("sw"), F.count("*").alias("n"), *[F.sum(w * p[i]).alias(f"p{i}") for i in range(3)], *[F.sum(w * q[i]).alias(f"q{i}") for i in range(3)]]
    sums += [F.sum(w * p[i] * q[j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    sums += [F.sum(w * sum((x * x for x in (*p, *q)), F.lit(0.0))).alias("s2")]
    got = matches.groupBy(by).agg(*sums)

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                cp, cq = np.array([r[f"p{i}"] for i in range(3)]) / r.sw, np.array([r[f"q{i}"] for i in range(3)]) / r.sw
                m = np.array([[r[f"m{i}{j}"] for j in range(3)] for i in range(3)]) - r.sw * np.outer(cp, cq)
                t = _from_moments(m, cp, cq) if r.n >= 3 else np.eye(4)
                spread = r.s2 - r.sw * (cp @ cp + cq @ cq)
                err = (spread - 2 * np.trace(t[:3, :3].T @ m)) / r.sw
                out.append((r[by], int(r.n), t.ravel().tolist(), float(np.sqrt(max(0.0, err)))))
            yield pd.DataFrame(out, columns=[by, "n", "trans", "rmsd"])

    kind = matches.schema[by].dataType.simpleString()
    return got.mapInPandas(solve, f"`{by}` {kind}, n bigint, trans {POSE}, rmsd double")


def _rigid_samples(m: np.ndarray) -> np.ndarray:
    """(samples, 16): the fits of (samples, 3, 6); nan where a value is endless."""
    good = np.isfinite(m).all((1, 2))
    m = np.where(good[:, None, None], m, 0.0)
    cp, cq = m[:, :, :3].mean(1), m[:, :, 3:].mean(1)
    u, _, vt = np.linalg.svd((m[:, :, :3] - cp[:, None]).transpose(0, 2, 1) @ (m[:, :, 3:] - cq[:, None]))
    turn = np.sign(np.linalg.det(u @ vt))
    u[:, :, 2] *= np.where(turn == 0, 1.0, turn)[:, None]
    out = np.tile(np.eye(4), (len(m), 1, 1))
    out[:, :3, :3] = u @ vt
    out[:, :3, 3] = cp - (out[:, :3, :3] @ cq[:, :, None])[:, :, 0]
    out[~good] = np.nan
    return out.reshape(-1, 16)


def _rigid_error(params: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distances of p from the moved q."""
    t = params.reshape(-1, 4, 4)
    out = np.zeros(np.broadcast_shapes((len(t), 1), m.shape[:-1]))
    part = np.empty_like(out)
    with np.errstate(all="ignore"):
        for i in range(3):
            off = m[..., i] - t[:, i, 3, None]
            for j in range(3):
                off -= np.multiply(t[:, i, j, None], m[..., 3 + j], out=part)
            out += np.multiply(off, off, out=part)
        return np.sqrt(out, out=out)


def _rigid_solve(matches: DataFrame, by: str) -> DataFrame:
    """by, params from means and covariances that are summed on the cluster."""
    p, q = [F.col(f"p{c}") for c in "xyz"], [F.col(f"q{c}") for c in "xyz"]
    got = matches.groupBy(by).agg(F.array(*[F.avg(x) for x in (*p, *q)]).alias("mid"), F.array(*[F.covar_pop(a, b) for a in p for b in q]).alias("m"))

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(g, _from_moments(np.reshape(m, (3, 3)), mid[:3], mid[3:]).ravel().tolist()) for g, mid, m in zip(pdf[by], pdf["mid"], pdf["m"], strict=True) if np.isfinite([*mid, *m]).all()]
            yield pd.DataFrame(rows, columns=[by, "params"])

    return got.mapInPandas(solve, f"`{by}` {matches.schema[by].dataType.simpleString()}, params {POSE}")


#: p = R q + t; three matches.
RIGID = Model(("px", "py", "pz", "qx", "qy", "qz"), 3, _rigid_samples, _rigid_error, lambda m: np.zeros(len(m), bool), _rigid_solve, once=True, direct=True)


def ransac(matches: DataFrame, by: str, limit: float = 0.05, p: float = 0.99, least: int = 10, most: int = 50_000, seed: int = 0) -> DataFrame:
    """by, trans, inliers, n, trials: the rigid motion with most matches closer than `limit`.

    Samples of three come from hashes of the key, so results don't depend on partitions; a group of any size is
    spread over tasks (see `consensus`). Rounds of 64 trials and more end by the best share so far; of equal counts the later trial
    wins; the last fit is over its inliers. Three matches are fitted directly; fewer, or no
    model, give the identity without inliers. Every row is a match, unless a value is null or nan.
    """
    # The name of a group is text that is never null, as joins lose null.
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("_group")
    got = consensus(matches.select(group, *RIGID.columns), "_group", None, RIGID, limit, p, least, most, seed)
    back = F.when(F.col("_group") != "", F.expr("substring(_group, 2)").cast(matches.schema[by].dataType)).alias(by)
    eye = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    return got.select(back, F.coalesce("params", eye).alias("trans"), "inliers", "n", "trials")


def align_rmsd(matches: DataFrame, by: str) -> DataFrame:
    d2 = sum(((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "xyz"), F.lit(0.0))
    return matches.groupBy(by).agg(F.sqrt(F.avg(d2)).alias("rmsd"), F.count("*").alias("n"))


def information_matrix(points: DataFrame, by: str) -> DataFrame:
    """Upper triangle of the sum of G'G with G = [I, -[q]x]: i00 is the count, the rest first and second moments."""
    x, y, z = geom.xyz()
    s = lambda c: F.sum(c)
    return points.groupBy(by).agg(
        F.count("*").cast("double").alias("i00"),
        s(z).alias("i04"), (-s(y)).alias("i05"), (-s(z)).alias("i13"), s(x).alias("i15"), s(y).alias("i23"), (-s(x)).alias("i24"),
        s(y * y + z * z).alias("i33"), (-s(x * y)).alias("i34"), (-s(x * z)).alias("i35"), s(x * x + z * z).alias("i44"), (-s(y * z)).alias("i45"), s(x * x + y * y).alias("i55"),
    )


def transform_error(pose: Column, info: Column) -> Column:
    """e'Ie / I[0] of a pose (16) under an information matrix (36); e holds t and the vector part of the quaternion (w >= 0) whose turn is the pose's."""
    _, qx, qy, qz = geom.matrix_to_quaternion(pose)
    e = F.array(pose[3], pose[7], pose[11], qx, qy, qz)
    row = lambda i: F.aggregate(F.zip_with(F.slice(info, 6 * i + 1, 6), e, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.zip_with(e, F.array(*[row(i) for i in range(6)]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / info[0]


def registration_pr(gt: DataFrame, info: DataFrame, result: DataFrame, err2: float = 0.04) -> DataFrame:
    """scene, n_gt, n_result, good, bad_pose, not_in_gt, recall, precision over pairs with j - i > 1; a result is good if its squared error is at most err2."""
    far = F.col("j") - F.col("i") > 1
    truth = gt.where(far).join(info.select("scene", "i", "j", "info"), ["scene", "i", "j"]).select("scene", "i", "j", F.col("trans").alias("gt"), "info")
    got = result.where(far).join(truth, ["scene", "i", "j"], "left")
    # Step by step: a matrix is used many times, and each use of an expression would repeat it.
    got = got.withColumn("back", geom.affine_inverse(F.col("gt"))).withColumn("off", geom.matmul4(F.col("back"), F.col("trans")))
    error = transform_error(F.col("off"), F.col("info"))
    marked = got.select("scene", F.col("gt").isNull().alias("missing"), (error <= err2).alias("ok"))
    per = marked.groupBy("scene").agg(F.count("*").alias("n_result"), F.count_if(F.coalesce("ok", F.lit(False))).alias("good"), F.count_if(~F.col("missing") & ~F.coalesce("ok", F.lit(False))).alias("bad_pose"), F.count_if("missing").alias("not_in_gt"))
    return truth.groupBy("scene").agg(F.count("*").alias("n_gt")).join(per, "scene", "left").fillna(0).select("scene", "n_gt", "n_result", "good", "bad_pose", "not_in_gt", (F.col("good") / F.col("n_gt")).alias("recall"), F.when(F.col("n_result") > 0, F.col("good") / F.col("n_result")).alias("precision"))


def trajectory_rmse(truth: DataFrame, got: DataFrame, by: str) -> DataFrame:
    """by, n, rmse, median of the translation error after the best rigid alignment; both are (by, k, x, y, z), joined by position."""
    m = truth.select(by, "k", *[F.col(c).alias(f"p{c}") for c in "xyz"]).join(got.select(by, "k", *[F.col(c).alias(f"q{c}") for c in "xyz"]), [by, "k"])
    fit = rigid_fit(m, by).select(by, "trans")
    moved = geom.transform(F.col("trans"), tuple(F.col(f"q{c}") for c in "xyz"))
    d2 = geom.norm2([F.col(f"p{c}") - v for c, v in zip("xyz", moved, strict=True)])
    return m.join(fit, by).groupBy(by).agg(F.count("*").alias("n"), F.sqrt(F.avg(d2)).alias("rmse"), F.median(F.sqrt(d2)).alias("median"))
