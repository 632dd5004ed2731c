"""Correspondence mining: a point seen in two frames (match) and one from elsewhere (non-match)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..plans.checkpoint import checkpointed


def _order(seed: int, *columns: str):
    """Random but repeatable: independent of partitions."""
    return F.xxhash64(F.lit(seed), *columns)


def mine_matches(anchors: DataFrame, depth: DataFrame, poses: DataFrame, k: tuple, baseline: float = 1.0, agree: float = 0.03, width: int = 640, height: int = 480, seed: int = 0, strict: bool = True) -> DataFrame:
    """p1, frame, px, py of the match of each anchor (p1, scene, frame, px, py, d) in another frame of its scene.

    The point is projected in every frame of the scene, whose camera must be at least `baseline` away,
    must fall inside the image, and the depth found there must agree within `agree` (where `strict`
    is False any depth will do). Of several frames a seeded hash takes one. Pixels meet by an equi-join.
    """
    own = anchors.join(poses.withColumnRenamed("pose", "from"), ["scene", "frame"])
    w = geom.transform(F.col("from"), geom.backproject(F.col("px"), F.col("py"), F.col("d"), k))
    own = own.select("p1", "scene", F.col("frame").alias("f1"), F.col("from"), *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"), strict=True)])
    seen = own.join(poses, "scene").where("frame <> f1")
    apart = geom.norm2([F.col("from")[i] - F.col("pose")[i] for i in (3, 7, 11)])
    c = geom.inverse_transform(F.col("pose"), (F.col("wx"), F.col("wy"), F.col("wz")))
    seen = seen.where(apart >= baseline * baseline).select("p1", "scene", "frame", "wx", "wy", "wz", *[x.alias(n) for x, n in zip(c, ("cx", "cy", "cz"), strict=True)])
    u, v = geom.project((F.col("cx"), F.col("cy"), F.col("cz")), k)
    seen = seen.select("*", F.when((u > -1) & (u < width), u).cast("int").alias("px"), F.when((v > -1) & (v < height), v).cast("int").alias("py")).where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))
    hit = seen.join(depth.select("scene", "frame", "px", "py", "d"), ["scene", "frame", "px", "py"]).where("d > 0")
    if strict:
        hit = hit.where(F.abs(F.col("d") - F.col("cz")) <= agree)
    one = hit.groupBy("p1").agg(F.min_by(F.struct("scene", "frame", "px", "py", "wx", "wy", "wz"), F.struct(_order(seed, "p1", "frame"), "frame")).alias("m"))
    return one.select("p1", "m.*")


def mine_triplets(anchors: DataFrame, depth: DataFrame, poses: DataFrame, k: tuple, far: float = 0.1, pool: int = 256, seed: int = 0, **how) -> DataFrame:
    """Matches with a non-match (n_frame, n_px, n_py) of the same scene, more than `far` away in space.

    All pixels with depth are dealt into groups of about `pool` by seeded hash. Each anchor tries eight pixels of the group
    that its own hash names. Where all of them are near, it takes its non-match from all pixels of the
    scene: by a seeded hash of the cells of size `far` that are wholly further away, else from the pixels of the cells around.
    """
    match = checkpointed(mine_matches(anchors, depth, poses, k, seed=seed, **how))
    p = depth.where("d > 0").join(poses, ["scene", "frame"])
    w = geom.transform(F.col("pose"), geom.backproject(F.col("px"), F.col("py"), F.col("d"), k))
    pixels = checkpointed(p.select("scene", F.col("frame").alias("n_frame"), F.col("px").alias("n_px"), F.col("py").alias("n_py"), *[c.alias(f"n{n}") for c, n in zip(w, "xyz", strict=True)], _order(seed + 1, "frame", "px", "py").alias("o")))
    sizes = pixels.groupBy("scene").agg(F.ceil(F.count("*") / pool).alias("groups"))
    dealt = pixels.join(F.broadcast(sizes), "scene").withColumn("g", F.pmod(_order(seed + 2, "n_frame", "n_px", "n_py"), "groups"))
    pick = dealt.groupBy("scene", "g").agg(F.sort_array(F.collect_list(F.struct("o", "n_frame", "n_px", "n_py", "nx", "ny", "nz"))).alias("all"))  # about pool each
    near = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("all", F.pmod(_order(seed + 3, "p1") + i, F.size("all")).cast("int")))
    named = match.join(F.broadcast(sizes), "scene").withColumn("g", F.pmod(_order(seed + 4, "p1"), "groups"))
    j = named.join(pick, ["scene", "g"]).withColumn("c", F.explode(near))
    first = _farther(j, far, seed)
    left = match.join(first, "p1", "left_anti")
    return first.union(_any_far(left, pixels, far, seed))


def _farther(tried: DataFrame, far: float, seed: int) -> DataFrame:
    """Of the candidates c of each match, of those further away than `far`, one by seeded hash."""
    d2 = sum(((F.col(f"w{n}") - F.col(f"c.n{n}")) * (F.col(f"w{n}") - F.col(f"c.n{n}")) for n in "xyz"), F.lit(0.0))
    ok = tried.where(d2 > far * far).groupBy("p1").agg(F.min_by(F.struct("frame", "px", "py", "c.n_frame", "c.n_px", "c.n_py"), F.struct(_order(seed, "p1", "c.n_frame", "c.n_px", "c.n_py"), "c.n_frame", "c.n_px", "c.n_py")).alias("m"))
    return ok.select("p1", "m.*")


def _any_far(match: DataFrame, pixels: DataFrame, far: float, seed: int) -> DataFrame:
    """A pixel further away than `far` for each match whose scene has one.

    A pixel two or more cells away on an axis is further away. One pixel of each cell stands for it, and of the cells in the order
    of a hash the first 28 do, as only 27 are not away. Where none is away, the whole scene lies within those 27 cells,
    and all of its pixels are tried, spread over 32 parts of each scene.
    """
    cell = [F.floor(F.col(f"n{n}") / far).cast("long").alias(f"c{n}") for n in "xyz"]
    at = [F.floor(F.col(f"w{n}") / far).cast("long").alias(f"a{n}") for n in "xyz"]
    own = F.struct("n_frame", "n_px", "n_py", "nx", "ny", "nz")
    cells = pixels.select("*", *cell).groupBy("scene", "cx", "cy", "cz").agg(F.min_by(own, F.struct("o", "n_frame", "n_px", "n_py")).alias("c"))
    ranked = cells.withColumn("h", _order(seed + 5, "cx", "cy", "cz"))
    # the 28 smallest of the cells of each scene, of the 28 smallest of each part
    some = F.slice(F.sort_array(F.collect_list(F.struct("h", "cx", "cy", "cz", "c"))), 1, 28)
    parts = ranked.groupBy("scene", F.pmod(F.col("h"), F.lit(64)).alias("part")).agg(some.alias("s")).select("scene", F.explode("s").alias("s")).select("scene", "s.*")
    first = parts.groupBy("scene").agg(some.alias("s"))
    tried = match.select("*", *at).join(F.broadcast(first), "scene").withColumn("s", F.explode("s"))
    away = F.greatest(*[F.abs(F.col(f"s.c{n}") - F.col(f"a{n}")) for n in "xyz"]) >= 2
    found = _farther(tried.where(away).withColumn("c", F.col("s.c")), far, seed)
    spread = pixels.select("scene", F.pmod(F.col("o"), F.lit(32)).cast("int").alias("part"), own.alias("c"))
    close = match.join(found, "p1", "left_anti").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(31)))).join(spread, ["scene", "part"])
    return found.union(_farther(close, far, seed))
