"""Random choices and orders that don't depend on partitions: by a seeded MD5 of the keys.

Every choice is a top-k on a hash, so only bounded rows meet in a task, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import dense_ids

SALTS = 64


def chance_key(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys]).cast("binary"))


def uniform(keys: list[str], seed: int, low: float = 0.0, high: float = 1.0, gap: float = 1e-4) -> Column:
    """A number in [low, high - gap) for each key, out of 48 bits of its hash."""
    share = F.conv(F.substring(chance_key(keys, seed), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return low + share * (high - gap - low)


def sample(rows: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """n rows without replacement, in random order; all of them if there are fewer."""
    return rows.withColumn("_chance", chance_key(keys, seed)).orderBy("_chance", *keys).limit(n).drop("_chance")


def sample_each(rows: DataFrame, by: str, most: int, keys: list[str], seed: int, multiple: int = 1) -> DataFrame:
    """Of each group its size floored to a multiple, but at most `most` rows, without replacement. Groups are cut to `most` in salted parts first."""
    own = rows.withColumn("_chance", chance_key(keys, seed)).withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    first = own.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_salt").orderBy("_chance", *keys))).where(F.col("_k") <= most)
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    ranked = first.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("_chance", *keys)))
    kept = ranked.join(sizes, ranked[by].eqNullSafe(sizes["_by"])).where(F.col("_k") <= F.least(F.lit(most), F.floor(F.col("_n") / multiple) * multiple))
    return kept.select(*rows.columns)


def permutation(items: DataFrame, keys: list[str], seed: int, name: str = "place") -> DataFrame:
    """Distinct items with their places from 0 in a random order; no global window."""
    order = dense_ids(items.withColumn("_chance", chance_key(keys, seed)), ["_chance", *keys], name)
    return order.withColumn(name, F.col(name) - 1).drop("_chance")


def argsort(items: DataFrame, value: str, key: str, name: str = "place") -> DataFrame:
    """Distinct items with their places from 0 in ascending order of a value, ties by key."""
    return dense_ids(items, [value, key], name).withColumn(name, F.col(name) - 1)


def pad_to_batch(rows: DataFrame, by: str, order: list[str], batch: int = 50) -> DataFrame:
    """All rows as copy 0, and copies of each group's last row up to a multiple of the batch; a whole batch of copies where the group is a multiple already."""
    last = rows.groupBy(by).agg(F.count("*").alias("_n"), F.max(F.struct(*order, F.struct(*rows.columns).alias("_row"))).alias("_last"))
    copies = last.select("_last._row", F.explode(F.sequence(F.lit(1), (batch - F.col("_n") % batch).cast("int"))).alias("copy"))
    return rows.withColumn("copy", F.lit(0)).unionByName(copies.select("_row.*", "copy"))
