"""Tolerant as-of join: a window over the union of both sides, with a RANGE frame of the tolerance.

Events and orders become one table of (key, microseconds, packed order), and the match of an event is the
largest packed struct (time, tie keys, payload) of the frame from `tolerance` microseconds before it to its
own row. How many orders share the matched time is counted by (key, time) and joined afterwards.

A key may hold a third of all rows, so the window isn't dealt by key alone:

* orders of one key and time become their largest struct, and events of one key and time one row, before
  they are shuffled to the window (with sums in the map tasks);
* the window is dealt by (key, slice of time). What a slice needs from before it is one order: the latest of the
  earlier slices. It comes from the same kind of window over one row a slice (dealt by blocks of slices), and enters
  the slice as a row at its own time, so that the frame there still decides about the tolerance;
* events meet the matches by (key, time) in a join whose large partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
SLICE = HOUR // 3
BLOCK = 216  # slices


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as UTC, whatever the zone of the session."""
    if df.schema[column].dataType.simpleString() == "timestamp_ntz":
        since = F.col(column) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return (since.cast("decimal(20,6)") * 1_000_000).cast("bigint")
    return F.unix_micros(column)


def crc_of(column: str) -> Column:
    """Unsigned crc32 of a number as decimal digits."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def _slice(column: str, width: int) -> Column:
    return ((F.col(column) - F.pmod(column, F.lit(width))) / width).cast("long")


def _last_before(heads: DataFrame, back: int, slice_us: int) -> DataFrame:
    """key, slice, order: the latest order of the `back` slices before each slice, where there is one; heads: key, slice, last.

    Slices are met within blocks of BLOCK, and what a block needs from before it is again one order; a key has a row a block there.
    """
    blocks = heads.withColumn("block", _slice("slice", BLOCK))
    tops = blocks.groupBy("key", "block").agg(F.max("last").alias("top"))
    w = Window.partitionBy("key").orderBy("block").rangeBetween(-(-(-back // BLOCK) + 1), -1)
    entering = tops.select("key", "block", F.max("top").over(w).alias("last")).where("last is not null")
    entering = entering.select("key", "block", _slice("last.us", slice_us).alias("slice"), "last", F.lit(False).alias("own"))
    both = blocks.select("key", "block", "slice", "last", F.lit(True).alias("own")).unionByName(entering)
    w = Window.partitionBy("key", "block").orderBy("slice").rangeBetween(-back, -1)
    return both.withColumn("order", F.max("last").over(w)).where("own and order is not null").select("key", "slice", "order")


def latest_within(events: DataFrame, orders: DataFrame, tolerance: int, ties: list[Column], payload: list[str], slice_us: int = SLICE) -> DataFrame:
    """key, us, matched_us, the payload and n_tied, for each distinct (key, us) of events with a match.

    Both sides have columns key and us (bigint microseconds); rows with a null in either never match.
    `ties` are columns of orders, larger first: among orders of one time the largest struct wins,
    and a null loses to any value (the payload goes last, so that equal orders give one result).
    n_tied counts all orders of the key at the matched time, repeated rows each. The slice only
    says how the work is cut: a row's frame holds at most the distinct times of a key in one slice.
    """
    there = F.col("key").isNotNull() & F.col("us").isNotNull()
    packed = F.struct(F.col("us"), *[t.alias(f"t{k}") for k, t in enumerate(ties)], *payload)
    at = orders.where(there).select("key", "us", packed.alias("order")).groupBy("key", "us").agg(F.max("order").alias("order"))
    asked = events.where(there).select("key", "us").distinct()
    kind = at.schema["order"].dataType
    rows = at.select("key", "us", "order", F.lit(False).alias("asks")).unionByName(asked.select("key", "us", F.lit(None).cast(kind).alias("order"), F.lit(True).alias("asks")))
    rows = rows.withColumn("slice", _slice("us", slice_us))
    # The latest order of the slices before, as far back as the tolerance reaches.
    heads = rows.groupBy("key", "slice").agg(F.max("order").alias("last"))
    carried = _last_before(heads, -(-tolerance // slice_us) + 1, slice_us)
    rows = rows.unionByName(carried.select("key", F.col("order.us").alias("us"), "order", F.lit(False).alias("asks"), "slice"))
    frame = Window.partitionBy("key", "slice").orderBy("us").rangeBetween(-tolerance, Window.currentRow)
    met = rows.withColumn("match", F.max("order").over(frame)).where("asks and match is not null")
    met = met.select("key", "us", F.col("match.us").alias("matched_us"), *[F.col(f"match.{p}").alias(p) for p in payload])
    counts = orders.where(there).groupBy(F.col("key"), F.col("us").alias("matched_us")).agg(F.count("*").alias("n_tied"))
    return met.join(counts, ["key", "matched_us"])


def asof_join(clicks: DataFrame, orders: DataFrame, tolerance: int, ties: list[Column], payload: list[str], slice_us: int = SLICE) -> DataFrame:
    """The columns of clicks (with key and us), matched_us, the payload and n_tied (0 where nothing matches); one row per row of clicks.

    A click without key or time never matches and stays. Other columns of orders are ignored. No orders: no
    click matches; no clicks: no rows.
    """
    best = latest_within(clicks, orders, tolerance, ties, payload, slice_us)
    best = best.select(F.col("key").alias("_k"), F.col("us").alias("_u"), "matched_us", *payload, "n_tied")
    out = clicks.join(best, (F.col("key") == F.col("_k")) & (F.col("us") == F.col("_u")), "left").drop("_k", "_u")
    return out.withColumn("n_tied", F.coalesce("n_tied", F.lit(0).cast("long")))


def distinct_clicks(clicks: DataFrame) -> DataFrame:
    """click_id, client_id, us: one row per click_id, its copies counting once; where copies differ the smallest client and time stay (null last).

    Rows without a click_id are told apart by client and time.
    """
    own = clicks.select(F.col("click_id").cast("long"), F.col("client_id").cast("long"), micros(clicks, "ts").alias("us"))
    rank = F.struct(F.col("client_id").isNull().alias("no_client"), "client_id", F.col("us").isNull().alias("no_time"), "us")
    none = F.when(F.col("click_id").isNull(), F.struct("client_id", "us"))
    out = own.groupBy("click_id", none.alias("none")).agg(F.min(rank).alias("r"))
    return out.select("click_id", F.col("r.client_id").alias("client_id"), F.col("r.us").alias("us"))


def floored(us: Column, h: Column) -> Column:
    """The time, at the start of its day (UTC) where h is odd."""
    return F.when(h % 2 == 1, us - F.pmod(us, F.lit(DAY))).otherwise(us)


def orders_of(sales: DataFrame) -> DataFrame:
    """key, us, sale_id, priority, total_cents: each sale, and its second order where h isn't divisible by 3."""
    h = crc_of("sale_id")
    own = sales.select(F.col("client_id").cast("long").alias("key"), floored(micros(sales, "sold_at"), h).alias("us"), F.col("sale_id").cast("long"), F.col("priority").cast("long"), F.floor(100 * F.col("total") + 0.5).cast("long").alias("total_cents"), h.alias("h"))
    twin = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    both = F.when(F.col("h") % 3 != 0, F.array(F.struct("sale_id", "priority"), twin)).otherwise(F.array(F.struct("sale_id", "priority")))
    return own.select("key", "us", F.explode(both).alias("o"), "total_cents").select("key", "us", "o.sale_id", "o.priority", "total_cents")


def match_clicks(clicks: DataFrame, sales: DataFrame, tolerance: int = 72 * HOUR, slice_us: int = SLICE) -> DataFrame:
    """The contract's rows for a table of clicks and one of sales.

    Nulls in any column, repeated rows, ties, empty tables and further columns give what the functions above say;
    text columns of any length are never read.
    """
    own = distinct_clicks(clicks)
    own = own.select("click_id", F.col("client_id").alias("key"), floored(F.col("us"), crc_of("click_id")).alias("us"))
    ties = [F.col("priority"), -F.col("sale_id")]  # the smallest id is the largest of the negative ones; null is the least of all
    out = asof_join(own, orders_of(sales), tolerance, ties, ["total_cents", "sale_id"], slice_us)
    return out.select("click_id", F.col("key").alias("client_id"), F.col("us").alias("ts_us"), "sale_id", (F.col("us") - F.col("matched_us")).alias("lag_us"), "total_cents", "n_tied")


def op12_asof_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return match_clicks(table(spark, sf_dir, "clicks").select("click_id", "client_id", "ts"), table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at", "priority", "total"))


OP12_SQL = """
WITH poly AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
c AS (
  SELECT click_id, client_id, epoch_us(ts) AS us FROM clicks
  QUALIFY row_number() OVER (PARTITION BY click_id, CASE WHEN click_id IS NULL THEN client_id END, CASE WHEN click_id IS NULL THEN ts END ORDER BY client_id NULLS LAST, ts NULLS LAST) = 1),
ch AS (
  SELECT click_id, client_id, us, xor(list_reduce([4294967295] || list_transform(string_split(click_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM c, poly),
ct AS (
  SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN us - ((us % 86400000000 + 86400000000) % 86400000000) ELSE us END AS us FROM ch),
sh AS (
  SELECT sale_id, client_id, epoch_us(sold_at) AS us, priority, floor(100 * total + 0.5)::BIGINT AS total_cents,
    xor(list_reduce([4294967295] || list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM sales, poly),
st AS (
  SELECT sale_id, client_id, priority, total_cents, h, CASE WHEN h % 2 = 1 THEN us - ((us % 86400000000 + 86400000000) % 86400000000) ELSE us END AS us FROM sh),
o AS (
  SELECT client_id, us, sale_id, priority, total_cents FROM st
  UNION ALL SELECT client_id, us, -1 - sale_id, 6 - priority, total_cents FROM st WHERE h % 3 <> 0),
best AS (
  SELECT *, count(*) OVER (PARTITION BY client_id, us) AS n_tied FROM o WHERE client_id IS NOT NULL AND us IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY client_id, us ORDER BY priority DESC NULLS LAST, sale_id NULLS LAST, total_cents DESC NULLS LAST) = 1),
m AS (
  SELECT ct.click_id, ct.client_id, ct.us, b.us AS matched, b.sale_id, b.total_cents, b.n_tied
  FROM ct ASOF LEFT JOIN best b ON ct.client_id = b.client_id AND ct.us >= b.us)
SELECT click_id::BIGINT AS click_id, client_id::BIGINT AS client_id, us AS ts_us,
  CASE WHEN us - matched <= 259200000000 THEN sale_id END AS sale_id,
  CASE WHEN us - matched <= 259200000000 THEN us - matched END AS lag_us,
  CASE WHEN us - matched <= 259200000000 THEN total_cents END AS total_cents,
  CASE WHEN us - matched <= 259200000000 THEN n_tied ELSE 0 END AS n_tied
FROM m
"""
