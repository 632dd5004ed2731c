"""The tolerant as-of join against a plain loop over all orders."""

import datetime
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fusionframe.llm import asof_join

CLICKS = "click_id long, client_id long, ts timestamp_ntz, lag_us string, key string, us string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, priority int, total double, n_tied string, us string"
START = datetime.datetime(2024, 1, 1)
DAY = 86_400_000_000


def micros(x):
    return None if x is None else (x - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)


def crc(x):
    return zlib.crc32(str(x).encode())


def brute(clicks, sales, tolerance):
    at = lambda i, t: None if t is None else micros(t) // DAY * DAY if i is not None and crc(i) % 2 else micros(t)
    orders = []
    for i, c, t, p, x in sales:
        cents = None if x is None else int((100 * x + 0.5) // 1)
        orders.append((c, at(i, t), p, i, cents))
        if i is not None and crc(i) % 3:
            orders.append((c, at(i, t), None if p is None else 6 - p, -1 - i, cents))
    low = float("-inf")
    rank = lambda o: (o[1], low if o[2] is None else o[2], low if o[3] is None else -o[3], low if o[4] is None else o[4])
    out = []
    for i, c, t in sorted(set(clicks), key=repr):
        us = at(i, t)
        near = [o for o in orders if c is not None and us is not None and o[0] == c and o[1] is not None and 0 <= us - o[1] <= tolerance]
        if not near:
            out.append((i, c, us, None, None, None, 0))
            continue
        best = max(near, key=rank)
        out.append((i, c, us, best[3], us - best[1], best[4], sum(o[:2] == best[:2] for o in orders)))
    return sorted(out, key=repr)


def shop(seed, span_s, clients):
    rng = random.Random(seed)
    when = lambda: None if rng.random() < 0.05 else START + datetime.timedelta(seconds=rng.randrange(span_s), microseconds=rng.choice([0, 0, 1, 999_999]))
    client = lambda: rng.choice([None, 0, *[0] * 5, *range(clients)])
    clicks = [(i, client(), when()) for i in range(400)]
    sales = [(rng.choice([i, i, i, None]), client(), when(), rng.choice([None, 1, 2, 5]), rng.choice([None, 0.0, 1.005, 2.675, -3.335, rng.random() * 500])) for i in range(250)]
    return clicks + clicks[:40], sales + sales[:20]


@pytest.mark.parametrize("seed,span_s,clients,slice_us", [(1, 40 * 86_400, 9, asof_join.SLICE), (2, 6 * 3_600, 3, asof_join.SLICE), (3, 20 * 86_400, 4, 7_000_001), (4, 9 * 86_400, 2, 400 * asof_join.HOUR)])
def test_match_clicks(spark, seed, span_s, clients, slice_us):
    clicks, sales = shop(seed, span_s, clients)
    c = spark.createDataFrame([(*x, "x", "y", "z") for x in clicks], CLICKS).repartition(5)
    s = spark.createDataFrame([(*x, "x", "y") for x in sales], SALES).repartition(3)
    got = asof_join.match_clicks(c, s, slice_us=slice_us).collect()
    assert sorted(map(tuple, got), key=repr) == brute(clicks, sales, 72 * asof_join.HOUR)


def test_tolerance_counts_both_ends(spark):
    at = lambda us: (1, START + datetime.timedelta(microseconds=us))
    c = spark.createDataFrame([(k, *at(us)) for k, us in enumerate((99, 100, 350, 351))], "click_id long, client_id long, ts timestamp_ntz")
    s = spark.createDataFrame([(2, *at(100), 3, 1.0)], "sale_id long, client_id long, sold_at timestamp_ntz, priority int, total double")
    own = c.select("click_id", F.col("client_id").alias("key"), asof_join.micros(c, "ts").alias("us"))
    orders = s.select(F.col("client_id").alias("key"), asof_join.micros(s, "sold_at").alias("us"), "sale_id")
    for width in (1, 90, 10_000):
        got = {r.click_id: (r.sale_id, r.n_tied) for r in asof_join.asof_join(own, orders, 250, [], ["sale_id"], slice_us=width).collect()}
        assert got == {0: (None, 0), 1: (2, 1), 2: (2, 1), 3: (None, 0)}


def test_asof_zone_and_empty(spark):
    """A timestamp with a zone and one without give the same microseconds in any session zone; empty tables give what the docstring says."""
    clicks, sales = shop(5, 86_400, 2)
    c = spark.createDataFrame([(*x, "", "", "") for x in clicks], CLICKS)
    s = spark.createDataFrame([(*x, "", "") for x in sales], SALES)
    want = sorted(map(tuple, asof_join.match_clicks(c, s).collect()), key=repr)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(map(tuple, asof_join.match_clicks(c, s).collect()), key=repr) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert asof_join.match_clicks(c.limit(0), s).count() == 0
    assert {r.n_tied for r in asof_join.match_clicks(c, s.limit(0)).collect()} == {0}
