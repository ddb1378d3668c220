"""Sliced ordered operators against a plain sort, one key holding most rows."""

import random
import statistics
from math import ceil

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanweave.operators import asof
from spanweave.operators.ordered import exact_median, nearest_rank, sliced_lag, sliced_rank, sliced_running, time_slice


def data(seed, n=150):
    rng = random.Random(seed)
    return [("hot" if i % 3 else rng.choice("xy"), i, round(rng.random() * 50, 2), rng.choice([None, 1.0, 2.5, -3.0])) for i in range(n)]


SCHEMA = "k string, no int, t double, v double"


def by_key(items):
    groups = {}
    for x in sorted(items, key=lambda x: (x[0], x[2], x[1])):
        groups.setdefault(x[0], []).append(x)
    return groups


@pytest.mark.parametrize("width", [0.7, 5.0, 1000.0])
def test_running_and_lag_and_rank(spark, width):
    items = data(1)
    df = spark.createDataFrame(items, SCHEMA)
    order, block = [F.col("t"), F.col("no")], time_slice("t", width)
    run = sliced_running(df, ["k"], order, block, sums={"s": F.coalesce("v", F.lit(0.0))}, maxes={"m": F.col("v")}, lasts={"l": F.col("v")}, totals={"n": F.lit(1)})
    lag = sliced_lag(run, ["k"], order, block, {"prev": F.col("no")})
    both = sliced_rank(sliced_lag(lag, ["k"], order, block, {"next": F.col("no")}, forward=True), ["k"], order, block, "rank")
    want = []
    for group in by_key(items).values():
        total, biggest, last = 0.0, None, None
        for i, (k, no, _, v) in enumerate(group):
            total += v or 0.0
            if v is not None:
                biggest, last = v if biggest is None else max(biggest, v), v
            prev = group[i - 1][1] if i else None
            nxt = group[i + 1][1] if i + 1 < len(group) else None
            want.append((no, round(total, 6), biggest, last, len(group), prev, nxt, i + 1))
    got = rows(both.withColumn("s", F.round("s", 6)), "no", "s", "m", "l", "n", "prev", "next", "rank")
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_order_statistics(spark, n):
    items = [x for x in data(3, n * 4)]
    df = spark.createDataFrame(items, SCHEMA)
    p90 = {r[0]: r[1] for r in rows(nearest_rank(df, ["k"], "t", 0.9, "p", 3.0), "k", "p")}
    med = {r[0]: r[1] for r in rows(exact_median(df, ["k"], "t", "m", 3.0), "k", "m")}
    for k, group in by_key(items).items():
        values = sorted(x[2] for x in group)
        assert p90[k] == values[max(0, ceil(0.9 * len(values)) - 1)]
        assert med[k] == pytest.approx(statistics.median(values))
    whole = rows(exact_median(df, [], "t", "m", 3.0))
    assert whole[0][0] == pytest.approx(statistics.median(x[2] for x in items))


@pytest.mark.parametrize("width", [2.0, 600.0])
def test_frame_joins(spark, width):
    rng = random.Random(5)
    frames = sorted({("v", round(rng.random() * 40, 2)) for _ in range(60)})
    asks = [("v", i, round(rng.random() * 45, 2), 0.0) for i in range(50)]
    asks = [(k, i, s, round(s + rng.random() * 9 + 0.01, 2)) for k, i, s, _ in asks]
    f = spark.createDataFrame(frames, "k string, pts double")
    r = spark.createDataFrame(asks, "k string, no int, start_sec double, end_sec double")
    d = spark.createDataFrame([("v", 60.0)], "k string, duration_sec double")
    got = {x[0]: x[1:] for x in rows(asof.frame_snap(r, f, d, ["k"], ["no"], slice_sec=width, bucket_sec=3.0), "no", "src_start_sec", "src_end_sec", "precision_sec")}
    pts = [p for _, p in frames]
    for _, no, s, e in asks:
        lo = max([p for p in pts if p <= s], default=pts[0])
        hi = min([p for p in pts if p >= e], default=60.0)
        inside = [p for p in pts if lo <= p < hi]
        widest = max([b - a for a, b in zip(inside, [*inside[1:], hi])], default=None)
        assert got[no][:2] == (lo, hi)
        assert got[no][2] == pytest.approx(widest)
