"""Set operators against brute force on whole seconds, with slices and salts forced to be tiny."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanweave.operators import intervalsets as ivs
from spanweave.operators.rangejoin import contained_join, overlap_join, overlap_semi, unplaceable

SPAN = "k string, no int, start_sec double, end_sec double"


def spans(seed, n, keys="abc", top=60):
    # one key holds a third of all rows and many copies
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = keys[0] if i % 3 == 0 else rng.choice(keys)
        s = rng.randrange(top) if i % 5 else 7
        out.append((k, i, float(s), float(s + rng.randint(1, 9))))
    return out


def cells(items):
    out = {}
    for k, _, s, e in items:
        out.setdefault(k, set()).update(range(int(s), int(e)))
    return out


def runs(points):
    out, points = [], sorted(points)
    for p in points:
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [(float(a), float(b)) for a, b in out]


@pytest.mark.parametrize("slice_sec", [3.0, 10.0, 1000.0])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_union(spark, seed, slice_sec):
    items = spans(seed, 120)
    got = rows(ivs.union_spans(spark.createDataFrame(items, SPAN), ["k"], slice_sec=slice_sec))
    assert got == sorted(((k, a, b) for k, c in cells(items).items() for a, b in runs(c)), key=repr)


def test_union_touching_and_fractions(spark):
    df = spark.createDataFrame([("a", 0, 0.25, 1.5), ("a", 1, 1.5, 2.0), ("a", 2, 2.1, 9.75), ("a", 3, 5.0, 5.5)], SPAN)
    for width in (0.5, 1.0, 4.0, 100.0):
        assert rows(ivs.union_spans(df, ["k"], slice_sec=width)) == [("a", 0.25, 2.0), ("a", 2.1, 9.75)]
        assert rows(ivs.union_spans(df, ["k"], slice_sec=width, tolerance=0.2)) == [("a", 0.25, 9.75)]


@pytest.mark.parametrize("slice_sec", [4.0, 500.0])
def test_subtract(spark, slice_sec):
    base, cuts = spans(4, 60), spans(5, 25)
    b, c = spark.createDataFrame(base, SPAN), spark.createDataFrame(cuts, SPAN)
    got = rows(ivs.subtract_spans(b, c, ["k"], bucket_sec=5.0, slice_sec=slice_sec), "no", "start_sec", "end_sec")
    cut = cells(cuts)
    want = [(no, a, z) for k, no, s, e in base for a, z in runs(set(range(int(s), int(e))) - cut.get(k, set()))]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [None, 1, 5, 100_000_000])
def test_overlap_join_salted(spark, hot):
    left, right = spans(6, 60), spans(7, 50)
    r = spark.createDataFrame(right, SPAN).selectExpr("k", "no AS r_no", "start_sec AS r_start_sec", "end_sec AS r_end_sec")
    got = rows(overlap_join(spark.createDataFrame(left, SPAN), r, ["k"], bucket_sec=4.0, hot_pairs=hot), "no", "r_no")
    want = [(a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] < b[3] and b[2] < a[3]]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [None, 1, 7])
def test_contained_join_salted(spark, hot):
    outer, inner = spans(8, 60), spans(9, 60)
    i = spark.createDataFrame(inner, SPAN).selectExpr("k", "no AS i_no", "start_sec AS i_s", "end_sec AS i_e")
    o = spark.createDataFrame(outer, SPAN)
    got = rows(contained_join(o, i, ["k"], outer_span=("start_sec", "end_sec"), inner_span=("i_s", "i_e"), bucket_sec=3.0, hot_pairs=hot), "no", "i_no")
    want = [(a[1], b[1]) for a in outer for b in inner if a[0] == b[0] and a[2] <= b[2] and b[3] <= a[3]]
    assert got == sorted(want, key=repr)


def far_spans(seed, n):
    """Spans from a second to tens of years, some open, some that cannot be placed."""
    draw = random.Random(seed)
    out = []
    for no in range(n):
        start = draw.choice([0.0, 10.0, 1e4, 5e6, -3e8]) + draw.randint(0, 40)
        end = start + draw.choice([0.0, 1.0, 30.0, 5e3, 9e5, 7e7, 2e9, 1e17])
        start, end = draw.choice([(start, end)] * 8 + [(float("-inf"), end), (start, float("inf"))])
        out.append((draw.choice("ab"), no, start, end))
    inf, nan = float("inf"), float("nan")
    return [*out, ("a", n, -inf, inf), ("a", n + 1, nan, 5.0), ("a", n + 2, 5.0, None), ("a", n + 3, 9.0, 2.0), ("b", n + 4, 1e300, 2e300), ("b", n + 5, inf, inf)]


@pytest.mark.parametrize("hot", [None, 1, 100_000_000])
@pytest.mark.parametrize("touching", [False, True])
def test_spans_of_any_length_meet(spark, hot, touching):
    left, right = far_spans(1, 60), far_spans(2, 50)
    r = spark.createDataFrame(right, SPAN).selectExpr("k", "no AS r_no", "start_sec AS r_start_sec", "end_sec AS r_end_sec")
    l_df = spark.createDataFrame(left, SPAN)
    got = rows(overlap_join(l_df, r, ["k"], hot_pairs=hot, touching=touching), "no", "r_no")
    good = lambda x: x[2] is not None and x[3] is not None and x[2] <= x[3]
    meet = lambda a, b: good(a) and good(b) and (a[2] <= b[3] and b[2] <= a[3] if touching else a[2] < b[3] and b[2] < a[3])
    assert got == sorted([(a[1], b[1]) for a in left for b in right if a[0] == b[0] and meet(a, b)], key=repr)
    if not touching:
        hit = {x[0] for x in got}
        assert {x[0] for x in rows(overlap_semi(l_df, r, ["k"], ["no"], anti=True), "no")} == {a[1] for a in left} - hit
        assert {x[0] for x in rows(unplaceable(l_df, ("start_sec", "end_sec")), "no")} == {a[1] for a in left if not good(a)}
        inside = rows(contained_join(l_df, r, ["k"], outer_span=("start_sec", "end_sec"), inner_span=("r_start_sec", "r_end_sec"), hot_pairs=hot), "no", "r_no")
        want = [(a[1], b[1]) for a in left for b in right if a[0] == b[0] and good(a) and good(b) and a[2] <= b[2] and b[3] <= a[3]]
        assert inside == sorted(want, key=repr)


def test_a_long_span_covers(spark):
    long, short = spark.createDataFrame([("k", 1, 0.0, 7e7)], SPAN), spark.createDataFrame([("k", 2, 10.0, 20.0)], SPAN)
    r = long.selectExpr("k", "start_sec AS r_start_sec", "end_sec AS r_end_sec")
    assert overlap_join(short, r, ["k"]).count() == 1
    assert rows(ivs.covered_seconds(short, long, ["k"], ["k", "no"]), "covered_sec") == [(10.0,)]
    assert overlap_semi(short, r, ["k"], ["no"], anti=True).collect() == []


def test_one_long_span_does_not_multiply_the_rest(spark):
    """Short spans are guests of the long one's level, and guests do not meet there."""
    from spanweave.operators import rangejoin

    left = spark.range(2000).selectExpr("'k' AS k", "id AS no", "id * 100D AS start_sec", "id * 100D + 5 AS end_sec")
    right = left.selectExpr("k", "no AS r_no", "start_sec AS r_start_sec", "end_sec AS r_end_sec")
    left = left.unionByName(spark.createDataFrame([("k", -1, 0.0, 7e7)], "k string, no bigint, start_sec double, end_sec double"))
    met = rangejoin._meet(left, right, ["k"], ("start_sec", "end_sec"), ("r_start_sec", "r_end_sec"), 60.0, 100_000_000, False)
    assert met.count() < 4 * 2000 + 100
    assert overlap_join(left, right, ["k"]).count() == 4000


def test_semi_and_anti(spark):
    left, right = spans(10, 40), spans(11, 8)
    r = spark.createDataFrame(right, SPAN).selectExpr("k", "start_sec AS r_start_sec", "end_sec AS r_end_sec")
    l_df = spark.createDataFrame(left, SPAN)
    hit = {a[1] for a in left for b in right if a[0] == b[0] and a[2] < b[3] and b[2] < a[3]}
    assert {x[0] for x in rows(overlap_semi(l_df, r, ["k"], ["no"]), "no")} == hit
    assert {x[0] for x in rows(overlap_semi(l_df, r, ["k"], ["no"], anti=True), "no")} == {a[1] for a in left} - hit


def test_coverage_cases(spark):
    s = spark.createDataFrame([("a", 0, 0.0, 6.0), ("a", 1, 4.0, 15.0), ("b", 2, 20.0, 22.0)], SPAN)
    r = spark.createDataFrame([("a", 0, 2.0, 10.0), ("b", 1, 2.0, 10.0), ("c", 2, 2.0, 10.0)], SPAN)
    assert rows(ivs.covered_seconds(r, s, ["k"], ["k", "no"]), "k", "covered_sec") == [("a", 8.0), ("b", 0.0), ("c", 0.0)]


def test_priority_keeps_every_piece(spark):
    items = spans(12, 90)
    kinds = ["positive", "uncertain", "negative"]
    df = spark.createDataFrame([(*x, kinds[x[1] % 3]) for x in items], SPAN + ", kind string")
    got = rows(ivs.overlay_by_priority(df, ["k"], slice_sec=7.0), "no", "start_sec", "end_sec")
    by = {kind: cells([x for x in items if kinds[x[1] % 3] == kind]) for kind in kinds}
    want = []
    for k, no, s, e in items:
        free = set(range(int(s), int(e)))
        if no % 3 >= 1:
            free -= by["positive"].get(k, set())
        if no % 3 == 2:
            free -= by["uncertain"].get(k, set())
        want += [(no, a, b) for a, b in runs(free)] if no % 3 else [(no, s, e)]
    assert got == sorted(want, key=repr)


def test_text_runs(spark):
    df = spark.createDataFrame([("v", 0, 0.0, 1.5, "你 好"), ("v", 1, 1.0, 2.5, "你好"), ("v", 2, 30.0, 31.5, "你好")], SPAN + ", text string")
    for width in (1.0, 600.0):
        got = rows(ivs.text_runs(df, ["k"], [F.col("start_sec"), F.col("no")], slice_sec=width), "start_sec", "end_sec", "rows")
        assert got == [(0.0, 2.5, 2), (30.0, 31.5, 1)]


def test_page_coverage_and_tiling(spark):
    pages = spark.createDataFrame(
        [("v", "p0", 0.0, 10.0, 0.0, 13.0), ("v", "p1", 10.0, 20.0, 7.0, 20.0)],
        "k string, page_id string, core_start_sec double, core_end_sec double, read_start_sec double, read_end_sec double",
    )
    watched = spark.createDataFrame([("v", 0.0, 6.0), ("v", 6.0000005, 11.0), ("v", 12.0, 20.0)], "k string, start_sec double, end_sec double")
    assert rows(ivs.page_coverage(pages, watched, ["k"]), "page_id", "covered") == [("p0", True), ("p1", False)]
    videos = spark.createDataFrame([("v", 20.0)], "k string, duration_sec double")
    assert rows(ivs.tiling_violations(pages, videos, ["k"])) == []
    longer = spark.createDataFrame([("v", 25.0)], "k string, duration_sec double")
    assert rows(ivs.tiling_violations(pages, longer, ["k"]), "reason") == [("incomplete",)]


def test_replace_core(spark):
    schema = "k string, kind string, start_sec double, end_sec double"
    now = spark.createDataFrame([("v", "positive", 0.0, 6.0), ("v", "negative", 6.0, 30.0), ("v", "positive", 12.0, 16.0)], schema)
    new = spark.createDataFrame([("v", "positive", 14.0, 22.0), ("v", "negative", 8.0, 14.0), ("v", "positive", 2.0, 5.0)], schema)
    core = spark.createDataFrame([("v", 10.0, 20.0)], "k string, core_start double, core_end double")
    got = rows(ivs.replace_core(now, core, new, ["k"]), "kind", "start_sec", "end_sec")
    assert got == [("negative", 10.0, 14.0), ("negative", 22.0, 30.0), ("negative", 6.0, 10.0), ("positive", 0.0, 6.0), ("positive", 14.0, 22.0)]


def test_cores_are_replaced_before_the_overlay(spark):
    """Labels meet their cores once, not again for each overlay that reads them."""
    schema = "k string, kind string, start_sec double, end_sec double"
    now = spark.createDataFrame(
        [("v", "negative", 5.0, 25.0), ("v", "uncertain", 10.0, 20.0), ("v", "positive", 14.0, 15.0), ("v", "positive", 6.0, 5.0), ("v", "negative", 5.0, 5.0), ("w", "negative", 12.0, 14.0), ("w", "negative", 12.0, 14.0), (None, "positive", 12.0, 14.0), ("v", None, 0.0, 1.0)], schema,
    )
    new = spark.createDataFrame([("v", "uncertain", 8.0, 12.0), ("v", "negative", 11.0, 13.0), ("v", "positive", None, 13.0), ("w", "positive", 12.0, 14.0)], schema)
    core = spark.createDataFrame([("v", 10.0, 20.0), (None, 10.0, 20.0)], "k string, core_start double, core_end double")
    out = ivs.replace_core(now, core, new, ["k"])
    assert rows(out) == sorted([
        ("v", "negative", 5.0, 10.0), ("v", "negative", 20.0, 25.0), ("v", "negative", 12.0, 13.0), ("v", "uncertain", 10.0, 12.0), ("v", "positive", 6.0, 5.0),
        ("w", "negative", 12.0, 14.0), ("w", "negative", 12.0, 14.0), (None, "positive", 12.0, 14.0),
    ], key=repr)
    assert "core_start" not in out._jdf.queryExecution().optimizedPlan().toString()
