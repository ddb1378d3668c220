"""Interval joins on an equi key plus a time bucket.

Spark has no native range join: an overlap predicate next to an equi key is a sort-merge join that
compares all pairs of the key. Both sides are therefore exploded to the time buckets they touch and
joined on (key, bucket); a pair is emitted only in the first bucket both share, so nothing has to be
de-duplicated.

Long spans. Buckets come in levels, each ``RATIO`` times as wide as the one below. A span has its home at the lowest level at
which it touches few buckets, and also goes to the one or two buckets it touches at each higher level that is the home of any span;
a pair meets at the higher of its two homes. So a row becomes a bounded number of rows however long its span is. Beyond the
last level, and for open spans (an infinite bound), there is one bucket for all time.

Hot buckets, whose pairs are too many for one task, are split by a two-dimensional salt: a left row goes to one row of the salt
grid, a right row to one column, and every pair meets in exactly one cell. One map-side combined count over a fixed number of
hashed cells tells which levels are in use and whether any bucket can be hot at all; only then are buckets counted one by
one, and the hot ones written as a small table that the planner can send out.

Spans with a null or NaN bound, or that end before they start, meet nothing; see :func:`unplaceable`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# most comparisons one task should make for one bucket
HOT_PAIRS = 100_000_000
# a span touches at most so many buckets (and one) of its home; each level is so many times as wide as the one below
RATIO = 32
# the last level with buckets: 60 s buckets reach two million years there; the level above it has one bucket
LAST = 8
# hashed cells of the first count
CELLS = 1 << 16
PLACE = ("_level", "_bucket", "_meets")
Span = tuple[str, str]


def _placeable(start: Column, end: Column) -> Column:
    known = start.isNotNull() & end.isNotNull() & ~F.isnan(start.cast("double")) & ~F.isnan(end.cast("double"))
    return F.coalesce(known & (start <= end), F.lit(False))


def unplaceable(df: DataFrame, span: Span) -> DataFrame:
    """Rows whose span no join here places: bounds that are null, not a number or reversed."""
    return df.filter(~_placeable(F.col(span[0]), F.col(span[1])))


def _home(span: Span, bucket_sec: float) -> Column:
    """The lowest level at which a span touches few buckets; null for spans that cannot be placed."""
    start, end = (F.col(c).cast("double") for c in span)
    level = F.lit(LAST + 1)
    for n in range(LAST, -1, -1):
        width = bucket_sec * RATIO**n
        # far from zero the numbers of buckets would not be exact
        small = (F.abs(start) < width * 2.0**52) & (F.abs(end) < width * 2.0**52)
        level = F.when(small & (end - start <= RATIO * width), n).otherwise(level)
    return F.when(_placeable(F.col(span[0]), F.col(span[1])), level)


def _buckets(span: Span, bucket_sec: float, level: int) -> tuple[Column, Column]:
    """First and last bucket of a span at a level."""
    if level > LAST:
        return F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    return tuple(F.floor(F.col(c) / (bucket_sec * RATIO**level)).cast("bigint") for c in span)


# which pairs meet at a level: both at home (0), a left span at home and a right guest (1), a left guest and a right span at
# home (2); guests never meet guests, whose pairs meet below
HOME, GUEST = {"l": (0, 1), "r": (0, 2)}, {"l": 2, "r": 1}


def _place(level: int, meets: int, first: Column, tag: str) -> Callable[[Column], Column]:
    return lambda bucket: F.struct(
        F.lit(level).alias("_level"), bucket.alias("_bucket"), F.lit(meets).alias("_meets"), (bucket == first).alias(f"_{tag}first")
    )


def _bucketed(df: DataFrame, span: Span, bucket_sec: float, tag: str, levels: Sequence[int], own_only: bool = False) -> DataFrame:
    """Rows by bucket: ``_level``, ``_bucket``, ``_meets`` and whether it is the first bucket of the span (``_{tag}first``)."""
    home = _home(span, bucket_sec)
    if len(levels) == 1:
        first, last = _buckets(span, bucket_sec, levels[0])
        placed = df.withColumn("_bucket", F.explode(F.when(home == levels[0], F.sequence(first, last))))
        return placed.withColumns({"_level": F.lit(levels[0]), "_meets": F.lit(0), f"_{tag}first": F.col("_bucket") == first})
    lists = []
    for n in levels:
        first, last = _buckets(span, bucket_sec, n)
        roles = [(home == n, 0)]
        if not own_only and n > levels[0]:
            roles = [*[(home == n, m) for m in HOME[tag]], (home < n, GUEST[tag])]
        for fits, meets in roles if not own_only or tag == "l" else [(home <= n, 0)]:
            # the guard is part of the expression, so that no plan expands a bad span before it is filtered
            lists.append(F.when(fits, F.transform(F.sequence(first, last), _place(n, meets, first, tag))))
    places = lists[0] if len(lists) == 1 else F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))
    return df.withColumn("_at", F.explode(places)).select(*df.columns, "_at.*")


def _levels_in_use(left: DataFrame, right: DataFrame, keys: list[str], left_span: Span, right_span: Span, bucket_sec: float, inner_start: bool) -> tuple[list[int], int]:
    """Home levels of any span, and an upper bound of the pairs that meet in one bucket.

    Buckets are counted by their hash, as many of one hash as of all buckets that share it."""

    def counted(df: DataFrame, span: Span, tag: str) -> DataFrame:
        home = _home(span, bucket_sec)
        first, last = _buckets(span, bucket_sec, 0)
        # at its home a span is counted at its own buckets; spans of higher homes are rare, they are counted exactly later
        at = F.explode(F.when(home == 0, F.sequence(first, last)).when(home > 0, F.array(F.lit(-1).cast("bigint"))))
        cell = F.pmod(F.xxhash64(*keys, "_b"), F.lit(CELLS)).alias("_cell")
        sides = [F.lit(int(tag == side)).cast("bigint").alias(f"_{side}") for side in ("l", "r")]
        return df.select(*keys, home.alias("_home"), at.alias("_b")).select(cell, "_home", *sides)

    both = counted(left, left_span, "l").unionByName(counted(right, (right_span[0], right_span[0]) if inner_start else right_span, "r"))
    cells = both.groupBy("_cell").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"), F.bit_or(F.expr("shiftleft(1, _home)")).alias("_homes"))
    row = cells.agg(F.max(F.col("_l").cast("double") * F.col("_r")).alias("pairs"), F.bit_or("_homes").alias("homes")).first()
    return [n for n in range(LAST + 2) if (row["homes"] or 1) >> n & 1], row["pairs"] or 0


def _grid(left: DataFrame, right: DataFrame, keys: list[str], hot_pairs: int) -> DataFrame:
    """(key, level, bucket) cells that need salting, with the number of left and right salts."""
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    by = [*keys, *PLACE]
    counted = left.select(*by, one.alias("_l"), zero.alias("_r")).unionByName(right.select(*by, zero.alias("_l"), one.alias("_r")))
    share = F.col("_l").cast("double") * F.col("_r") / hot_pairs
    # a square grid, but never more salts on a side than it has rows
    left_salts = F.least(F.ceil(F.sqrt(share)), F.col("_l"))
    grid = (
        counted.groupBy(*by)
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
        .filter(share > 1)
        .withColumn("_gl", left_salts.cast("int"))
        .select(*by, "_gl", F.least(F.ceil(share / F.col("_gl")), F.col("_r")).cast("int").alias("_gr"))
    )
    return materialize(grid, "hot_buckets")


def _salted(df: DataFrame, grid: DataFrame, keys: list[str], own: str, other: str, cols: list[str]) -> DataFrame:
    """Attach (_sl, _sr): the own salt from a row hash, the other side's salts by replication."""
    joined = df.join(grid, [*keys, *PLACE], "left")
    mine = F.pmod(F.xxhash64(*cols), F.coalesce(F.col(f"_g{own}"), F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"_g{other}"), F.lit(1)) - 1))
    return joined.withColumn(f"_s{own}", mine).withColumn(f"_s{other}", every).drop("_gl", "_gr")


def _meet(left: DataFrame, right: DataFrame, keys: list[str], left_span: Span, right_span: Span, bucket_sec: float, hot_pairs: int, inner_start: bool) -> DataFrame:
    """Rows of both sides that share a bucket, each pair once if its spans overlap."""
    levels, pairs = _levels_in_use(left, right, keys, left_span, right_span, bucket_sec, inner_start)
    if inner_start:  # the inner span is looked for where it starts, the outer one at its home
        point = (right_span[0], right_span[0])
        lb, rb = _bucketed(left, left_span, bucket_sec, "l", levels, own_only=True), _bucketed(right, point, bucket_sec, "r", levels, own_only=True)
    else:
        lb, rb = _bucketed(left, left_span, bucket_sec, "l", levels), _bucketed(right, right_span, bucket_sec, "r", levels)
    on = [*keys, *(PLACE if len(levels) > 1 else ["_bucket"])]
    if hot_pairs is not None and (pairs > hot_pairs or len(levels) > 1):
        grid = _grid(lb, rb, keys, hot_pairs)
        lb = _salted(lb, grid, keys, "l", "r", left.columns)
        rb = _salted(rb, grid, keys, "r", "l", right.columns)
        on = [*keys, *PLACE, "_sl", "_sr"]
    joined = lb.join(rb, on)
    return joined if inner_start else joined.filter(F.col("_lfirst") | F.col("_rfirst"))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_span: Span = ("start_sec", "end_sec"),
    right_span: Span = ("r_start_sec", "r_end_sec"),
    bucket_sec: float = 60.0,
    residual: Column | None = None,
    touching: bool = False,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """Inner join of spans with positive overlap (``touching``: or a shared end point).

    Column names of the two sides must differ except for ``keys``. Both sides are read twice: once for the count.
    """
    keys = list(keys)
    joined = _meet(left, right, keys, left_span, right_span, bucket_sec, hot_pairs, False)
    ls, le, rs, re = (F.col(c) for c in (*left_span, *right_span))
    cond = (ls <= re) & (rs <= le) if touching else (ls < re) & (rs < le)
    if residual is not None:
        cond = cond & residual
    return joined.filter(cond).select(*left.columns, *[c for c in right.columns if c not in keys])


def overlap_semi(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ids: Sequence[str], *, anti: bool = False, **options
) -> DataFrame:
    """Left rows (identified by ``ids``) that meet, or with ``anti`` do not meet, any right span."""
    slim = left.select(*dict.fromkeys([*keys, *ids, *options.get("left_span", ("start_sec", "end_sec"))]))
    hits = overlap_join(slim, right, keys, **options).select(*ids).distinct()
    return left.join(hits, list(ids), "left_anti" if anti else "left_semi")


def contained_join(
    outer: DataFrame,
    inner: DataFrame,
    keys: Sequence[str],
    *,
    outer_span: Span,
    inner_span: Span,
    bucket_sec: float = 60.0,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """Pairs whose inner span lies inside the outer span. The inner side needs one bucket of each level only:
    the one of its start, which the outer span must touch."""
    keys = list(keys)
    inner = inner.filter(_placeable(F.col(inner_span[0]), F.col(inner_span[1])))
    joined = _meet(outer, inner, keys, outer_span, inner_span, bucket_sec, hot_pairs, True)
    cond = (F.col(outer_span[0]) <= F.col(inner_span[0])) & (F.col(inner_span[1]) <= F.col(outer_span[1]))
    return joined.filter(cond).select(*outer.columns, *[c for c in inner.columns if c not in keys])


def candidate_edges(
    predictions: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    similarity: Callable[[], Column],
    threshold: float,
    *,
    prediction_span: Span = ("p_start", "p_end"),
    target_span: Span = ("t_start", "t_end"),
    bucket_sec: float = 60.0,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """Prediction-target pairs with similarity at or above the threshold and above zero.

    ``target_span`` is where the bucketing looks for partners: pass the hull of a target, its
    alternatives and its evidence when the similarity looks at those too.
    """
    pairs = overlap_join(
        predictions,
        targets,
        keys,
        left_span=prediction_span,
        right_span=target_span,
        bucket_sec=bucket_sec,
        hot_pairs=hot_pairs,
    )
    return pairs.withColumn("similarity", similarity()).filter(
        (F.col("similarity") >= threshold) & (F.col("similarity") > 0)
    )
