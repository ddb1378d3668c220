"""Ordered, per-key computations that never put one whole key into one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task, so a key that
holds a third of the table decides the run time. Here the key is cut into slices that follow the
order (``floor(t / width)``, a hash prefix, a step block): rows meet only inside their slice, and
what a slice must know about earlier slices travels in one small row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def time_slice(value, width: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(float(width))).cast("bigint")


def hash_slice(hex_digest, digits: int = 2) -> Column:
    """Slice of a hex digest by its leading digits (16**digits evenly filled slices)."""
    digest = F.col(hex_digest) if isinstance(hex_digest, str) else hex_digest
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def sliced_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums, maxima and last non-null values per key in ``order``.

    ``totals`` are whole-key sums, repeated on every row. ``inclusive=False`` leaves the current
    row out of every running value.
    """
    sums, maxes, lasts, totals = dict(sums or {}), dict(maxes or {}), dict(lasts or {}), dict(totals or {})
    keys = list(keys)
    names = [*sums, *maxes, *lasts]
    inputs = {**sums, **maxes, **lasts}
    work = df.withColumns({"_slice": slice_by, **{f"_in_{n}": inputs[n] for n in names}})
    rank = F.struct(*order)
    summary = [F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums]
    summary += [F.max(f"_in_{n}").alias(f"_in_{n}") for n in maxes]
    summary += [
        F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), rank)).alias(f"_in_{n}") for n in lasts
    ]
    summary += [F.sum(totals[n]).alias(f"_tot_{n}") for n in totals]
    slices = work.groupBy(*keys, "_slice").agg(*summary)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_in_{n}": F.sum(f"_in_{n}").over(before) for n in sums}
    carried |= {f"_in_{n}": F.max(f"_in_{n}").over(before) for n in maxes}
    carried |= {f"_in_{n}": F.last(f"_in_{n}", ignorenulls=True).over(before) for n in lasts}
    carried |= {n: F.sum(f"_tot_{n}").over(whole) for n in totals}
    carry = slices.select(
        *keys, "_slice", *[c.alias(n) for n, c in carried.items()], F.lit(True).alias("_carry")
    )
    rows = work.withColumn("_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    in_slice = Window.partitionBy(*keys, "_slice")
    ordered = in_slice.orderBy(F.col("_carry").desc(), *order)
    running = ordered.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = {n: F.sum(f"_in_{n}").over(running) for n in sums}
    out |= {n: F.max(f"_in_{n}").over(running) for n in maxes}
    out |= {n: F.last(f"_in_{n}", ignorenulls=True).over(running) for n in lasts}
    out |= {n: F.max(n).over(in_slice) for n in totals}
    return (
        rows.withColumns(out)
        .filter(~F.col("_carry"))
        .select(*[c for c in df.columns if c not in out], *out)
    )


def sliced_lag(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column,
    values: Mapping[str, Column],
    *,
    forward: bool = False,
) -> DataFrame:
    """Values of the previous (``forward``: next) row of the key.

    Inside a slice this is a plain lag. Only the first and last row of each slice are looked at
    across slices, in a second pass that sees at most two rows per slice.
    """
    keys = list(keys)
    step = F.lead if forward else F.lag
    work = df.withColumns({"_slice": slice_by, **{f"_v_{n}": c for n, c in values.items()}})
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    work = work.withColumns(
        {
            "_head": F.lag(F.lit(1)).over(in_slice).isNull(),
            "_tail": F.lead(F.lit(1)).over(in_slice).isNull(),
            **{f"_l_{n}": step(f"_v_{n}").over(in_slice) for n in values},
        }
    ).withColumn("_stream", F.when(~(F.col("_head") | F.col("_tail")), F.col("_slice")))
    stream = Window.partitionBy(*keys, "_stream").orderBy(*order)
    edge = F.col("_tail") if forward else F.col("_head")
    out = {
        n: F.when(edge, step(f"_v_{n}").over(stream)).otherwise(F.col(f"_l_{n}")) for n in values
    }
    return work.withColumns(out).select(*[c for c in df.columns if c not in out], *out)


def sliced_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_by: Column, name: str, total: str | None = None
) -> DataFrame:
    """Exact 1-based row number per key (and, if asked, the row count of the key)."""
    return sliced_running(
        df,
        keys,
        order,
        slice_by,
        sums={name: F.lit(1).cast("bigint")},
        totals={total: F.lit(1).cast("bigint")} if total else None,
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Exact 1-based row number over the whole table.

    Rows are range-partitioned by the full order (which should end in a unique column, so that ties
    split as well), each part is numbered on its own and starts after the rows of the parts before.
    The offsets have one row per partition, hence the broadcast."""
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    ranked = placed.withColumn("_no", F.row_number().over(inside)).join(F.broadcast(offsets), "_part")
    return ranked.withColumn(name, F.col("_no") + F.col("_before")).drop("_part", "_no", "_before")


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, probability: float, name: str, width: float
) -> DataFrame:
    """Exact nearest-rank percentile per key: the value at rank ceil(p*n).

    Equal values are counted before the shuffle; the bucket that holds the rank is found from
    one count per bucket, and only that bucket is sorted.
    """
    return order_statistics(df, keys, value, {name: lambda n: F.greatest(F.lit(1), F.ceil(F.lit(probability) * n))}, width)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping, width: float) -> DataFrame:
    """Exact values at given 1-based ranks per key; ``ranks`` maps a name to f(n) -> rank."""
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_slice", time_slice("_value", width))
    )
    per_slice = counts.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_m"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = per_slice.withColumns(
        {"_before": F.coalesce(F.sum("_m").over(before), F.lit(0)), "_total": F.sum("_m").over(whole)}
    )
    wanted = F.array(
        *[F.struct(F.lit(n).alias("name"), f(F.col("_total")).cast("bigint").alias("rank")) for n, f in ranks.items()]
    )
    slices = slices.withColumn(
        "_wanted",
        F.filter(wanted, lambda x: (x["rank"] > F.col("_before")) & (x["rank"] <= F.col("_before") + F.col("_m"))),
    ).filter(F.size("_wanted") > 0)
    null_safe = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_slice"]]
    cond = null_safe[0]
    for term in null_safe[1:]:
        cond = cond & term
    inside = Window.partitionBy(*keys, "_slice").orderBy("_value")
    hits = (
        counts.alias("c")
        .join(slices.alias("s"), cond)
        .select("c.*", "s._before", "s._wanted")
        .withColumn("_upto", F.sum("_n").over(inside) + F.col("_before"))
        .withColumn("_hit", F.explode("_wanted"))
        .filter((F.col("_hit.rank") <= F.col("_upto")) & (F.col("_hit.rank") > F.col("_upto") - F.col("_n")))
    )
    return hits.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_hit.name") == n, F.col("_value"))).alias(n) for n in ranks]
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str, width: float) -> DataFrame:
    """Exact median (mean of the two middle values) per key, without a single-task sort."""
    both = order_statistics(
        df,
        keys,
        value,
        {"_lo": lambda n: F.floor((n + 1) / 2), "_hi": lambda n: F.floor(n / 2) + 1},
        width,
    )
    return both.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(name))
