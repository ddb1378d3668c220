"""Stratified, group-fair sampling with a reproducible hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CATEGORIES
from .ordered import hash_slice, sliced_rank


def quotas(windows: DataFrame, size) -> DataFrame:
    """(category, n, quota): proportional shares, largest remainder, ties by name.

    ``size`` is a number or a column of the one-row-per-category table. Always three rows."""
    counts = windows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    spark = windows.sparkSession
    kinds = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    table = kinds.join(counts, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = Window.partitionBy()  # three rows
    size = size if not isinstance(size, int) else F.lit(size)
    total = F.sum("n").over(one)
    exact = size.cast("bigint") * F.col("n")
    table = table.withColumns({"_total": total}).withColumns(
        {"_floor": F.floor(exact / F.col("_total")).cast("bigint"), "_rest": F.pmod(exact, F.col("_total"))}
    )
    rank = F.row_number().over(one.orderBy(F.col("_rest").desc(), "category"))
    left = size.cast("bigint") - F.sum("_floor").over(one)
    return table.withColumn("quota", F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).select("category", "n", "quota")


def seeded_hash(column: str, seed: int):
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")), 256)


def round_robin(rows: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """Per category, ``wanted`` rows (category, take) drawn in rounds across the groups.

    Round r takes the r-th row of every group in hash order; groups of a round follow the hash of
    their name. Ranks are exact and sliced by hash prefix, so neither a big group nor one of the
    three categories is sorted in one task."""
    hashed = rows.withColumns({"_h": seeded_hash("sample_id", seed), "_g": seeded_hash("drama_id", seed)})
    rounds = sliced_rank(
        hashed, ["category", "drama_id"], [F.col("_h"), F.col("sample_id")], hash_slice("_h"), "round_no"
    )
    order = [F.col("round_no"), F.col("_g"), F.col("drama_id")]
    block = F.struct(F.col("round_no"), hash_slice("_g").alias("g"))
    placed = sliced_rank(rounds, ["category"], order, block, "draw_no")
    # three rows: one per category
    return (
        placed.join(F.broadcast(wanted.select("category", "take")), "category")
        .filter(F.col("draw_no") <= F.col("take"))
        .drop("_h", "_g", "take")
    )


def sampling_problems(windows: DataFrame, focus: DataFrame, quota_table: DataFrame, size: int) -> DataFrame:
    """Reasons why the sample may not be drawn: size, foreign focus rows, focus beyond a quota."""
    n = windows.agg(F.count(F.lit(1)).alias("n"))
    bad_size = n.filter((F.lit(size) <= 0) | (F.lit(size) > F.col("n"))).select(F.lit("invalid_size").alias("reason"))
    foreign = (
        focus.join(windows.select("sample_id"), "sample_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 0").select(F.lit("foreign_focus").alias("reason"))
    )
    held = windows.join(focus, "sample_id", "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("_f"))
    beyond = quota_table.join(held, "category").filter("_f > quota").select(
        F.concat(F.lit("focus_exceeds_quota:"), "category").alias("reason")
    )
    return bad_size.unionByName(foreign).unionByName(beyond)


class SampleRefused(ValueError):
    """The sample may not be drawn; ``reasons`` says why."""

    def __init__(self, reasons: Sequence[str]) -> None:
        super().__init__("; ".join(reasons))
        self.reasons = list(reasons)


def focus_stratified(windows: DataFrame, focus: DataFrame, size: int, seed: int) -> DataFrame:
    """All focus rows plus a round-robin fill of every category to its quota, with a shuffle key.

    ``focus``: distinct sample_id. Raises when the request is invalid (a few rows are looked at)."""
    table = quotas(windows, size)
    problems = [r.reason for r in sampling_problems(windows, focus, table, size).collect()]
    if problems:
        raise SampleRefused(sorted(problems))
    return draw_stratified(windows, focus, table, seed)


def draw_stratified(windows: DataFrame, focus: DataFrame, quota_table: DataFrame, seed: int) -> DataFrame:
    marked = windows.join(focus.select("sample_id", F.lit(True).alias("focus")), "sample_id", "left").withColumn(
        "focus", F.coalesce("focus", F.lit(False))
    )
    held = marked.groupBy("category").agg(F.count_if("focus").alias("_f"))
    wanted = quota_table.join(held, "category", "left").select(
        "category", (F.col("quota") - F.coalesce("_f", F.lit(0))).alias("take")
    )
    regular = round_robin(marked.filter(~F.col("focus")), wanted, seed).drop("round_no", "draw_no")
    chosen = marked.filter("focus").unionByName(regular)
    return chosen.withColumn("shuffle_key", seeded_hash("sample_id", seed + 1))


def default_size(n_train, n_focus):
    """min(train rows, twice the focus rows)."""
    return F.least(n_train, n_focus * 2)


def first_examples(details: DataFrame) -> DataFrame:
    """First hit, first failure and first boundary drift per group (by sample_id)."""
    shown = (
        F.when(F.col("error_class") == "hit", "hit")
        .when(F.col("error_class") == "boundary_drift", "drift")
        .when(F.col("error_class").isin("missed", "false", "missed_and_false", "parse_error"), "failure")
    )
    return (
        details.withColumn("example", shown).filter(F.col("example").isNotNull())
        .groupBy("drama_id", "example").agg(F.min("sample_id").alias("sample_id"))
    )
