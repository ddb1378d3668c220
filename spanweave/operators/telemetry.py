"""Run logs: metric merging, stagnation, facts, progress, attempts, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import is_finite
from .intervalsets import page_coverage
from .ordered import sliced_lag, sliced_running, time_slice

STEP_BLOCK = 10_000


def merge_metrics(log: DataFrame) -> DataFrame:
    """Newest value per (run, step, key): a later training row replaces its whole step, an
    evaluation row merges into it. ``log``: run, pos, step, training, key, value."""
    newest = (
        log.filter("training").groupBy("run", "step").agg(F.max("pos").alias("_since"))
    )
    alive = log.join(newest, ["run", "step"], "left").filter(F.col("_since").isNull() | (F.col("pos") >= F.col("_since")))
    return alive.groupBy("run", "step", "key").agg(F.max_by("value", "pos").alias("value"))


def step_speed(training: DataFrame, train_samples: float) -> DataFrame:
    """Seconds per update and windows per second against the previous training row in file order,
    only when the step grew by one and both differences are positive.

    ``training``: run, pos, step, elapsed_sec, epoch."""
    values = {"_step": F.col("step"), "_elapsed": F.col("elapsed_sec"), "_epoch": F.col("epoch")}
    chained = sliced_lag(training, ["run"], [F.col("pos")], time_slice("pos", STEP_BLOCK), values)
    seconds = F.col("elapsed_sec") - F.col("_elapsed")
    windows = (F.col("epoch") - F.col("_epoch")) * F.lit(float(train_samples))
    ok = (F.col("step") == F.col("_step") + 1) & (seconds > 0) & (windows > 0)
    return chained.withColumns(
        {
            "seconds_per_update": F.when(ok, seconds),
            "windows_per_second": F.when(ok, F.try_divide(windows, seconds)),
        }
    ).drop("_step", "_elapsed", "_epoch")


def training_speed(log: DataFrame, train_samples: float) -> DataFrame:
    """Speed rows (run, pos, step, training, key, value) to append before ``merge_metrics``."""
    wide = log.filter("training").groupBy("run", "pos", "step").agg(
        F.max(F.when(F.col("key") == "elapsed_sec", F.col("value"))).alias("elapsed_sec"),
        F.max(F.when(F.col("key") == "epoch", F.col("value"))).alias("epoch"),
    )
    speed = step_speed(wide, train_samples)
    pairs = F.array(
        *[F.struct(F.lit(f"speed/{c}").alias("key"), F.col(c).alias("value")) for c in ("seconds_per_update", "windows_per_second")]
    )
    return (
        speed.select("run", "pos", "step", F.lit(True).alias("training"), F.explode(pairs).alias("_p"))
        .select("run", "pos", "step", "training", "_p.key", "_p.value")
        .filter("value IS NOT NULL")
    )


#: fixed values: families of metrics that are always let through
PREFIXES = ("validation/", "sampling/", "effect/")


def is_allowed(names: Sequence[str], prefixes: Sequence[str] = PREFIXES) -> Column:
    """Rows (key, value) with a listed name or prefix and a finite value."""
    wanted = F.col("key").isin(*names)
    for prefix in prefixes:
        wanted = wanted | F.startswith(F.col("key"), F.lit(prefix))
    return wanted & is_finite("value")


def allowed_metrics(log: DataFrame, names: Sequence[str], prefixes: Sequence[str] = PREFIXES) -> DataFrame:
    """Finite allow-listed values, later files and positions win per (run, step, key).

    ``log``: run, file, pos, step, key, value."""
    return (
        log.filter(is_allowed(names, prefixes))
        .groupBy("run", "step", "key")
        .agg(F.max_by("value", F.struct("file", "pos")).alias("value"))
    )


def changed_steps(values: DataFrame, sent: DataFrame) -> DataFrame:
    """Steps whose values differ from those last sent. Both: run, step, key, value."""
    def digest(df, name):
        entry = F.struct("key", "value")
        return df.groupBy("run", "step").agg(
            F.bit_xor(F.xxhash64(entry)).alias(f"{name}_x"), F.count(F.lit(1)).alias(f"{name}_n"),
            F.sum(F.xxhash64(F.lit(7), entry) % 1_000_003).alias(f"{name}_s"),
        )

    both = digest(values, "_a").join(digest(sent, "_b"), ["run", "step"], "left")
    same = F.lit(True)
    for part in ("x", "n", "s"):
        same = same & F.col(f"_a_{part}").eqNullSafe(F.col(f"_b_{part}"))
    return values.join(both.filter(~same).select("run", "step"), ["run", "step"], "left_semi")


def stagnation(steps: DataFrame, facts: DataFrame) -> DataFrame:
    """Per step: facts seen for the first time and the count of steps since the last new one.

    ``steps``: run, step. ``facts``: run, step, fact. A fact that comes and goes counts once."""
    first = facts.groupBy("run", "fact").agg(F.min("step").alias("step"))
    fresh = first.groupBy("run", "step").agg(F.count(F.lit(1)).alias("new_facts"))
    joined = steps.join(fresh, ["run", "step"], "left").withColumn("new_facts", F.coalesce("new_facts", F.lit(0)))
    order, block = [F.col("step")], time_slice("step", STEP_BLOCK)
    counted = sliced_running(joined, ["run"], order, block, sums={"_no": F.lit(1).cast("bigint")})
    reset = sliced_running(
        counted, ["run"], order, block, lasts={"_reset": F.when(F.col("new_facts") > 0, F.col("_no"))}
    )
    return reset.withColumn("stagnant_steps", F.col("_no") - F.coalesce("_reset", F.lit(0))).drop("_no", "_reset")


def scan_progress(pages: DataFrame, watched: DataFrame, videos: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Completed pages and seconds, coverage, the next page per video."""
    keys = list(keys)
    marked = page_coverage(pages, watched, keys)
    length = F.col("core_end_sec") - F.col("core_start_sec")
    per = marked.groupBy(*keys).agg(
        F.count_if("covered").alias("completed_page_count"),
        F.count(F.lit(1)).alias("page_count"),
        F.sum(F.when(F.col("covered"), length).otherwise(0.0)).alias("_done"),
        F.min_by("page_id", F.when(~F.col("covered"), F.struct("core_start_sec", "page_id"))).alias("next_page"),
    )
    return per.join(videos.select(*keys, "duration_sec"), keys).withColumn(
        "scan_coverage", F.try_divide(F.col("_done"), F.col("duration_sec"))
    ).drop("_done")


def attempt_status(items: DataFrame, attempts: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status per item: the last attempt's, overridden by a result's completion unless that attempt
    failed or still runs; ``not_started`` without attempts."""
    keys = list(keys)
    last = attempts.groupBy(*keys).agg(F.max_by("status", "attempt_no").alias("_s"), F.count(F.lit(1)).alias("attempts"))
    base = F.coalesce("_s", F.lit("not_started"))
    status = F.when(F.col("completion").isNotNull() & ~base.isin("failed", "running"), F.col("completion")).otherwise(base)
    return (
        items.join(last, keys, "left").join(results.select(*keys, "completion"), keys, "left")
        .select(*keys, status.alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"))
    )


def budget_prefix(rows: DataFrame, keys: Sequence[str], order: str, size: str, budget: float, *, block: float = STEP_BLOCK) -> DataFrame:
    """``running`` size of ordered materials, ``fits`` for the greedy prefix within the budget, and
    ``overflow`` for a first row that alone is too big (the request is to be refused)."""
    running = sliced_running(
        rows, list(keys), [F.col(order)], time_slice(order, block),
        sums={"running": F.col(size).cast("bigint"), "_no": F.lit(1).cast("bigint")},
    )
    fits = F.col("running") <= budget
    return running.withColumns({"fits": fits, "overflow": ~fits & (F.col("_no") == 1)}).drop("_no")


def trace_counts(trace: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per job: request errors, invalid and missing calls, timed requests and seconds."""
    request = F.col("kind").isin("model", "clip_review", "perception_model") & F.col("elapsed_sec").isNotNull()
    return trace.groupBy(*keys).agg(
        F.count(F.when(F.col("kind") == "request_error", 1)).alias("request_errors"),
        F.count(F.when((F.col("kind") == "tool") & F.col("error"), 1)).alias("invalid_tool_requests"),
        F.count(F.when((F.col("kind") == "model") & F.col("calls_empty"), 1)).alias("missing_tool_calls"),
        F.count(F.when(request, 1)).alias("requests"),
        F.sum(F.when(request, F.col("elapsed_sec"))).alias("request_sec"),
    )


def facts(*parts: DataFrame) -> DataFrame:
    """Distinct facts per job from their sources (each: job, fact)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
