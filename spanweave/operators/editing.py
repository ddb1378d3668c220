"""Highlight edits as table operations.

Bulk edits take a command table (job_id, command_no, ...) and a highlight table. Each command is
all or nothing: one bad target rejects it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import clip_edit_error
from ..functions.scalars import truncate
from ..session import materialize
from .ordered import global_rank, sliced_rank, sliced_running, time_slice

TITLE_LENGTH = 120
REASON_LENGTH = 300
# Suffixes of split titles and the separators of merged texts.
FIRST_PART, SECOND_PART = "（上）", "（下）"
TITLE_SEPARATOR, REASON_SEPARATOR = " / ", "；"
CHILD_SUFFIX = "_split"


def edit_ranges(highlights: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edited, rejected commands) of move_start, move_end and set_range commands.

    ``commands``: job_id, command_no, operation, highlight_id, delta_sec, start_sec, end_sec (one
    row per target). ``highlights``: job_id, highlight_id, start_sec, end_sec, duration_sec."""
    h = highlights.select(
        "job_id", "highlight_id", F.col("start_sec").alias("_s"), F.col("end_sec").alias("_e"), "duration_sec"
    )
    joined = commands.join(h, ["job_id", "highlight_id"], "left")
    delta = F.coalesce("delta_sec", F.lit(0.0))
    start = (
        F.when(F.col("operation") == "move_start", F.greatest(F.lit(0.0), F.col("_s") + delta))
        .when(F.col("operation") == "set_range", F.coalesce("start_sec", "_s"))
        .otherwise(F.col("_s"))
    )
    end = (
        F.when(F.col("operation") == "move_end", F.least("duration_sec", F.col("_e") + delta))
        .when(F.col("operation") == "set_range", F.coalesce("end_sec", "_e"))
        .otherwise(F.col("_e"))
    )
    moved = joined.withColumns({"new_start": start, "new_end": end}).withColumn(
        "error",
        F.when(F.col("_s").isNull(), F.lit("unknown_highlight")).otherwise(clip_edit_error("new_start", "new_end", "duration_sec")),
    )
    rejected = (
        moved.filter(F.col("error").isNotNull()).groupBy("job_id", "command_no").agg(F.min("error").alias("error"))
    )
    edited = (
        moved.join(rejected.select("job_id", "command_no"), ["job_id", "command_no"], "left_anti")
        .select(
            "job_id", "command_no", "highlight_id",
            F.round("new_start", 3).alias("start_sec"), F.round("new_end", 3).alias("end_sec"),
            F.lit("revised").alias("review_status"),
        )
    )
    return edited, rejected


def delete_highlights(highlights: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept highlights, unknown targets); nothing is removed in jobs with an unknown target."""
    key = ["job_id", "highlight_id"]
    unknown = targets.join(highlights.select(*key), key, "left_anti")
    allowed = targets.join(unknown.select("job_id").distinct(), "job_id", "left_anti")
    return highlights.join(allowed.select(*key).distinct(), key, "left_anti"), unknown


def set_text(highlights: DataFrame, commands: DataFrame, column: str, length: int) -> DataFrame:
    """Replace a text column, trimmed and truncated. ``commands``: job_id, highlight_id, text."""
    new = commands.select("job_id", "highlight_id", truncate("text", length).alias("_t"))
    joined = highlights.join(new, ["job_id", "highlight_id"], "left")
    return joined.withColumns(
        {
            column: F.coalesce("_t", column),
            "review_status": F.when(F.col("_t").isNotNull(), F.lit("revised")).otherwise(F.col("review_status")),
        }
    ).drop("_t")


def rename(highlights: DataFrame, commands: DataFrame) -> DataFrame:
    return set_text(highlights, commands, "description", TITLE_LENGTH)


def set_reason(highlights: DataFrame, commands: DataFrame) -> DataFrame:
    return set_text(highlights, commands, "reason", REASON_LENGTH)


def _suffixed(text, suffix: str) -> Column:
    return F.concat(F.left(F.col(text), F.lit(TITLE_LENGTH - len(suffix))), F.lit(suffix))


def _free_numbers(highlights: DataFrame, parents: DataFrame) -> DataFrame:
    """``parents`` (job_id, parent_id, _base) with ``_free``: of the numbers that no id of the family has, the one at the place of the parent.

    The r-th free number is r more than the used numbers before it, which are those with fewer than r free ones below them;
    a used number u at place i has u - i below it. So one running count per family finds all, in slices.

    Used numbers and both kinds of rows are written before they are counted: a count reads its rows twice, and as all follow the
    family, the planner would put every join and sort before it into the same task again for each."""
    family, block = ["job_id", "_base"], 10_000.0
    placed = materialize(global_rank(parents, [F.col("job_id"), F.col("_base"), F.col("parent_id")], "_place"), "parents")
    first = placed.groupBy(*family).agg(F.min("_place").alias("_from"))
    turns = placed.join(first, family).select("job_id", "_base", "parent_id", (F.col("_place") - F.col("_from") + 1).alias("_at"))
    number = F.when(F.col("_id") == F.col("_base"), F.lit(1)).otherwise(F.expr("try_cast(substring(_id, length(_base) + 2) AS int)"))
    ids = highlights.select("job_id", F.col("highlight_id").alias("_id"), F.left(F.regexp_extract("highlight_id", r"^(.*_split)(?:_\d+)?$", 1), F.lit(74)).alias("_base"))
    used = ids.join(first.select(*family), family, "left_semi").select(*family, number.cast("bigint").alias("_n")).filter("_n > 0").distinct()
    used = materialize(used, "used_numbers")
    ranked = sliced_rank(used, family, [F.col("_n")], time_slice("_n", block), "_i")
    below = ranked.select(*family, F.lit(None).cast("string").alias("parent_id"), (F.col("_n") - F.col("_i") + 1).alias("_at"), F.lit(1).cast("bigint").alias("_one"))
    both = materialize(turns.withColumn("_one", F.lit(0).cast("bigint")).unionByName(below), "family_numbers")
    counted = sliced_running(both, family, [F.col("_at"), F.col("_one").desc()], time_slice("_at", block), sums={"_before": F.col("_one")})
    return counted.filter("parent_id IS NOT NULL").select(*family, "parent_id", (F.col("_at") + F.col("_before")).alias("_free"))


def split_highlights(highlights: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(highlights after splits, rejected commands). ``commands``: job_id, highlight_id, split_sec,
    one per highlight. The new children of a family (one base id) take its free ids in order of their parents."""
    key = ["job_id", "highlight_id"]
    both = highlights.join(commands, key, "left")
    bad = F.coalesce(
        clip_edit_error("start_sec", "split_sec", "duration_sec"), clip_edit_error("split_sec", "end_sec", "duration_sec")
    )
    both = both.withColumn("error", F.when(F.col("split_sec").isNotNull(), bad))
    rejected = both.filter(F.col("error").isNotNull()).select(*key, F.lit("invalid_split").alias("error"))
    both = both.withColumn("_go", F.col("split_sec").isNotNull() & F.col("error").isNull())
    # ids already used in the family of a split parent: base, base_2, base_3, ...
    base = F.concat(F.left("highlight_id", F.lit(68)), F.lit(CHILD_SUFFIX))
    parents = both.filter("_go").select("job_id", F.col("highlight_id").alias("parent_id"), base.alias("_base"))
    free = _free_numbers(highlights, parents)
    ids = free.select(
        "job_id", F.col("parent_id").alias("highlight_id"),
        F.when(F.col("_free") == 1, F.col("_base")).otherwise(F.concat_ws("_", F.left("_base", F.lit(74)), F.col("_free").cast("string"))).alias("_child"),
    )
    both = both.join(ids, key, "left")
    cut = F.round("split_sec", 3)

    def row(id_, start, end, title, status):
        return F.struct(id_.alias("i"), start.alias("s"), end.alias("e"), title.alias("d"), status.alias("r"))

    same = row(*[F.col(c) for c in ("highlight_id", "start_sec", "end_sec", "description", "review_status")])
    halves = F.array(
        row(F.col("highlight_id"), F.col("start_sec"), cut, _suffixed("description", FIRST_PART), F.lit("revised")),
        row(F.col("_child"), cut, F.col("end_sec"), _suffixed("description", SECOND_PART), F.lit("revised")),
    )
    out = (
        both.withColumn("_x", F.explode(F.when(F.col("_go"), halves).otherwise(F.array(same))))
        .withColumns(
            {"highlight_id": F.col("_x.i"), "start_sec": F.col("_x.s"), "end_sec": F.col("_x.e"),
             "description": F.col("_x.d"), "review_status": F.col("_x.r")}
        )
        .select(*highlights.columns)
    )
    return out, rejected


def timeline_positions(highlights: DataFrame, *, slice_sec: float = 600.0) -> DataFrame:
    """Highlights with their position on the job's timeline (start, end, id)."""
    order = [F.col("start_sec"), F.col("end_sec"), F.col("highlight_id")]
    return sliced_rank(highlights, ["job_id"], order, time_slice("start_sec", slice_sec), "position")


def merge_adjacency(highlights: DataFrame, targets: DataFrame, *, slice_sec: float = 600.0) -> DataFrame:
    """Per merge command whether its targets are timeline neighbours. ``targets``: job_id,
    command_no, highlight_id."""
    placed = timeline_positions(highlights, slice_sec=slice_sec)
    joined = targets.join(placed.select("job_id", "highlight_id", "position"), ["job_id", "highlight_id"])
    return joined.groupBy("job_id", "command_no").agg(
        F.count(F.lit(1)).alias("targets"),
        (F.max("position") - F.min("position") + 1 == F.count(F.lit(1))).alias("adjacent"),
    )


def merge_highlights(highlights: DataFrame, targets: DataFrame, *, slice_sec: float = 600.0) -> DataFrame:
    """One merged row per valid command: hull, best score with its type, distinct joined texts.

    Texts are reduced to their first occurrences, and of these the first few that can reach into the kept length are
    listed: of distinct texts one at most is empty."""
    key, command = ["job_id", "highlight_id"], ["job_id", "command_no"]
    valid = merge_adjacency(highlights, targets, slice_sec=slice_sec).filter("adjacent").select(*command)
    rows = targets.join(valid, command, "left_semi").join(highlights, key)
    order = F.struct("start_sec", "end_sec", "highlight_id")
    # the first of the best-scored rows in time order
    best = F.struct((-F.col("score")).alias("ns"), "start_sec", "end_sec", "highlight_id")
    merged = rows.groupBy(*command).agg(
        F.min_by("highlight_id", order).alias("highlight_id"),
        F.round(F.min("start_sec"), 3).alias("start_sec"),
        F.round(F.max("end_sec"), 3).alias("end_sec"),
        F.max("score").alias("score"),
        F.min_by("highlight_type", best).alias("highlight_type"),
        F.max("duration_sec").alias("duration_sec"),
    )
    merged = merged.filter(clip_edit_error("start_sec", "end_sec", "duration_sec").isNull())
    for column, separator, length in (("description", TITLE_SEPARATOR, TITLE_LENGTH), ("reason", REASON_SEPARATOR, REASON_LENGTH)):
        first = rows.groupBy(*command, column).agg(F.min(order).alias("_o"))
        # the planner keeps so many per task before it shuffles
        first = first.withColumn("_r", F.row_number().over(Window.partitionBy(*command).orderBy("_o"))).filter(F.col("_r") <= length + 2).drop("_r")
        listed = F.sort_array(F.collect_list(F.struct("_o", column)))
        text = F.left(F.trim(F.array_join(F.transform(listed, lambda x: x[column]), separator)), F.lit(length))  # noqa: B023
        merged = merged.join(first.groupBy(*command).agg(text.alias(column)), command)
    return merged.withColumn("review_status", F.lit("revised"))


def carry_review(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote highlights with the local review status unless bounds or texts changed; jobs whose
    remote revision is older keep their local rows."""
    key = ["job_id", "highlight_id"]
    mine = local.select(
        *key, F.col("start_sec").alias("_s"), F.col("end_sec").alias("_e"), F.col("description").alias("_d"),
        F.col("reason").alias("_r"), F.col("review_status").alias("_status"),
    )
    revisions = local.groupBy("job_id").agg(F.max("revision").alias("_rev"))
    fresh = remote.join(revisions, "job_id", "left").filter(F.col("_rev").isNull() | (F.col("revision") >= F.col("_rev")))
    stale_jobs = remote.select("job_id", "revision").distinct().join(revisions, "job_id").filter(F.col("revision") < F.col("_rev")).select("job_id").distinct()
    joined = fresh.drop("_rev").join(mine, key, "left")
    same = (
        F.col("_s").eqNullSafe(F.col("start_sec")) & F.col("_e").eqNullSafe(F.col("end_sec"))
        & F.col("_d").eqNullSafe(F.col("description")) & F.col("_r").eqNullSafe(F.col("reason"))
    )
    out = joined.withColumn(
        "review_status", F.when(same, F.coalesce("_status", "review_status")).otherwise(F.col("review_status"))
    ).select(*remote.columns)
    return out.unionByName(local.join(stale_jobs, "job_id", "left_semi").select(*remote.columns))


def invalidate_clips(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Blank the clip address of highlights that are new or moved against the previous revision."""
    key = ["job_id", "highlight_id"]
    old = previous.select(*key, F.col("start_sec").alias("_s"), F.col("end_sec").alias("_e"))
    joined = new.join(old, key, "left")
    same = F.coalesce((F.col("_s") == F.col("start_sec")) & (F.col("_e") == F.col("end_sec")), F.lit(False))
    return joined.withColumn("clip_url", F.when(same, F.col("clip_url")).otherwise(F.lit(""))).drop("_s", "_e")


def apply_reviews(highlights: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(review log rows, rejected decisions). ``decisions``: job_id, highlight_id, status,
    new_start, new_end (nullable). ``highlights`` also needs duration_sec and clip_url."""
    key = ["job_id", "highlight_id"]
    joined = decisions.join(highlights, key, "left")
    start = F.when(F.col("new_start").isNull(), F.col("start_sec")).otherwise(F.greatest(F.lit(0.0), F.col("new_start")))
    end = F.when(F.col("new_end").isNull(), F.col("end_sec")).otherwise(F.least(F.col("duration_sec"), F.col("new_end")))
    reviewed = joined.withColumns({"_s": start, "_e": end}).withColumn(
        "error",
        F.when(F.col("start_sec").isNull(), "unknown_highlight")
        .when(~F.col("status").isin("accepted", "rejected", "revised"), "unknown_status")
        .when(F.col("_e") <= F.col("_s"), "empty_range"),
    )
    moved = (F.col("_s") != F.col("start_sec")) | (F.col("_e") != F.col("end_sec"))
    log = reviewed.filter(F.col("error").isNull()).select(
        *key,
        F.col("status").alias("review_status"),
        F.when(moved, F.lit("")).otherwise(F.col("clip_url")).alias("clip_url"),
        F.col("_s").alias("start_sec"),
        F.col("_e").alias("end_sec"),
    )
    return log, reviewed.filter(F.col("error").isNotNull()).select(*key, "error")


def upsert_candidates(current: DataFrame, proposed: DataFrame, content: Sequence[str], media: Sequence[str], violations: DataFrame) -> DataFrame:
    """Merged candidate table keyed by (job_id, event_id): the version grows only when the content
    changed, the media plan is kept when the ``media`` columns are unchanged, and a job with any
    violation (job_id) is left as it was. ``current`` also has version and plan_status."""
    key = ["job_id", "event_id"]
    ok = proposed.join(violations.select("job_id").distinct(), "job_id", "left_anti")
    new = ok.select(*key, *[F.col(c).alias(f"_n_{c}") for c in content], F.lit(True).alias("_new"))
    both = current.withColumn("_old", F.lit(True)).join(new, key, "full")
    def same(cols):
        cond = F.lit(True)
        for c in cols:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
        return cond

    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    changed = is_new & (~is_old | ~same(content))
    outcome = (
        F.when(~is_new, "kept").when(~is_old, "inserted").when(changed, "updated").otherwise("unchanged")
    )
    plan = (
        F.when(~changed, F.col("plan_status"))
        .when(is_old & same(media) & F.col("plan_status").isNotNull(), F.lit("draft"))
    )
    return both.withColumns(
        {
            "outcome": outcome,
            "_plan": plan,
            "version": F.when(~is_old, F.lit(1).cast("bigint")).when(changed, F.col("version") + 1).otherwise(F.col("version")),
        }
    ).select(
        *key, *[F.when(is_new, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in content],
        F.col("version").cast("bigint").alias("version"), F.col("_plan").alias("plan_status"), "outcome",
    )


def details(highlights: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked highlights (job_id, highlight_id) with their place on the timeline and score in percent."""
    key = ["job_id", "highlight_id"]
    placed = timeline_positions(highlights).join(asked.select(*key).distinct(), key, "left_semi")
    return placed.withColumn("score_percent", F.round(F.col("score") * 100).cast("bigint"))


def latest_history(turns: DataFrame, keep: int = 5) -> DataFrame:
    """The last turns per job (bounded per-group top-k, cut before the shuffle)."""
    w = Window.partitionBy("job_id").orderBy(F.col("pos").desc())
    return turns.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= keep)


def archive(jobs: DataFrame, statuses: Sequence[str], keyword: str, text_columns: Sequence[str], sort: str = "newest") -> DataFrame:
    """Jobs filtered by shown status (any of active, completed, partial, failed, all) and keyword,
    sorted newest, oldest or by name."""
    from ..functions.labels import display_status, review_ready
    from ..functions.scalars import folded_contains

    shown = display_status("status", "completion")
    tests = {
        "all": F.lit(True),
        "active": F.col("status").isin("queued", "processing"),
        "completed": review_ready("status", "completion"),
        "partial": shown == "partial",
        "failed": F.col("status") == "failed",
    }
    keep = tests[statuses[0]]
    for name in statuses[1:]:
        keep = keep | tests[name]
    needle = keyword.strip()
    if needle:
        keep = keep & folded_contains(F.concat_ws(" ", *[F.col(c).cast("string") for c in text_columns]), F.lit(needle))
    order = {"newest": F.col("created").desc(), "oldest": F.col("created"), "name": F.col("name")}[sort]
    return jobs.filter(keep).orderBy(order, "job_id")


def score_positions(highlights: DataFrame) -> DataFrame:
    """Highlights with their rank by score (best first) within the job."""
    keyed = highlights.withColumn("_neg", -F.col("score"))
    order = [F.col("_neg"), F.col("start_sec"), F.col("highlight_id")]
    return sliced_rank(keyed, ["job_id"], order, F.floor(F.col("_neg") * 20), "position").drop("_neg")
