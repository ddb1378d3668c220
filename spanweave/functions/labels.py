"""Ordered case classifications of labels, windows, predictions and jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import _c, is_finite

CATEGORIES = ("empty", "single", "multiple")
SPLITS = ("train", "val", "test")
THRESHOLDS = (0.3, 0.5, 0.7)
CORE_COVERAGE = 0.8


def window_category(n_segments) -> Column:
    n = _c(n_segments)
    return F.when(n == 0, F.lit("empty")).when(n == 1, F.lit("single")).otherwise(F.lit("multiple"))


def annotation_cohort(human_verified, status, exposure) -> Column:
    return (
        F.when(F.coalesce(_c(human_verified), F.lit(False)), F.lit("human_verified"))
        .when(F.coalesce(_c(status) == "silver", F.lit(False)), F.lit("silver"))
        .when(_c(exposure) == F.lit(False), F.lit("ai_blind"))
        .when(_c(exposure) == F.lit(True), F.lit("ai_prediction_exposed"))
        .otherwise(F.lit("unspecified"))
    )


def label_status(n_certain) -> Column:
    """Saved labels are ready once any segment is not uncertain."""
    return F.when(_c(n_certain) > 0, F.lit("ready")).otherwise(F.lit("unresolved"))


def error_class(parse_error, n_missed, n_false, n_pairs, n_pairs_half) -> Column:
    """Class of one scored window, in order of precedence."""
    missed, false, pairs = _c(n_missed), _c(n_false), _c(n_pairs)
    return (
        F.when(_c(parse_error), F.lit("parse_error"))
        .when((missed > 0) & (false > 0), F.lit("missed_and_false"))
        .when(missed > 0, F.lit("missed"))
        .when(false > 0, F.lit("false"))
        .when((pairs > 0) & (_c(n_pairs_half) < pairs), F.lit("boundary_drift"))
        .when(pairs > 0, F.lit("hit"))
        .otherwise(F.lit("correct_empty"))
    )


def review_ready(status, completion) -> Column:
    return F.coalesce((_c(status) == "completed") & (_c(completion) == "complete"), F.lit(False))


def resumable(status, completion, revision) -> Column:
    partial = F.coalesce((_c(status) == "completed") & (_c(completion) == "partial"), F.lit(False))
    return (_c(revision) == 0) & ((_c(status) == "failed") | partial)


def display_status(status, completion) -> Column:
    partial = F.coalesce((_c(status) == "completed") & (_c(completion) == "partial"), F.lit(False))
    return F.when(partial, F.lit("partial")).otherwise(_c(status))


def coverage_percent(status, result_coverage, checkpoint_coverage) -> Column:
    """A terminal result outranks a checkpoint; otherwise the checkpoint comes first."""
    chosen = F.when(
        _c(status) == "completed", F.coalesce(_c(result_coverage), _c(checkpoint_coverage))
    ).otherwise(F.coalesce(_c(checkpoint_coverage), _c(result_coverage)))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), chosen))
    return F.when(is_finite(chosen), F.floor(clipped * 100 + 0.5).cast("bigint"))


def group_bucket(drama_id) -> Column:
    """Bucket 0..9 from the leading 32 bits of the group's SHA-256."""
    head = F.substring(F.sha2(_c(drama_id).cast("string"), 256), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % 10


def group_split(drama_id) -> Column:
    bucket = group_bucket(drama_id)
    return F.when(bucket < 8, F.lit("train")).when(bucket == 8, F.lit("val")).otherwise(F.lit("test"))
