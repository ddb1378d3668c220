"""Scoring plans: saved answers and saved results against reference spans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions.labels import CORE_COVERAGE, THRESHOLDS, error_class
from ..functions.parsing import parse_lenient, parse_strict
from ..operators import matching as mt
from ..operators import metrics as me
from ..operators.rangejoin import candidate_edges
from ..session import materialize


def iou_edges(predictions: DataFrame, targets: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Edges by IoU. ``predictions``: keys, p_no, p_start, p_end; ``targets``: keys, t_no, t_start, t_end."""
    return candidate_edges(predictions, targets, keys, lambda: iv.iou("p_start", "p_end", "t_start", "t_end"), threshold)


def coverage_edges(predictions: DataFrame, targets: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Edges by the share of the target that the prediction covers, with the IoU beside it."""
    edges = candidate_edges(
        predictions, targets, keys, lambda: iv.reference_coverage("p_start", "p_end", "t_start", "t_end"), threshold
    )
    return edges.withColumn("iou", iv.iou("p_start", "p_end", "t_start", "t_end"))


def event_edges(predictions: DataFrame, targets: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Edges by event coverage. ``targets`` also have ``alternatives`` and ``evidence``; partners
    are looked for in the hull of a target, its alternatives and its decisive evidence."""
    decisive = F.filter("evidence", lambda x: x.isNotNull() & (x["role"] == "decisive"))
    starts = F.concat(
        F.array("t_start"), F.transform("alternatives", lambda x: x["start_sec"]), F.transform(decisive, lambda x: x["start_sec"])
    )
    ends = F.concat(
        F.array("t_end"), F.transform("alternatives", lambda x: x["end_sec"]), F.transform(decisive, lambda x: x["end_sec"])
    )
    hulled = targets.withColumns({"th_start": F.array_min(starts), "th_end": F.array_max(ends)})
    edges = candidate_edges(
        predictions, hulled, keys,
        lambda: iv.event_coverage("p_start", "p_end", "t_start", "t_end", F.col("alternatives"), F.col("evidence")),
        threshold, target_span=("th_start", "th_end"),
    )
    edges = edges.withColumn("decisive", iv.decisive_coverage("p_start", "p_end", F.col("evidence")))
    return edges.drop("alternatives", "evidence", "th_start", "th_end")


CORE = ("p_no", "t_no", "similarity", "p_n", "t_n")
SPANS = ("p_start", "p_end", "t_start", "t_end")


def slim(edges: DataFrame, keys: Sequence[str], *extra: str) -> DataFrame:
    return edges.select(*keys, *extra, *[c for c in CORE if c in edges.columns])


def folded_edges(predictions: DataFrame, targets: DataFrame, keys: Sequence[str], threshold: float, build=iou_edges) -> DataFrame:
    """Edges between distinct spans: equal predictions and equal targets are folded first."""
    return build(mt.fold_copies(predictions, "p_no", "p"), mt.fold_copies(targets, "t_no", "t"), keys, threshold)


def match_spans(predictions: DataFrame, targets: DataFrame, keys: Sequence[str], solver, threshold: float, *, thresholds: Sequence[float] = (), extra: Sequence[str] = (), keep: Sequence[str] = (), build=iou_edges) -> DataFrame:
    """Row-level pairs of a matching; ``thresholds`` adds one matching per threshold.

    ``extra`` names further grouping columns of the predictions, ``keep`` edge columns to carry."""
    edges = folded_edges(predictions, targets, keys, threshold, build)
    extra = list(extra)
    if thresholds:
        edges, extra = mt.at_thresholds(edges, thresholds), ["threshold", *extra]
    edges = materialize(slim(edges, keys, *extra, *keep), "pair_edges")
    return row_pairs(edges, predictions, targets, keys, solver, extra)


def row_pairs(edges: DataFrame, predictions: DataFrame, targets: DataFrame, keys: Sequence[str], solver, extra: Sequence[str] = ()) -> DataFrame:
    """Row-level pairs of a matching over folded edges."""
    pairs = mt.match_edges(edges, keys, solver, extra=extra, predictions=predictions, targets=targets)
    return mt.expand_pairs(materialize(pairs, "pairs"), predictions, targets, keys, extra=extra)


def stage_edges(predictions: DataFrame, required: DataFrame, optional: DataFrame, keys: Sequence[str], threshold: float, *, keep: Sequence[str] = (), build=iou_edges) -> DataFrame:
    """Folded edges to the required and to the optional targets (``is_optional``), from one join."""
    marked = [df.withColumn("is_optional", F.lit(on)) for df, on in ((required, False), (optional, True))]
    return materialize(slim(folded_edges(predictions, marked[0].unionByName(marked[1]), keys, threshold, build), keys, "is_optional", *keep), "stage_edges")


def left_over_edges(edges: DataFrame, predictions: DataFrame, taken: DataFrame, base: Sequence[str]) -> DataFrame:
    """Folded edges of the predictions that are not ``taken`` (base, p_no).

    A class of copies of which some are taken goes on under the first number that is left, with the copies left."""
    base = list(base)
    rest = edges.filter("p_n = 1").join(taken, [*base, "p_no"], "left_anti")
    folded = edges.filter("p_n > 1")
    if not folded.take(1):
        return rest
    asked = folded.select(*base, F.col("p_no").alias("_class")).distinct()
    members = mt.members_of(predictions, "p_no", asked, base).join(taken, [*base, "p_no"], "left_anti")
    left = members.groupBy(*base, "_class").agg(F.min("p_no").alias("_first"), F.count(F.lit(1)).alias("_left"))
    kept = folded.withColumnRenamed("p_no", "_class").join(left, [*base, "_class"]).withColumns({"p_no": F.col("_first"), "p_n": F.col("_left")})
    return rest.unionByName(kept.select(*edges.columns))


def two_stage(predictions: DataFrame, required: DataFrame, optional: DataFrame, keys: Sequence[str], threshold: float, *, keep: Sequence[str] = (), build=iou_edges, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Required targets first; predictions left over are then matched to optional targets.

    ``edges``: those of :func:`stage_edges`, when they are there already."""
    keys = list(keys)
    if edges is None:
        edges = stage_edges(predictions, required, optional, keys, threshold, keep=keep, build=build)
    part = lambda on: edges.filter(F.col("is_optional") == on).drop("is_optional")
    first = materialize(row_pairs(part(False), predictions, required, keys, mt.traversal_matching), "first_stage")
    taken = first.select(*keys, "p_no")
    rest = predictions.join(taken, [*keys, "p_no"], "left_anti")
    spare = materialize(left_over_edges(part(True), predictions, taken, keys), "spare_edges")
    return first, row_pairs(spare, rest, optional, keys, mt.traversal_matching)


# --- answers of one window -----------------------------------------------------------------------


def soft_f1(answers: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reward per answer: 2 * matched IoU / (predictions + targets) under maximum weight matching.

    ``answers``: keys, text, duration_sec, core_start, core_end. Both sides empty score 1, no JSON
    scores 0, invalid spans stay in the denominator. Also hits at 0.3 and 0.5 and empty flags."""
    keys = list(keys)
    parsed = materialize(parse_lenient(answers, "duration_sec", "core_start", "core_end"), "answers")
    spans = parsed.select(*keys, F.posexplode("segments").alias("p_no", "s")).select(
        *keys, "p_no", F.col("s.start_sec").alias("p_start"), F.col("s.end_sec").alias("p_end")
    )
    edges = materialize(slim(folded_edges(spans, targets, keys, 0.0), keys), "answer_edges")
    best = mt.match_edges(edges, keys, mt.weighted_matching).groupBy(*keys).agg(
        F.sum(F.col("similarity") * F.col("units")).alias("_sum")
    )
    # only the number of pairs counts here, any matching of maximum cardinality gives it
    counted = mt.match_edges(mt.at_thresholds(edges, (0.3, 0.5)), keys, mt.weighted_cardinality_matching, extra=["threshold"])
    units = lambda th: F.coalesce(F.sum(F.when(F.col("threshold") == th, F.col("units"))), F.lit(0))
    hits = counted.groupBy(*keys).agg(units(0.3).alias("hits30"), units(0.5).alias("hits50"))
    n_t = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("target_count"))
    out = (
        parsed.drop("segments", "text").join(n_t, keys, "left").join(best, keys, "left").join(hits, keys, "left")
        .na.fill(0, ["target_count", "hits30", "hits50"]).na.fill(0.0, ["_sum"])
    )
    both = F.col("predicted_count") + F.col("target_count")
    score = (
        F.when(~F.col("format_valid"), 0.0).when(both == 0, 1.0).otherwise(F.try_divide(F.col("_sum") * 2, both.cast("double")))
    )
    some = F.col("target_count") > 0
    return out.withColumns(
        {
            "score": score,
            "positive": some,
            "empty_positive": some & F.col("format_valid") & (F.col("predicted_count") == 0),
            "empty_negative_false_alarm": ~some & (F.col("predicted_count") > 0),
        }
    ).drop("_sum", "duration_sec", "core_start", "core_end")


def score_windows(windows: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """Strictly parsed answers of fixed windows: ``details`` per window, ``pairs`` per threshold.

    ``windows``: sample_id, drama_id, view_sec, core_start, core_end, segments (array of spans).
    ``answers``: sample_id, text, truncated, generation_sec."""
    keys = ["sample_id"]
    rows = parse_strict(answers).select(
        "sample_id", "parse_error", F.col("segments").alias("predicted"), "truncated", "generation_sec"
    )
    both = materialize(windows.join(rows, "sample_id"), "windows")

    def exploded(column, tag):
        return both.select("sample_id", F.posexplode(column).alias(f"{tag}_no", "s")).select(
            "sample_id", f"{tag}_no", F.col("s.start_sec").alias(f"{tag}_start"), F.col("s.end_sec").alias(f"{tag}_end")
        )

    p, t = exploded("predicted", "p"), exploded("segments", "t")
    pairs = match_spans(
        p, t, keys, mt.weighted_cardinality_matching, min(THRESHOLDS), thresholds=THRESHOLDS,
        keep=("p_start", "p_end", "t_start", "t_end"),
    )
    core = match_spans(p, t, keys, mt.weighted_cardinality_matching, CORE_COVERAGE, keep=("iou",), build=coverage_edges)
    n_core = core.groupBy("sample_id").agg(F.count(F.lit(1)).alias("core_pairs"))
    n_pairs = pairs.groupBy("sample_id").agg(
        *[F.count_if(F.col("threshold") == th).alias(f"hits{int(th * 100)}") for th in THRESHOLDS]
    )
    bounds, scope = iv.scope_flags(F.col("predicted"), "view_sec", "core_start", "core_end")
    details = (
        both.join(n_core, "sample_id", "left").join(n_pairs, "sample_id", "left")
        .na.fill(0, ["core_pairs", "hits30", "hits50", "hits70"])
        .withColumns({"n_pred": F.size("predicted"), "n_ref": F.size("segments"), "out_of_bounds": bounds, "out_of_scope": scope})
    )
    details = details.withColumn(
        "error_class",
        error_class(
            "parse_error", F.col("n_ref") - F.col("core_pairs"), F.col("n_pred") - F.col("core_pairs"), "core_pairs", "hits50"
        ),
    )
    return {"details": details, "pairs": pairs, "core_pairs": core}


# --- saved results of whole videos ---------------------------------------------------------------


def score_events(items: DataFrame, predictions: DataFrame, targets: DataFrame, optional: DataFrame, candidates: DataFrame, verified: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Event totals per (item, threshold).

    Required targets are matched first, left-over predictions then take optional targets, which
    leave the precision denominator. Candidates and verified plans are matched to the required
    targets on their own. ``items``: keys and complete; an incomplete item has no predictions,
    candidates or verified plans but keeps its targets."""
    keys = list(keys)
    base = [*keys, "threshold"]
    done = items.filter("complete").select(*keys)
    live = lambda df: df.join(done, keys, "left_semi")
    low = min(thresholds)
    roles = {"required": predictions, "candidate": candidates, "verified": verified}
    shaped = [df.select(*keys, "p_no", "p_start", "p_end", F.lit(role).alias("role")) for role, df in roles.items()]
    spans = reduce(lambda a, b: a.unionByName(b), shaped)
    wanted = [df.withColumn("is_optional", F.lit(on)) for df, on in ((targets, False), (optional, True))]
    # one edge build for the three roles and both kinds of targets, between folded sides that are written once; roles never
    # meet in a group, and only required predictions look for optional targets
    folded_p = materialize(mt.fold_copies(live(spans), "p_no", "p"), "event_spans")
    folded_t = materialize(mt.fold_copies(wanted[0].unionByName(wanted[1]), "t_no", "t"), "event_targets")
    near = event_edges(folded_p, folded_t, keys, low).filter("role = 'required' OR NOT is_optional")
    edges = materialize(slim(mt.at_thresholds(near, thresholds), base, "role", "is_optional", "decisive"), "event_edges")
    part = lambda on: edges.filter(F.col("is_optional") == on).drop("is_optional")
    # rows are asked for where copies meet edges only
    folded = materialize(edges.filter("p_n > 1 OR t_n > 1").select(*keys).distinct(), "folded_keys")
    if folded.take(1):
        spans = materialize(live(spans.join(folded, keys, "left_semi")), "folded_spans")
        targets, optional = (df.join(folded, keys, "left_semi") for df in (targets, optional))
    role_keys = ["threshold", "role"]
    chosen = materialize(mt.match_edges(part(False), keys, mt.traversal_matching, extra=role_keys, predictions=spans, targets=targets), "event_pairs")
    # totals need units only; single rows are needed to tell which predictions are left over
    mine = spans.filter("role = 'required'")
    first = mt.expand_pairs(chosen.filter("role = 'required'"), mine, targets, keys, extra=role_keys)
    required = materialize(first.select(*base, "p_no"), "required_pairs")
    # what is left over differs by threshold, so the second stage is keyed by it as well
    mine = mine.drop("role")
    at_each = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    left_over = mine.select("*", at_each).join(required, [*base, "p_no"], "left_anti")
    spare_targets = optional.select("*", at_each)
    spare = materialize(left_over_edges(part(True).drop("role", "decisive"), mine, required, base), "optional_edges")
    spare_pairs = materialize(mt.match_edges(spare, base, mt.traversal_matching, predictions=left_over, targets=spare_targets), "optional_pairs")
    second = mt.expand_pairs(spare_pairs, left_over, spare_targets, base).select(*base, "p_no")
    # unmatched after both stages and next to some target
    repeated = mt.duplicate_numbers(mine, edges.filter("role = 'required'"), required.unionByName(second), base).distinct()
    value_of = lambda r, value: F.coalesce(F.sum(F.when(F.col("role") == r, value)), F.lit(0))
    units, known = F.col("units"), F.col("decisive").isNotNull()
    matched = chosen.groupBy(*base).agg(
        value_of("required", units).alias("hits"),
        value_of("candidate", units).alias("candidate_hits"),
        value_of("verified", units).alias("verified_hits"),
        F.sum(F.when(F.col("role") == "required", F.col("decisive") * units)).alias("decisive_sum"),
        value_of("required", F.when(known, units)).alias("decisive_n"),
    )
    optional_hits = spare_pairs.groupBy(*base).agg(F.sum("units").alias("optional_hits"))
    duplicate_count = repeated.groupBy(*base).agg(F.count(F.lit(1)).alias("duplicate_count"))
    n_p = folded_p.filter("role = 'required'").groupBy(*keys).agg(
        F.sum("p_n").alias("output_count"), F.sum((F.col("p_end") - F.col("p_start")) * F.col("p_n")).alias("output_sec")
    )
    n_t = folded_t.filter("NOT is_optional").groupBy(*keys).agg(F.sum("t_n").alias("targets"))
    grid = items.join(n_p, keys, "left").join(n_t, keys, "left").withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    )
    out = (
        grid.join(matched, base, "left").join(optional_hits, base, "left").join(duplicate_count, base, "left")
    )
    counts = ["hits", "candidate_hits", "verified_hits", "decisive_n", "optional_hits", "duplicate_count", "output_count", "targets"]
    return out.na.fill(0, counts).na.fill(0.0, ["decisive_sum", "output_sec"]).withColumn(
        "predictions", F.col("output_count") - F.col("optional_hits")
    )


def event_totals(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """Totals and rates of ``score_events`` rows per (group, threshold)."""
    sums = ["hits", "predictions", "targets", "output_count", "output_sec", "optional_hits", "duplicate_count", "candidate_hits", "verified_hits", "decisive_sum", "decisive_n"]
    totals = scored.groupBy(*group, "threshold").agg(F.count(F.lit(1)).alias("videos"), *[F.sum(c).alias(c) for c in sums])
    floor = F.greatest(F.col("targets"), F.lit(1)).cast("double")
    return me.rates(totals).withColumns(
        {
            "candidate_recall": F.col("candidate_hits") / floor,
            "verification_recall": F.col("verified_hits") / floor,
            "mean_decisive_coverage": F.try_divide(F.col("decisive_sum"), F.col("decisive_n").cast("double")),
        }
    ).drop("decisive_sum")


def by_cohort(scored: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Totals per cohort and over all (null cohort), from one pass over the scored rows."""
    both = scored.withColumn("_c", F.explode(F.array(F.col(cohort), F.lit("all")))).drop(cohort).withColumnRenamed("_c", cohort)
    return event_totals(both, [cohort])
