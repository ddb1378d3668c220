"""Aggregates over labels, windows, matchings and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import scalars as sc
from ..functions.labels import THRESHOLDS
from ..operators import matching as mt
from ..operators import metrics as me
from ..operators import store
from ..operators.tiles import tiles
from . import fixtures as fx
from . import scoring as sg
from . import windows as wn
from .catalog_generation import CELLS, OPTIONS, WINDOW_SQL, labelled_videos
from .catalog_intervals import IOU, OVER, PAIRS_SQL, evidence, keyed, pairs
from .catalog_joins import EDGES_SQL, TILES_SQL, sides
from .catalog_matching import (
    HALF_SQL,
    KEYS,
    SAMPLE_SQL,
    SOFT_SQL,
    half_pairs,
    matching_sql,
    recursive,
    samples,
    scored_answers,
    scored_windows,
)
from .registry import query


@query(
    "agg_store_stats",
    fx.with_sql(
        "videos", "seg", "ok AS (SELECT * FROM videos WHERE status = 'ready' AND source = 'model_reviewed')",
        "pos AS (SELECT s.* FROM seg s WHERE kind = 'positive' AND video_id IN (SELECT video_id FROM ok))", fx.union_sql("u", "pos", "video_id"),
        "q AS (SELECT (SELECT sum(end_sec - start_sec) FROM u) AS hl, (SELECT sum(duration_sec) FROM ok) AS tot)",
    )
    + """SELECT 'status' AS facet, status AS name, CAST(count(*) AS DOUBLE) AS value FROM videos GROUP BY status
UNION ALL SELECT 'split', split, count(*) FROM videos GROUP BY split UNION ALL SELECT 'label', source, count(*) FROM ok GROUP BY source
UNION ALL SELECT 'ready_split', split, count(*) FROM ok GROUP BY split UNION ALL SELECT 'quality', 'dramas', count(DISTINCT drama_id) FROM videos
UNION ALL SELECT 'quality', 'highlight_sec', round(hl, 3) FROM q UNION ALL SELECT 'quality', 'total_sec', round(tot, 3) FROM q
UNION ALL SELECT 'quality', 'highlight_ratio', round(hl / tot, 4) FROM q""",
)
def _(spark, sf):
    v = fx.videos(spark, sf)
    names = ("dramas", "highlight_sec", "total_sec", "highlight_ratio")
    quality = me.store_quality(v, fx.seg(spark, sf)).select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("q")
    )
    return me.store_counts(v).select("facet", "name", F.col("n").cast("double").alias("value")).unionByName(
        quality.select(F.lit("quality").alias("facet"), "q.name", "q.value")
    )


@query(
    "agg_snapshot_report",
    fx.with_sql(
        "videos", "seg", fx.union_sql("u", "seg", "video_id", "kind <> 'uncertain'"),
        "k AS (SELECT video_id, sum(end_sec - start_sec) AS known FROM u GROUP BY video_id)",
        """p AS (SELECT video_id, count(*) FILTER (kind = 'positive') AS positive, count(*) FILTER (kind = 'negative') AS negative, count(*) FILTER (kind = 'uncertain') AS uncertain,
  coalesce(sum(end_sec - start_sec) FILTER (kind = 'positive'), 0) AS hl, max(end_sec - start_sec) FILTER (kind = 'positive') AS longest FROM seg GROUP BY video_id)""",
    )
    + """SELECT split, count(*) AS videos, count(DISTINCT drama_id) AS dramas, CAST(sum(positive) AS BIGINT) AS positive, CAST(sum(negative) AS BIGINT) AS negative, CAST(sum(uncertain) AS BIGINT) AS uncertain,
  sum(duration_sec) AS total_sec, sum(known) AS supervised_sec, sum(hl) AS highlight_sec, coalesce(max(longest), 0) AS longest_highlight_sec,
  sum(duration_sec) - sum(known) AS unknown_sec, round(sum(hl) / sum(duration_sec), 4) AS highlight_ratio
FROM videos JOIN p USING (video_id) JOIN k USING (video_id) WHERE status = 'ready' AND source = 'model_reviewed' GROUP BY split""",
)
def _(spark, sf):
    return me.snapshot_report(fx.videos(spark, sf), fx.seg(spark, sf))


@query(
    "agg_window_counts",
    fx.with_sql("seg", "videos", TILES_SQL.format(w=5, c=0), WINDOW_SQL[: WINDOW_SQL.index(",\nlines AS")])
    + """SELECT v.split, count(*) AS total, count(*) FILTER (outcome = 'unknown') AS unknown, count(*) FILTER (outcome = 'incomplete_core') AS incomplete_core,
  count(*) FILTER (outcome IN ('positive', 'empty')) AS usable, count(*) FILTER (outcome = 'positive') AS positive, count(*) FILTER (outcome = 'empty') AS empty
FROM outcome o JOIN videos v USING (video_id) GROUP BY v.split""",
)
def _(spark, sf):
    return wn.window_counts(wn.classify_tiles(labelled_videos(spark, sf), fx.seg(spark, sf), wn.WindowOptions(5.0, 0.0, 0.0)))


@query(
    "agg_stage_stats",
    fx.with_sql("seg", "videos", SAMPLE_SQL)
    + """SELECT count(*) AS samples, count(DISTINCT video_id) AS videos, count(DISTINCT drama_id) AS dramas, count(*) FILTER (category = 'empty') AS empty,
  count(*) FILTER (category = 'single') AS single, count(*) FILTER (category = 'multiple') AS multiple, count(*) FILTER (focus) AS history_focus FROM samples""",
)
def _(spark, sf):
    return me.stage_stats(samples(spark, sf))


Z = "1.959963984540054::DOUBLE"


def wilson_sql(h: str, n: str, name: str) -> str:
    p = f"({h} / {n}::DOUBLE)"
    centre = f"({p} + {Z} * {Z} / (2 * {n}))"
    radius = f"({Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4.0 * {n} * {n})))"
    den = f"(1 + {Z} * {Z} / {n})"
    return (
        f"CASE WHEN {n} > 0 THEN round(greatest(0, ({centre} - {radius}) / {den}), 6) END AS {name}_low, "
        f"CASE WHEN {n} > 0 THEN round(least(1, ({centre} + {radius}) / {den}), 6) END AS {name}_high"
    )


RATES_SQL = (
    "round(coalesce(hits / nullif(predictions, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(hits / nullif(targets, 0)::DOUBLE, 0), 6) AS recall, "
    "round(coalesce(2 * hits / nullif(predictions + targets, 0)::DOUBLE, 0), 6) AS f1, "
    + wilson_sql("hits", "predictions", "precision") + ", " + wilson_sql("hits", "targets", "recall")
)
RATE_COLS = ["precision", "recall", "f1", "precision_low", "precision_high", "recall_low", "recall_high"]


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "agg_rates",
    recursive(
        "seg", *HALF_SQL, "h AS (SELECT video_id, pairs AS hits FROM m)",
        "n AS (SELECT video_id, count(*) FILTER (side = 1) AS predictions, count(*) FILTER (side = 0) AS targets FROM seg GROUP BY video_id)",
        "t AS (SELECT video_id, coalesce(hits, 0) AS hits, predictions, targets FROM n LEFT JOIN h USING (video_id))",
    )
    + f"SELECT video_id, hits, predictions, targets, {RATES_SQL} FROM t",
)
def _(spark, sf):
    hits = half_pairs(spark, sf).groupBy("video_id").agg(F.count(F.lit(1)).alias("hits"))
    n = fx.seg(spark, sf).groupBy("video_id").agg(
        F.count_if(F.col("side") == 1).alias("predictions"), F.count_if(F.col("side") == 0).alias("targets")
    )
    return rounded(me.rates(n.join(hits, "video_id", "left").na.fill(0, ["hits"])), RATE_COLS)


@query(
    "agg_wilson",
    f"SELECT supp, hits, total, {wilson_sql('hits', 'total', 'share')} FROM (SELECT l_suppkey AS supp, count(*) FILTER (l_returnflag = 'A') AS hits, count(*) FILTER (l_tax > 0.05) + count(*) FILTER (l_returnflag = 'A') AS total FROM lineitem GROUP BY l_suppkey)",
)
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supp")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("hits"), F.count_if(F.col("l_tax") > 0.05).alias("_t")
    ).withColumn("total", F.col("_t") + F.col("hits")).drop("_t")
    low, high = sc.wilson("hits", "total")
    return rows.withColumns({"share_low": F.round(low, 6), "share_high": F.round(high, 6)})


@query(
    "agg_threshold_sweep",
    recursive(
        "seg", "videos", EDGES_SQL, "th AS (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS threshold)",
        "near AS (SELECT concat(video_id, ':', threshold) AS k, p_no, t_no, similarity, threshold FROM edges JOIN th ON similarity >= threshold)", matching_sql("m", "near", "k"),
        "h AS (SELECT threshold, CAST(sum(pairs) AS BIGINT) AS hits FROM m JOIN (SELECT DISTINCT k, threshold FROM near) USING (k) GROUP BY threshold)",
        "t AS (SELECT threshold, coalesce(hits, 0) AS hits, (SELECT count(*) FROM seg WHERE side = 1) AS predictions, (SELECT count(*) FROM seg WHERE side = 0) AS targets FROM th LEFT JOIN h USING (threshold))",
    )
    + f"SELECT threshold, hits, predictions, targets, {RATES_SQL} FROM t",
)
def _(spark, sf):
    p, t = sides(spark, sf)
    p, t = p.drop("p_kind"), t.drop("t_kind")
    pairs = sg.match_spans(p, t, KEYS, mt.traversal_matching, min(THRESHOLDS), thresholds=THRESHOLDS)
    totals = me.match_totals(fx.videos(spark, sf).select("video_id"), pairs, p, t, KEYS, [], THRESHOLDS)
    return rounded(me.rates(totals), RATE_COLS)


def event_scores(spark, sf):
    """Per (video, threshold) event totals; videos in review are incomplete."""
    p, t = sides(spark, sf)
    span = lambda s, e, *role: F.struct(*role, s.alias("start_sec"), e.alias("end_sec"))
    t = t.withColumns(
        {
            "alternatives": F.array(span(F.col("t_start") + 20, F.col("t_end") + 20)),
            "evidence": F.array(span(F.col("t_start") + 1, F.col("t_start") + 3, F.lit("decisive").alias("role"))),
        }
    )
    cols = ["video_id", "t_no", "t_start", "t_end", "alternatives", "evidence"]
    spans = p.select("video_id", "p_no", "p_start", "p_end")
    items = fx.videos(spark, sf).select(
        "video_id", (F.col("status") != "review").alias("complete"),
        F.when(F.col("source") == "model_reviewed", "silver").otherwise("unspecified").alias("cohort"),
    )
    return sg.score_events(
        items, spans, t.filter("t_kind = 'positive'").select(*cols), t.filter("t_kind = 'uncertain'").select(*cols),
        spans.withColumn("p_start", F.col("p_start") - 1), p.filter("p_kind = 'positive'").select(*spans.columns), KEYS,
    )


EVENT_COLS = [*RATE_COLS, "candidate_recall", "verification_recall"]
EVENT_SIM = (
    f"greatest({IOU.format('ps', 'pe', 'ts', 'te')}, {IOU.format('ps', 'pe', 'ts + 20', 'te + 20')}, {OVER.format('ps', 'pe', 'ts + 1', 'ts + 3')} / 2)"
)


def event_sql(group: str) -> str:
    """Event totals by ``group`` (an expression over the items), as in ``score_events``."""
    rates = RATES_SQL + ", round(candidate_hits / greatest(targets, 1)::DOUBLE, 6) AS candidate_recall, round(verified_hits / greatest(targets, 1)::DOUBLE, 6) AS verification_recall"
    counts = "hits, predictions, targets, output_count, output_sec, optional_hits, duplicate_count, candidate_hits, verified_hits, decisive_n"
    return recursive(
        "seg", "videos", "th AS (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS threshold)",
        "items AS (SELECT video_id, status <> 'review' AS complete, CASE WHEN source = 'model_reviewed' THEN 'silver' ELSE 'unspecified' END AS cohort FROM videos)",
        "live AS (SELECT seg.* FROM seg JOIN items USING (video_id) WHERE complete AND side = 1)",
        """pr AS (SELECT video_id, seg_no AS p_no, start_sec AS ps, end_sec AS pe, 'required' AS role FROM live UNION ALL SELECT video_id, seg_no, start_sec - 1, end_sec, 'candidate' FROM live
  UNION ALL SELECT video_id, seg_no, start_sec, end_sec, 'verified' FROM live WHERE kind = 'positive')""",
        "tg AS (SELECT video_id, seg_no AS t_no, start_sec AS ts, end_sec AS te, kind FROM seg WHERE side = 0 AND kind IN ('positive', 'uncertain'))",
        f"ev AS (SELECT video_id, role, p_no, t_no, kind, {EVENT_SIM} AS similarity FROM pr JOIN tg USING (video_id))",
        "el AS (SELECT concat(video_id, ':', threshold, ':', role) AS k, ev.*, threshold FROM ev JOIN th ON similarity >= threshold AND (kind = 'positive' OR role = 'required'))",
        "req AS (SELECT * FROM el WHERE kind = 'positive')", matching_sql("m", "req", "k"),
        "opt AS (SELECT * FROM el WHERE kind = 'uncertain' AND NOT EXISTS (SELECT 1 FROM m_used u WHERE u.k = el.k AND u.p_no = el.p_no))", matching_sql("o", "opt", "k"),
        "dup AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, p_no FROM el WHERE role = 'required' EXCEPT (SELECT k, p_no FROM m_used UNION ALL SELECT k, p_no FROM o_used)) GROUP BY k)",
        "ks AS (SELECT DISTINCT k, video_id, threshold, role FROM el)",
        """x AS (SELECT video_id, threshold, sum(m.pairs) FILTER (role = 'required') AS hits, sum(m.pairs) FILTER (role = 'candidate') AS candidate_hits, sum(m.pairs) FILTER (role = 'verified') AS verified_hits,
  sum(o.pairs) AS optional_hits, sum(dup.n) AS duplicate_count FROM ks LEFT JOIN m USING (k) LEFT JOIN o USING (k) LEFT JOIN dup USING (k) GROUP BY video_id, threshold)""",
        "np AS (SELECT video_id, count(*) AS output_count, sum(end_sec - start_sec) AS output_sec FROM live GROUP BY video_id)",
        "nt AS (SELECT video_id, count(*) AS targets FROM tg WHERE kind = 'positive' GROUP BY video_id)",
        f"""t AS (SELECT {group} threshold, count(*) AS videos, CAST(sum(coalesce(hits, 0)) AS BIGINT) AS hits, CAST(sum(coalesce(output_count, 0) - coalesce(optional_hits, 0)) AS BIGINT) AS predictions,
  CAST(sum(coalesce(targets, 0)) AS BIGINT) AS targets, CAST(sum(coalesce(output_count, 0)) AS BIGINT) AS output_count, sum(coalesce(output_sec, 0)) AS output_sec, CAST(sum(coalesce(optional_hits, 0)) AS BIGINT) AS optional_hits,
  CAST(sum(coalesce(duplicate_count, 0)) AS BIGINT) AS duplicate_count, CAST(sum(coalesce(candidate_hits, 0)) AS BIGINT) AS candidate_hits, CAST(sum(coalesce(verified_hits, 0)) AS BIGINT) AS verified_hits,
  CAST(sum(coalesce(hits, 0)) AS BIGINT) AS decisive_n
  FROM {"items" if not group else "(SELECT * FROM items UNION ALL SELECT video_id, complete, 'all' FROM items)"} JOIN th ON true LEFT JOIN np USING (video_id) LEFT JOIN nt USING (video_id) LEFT JOIN x USING (video_id, threshold) GROUP BY {group} threshold)""",
    ) + f"SELECT {group} threshold, videos, {counts}, {rates} FROM t"


# which of several equal matchings is taken decides the mean of decisive coverage, so the SQL of the totals leaves it out;
# the whole rows are tested against plain walks


@query("agg_event_metrics")
def _(spark, sf):
    return rounded(sg.event_totals(event_scores(spark, sf), []), [*EVENT_COLS, "mean_decisive_coverage"])


@query("agg_event_totals", event_sql(""))
def _(spark, sf):
    return rounded(sg.event_totals(event_scores(spark, sf), []).drop("mean_decisive_coverage"), EVENT_COLS)


@query("agg_by_cohort")
def _(spark, sf):
    return rounded(sg.by_cohort(event_scores(spark, sf)), [*EVENT_COLS, "mean_decisive_coverage"])


@query("agg_cohort_totals", event_sql("cohort,"))
def _(spark, sf):
    return rounded(sg.by_cohort(event_scores(spark, sf)).drop("mean_decisive_coverage"), EVENT_COLS)


@query(
    "agg_all_vs_complete",
    recursive(
        "seg", "videos", *HALF_SQL, "h AS (SELECT video_id, pairs AS hits FROM m)",
        "n AS (SELECT video_id, count(*) FILTER (side = 1) AS predictions, count(*) FILTER (side = 0) AS targets FROM seg GROUP BY video_id)",
        """i AS (SELECT video_id, status <> 'review' AS complete, CASE WHEN status <> 'review' THEN coalesce(hits, 0) ELSE 0 END AS hits,
  CASE WHEN status <> 'review' THEN coalesce(predictions, 0) ELSE 0 END AS predictions, coalesce(targets, 0) AS targets FROM videos LEFT JOIN n USING (video_id) LEFT JOIN h USING (video_id))""",
        """t AS (SELECT 'all' AS scope, count(*) AS videos, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(predictions) AS BIGINT) AS predictions, CAST(sum(targets) AS BIGINT) AS targets FROM i
  UNION ALL SELECT 'completed_only', count(*), sum(hits), sum(predictions), sum(targets) FROM i WHERE complete)""",
    )
    + f"SELECT scope, videos, CAST(hits AS BIGINT) AS hits, CAST(predictions AS BIGINT) AS predictions, CAST(targets AS BIGINT) AS targets, round((SELECT avg(complete::INT) FROM i), 6) AS completion_rate, {RATES_SQL} FROM t",
)
def _(spark, sf):
    hits = half_pairs(spark, sf).groupBy("video_id").agg(F.count(F.lit(1)).alias("hits"))
    n = fx.seg(spark, sf).groupBy("video_id").agg(
        F.count_if(F.col("side") == 1).alias("predictions"), F.count_if(F.col("side") == 0).alias("targets")
    )
    items = fx.videos(spark, sf).select("video_id", (F.col("status") != "review").alias("complete"))
    items = items.join(n, "video_id", "left").join(hits, "video_id", "left").na.fill(0)
    return rounded(me.rates(me.all_and_completed(items)), [*RATE_COLS, "completion_rate"])


def windowed_drama_sql() -> str:
    """Windows as in ``scored_windows``: hits at IoU 0.5 between a window's predictions and its positive segments."""
    sim = IOU.format("ps", "pe", "rs", "re")
    return recursive(
        "seg", "dialogues", "videos", TILES_SQL.format(w=10, c=10), WINDOW_SQL, PRED_SQL,
        f"near AS (SELECT concat(pr.video_id, ':', pr.tile_no) AS k, row_number() OVER () AS e, concat(ps, '-', pe, '-', pn) AS p_no, concat(rs, '-', re, '-', tn) AS t_no, {sim} AS similarity "
        "FROM (SELECT *, row_number() OVER (PARTITION BY video_id, tile_no ORDER BY ps, pe) AS pn FROM pr) pr JOIN (SELECT *, row_number() OVER (PARTITION BY video_id, tile_no ORDER BY rs, re) AS tn FROM targets) t "
        f"ON t.video_id = pr.video_id AND t.tile_no = pr.tile_no AND {sim} >= 0.5)",
        matching_sql("m", "near", "k"),
        """t AS (SELECT drama_id, CAST(sum(coalesce(m.pairs, 0)) AS BIGINT) AS hits, CAST(sum(n_pred) AS BIGINT) AS predictions, CAST(sum(n_ref) AS BIGINT) AS targets
  FROM d JOIN videos v ON v.video_id = d.video_id LEFT JOIN m ON m.k = concat(d.video_id, ':', d.tile_no) GROUP BY drama_id)""",
    ) + f"SELECT drama_id, hits, predictions, targets, {RATES_SQL} FROM t"


PRED_SQL = """w AS (SELECT o.*, o.video_id % 10 = 7 AS bad FROM outcome o WHERE o.outcome IN ('positive', 'empty')),
pr AS (SELECT w.video_id, w.tile_no, s.start_sec - w.read_start AS ps, s.end_sec - w.read_start AS pe FROM w JOIN seg s ON s.video_id = w.video_id AND s.side = 1 AND NOT w.bad
  AND (s.start_sec + s.end_sec) / 2 >= w.core_start AND (s.start_sec + s.end_sec) / 2 < w.core_end),
d AS (SELECT w.video_id, w.tile_no, w.bad, w.n AS n_ref, count(pr.ps) AS n_pred, count(pr.ps) FILTER (ps < 0 OR pe > w.read_end - w.read_start) AS oob FROM w
  LEFT JOIN pr ON pr.video_id = w.video_id AND pr.tile_no = w.tile_no GROUP BY w.video_id, w.tile_no, w.bad, w.n)"""


@query("agg_by_drama", windowed_drama_sql())
def _(spark, sf):
    details = scored_windows(spark, sf)["details"]
    totals = details.groupBy("drama_id").agg(
        F.sum("hits50").alias("hits"), F.sum("n_pred").alias("predictions"), F.sum("n_ref").alias("targets")
    )
    return rounded(me.rates(totals), RATE_COLS)


@query(
    "agg_window_quality",
    fx.with_sql("seg", "dialogues", TILES_SQL.format(w=10, c=10), WINDOW_SQL, PRED_SQL)
    + """SELECT count(*) AS windows, round(count(*) FILTER (NOT bad) / count(*), 6) AS valid_output_rate, count(*) FILTER (bad) AS invalid_outputs, count(*) FILTER (bad) AS truncated_outputs,
  count(*) FILTER (n_ref = 0) AS empty_windows, round(count(*) FILTER (n_ref = 0 AND n_pred > 0) / count(*) FILTER (n_ref = 0), 6) AS empty_window_false_positive_rate,
  round(count(*) FILTER (n_ref = 0 AND n_pred = 0 AND NOT bad) / count(*) FILTER (n_ref = 0), 6) AS empty_window_correct_rate,
  CAST(sum(oob) AS BIGINT) AS out_of_bounds_segments, CAST(0 AS BIGINT) AS out_of_scope_segments FROM d""",
)
def _(spark, sf):
    return rounded(
        me.window_quality(scored_windows(spark, sf)["details"]),
        ["valid_output_rate", "empty_window_false_positive_rate", "empty_window_correct_rate"],
    )


@query(
    "agg_lengths",
    fx.with_sql("seg")
    + """SELECT max(end_sec - start_sec) FILTER (side = 1) AS predicted_max_seconds, median(end_sec - start_sec) FILTER (side = 1) AS predicted_median_seconds,
  median(end_sec - start_sec) FILTER (side = 0) AS reference_median_seconds, (SELECT round(avg(value), 6) FROM events) AS mean_generation_sec,
  (SELECT round(median(value), 6) FROM events) AS median_generation_sec FROM seg""",
)
def _(spark, sf):
    seg = fx.seg(spark, sf)
    generation = fx.timeline(spark, sf).select(F.col("value").alias("generation_sec"))
    out = me.length_summary(seg.filter("side = 1"), seg.filter("side = 0"), generation)
    return rounded(out, ["mean_generation_sec", "median_generation_sec"])


@query("agg_matched_error")
def _(spark, sf):
    p, t = sides(spark, sf)
    pairs = sg.match_spans(
        p.drop("p_kind"), t.drop("t_kind"), KEYS, mt.weighted_cardinality_matching, 0.5, keep=("p_start", "p_end", "t_start", "t_end")
    )
    return rounded(me.matched_error(pairs), ["matched_mean_iou", "start_mae", "end_mae"])


@query(
    "agg_duration_fraction",
    fx.with_sql(
        "seg", f"cells AS (SELECT DISTINCT video_id, side, c FROM ({CELLS.format(cols='video_id, side', src='seg')}))",
        "n AS (SELECT 64.0 * count(*) AS total FROM orders)",
    )
    + """SELECT round((SELECT count(*) FROM cells WHERE side = 1) / total, 6)::DOUBLE AS predicted_duration_fraction,
  round((SELECT count(*) FROM cells WHERE side = 0) / total, 6)::DOUBLE AS reference_duration_fraction,
  round((SELECT count(*) FROM seg WHERE side = 1) * 60 / total, 6)::DOUBLE AS predictions_per_minute FROM n""",
)
def _(spark, sf):
    seg = fx.seg(spark, sf)
    ranges = tiles(fx.videos(spark, sf).select("video_id", "duration_sec"), 10.0).select(
        "video_id", "tile_no", F.col("core_start").alias("start_sec"), F.col("core_end").alias("end_sec")
    )
    n = seg.filter("side = 1").agg(F.count(F.lit(1)).alias("n_pred"))
    out = me.duration_fractions(ranges, seg.filter("side = 1"), seg.filter("side = 0"), KEYS, ["video_id", "tile_no"], n)
    return rounded(out, out.columns)


# run logs: sign-ups are attempts, the other events are trace rows
RUNLOG = [
    "job", "pos", "CASE kind WHEN 'click' THEN 'model' WHEN 'view' THEN 'perception_model' WHEN 'purchase' THEN 'tool' ELSE 'request_error' END AS kind",
    "CASE WHEN kind IN ('click', 'view') AND CAST(k AS BIGINT) % 11 > 0 THEN value END AS elapsed_sec",
    "CAST(k AS BIGINT) % 4 = 0 AS calls_empty", "CAST(k AS BIGINT) % 5 = 0 AS error",
]
ATTEMPTS = [
    "job", "pos AS attempt_no", "CASE WHEN CAST(k AS BIGINT) % 60 > 0 THEN value END AS elapsed_sec",
    "CASE CAST(k AS BIGINT) % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'running' END AS status",
]
RUNLOG_SQL = (
    f"trace AS (SELECT {', '.join(RUNLOG)} FROM timeline WHERE kind <> 'signup'),\n"
    f"attempts AS (SELECT {', '.join(ATTEMPTS)} FROM timeline WHERE kind = 'signup')"
)


def run_log(spark, sf):
    log = fx.timeline(spark, sf)
    return log.filter("kind = 'signup'").selectExpr(*ATTEMPTS), log.filter("kind <> 'signup'").selectExpr(*RUNLOG)


@query(
    "agg_runtime",
    fx.with_sql(
        "timeline", RUNLOG_SQL,
        "a AS (SELECT job, CASE WHEN bool_and(elapsed_sec IS NOT NULL) THEN sum(elapsed_sec) END AS elapsed, count(*) AS attempts, min_by(status, attempt_no) AS first FROM attempts GROUP BY job)",
        "rq AS (SELECT job, elapsed_sec AS v FROM trace WHERE kind IN ('model', 'perception_model') AND elapsed_sec IS NOT NULL)",
        "rr AS (SELECT job, v, row_number() OVER (PARTITION BY job ORDER BY v) AS rn, count(*) OVER (PARTITION BY job) AS n FROM rq)",
        "s AS (SELECT job, median(v) AS med, max(v) AS mx, max(v) FILTER (rn = ceil(0.9 * n)) AS p90, count(*) AS requests FROM rr GROUP BY job)",
        """c AS (SELECT job, count(*) FILTER (kind = 'request_error') AS request_errors, count(*) FILTER (kind = 'model' AND calls_empty) AS missing, count(*) FILTER (kind = 'tool' AND error) AS invalid FROM trace GROUP BY job)""",
        "i AS (SELECT coalesce(c.job, a.job) AS job, elapsed, attempts, first, med, p90, mx, coalesce(requests, 0) AS requests, request_errors, missing, invalid FROM c FULL JOIN a ON a.job = c.job LEFT JOIN s ON s.job = c.job)",
        "ir AS (SELECT elapsed, row_number() OVER (ORDER BY elapsed) AS rn, count(*) OVER () AS n FROM i WHERE elapsed IS NOT NULL)",
    )
    + """SELECT job, round(elapsed, 4) AS elapsed_sec, round(med, 6) AS median_sec, round(p90, 6) AS p90_sec, mx AS max_sec, requests, request_errors, missing AS missing_tool_calls, invalid AS invalid_tool_requests,
  attempts, CASE WHEN first = 'complete' THEN 1 ELSE 0 END::BIGINT AS first_completed FROM i
UNION ALL SELECT NULL, CASE WHEN bool_and(elapsed IS NOT NULL) THEN round(sum(elapsed), 4) END, round(median(elapsed), 6), (SELECT round(max(elapsed), 6) FROM ir WHERE rn = ceil(0.9 * n)), NULL,
  CAST(sum(requests) AS BIGINT), CAST(sum(request_errors) AS BIGINT), CAST(sum(missing) AS BIGINT), CAST(sum(invalid) AS BIGINT), count(*) FILTER (attempts > 1), count(*) FILTER (first = 'complete') FROM i""",
)
def _(spark, sf):
    attempts, trace = run_log(spark, sf)
    items = me.item_runtime(attempts, trace, ["job"], width=50.0)
    total = me.run_runtime(items, width=500.0)
    cols = ["request_errors", "missing_tool_calls", "invalid_tool_requests"]
    first = (F.col("first_status") == "complete").cast("bigint")
    rows = items.select(
        "job", F.round("elapsed_sec", 4).alias("elapsed_sec"), F.round("request_median_sec", 6).alias("median_sec"),
        F.round("request_p90_sec", 6).alias("p90_sec"), F.col("request_max_sec").alias("max_sec"), "requests", *cols, "attempts",
        F.coalesce(first, F.lit(0)).alias("first_completed"),
    )
    none = F.lit(None)
    run = total.select(
        none.cast("bigint").alias("job"), F.round("elapsed_total_sec", 4).alias("elapsed_sec"), F.round("elapsed_median_sec", 6).alias("median_sec"),
        F.round("elapsed_p90_sec", 6).alias("p90_sec"), none.cast("double").alias("max_sec"), "requests", *cols,
        F.col("videos_with_multiple_attempts").alias("attempts"), F.col("first_attempt_completed").alias("first_completed"),
    )
    return rows.unionByName(run)


def share_sql(t: int) -> str:
    h = f"sum(hits{t})"
    return (
        f"round(coalesce({h} / nullif(sum(predicted_count), 0)::DOUBLE, 0), 6) AS precision_iou{t}, round(coalesce({h} / nullif(sum(target_count), 0)::DOUBLE, 0), 6) AS recall_iou{t}, "
        f"round(coalesce(2 * {h} / nullif(sum(predicted_count) + sum(target_count), 0)::DOUBLE, 0), 6) AS f1_iou{t}"
    )


@query(
    "agg_validation",
    recursive(*SOFT_SQL)
    + f"""SELECT round(avg(score), 6) AS soft_f1, round(count(*) FILTER (format_valid) / count(*), 6) AS valid_output_rate, round(count(*) FILTER (empty_positive) / count(*) FILTER (positive), 6) AS empty_positive_rate,
  round(count(*) FILTER (empty_negative_false_alarm) / count(*) FILTER (NOT positive), 6) AS empty_window_false_positive_rate, CAST(sum(invalid_segments) AS BIGINT) AS invalid_segments, CAST(sum(hits30) AS BIGINT) AS hits30,
  CAST(sum(hits50) AS BIGINT) AS hits50, CAST(sum(predicted_count) AS BIGINT) AS predicted_count, CAST(sum(target_count) AS BIGINT) AS target_count, {share_sql(30)}, {share_sql(50)} FROM sc""",
)
def _(spark, sf):
    out = me.validation_summary(scored_answers(spark, sf))
    return rounded(out, [c for c in out.columns if "rate" in c or "iou" in c or c == "soft_f1"])


SCORES = ["job", "kind", "CASE WHEN CAST(k AS BIGINT) % 10 > 2 THEN value / 500 ELSE 0 END AS score", "kind <> 'error' AS positive"]


@query(
    "agg_reward_signal",
    fx.with_sql(
        "timeline", f"sc AS (SELECT {', '.join(SCORES)} FROM timeline)",
        "g AS (SELECT job, kind, stddev_pop(score) AS sd, bool_and(score = 0) AS zero FROM sc GROUP BY job, kind)",
    )
    + """SELECT round(avg(sd), 6) AS reward_std, round(avg((sd > 1e-8)::INT), 6) AS groups_with_signal, round(avg(zero::INT), 6) AS all_zero_groups,
  (SELECT round(avg(score), 6) FROM sc WHERE positive) AS positive_reward, (SELECT round(avg(score), 6) FROM sc WHERE NOT positive) AS negative_reward FROM g""",
)
def _(spark, sf):
    out = me.reward_signal(fx.timeline(spark, sf).selectExpr(*SCORES), ["job", "kind"])
    return rounded(out, out.columns)


@query(
    "agg_review_queue_delta",
    fx.with_sql(
        "seg", "videos", EDGES_SQL, "ok AS (SELECT * FROM edges WHERE similarity >= 0.5 AND t_kind = 'positive')",
        "p AS (SELECT video_id, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ok WHERE ok.video_id = s.video_id AND ok.p_no = s.seg_no)) AS extra FROM seg s WHERE side = 1 GROUP BY video_id)",
        "t AS (SELECT video_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ok WHERE ok.video_id = s.video_id AND ok.t_no = s.seg_no)) AS missed FROM seg s WHERE side = 0 AND kind = 'positive' GROUP BY video_id)",
        "x AS (SELECT v.video_id, v.status, v.video_id % 3 > 0 AS labelled, CASE WHEN v.video_id % 3 > 0 THEN coalesce(missed, 0) + coalesce(extra, 0) ELSE p.n END AS priority FROM videos v JOIN p USING (video_id) LEFT JOIN t USING (video_id))",
    )
    + "SELECT video_id, priority, status, CASE WHEN priority = 0 THEN status WHEN labelled THEN 'review' ELSE 'queued' END AS new_status FROM x",
)
def _(spark, sf):
    seg = fx.seg(spark, sf)
    v = fx.videos(spark, sf).select("video_id", "status", (F.col("video_id") % 3 > 0).alias("labelled"))
    return store.feedback_priority(v, seg.filter("side = 0 AND kind = 'positive'"), seg.filter("side = 1"), 0.5)


@query(
    "agg_feedback_check",
    fx.with_sql(
        "seg", "videos", "v AS (SELECT video_id, split, CASE WHEN price < 50000 THEN 'labeling' ELSE status END AS status FROM videos WHERE video_id % 9 > 0)",
        "p AS (SELECT video_id, CASE WHEN video_id % 5 = 0 THEN seg_no % 2 ELSE 0 END AS fno, max(end_sec) AS e FROM seg WHERE side = 1 GROUP BY ALL)",
    )
    + """SELECT DISTINCT p.video_id, 'unknown_video' AS reason FROM p LEFT JOIN v USING (video_id) WHERE v.split IS NULL
UNION SELECT p.video_id, 'not_train' FROM p JOIN v USING (video_id) WHERE split <> 'train'
UNION SELECT p.video_id, 'being_labelled' FROM p JOIN v USING (video_id) WHERE status = 'labeling'
UNION SELECT p.video_id, 'out_of_range' FROM p JOIN v USING (video_id) WHERE e > 50
UNION SELECT video_id, 'repeated_id' FROM p GROUP BY video_id HAVING count(*) > 1""",
)
def _(spark, sf):
    v = fx.videos(spark, sf).filter("video_id % 9 > 0").select(
        "video_id", "split", F.when(F.col("price") < 50000, "labeling").otherwise(F.col("status")).alias("status"), F.lit(50.0).alias("duration_sec")
    )
    p = fx.seg(spark, sf).filter("side = 1").withColumn(
        "feedback_no", F.when(F.col("video_id") % 5 == 0, F.col("seg_no") % 2).otherwise(0)
    )
    return store.feedback_violations(v, p)


@query(
    "agg_plan_hull",
    f"WITH {PAIRS_SQL} SELECT video_id, seg_no, least(t_start, a_start) AS hull_start, greatest(t_end, a_end) AS hull_end FROM pairs WHERE kind <> 'uncertain'",
)
def _(spark, sf):
    lo, hi = iv.hull(evidence())
    return keyed(pairs(spark, sf).filter("kind NOT IN ('uncertain')"), hull_start=lo, hull_end=hi)


@query(
    "agg_delivery",
    fx.with_sql("seg")
    + """SELECT count(*) FILTER (kind = 'positive') AS accepted, sum(end_sec - start_sec) FILTER (kind = 'positive') AS total_sec,
  count(*) FILTER (kind = 'uncertain') AS pending_reviews, count(*) FILTER (kind = 'positive' AND side = 1) AS configured FROM seg""",
)
def _(spark, sf):
    status = F.when(F.col("kind") == "positive", "accepted").when(F.col("kind") == "negative", "rejected").otherwise("pending")
    return me.delivery(fx.seg(spark, sf).withColumns({"review_status": status, "configured": F.col("side") == 1}))


_ = OPTIONS
