"""Run-log operators: batch queries, and streams that run over files made of the same tables.

A stream gets its rows in parts, each as new files, and is drained after each by a new query from the same checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import content_key
from ..operators import telemetry as tm
from ..streaming import metrics as sm
from ..streaming import progress as sp
from ..streaming import sinks
from . import fixtures as fx
from .catalog_aggregates import RUNLOG, RUNLOG_SQL, run_log
from .catalog_generation import page_rows
from .catalog_joins import TILES_SQL
from .catalog_sources import scratch
from .registry import query

LOG = ["job AS run", "pos", "CAST(floor(value / 20) AS BIGINT) AS step", "kind IN ('view', 'click') AS training", "kind AS key", "value"]
LOG_SQL = f"lg AS (SELECT {', '.join(LOG)} FROM timeline)"


def merged_sql(name: str, where: str) -> str:
    return f"""{name}_t AS (SELECT run, step, max(pos) AS since FROM lg WHERE training AND {where} GROUP BY run, step),
{name} AS (SELECT run, step, key, max_by(value, pos) AS value FROM lg LEFT JOIN {name}_t USING (run, step) WHERE (since IS NULL OR pos >= since) AND {where} GROUP BY run, step, key)"""


MERGE_SQL = fx.with_sql("timeline", LOG_SQL, merged_sql("m", "TRUE")) + "SELECT run, step, key, value FROM m"


@query("st_metric_merge", MERGE_SQL)
def _(spark, sf):
    return tm.merge_metrics(fx.timeline(spark, sf).selectExpr(*LOG))


@query("st_metric_merge_stream", MERGE_SQL)
def _(spark, sf):
    """The rows come in three parts, none of them in order."""
    log = fx.timeline(spark, sf).selectExpr(*LOG)
    parts = [log.filter(f"pos % 3 = {i}") for i in (2, 0, 1)]
    out = sinks.run_in_parts(parts, sm.merge_metrics_stream, scratch(spark, "metrics"))
    return sinks.newest_groups(spark, out, sm.MERGED, ["run", "step"])


ALLOWED_SQL = (
    fx.with_sql(
        "timeline",
        """lg AS (SELECT job AS run, CAST(pos % 3 AS VARCHAR) AS file, pos, CAST(floor(value / 20) AS BIGINT) AS step, CASE WHEN kind = 'error' THEN 'validation/error' ELSE kind END AS key,
  CASE WHEN pos % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value FROM timeline)""",
    )
    + """SELECT run, step, key, value FROM (SELECT *, row_number() OVER (PARTITION BY run, step, key ORDER BY file DESC, pos DESC) AS rn FROM lg
WHERE (key IN ('view', 'click') OR key LIKE 'validation/%') AND NOT isnan(value)) WHERE rn = 1"""
)


def file_log(spark, sf):
    return fx.timeline(spark, sf).select(
        F.col("job").alias("run"), (F.col("pos") % 3).cast("string").alias("file"), "pos", F.floor(F.col("value") / 20).alias("step"),
        F.when(F.col("kind") == "error", "validation/error").otherwise(F.col("kind")).alias("key"),
        F.when(F.col("pos") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    )


@query("st_metric_allowlist", ALLOWED_SQL)
def _(spark, sf):
    return tm.allowed_metrics(file_log(spark, sf), ["view", "click"])


@query("st_metric_allowlist_stream", ALLOWED_SQL)
def _(spark, sf):
    """The last file comes first, and the first in two parts."""
    log = file_log(spark, sf)
    parts = [log.filter(where) for where in ("file = '2' OR file = '0' AND pos % 2 = 1", "file = '1'", "file = '0' AND pos % 2 = 0")]
    out = sinks.run_in_parts(parts, lambda rows: sm.allowed_metrics_stream(rows, ["view", "click"]), scratch(spark, "allowed"))
    return sinks.newest_groups(spark, out, sm.MERGED, ["run", "step"])


CHANGED_SQL = (
    fx.with_sql(
        "timeline", LOG_SQL, merged_sql("now", "TRUE"), merged_sql("sent", "pos % 4 > 0"),
        """same AS (SELECT run, step FROM (SELECT run, step, key, value, 1 AS a, 0 AS b FROM now UNION ALL SELECT run, step, key, value, 0, 1 FROM sent)
  GROUP BY run, step HAVING sum(a) = sum(b) AND count(DISTINCT concat(key, '=', CAST(value AS VARCHAR))) = sum(a))""",
    )
    + "SELECT run, step, key, value FROM now WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.run = now.run AND s.step = now.step)"
)


@query("st_emit_changed", CHANGED_SQL)
def _(spark, sf):
    log = fx.timeline(spark, sf).selectExpr(*LOG)
    return tm.changed_steps(tm.merge_metrics(log), tm.merge_metrics(log.filter("pos % 4 > 0")))


@query("st_emit_changed_stream", CHANGED_SQL)
def _(spark, sf):
    """What is sent after the first batch: the steps that the rest of the rows change; all rows once more send nothing."""
    log = fx.timeline(spark, sf).selectExpr(*LOG)
    out = sinks.run_in_parts([log.filter("pos % 4 > 0"), log.filter("pos % 4 = 0"), log], sm.merge_metrics_stream, scratch(spark, "changed"))
    return sinks.read_batches(spark, out, sm.MERGED).filter("batch > 0").drop("batch")


@query(
    "st_stagnation",
    fx.with_sql(
        "timeline", "f AS (SELECT job, k, min(pos) AS pos FROM timeline GROUP BY job, k)",
        "s AS (SELECT t.job, t.pos, CASE WHEN f.pos IS NULL THEN 0 ELSE 1 END AS new_facts, row_number() OVER (PARTITION BY t.job ORDER BY t.pos) AS no FROM timeline t LEFT JOIN f ON f.job = t.job AND f.pos = t.pos)",
    )
    + """SELECT job AS run, pos AS step, CAST(new_facts AS BIGINT) AS new_facts, no - coalesce(max(CASE WHEN new_facts > 0 THEN no END) OVER (PARTITION BY job ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS stagnant_steps FROM s""",
)
def _(spark, sf):
    log = fx.timeline(spark, sf).select(F.col("job").alias("run"), F.col("pos").alias("step"), F.col("k").alias("fact"))
    return tm.stagnation(log.select("run", "step"), log)


START = 1_704_067_200  # the start of the timeline, in seconds since 1970
STEP_SEC = 6 * 3600


def stamped(log):
    """The timeline with its event time."""
    return log.withColumn("ts", F.timestamp_micros(F.round((F.col("t") + START) * 1_000_000).cast("bigint")))


@query(
    "st_stagnation_stream",
    fx.with_sql(
        "timeline", f"x AS (SELECT job, CAST(floor((t + {START}) / {STEP_SEC}) AS BIGINT) AS step, k FROM timeline)",
        "f AS (SELECT job, k, min(step) AS step FROM x WHERE k IS NOT NULL GROUP BY job, k)", "n AS (SELECT job, step, count(*) AS fresh FROM f GROUP BY job, step)",
        "s AS (SELECT DISTINCT x.job, x.step, coalesce(fresh, 0) AS new_facts FROM x LEFT JOIN n ON n.job = x.job AND n.step = x.step)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY step) AS no FROM s)",
    )
    + """SELECT job AS run, step, new_facts, no - coalesce(max(CASE WHEN new_facts > 0 THEN no END) OVER (PARTITION BY job ORDER BY step ROWS UNBOUNDED PRECEDING), 0) AS stagnant_steps FROM o""",
)
def _(spark, sf):
    """Steps of six hours; rows come up to four hours late and in three parts, behind a watermark of six hours. A last row
    of no run lets the watermark pass the end of all steps."""
    log = stamped(fx.timeline(spark, sf))
    facts = log.select(F.col("job").alias("run"), "ts", F.col("k").alias("fact"), F.floor((F.col("t") + (F.col("pos") % 5) * 3600) / (10 * 86400)).alias("part"))
    end = spark.range(1).select(F.lit(-1).cast("bigint").alias("run"), F.timestamp_seconds(F.lit(4_102_444_800)).alias("ts"), F.lit(None).cast("string").alias("fact"))
    parts = [facts.filter(where).drop("part") for where in ("part <= 0", "part = 1", "part >= 2")]
    out = sinks.run_in_parts([*parts, end], lambda rows: sm.stagnation_stream(rows, STEP_SEC, "6 hours"), scratch(spark, "stagnation"))
    return sinks.read_batches(spark, out, sm.STAGNANT).filter("run >= 0").drop("batch")


# one kind of fact per kind of event; errors stand for the seven rarer kinds by position
FACT = """CASE kind WHEN 'view' THEN concat('text:', k) WHEN 'click' THEN concat('query:', k) WHEN 'purchase' THEN concat('video:', {k_pos}) WHEN 'signup' THEN concat('review:', {k})
  ELSE CASE pos % 7 WHEN 0 THEN concat('candidate:', {k_pos}) WHEN 1 THEN concat('frames:', k) WHEN 2 THEN concat('memory:', k) WHEN 3 THEN concat('confirmation:', {k_pos})
  WHEN 4 THEN concat('detection:', k) WHEN 5 THEN concat('selection:', {k}) ELSE 'finished' END END"""


@query(
    "st_facts",
    fx.with_sql("timeline") + f"SELECT DISTINCT job, {FACT.format(k='sha256(k)', k_pos='sha256(concat(k, chr(1), CAST(pos AS VARCHAR)))')} AS fact FROM timeline",
)
def _(spark, sf):
    keyed = fx.timeline(spark, sf).withColumns({"_k": content_key("k"), "_kp": content_key("k", "pos")})
    return tm.facts(keyed.select("job", F.expr(FACT.format(k="_k", k_pos="_kp")).alias("fact")))


@query(
    "st_scan_progress",
    fx.with_sql("seg", TILES_SQL.format(w=10, c=3), fx.union_sql("u", "seg", "video_id"))
    + """SELECT video_id, count(*) FILTER (c) AS completed_page_count, count(*) AS page_count, min(page_id) FILTER (NOT c) AS next_page,
  round(coalesce(sum(core_end - core_start) FILTER (c), 0) / 64, 6) AS scan_coverage FROM (SELECT t.video_id, concat('p', CAST(t.tile_no AS VARCHAR)) AS page_id, core_start, core_end,
  EXISTS (SELECT 1 FROM u WHERE u.video_id = t.video_id AND u.start_sec <= t.core_start AND u.end_sec >= t.core_end) AS c FROM tiles t) GROUP BY video_id""",
)
def _(spark, sf):
    out = tm.scan_progress(page_rows(spark, sf, 10.0, 3.0), fx.seg(spark, sf), fx.videos(spark, sf), ["video_id"])
    return out.select("video_id", "completed_page_count", "page_count", "next_page", F.round("scan_coverage", 6).alias("scan_coverage"))


# an observation per event, most of them delivered
OBSERVED = ["job AS video_id", "pos AS observation_id", "CAST(pos * 37 % 620 AS DOUBLE) AS start_sec", "CAST(pos * 37 % 620 + 5 + floor(value / 4) AS DOUBLE) AS end_sec", "kind <> 'error' AS sent"]


@query(
    "st_scan_progress_stream",
    fx.with_sql(
        "timeline", f"obs AS (SELECT {', '.join(OBSERVED)} FROM timeline)", fx.union_sql("u", "obs", "video_id", "sent"),
        "pg AS (SELECT video_id, CAST(i AS BIGINT) AS i, i * 10.0::DOUBLE AS core_start, i * 10.0::DOUBLE + 10 AS core_end FROM (SELECT DISTINCT video_id FROM obs), range(64) r(i))",
    )
    + """SELECT c.video_id, count(*) FILTER (c) AS completed_page_count, count(*) AS page_count, min_by(page_id, i) FILTER (NOT c) AS next_page, round(count(*) FILTER (c) * 10 / 640, 6) AS scan_coverage,
  any_value(pending) AS pending_observation_count, count(*) FILTER (NOT c) AS pending_page_count
FROM (SELECT p.video_id, i, concat('p', CAST(i AS VARCHAR)) AS page_id, EXISTS (SELECT 1 FROM u WHERE u.video_id = p.video_id AND u.start_sec <= p.core_start AND u.end_sec >= p.core_end) AS c FROM pg p) c
JOIN (SELECT video_id, count(*) FILTER (NOT sent) AS pending FROM obs GROUP BY video_id) o ON o.video_id = c.video_id GROUP BY c.video_id""",
)
def _(spark, sf):
    """Observations are made and delivered in separate rows; a third of the deliveries come before their observations."""
    obs = fx.timeline(spark, sf).selectExpr(*OBSERVED)
    told = lambda where, delivered: obs.filter(where).drop("sent").withColumn("delivered", F.lit(delivered))
    early, late = "observation_id % 3 = 0", "observation_id % 3 > 0"
    parts = [told(f"{early} AND sent", True).unionByName(told(late, False)), told(early, False).unionByName(told(f"{late} AND sent", True))]
    out = sinks.run_in_parts(parts, sp.watched_stream, scratch(spark, "progress"))
    watched = sinks.newest_groups(spark, out, sp.WATCHED, ["video_id", "slice"])
    videos = obs.select("video_id").distinct().withColumn("duration_sec", F.lit(640.0))
    grid = videos.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    pages = grid.select(
        "video_id", F.concat(F.lit("p"), "i").alias("page_id"), (F.col("i") * 10.0).alias("core_start_sec"), (F.col("i") * 10.0 + 10).alias("core_end_sec"),
    )
    return sp.progress_of(watched, pages, videos).select(
        "video_id", "completed_page_count", "page_count", "next_page", F.round("scan_coverage", 6).alias("scan_coverage"), "pending_observation_count", "pending_page_count",
    )


CUT = 15 * 86400  # the first part ends here
DELAY = 2 * 86400


@query(
    "st_trace_counts_stream",
    fx.with_sql(
        "timeline", RUNLOG_SQL.replace("AS error FROM", "AS error, t FROM").split(",\nattempts")[0],
        f"b0 AS (SELECT * FROM trace WHERE t < {CUT} AND pos % 17 > 0)",
        f"b1 AS (SELECT * FROM trace WHERE t >= {CUT} OR pos % 17 = 0 UNION ALL SELECT * FROM b0 WHERE pos % 10 = 0)",
        "w AS (SELECT job, pos % 4 AS part, max(t) AS latest FROM b0 GROUP BY ALL)",
        f"""j AS (SELECT b1.*, coalesce(b1.t < latest - {DELAY}, FALSE) AS late, EXISTS (SELECT 1 FROM b0 WHERE b0.pos = b1.pos) AS again FROM b1 LEFT JOIN w ON w.job = b1.job AND w.part = b1.pos % 4
  UNION ALL SELECT *, FALSE, FALSE FROM b0)""",
        "g AS (SELECT *, NOT late AND NOT again AS good FROM j)",
    )
    + """SELECT job, count(*) FILTER (good AND kind = 'request_error') AS request_errors, count(*) FILTER (good AND kind = 'tool' AND error) AS invalid_tool_requests,
  count(*) FILTER (good AND kind = 'model' AND calls_empty) AS missing_tool_calls, count(*) FILTER (good AND elapsed_sec IS NOT NULL AND kind IN ('model', 'perception_model')) AS requests,
  round(coalesce(sum(elapsed_sec) FILTER (good AND kind IN ('model', 'perception_model')), 0), 4) AS request_sec, count(*) FILTER (NOT late AND again) AS repeated, count(*) FILTER (late) AS late FROM g GROUP BY job""",
)
def _(spark, sf):
    """The second part repeats some rows and brings others that were held back."""
    log = stamped(fx.timeline(spark, sf).filter("kind <> 'signup'"))
    trace = log.selectExpr(*RUNLOG, "ts", "t").withColumnRenamed("pos", "id")
    first = trace.filter(f"t < {CUT} AND id % 17 > 0")
    second = trace.filter(f"t >= {CUT} OR id % 17 = 0").unionByName(first.filter("id % 10 = 0"))
    out = sinks.run_in_parts([first.drop("t"), second.drop("t")], lambda rows: sm.trace_counts_stream(rows, DELAY, F.col("id") % 4), scratch(spark, "trace"))
    hours = sinks.newest_groups(spark, out, sm.TRACED, ["job", "part", "hour"])
    sums = [c for c in sm.TRACED.names if c not in ("job", "part", "hour")]
    return hours.groupBy("job").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("request_sec", F.round("request_sec", 4))


@query(
    "st_trace_counts",
    fx.with_sql("timeline", RUNLOG_SQL)
    + """SELECT job, count(*) FILTER (kind = 'request_error') AS request_errors, count(*) FILTER (kind = 'tool' AND error) AS invalid_tool_requests,
  count(*) FILTER (kind = 'model' AND calls_empty) AS missing_tool_calls, count(*) FILTER (elapsed_sec IS NOT NULL AND kind IN ('model', 'perception_model')) AS requests,
  round(sum(elapsed_sec) FILTER (kind IN ('model', 'perception_model')), 4) AS request_sec FROM trace GROUP BY job""",
)
def _(spark, sf):
    _, trace = run_log(spark, sf)
    return tm.trace_counts(trace, ["job"]).withColumn("request_sec", F.round("request_sec", 4))


@query(
    "st_attempt_status",
    fx.with_sql("timeline", RUNLOG_SQL, "l AS (SELECT job, max_by(status, attempt_no) AS s, count(*) AS n FROM attempts GROUP BY job)")
    + """SELECT c_custkey AS job, CASE WHEN coalesce(s, 'not_started') IN ('failed', 'running') THEN s WHEN c_custkey % 3 = 0 THEN 'complete' ELSE coalesce(s, 'not_started') END AS status,
  coalesce(n, 0) AS attempts FROM customer LEFT JOIN l ON l.job = c_custkey""",
)
def _(spark, sf):
    items = fx.table(spark, sf, "customer").selectExpr("c_custkey AS job")
    attempts, _ = run_log(spark, sf)
    results = items.filter("job % 3 = 0").withColumn("completion", F.lit("complete"))
    return tm.attempt_status(items, attempts, results, ["job"])
