"""Ordered operators: ranks, lags, prefixes, pages, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import editing, selection, store, telemetry
from ..operators.ordered import exact_median, nearest_rank
from ..operators.search import page, page_info
from . import fixtures as fx
from .catalog_intervals import JOBS_SQL, jobs
from .registry import query


@query(
    "wf_review_queue",
    fx.with_sql("videos", "ap AS (SELECT drama_id, count(*) AS approved FROM videos WHERE status = 'ready' AND source = 'model_reviewed' GROUP BY drama_id)")
    + """SELECT video_id, priority, approved, row_number() OVER (ORDER BY priority DESC, approved, duration_sec, video_id) AS queue_rank FROM
  (SELECT video_id, video_id % 5 AS priority, coalesce(approved, 0) AS approved, price % 60 + 1 AS duration_sec FROM videos LEFT JOIN ap USING (drama_id) WHERE status IN ('queued', 'review'))""",
)
def _(spark, sf):
    v = fx.videos(spark, sf).withColumns({"priority": F.col("video_id") % 5, "duration_sec": F.col("price") % 60 + 1})
    return store.review_queue(v).select("video_id", "priority", "approved", "queue_rank")


@query(
    "wf_latest",
    """SELECT l_suppkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_extendedprice DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem")
    return store.latest(
        rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_extendedprice", "l_partkey"], ["l_partkey", "l_extendedprice"]
    )


@query(
    "wf_step_delta",
    fx.with_sql(
        "timeline",
        "r AS (SELECT job AS run, pos, CAST(k AS BIGINT) % 3 AS step, t AS elapsed, value AS epoch FROM timeline)",
        "l AS (SELECT *, lag(step) OVER w AS ps, elapsed - lag(elapsed) OVER w AS sec, (epoch - lag(epoch) OVER w) * 100 AS win FROM r WINDOW w AS (PARTITION BY run ORDER BY pos))",
    )
    + """SELECT run, pos, CASE WHEN step = ps + 1 AND sec > 0 AND win > 0 THEN round(sec, 6) END AS seconds_per_update,
  CASE WHEN step = ps + 1 AND sec > 0 AND win > 0 THEN round(win / sec, 6) END AS windows_per_second FROM l""",
)
def _(spark, sf):
    rows = fx.timeline(spark, sf).select(
        F.col("job").alias("run"), "pos", (F.col("k").cast("bigint") % 3).alias("step"), F.col("t").alias("elapsed_sec"), F.col("value").alias("epoch")
    )
    out = telemetry.step_speed(rows, 100.0)
    return out.select("run", "pos", F.round("seconds_per_update", 6).alias("seconds_per_update"), F.round("windows_per_second", 6).alias("windows_per_second"))


@query(
    "wf_overlap_consecutive",
    fx.with_sql("seg")
    + """SELECT video_id, seg_no, prev_end FROM (SELECT *, lag(end_sec) OVER (PARTITION BY video_id ORDER BY start_sec, seg_no) AS prev_end FROM seg) WHERE prev_end > start_sec""",
)
def _(spark, sf):
    return selection.consecutive_overlaps(fx.seg(spark, sf), ["video_id"], ["seg_no"]).select("video_id", "seg_no", "prev_end")


@query(
    "wf_percentile",
    fx.with_sql("timeline", "r AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS rn, count(*) OVER (PARTITION BY kind) AS n FROM timeline)")
    + "SELECT kind, max(value) FILTER (rn = ceil(0.9 * n)) AS p90, round(median(value), 6) AS median FROM r GROUP BY kind",
)
def _(spark, sf):
    rows = fx.timeline(spark, sf)
    p90 = nearest_rank(rows, ["kind"], "value", 0.9, "p90", 5.0)
    median = exact_median(rows, ["kind"], "value", "median", 5.0)
    return p90.join(median, "kind").withColumn("median", F.round("median", 6))


@query(
    "wf_budget_prefix",
    fx.with_sql("b AS (SELECT lang AS source, doc_id, n_chars FROM documents UNION ALL SELECT source, doc_id, n_chars * (1 + doc_id % 9) FROM documents)",
        "r AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS no FROM b)")
    + "SELECT source, doc_id, CAST(running AS BIGINT) AS running, running > 20000 AS overflow FROM r WHERE running <= 20000 OR no = 1",
)
def _(spark, sf):
    docs = fx.table(spark, sf, "documents")
    # sources under other sizes too, so that some begin with a row beyond the budget
    rows = docs.select(F.col("lang").alias("source"), "doc_id", "n_chars").unionByName(
        docs.select("source", "doc_id", F.expr("n_chars * (1 + doc_id % 9)").alias("n_chars"))
    )
    out = telemetry.budget_prefix(rows, ["source"], "doc_id", "n_chars", 20_000, block=1000)
    return out.filter("fits OR overflow").select("source", "doc_id", "running", "overflow")


@query(
    "wf_merge_adjacent_check",
    fx.with_sql("seg", "r AS (SELECT video_id, kind, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, CAST(seg_no AS VARCHAR)) AS p FROM seg)")
    + "SELECT video_id AS job_id, kind AS command_no, count(*) AS targets, max(p) - min(p) + 1 = count(*) AS adjacent FROM r GROUP BY video_id, kind",
)
def _(spark, sf):
    rows = fx.seg(spark, sf).select(
        F.col("video_id").alias("job_id"), F.col("seg_no").cast("string").alias("highlight_id"), "start_sec", "end_sec", F.col("kind").alias("command_no")
    )
    return editing.merge_adjacency(rows.drop("command_no"), rows.select("job_id", "command_no", "highlight_id"))


@query(
    "ord_page",
    """SELECT doc_id, n_chars, NULL::BIGINT AS total, NULL::BIGINT AS next_offset FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 20)
UNION ALL SELECT NULL, NULL, count(*), CASE WHEN count(*) > 70 THEN 70 END FROM documents""",
)
def _(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    shown = page(rows, [F.col("n_chars").desc(), F.col("doc_id")], 20, 50)
    return shown.unionByName(page_info(rows, 20, 50), allowMissingColumns=True)


@query("ord_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return page(rows, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 0, 100)


@query(
    "ord_archive",
    f"""WITH {JOBS_SQL} SELECT job_id, name, status, created FROM jobs
WHERE (status IN ('queued', 'processing') OR (status = 'completed' AND completion = 'partial')) AND contains(lower(concat(name, ' ', CAST(job_id AS VARCHAR))), 'urgent')""",
)
def _(spark, sf):
    shown = editing.archive(jobs(spark, sf), ["active", "partial"], " URGENT ", ["name", "job_id"])
    return shown.select("job_id", "name", "status", "created")


@query(
    "set_union",
    fx.with_sql("seg") + "SELECT video_id, seg_no, kind FROM seg WHERE side = 0 AND kind <> 'uncertain' UNION ALL SELECT video_id, seg_no, kind FROM seg WHERE side = 1",
)
def _(spark, sf):
    seg = fx.seg(spark, sf).select("video_id", "seg_no", "kind", "side")
    return seg.filter("side = 0 AND kind <> 'uncertain'").unionByName(seg.filter("side = 1")).drop("side")


@query("set_intersect", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem").selectExpr("l_partkey AS id", "l_returnflag AS f")
    return rows.filter("f = 'A'").select("id").intersect(rows.filter("f = 'N'").select("id"))


@query("set_except", "SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def _(spark, sf):
    wanted = fx.table(spark, sf, "orders").selectExpr("o_orderkey AS id")
    return wanted.subtract(fx.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").selectExpr("l_orderkey AS id"))
