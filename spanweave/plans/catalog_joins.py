"""Interval, as-of, keyed and checking joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import iou
from ..operators import asof, editing, rangejoin, selection, store, telemetry  # noqa: F401
from ..operators.intervalsets import union_spans
from ..operators.tiles import tiles
from ..sources.subtitles import pair_files
from . import fixtures as fx
from . import windows as wn
from .registry import query


def renamed(df, tag, *keep):
    return df.select(
        "video_id", F.col("seg_no").alias(f"{tag}_no"), F.col("start_sec").alias(f"{tag}_start"),
        F.col("end_sec").alias(f"{tag}_end"), *[F.col(c).alias(f"{tag}_{c}") for c in keep],
    )


@query(
    "jn_overlap",
    fx.with_sql("seg")
    + """SELECT a.video_id, a.seg_no AS a_no, b.seg_no AS b_no,
  least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec) AS overlap_sec
FROM seg a JOIN seg b ON a.video_id = b.video_id AND a.seg_no < b.seg_no AND a.start_sec < b.end_sec AND b.start_sec < a.end_sec""",
)
def _(spark, sf):
    seg = fx.seg(spark, sf)
    pairs = rangejoin.overlap_join(
        renamed(seg, "a"), renamed(seg, "b"), ["video_id"], left_span=("a_start", "a_end"), right_span=("b_start", "b_end"),
        residual=F.col("a_no") < F.col("b_no"),
    )
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return pairs.select("video_id", "a_no", "b_no", shared.alias("overlap_sec"))


@query(
    "jn_self_conflict",
    fx.with_sql("seg")
    + """SELECT a.video_id, a.seg_no AS a_no, b.seg_no AS b_no,
  CASE WHEN a.kind <> b.kind THEN 'different_kinds' ELSE 'overlapping_highlights' END AS reason,
  least(a.start_sec, b.start_sec) AS hull_start, greatest(a.end_sec, b.end_sec) AS hull_end
FROM seg a JOIN seg b ON a.video_id = b.video_id AND a.seg_no < b.seg_no AND a.start_sec < b.end_sec AND b.start_sec < a.end_sec
WHERE a.kind <> b.kind OR a.kind = 'positive'""",
)
def _(spark, sf):
    seg = fx.seg(spark, sf)
    differ = F.col("a_kind") != F.col("b_kind")
    pairs = rangejoin.overlap_join(
        renamed(seg, "a", "kind"), renamed(seg, "b", "kind"), ["video_id"], left_span=("a_start", "a_end"),
        right_span=("b_start", "b_end"), residual=(F.col("a_no") < F.col("b_no")) & (differ | (F.col("a_kind") == "positive")),
    )
    return pairs.select(
        "video_id", "a_no", "b_no", F.when(differ, "different_kinds").otherwise("overlapping_highlights").alias("reason"),
        F.least("a_start", "b_start").alias("hull_start"), F.greatest("a_end", "b_end").alias("hull_end"),
    )


def sides(spark, sf):
    """(predictions, targets) of the segment table."""
    seg = fx.seg(spark, sf)
    return renamed(seg.filter("side = 1"), "p", "kind"), renamed(seg.filter("side = 0"), "t", "kind")


def iou_edges(spark, sf, threshold):
    p, t = sides(spark, sf)
    return rangejoin.candidate_edges(
        p, t, ["video_id"], lambda: iou("p_start", "p_end", "t_start", "t_end"), threshold
    ).withColumns({"h_start": F.least("p_start", "t_start"), "h_end": F.greatest("p_end", "t_end")})


EDGES_SQL = """edges AS (SELECT p.video_id, p.seg_no AS p_no, t.seg_no AS t_no, p.kind AS p_kind, t.kind AS t_kind,
  p.start_sec AS p_start, p.end_sec AS p_end, t.start_sec AS t_start, t.end_sec AS t_end,
  (least(p.end_sec, t.end_sec) - greatest(p.start_sec, t.start_sec)) / (greatest(p.end_sec, t.end_sec) - least(p.start_sec, t.start_sec)) AS similarity
  FROM seg p JOIN seg t ON p.video_id = t.video_id AND p.side = 1 AND t.side = 0
  WHERE p.start_sec < t.end_sec AND t.start_sec < p.end_sec)"""


@query(
    "jn_candidates",
    fx.with_sql("seg", EDGES_SQL)
    + "SELECT video_id, p_no, t_no, round(similarity, 6) AS similarity FROM edges WHERE similarity >= 0.5",
)
def _(spark, sf):
    return iou_edges(spark, sf, 0.5).select("video_id", "p_no", "t_no", F.round("similarity", 6).alias("similarity"))


TILES_SQL = """tiles AS (SELECT video_id, i AS tile_no, i * {w}.0::DOUBLE AS core_start, least(64.0, (i + 1) * {w})::DOUBLE AS core_end,
  greatest(0.0, i * {w} - {c})::DOUBLE AS read_start, least(64.0, (i + 1) * {w} + {c})::DOUBLE AS read_end
  FROM (SELECT o_orderkey AS video_id, unnest(range(0, CAST(ceil(64.0 / {w}) AS BIGINT))) AS i FROM orders))"""


@query(
    "jn_midpoint_window",
    fx.with_sql("seg", TILES_SQL.format(w=10, c=10))
    + """SELECT s.video_id, s.seg_no, t.tile_no FROM seg s JOIN tiles t ON s.video_id = t.video_id
  AND (s.start_sec + s.end_sec) / 2 >= t.core_start AND (s.start_sec + s.end_sec) / 2 < t.core_end""",
)
def _(spark, sf):
    grid = tiles(fx.videos(spark, sf).select("video_id", "duration_sec"), 10.0, 10.0)
    hits = wn.midpoint_windows(fx.seg(spark, sf), grid.select("video_id", "tile_no", "core_start", "core_end"), 10.0)
    return hits.select("video_id", "seg_no", "tile_no")


@query(
    "jn_dialogue_window",
    fx.with_sql("dialogues", TILES_SQL.format(w=10, c=10))
    + """SELECT t.video_id, t.tile_no, count(*) AS lines, string_agg(CAST(CAST(d.start_sec - t.read_start AS BIGINT) AS VARCHAR), ','
  ORDER BY d.start_sec) AS starts FROM tiles t JOIN dialogues d ON d.video_id = t.video_id
  AND d.start_sec >= greatest(0, t.read_start - 20) AND d.end_sec <= t.read_end GROUP BY t.video_id, t.tile_no""",
)
def _(spark, sf):
    options = wn.WindowOptions(10.0, 10.0, 20.0)
    grid = tiles(fx.videos(spark, sf).select("video_id", "duration_sec"), 10.0, 10.0)
    out = wn.window_dialogue(grid, fx.dialogues(spark, sf), options).filter(F.size("dialogue") > 0)
    starts = F.transform("dialogue", lambda x: x["start_sec"].cast("bigint").cast("string"))
    return out.select("video_id", "tile_no", F.size("dialogue").cast("bigint").alias("lines"), F.array_join(starts, ",").alias("starts"))


def frames(spark, sf):
    return fx.timeline(spark, sf).filter("kind = 'view'").select("job", F.col("t").alias("pts"))


def requests(spark, sf):
    return fx.timeline(spark, sf).filter("kind = 'click'").select(
        "job", "pos", F.col("t").alias("start_sec"), (F.col("t") + F.col("value") * 100).alias("end_sec")
    )


FRAMES_SQL = """frames AS (SELECT job, t AS pts FROM timeline WHERE kind = 'view'),
requests AS (SELECT job, pos, t AS start_sec, t + value * 100 AS end_sec FROM timeline WHERE kind = 'click'),
ends AS (SELECT job, max(t) + 40000 AS duration_sec FROM timeline GROUP BY job)"""


def ends(spark, sf):
    return fx.timeline(spark, sf).groupBy("job").agg((F.max("t") + 40000).alias("duration_sec"))


@query(
    "jn_frame_floor",
    fx.with_sql("timeline", FRAMES_SQL)
    + """SELECT r.job, r.pos, round(coalesce(f.pts, m.pts), 6) AS frame_start FROM requests r
  ASOF LEFT JOIN frames f ON r.job = f.job AND r.start_sec >= f.pts
  LEFT JOIN (SELECT job, min(pts) AS pts FROM frames GROUP BY job) m ON m.job = r.job""",
)
def _(spark, sf):
    out = asof.frame_floor(requests(spark, sf), frames(spark, sf), ["job"], ["pos"], "start_sec", slice_sec=86400.0)
    return out.withColumn("frame_start", F.round("frame_start", 6))


@query(
    "jn_frame_ceil",
    fx.with_sql("timeline", FRAMES_SQL)
    + """SELECT r.job, r.pos, round(coalesce(f.pts, e.duration_sec), 6) AS frame_end FROM requests r
  ASOF LEFT JOIN frames f ON r.job = f.job AND r.start_sec <= f.pts LEFT JOIN ends e ON e.job = r.job""",
)
def _(spark, sf):
    out = asof.frame_ceil(
        requests(spark, sf), frames(spark, sf), ["job"], ["pos"], "start_sec", durations=ends(spark, sf), slice_sec=86400.0
    )
    return out.withColumn("frame_end", F.round("frame_end", 6))


SNAP_SQL = """snap AS (SELECT r.job, r.pos, r.start_sec, r.end_sec, coalesce(f.pts, m.pts) AS s, coalesce(g.pts, e.duration_sec) AS e FROM requests r
  ASOF LEFT JOIN frames f ON r.job = f.job AND r.start_sec >= f.pts
  ASOF LEFT JOIN frames g ON r.job = g.job AND r.end_sec <= g.pts
  LEFT JOIN (SELECT job, min(pts) AS pts FROM frames GROUP BY job) m ON m.job = r.job LEFT JOIN ends e ON e.job = r.job),
gaps AS (SELECT f.job, f.pts, coalesce(lead(f.pts) OVER (PARTITION BY f.job ORDER BY f.pts), e.duration_sec) - f.pts AS gap
  FROM frames f JOIN ends e ON e.job = f.job)"""


@query(
    "jn_frame_snap",
    fx.with_sql("timeline", FRAMES_SQL, SNAP_SQL)
    + """SELECT s.job, s.pos, round(s.s, 6) AS src_start_sec, round(s.e, 6) AS src_end_sec, round(max(g.gap), 6) AS precision_sec
FROM snap s LEFT JOIN gaps g ON g.job = s.job AND g.pts >= s.s AND g.pts < s.e GROUP BY s.job, s.pos, s.s, s.e""",
)
def _(spark, sf):
    out = asof.frame_snap(
        requests(spark, sf), frames(spark, sf), ends(spark, sf), ["job"], ["pos"], slice_sec=86400.0, bucket_sec=43200.0
    )
    return out.select("job", "pos", *[F.round(c, 6).alias(c) for c in ("src_start_sec", "src_end_sec", "precision_sec")])


@query(
    "jn_point_in_range",
    fx.with_sql("timeline")
    + """SELECT n.job, n.pos FROM timeline n WHERE n.kind = 'error' AND EXISTS (SELECT 1 FROM timeline c WHERE c.kind = 'purchase'
  AND c.job = n.job AND n.t >= c.t AND n.t <= c.t + c.value * 600)""",
)
def _(spark, sf):
    log = fx.timeline(spark, sf)
    notes = log.filter("kind = 'error'").select("job", "pos", F.col("t").alias("n_start"), F.col("t").alias("n_end"))
    ranges = log.filter("kind = 'purchase'").select("job", F.col("t").alias("c_start"), (F.col("t") + F.col("value") * 600).alias("c_end"))
    # lying in any range is lying in their union, which holds no overlapping ranges; single points are no spans to unite
    united = union_spans(ranges, ["job"], "c_start", "c_end", slice_sec=86400.0).unionByName(ranges.filter("c_start = c_end").distinct())
    hits = rangejoin.contained_join(
        united, notes, ["job"], outer_span=("c_start", "c_end"), inner_span=("n_start", "n_end"), bucket_sec=3600.0
    ).select("job", "pos").distinct()
    return notes.select("job", "pos").join(hits, ["job", "pos"], "left_semi")


@query(
    "jn_evidence_notes",
    fx.with_sql("seg")
    + """SELECT i.video_id, i.seg_no FROM seg i WHERE i.side = 1 AND EXISTS (SELECT 1 FROM seg e WHERE e.video_id = i.video_id
  AND e.side = 0 AND e.kind = 'positive' AND i.end_sec > e.start_sec AND i.start_sec < e.end_sec)""",
)
def _(spark, sf):
    seg = fx.seg(spark, sf)
    items = seg.filter("side = 1").select("video_id", "seg_no", "start_sec", "end_sec")
    # overlapping any cited span is overlapping their union, which is disjoint per observation
    cited = union_spans(
        seg.filter("side = 0 AND kind = 'positive'").selectExpr("video_id", "start_sec AS r_start_sec", "end_sec AS r_end_sec"),
        ["video_id"], "r_start_sec", "r_end_sec",
    )
    return rangejoin.overlap_semi(items, cited, ["video_id"], ["video_id", "seg_no"]).select("video_id", "seg_no")


@query(
    "jn_evidence_check",
    fx.with_sql("seg", "videos")
    + """SELECT s.video_id, s.seg_no, CASE WHEN v.video_id IS NULL OR v.status = 'queued' THEN 'not_delivered'
  WHEN NOT (s.start_sec >= 5 AND s.end_sec <= 50) THEN 'outside_observation'
  WHEN NOT (s.start_sec >= 2 AND s.end_sec <= 45) THEN 'outside_candidate' END AS violation
FROM seg s LEFT JOIN (SELECT * FROM videos WHERE status <> 'review') v ON v.video_id = s.video_id""",
)
def _(spark, sf):
    spans = fx.seg(spark, sf).select(
        "video_id", "seg_no", F.col("video_id").alias("observation_id"), "start_sec", "end_sec",
        F.lit(2.0).alias("cand_start"), F.lit(45.0).alias("cand_end"),
    )
    seen = fx.videos(spark, sf).filter("status <> 'review'").select(
        "video_id", F.col("video_id").alias("observation_id"), F.lit(5.0).alias("src_start_sec"),
        F.lit(50.0).alias("src_end_sec"), (F.col("status") != "queued").alias("delivered"),
    )
    return selection.evidence_violations(spans, seen, ["video_id"]).select("video_id", "seg_no", "violation")


@query(
    "jn_current_label",
    """WITH p AS (SELECT l_orderkey, concat('m', CAST(l_suppkey AS VARCHAR)) AS model_id, l_extendedprice,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem)
SELECT o.o_orderkey AS video_id, a.o_orderpriority AS source, p.model_id, p.l_extendedprice AS predicted FROM orders o
LEFT JOIN orders a ON a.o_orderkey = o.o_orderkey AND o.o_orderkey % 5 <> 0 LEFT JOIN p ON p.l_orderkey = o.o_orderkey AND p.rn = 1""",
)
def _(spark, sf):
    o = fx.table(spark, sf, "orders")
    videos = o.selectExpr("o_orderkey AS video_id", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS label_id")
    annotations = o.selectExpr("o_orderkey AS label_id", "o_orderkey AS video_id", "o_orderpriority AS source")
    predictions = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS video_id", "concat('m', l_suppkey) AS model_id", "l_extendedprice AS segments",
        "l_shipdate AS created_at", f"{fx.SEG_NO} AS row_no",
    )
    return store.current_labels(videos, annotations, predictions).select("video_id", "source", "model_id", "predicted")


@query(
    "jn_cover_check",
    """SELECT coalesce(e.id, p.id) AS sample_id, coalesce(p.n, 0) AS predictions, e.id IS NOT NULL AS expected
FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P') e
FULL JOIN (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey) p ON p.id = e.id
WHERE e.id IS NULL OR p.id IS NULL OR p.n <> 1""",
)
def _(spark, sf):
    expected = fx.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").selectExpr("o_orderkey AS sample_id")
    records = fx.table(spark, sf, "lineitem").selectExpr("l_orderkey AS sample_id")
    return store.cover_violations(expected, records, "sample_id")


@query(
    "jn_eval_dataset",
    """WITH m AS (SELECT o_orderkey AS video_id, CASE WHEN o_custkey % 50 = 0 THEN 0.0 WHEN o_custkey % 3 = 0 THEN 55.0 ELSE 64.0 END AS d FROM orders),
a AS (SELECT o_orderkey + 3 AS video_id, o_orderstatus AS s FROM orders), l AS (SELECT DISTINCT video_id FROM a WHERE s IN ('O', 'F')),
c AS (SELECT m.* FROM m JOIN l USING (video_id)),
e AS (SELECT l_orderkey AS video_id, l_linenumber AS event_id, l_quantity AS s, l_quantity + 4 + l_linenumber AS e, c.d FROM lineitem JOIN c ON c.video_id = l_orderkey)
SELECT video_id, 'missing_from_manifest' AS reason FROM l WHERE video_id NOT IN (SELECT video_id FROM m)
UNION SELECT video_id, 'invalid_duration' FROM c WHERE d <= 0
UNION SELECT video_id, 'invalid_interval' FROM e WHERE NOT (s >= 0 AND s < e AND e <= d + 0.1)
UNION SELECT video_id, 'duplicate_event_id' FROM e GROUP BY video_id, event_id HAVING count(*) > 1""",
)
def _(spark, sf):
    o = fx.table(spark, sf, "orders")
    manifest = o.selectExpr(
        "o_orderkey AS video_id",
        "CAST(CASE WHEN o_custkey % 50 = 0 THEN 0 WHEN o_custkey % 3 = 0 THEN 55 ELSE 64 END AS DOUBLE) AS duration_sec",
    )
    annotations = o.selectExpr("o_orderkey + 3 AS video_id", "o_orderstatus AS annotation_status")
    events = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS video_id", "l_linenumber AS event_id", "l_quantity AS start_sec", "l_quantity + 4 + l_linenumber AS end_sec"
    )
    return store.eval_dataset_violations(manifest, annotations, events, ["O", "F"])


@query("jn_pending", "SELECT o_orderkey AS sample_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf):
    work = fx.table(spark, sf, "orders").selectExpr("o_orderkey AS sample_id")
    return store.pending(work, fx.table(spark, sf, "lineitem").selectExpr("l_orderkey AS sample_id"), "sample_id")


@query(
    "jn_group_leak",
    """SELECT c_nationkey AS drama_id, min(sp) AS first_split, max(sp) AS last_split FROM (SELECT c_nationkey,
  CASE WHEN c_custkey % 10 < 8 THEN 'train' WHEN c_custkey % 10 = 8 THEN 'val' ELSE 'test' END AS sp FROM customer)
GROUP BY c_nationkey HAVING count(DISTINCT sp) > 1""",
)
def _(spark, sf):
    rows = fx.table(spark, sf, "customer").selectExpr(
        "c_nationkey AS drama_id",
        "CASE WHEN c_custkey % 10 < 8 THEN 'train' WHEN c_custkey % 10 = 8 THEN 'val' ELSE 'test' END AS split",
    )
    return store.group_leaks(rows)


# past positives: prediction-side rows; labels: target-side rows
HISTORY_SQL = (
    fx.union_sql("neg", "seg", "video_id", "side = 0 AND kind = 'negative'")
    + """,
cand AS (SELECT DISTINCT video_id, start_sec, end_sec FROM seg WHERE side = 1),
clear AS (SELECT c.* FROM cand c WHERE EXISTS (SELECT 1 FROM neg n WHERE n.video_id = c.video_id AND n.start_sec <= c.start_sec AND n.end_sec >= c.end_sec)
  AND NOT EXISTS (SELECT 1 FROM seg p WHERE p.side = 0 AND p.kind = 'positive' AND p.video_id = c.video_id AND p.start_sec < c.end_sec AND c.start_sec < p.end_sec)),
"""
    + fx.union_sql("regions", "clear", "video_id")
)


def regions(spark, sf):
    seg = fx.seg(spark, sf)
    return wn.history_regions(seg.filter("side = 0"), seg.filter("side = 1"))


@query("jn_history_regions", fx.with_sql("seg", HISTORY_SQL) + "SELECT * FROM regions")
def _(spark, sf):
    return regions(spark, sf)


@query(
    "jn_focus_windows",
    fx.with_sql("seg", HISTORY_SQL, TILES_SQL.format(w=10, c=10))
    + """SELECT DISTINCT t.video_id, t.tile_no FROM tiles t JOIN regions r ON r.video_id = t.video_id
  AND r.start_sec < t.core_end AND t.core_start < r.end_sec""",
)
def _(spark, sf):
    grid = tiles(fx.videos(spark, sf).select("video_id", "duration_sec"), 10.0, 10.0)
    return wn.focus_windows(grid, regions(spark, sf)).select("video_id", "tile_no")


@query(
    "jn_plan_event",
    """SELECT l_orderkey AS job_id, concat('e', CAST(l_linenumber AS VARCHAR)) AS event_id, CAST(l_partkey AS BIGINT) AS plan_no,
  CASE WHEN o_orderkey IS NULL OR l_linenumber > 5 THEN 'unknown_event' WHEN o_orderstatus = 'F' THEN 'event_not_supported'
  WHEN l_suppkey % 3 <> 0 THEN 'stale_event_version' WHEN l_quantity < 10 THEN 'stale_required_spans' END AS mismatch
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""",
)
def _(spark, sf):
    span = "array(named_struct('start_sec', {}, 'end_sec', 60D))"
    plans = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS job_id", "concat('e', l_linenumber) AS event_id", "l_partkey AS plan_no",
        "l_suppkey % 3 AS event_version", span.format("CASE WHEN l_quantity < 10 THEN 1D ELSE 0D END") + " AS required_spans",
    )
    events = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS job_id", "explode(sequence(1, 5)) AS n", "CASE WHEN o_orderstatus = 'F' THEN 'pending' ELSE 'supported' END AS status",
        "0L AS version", span.format("0D") + " AS required_spans",
    ).withColumn("event_id", F.concat(F.lit("e"), F.col("n")))
    return selection.plan_mismatch(plans, events, ["job_id"]).select("job_id", "event_id", "plan_no", "mismatch")


@query(
    "jn_subtitle_pair",
    """WITH v AS (SELECT o_custkey AS batch, concat('V', CAST(o_orderkey % 97 AS VARCHAR), '.MP4') AS name, concat('v', CAST(o_orderkey % 97 AS VARCHAR)) AS base FROM orders),
s AS (SELECT DISTINCT c_custkey AS batch, concat('v', CAST(n * 3 AS VARCHAR), '.', ext) AS name, concat('v', CAST(n * 3 AS VARCHAR)) AS base
  FROM customer, (SELECT unnest(range(0, 12)) AS n) r, (SELECT unnest(['srt', 'vtt']) AS ext) e WHERE ext = 'srt' OR n < 3),
nv AS (SELECT batch, count(*) AS n FROM v GROUP BY batch), ns AS (SELECT batch, count(*) AS n FROM s GROUP BY batch),
one AS (SELECT batch FROM nv JOIN ns USING (batch) WHERE nv.n = 1 AND ns.n = 1),
k AS (SELECT batch, base, count(*) AS n, min(name) AS subtitle FROM s GROUP BY batch, base)
SELECT v.batch, v.name, CASE WHEN k.n = 1 THEN k.subtitle END AS subtitle, CASE WHEN k.n > 1 THEN 'ambiguous' END AS problem
  FROM v LEFT JOIN k ON k.batch = v.batch AND k.base = v.base WHERE v.batch NOT IN (SELECT batch FROM one)
UNION ALL SELECT s.batch, s.name, NULL, 'unmatched' FROM s WHERE s.batch NOT IN (SELECT batch FROM one) AND NOT EXISTS (SELECT 1 FROM v WHERE v.batch = s.batch AND v.base = s.base)
UNION ALL SELECT v.batch, v.name, s.name, NULL FROM v JOIN one USING (batch) JOIN s ON s.batch = v.batch""",
)
def _(spark, sf):
    videos = fx.table(spark, sf, "orders").selectExpr("o_custkey AS batch", "concat('V', o_orderkey % 97, '.MP4') AS name")
    subtitles = (
        fx.table(spark, sf, "customer").selectExpr("c_custkey AS batch", "explode(sequence(0, 11)) AS n")
        .selectExpr("batch", "n", "explode(CASE WHEN n < 3 THEN array('srt', 'vtt') ELSE array('srt') END) AS ext")
        .selectExpr("batch", "concat('v', n * 3, '.', ext) AS name")
    )
    pairs, problems = pair_files(videos, subtitles)
    none = F.lit(None).cast("string")
    return pairs.select("batch", F.col("video").alias("name"), "subtitle", none.alias("problem")).unionByName(
        problems.select("batch", "name", none.alias("subtitle"), "problem")
    )


# two revisions of a highlight list: some moved, some renamed, some new, some jobs stale
LOCAL = [
    "l_orderkey AS job_id", f"CAST({fx.SEG_NO} AS STRING) AS highlight_id", "CAST(l_quantity AS DOUBLE) AS start_sec",
    "CAST(l_quantity + 9 AS DOUBLE) AS end_sec", "l_returnflag AS description", "l_linestatus AS reason",
    "CASE WHEN l_linenumber % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS review_status", "concat('u', l_partkey) AS clip_url",
    "1L AS revision", "l_linenumber AS line", "l_suppkey AS supp",
]
REMOTE_START = "start_sec + CASE WHEN supp % 3 = 0 THEN 1 ELSE 0 END"
REMOTE_TEXT = "CASE WHEN supp % 5 = 0 THEN concat(description, '!') ELSE description END"


def revisions(spark, sf):
    local = fx.table(spark, sf, "lineitem").selectExpr(*LOCAL)
    remote = local.selectExpr(
        "job_id", "highlight_id", f"CAST({REMOTE_START} AS DOUBLE) AS start_sec", "end_sec", f"{REMOTE_TEXT} AS description",
        "reason", "'pending' AS review_status", "clip_url", "CASE WHEN job_id % 4 = 0 THEN 0L ELSE 2L END AS revision", "line",
    )
    return local.filter("line < 6"), remote


LOCAL_SQL = "loc AS (SELECT " + ", ".join(LOCAL).replace("AS STRING", "AS VARCHAR").replace("'u', l_partkey", "'u', CAST(l_partkey AS VARCHAR)").replace("1L", "1") + " FROM lineitem)"


@query(
    "jn_carry_review",
    f"""WITH {LOCAL_SQL}, has AS (SELECT DISTINCT job_id FROM loc WHERE line < 6)
SELECT job_id, highlight_id, CAST({REMOTE_START} AS DOUBLE) AS start_sec, {REMOTE_TEXT} AS description,
  CASE WHEN line < 6 AND supp % 3 <> 0 AND supp % 5 <> 0 THEN review_status ELSE 'pending' END AS review_status
FROM loc WHERE job_id % 4 <> 0 OR job_id NOT IN (SELECT job_id FROM has)
UNION ALL SELECT job_id, highlight_id, start_sec, description, review_status FROM loc WHERE line < 6 AND job_id % 4 = 0""",
)
def _(spark, sf):
    local, remote = revisions(spark, sf)
    return editing.carry_review(remote.drop("line"), local).select("job_id", "highlight_id", "start_sec", "description", "review_status")


@query(
    "jn_clip_invalidate",
    f"""WITH {LOCAL_SQL} SELECT job_id, highlight_id, CASE WHEN line < 6 AND supp % 3 <> 0 THEN clip_url ELSE '' END AS clip_url FROM loc""",
)
def _(spark, sf):
    local, remote = revisions(spark, sf)
    return editing.invalidate_clips(remote, local).select("job_id", "highlight_id", "clip_url")
