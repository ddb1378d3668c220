"""Interval scalars, classifications and row-level cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import labels as lb
from ..functions import scalars as sc
from . import fixtures as fx
from .registry import query

# One row per lineitem with a second range (t), an alternative range (a) and nullable bounds.
PAIR_EXPR = [
    "l_orderkey AS video_id",
    f"{fx.SEG_NO} AS seg_no",
    "CAST(l_quantity AS DOUBLE) AS start_sec",
    "CAST(l_quantity + 4 + l_linenumber AS DOUBLE) AS end_sec",
    "CAST(l_linenumber * 6 AS DOUBLE) AS t_start",
    "CAST(l_linenumber * 6 + 5 + l_partkey % 17 AS DOUBLE) AS t_end",
    "CAST(l_suppkey % 40 AS DOUBLE) AS a_start",
    "CAST(l_suppkey % 40 + 8 AS DOUBLE) AS a_end",
    f"{fx.KIND} AS kind",
    "l_linenumber AS line",
    "l_discount AS discount",
]
PAIRS_SQL = f"pairs AS (SELECT {', '.join(PAIR_EXPR)} FROM lineitem)"


def pairs(spark, sf):
    return fx.table(spark, sf, "lineitem").selectExpr(*PAIR_EXPR)


def psql(columns: str, where: str = "TRUE") -> str:
    return f"WITH {PAIRS_SQL} SELECT video_id, seg_no, {columns} FROM pairs WHERE {where}"


def keyed(df, **cols):
    return df.select("video_id", "seg_no", *[c.alias(n) for n, c in cols.items()])


OVER = "greatest(0.0::DOUBLE, least({1}, {3}) - greatest({0}, {2}))"
IOU = f"{OVER} / (greatest({{1}}, {{3}}) - least({{0}}, {{2}}))"
OV_T = OVER.format("start_sec", "end_sec", "t_start", "t_end")
OV_A = OVER.format("start_sec", "end_sec", "a_start", "a_end")
IOU_T = IOU.format("start_sec", "end_sec", "t_start", "t_end")
IOU_A = IOU.format("start_sec", "end_sec", "a_start", "a_end")
R1 = "CASE WHEN kind = 'positive' THEN 'decisive' ELSE 'setup' END"
R2 = "CASE WHEN line % 2 = 0 THEN 'decisive' ELSE 'reaction' END"
D1, D2 = f"({R1} = 'decisive')::INT", f"({R2} = 'decisive')::INT"
DEC = (
    f"CASE WHEN {D1} + {D2} > 0 THEN ({D1} * {OV_T} + {D2} * {OV_A}) / "
    f"({D1} * (t_end - t_start) + {D2} * (a_end - a_start)) END"
)


def alternatives():
    return F.array(F.struct(F.col("a_start").alias("start_sec"), F.col("a_end").alias("end_sec")))


def evidence():
    def span(role, s, e):
        return F.struct(F.expr(role).alias("role"), F.col(s).alias("start_sec"), F.col(e).alias("end_sec"))

    return F.array(span(R1, "t_start", "t_end"), span(R2, "a_start", "a_end"))


@query("iv_overlap", psql(f"{OV_T} AS overlap_sec"))
def _(spark, sf):
    return keyed(pairs(spark, sf), overlap_sec=iv.overlap("start_sec", "end_sec", "t_start", "t_end"))


@query("iv_iou", psql(f"round({IOU_T}, 6) AS iou"))
def _(spark, sf):
    return keyed(pairs(spark, sf), iou=F.round(iv.iou("start_sec", "end_sec", "t_start", "t_end"), 6))


@query("iv_ref_coverage", psql(f"round({OV_T} / (t_end - t_start), 6) AS coverage"))
def _(spark, sf):
    return keyed(
        pairs(spark, sf), coverage=F.round(iv.reference_coverage("start_sec", "end_sec", "t_start", "t_end"), 6)
    )


@query("iv_event_iou", psql(f"round(greatest({IOU_T}, {IOU_A}), 6) AS event_iou"))
def _(spark, sf):
    value = iv.event_iou("start_sec", "end_sec", "t_start", "t_end", alternatives())
    return keyed(pairs(spark, sf), event_iou=F.round(value, 6))


@query("iv_decisive_coverage", psql(f"round({DEC}, 6) AS decisive"))
def _(spark, sf):
    return keyed(pairs(spark, sf), decisive=F.round(iv.decisive_coverage("start_sec", "end_sec", evidence()), 6))


@query("iv_event_coverage", psql(f"round(greatest({IOU_T}, {IOU_A}, coalesce({DEC}, 0)), 6) AS coverage"))
def _(spark, sf):
    value = iv.event_coverage("start_sec", "end_sec", "t_start", "t_end", alternatives(), evidence())
    return keyed(pairs(spark, sf), coverage=F.round(value, 6))


MID = "(start_sec + end_sec) / 2"


@query("iv_owned_by", psql(f"({MID} >= t_start AND {MID} < t_end) AS owned"))
def _(spark, sf):
    return keyed(pairs(spark, sf), owned=iv.owned_by("start_sec", "end_sec", "t_start", "t_end"))


@query(
    "iv_contains",
    psql("(10 <= start_sec AND end_sec <= 50 AND 10 <= t_start AND t_end <= 50) AS contains"),
)
def _(spark, sf):
    spans = F.array(
        F.struct("start_sec", "end_sec"), F.struct(F.col("t_start").alias("start_sec"), F.col("t_end").alias("end_sec"))
    )
    return keyed(pairs(spark, sf), contains=iv.contains_all(F.lit(10.0), F.lit(50.0), spans))


@query(
    "iv_clamp",
    psql(
        "greatest(0.0, start_sec - 8) AS c_start, least(30.0, end_sec) AS c_end",
        "greatest(0.0, start_sec - 8) < least(30.0, end_sec)",
    ).replace("0.0,", "0.0::DOUBLE,"),
)
def _(spark, sf):
    df = keyed(pairs(spark, sf), c_start=iv.clamp_start(F.col("start_sec") - 8), c_end=iv.clamp_end("end_sec", F.lit(30.0)))
    return df.filter("c_start < c_end")


@query(
    "iv_shift",
    psql("round(start_sec / 3 - t_start, 6) AS s, round(end_sec / 3 - t_start, 6) AS e"),
)
def _(spark, sf):
    return keyed(
        pairs(spark, sf), s=iv.shift(F.col("start_sec") / 3, "t_start"), e=iv.shift(F.col("end_sec") / 3, "t_start")
    )


@query(
    "iv_open_overlap",
    psql(
        """((line = 1 OR start_sec < t_end) AND
  (line = 1 OR line = 2 OR start_sec + (end_sec - start_sec) > t_start)) AS meets"""
    ),
)
def _(spark, sf):
    start = F.when(F.col("line") != 1, F.col("start_sec"))
    length = F.when(F.col("line") != 2, F.col("end_sec") - F.col("start_sec"))
    return keyed(pairs(spark, sf), meets=iv.open_overlap(start, length, "t_start", "t_end"))


# bounds that are missing, NaN, infinite or reversed for some line numbers
BAD_START = "CASE line WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN NULL ELSE start_sec END"
BAD_END = "CASE line WHEN 3 THEN CAST('Infinity' AS DOUBLE) WHEN 4 THEN start_sec - 1 ELSE end_sec END"


@query(
    "iv_valid",
    psql(f"(line > 4 AND end_sec <= 45 AND {MID} >= 15 AND {MID} < 40) AS valid"),
)
def _(spark, sf):
    df = pairs(spark, sf).withColumns({"s": F.expr(BAD_START), "e": F.expr(BAD_END)})
    return keyed(df, valid=iv.valid_span("s", "e", F.lit(45.0), F.lit(15.0), F.lit(40.0)))


@query(
    "iv_edge_demote",
    psql(
        f"""CASE WHEN kind = 'positive' AND (start_sec <= 10 OR end_sec >= 50) AND start_sec >= 10 AND end_sec <= 50
  THEN 'uncertain' ELSE kind END AS new_kind,
  CASE WHEN kind = 'positive' AND (start_sec <= 10 OR end_sec >= 50) AND start_sec >= 10 AND end_sec <= 50
  THEN concat('{iv.EDGE_PREFIX}', kind) ELSE kind END AS new_reason,
  NOT (start_sec >= 10 AND end_sec <= 50) AS violation"""
    ),
)
def _(spark, sf):
    kind, reason, violation = iv.edge_demote(
        "kind", "kind", "start_sec", "end_sec", F.lit(10.0), F.lit(50.0), F.lit(64.0)
    )
    return keyed(pairs(spark, sf), new_kind=kind, new_reason=reason, violation=violation)


@query(
    "iv_clip_edit_valid",
    psql(
        """CASE WHEN start_sec - 5 < 0 OR end_sec - 5 * line > 40 THEN 'out_of_video'
  WHEN end_sec - 5 * line - (start_sec - 5) < 0.5 THEN 'too_short' END AS error"""
    ),
)
def _(spark, sf):
    error = iv.clip_edit_error(F.col("start_sec") - 5, F.col("end_sec") - 5 * F.col("line"), F.lit(40.0))
    return keyed(pairs(spark, sf), error=error)


@query(
    "iv_scope_flags",
    psql(
        """(CASE WHEN end_sec > 40 THEN 1 ELSE 0 END + CASE WHEN t_end > 40 THEN 1 ELSE 0 END)::BIGINT AS out_of_bounds,
  (CASE WHEN (start_sec + end_sec) / 2 >= 15 AND (start_sec + end_sec) / 2 < 35 THEN 0 ELSE 1 END
  + CASE WHEN (t_start + t_end) / 2 >= 15 AND (t_start + t_end) / 2 < 35 THEN 0 ELSE 1 END)::BIGINT AS out_of_scope"""
    ),
)
def _(spark, sf):
    spans = F.array(
        F.struct("start_sec", "end_sec"), F.struct(F.col("t_start").alias("start_sec"), F.col("t_end").alias("end_sec"))
    )
    bounds, scope = iv.scope_flags(spans, F.lit(40.0), F.lit(15.0), F.lit(35.0))
    return keyed(pairs(spark, sf), out_of_bounds=bounds.cast("bigint"), out_of_scope=scope.cast("bigint"))


@query(
    "win_category",
    fx.with_sql("seg")
    + """SELECT video_id, CASE WHEN n = 0 THEN 'empty' WHEN n = 1 THEN 'single' ELSE 'multiple' END AS category
FROM (SELECT video_id, sum(CASE WHEN kind = 'positive' THEN 1 ELSE 0 END) AS n FROM seg GROUP BY video_id)""",
)
def _(spark, sf):
    n = fx.seg(spark, sf).groupBy("video_id").agg(F.count_if(F.col("kind") == "positive").alias("n"))
    return n.select("video_id", lb.window_category("n").alias("category"))


@query(
    "lbl_cohort",
    """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'human_verified' WHEN doc_id % 5 = 0 THEN 'silver'
WHEN doc_id % 3 = 0 THEN 'unspecified' WHEN toxic = 0 THEN 'ai_blind' ELSE 'ai_prediction_exposed' END AS cohort FROM labels""",
)
def _(spark, sf):
    d = fx.table(spark, sf, "labels")
    verified = (F.col("quality") == 1) & (F.col("toxic") == 1)
    status = F.when(F.col("doc_id") % 5 == 0, F.lit("silver"))
    exposed = F.when(F.col("doc_id") % 3 != 0, F.col("toxic") == 1)
    return d.select("doc_id", lb.annotation_cohort(verified, status, exposed).alias("cohort"))


@query(
    "lbl_status",
    fx.with_sql("seg")
    + """SELECT video_id, CASE WHEN bool_or(kind <> 'uncertain') THEN 'ready' ELSE 'unresolved' END AS status
FROM seg GROUP BY video_id""",
)
def _(spark, sf):
    n = fx.seg(spark, sf).groupBy("video_id").agg(F.count_if(F.col("kind") != "uncertain").alias("n"))
    return n.select("video_id", lb.label_status("n").alias("status"))


@query(
    "pred_error_class",
    psql(
        """CASE WHEN line = 7 THEN 'parse_error' WHEN line % 3 > 0 AND CAST(a_start AS BIGINT) % 2 > 0 THEN 'missed_and_false'
  WHEN line % 3 > 0 THEN 'missed' WHEN CAST(a_start AS BIGINT) % 2 > 0 THEN 'false'
  WHEN CAST(t_end AS BIGINT) % 4 > 0 AND CAST(t_end AS BIGINT) % 3 < CAST(t_end AS BIGINT) % 4 THEN 'boundary_drift'
  WHEN CAST(t_end AS BIGINT) % 4 > 0 THEN 'hit' ELSE 'correct_empty' END AS error_class"""
    ),
)
def _(spark, sf):
    whole = F.col("t_end").cast("bigint")
    value = lb.error_class(
        F.col("line") == 7, F.col("line") % 3, F.col("a_start").cast("bigint") % 2, whole % 4, whole % 3
    )
    return keyed(pairs(spark, sf), error_class=value)


JOBS = [
    "o_orderkey AS job_id",
    "CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' ELSE 'processing' END AS status",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'complete' ELSE 'partial' END AS completion",
    "CAST(o_custkey % 2 AS BIGINT) AS revision",
    "CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 101) / 100.0 END AS result_coverage",
    "CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 150) / 100.0 END AS checkpoint_coverage",
    "CAST(o_orderdate AS DATE) AS created",
    "o_orderpriority AS name",
]


def jobs(spark, sf):
    df = fx.table(spark, sf, "orders").selectExpr(*JOBS)
    return df.withColumns({c: F.col(c).cast("double") for c in ("result_coverage", "checkpoint_coverage")})


JOBS_SQL = f"jobs AS (SELECT {', '.join(JOBS)} FROM orders)"


@query(
    "job_state",
    f"""WITH {JOBS_SQL}, c AS (SELECT *, CASE WHEN status = 'completed'
  THEN coalesce(result_coverage, checkpoint_coverage) ELSE coalesce(checkpoint_coverage, result_coverage) END AS cov FROM jobs)
SELECT job_id, coalesce(status = 'completed' AND completion = 'complete', FALSE) AS review_ready,
  revision = 0 AND (status = 'failed' OR coalesce(status = 'completed' AND completion = 'partial', FALSE)) AS resumable,
  CASE WHEN status = 'completed' AND completion = 'partial' THEN 'partial' ELSE status END AS shown,
  CASE WHEN cov IS NOT NULL THEN CAST(floor(greatest(0, least(1, cov))::DOUBLE * 100 + 0.5) AS BIGINT) END AS percent FROM c""",
)
def _(spark, sf):
    return jobs(spark, sf).select(
        "job_id",
        lb.review_ready("status", "completion").alias("review_ready"),
        lb.resumable("status", "completion", "revision").alias("resumable"),
        lb.display_status("status", "completion").alias("shown"),
        lb.coverage_percent("status", "result_coverage", "checkpoint_coverage").alias("percent"),
    )


# open counters: numbers, fractions, negatives, booleans and ranges as the event stream gives them
PROGRESS = (
    """concat('{"model_calls": ', CASE WHEN kind = 'error' THEN 'true' ELSE k END, ', "turn": ', CASE WHEN kind = 'click' THEN concat('-', k) ELSE CAST(value AS TEXT) END, """
    """', "duration_sec": ', CAST(value AS TEXT), ', "scan_coverage": ', CAST(CAST(k AS DOUBLE) / 80 AS TEXT), ', "ready_event_ids": ["e1", "e1", 3, "e', k, '"]', """
    """', "capabilities": ', CASE WHEN kind = 'signup' THEN '"all"' ELSE concat('{"transcript": true, "semantic_search": ', CASE WHEN pos % 2 = 0 THEN 'false' ELSE '1' END, ', "read_text": "true"}') END, """
    """', "next_page": {"core_start_sec": ', k, ', "core_end_sec": 50}, "secret": "x"}')"""
)


def progress_sql() -> str:
    from ..sources.progress import COUNTERS, FLAGS

    def number(path: str) -> str:
        return f"CASE WHEN json_type(d, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(d->>'{path}' AS DOUBLE) >= 0 THEN abs(CAST(d->>'{path}' AS DOUBLE)) END"

    whole = ", ".join(f"CASE WHEN {number(f'$.{c}')} = floor({number(f'$.{c}')}) THEN CAST({number(f'$.{c}')} AS BIGINT) END AS {c}" for c in COUNTERS)
    flags = ", ".join(f"CASE json_type(d, '$.capabilities.{c}') WHEN 'BOOLEAN' THEN CAST(d->>'$.capabilities.{c}' AS BOOLEAN) END AS can_{c}" for c in FLAGS)
    start, end = number("$.next_page.core_start_sec"), number("$.next_page.core_end_sec")
    return (
        f"WITH {fx.SQL['timeline']}, j AS (SELECT pos, strftime(TIMESTAMP '2024-01-01' + to_seconds(floor(t)::BIGINT), '%Y-%m-%dT%H:%M:%S+00:00') AS updated_at, CAST({PROGRESS.replace('TEXT', 'VARCHAR')} AS JSON) AS d FROM timeline)\n"
        f"SELECT pos, updated_at, {whole}, {flags}, CASE WHEN {number('$.duration_sec')} > 0 THEN {number('$.duration_sec')} END AS duration_sec, "
        f"CASE WHEN {number('$.scan_coverage')} <= 1 THEN {number('$.scan_coverage')} END AS scan_coverage, "
        "CAST((SELECT count(DISTINCT x->>'$') FROM (SELECT unnest(CAST(d->'$.ready_event_ids' AS JSON[])) AS x) WHERE json_type(x) = 'VARCHAR') AS BIGINT) AS ready_clip_count, "
        f"CASE WHEN {start} < {end} THEN {start} END AS next_start_sec, CASE WHEN {start} < {end} THEN {end} END AS next_end_sec FROM j"
    )


@query("job_progress_clean", progress_sql())
def _(spark, sf):
    from ..sources.progress import clean_progress

    second = F.expr("timestampadd(SECOND, cast(floor(t) AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    rows = fx.timeline(spark, sf).select("pos", second.alias("modified"), F.expr(PROGRESS.replace("TEXT", "STRING")).alias("progress"))
    return clean_progress(rows, "progress", modified="modified").drop("progress", "modified")


@query(
    "asr_clean",
    """SELECT conv_id, turn, trim(text, ' ') AS text, round(exp(-(turn + 1) / 10.0), 6)::DOUBLE AS confidence
FROM conversations WHERE trim(text, ' ') <> ''""",
)
def _(spark, sf):
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.trim("text").alias("text"),
        F.round(sc.asr_confidence(-(F.col("turn") + 1) / 10.0), 6).alias("confidence"),
    ).filter("text <> ''")


@query(
    "ocr_frame_text",
    """WITH lines AS (SELECT conv_id, turn, role, trim(text, ' ') AS text,
  (length(text) % 100) / 100.0::DOUBLE AS s1, (length(text) % 37) / 36.0::DOUBLE AS s2 FROM conversations)
SELECT conv_id, turn, CAST(turn AS DOUBLE) AS start_sec, turn + 1.5::DOUBLE AS end_sec,
  CASE WHEN s1 >= 0.55 AND s2 >= 0.55 THEN concat(text, ' ', role) WHEN s1 >= 0.55 THEN text ELSE role END AS text,
  round(CASE WHEN s1 >= 0.55 AND s2 >= 0.55 THEN (s1 + s2) / 2 WHEN s1 >= 0.55 THEN s1 ELSE s2 END, 6) AS confidence
FROM lines WHERE s1 >= 0.55 OR s2 >= 0.55""",
)
def _(spark, sf):
    n = F.length("text")
    lines = F.array(
        F.struct(F.col("text"), (n % 100 / 100.0).alias("score")),
        F.struct(F.col("role").alias("text"), (n % 37 / 36.0).alias("score")),
    )
    text, confidence = sc.ocr_frame(lines)
    return (
        fx.table(spark, sf, "conversations")
        .select(
            "conv_id", "turn", F.col("turn").cast("double").alias("start_sec"),
            (F.col("turn") + sc.OCR_HOLD_SEC).cast("double").alias("end_sec"), text.alias("text"), F.round(confidence, 6).alias("confidence"),
        )
        .filter(F.col("text").isNotNull())
    )


@query(
    "req_budget",
    """SELECT source, CAST(sum(4 * ((n_chars + 2) // 3)) + 100000 AS BIGINT) AS bytes,
  sum(4 * ((n_chars + 2) // 3)) + 100000 >= 400000 AS too_big FROM documents GROUP BY source""",
)
def _(spark, sf):
    total = F.sum(sc.base64_bytes("n_chars")) + sc.REQUEST_OVERHEAD_BYTES
    return (
        fx.table(spark, sf, "documents").groupBy("source").agg(total.alias("bytes"))
        .withColumn("too_big", F.col("bytes") >= 400_000)
    )


@query(
    "content_key",
    psql("sha256(concat(video_id::VARCHAR, chr(1), seg_no::VARCHAR, chr(1), kind, chr(1), line::VARCHAR)) AS content_key"),
)
def _(spark, sf):
    return keyed(pairs(spark, sf), content_key=sc.content_key("video_id", "seg_no", "kind", "line"))
