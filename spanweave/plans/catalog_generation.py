"""Interval-set operators and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervalsets as ivs
from ..operators import tiles as tl
from . import fixtures as fx
from . import windows as wn
from .catalog_intervals import PAIRS_SQL, evidence, pairs
from .catalog_joins import TILES_SQL
from .registry import query


def span_rows(spark, sf, where):
    return fx.seg(spark, sf).filter(where).select("video_id", "seg_no", "kind", "start_sec", "end_sec")


# seconds covered by a row, one row per second; runs of seconds make spans again
CELLS = "SELECT {cols}, unnest(range(CAST(start_sec AS BIGINT), CAST(end_sec AS BIGINT))) AS c FROM {src}"
RUNS = """SELECT {keys}, CAST(min(c) AS DOUBLE) AS start_sec, CAST(max(c) + 1 AS DOUBLE) AS end_sec FROM
  (SELECT {keys}, c, c - row_number() OVER (PARTITION BY {keys} ORDER BY c) AS run FROM {src}) GROUP BY {keys}, run"""


@query("iv_set_union", fx.with_sql("seg", fx.union_sql("u", "seg", "video_id")) + "SELECT * FROM u")
def _(spark, sf):
    return ivs.union_spans(fx.seg(spark, sf), ["video_id"])


@query(
    "iv_set_subtract",
    fx.with_sql(
        "seg", "base AS (SELECT * FROM seg WHERE side = 1)", "cuts AS (SELECT * FROM seg WHERE side = 0)",
        f"bc AS ({CELLS.format(cols='video_id, seg_no', src='base')})", f"cc AS ({CELLS.format(cols='video_id', src='cuts')})",
        "rest AS (SELECT * FROM bc WHERE NOT EXISTS (SELECT 1 FROM cc WHERE cc.video_id = bc.video_id AND cc.c = bc.c))",
    )
    + RUNS.format(keys="video_id, seg_no", src="rest"),
)
def _(spark, sf):
    rest = ivs.subtract_spans(span_rows(spark, sf, "side = 1"), span_rows(spark, sf, "side = 0"), ["video_id"])
    return rest.drop("kind")


@query(
    "iv_set_coverage",
    fx.with_sql("seg", TILES_SQL.format(w=20, c=15), f"cells AS (SELECT DISTINCT video_id, c FROM ({CELLS.format(cols='video_id', src='seg')}))")
    + """SELECT t.video_id, t.tile_no, CAST(count(c.c) AS DOUBLE) AS covered_sec, count(c.c) = t.core_end - t.core_start AS full_cover
FROM tiles t LEFT JOIN cells c ON c.video_id = t.video_id AND c.c >= t.core_start AND c.c < t.core_end GROUP BY t.video_id, t.tile_no, t.core_start, t.core_end""",
)
def _(spark, sf):
    grid = tl.tiles(fx.videos(spark, sf).select("video_id", "duration_sec"), 20.0, 15.0)
    out = ivs.covered_seconds(
        grid, fx.seg(spark, sf), ["video_id"], ["video_id", "tile_no"], range_span=("core_start", "core_end")
    )
    rest = F.col("core_end") - F.col("core_start") - F.col("covered_sec")
    return out.select("video_id", "tile_no", "covered_sec", (rest <= ivs.TOLERANCE).alias("full_cover"))


def priority_sql(src: str) -> str:
    """Overlay by seconds: what remains of each row after stronger kinds."""
    return f"""cells AS ({CELLS.format(cols='video_id, seg_no, kind', src=src)}),
strong AS (SELECT DISTINCT video_id, kind, c FROM cells),
rest AS (SELECT * FROM cells x WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.video_id = x.video_id AND s.c = x.c
  AND ((s.kind = 'positive' AND x.kind <> 'positive') OR (s.kind = 'uncertain' AND x.kind = 'negative'))))"""


@query(
    "iv_set_priority",
    fx.with_sql("seg", priority_sql("seg")) + RUNS.format(keys="video_id, seg_no, kind", src="rest"),
)
def _(spark, sf):
    return ivs.overlay_by_priority(span_rows(spark, sf, F.lit(True)), ["video_id"])


@query(
    "iv_set_replace",
    fx.with_sql(
        "seg", "core AS (SELECT o_orderkey AS video_id FROM orders WHERE o_orderstatus <> 'O')",
        """merged AS (
  SELECT s.video_id, seg_no, kind, start_sec, end_sec FROM seg s LEFT JOIN core k ON k.video_id = s.video_id
    WHERE side = 0 AND kind = 'positive' AND (k.video_id IS NULL OR NOT ((start_sec + end_sec) / 2 >= 20 AND (start_sec + end_sec) / 2 < 40))
  UNION ALL SELECT s.video_id, seg_no, kind, start_sec, CASE WHEN k.video_id IS NULL OR end_sec <= 20 OR start_sec >= 40 THEN end_sec ELSE 20 END
    FROM seg s LEFT JOIN core k ON k.video_id = s.video_id WHERE side = 0 AND kind <> 'positive'
    AND (k.video_id IS NULL OR end_sec <= 20 OR start_sec >= 40 OR start_sec < 20)
  UNION ALL SELECT s.video_id, seg_no, kind, 40, end_sec FROM seg s JOIN core k ON k.video_id = s.video_id
    WHERE side = 0 AND kind <> 'positive' AND start_sec < 40 AND end_sec > 40
  UNION ALL SELECT s.video_id, seg_no, kind, start_sec, end_sec FROM seg s JOIN core k ON k.video_id = s.video_id
    WHERE side = 1 AND kind = 'positive' AND (start_sec + end_sec) / 2 >= 20 AND (start_sec + end_sec) / 2 < 40
  UNION ALL SELECT s.video_id, seg_no, kind, greatest(start_sec, 20), least(end_sec, 40) FROM seg s JOIN core k ON k.video_id = s.video_id
    WHERE side = 1 AND kind <> 'positive' AND start_sec < 40 AND end_sec > 20)""",
        priority_sql("merged"),
    )
    + RUNS.format(keys="video_id, seg_no, kind", src="rest"),
)
def _(spark, sf):
    core = fx.videos(spark, sf).filter("status <> 'ready'").select(
        "video_id", F.lit(20.0).alias("core_start"), F.lit(40.0).alias("core_end")
    )
    return ivs.replace_core(span_rows(spark, sf, "side = 0"), core, span_rows(spark, sf, "side = 1"), ["video_id"])


@query("iv_set_dedup", fx.with_sql("seg") + "SELECT DISTINCT video_id, start_sec, end_sec FROM seg")
def _(spark, sf):
    return ivs.dedup_spans(fx.seg(spark, sf), ["video_id"])


@query(
    "iv_text_runs",
    fx.with_sql(
        "timeline", "r AS (SELECT job, pos, kind, t AS s, t + value * 700 AS e FROM timeline)",
        """l AS (SELECT *, lag(kind) OVER w AS pk, lag(e) OVER w AS pe FROM r WINDOW w AS (PARTITION BY job ORDER BY s, pos)),
n AS (SELECT *, sum(CASE WHEN kind = pk AND s <= pe + 1e-6 THEN 0 ELSE 1 END) OVER (PARTITION BY job ORDER BY s, pos ROWS UNBOUNDED PRECEDING) AS run FROM l)""",
    )
    + """SELECT job, CAST(run AS BIGINT) AS run_no, round(min(s), 6) AS start_sec, round(max_by(e, s), 6) AS end_sec, min(kind) AS text, count(*) AS rows
FROM n GROUP BY job, run""",
)
def _(spark, sf):
    rows = fx.timeline(spark, sf).select(
        "job", "pos", F.col("kind").alias("text"), F.col("t").alias("start_sec"), (F.col("t") + F.col("value") * 700).alias("end_sec")
    )
    runs = ivs.text_runs(rows, ["job"], [F.col("start_sec"), F.col("pos")], slice_sec=86400.0)
    return runs.withColumns({c: F.round(c, 6) for c in ("start_sec", "end_sec")})


def page_rows(spark, sf, width, context):
    grid = tl.tiles(fx.videos(spark, sf).select("video_id", "duration_sec"), width, context)
    return grid.select(
        "video_id", F.concat(F.lit("p"), "tile_no").alias("page_id"), F.col("core_start").alias("core_start_sec"),
        F.col("core_end").alias("core_end_sec"), F.col("read_start").alias("read_start_sec"), F.col("read_end").alias("read_end_sec"),
    )


@query(
    "iv_page_coverage",
    fx.with_sql("seg", TILES_SQL.format(w=10, c=3), fx.union_sql("u", "seg", "video_id"))
    + """SELECT t.video_id, concat('p', CAST(t.tile_no AS VARCHAR)) AS page_id, EXISTS (SELECT 1 FROM u WHERE u.video_id = t.video_id
  AND u.start_sec <= t.core_start AND u.end_sec >= t.core_end) AS covered FROM tiles t""",
)
def _(spark, sf):
    out = ivs.page_coverage(page_rows(spark, sf, 10.0, 3.0), fx.seg(spark, sf), ["video_id"])
    return out.select("video_id", "page_id", "covered")


@query(
    "iv_tiling_check",
    fx.with_sql(
        TILES_SQL.format(w=10, c=3),
        """pages AS (SELECT video_id, CASE WHEN video_id % 13 = 0 AND tile_no = 1 THEN 'p0' ELSE concat('p', CAST(tile_no AS VARCHAR)) END AS page_id,
  core_start, core_end, CASE WHEN video_id % 11 = 0 THEN read_end + 5 ELSE read_end END AS read_end FROM tiles
  WHERE NOT (video_id % 7 = 0 AND tile_no = 3) AND NOT (video_id % 17 = 0 AND tile_no = 6))""",
    )
    + """SELECT video_id, page_id, 'not_continuous' AS reason FROM (SELECT *, lag(core_end, 1, 0.0) OVER (PARTITION BY video_id ORDER BY core_start) AS pe FROM pages) WHERE core_start <> pe
UNION ALL SELECT video_id, page_id, 'read_out_of_video' FROM pages WHERE read_end > 64
UNION ALL SELECT video_id, page_id, 'duplicate_id' FROM pages GROUP BY video_id, page_id HAVING count(*) > 1
UNION ALL SELECT video_id, NULL, 'incomplete' FROM pages GROUP BY video_id HAVING max(core_end) <> 64""",
)
def _(spark, sf):
    n = F.regexp_extract("page_id", r"\d+", 0).cast("int")
    pages = (
        page_rows(spark, sf, 10.0, 3.0).withColumn("n", n)
        .filter("NOT (video_id % 7 = 0 AND n = 3) AND NOT (video_id % 17 = 0 AND n = 6)")
        .withColumns(
            {
                "page_id": F.when((F.col("video_id") % 13 == 0) & (F.col("n") == 1), "p0").otherwise(F.col("page_id")),
                "read_end_sec": F.when(F.col("video_id") % 11 == 0, F.col("read_end_sec") + 5).otherwise(F.col("read_end_sec")),
            }
        )
    )
    return ivs.tiling_violations(pages, fx.videos(spark, sf), ["video_id"])


TILE_COLS = ["video_id", "tile_no", "core_start", "core_end", "read_start", "read_end"]


@query("gen_tiles", fx.with_sql(TILES_SQL.format(w=10, c=10)) + f"SELECT {', '.join(TILE_COLS)} FROM tiles")
def _(spark, sf):
    return tl.tiles(fx.videos(spark, sf), 10.0, 10.0).select(*TILE_COLS)


@query(
    "gen_tiles_for_range",
    fx.with_sql("seg", "g AS (SELECT video_id, seg_no, unnest(range(CAST(floor(start_sec / 20) AS BIGINT), CAST(ceil(end_sec / 20) AS BIGINT))) AS i FROM seg)")
    + """SELECT video_id, seg_no, i AS tile_no, CAST(i * 20 AS DOUBLE) AS core_start, least(64.0, (i + 1) * 20)::DOUBLE AS core_end,
  greatest(0.0, i * 20 - 15)::DOUBLE AS read_start, least(64.0, (i + 1) * 20 + 15)::DOUBLE AS read_end FROM g""",
)
def _(spark, sf):
    requests = fx.seg(spark, sf).withColumn("duration_sec", F.lit(64.0))
    out = tl.tiles_for_range(requests, 20.0, 15.0, "start_sec", "end_sec")
    return out.select("video_id", "seg_no", *TILE_COLS[1:])


@query(
    "gen_split_page",
    fx.with_sql(
        TILES_SQL.format(w=9, c=3),
        "t AS (SELECT *, (core_end - core_start) / 2 AS half, (core_start + core_end) / 2 AS mid, video_id % 2 = 0 AS flag FROM tiles)",
    )
    + """SELECT video_id, tile_no, CAST(0 AS BIGINT) AS part, core_start AS cs, core_end AS ce, read_start AS rs, read_end AS re, flag AND half < 1 AS split_error
  FROM t WHERE NOT flag OR half < 1
UNION ALL SELECT video_id, tile_no, 1, core_start, mid, greatest(read_start, core_start - 2), least(read_end, mid + 2), FALSE FROM t WHERE flag AND half >= 1
UNION ALL SELECT video_id, tile_no, 2, mid, core_end, greatest(read_start, mid - 2), least(read_end, core_end + 2), FALSE FROM t WHERE flag AND half >= 1""",
)
def _(spark, sf):
    out = tl.split_pages(page_rows(spark, sf, 9.0, 3.0), F.col("video_id") % 2 == 0, 2.0)
    return out.select(
        "video_id", F.regexp_extract("page_id", r"\d+", 0).cast("bigint").alias("tile_no"), F.col("part").cast("bigint").alias("part"),
        F.col("core_start_sec").alias("cs"), F.col("core_end_sec").alias("ce"), F.col("read_start_sec").alias("rs"),
        F.col("read_end_sec").alias("re"), "split_error",
    )


@query(
    "gen_compact_tail",
    fx.with_sql(
        """pages AS (SELECT o_orderkey AS video_id, d, i * 20.0::DOUBLE AS cs, least(d, (i + 1) * 20.0)::DOUBLE AS ce, least(d, (i + 1) * 20.0 + 5)::DOUBLE AS re
  FROM (SELECT o_orderkey, d, unnest(range(0, CAST(ceil(d / 20) AS BIGINT))) AS i FROM (SELECT o_orderkey, (40 + o_custkey % 30)::DOUBLE AS d FROM orders)))""",
        "l AS (SELECT *, lead(cs) OVER w AS ns, lead(ce) OVER w AS ne, lead(cs, 2) OVER w AS n2, lag(re) OVER w AS pr, lag(ce - cs) OVER w AS pl FROM pages WINDOW w AS (PARTITION BY video_id ORDER BY cs))",
    )
    + """SELECT video_id, cs AS core_start_sec, CASE WHEN ns IS NOT NULL AND n2 IS NULL AND re = d AND ne - ns < ce - cs THEN ne ELSE ce END AS core_end_sec
FROM l WHERE NOT (ns IS NULL AND pr IS NOT NULL AND pr = d AND ce - cs < pl)""",
)
def _(spark, sf):
    videos = fx.table(spark, sf, "orders").selectExpr("o_orderkey AS video_id", "CAST(40 + o_custkey % 30 AS DOUBLE) AS duration_sec")
    pages = tl.tiles(videos, 20.0, 5.0).select(
        "video_id", F.col("core_start").alias("core_start_sec"), F.col("core_end").alias("core_end_sec"), F.col("read_end").alias("read_end_sec")
    )
    return tl.compact_tail(pages, videos, ["video_id"]).select("video_id", "core_start_sec", "core_end_sec")


@query(
    "gen_sample_grid",
    fx.with_sql("seg") + """SELECT video_id, seg_no, count(*) AS n, round(max(start_sec + i / 2.0), 6) AS last_t, round(sum(start_sec + i / 2.0), 6) AS sum_t,
  round(sum(start_sec + i * (end_sec - start_sec) / n), 4) AS sum_step
FROM (SELECT *, CAST(ceil((end_sec - start_sec) * 2) AS BIGINT) AS n, unnest(range(0, CAST(ceil((end_sec - start_sec) * 2) AS BIGINT))) AS i FROM seg) GROUP BY video_id, seg_no""",
)
def _(spark, sf):
    n = F.ceil((F.col("end_sec") - F.col("start_sec")) * 2)
    times = fx.seg(spark, sf).withColumns(
        {"t": tl.sample_grid("start_sec", "end_sec", 2.0), "step": tl.equal_steps("start_sec", "end_sec", n)}
    )
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return times.select(
        "video_id", "seg_no", F.size("t").cast("bigint").alias("n"), F.round(F.array_max("t"), 6).alias("last_t"),
        F.round(total("t"), 6).alias("sum_t"), F.round(total("step"), 4).alias("sum_step"),
    )


@query(
    "gen_equal_parts",
    fx.with_sql("seg") + """SELECT video_id, seg_no, CAST(i AS BIGINT) AS part_no, round(start_sec + i * (end_sec - start_sec) / n, 6) AS part_start,
  round(start_sec + (i + 1) * (end_sec - start_sec) / n, 6) AS part_end
FROM (SELECT *, CAST(ceil((end_sec - start_sec) / 4) AS BIGINT) AS n, unnest(range(0, CAST(ceil((end_sec - start_sec) / 4) AS BIGINT))) AS i FROM seg)""",
)
def _(spark, sf):
    parts = tl.equal_parts(fx.seg(spark, sf), 4.0)
    return parts.select(
        "video_id", "seg_no", F.col("part_no").cast("bigint").alias("part_no"), F.round("part_start", 6).alias("part_start"), F.round("part_end", 6).alias("part_end")
    )


WINDOW_SQL = fx.union_sql("known", "seg", "video_id", "kind <> 'uncertain'") + """,
cov AS (SELECT t.video_id, t.tile_no, sum(least(t.core_end, k.end_sec) - greatest(t.core_start, k.start_sec)) AS sec FROM tiles t
  JOIN known k ON k.video_id = t.video_id AND k.start_sec < t.core_end AND t.core_start < k.end_sec GROUP BY t.video_id, t.tile_no),
targets AS (SELECT t.video_id, t.tile_no, s.start_sec - t.read_start AS rs, s.end_sec - t.read_start AS re,
  s.start_sec < t.read_start OR s.end_sec > t.read_end AS cut FROM seg s JOIN tiles t ON t.video_id = s.video_id AND s.kind = 'positive'
  AND (s.start_sec + s.end_sec) / 2 >= t.core_start AND (s.start_sec + s.end_sec) / 2 < t.core_end),
per AS (SELECT video_id, tile_no, count(*) AS n, bool_or(cut) AS cut, string_agg(concat(CAST(CAST(rs AS BIGINT) AS VARCHAR), '-', CAST(CAST(re AS BIGINT) AS VARCHAR)), ',' ORDER BY rs, re) AS segs,
  string_agg(concat('{"start_sec":', CAST(rs AS VARCHAR), ',"end_sec":', CAST(re AS VARCHAR), '}'), ',' ORDER BY rs, re) AS json FROM targets GROUP BY video_id, tile_no),
outcome AS (SELECT t.*, coalesce(p.n, 0) AS n, coalesce(p.segs, '') AS segs, coalesce(p.json, '') AS json,
  CASE WHEN t.core_end - t.core_start - coalesce(c.sec, 0) > 1e-6 THEN 'unknown' WHEN p.cut THEN 'incomplete_core' WHEN p.n > 0 THEN 'positive' ELSE 'empty' END AS outcome
  FROM tiles t LEFT JOIN cov c ON c.video_id = t.video_id AND c.tile_no = t.tile_no LEFT JOIN per p ON p.video_id = t.video_id AND p.tile_no = t.tile_no
  WHERE t.video_id IN (SELECT video_id FROM seg)),
lines AS (SELECT o.video_id, o.tile_no, d.start_sec - o.read_start AS ls, d.end_sec - o.read_start AS le, d.source, d.text FROM outcome o JOIN dialogues d ON d.video_id = o.video_id
  AND d.start_sec >= greatest(0, o.read_start - 20) AND d.end_sec <= o.read_end WHERE o.outcome IN ('positive', 'empty')),
talk AS (SELECT video_id, tile_no, count(*) AS n_lines, max(le) AS last_line, string_agg(CAST(CAST(ls AS BIGINT) AS VARCHAR), ',' ORDER BY ls) AS starts FROM lines GROUP BY video_id, tile_no)"""
OPTIONS = wn.WindowOptions(10.0, 10.0, 20.0)
SAMPLE_ID = "concat(CAST(o.video_id AS VARCHAR), ':', CAST(CAST(o.core_start AS BIGINT) AS VARCHAR), '-', CAST(CAST(o.core_end AS BIGINT) AS VARCHAR))"


def labelled_videos(spark, sf):
    """Videos that have an annotation."""
    return fx.videos(spark, sf).join(fx.seg(spark, sf).select("video_id"), "video_id", "left_semi")


def windows(spark, sf, options=OPTIONS):
    return wn.build_windows(labelled_videos(spark, sf), fx.seg(spark, sf), fx.dialogues(spark, sf), options)


@query(
    "gen_windows",
    fx.with_sql("seg", "dialogues", TILES_SQL.format(w=10, c=10), WINDOW_SQL)
    + f"""SELECT {SAMPLE_ID} AS sample_id, o.video_id, o.outcome, o.read_start, o.read_end, o.core_start - o.read_start AS detect_start, o.core_end - o.read_start AS detect_end,
  o.n AS n_segments, o.segs AS segments, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.starts, '') AS line_starts
FROM outcome o LEFT JOIN talk k ON k.video_id = o.video_id AND k.tile_no = o.tile_no WHERE o.outcome IN ('positive', 'empty')""",
)
def gen_windows(spark, sf):
    whole = lambda c: c.cast("bigint").cast("string")
    segs = F.transform("segments", lambda x: F.concat(whole(x["start_sec"]), F.lit("-"), whole(x["end_sec"])))
    return windows(spark, sf).select(
        "sample_id", "video_id", "outcome", "read_start", "read_end",
        F.col("detect_range.start_sec").alias("detect_start"), F.col("detect_range.end_sec").alias("detect_end"),
        F.size("segments").cast("bigint").alias("n_segments"), F.array_join(segs, ",").alias("segments"),
        F.size("dialogue").cast("bigint").alias("n_lines"),
        F.array_join(F.transform("dialogue", lambda x: whole(x["start_sec"])), ",").alias("line_starts"),
    )


@query(
    "gen_window_check",
    fx.with_sql(
        "seg", "dialogues", TILES_SQL.format(w=10, c=10), WINDOW_SQL,
        f"w AS (SELECT o.*, {SAMPLE_ID} AS sample_id, o.read_end - CASE WHEN o.video_id % 5 = 0 THEN 15 ELSE 0 END - o.read_start AS len FROM outcome o WHERE o.outcome IN ('positive', 'empty'))",
        "tg AS (SELECT t.*, lag(t.re) OVER (PARTITION BY t.video_id, t.tile_no ORDER BY t.rs, t.re) AS pe FROM targets t)",
    )
    + """SELECT sample_id, 'detect_range' AS reason FROM w WHERE core_end - read_start > len + 1e-6
UNION ALL SELECT sample_id, 'ownership' FROM w WHERE EXISTS (SELECT 1 FROM tg WHERE tg.video_id = w.video_id AND tg.tile_no = w.tile_no AND tg.re > w.len + 1e-6)
UNION ALL SELECT sample_id, 'overlap' FROM w WHERE EXISTS (SELECT 1 FROM tg WHERE tg.video_id = w.video_id AND tg.tile_no = w.tile_no AND tg.pe > tg.rs)
UNION ALL SELECT sample_id, 'future_dialogue' FROM w JOIN talk k ON k.video_id = w.video_id AND k.tile_no = w.tile_no WHERE k.last_line > w.len + 1e-6""",
)
def _(spark, sf):
    shorter = F.when(F.col("video_id") % 5 == 0, F.col("read_end") - 15).otherwise(F.col("read_end"))
    return wn.window_violations(windows(spark, sf).withColumn("read_end", shorter))


@query(
    "gen_frame_timeline",
    fx.with_sql(
        "timeline", "st AS (SELECT job, min(t) + 100000 AS ds FROM timeline GROUP BY job)",
        """pk AS (SELECT t.job, floor(t / 5000) * 5000 AS pts, CASE WHEN kind = 'signup' THEN 0 ELSE value END AS hold, pos FROM timeline t JOIN st USING (job)
  WHERE kind <> 'error' AND floor(t / 5000) * 5000 >= st.ds)""",
        "u AS (SELECT job, pts, max_by(hold, pos) AS hold FROM pk GROUP BY job, pts)",
        "e AS (SELECT job, min(pts) AS origin, max(pts) AS last, max_by(hold, pts) AS hold FROM u GROUP BY job)",
    )
    + """SELECT u.job, row_number() OVER (PARTITION BY u.job ORDER BY u.pts) - 1 AS frame_no, round(u.pts - e.origin, 9) AS pts,
  round(e.last + CASE WHEN e.hold > 0 THEN e.hold WHEN s.ds + 3000000 > e.last THEN s.ds + 3000000 - e.last ELSE 1 / 25.0 END - e.origin, 6) AS duration_sec
FROM u JOIN e ON e.job = u.job JOIN st s ON s.job = u.job""",
)
def _(spark, sf):
    log = fx.timeline(spark, sf)
    packets = log.select(
        "job", F.col("pos").alias("packet_no"), (F.floor(F.col("t") / 5000) * 5000).cast("double").alias("pts"),
        F.when(F.col("kind") == "signup", F.lit(0.0)).otherwise(F.col("value")).alias("hold_sec"),
        F.when(F.col("kind") == "error", F.lit("_D")).otherwise(F.lit("K_")).alias("flags"),
    )
    streams = log.groupBy("job").agg((F.min("t") + 100000).alias("declared_start")).withColumns(
        {"declared_duration": F.lit(3000000.0), "fps": F.lit(25.0)}
    )
    frames, ends = tl.frame_timeline(packets, streams, ["job"], slice_sec=86400.0)
    return frames.join(ends, "job").select("job", "frame_no", "pts", F.round("duration_sec", 6).alias("duration_sec"))


CLIP_SQL = """ev AS (SELECT *, least(t_start, a_start) AS lo, greatest(t_end, a_end) AS hi, CASE WHEN line > 2 THEN t_start - 2 END AS ps,
    CASE WHEN line > 4 THEN a_end + 6 END AS pe FROM pairs WHERE line <> 3),
ok AS (SELECT *, least(lo, coalesce(ps, lo)) AS s, greatest(hi, coalesce(pe, hi)) AS e FROM ev WHERE (kind = 'positive' OR line % 2 = 0) AND hi <= 64 AND coalesce(ps BETWEEN 0 AND 64, TRUE) AND coalesce(pe BETWEEN 0 AND 64, TRUE)),
p1 AS (SELECT *, greatest(0, s - (25 - (e - s)) / 2) AS s1 FROM ok),
p2 AS (SELECT *, least(64, greatest(e, s1 + 25)) AS e1 FROM p1),
p3 AS (SELECT *, CASE WHEN e - s < 25 THEN greatest(0, least(s1, e1 - 25)) ELSE s END AS fs, CASE WHEN e - s < 25 THEN e1 ELSE e END AS fe FROM p2)"""


@query(
    "gen_clip_plan",
    f"WITH {PAIRS_SQL}, {CLIP_SQL} " + """SELECT video_id, seg_no, CAST(fs AS DOUBLE) AS start_sec, CAST(fe AS DOUBLE) AS end_sec,
  CASE WHEN fe - fs > 30 OR fe - fs < 25 THEN 'infeasible_duration' ELSE 'draft' END AS plan_status FROM p3""",
)
def _(spark, sf):
    return clip_plans(spark, sf).select("video_id", "seg_no", "start_sec", "end_sec", "plan_status")


def clip_plans(spark, sf):
    events = pairs(spark, sf).withColumns(
        {
            "status": F.when(F.col("line") == 3, "rejected").otherwise("supported"),
            "required_spans": evidence(),
            "proposed_start_sec": F.when(F.col("line") > 2, F.col("t_start") - 2),
            "proposed_end_sec": F.when(F.col("line") > 4, F.col("a_end") + 6),
            "duration_sec": F.lit(64.0),
        }
    ).drop("start_sec", "end_sec")
    return tl.clip_plans(events, max_clip_sec=30.0, min_clip_sec=25.0)


@query(
    "gen_training_text",
    fx.with_sql(
        "seg", "dialogues", TILES_SQL.format(w=10, c=10), WINDOW_SQL,
        f"""shown AS (SELECT video_id, tile_no, string_agg(printf('{tl.LINE_FORMAT}', CASE WHEN source = 'ocr' THEN greatest(0.0::DOUBLE, ls) ELSE ls END, le,
  CASE WHEN source = 'asr' THEN '{tl.SPEECH_WORD}' ELSE '{tl.SCREEN_WORD}' END, text), chr(10) ORDER BY ls) AS txt FROM lines WHERE source <> 'ocr' OR le > 0 GROUP BY video_id, tile_no)""",
    )
    + f"""SELECT {SAMPLE_ID} AS sample_id, concat(printf('本次检测范围：%.2f–%.2f秒。下列文字使用同一时间轴，负时间是此前对白。', o.core_start - o.read_start, o.core_end - o.read_start), chr(10), coalesce(x.txt, '')) AS prompt,
  concat('{{"segments":[', o.json, ']}}') AS answer FROM outcome o LEFT JOIN shown x ON x.video_id = o.video_id AND x.tile_no = o.tile_no WHERE o.outcome IN ('positive', 'empty')""",
)
def _(spark, sf):
    return tl.training_text(windows(spark, sf))

