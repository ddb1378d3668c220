"""Matching, sampling and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import labels as lb
from ..operators import matching as mt
from ..operators import sampling as sm
from ..operators import selection as sel
from ..session import materialize
from . import fixtures as fx
from . import scoring as sg
from . import windows as wn
from .catalog_generation import CLIP_SQL, clip_plans, labelled_videos
from .catalog_intervals import PAIRS_SQL
from .catalog_joins import EDGES_SQL, sides
from .registry import query

KEYS = ["video_id"]


def spans(spark, sf):
    """(predictions, targets) without their kinds."""
    p, t = sides(spark, sf)
    return p.drop("p_kind"), t.drop("t_kind")


def matching_sql(name: str, edges: str, key: str = "video_id") -> str:
    """CTEs that try every matching of the few spans of a key, prediction by prediction, with a mask of
    used targets. ``{name}``: per key the greatest row of used predictions (as bits, the first
    highest), which is the one a traversal in order keeps, their number, the highest weight with that many pairs, and the
    highest weight at all. Needs WITH RECURSIVE."""
    return f"""{name}_p AS (SELECT {key}, p_no, row_number() OVER (PARTITION BY {key} ORDER BY p_no) AS i FROM (SELECT DISTINCT {key}, p_no FROM {edges})),
{name}_t AS (SELECT {key}, t_no, 1::BIGINT << (row_number() OVER (PARTITION BY {key} ORDER BY t_no) - 1)::INT AS bit FROM (SELECT DISTINCT {key}, t_no FROM {edges})),
{name}_c AS (SELECT {key}, i, bit, similarity FROM {edges} JOIN {name}_p USING ({key}, p_no) JOIN {name}_t USING ({key}, t_no)
  UNION ALL SELECT {key}, i, 0, 0 FROM {name}_p),
{name}_s AS (SELECT DISTINCT {key}, 0::BIGINT AS i, 0::BIGINT AS mask, 0::BIGINT AS used, 0::DOUBLE AS w FROM {name}_p
  UNION ALL SELECT s.{key}, c.i, s.mask | c.bit, s.used * 2 + (c.bit > 0)::BIGINT, s.w + c.similarity
  FROM {name}_s s JOIN {name}_c c ON c.{key} = s.{key} AND c.i = s.i + 1 AND (s.mask & c.bit) = 0),
{name}_n AS (SELECT {key}, max(i) AS n FROM {name}_p GROUP BY {key}),
{name}_e AS (SELECT s.{key}, n, used, w, max(used) OVER (PARTITION BY s.{key}) AS top FROM {name}_s s JOIN {name}_n m ON m.{key} = s.{key} AND i = n),
{name} AS (SELECT {key}, n, top, bit_count(top)::BIGINT AS pairs, max(w) FILTER (bit_count(used) = bit_count(top)) AS weight, max(w) AS free_weight
  FROM {name}_e GROUP BY {key}, n, top),
{name}_used AS (SELECT {key}, p_no, pairs FROM {name} JOIN {name}_p USING ({key}) WHERE (top >> (n - i)::INT) & 1 = 1)"""


def recursive(*parts: str) -> str:
    return fx.with_sql(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def near_sql(name: str, where: str) -> str:
    return f"{name} AS (SELECT video_id, p_no, t_no, similarity FROM edges WHERE {where})"


def pair_columns(pairs):
    """Pairs with their IoU and the share of the target that is covered."""
    return pairs.select(
        "video_id", "p_no", "t_no", F.round("similarity", 6).alias("similarity"), F.round(iv.reference_coverage(*sg.SPANS), 6).alias("coverage")
    )


def span_pairs(spark, sf, solver, threshold):
    return sg.match_spans(*spans(spark, sf), KEYS, solver, threshold, keep=sg.SPANS)


# Several matchings can be equally good, and which pairs a traversal takes is no property that SQL can state, so the queries that
# return pairs are tested against plain walks; a query of totals beside each has the SQL check.


@query("mt_max_cardinality")
def _(spark, sf):
    return pair_columns(span_pairs(spark, sf, mt.traversal_matching, 0.3))


@query(
    "mt_max_cardinality_used",
    recursive("seg", EDGES_SQL, near_sql("near", "similarity >= 0.3"), matching_sql("m", "near")) + "SELECT video_id, p_no, pairs FROM m_used",
)
def _(spark, sf):
    """The predictions that a traversal in order matches, and how many they are."""
    pairs = materialize(span_pairs(spark, sf, mt.traversal_matching, 0.3).select("video_id", "p_no"), "pairs")
    return pairs.join(pairs.groupBy("video_id").agg(F.count(F.lit(1)).alias("pairs")), "video_id")


def weights(pairs):
    return pairs.groupBy("video_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("similarity"), 6).alias("weight"))


@query("mt_max_weight_cardinality")
def _(spark, sf):
    return pair_columns(span_pairs(spark, sf, mt.weighted_cardinality_matching, 0.3))


@query(
    "mt_max_weight_cardinality_totals",
    recursive("seg", EDGES_SQL, near_sql("near", "similarity >= 0.3"), matching_sql("m", "near"))
    + "SELECT video_id, pairs, round(weight, 6) AS weight FROM m",
)
def _(spark, sf):
    return weights(span_pairs(spark, sf, mt.weighted_cardinality_matching, 0.3))


@query("mt_max_weight")
def _(spark, sf):
    return pair_columns(span_pairs(spark, sf, mt.weighted_matching, 0.0))


@query(
    "mt_max_weight_totals",
    recursive("seg", EDGES_SQL, near_sql("near", "similarity > 0"), matching_sql("m", "near"))
    + "SELECT video_id, round(free_weight, 6) AS weight FROM m",
)
def _(spark, sf):
    return weights(span_pairs(spark, sf, mt.weighted_matching, 0.0)).drop("pairs")


def required_and_optional(spark, sf):
    """Predictions, positive (required) and uncertain (optional) targets."""
    p, t = sides(spark, sf)
    pick = lambda kind: t.filter(F.col("t_kind") == kind).drop("t_kind")
    return p.drop("p_kind"), pick("positive"), pick("uncertain")


TWO_STAGE_SQL = recursive(
    "seg", EDGES_SQL, near_sql("req", "t_kind = 'positive' AND similarity >= 0.3"), matching_sql("m", "req"),
    near_sql("opt", "t_kind = 'uncertain' AND similarity >= 0.3 AND NOT EXISTS (SELECT 1 FROM m_used u WHERE u.video_id = edges.video_id AND u.p_no = edges.p_no)"),
    matching_sql("o", "opt"),
)


@query("mt_two_stage")
def _(spark, sf):
    required, optional = sg.two_stage(*required_and_optional(spark, sf), KEYS, 0.3, keep=sg.SPANS)
    mark = lambda pairs, stage: pair_columns(pairs).withColumn("stage", F.lit(stage))
    return mark(required, "required").unionByName(mark(optional, "optional"))


@query(
    "mt_two_stage_used",
    TWO_STAGE_SQL + "SELECT video_id, p_no, 'required' AS stage FROM m_used UNION ALL SELECT video_id, p_no, 'optional' FROM o_used",
)
def _(spark, sf):
    required, optional = sg.two_stage(*required_and_optional(spark, sf), KEYS, 0.3)
    mark = lambda pairs, stage: pairs.select("video_id", "p_no", F.lit(stage).alias("stage"))
    return mark(required, "required").unionByName(mark(optional, "optional"))


@query(
    "mt_duplicates",
    TWO_STAGE_SQL
    + """SELECT DISTINCT video_id, p_no FROM edges WHERE t_kind IN ('positive', 'uncertain') AND similarity >= 0.3
EXCEPT (SELECT video_id, p_no FROM m_used UNION ALL SELECT video_id, p_no FROM o_used)""",
)
def _(spark, sf):
    p, required, optional = required_and_optional(spark, sf)
    edges = sg.stage_edges(p, required, optional, KEYS, 0.3)
    first, second = sg.two_stage(p, required, optional, KEYS, 0.3, edges=edges)
    pairs = first.select("video_id", "p_no").unionByName(second.select("video_id", "p_no"))
    return mt.duplicate_numbers(p, edges, pairs, KEYS)


HALF_SQL = [EDGES_SQL, near_sql("near", "similarity >= 0.5"), matching_sql("m", "near")]


def half_pairs(spark, sf):
    """Pairs of the ordered matching at IoU 0.5."""
    return materialize(sg.match_spans(*spans(spark, sf), KEYS, mt.traversal_matching, 0.5).select("video_id", "p_no", "t_no"), "pairs")


@query("mt_unmatched")
def _(spark, sf):
    """Predictions and targets that the ordered matching at IoU 0.5 leaves over."""
    p, t = sides(spark, sf)
    pairs = half_pairs(spark, sf)
    left = lambda rows, number, side: mt.unmatched(rows, pairs, KEYS, number).select("video_id", F.col(number).alias("no"), F.lit(side).alias("side"))
    return left(p, "p_no", "prediction").unionByName(left(t, "t_no", "target"))


@query(
    "mt_unmatched_totals",
    recursive("seg", *HALF_SQL)
    + """SELECT video_id, CAST(seg_no AS VARCHAR) AS missed, 'prediction' AS side FROM seg s WHERE side = 1 AND NOT EXISTS (SELECT 1 FROM m_used u WHERE u.video_id = s.video_id AND u.p_no = s.seg_no)
UNION ALL SELECT video_id, CAST(n - coalesce(pairs, 0) AS VARCHAR), 'targets' FROM (SELECT video_id, count(*) AS n FROM seg WHERE side = 0 GROUP BY video_id) t LEFT JOIN (SELECT video_id, pairs FROM m) USING (video_id)
WHERE n > coalesce(pairs, 0)""",
)
def _(spark, sf):
    """Unmatched predictions by number; of unmatched targets how many, as equal matchings leave different ones."""
    p, t = sides(spark, sf)
    pairs = half_pairs(spark, sf)
    left = mt.unmatched(t, pairs, KEYS, "t_no").groupBy("video_id").agg(F.count(F.lit(1)).cast("string").alias("missed"))
    return mt.unmatched(p, pairs, KEYS, "p_no").select(
        "video_id", F.col("p_no").cast("string").alias("missed"), F.lit("prediction").alias("side")
    ).unionByName(left.withColumn("side", F.lit("targets")))


def video_answers(spark, sf):
    """One JSON answer per video from its prediction rows; some are cut off and so no JSON.

    An answer is the text of one model call, so its list of spans is short by nature."""
    span = F.format_string('{"start_sec": %.1f, "end_sec": %.1f}', "start_sec", "end_sec")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seg_no", span.alias("x")))), lambda r: r["x"])
    rows = fx.seg(spark, sf).filter("side = 1").groupBy("video_id").agg(listed.alias("spans"))
    text = F.concat(F.lit('{"segments": ['), F.array_join(F.coalesce("spans", F.array().cast("array<string>")), ", "), F.lit("]}"))
    cut = F.col("video_id") % 10 == 7
    return fx.videos(spark, sf).join(rows, "video_id", "left").select(
        "video_id", "drama_id", F.when(cut, F.substring(text, 1, 20)).otherwise(text).alias("text"), "duration_sec",
        F.lit(0.0).alias("core_start"), F.lit(48.0).alias("core_end"),
    )


def scored_answers(spark, sf):
    _, t = sides(spark, sf)
    targets = t.filter("t_kind = 'positive'").select("video_id", "t_no", "t_start", "t_end")
    return sg.soft_f1(video_answers(spark, sf), targets, KEYS)


SOFT_SQL = [
    "seg", "videos",
    "ans AS (SELECT v.video_id, v.drama_id, coalesce(n, 0) AS n, v.video_id % 10 = 7 AND coalesce(n, 0) > 0 AS bad FROM videos v LEFT JOIN (SELECT video_id, count(*) AS n FROM seg WHERE side = 1 GROUP BY video_id) s USING (video_id))",
    "good AS (SELECT seg.* FROM seg JOIN ans USING (video_id) WHERE side = 1 AND NOT bad AND start_sec >= 0 AND start_sec < end_sec AND end_sec <= 64 AND (start_sec + end_sec) / 2 >= 0 AND (start_sec + end_sec) / 2 < 48)",
    """el AS (SELECT p.video_id, p.seg_no AS p_no, t.seg_no AS t_no,
  (least(p.end_sec, t.end_sec) - greatest(p.start_sec, t.start_sec)) / (greatest(p.end_sec, t.end_sec) - least(p.start_sec, t.start_sec)) AS similarity
  FROM good p JOIN seg t ON p.video_id = t.video_id AND t.side = 0 AND t.kind = 'positive' AND p.start_sec < t.end_sec AND t.start_sec < p.end_sec)""",
    matching_sql("m", "el"), "e3 AS (SELECT * FROM el WHERE similarity >= 0.3)", matching_sql("m3", "e3"), "e5 AS (SELECT * FROM el WHERE similarity >= 0.5)", matching_sql("m5", "e5"),
    "nt AS (SELECT video_id, count(*) AS n_t FROM seg WHERE side = 0 AND kind = 'positive' GROUP BY video_id)",
    "ng AS (SELECT video_id, count(*) AS n_g FROM good GROUP BY video_id)",
    """c AS (SELECT ans.video_id, drama_id, NOT bad AS format_valid, CASE WHEN bad THEN 0 ELSE ans.n END AS predicted_count, CASE WHEN bad THEN 0 ELSE ans.n - coalesce(n_g, 0) END AS invalid_segments,
  coalesce(n_t, 0) AS target_count, coalesce(m3.pairs, 0) AS hits30, coalesce(m5.pairs, 0) AS hits50, coalesce(m.free_weight, 0) AS w
  FROM ans LEFT JOIN nt ON nt.video_id = ans.video_id LEFT JOIN ng ON ng.video_id = ans.video_id LEFT JOIN m ON m.video_id = ans.video_id LEFT JOIN m3 ON m3.video_id = ans.video_id LEFT JOIN m5 ON m5.video_id = ans.video_id)""",
    """sc AS (SELECT c.* EXCLUDE (w), CASE WHEN NOT format_valid THEN 0 WHEN predicted_count + target_count = 0 THEN 1 ELSE 2 * w / (predicted_count + target_count) END AS score,
  target_count > 0 AS positive, target_count > 0 AND format_valid AND predicted_count = 0 AS empty_positive, target_count = 0 AND predicted_count > 0 AS empty_negative_false_alarm FROM c)""",
]


@query("mt_soft_f1", recursive(*SOFT_SQL) + "SELECT * REPLACE (round(score, 6) AS score) FROM sc")
def _(spark, sf):
    return scored_answers(spark, sf).withColumn("score", F.round("score", 6))


# --- sampling: one window per video, category by its positives ----------------------------------

SAMPLE_SQL = """samples AS (SELECT concat('w', CAST(v.video_id AS VARCHAR)) AS sample_id, v.drama_id, v.video_id,
  CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n = 1 THEN 'single' ELSE 'multiple' END AS category,
  v.price < 30000 AS focus FROM videos v LEFT JOIN (SELECT video_id, count(*) AS n FROM seg WHERE kind = 'positive' GROUP BY video_id) s ON s.video_id = v.video_id
  WHERE v.split = 'train')"""


def samples(spark, sf):
    n = fx.seg(spark, sf).filter("kind = 'positive'").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    v = fx.videos(spark, sf).filter("split = 'train'").join(n, "video_id", "left")
    return v.select(
        F.concat(F.lit("w"), "video_id").alias("sample_id"), "drama_id", "video_id",
        lb.window_category(F.coalesce("n", F.lit(0))).alias("category"), (F.col("price") < 30000).alias("focus"),
    )


def quota_sql(size: int) -> str:
    return f"""c AS (SELECT category, count(*) AS n FROM samples GROUP BY category),
q0 AS (SELECT category, n, ({size} * n) // sum(n) OVER () AS fl, ({size} * n) % sum(n) OVER () AS rest FROM c),
quota AS (SELECT category, n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, category) <= {size} - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q0)"""


QUOTA_SQL = quota_sql(1000)


@query("smp_quotas", fx.with_sql("seg", "videos", SAMPLE_SQL, QUOTA_SQL) + "SELECT category, n, quota FROM quota")
def _(spark, sf):
    return sm.quotas(samples(spark, sf), 1000)


DRAW_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY category, drama_id ORDER BY sha256(concat('42:', sample_id)), sample_id) AS round_no FROM {src}),
d AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round_no, sha256(concat('42:', drama_id)), drama_id) AS draw_no FROM r)"""


@query(
    "smp_round_robin",
    fx.with_sql("seg", "videos", SAMPLE_SQL, QUOTA_SQL, DRAW_SQL.format(src="samples"))
    + "SELECT sample_id, drama_id, category, round_no, draw_no FROM d JOIN quota USING (category) WHERE draw_no <= quota",
)
def _(spark, sf):
    rows = samples(spark, sf)
    wanted = sm.quotas(rows, 1000).select("category", F.col("quota").alias("take"))
    return sm.round_robin(rows, wanted, 42).select("sample_id", "drama_id", "category", "round_no", "draw_no")


def focus_sql(size: int) -> str:
    """The sample of one size, or the reasons why it may not be drawn."""
    return "(" + fx.with_sql(
        "seg", "videos", SAMPLE_SQL, quota_sql(size), "f AS (SELECT category, count(*) AS nf FROM samples WHERE focus GROUP BY category)",
        "reg AS (SELECT * FROM samples WHERE NOT focus)", DRAW_SQL.format(src="reg"),
        f"""bad AS (SELECT 'invalid_size' AS refusal FROM (SELECT count(*) AS n FROM samples) WHERE n < {size}
  UNION ALL SELECT concat('focus_exceeds_quota:', category) FROM f JOIN quota USING (category) WHERE nf > quota)""",
    ) + f"""SELECT {size} AS size, sample_id, category, focus, sha256(concat('43:', sample_id)) AS shuffle_key, NULL AS refusal FROM samples WHERE focus AND NOT EXISTS (SELECT 1 FROM bad)
UNION ALL SELECT {size}, sample_id, category, focus, sha256(concat('43:', sample_id)), NULL FROM d JOIN quota USING (category) LEFT JOIN f USING (category) WHERE draw_no <= quota - coalesce(nf, 0) AND NOT EXISTS (SELECT 1 FROM bad)
UNION ALL SELECT {size}, NULL, NULL, NULL, NULL, refusal FROM bad)"""


SIZES = (1000, 100)


@query("smp_focus_stratified", " UNION ALL ".join(focus_sql(n) for n in SIZES))
def _(spark, sf):
    """Samples of two sizes; one that may not be drawn gives its refusals instead."""
    rows = samples(spark, sf)
    focus = rows.filter("focus").select("sample_id")
    found = []
    for size in SIZES:
        try:
            drawn = sm.focus_stratified(rows.drop("focus"), focus, size, 42)
            found.append(drawn.select(F.lit(size).alias("size"), "sample_id", "category", "focus", "shuffle_key", F.lit(None).cast("string").alias("refusal")))
        except sm.SampleRefused as refused:
            found.append(spark.createDataFrame([(size, None, None, None, None, r) for r in refused.reasons], "size int, sample_id string, category string, focus boolean, shuffle_key string, refusal string"))
    return found[0].unionByName(found[1])


@query(
    "smp_default_size",
    fx.with_sql("seg", "videos", SAMPLE_SQL)
    + "SELECT count(*) AS train, count(*) FILTER (focus) AS focus_rows, least(count(*), 2 * count(*) FILTER (focus)) AS size FROM samples",
)
def _(spark, sf):
    n = samples(spark, sf).agg(F.count(F.lit(1)).alias("train"), F.count_if("focus").alias("focus_rows"))
    return n.withColumn("size", sm.default_size(F.col("train"), F.col("focus_rows")))


def scored_windows(spark, sf):
    """Usable windows scored against answers made from the video's prediction rows."""
    options = wn.WindowOptions(10.0, 10.0, 20.0)
    tiles = wn.classify_tiles(labelled_videos(spark, sf), fx.seg(spark, sf), options, known_only=True).filter("outcome IN ('positive', 'empty')")
    keyed = tiles.withColumn("sample_id", wn.sample_id("video_id", "core_start", "core_end"))
    windows = keyed.select(
        "sample_id", "video_id", "drama_id", (F.col("read_end") - F.col("read_start")).alias("view_sec"),
        (F.col("core_start") - F.col("read_start")).alias("core_start"), (F.col("core_end") - F.col("read_start")).alias("core_end"), "segments",
    )
    owned = wn.midpoint_windows(
        fx.seg(spark, sf).filter("side = 1").select("video_id", "seg_no", "start_sec", "end_sec"),
        keyed.select("video_id", "tile_no", "sample_id", "core_start", "core_end", "read_start"), 10.0,
    )
    span = F.format_string(
        '{"start_sec": %.1f, "end_sec": %.1f}', F.col("start_sec") - F.col("read_start"), F.col("end_sec") - F.col("read_start")
    )
    texts = owned.groupBy("sample_id").agg(F.array_join(F.sort_array(F.collect_list(span)), ", ").alias("t"))
    answers = keyed.join(texts, "sample_id", "left").select(
        "sample_id",
        F.when(F.col("video_id") % 10 == 7, F.lit("cut off")).otherwise(F.concat(F.lit('{"segments": ['), F.coalesce("t", F.lit("")), F.lit("]}"))).alias("text"),
        (F.col("video_id") % 10 == 7).alias("truncated"), (F.col("video_id") % 60 / 10.0).alias("generation_sec"),
    )
    return sg.score_windows(windows, answers)


@query("smp_examples")
def _(spark, sf):
    return sm.first_examples(scored_windows(spark, sf)["details"])


STEP_SQL = """SELECT user_id AS run, event_id AS step, round(value / 500, 3) AS f1, round((event_id % 7) / 7.0, 3) AS recall, (event_id % 3) / 3.0 AS fp FROM events"""


@query(
    "sel_best_step",
    f"""SELECT run, step AS best_step, f1 AS f1_iou50, recall AS recall_iou30 FROM (SELECT *, row_number() OVER (PARTITION BY run
  ORDER BY f1 DESC, recall DESC, fp, step) AS rn FROM ({STEP_SQL})) WHERE rn = 1""",
)
def _(spark, sf):
    steps = fx.timeline(spark, sf).select(
        F.col("job").alias("run"), F.col("pos").alias("step"), F.round(F.col("value") / 500, 3).alias("f1_iou50"),
        F.round(F.col("pos") % 7 / F.lit(7.0), 3).alias("recall_iou30"), (F.col("pos") % 3 / F.lit(3.0)).alias("empty_window_false_positive_rate"),
    )
    return sel.best_step(steps)


# plans and decisions per order: event e<line>, decision by part and supplier numbers
PLAN = [
    "l_orderkey AS job_id", f"CAST({fx.SEG_NO} AS {{text}}) AS event_id", "CAST(l_quantity AS DOUBLE) AS start_sec",
    "CAST(l_quantity + 4 + l_linenumber AS DOUBLE) AS end_sec", "CASE WHEN l_tax > 0.07 THEN 'infeasible_duration' ELSE 'ready' END AS status",
    "l_partkey % 3 <> 0 AS selected", "l_suppkey AS supp", "l_partkey AS part", "l_linenumber AS line",
]


def plan_rows(spark, sf):
    return fx.table(spark, sf, "lineitem").selectExpr(*[c.format(text="STRING") for c in PLAN])


PLAN_SQL = "plans AS (SELECT " + ", ".join(c.format(text="VARCHAR") for c in PLAN) + " FROM lineitem)"


@query(
    "sel_decisions_check",
    fx.with_sql(
        PLAN_SQL, "dec AS (SELECT job_id, event_id, selected, CASE WHEN line = 2 THEN event_id END AS dup FROM plans WHERE supp % 10 <> 0 UNION ALL SELECT job_id, event_id, selected, NULL FROM plans WHERE supp % 10 = 9)",
        "once AS (SELECT job_id, event_id, count(*) AS n, bool_or(selected) AS selected FROM dec GROUP BY job_id, event_id)",
        "picked AS (SELECT p.job_id, p.event_id, p.start_sec, p.end_sec, p.status FROM plans p JOIN once o ON o.job_id = p.job_id AND o.event_id = p.event_id AND o.selected)",
        "sums AS (SELECT job_id, count(*) AS c, sum(end_sec - start_sec) AS s FROM picked GROUP BY job_id)",
        "budget AS (SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 2 = 0 THEN 3 END AS mc, CASE WHEN o_custkey % 3 = 0 THEN 30.0 END AS ms, o_orderstatus <> 'P' AS allow FROM orders)",
        "seq AS (SELECT p.job_id, p.start_sec, lag(p.end_sec) OVER (PARTITION BY p.job_id ORDER BY p.start_sec, p.event_id) AS pe FROM picked p JOIN budget b ON b.job_id = p.job_id AND NOT b.allow)",
    )
    + """SELECT job_id, 'decisions_do_not_cover' AS reason FROM plans p WHERE NOT EXISTS (SELECT 1 FROM once o WHERE o.job_id = p.job_id AND o.event_id = p.event_id AND o.n = 1)
UNION SELECT job_id, 'infeasible_selected' FROM picked WHERE status = 'infeasible_duration'
UNION SELECT d.job_id, 'duplicate_of_unselected' FROM dec d WHERE d.dup IS NOT NULL AND NOT EXISTS (SELECT 1 FROM picked p WHERE p.job_id = d.job_id AND p.event_id = d.dup)
UNION SELECT s.job_id, 'count_budget' FROM sums s JOIN budget b USING (job_id) WHERE s.c > b.mc
UNION SELECT s.job_id, 'seconds_budget' FROM sums s JOIN budget b USING (job_id) WHERE s.s > b.ms + 1e-9
UNION SELECT job_id, 'overlap' FROM seq WHERE pe > start_sec""",
)
def _(spark, sf):
    plans = plan_rows(spark, sf)
    decisions = plans.filter("supp % 10 <> 0").select(
        "job_id", "event_id", "selected", F.when(F.col("line") == 2, F.col("event_id")).alias("duplicate_of")
    ).unionByName(plans.filter("supp % 10 = 9").select("job_id", "event_id", "selected", F.lit(None).cast("string").alias("duplicate_of")))
    budgets = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS job_id", "CASE WHEN o_custkey % 2 = 0 THEN 3 END AS max_count",
        "CASE WHEN o_custkey % 3 = 0 THEN 30.0D END AS max_seconds", "o_orderstatus <> 'P' AS allow_overlap",
    )
    return sel.decision_violations(plans, decisions, budgets)


@query(
    "sel_publishable",
    fx.with_sql(PLAN_SQL)
    + """SELECT job_id, event_id, CASE WHEN status <> 'ready' THEN 'not_ready' WHEN supp % 4 = 0 THEN 'not_reviewed' WHEN line = 5 THEN 'has_issues' ELSE 'no_media' END AS reason
FROM plans WHERE selected AND (status <> 'ready' OR supp % 4 = 0 OR line = 5 OR part % 5 = 0)""",
)
def _(spark, sf):
    rows = plan_rows(spark, sf).filter("selected").withColumns(
        {
            "review": F.when(F.col("supp") % 4 != 0, "seen"),
            "issues": F.when(F.col("line") == 5, F.array(F.lit("cutoff"))).otherwise(F.array().cast("array<string>")),
            "media_path": F.when(F.col("part") % 5 != 0, "clip"),
        }
    )
    return sel.unpublishable(rows).select("job_id", "event_id", "reason")


@query(
    "sel_media_align",
    f"WITH {PAIRS_SQL}, {CLIP_SQL}, " + """pl AS (SELECT video_id, seg_no, line, CAST(fs AS DOUBLE) AS s, CAST(fe AS DOUBLE) AS e, fe - fs > 30 OR fe - fs < 25 AS bad FROM p3),
sn AS (SELECT *, CASE WHEN line = 6 THEN s + 1 ELSE floor(s / 4) * 4 END AS a, CASE WHEN line = 5 THEN e + 64 ELSE ceil(e / 4) * 4 END AS b FROM pl),
er AS (SELECT *, CASE WHEN NOT (a >= 0 AND a < b AND b <= 64) THEN 'outside_video' WHEN a > s OR b < e THEN 'discards_content' END AS error FROM sn)
SELECT video_id, seg_no, CASE WHEN error IS NULL THEN a ELSE s END AS start_sec, CASE WHEN error IS NULL THEN b ELSE e END AS end_sec, error AS align_error,
  CASE WHEN error IS NOT NULL THEN CASE WHEN bad THEN 'infeasible_duration' ELSE 'draft' END WHEN bad OR b - a > 30 THEN 'infeasible_duration' ELSE 'draft' END AS plan_status FROM er""",
)
def _(spark, sf):
    plans = clip_plans(spark, sf).withColumn("reviewed", F.lit(True))
    snapped = plans.select(
        "video_id", "seg_no",
        F.when(F.col("line") == 6, F.col("start_sec") + 1).otherwise(F.floor(F.col("start_sec") / 4) * 4).cast("double").alias("src_start_sec"),
        F.when(F.col("line") == 5, F.col("end_sec") + 64).otherwise(F.ceil(F.col("end_sec") / 4) * 4).cast("double").alias("src_end_sec"),
    )
    out = sel.align_media(plans, snapped, ["video_id", "seg_no"], max_clip_sec=30.0)
    return out.select("video_id", "seg_no", "start_sec", "end_sec", "align_error", "plan_status")

