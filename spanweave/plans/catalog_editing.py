"""Highlight edits over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import editing as ed
from ..operators import store
from . import fixtures as fx
from .registry import query

HIGHLIGHT = [
    "l_orderkey AS job_id", f"CAST({fx.SEG_NO} AS {{text}}) AS highlight_id", "CAST(l_quantity AS DOUBLE) AS start_sec",
    "CAST(l_quantity + 4 + l_linenumber AS DOUBLE) AS end_sec", "l_discount AS score", "l_linestatus AS highlight_type",
    "concat('clip ', l_returnflag) AS description", "concat('why ', l_linestatus) AS reason", "'u' AS clip_url", "'pending' AS review_status",
    "CAST(64.0 AS DOUBLE) AS duration_sec", "l_linenumber AS line", "l_partkey AS part", "l_suppkey AS supp",
]
HL_SQL = "hl AS (SELECT " + ", ".join(c.format(text="VARCHAR") for c in HIGHLIGHT) + " FROM lineitem)"


def highlights(spark, sf):
    return fx.table(spark, sf, "lineitem").selectExpr(*[c.format(text="STRING") for c in HIGHLIGHT])


def ranges_sql(new_start: str, new_end: str) -> str:
    """Edited rows and rejected commands as one table."""
    return f"""c AS (SELECT job_id, line, highlight_id, supp % 50 = 0 AS unknown, {new_start} AS s, {new_end} AS e FROM hl),
x AS (SELECT *, CASE WHEN unknown THEN 'unknown_highlight' WHEN s < 0 OR e > 64 THEN 'out_of_video' WHEN e - s < 0.5 THEN 'too_short' END AS error FROM c),
bad AS (SELECT job_id, line, min(error) AS error FROM x WHERE error IS NOT NULL GROUP BY job_id, line)
SELECT job_id, CAST(line AS BIGINT) AS command_no, highlight_id, round(s, 3) AS start_sec, round(e, 3) AS end_sec, NULL AS error FROM x
  WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.job_id = x.job_id AND b.line = x.line)
UNION ALL SELECT job_id, line, NULL, NULL, NULL, error FROM bad"""


def edited_rows(spark, sf, commands):
    """Run range commands whose targets are unknown for some suppliers."""
    h = highlights(spark, sf)
    target = F.when(F.col("supp") % 50 == 0, F.concat(F.lit("x"), "highlight_id")).otherwise(F.col("highlight_id"))
    rows = commands(h).withColumns({"highlight_id": target, "command_no": F.col("line").cast("bigint")}).select(
        "job_id", "command_no", "operation", "highlight_id", "delta_sec", "new_start", "new_end"
    ).withColumnsRenamed({"new_start": "start_sec", "new_end": "end_sec"})
    edited, rejected = ed.edit_ranges(h, rows)
    return edited.drop("review_status").unionByName(rejected, allowMissingColumns=True)


@query(
    "ed_move",
    f"WITH {HL_SQL}, " + ranges_sql(
        "CASE WHEN line % 2 = 0 THEN greatest(0, start_sec + part % 11 - 5) ELSE start_sec END",
        "CASE WHEN line % 2 = 1 THEN least(64, end_sec + (part % 31 - 20) / 2.0::DOUBLE) ELSE end_sec END",
    ),
)
def _(spark, sf):
    even = F.col("line") % 2 == 0
    return edited_rows(
        spark, sf,
        lambda h: h.withColumns(
            {
                "operation": F.when(even, "move_start").otherwise("move_end"),
                "delta_sec": F.when(even, (F.col("part") % 11 - 5).cast("double")).otherwise((F.col("part") % 31 - 20) / 2.0),
                "new_start": F.lit(None).cast("double"), "new_end": F.lit(None).cast("double"),
            }
        ),
    )


@query(
    "ed_set_range",
    f"WITH {HL_SQL}, " + ranges_sql(
        "CASE WHEN part % 3 = 0 THEN start_sec ELSE CAST(part % 60 AS DOUBLE) END", "CASE WHEN part % 4 = 0 THEN end_sec ELSE CAST(part % 60 + supp % 10 AS DOUBLE) END"
    ),
)
def _(spark, sf):
    return edited_rows(
        spark, sf,
        lambda h: h.withColumns(
            {
                "operation": F.lit("set_range"), "delta_sec": F.lit(None).cast("double"),
                "new_start": F.when(F.col("part") % 3 != 0, (F.col("part") % 60).cast("double")),
                "new_end": F.when(F.col("part") % 4 != 0, (F.col("part") % 60 + F.col("supp") % 10).cast("double")),
            }
        ),
    )


@query(
    "ed_delete",
    f"""WITH {HL_SQL}, del AS (SELECT job_id, highlight_id FROM hl WHERE line = 3 UNION ALL SELECT job_id, 'nope' FROM hl WHERE line = 4 AND job_id % 10 = 0),
bad AS (SELECT DISTINCT job_id FROM hl WHERE line = 4 AND job_id % 10 = 0)
SELECT job_id, highlight_id FROM hl WHERE line <> 3 OR job_id IN (SELECT job_id FROM bad)""",
)
def _(spark, sf):
    h = highlights(spark, sf)
    unknown = h.filter("line = 4 AND job_id % 10 = 0").select("job_id", F.lit("nope").alias("highlight_id"))
    kept, _ = ed.delete_highlights(h, h.filter("line = 3").select("job_id", "highlight_id").unionByName(unknown))
    return kept.select("job_id", "highlight_id")


def text_commands(h, word, times):
    text = F.concat(F.lit("  "), "highlight_id", F.repeat(F.lit(word), F.lit(times)), F.lit(" "))
    return h.filter("line = 2").select("job_id", "highlight_id", text.alias("text"))


@query(
    "ed_rename",
    f"""WITH {HL_SQL} SELECT job_id, highlight_id, CASE WHEN line = 2 THEN left(concat(highlight_id, repeat('片', 130)), 120) ELSE description END AS description,
  CASE WHEN line = 2 THEN 'revised' ELSE 'pending' END AS review_status FROM hl""",
)
def _(spark, sf):
    h = highlights(spark, sf)
    return ed.rename(h, text_commands(h, "片", 130)).select("job_id", "highlight_id", "description", "review_status")


@query(
    "ed_reason",
    f"""WITH {HL_SQL} SELECT job_id, highlight_id, CASE WHEN line = 2 THEN left(concat(highlight_id, repeat('ab', 200)), 300) ELSE reason END AS reason,
  CASE WHEN line = 2 THEN 'revised' ELSE 'pending' END AS review_status FROM hl""",
)
def _(spark, sf):
    h = highlights(spark, sf)
    return ed.set_reason(h, text_commands(h, "ab", 200)).select("job_id", "highlight_id", "reason", "review_status")


@query(
    "ed_split",
    f"""WITH {HL_SQL}, c AS (SELECT *, line = 1 AS cmd, start_sec + part % 12 AS cut FROM hl),
g AS (SELECT *, cmd AND cut - start_sec >= 0.5 AND end_sec - cut >= 0.5 AS go FROM c)
SELECT job_id, highlight_id, start_sec, CASE WHEN go THEN cut ELSE end_sec END AS end_sec, CASE WHEN go THEN concat(description, '（上）') ELSE description END AS description FROM g
UNION ALL SELECT job_id, CASE WHEN supp % 6 = 0 THEN concat(highlight_id, '_split_3') WHEN supp % 3 = 0 THEN concat(highlight_id, '_split_2') ELSE concat(highlight_id, '_split') END, cut, end_sec, concat(description, '（下）') FROM g WHERE go
UNION ALL SELECT job_id, concat(highlight_id, '_split'), start_sec, end_sec, description FROM g WHERE supp % 3 = 0
UNION ALL SELECT job_id, concat(highlight_id, '_split_2'), start_sec, end_sec, description FROM g WHERE supp % 6 = 0""",
)
def _(spark, sf):
    h = highlights(spark, sf)
    used = h.filter("supp % 3 = 0").withColumn("highlight_id", F.concat("highlight_id", F.lit("_split")))
    used2 = h.filter("supp % 6 = 0").withColumn("highlight_id", F.concat("highlight_id", F.lit("_split_2")))
    commands = h.filter("line = 1").select("job_id", "highlight_id", (F.col("start_sec") + F.col("part") % 12).alias("split_sec"))
    out, _ = ed.split_highlights(h.unionByName(used).unionByName(used2), commands)
    return out.select("job_id", "highlight_id", "start_sec", "end_sec", "description")


@query(
    "ed_merge",
    f"""WITH {HL_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_sec, end_sec, highlight_id) AS pos FROM hl),
t AS (SELECT * FROM p WHERE line % 2 = 0),
ok AS (SELECT job_id FROM t GROUP BY job_id HAVING max(pos) - min(pos) + 1 = count(*)),
m AS (SELECT t.* FROM t JOIN ok USING (job_id)),
d AS (SELECT job_id, description, min(pos) AS o FROM m GROUP BY job_id, description), w AS (SELECT job_id, reason, min(pos) AS o FROM m GROUP BY job_id, reason),
dj AS (SELECT job_id, string_agg(description, ' / ' ORDER BY o) AS description FROM d GROUP BY job_id), wj AS (SELECT job_id, string_agg(reason, '；' ORDER BY o) AS reason FROM w GROUP BY job_id),
b AS (SELECT * FROM (SELECT job_id, highlight_type, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, start_sec, end_sec, highlight_id) AS rn FROM m) WHERE rn = 1)
SELECT m.job_id, min_by(highlight_id, pos) AS highlight_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, max(score) AS score, any_value(b.highlight_type) AS highlight_type,
  any_value(dj.description) AS description, any_value(wj.reason) AS reason FROM m JOIN b USING (job_id) JOIN dj USING (job_id) JOIN wj USING (job_id) GROUP BY m.job_id""",
)
def _(spark, sf):
    h = highlights(spark, sf)
    targets = h.filter("line % 2 = 0").select("job_id", F.lit(1).alias("command_no"), "highlight_id")
    return ed.merge_highlights(h, targets).select(
        "job_id", "highlight_id", "start_sec", "end_sec", "score", "highlight_type", "description", "reason"
    )


@query(
    "ed_query",
    f"""WITH {HL_SQL} SELECT 'list' AS view, job_id, highlight_id AS item, row_number() OVER (PARTITION BY job_id ORDER BY start_sec, end_sec, highlight_id) AS place FROM hl
UNION ALL SELECT 'compare', job_id, highlight_id, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, start_sec, highlight_id) FROM hl
UNION ALL SELECT 'details', job_id, concat(highlight_id, ' ', highlight_type, ' ', CAST(round(score * 100) AS BIGINT)), place FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_sec, end_sec, highlight_id) AS place FROM hl) WHERE line % 2 = 0
UNION ALL SELECT 'history', conv_id, CAST(turn AS VARCHAR), rn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5""",
)
def _(spark, sf):
    h = highlights(spark, sf)
    turns = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("pos"))
    listed = ed.timeline_positions(h).select(F.lit("list").alias("view"), "job_id", F.col("highlight_id").alias("item"), F.col("position").alias("place"))
    compared = ed.score_positions(h).select(F.lit("compare").alias("view"), "job_id", F.col("highlight_id").alias("item"), F.col("position").alias("place"))
    asked = ed.details(h, h.filter("line % 2 = 0")).select(
        F.lit("details").alias("view"), "job_id", F.concat_ws(" ", "highlight_id", "highlight_type", "score_percent").alias("item"), F.col("position").alias("place")
    )
    last = ed.latest_history(turns).select(
        F.lit("history").alias("view"), "job_id", F.col("pos").cast("string").alias("item"), F.col("recency").cast("bigint").alias("place")
    )
    return listed.unionByName(compared).unionByName(asked).unionByName(last)


@query(
    "ed_candidate_upsert",
    f"""WITH {HL_SQL}, bad AS (SELECT DISTINCT job_id FROM hl WHERE job_id % 10 = 0)
SELECT job_id, highlight_id AS event_id, CASE WHEN line > 2 AND job_id % 10 > 0 AND supp % 5 = 0 THEN concat(description, '!') ELSE description END AS description,
  CASE WHEN line > 2 AND job_id % 10 > 0 AND supp % 3 = 0 THEN start_sec + 1 ELSE start_sec END AS start_sec,
  CASE WHEN line >= 6 THEN 1 WHEN line > 2 AND job_id % 10 > 0 AND (supp % 5 = 0 OR supp % 3 = 0) THEN line + 1 ELSE line END::BIGINT AS version,
  CASE WHEN line >= 6 THEN NULL WHEN line <= 2 OR job_id % 10 = 0 OR (supp % 5 <> 0 AND supp % 3 <> 0) THEN 'ready' WHEN supp % 3 = 0 THEN NULL ELSE 'draft' END AS plan_status,
  CASE WHEN line >= 6 THEN 'inserted' WHEN line <= 2 OR job_id % 10 = 0 THEN 'kept' WHEN supp % 5 = 0 OR supp % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome
FROM hl WHERE line < 6 OR job_id % 10 > 0""",
)
def _(spark, sf):
    h = highlights(spark, sf).withColumnRenamed("highlight_id", "event_id")
    current = h.filter("line < 6").select("job_id", "event_id", "description", "start_sec", F.col("line").cast("bigint").alias("version"), F.lit("ready").alias("plan_status"))
    proposed = h.filter("line > 2").select(
        "job_id", "event_id",
        F.when(F.col("supp") % 5 == 0, F.concat("description", F.lit("!"))).otherwise(F.col("description")).alias("description"),
        F.when(F.col("supp") % 3 == 0, F.col("start_sec") + 1).otherwise(F.col("start_sec")).alias("start_sec"),
    )
    violations = h.filter("job_id % 10 = 0").select("job_id")
    return ed.upsert_candidates(current, proposed, ["description", "start_sec"], ["start_sec"], violations)


@query(
    "ed_label_append",
    f"""WITH s AS (SELECT {fx.SEG_NO} AS no, l_orderkey AS video_id, l_partkey % 2 = 0 AND l_orderkey % 6 > 0 AS ok, l_returnflag <> 'R' AS certain FROM lineitem),
f AS (SELECT video_id, min(no) AS first FROM s WHERE ok GROUP BY video_id)
SELECT no AS submission_no, video_id, CASE WHEN ok AND no = first THEN 'accepted' ELSE 'conflict' END AS outcome,
  CASE WHEN ok AND no = first THEN CASE WHEN certain THEN 'ready' ELSE 'unresolved' END END AS new_status FROM s LEFT JOIN f USING (video_id)""",
)
def _(spark, sf):
    videos = fx.table(spark, sf, "orders").filter("o_orderkey % 6 > 0").selectExpr("o_orderkey AS video_id", "o_orderkey + 7 AS label_id")
    submissions = fx.table(spark, sf, "lineitem").selectExpr(
        f"{fx.SEG_NO} AS submission_no", "l_orderkey AS video_id", "CASE WHEN l_partkey % 2 = 0 THEN l_orderkey + 7 ELSE l_orderkey END AS expected_label_id",
        "CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS n_certain",
    )
    return store.append_labels(videos, submissions)
