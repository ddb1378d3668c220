"""Sources and sinks, exercised on files and tables that Spark derives from the supplied data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as lb
from ..operators import editing
from ..session import shared_folder
from ..sources import artifacts, journal, manifest, snapshot, subtitles, tables
from . import fixtures as fx
from .catalog_editing import HL_SQL, highlights
from .registry import query


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/spanweave/{name}-{uuid.uuid4().hex}"


@query(
    "src_manifest",
    fx.with_sql("videos")
    + """SELECT CAST(video_id AS VARCHAR) AS video_id, CASE WHEN video_id % 17 = 0 THEN 'blank_id' WHEN video_id % 19 = 0 OR video_id % 23 = 0 THEN 'invalid_duration' END AS reject_reason,
  CASE WHEN video_id % 17 > 0 AND video_id % 19 > 0 AND video_id % 23 > 0 THEN split END AS split FROM videos""",
)
def _(spark, sf):
    v = fx.videos(spark, sf)
    lines = v.select(
        F.to_json(
            F.struct(
                F.col("video_id").cast("string").alias("video_id"),
                F.when(F.col("video_id") % 17 == 0, F.lit("  ")).otherwise(F.col("drama_id")).alias("drama_id"),
                # a zero length, a missing length, or the real one
                F.when(F.col("video_id") % 19 == 0, 0.0).when(F.col("video_id") % 23 != 0, F.col("duration_sec")).alias("duration_sec"),
                F.lit("zh").alias("language"), F.lit("ignored").alias("another_key"),
            )
        ).alias("value")
    )
    path = scratch(spark, "manifest")
    lines.write.text(path)
    good, bad = manifest.split_manifest(manifest.read_manifest(spark, path))
    none = F.lit(None).cast("string")
    return good.select("video_id", none.alias("reject_reason"), "split").unionByName(
        bad.select("video_id", "reject_reason", none.alias("split"))
    )


REG_IN = [
    f"{fx.SEG_NO} * 0 + l_orderkey * 100 + l_linenumber AS pos", "l_orderkey AS video_id", "concat('d', CAST(o_custkey + CASE WHEN l_suppkey % 40 = 0 THEN 1 ELSE 0 END AS {text})) AS drama_id",
    "concat('h', CAST(l_orderkey - CASE WHEN l_suppkey % 30 = 0 THEN 100000000 ELSE 0 END AS {text})) AS sha256",
]
REG_OLD = ["o_orderkey AS video_id", "concat('d', CAST(o_custkey AS {text})) AS drama_id", "concat('h', CAST(o_orderkey AS {text})) AS sha256"]


@query(
    "src_register",
    "WITH inc AS (SELECT " + ", ".join(c.format(text="VARCHAR") for c in REG_IN) + " FROM lineitem JOIN orders ON o_orderkey = l_orderkey),\n"
    + "old AS (SELECT " + ", ".join(c.format(text="VARCHAR") for c in REG_OLD) + " FROM orders WHERE o_orderstatus = 'O'),\n"
    + """b AS (SELECT video_id, drama_id, sha256, NULL AS pos, TRUE AS old FROM old UNION ALL SELECT video_id, drama_id, sha256, pos, FALSE FROM inc),
i AS (SELECT video_id, count(DISTINCT sha256) > 1 AS clash FROM b GROUP BY video_id), h AS (SELECT sha256, count(DISTINCT drama_id) > 1 AS clash, bool_or(old) AS old, min(pos) AS first FROM b GROUP BY sha256),
o AS (SELECT inc.*, CASE WHEN i.clash OR h.clash THEN 'conflict' WHEN NOT h.old AND inc.pos = h.first THEN 'added' ELSE 'duplicate' END AS outcome
FROM inc JOIN i USING (video_id) JOIN h USING (sha256)),
r AS (SELECT 'whole' AS attempt, * FROM o UNION ALL SELECT 'clean', * FROM o WHERE outcome <> 'conflict'),
t AS (SELECT 'whole' AS attempt, CASE WHEN bool_or(outcome = 'conflict') THEN 0 ELSE count(DISTINCT video_id) FILTER (outcome = 'added') END AS more FROM o
  UNION ALL SELECT 'clean', CASE WHEN bool_or(outcome = 'conflict') THEN count(DISTINCT video_id) FILTER (outcome = 'added') ELSE 0 END FROM o),
g AS (SELECT attempt, CASE WHEN attempt = 'clean' AND NOT (SELECT bool_or(outcome = 'conflict') FROM o) AND outcome = 'added' THEN 'duplicate' ELSE outcome END AS outcome, video_id FROM r)
SELECT g.attempt, outcome, count(*) AS n, sum(video_id)::BIGINT AS id_sum, (SELECT count(*) FROM old) + CASE WHEN g.attempt = 'whole' THEN any_value(more) ELSE (SELECT sum(more)::BIGINT FROM t) END AS videos_after
FROM g JOIN t ON t.attempt = g.attempt GROUP BY g.attempt, outcome""",
)
def _(spark, sf):
    """Two attempts on one table: all rows, which any conflict stops as a whole, then the rows without conflicts."""
    o = fx.table(spark, sf, "orders")
    old = o.filter("o_orderstatus = 'O'").selectExpr(*[c.format(text="STRING") for c in REG_OLD])
    rows = fx.table(spark, sf, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(*[c.format(text="STRING") for c in REG_IN])
    table = scratch(spark, "videos")
    old.withColumn("split", lb.group_split("drama_id")).write.parquet(f"{table}/first")
    found = []
    for attempt in ("whole", "clean"):
        out = tables.register_videos(rows, table)
        # rows of one order with the same line number share a position and count alike
        totals = out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("video_id").alias("id_sum"))
        after = tables.read_videos(spark, table).count()
        found.append(totals.select(F.lit(attempt).alias("attempt"), "*", F.lit(after).cast("bigint").alias("videos_after")))
        rows = out.filter("outcome <> 'conflict'").drop("outcome")
    return found[0].unionByName(found[1])


@query("src_group_split", fx.with_sql("videos") + "SELECT video_id, drama_id, split FROM videos")
def _(spark, sf):
    v = fx.videos(spark, sf).select("video_id", "drama_id")
    return v.withColumn("split", lb.group_split("drama_id"))


@query(
    "src_dialogue",
    fx.with_sql("dialogues", "h AS (SELECT DISTINCT video_id, CASE WHEN video_id % 5 = 0 THEN 'other_content' WHEN video_id % 7 = 0 THEN 'not_at_zero' END AS reason FROM dialogues)")
    + """SELECT d.video_id, d.start_sec, d.source, NULL AS reason FROM dialogues d JOIN h USING (video_id) WHERE reason IS NULL AND d.end_sec <= 40
UNION ALL SELECT video_id, NULL, NULL, reason FROM h WHERE reason IS NOT NULL
UNION ALL SELECT DISTINCT d.video_id, NULL::DOUBLE, NULL, 'out_of_range' FROM dialogues d JOIN h USING (video_id) WHERE reason IS NULL AND d.end_sec > 40""",
)
def _(spark, sf):
    d = fx.dialogues(spark, sf)
    ids = d.select("video_id").distinct()
    v = ids.select("video_id", F.concat(F.lit("h"), "video_id").alias("sha256"), F.lit(40.0).alias("duration_sec"))
    records = v.select(
        "video_id", F.when(F.col("video_id") % 5 == 0, "x").otherwise(F.col("sha256")).alias("source_sha256"),
        F.when(F.col("video_id") % 7 == 0, 3.0).otherwise(0.0).alias("source_start"),
    )
    rows, bad = manifest.checked_dialogue(d, v, records)
    return rows.select("video_id", "start_sec", "source").unionByName(bad, allowMissingColumns=True)


@query(
    "src_subtitles",
    """SELECT conv_id, CAST(turn * 8 AS DOUBLE) AS start_sec, CAST(turn * 8 AS DOUBLE) + 2.5 AS end_sec, concat(CAST(conv_id AS VARCHAR), ' ', role, ' ', CAST(length(text) AS VARCHAR)) AS text
FROM conversations WHERE turn % 5 <> 4 AND turn % 7 <> 6""",
)
def _(spark, sf):
    """One cue block per turn, in subtitle files of some conversations each. Some cues run backwards, some are notes."""
    second = F.col("turn") * 8
    clock = lambda s, ms: F.format_string(f"%02d:%02d:%02d,{ms}", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    times = F.concat(clock(second, "000"), F.lit(" --> "), clock(second + F.when(F.col("turn") % 5 == 4, -2).otherwise(2), "500"))
    words = F.concat_ws(" ", F.concat(F.lit("<b>"), F.col("conv_id").cast("string"), F.lit("</b>")), "role", F.length("text").cast("string"))
    cue = F.concat_ws("\n", F.col("turn").cast("string"), times, words)
    block = F.when(F.col("turn") % 7 == 6, F.concat(F.lit("NOTE "), cue)).otherwise(cue)
    path = scratch(spark, "subtitles")
    blocks = fx.table(spark, sf, "conversations").select((F.col("conv_id") % 16).alias("batch"), "conv_id", "turn", block.alias("value"))
    ordered = blocks.repartition("batch").sortWithinPartitions("batch", "conv_id", "turn").select("batch", "value")
    ordered.write.partitionBy("batch").option("lineSep", "\n\n").text(path)
    read = subtitles.read_subtitles(spark, f"{path}/*")
    return read.select(F.regexp_extract("text", r"^(\d+) ", 1).cast("bigint").alias("conv_id"), "start_sec", "end_sec", "text")


JOURNALS = 8


@query(
    "src_journal",
    f"""SELECT CAST(ts AS DATE) AS day, user_id % {JOURNALS} AS journal, event_id AS pos, event_id % 50 = 0 AS bad FROM events""",
)
def _(spark, sf):
    """Journals of a day each, in files whose last line is whole JSON but not terminated, read split by split."""
    e = fx.table(spark, sf, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), (F.col("user_id") % JOURNALS).alias("journal"))
    line = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("broken "), "event_id")).otherwise(
        F.to_json(F.struct(F.col("event_id").alias("pos"), "event_type"))
    )
    # each row starts a new line, and the writer puts the closing brace behind it, so that no newline ends the file
    row = lambda text: F.concat(F.lit("\n"), F.regexp_replace(text, r"\}$", "")).alias("value")
    whole = e.select("day", "journal", F.col("event_id").alias("at"), row(line))
    last = e.select("day", "journal").distinct().select("day", "journal", F.lit(2**62).alias("at"), row(F.lit('{"pos": 1}')))
    path = scratch(spark, "journals")
    ordered = whole.unionByName(last).repartition("day", "journal").sortWithinPartitions("day", "journal", "at").drop("at")
    ordered.write.partitionBy("day", "journal").option("lineSep", "}").text(path)
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("day", T.DateType()), T.StructField("journal", T.LongType())])
    good, bad = journal.read_large_journal(spark, path, schema)
    number = F.regexp_extract("value", r"broken (\d+)", 1).cast("bigint")
    return good.select("day", "journal", F.try_variant_get("record", "$.pos", "bigint").alias("pos"), F.lit(False).alias("bad")).unionByName(
        bad.select("day", "journal", number.alias("pos"), F.lit(True).alias("bad"))
    )


@query(
    "src_run_artifacts",
    """SELECT CAST(o_orderkey AS VARCHAR) AS job, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderstatus = 'O' THEN 'complete' ELSE 'partial' END END AS completion,
  CASE WHEN o_orderkey % 3 > 0 THEN 2 ELSE 0 END::BIGINT AS attempts, CASE WHEN o_orderkey % 5 > 0 THEN 1 ELSE 0 END::BIGINT AS events, coalesce(n, 0) AS trace_rows
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def _(spark, sf):
    o = fx.table(spark, sf, "orders").withColumn("job", F.col("o_orderkey").cast("string"))
    root = scratch(spark, "run")
    o.filter("o_orderkey % 4 > 0").selectExpr(
        "job", "'2.0' AS schema_version", "CASE WHEN o_orderstatus = 'O' THEN 'complete' ELSE 'partial' END AS completion"
    ).write.json(f"{root}/result")
    o.filter("o_orderkey % 5 > 0").selectExpr(
        "job", "named_struct('events', array(named_struct('id', 'e1', 'status', 'supported')), 'plans', array()) AS tools"
    ).write.json(f"{root}/state")
    o.filter("o_orderkey % 3 > 0").selectExpr(
        "job", "array(named_struct('status', 'failed', 'elapsed_sec', 1.5D), named_struct('status', 'complete', 'elapsed_sec', 2D)) AS attempts"
    ).write.json(f"{root}/execution")
    fx.table(spark, sf, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS job", "'model' AS kind", "l_tax AS elapsed_sec", "array() AS calls"
    ).write.json(f"{root}/trace")
    return artifacts.items_with_artifacts(o.select("job"), artifacts.read_run_bundles(spark, root))


@query(
    "src_result_upgrade",
    f"""SELECT o_orderkey AS job_id, '2.0' AS schema_version, CASE WHEN old THEN 'complete' ELSE 'partial' END AS completion, CASE WHEN old THEN '{artifacts.LEGACY_MESSAGE}' ELSE 'm' END AS message,
  CASE WHEN old THEN 1.0 ELSE 0.5 END::DOUBLE AS scan_coverage, CASE WHEN old THEN '{artifacts.LEGACY_STOP_REASON}' ELSE 's' END AS stop_reason, CASE WHEN old THEN 0 ELSE 7 END::BIGINT AS model_calls
FROM (SELECT *, o_orderpriority = '5-LOW' AS old FROM orders)""",
)
def _(spark, sf):
    rows = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS job_id", "CASE WHEN o_orderpriority = '5-LOW' THEN '1.0' ELSE '2.0' END AS schema_version",
        "'partial' AS completion", "'m' AS message",
        "named_struct('scan_coverage', 0.5D, 'pending_event_count', 1L, 'pending_observation_count', 1L, 'pending_proposal_count', 1L,"
        " 'pending_review_count', 1L, 'stop_reason', 's', 'model_calls', 7L) AS analysis",
    )
    return artifacts.upgrade_results(rows).select(
        "job_id", "schema_version", "completion", "message", "analysis.scan_coverage", "analysis.stop_reason", "analysis.model_calls"
    )


def published(spark, sf) -> str:
    target = scratch(spark, "snapshot")
    tables = {"videos": fx.videos(spark, sf), "segments": fx.seg(spark, sf)}
    snapshot.publish(tables, target, {"videos": ["split"]})
    return target


@query("snk_snapshot", 'SELECT \'videos\' AS "table", count(*) AS rows FROM orders UNION ALL SELECT \'segments\', count(*) FROM lineitem')
def _(spark, sf):
    return spark.read.parquet(f"{published(spark, sf)}/_manifest").select("table", "rows")


@query("src_snapshot_read", fx.with_sql("videos") + "SELECT split, count(*) AS videos, count(DISTINCT drama_id) AS dramas FROM videos GROUP BY split")
def _(spark, sf):
    df = snapshot.read_published(spark, published(spark, sf), "videos")
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("videos"), F.count_distinct("drama_id").alias("dramas"))


@query(
    "snk_review_log",
    f"""WITH {HL_SQL}, d AS (SELECT *, CASE WHEN line % 3 > 0 THEN start_sec - supp % 8 END AS ns, CASE WHEN line % 2 > 0 THEN end_sec - part % 14 + 7 END AS ne FROM hl WHERE line < 6),
r AS (SELECT *, CASE WHEN ns IS NULL THEN start_sec ELSE greatest(0, ns) END AS s, CASE WHEN ne IS NULL THEN end_sec ELSE least(64, ne) END AS e FROM d)
SELECT job_id, highlight_id, CASE WHEN line % 2 > 0 THEN 'accepted' ELSE 'rejected' END AS review_status, CASE WHEN s <> start_sec OR e <> end_sec THEN '' ELSE clip_url END AS clip_url, CAST(s AS DOUBLE) AS start_sec, CAST(e AS DOUBLE) AS end_sec
FROM r WHERE e > s""",
)
def _(spark, sf):
    h = highlights(spark, sf)
    decisions = h.filter("line < 6").select(
        "job_id", "highlight_id", F.when(F.col("line") % 2 > 0, "accepted").otherwise("rejected").alias("status"),
        F.when(F.col("line") % 3 > 0, F.col("start_sec") - F.col("supp") % 8).alias("new_start"),
        F.when(F.col("line") % 2 > 0, F.col("end_sec") - F.col("part") % 14 + 7).alias("new_end"),
    )
    table = scratch(spark, "review_log")
    batches = {"odd": "job_id % 2 = 1", "even": "job_id % 2 = 0"}
    # the first batch is delivered twice
    for name in ("odd", "even", "odd"):
        log, _ = editing.apply_reviews(h.filter(batches[name]).drop("review_status"), decisions.filter(batches[name]))
        tables.append_batch(log, table, name)
    return tables.read_log(spark, table, log.schema).drop("batch")


@query(
    "snk_prediction_upsert",
    """WITH old AS (SELECT ps_k AS video_id, m AS model_id, max(p) AS payload FROM (SELECT l_orderkey AS ps_k, l_suppkey % 3 AS m, l_extendedprice AS p FROM lineitem WHERE l_linenumber < 5) GROUP BY ALL),
new AS (SELECT l_orderkey AS video_id, l_suppkey % 3 AS model_id, max(l_extendedprice) AS payload FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL)
SELECT coalesce(o.video_id, n.video_id) AS video_id, coalesce(o.model_id, n.model_id) AS model_id, coalesce(n.payload, o.payload) AS payload,
  CASE WHEN n.video_id IS NULL THEN 'kept' WHEN o.video_id IS NULL THEN 'inserted' WHEN o.payload = n.payload THEN 'unchanged' ELSE 'updated' END AS outcome
FROM old o FULL JOIN new n ON o.video_id = n.video_id AND o.model_id = n.model_id""",
)
def _(spark, sf):
    """The table as it is read back after the upsert, with what became of each key."""
    li = fx.table(spark, sf, "lineitem").selectExpr("l_orderkey AS video_id", "l_suppkey % 3 AS model_id", "l_extendedprice AS p", "l_linenumber AS line")
    pick = lambda where: li.filter(where).groupBy("video_id", "model_id").agg(F.max("p").alias("payload"))
    table = scratch(spark, "predictions")
    tables.write_predictions(pick("line < 5"), table)
    outcomes = tables.merge_predictions(pick("line > 1"), table)
    now = spark.read.parquet(table).drop("part").join(outcomes, ["video_id", "model_id"], "left")
    return now.withColumn("outcome", F.coalesce("outcome", F.lit("kept")))
