"""Native tables derived from the supplied parquet tables, as DataFrames and as SQL text.

Both forms describe the same rows, so the registered queries and their SQL check read the same
input. Every derivation is a projection of a whole table: no window, no row cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.labels import group_split


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# seg_no orders the segments of a video; it is a pure function of the row (no shuffle).
SEG_NO = (
    "(CAST(l_linenumber AS BIGINT) * 100 + CAST(l_quantity AS BIGINT)) * 10000000000000000"
    " + CAST(l_partkey AS BIGINT) * 10000000 + CAST(l_suppkey AS BIGINT)"
)
KIND = "CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'negative' ELSE 'uncertain' END"
STATUS = "CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'F' THEN 'queued' ELSE 'review' END"
SOURCE = "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'model_reviewed' ELSE 'model_scan' END"
DRAMA = "concat('d', CAST(o_custkey AS {text}))"


def seg(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS video_id",
        f"{SEG_NO} AS seg_no",
        "CAST(l_quantity AS DOUBLE) AS start_sec",
        "CAST(l_quantity + 4 + l_linenumber AS DOUBLE) AS end_sec",
        f"{KIND} AS kind",
        "CAST(l_suppkey % 2 AS BIGINT) AS side",
    )


def videos(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .selectExpr(
            "o_orderkey AS video_id",
            f"{DRAMA.format(text='STRING')} AS drama_id",
            "CAST(64.0 AS DOUBLE) AS duration_sec",
            f"{STATUS} AS status",
            f"{SOURCE} AS source",
            "CAST(o_orderdate AS DATE) AS created",
            "o_totalprice AS price",
        )
        .withColumn("split", group_split("drama_id"))
    )


def dialogues(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr(
        "conv_id AS video_id",
        "CAST(turn * 8 AS DOUBLE) AS start_sec",
        "CAST(turn * 8 + 6 AS DOUBLE) AS end_sec",
        "text",
        "CASE WHEN role = 'user' THEN 'asr' ELSE 'ocr' END AS source",
    )


def timeline(spark, sf) -> DataFrame:
    """All events with seconds since the epoch of the stream."""
    return table(spark, sf, "events").selectExpr(
        "user_id AS job",
        "event_id AS pos",
        "event_type AS kind",
        "value",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) / 1000000D AS t",
        "get_json_object(props, '$.k') AS k",
    )


SQL = {
    "seg": f"""seg AS (SELECT l_orderkey AS video_id, {SEG_NO} AS seg_no,
  CAST(l_quantity AS DOUBLE) AS start_sec, CAST(l_quantity + 4 + l_linenumber AS DOUBLE) AS end_sec,
  {KIND} AS kind, CAST(l_suppkey % 2 AS BIGINT) AS side FROM lineitem)""",
    "videos": f"""videos AS (SELECT o_orderkey AS video_id, {DRAMA.format(text='VARCHAR')} AS drama_id,
  CAST(64.0 AS DOUBLE) AS duration_sec, {STATUS} AS status, {SOURCE} AS source,
  CAST(o_orderdate AS DATE) AS created, o_totalprice AS price,
  CASE WHEN CAST(concat('0x', substr(sha256({DRAMA.format(text='VARCHAR')}), 1, 8)) AS BIGINT) % 10 < 8 THEN 'train'
       WHEN CAST(concat('0x', substr(sha256({DRAMA.format(text='VARCHAR')}), 1, 8)) AS BIGINT) % 10 = 8 THEN 'val'
       ELSE 'test' END AS split FROM orders)""",
    "dialogues": """dialogues AS (SELECT conv_id AS video_id, CAST(turn * 8 AS DOUBLE) AS start_sec,
  CAST(turn * 8 + 6 AS DOUBLE) AS end_sec, text,
  CASE WHEN role = 'user' THEN 'asr' ELSE 'ocr' END AS source FROM conversations)""",
    "timeline": """timeline AS (SELECT user_id AS job, event_id AS pos, event_type AS kind, value,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0::DOUBLE AS t,
  json_extract_string(props, '$.k') AS k FROM events)""",
}


def union_sql(name: str, source: str, keys: str, where: str = "TRUE") -> str:
    """CTEs merging overlapping or touching spans of ``source`` per key (plain window form)."""
    return f"""{name}_m AS (SELECT {keys}, start_sec, end_sec, max(end_sec) OVER (PARTITION BY {keys}
    ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM {source} WHERE {where}),
{name}_i AS (SELECT {keys}, start_sec, end_sec, sum(CASE WHEN reach IS NULL OR start_sec > reach THEN 1 ELSE 0 END)
    OVER (PARTITION BY {keys} ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS island FROM {name}_m),
{name} AS (SELECT {keys}, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM {name}_i GROUP BY {keys}, island)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(SQL.get(p, p) for p in parts) + "\n"
