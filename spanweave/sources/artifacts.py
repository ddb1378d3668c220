"""Run artifacts (result, state, execution, trace) of many jobs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIGHLIGHTS = (
    "ARRAY<STRUCT<highlight_id: STRING, start_sec: DOUBLE, end_sec: DOUBLE, score: DOUBLE, highlight_type: STRING,"
    " description: STRING, reason: STRING, clip_url: STRING, review_status: STRING>>"
)
ANALYSIS = (
    "STRUCT<scan_coverage: DOUBLE, pending_event_count: BIGINT, pending_observation_count: BIGINT,"
    " pending_proposal_count: BIGINT, pending_review_count: BIGINT, stop_reason: STRING, model_calls: BIGINT>"
)
VIDEO = "STRUCT<video_id: STRING, title: STRING, duration_sec: DOUBLE>"
RESULT = (
    f"schema_version STRING, job_id STRING, video {VIDEO}, completion STRING, message STRING,"
    f" analysis {ANALYSIS}, highlights {HIGHLIGHTS}"
)
SPANS = "ARRAY<STRUCT<role: STRING, start_sec: DOUBLE, end_sec: DOUBLE>>"
STATE = (
    f"tools STRUCT<events: ARRAY<STRUCT<id: STRING, status: STRING, required_spans: {SPANS}>>,"
    " plans: ARRAY<STRUCT<id: STRING, event_id: STRING, status: STRING, start_sec: DOUBLE, end_sec: DOUBLE>>>"
)
EXECUTION = "attempts ARRAY<STRUCT<started_at: STRING, status: STRING, elapsed_sec: DOUBLE, stop_reason: STRING>>"
TRACE = "timestamp DOUBLE, kind STRING, turn BIGINT, elapsed_sec DOUBLE, error BOOLEAN, calls ARRAY<STRING>"


def _job_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _read(spark: SparkSession, root: str, name: str, schema: str, lines: bool) -> DataFrame:
    """All jobs' files of one name; an empty table when no job has one."""
    reader = spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", name).json(f"{root}/jobs").withColumn("job", _job_of(F.col("_metadata.file_path")))


def read_run(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of a run folder ``root/jobs/<job>/{result,state,execution}.json, trace.jsonl``."""
    return _tables(
        _read(spark, root, "result.json", RESULT, False),
        _read(spark, root, "state.json", STATE, False),
        _read(spark, root, "execution.json", EXECUTION, False),
        _read(spark, root, "trace.jsonl", TRACE, True),
    )


def read_run_bundles(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The same tables from ``root/{result,state,execution,trace}/``: JSON lines of many jobs, each
    with its ``job``. Large runs are kept this way, since a file per job burdens the file system."""
    def bundle(name, schema):
        return spark.read.schema(f"job STRING, {schema}").json(f"{root}/{name}")

    return _tables(bundle("result", RESULT), bundle("state", STATE), bundle("execution", EXECUTION), bundle("trace", TRACE))


def _tables(result: DataFrame, state: DataFrame, execution: DataFrame, trace: DataFrame) -> dict[str, DataFrame]:
    attempts = execution.select("job", F.posexplode("attempts").alias("attempt_no", "a")).select(
        "job", F.col("attempt_no").cast("bigint").alias("attempt_no"), "a.*"
    )
    return {
        "results": upgrade_results(result),
        "events": state.select("job", F.explode("tools.events").alias("e")).select("job", "e.*"),
        "plans": state.select("job", F.explode("tools.plans").alias("p")).select("job", "p.*"),
        "attempts": attempts,
        "trace": trace.withColumn("calls_empty", F.coalesce(F.size("calls") == 0, F.lit(False))),
    }


def items_with_artifacts(items: DataFrame, run: dict[str, DataFrame]) -> DataFrame:
    """Evaluation items with what their job left behind; a missing file is an empty default."""
    tried = run["attempts"].groupBy("job").agg(F.count(F.lit(1)).alias("attempts"))
    events = run["events"].groupBy("job").agg(F.count(F.lit(1)).alias("events"))
    traced = run["trace"].groupBy("job").agg(F.count(F.lit(1)).alias("trace_rows"))
    out = items.join(run["results"].select("job", "completion"), "job", "left")
    for part in (tried, events, traced):
        out = out.join(part, "job", "left")
    return out.na.fill(0, ["attempts", "events", "trace_rows"])


# What a result of schema 1.0 is read as.
LEGACY_VERSION = "1.0"
CURRENT_VERSION = "2.0"
LEGACY_MESSAGE = "历史分析结果（schema 1.0）"
LEGACY_STOP_REASON = "legacy_schema_1.0"


def upgrade_results(results: DataFrame) -> DataFrame:
    """Results of schema 1.0 get the current shape with literal defaults; others pass unchanged."""
    legacy = F.col("schema_version") == LEGACY_VERSION
    zero = F.lit(0).cast("bigint")
    analysis = F.struct(
        F.lit(1.0).alias("scan_coverage"), zero.alias("pending_event_count"), zero.alias("pending_observation_count"),
        zero.alias("pending_proposal_count"), zero.alias("pending_review_count"),
        F.lit(LEGACY_STOP_REASON).alias("stop_reason"), zero.alias("model_calls"),
    )
    return results.withColumns(
        {
            "schema_version": F.when(legacy, F.lit(CURRENT_VERSION)).otherwise(F.col("schema_version")),
            "completion": F.when(legacy, F.lit("complete")).otherwise(F.col("completion")),
            "message": F.when(legacy, F.lit(LEGACY_MESSAGE)).otherwise(F.col("message")),
            "analysis": F.when(legacy, analysis).otherwise(F.col("analysis")),
        }
    )
