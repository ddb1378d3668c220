"""Manifests of videos as JSON lines with a declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.intervals import is_finite
from ..functions.labels import group_split

# The manifest's keys used here.
MANIFEST_FIELDS = (
    "video_id STRING, drama_id STRING, path STRING, sha256 STRING, duration_sec DOUBLE, fps DOUBLE,"
    " width INT, height INT, language STRING, split STRING, title STRING, has_audio BOOLEAN,"
    " annotation_status STRING, highlights ARRAY<STRUCT<start_sec: DOUBLE, end_sec: DOUBLE>>"
)


def read_manifest(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Manifest rows with their file; unknown keys are ignored, absent ones are null."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (
        spark.read.schema(MANIFEST_FIELDS + ", _corrupt STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(paths)
        .select("*", F.col("_metadata.file_path").alias("manifest_file"))
    )


def check_manifest(rows: DataFrame) -> DataFrame:
    """Rows with ``reject_reason``: unreadable, blank_id, invalid_duration, or null."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in rows.columns else F.lit(False)
    reason = (
        F.when(corrupt, "unreadable")
        .when(blank("video_id") | blank("drama_id"), "blank_id")
        .when(~is_finite("duration_sec") | (F.col("duration_sec") <= 0), "invalid_duration")
    )
    return rows.withColumn("reject_reason", reason)


def split_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted videos with their group split, rejected rows)."""
    checked = check_manifest(rows)
    good = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason", "_corrupt")
    return good.withColumn("split", group_split("drama_id")), checked.filter(F.col("reject_reason").isNotNull())


def checked_dialogue(dialogues: DataFrame, videos: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable dialogue rows, violations). A record must carry its video's hash and start at 0, and
    no row may leave the video.

    ``records``: video_id, source_sha256, source_start. ``videos``: video_id, sha256, duration_sec."""
    heads = records.join(videos.select("video_id", "sha256", "duration_sec"), "video_id", "left")
    reason = F.when(~F.col("source_sha256").eqNullSafe(F.col("sha256")), "other_content").when(
        F.coalesce(F.col("source_start"), F.lit(-1.0)) != 0, "not_at_zero"
    )
    heads = heads.withColumn("reason", reason)
    bad_heads = heads.filter(F.col("reason").isNotNull()).select("video_id", "reason")
    rows = dialogues.join(heads.filter(F.col("reason").isNull()).select("video_id", "duration_sec"), "video_id")
    outside = (F.col("start_sec") < 0) | (F.col("end_sec") > F.col("duration_sec") + 1e-6)
    bad_rows = rows.filter(outside).select("video_id", F.lit("out_of_range").alias("reason")).distinct()
    return rows.filter(~outside).drop("duration_sec"), bad_heads.unionByName(bad_rows)


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
