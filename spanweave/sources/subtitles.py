"""Subtitle files (SRT, VTT) read in bulk into cue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The cue line of SRT ("00:00:01,000 --> ...") and VTT ("00:01.000 --> ...").
CUE = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"


def _seconds(line: Column, at: int) -> Column:
    def part(i):
        return F.coalesce(F.regexp_extract(line, CUE, at + i).try_cast("double"), F.lit(0.0))

    millis = F.rpad(F.regexp_extract(line, CUE, at + 3), 3, "0")
    total = part(0) * 3600000 + part(1) * 60000 + part(2) * 1000 + F.coalesce(millis.try_cast("double"), F.lit(0.0))
    return total / 1000


def cues(documents: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Cue rows (keys, cue_no, start_sec, end_sec, text) of whole subtitle texts.

    Blocks are split at blank lines; comment blocks have no time line and fall away, cues that end
    before they start are dropped, markup tags are removed."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "﻿", ""), r"\r\n?", "\n")
    blocks = documents.select(*keys, F.posexplode(F.split(clean, r"\n[ \t]*\n+")).alias("cue_no", "_block"))
    comment = F.startswith(F.ltrim("_block"), F.lit("NOTE"))
    timed = blocks.filter(F.regexp_like("_block", F.lit(CUE)) & ~comment)
    line = F.regexp_extract("_block", CUE, 0)
    # all lines after the time line; cue settings on the time line itself are dropped
    tail = F.element_at(F.split("_block", CUE + r"[^\n]*", 2), 2)
    body = F.trim(F.regexp_replace(F.regexp_replace(tail, r"<[^>]*>|\{\\[^}]*\}", ""), r"^\n+|\n+$", ""))
    return (
        timed.select(
            *keys, F.col("cue_no").cast("bigint").alias("cue_no"),
            _seconds(line, 1).alias("start_sec"), _seconds(line, 5).alias("end_sec"), body.alias("text"),
        )
        .filter(F.col("end_sec") > F.col("start_sec"))
    )


def read_subtitles(spark: SparkSession, paths) -> DataFrame:
    """Cues of many subtitle files; one row per file enters, files are small texts."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return cues(files, "value", ["file"])


def pair_files(videos: DataFrame, subtitles: DataFrame, batch: str = "batch") -> tuple[DataFrame, DataFrame]:
    """(pairs, problems) of video and subtitle names within a batch.

    Names pair by lower-case base name. A batch of one video and one subtitle pairs whatever the
    names are. Several subtitles for a name are ambiguous, subtitles without a video unmatched.

    No side is sent out whole: names that a caller generates are far more than the planner estimates."""
    base = F.lower(F.regexp_replace("name", r"\.[^.]+$", ""))
    v = videos.select(batch, F.col("name").alias("video"), base.alias("_base"))
    s = subtitles.select(batch, F.col("name").alias("subtitle"), base.alias("_base"))
    nv = v.groupBy(batch).agg(F.count(F.lit(1)).alias("_nv"), F.min("video").alias("_v1"))
    ns = s.groupBy(batch).agg(F.count(F.lit(1)).alias("_ns"), F.min("subtitle").alias("_s1"))
    single = nv.join(ns.hint("merge"), batch).filter((F.col("_nv") == 1) & (F.col("_ns") == 1))
    ones = single.select(batch, F.col("_v1").alias("video"), F.col("_s1").alias("subtitle"))
    many_v = v.join(single.select(batch).hint("merge"), batch, "left_anti")
    many_s = s.join(single.select(batch).hint("merge"), batch, "left_anti")
    per_base = many_s.groupBy(batch, "_base").agg(F.count(F.lit(1)).alias("_n"), F.min("subtitle").alias("subtitle"))
    matched = many_v.join(per_base.hint("merge"), [batch, "_base"], "left")
    pairs = matched.filter(F.col("_n").isNull() | (F.col("_n") == 1)).select(batch, "video", "subtitle")
    ambiguous = matched.filter(F.col("_n") > 1).select(batch, F.col("video").alias("name"), F.lit("ambiguous").alias("problem"))
    unmatched = many_s.join(many_v.select(batch, "_base").distinct().hint("merge"), [batch, "_base"], "left_anti").select(
        batch, F.col("subtitle").alias("name"), F.lit("unmatched").alias("problem")
    )
    return ones.unionByName(pairs), ambiguous.unionByName(unmatched)
