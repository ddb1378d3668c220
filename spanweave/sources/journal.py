"""Append-only JSON-lines journals whose last line may be unfinished."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def journal_records(raw: DataFrame, keys: list[str], text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, errors) of whole journal texts: line_no and record (VARIANT) per complete line.

    A line counts as complete only when a newline ends it, so only the unterminated rest of a file
    is ignored; every other unreadable line is an error."""
    closed = F.regexp_extract(F.col(text), r"(?s)^(.*)\n", 1)
    lines = (
        raw.filter(F.contains(F.col(text), F.lit("\n")))
        .select(*keys, F.posexplode(F.split(closed, "\n")).alias("line_no", "line"))
        .withColumn("line_no", F.col("line_no").cast("bigint"))
    )
    parsed = lines.withColumn("record", F.try_parse_json("line"))
    good = parsed.filter(F.col("record").isNotNull()).drop("line")
    return good, parsed.filter(F.col("record").isNull()).drop("record")


def read_journal(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Journals of moderate size, one file per task: (records, errors) with their file."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return journal_records(raw, ["file"])


def read_large_journal(spark: SparkSession, paths, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of journals too large for one task, with their file (and partition columns that ``schema`` names); lines are read split by split.

    The reader drops newlines, but the bytes of the lines tell whether the last one had one: with a newline for each line they are one more than the
    file has, if the last line was not terminated. Exactly that line is ignored, whatever it holds."""
    reader = spark.read.option("lineSep", "\n")
    lines = (reader.schema(schema) if schema else reader).text(paths)
    others = [c for c in lines.columns if c != "value"]
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line_no"), "value", *others,
    )
    files = lines.groupBy("file").agg(
        F.max(F.struct("block_start", "line_no")).alias("_last"),
        (F.sum(F.octet_length("value").cast("bigint") + 1) - F.max("_size")).alias("_over"),
    )
    # a byte order mark is three bytes of the file, but of no line
    cut = F.col("_over").isin(1, -2) & (F.struct("block_start", "line_no") == F.col("_last"))
    closed = lines.join(files, "file").filter(~cut).withColumn("record", F.try_parse_json("value"))
    good = closed.filter(F.col("record").isNotNull()).select("file", "block_start", "line_no", "record", *others)
    bad = closed.filter(F.col("record").isNull() & (F.trim("value") != "")).select("file", "value", *others)
    return good, bad
