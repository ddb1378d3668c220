"""Tables that are written to: idempotent appends, upserts of touched partitions, all-or-nothing registration."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import group_split
from ..operators.store import register, upsert_predictions
from ..session import materialize
from .snapshot import _fs


def append_batch(rows: DataFrame, table: str, batch: str) -> None:
    """Append rows under the name of their batch. A batch owns one partition, so writing it again replaces it and adds nothing."""
    rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")


def read_log(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """All batches of a log, with the name of the batch."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(table)


def part_of(keys: Sequence[str], parts: int):
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


PREDICTION_KEYS = ("video_id", "model_id")


def write_predictions(predictions: DataFrame, table: str, parts: int = 64) -> None:
    """A new prediction table: one row per (video_id, model_id), dealt into partitions by the hash of the key."""
    keyed = predictions.withColumn("part", part_of(PREDICTION_KEYS, parts))
    keyed.repartition("part").write.mode("errorifexists").partitionBy("part").parquet(table)


def merge_predictions(incoming: DataFrame, table: str, parts: int = 64) -> DataFrame:
    """Upsert ``incoming`` (video_id, model_id, payload) into the table; returns the outcome of each key it has.

    Only partitions that hold an incoming key are read, and only those with a new or changed payload are written again, by dynamic
    partition overwrite: an unfinished write leaves the table as it was. Running the same upsert again writes nothing.
    ``parts`` is that of the table."""
    spark = incoming.sparkSession
    fresh = materialize(incoming.withColumn("part", part_of(PREDICTION_KEYS, parts)), "incoming")
    touched = [r["part"] for r in fresh.select("part").distinct().collect()]  # at most ``parts`` numbers
    schema = T.StructType([*incoming.schema.fields, T.StructField("part", T.IntegerType())])
    old = spark.read.schema(schema).parquet(table).filter(F.col("part").isin(touched))
    merged = materialize(upsert_predictions(old.drop("part"), fresh.drop("part")).withColumn("part", part_of(PREDICTION_KEYS, parts)), "merged")
    changed = [r["part"] for r in merged.filter("outcome IN ('inserted', 'updated')").select("part").distinct().collect()]
    if changed:
        again = merged.filter(F.col("part").isin(changed)).select(*incoming.columns, "part")
        again.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table)
    return merged.filter("outcome <> 'kept'").select(*PREDICTION_KEYS, "outcome")


VIDEOS = T.StructType([T.StructField("video_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("drama_id", "sha256", "split")]])


def read_videos(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(VIDEOS).option("recursiveFileLookup", "true").parquet(table)


def register_videos(incoming: DataFrame, table: str) -> DataFrame:
    """Register ``incoming`` (pos, video_id, drama_id, sha256) in the table of videos; returns the outcome of each row.

    If any row conflicts, nothing is written. Otherwise the added rows, with their split, are written aside and published by one
    rename, so that readers see all of them or none."""
    spark = incoming.sparkSession
    outcomes = materialize(register(read_videos(spark, table), incoming), "registered")
    if outcomes.filter("outcome = 'conflict'").isEmpty():
        name = uuid.uuid4().hex
        added = outcomes.filter("outcome = 'added'").withColumn("split", group_split("drama_id")).select(*VIDEOS.names)
        stage = f"{table.rstrip('/')}.staging/{name}"
        added.dropDuplicates(["video_id"]).write.mode("errorifexists").parquet(stage)
        fs, final, make = _fs(spark, f"{table.rstrip('/')}/added-{name}")
        if not fs.rename(make(stage), final):
            raise FileExistsError(f"{final} could not be published")
    return outcomes
