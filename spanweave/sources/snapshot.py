"""Immutable published tables with a manifest of counts and content fingerprints."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, hash_xor, hash_sum): order-free content identity, combined on the map side.

    The sum tells apart what the xor cannot (pairs of equal rows)."""
    row = F.xxhash64(*[F.to_json(F.struct(c)) if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in sorted(df.columns)])
    return df.select(row.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(F.pmod(F.col("h"), F.lit(1_000_000_007))), F.lit(0)).alias("hash_sum"),
    )


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm.org.apache.hadoop.fs.Path


def publish(tables: dict[str, DataFrame], target: str, partition_by: dict[str, list[str]] | None = None) -> DataFrame:
    """Write tables and their manifest beside the target, then rename: all or nothing.

    Fails when the target exists. The fingerprints are taken from what was written, so they
    describe the files and not a second evaluation of the plan."""
    spark = next(iter(tables.values())).sparkSession
    fs, final, make = _fs(spark, target)
    if fs.exists(final):
        raise FileExistsError(f"{target} exists; publish under a new name")
    stage = f"{target.rstrip('/')}.staging-{datetime.now(UTC):%Y%m%dT%H%M%S%f}"
    manifest = None
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        keys = (partition_by or {}).get(name)
        if keys:
            writer = writer.partitionBy(*keys)
        writer.parquet(f"{stage}/{name}")
        row = fingerprint(spark.read.parquet(f"{stage}/{name}")).withColumn("table", F.lit(name))
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("errorifexists").parquet(f"{stage}/_manifest")
    if not fs.rename(make(stage), final):
        raise FileExistsError(f"{target} could not be published")
    return spark.read.parquet(f"{target}/_manifest")


def read_published(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A published table, after its content was checked against the manifest."""
    df = spark.read.parquet(f"{target}/{name}")
    want = spark.read.parquet(f"{target}/_manifest").filter(F.col("table") == name).drop("table")
    if fingerprint(df).exceptAll(want).take(1) or not want.take(1):
        raise ValueError(f"content of {name} does not match its manifest")
    return df
