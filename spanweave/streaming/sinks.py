"""Table sinks of update-mode streams: one partition per micro-batch, newest batch wins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

def start_upserts(values: DataFrame, target: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Write each batch of changed rows to its own partition of ``target``.

    A replayed batch overwrites its own partition, so a failure never leaves rows twice. Keyed
    state needs a session with the RocksDB provider (``build_session`` sets it)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = values.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def drain(values: DataFrame, target: str, checkpoint: str) -> None:
    """Process everything available now, then stop."""
    with keyed_state(values.sparkSession):
        start_upserts(values, target, checkpoint).awaitTermination()


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """A session whose streams keep keyed state in RocksDB, as ``transformWithState`` needs; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_in_parts(parts: Sequence[DataFrame], stream: Callable[[DataFrame], DataFrame], folder: str) -> str:
    """Feed a stream with files that come one part after the other; returns the folder of its batches.

    Each part is written as files into the watched folder and then drained by a new query from the same checkpoint, as after a restart."""
    spark = parts[0].sparkSession
    source = spark.readStream.schema(parts[0].schema).option("recursiveFileLookup", "true").parquet
    for i, part in enumerate(parts):
        part.write.mode("overwrite").parquet(f"{folder}/in/part={i}")
        drain(stream(source(f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint")
    return f"{folder}/out"


def read_batches(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(target)


def newest_groups(spark: SparkSession, target: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Rows of the newest batch of each key, for streams that emit whole groups."""
    rows = read_batches(spark, target, schema)
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    on = [rows[k].eqNullSafe(last[k]) for k in keys]
    return rows.join(last, [*on, rows["batch"] == last["batch"]], "left_semi").drop("batch")
