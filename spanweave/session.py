"""Session defaults.

Only settings that matter for results or for skew are fixed here; sizing (executors, memory,
shuffle partitions) belongs to the cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}
SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "spanweave", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RESULT_SETTINGS, **SCALE_SETTINGS}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The scratch folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spanweave-")
    return _LOCAL_FOLDERS[context.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several branches read to the shared folder and read it back.

    The table outlives lost executors, is scanned column by column and has a known size, so the
    planner can choose joins for it; its folder may be removed when the session has ended."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/spanweave/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
