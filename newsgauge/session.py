"""Session factory, and the shared folder that holds what is cut out of a long plan."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed streaming state lives on disk, not in the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Recording the Python call site of every Column costs more than planning does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
_STAGES: set[str] = set()


def get_spark(app: str = "newsgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in _CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``. Where that is unset, on one machine a folder in the
    warehouse, on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under :func:`shared_dir`."""
    return os.path.join(shared_dir(spark), f"newsgauge-{label}-{uuid.uuid4().hex}")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage of iterative work.

    What is used several times is computed once, a lost executor does not set the work back, and the file sizes
    tell the optimizer whether the table is small enough to broadcast. Stages go with :func:`drop_staged` once
    their last reader has run, the others with :func:`release` or when the process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    _STAGES.add(path)
    if len(_STAGES) == 1:
        atexit.register(_at_exit)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def drop_staged(*frames: DataFrame) -> None:
    """Deletes the files behind frames returned by :func:`staged`; their readers must have run."""
    for df in frames:
        _delete(df.sparkSession, df._staged_path)


def release(spark: SparkSession) -> None:
    """Deletes every stage made so far in this process; call it when the results built on them are written."""
    for path in list(_STAGES):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    _STAGES.discard(path)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _STAGES and spark is not None and spark.sparkContext._jsc is not None:
        release(spark)
