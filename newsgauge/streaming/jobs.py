"""Incremental jobs: Structured Streaming twins of the batch operators.

Functions on a stream return a stream; ``run_*`` functions start a query, take all that is available and return the
table they wrote. Every write to a folder is keyed by batch id, so that a batch that runs again after a failure
replaces itself.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from newsgauge.functions.stats import exact_mean
from newsgauge.functions.text import instant_to_ntz, ntz_to_instant
from newsgauge.operators import reconcile, telemetry
from newsgauge.operators.scoring import lexicon_score
from newsgauge.session import scratch_path

LATE = "1 hour"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                max_files: int | None = None, fmt: str = "parquet") -> DataFrame:
    """New files of a folder as a stream; the schema is given, not inferred."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def timed(stream: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    """The stream with ``ts`` as an instant and a watermark ``late`` behind the newest one."""
    return stream.withColumn(ts, ntz_to_instant(F.col(ts))).withWatermark(ts, late)


def dedup_ingest(stream: DataFrame, key: list[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """First row of each natural key; keys are remembered until the watermark passes them."""
    once = timed(stream, late, ts).dropDuplicatesWithinWatermark([*key])
    return once.withColumn(ts, instant_to_ntz(F.col(ts)))


def slow_alerts(op_log: DataFrame, threshold_ms: float, width: str = "30 minutes", slide: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Every ``slide``, query types whose mean duration over the last ``width`` is above the threshold."""
    return duration_windows(op_log, width, slide, late).where(F.col("avg_duration") > threshold_ms)


def duration_windows(op_log: DataFrame, width: str = "30 minutes", slide: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Mean duration and count per query type and window."""
    means = telemetry.in_bins(timed(op_log, late), ["query_type"], width, slide).agg(
        exact_mean("duration_ms").alias("avg_duration"), F.count("*").alias("n"))
    return _bin(means)


def error_alerts(op_log: DataFrame, threshold: int, width: str = "30 minutes", slide: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Every ``slide``, windows of the last ``width`` with more than ``threshold`` severe errors."""
    return error_windows(op_log, width, slide, late).where(F.col("error_count") > threshold)


def error_windows(op_log: DataFrame, width: str = "30 minutes", slide: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Severe errors per window."""
    bad = timed(op_log.where(F.col("severity") >= 3), late)
    return _bin(telemetry.in_bins(bad, [], width, slide).agg(F.count("*").alias("error_count")))


def rate_windows(requests: DataFrame, limit: int, period: str, late: str = LATE) -> DataFrame:
    """Requests per (client, endpoint) and period: limited or not, remaining, and when the count resets.

    Counts are combined before the shuffle, so a busy client is one row per task and period, not all its requests.
    """
    w = telemetry.in_bins(timed(requests, late), ["client", "endpoint"], period)
    counted = w.agg(F.count("*").alias("request_count"))
    return (counted.withColumns({"bin": instant_to_ntz(F.col("_w.start")), "reset": instant_to_ntz(F.col("_w.end")), "limited": F.col("request_count") >= limit,
                                 "remaining": F.greatest(F.lit(0), limit - F.col("request_count"))}).drop("_w"))


def _bin(df: DataFrame) -> DataFrame:
    return df.withColumns({"bin": instant_to_ntz(F.col("_w.start")), "bin_end": instant_to_ntz(F.col("_w.end"))}).drop("_w")


def score_stream(stream: DataFrame, text: str, *words: list[str]) -> DataFrame:
    """Label, score and confidence of every text of a stream; ``words``: the positive and the negative ones."""
    return lexicon_score(stream, text, *words)


_PROGRESS = ("run_id STRING, batch_id BIGINT, input_rows BIGINT, dropped_by_watermark BIGINT, watermark STRING, "
             "state_rows BIGINT, observed MAP<STRING, STRING>")


def finish(query, progress: str | None = None) -> None:
    """Waits for a query to take all that is available. With ``progress``, a folder, one row per micro-batch is kept there
    (:func:`progress_rows`): rows read, rows that came behind the watermark and were dropped, and what ``observe`` counted."""
    if progress is None:
        query.awaitTermination()
        return
    seen: dict[int, tuple] = {}

    def take() -> None:
        for p in query.recentProgress:
            ops = p.stateOperators
            observed = {f"{name}.{k}": str(v) for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
            seen[p.batchId] = (str(p.runId), p.batchId, p.numInputRows, sum(o.numRowsDroppedByWatermark for o in ops),
                               (p.eventTime or {}).get("watermark"), sum(o.numRowsTotal for o in ops), observed)

    while not query.awaitTermination(1):  # Spark keeps the last hundred batches only
        take()
    take()
    if seen:
        SparkSession.getActiveSession().createDataFrame(list(seen.values()), _PROGRESS).coalesce(1).write.mode("append").parquet(progress)


def progress_rows(spark: SparkSession, progress: str) -> DataFrame:
    """One row for each micro-batch that :func:`finish` kept in a folder, over all runs."""
    return spark.read.schema(_PROGRESS).parquet(progress)


def run_append(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None, progress: str | None = None) -> DataFrame:
    """Appends all available rows to a Parquet folder, exactly once, and returns the folder's table."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    checkpoint = checkpoint or scratch_path(spark, f"{label}-checkpoint")
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finish(query, progress)
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, label: str, key: list[str], path: str | None = None, checkpoint: str | None = None,
                progress: str | None = None) -> DataFrame:
    """The newest state of every ``key`` of an aggregated stream, windows that are still open included.

    Every batch writes the rows it changed to a folder of its own; the newest row per key counts. Conditions on an
    aggregate belong on the result, since a later batch may undo them.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    checkpoint = checkpoint or scratch_path(spark, f"{label}-checkpoint")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(os.path.join(path, "batch=-1"))  # a run without data
    query = (stream.writeStream.outputMode("update").foreachBatch(batch_writer(path))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finish(query, progress)
    rest = F.struct(*[c for c in stream.columns if c not in key])
    written = spark.read.schema(f"{_ddl(stream)}, `batch` BIGINT").parquet(path)
    return written.groupBy(*key).agg(F.max_by(rest, "batch").alias("_newest")).select(*key, "_newest.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def run_batches(stream: DataFrame, label: str, body: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Calls ``body(rows, batch_id)`` for every micro-batch of what is available."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, f"{label}-checkpoint")
    query = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch to its own ``batch=`` folder; a repeated batch overwrites itself."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))
    return write


def run_copy(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Incremental copy: the checkpoint holds the position, each batch has its folder."""
    path = path or scratch_path(stream.sparkSession, label)
    run_batches(stream, label, batch_writer(path), checkpoint)
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def run_dual_write(stream: DataFrame, label: str, secondary: Callable[[DataFrame, int], None] | None = None,
                   on_failure: Callable[[int, Exception], None] | None = None, paths: tuple[str, str] | None = None,
                   checkpoint: str | None = None) -> tuple[str, str]:
    """Every batch to two folders. The primary must succeed; a failure of the secondary goes to ``on_failure``, without it
    to the table of :func:`dual_write_failures`, and is left for reconciliation. Returns both paths. With ``paths`` and
    ``checkpoint`` of an earlier run it goes on where that one ended."""
    spark = stream.sparkSession
    first, second = paths or (scratch_path(spark, f"{label}-primary"), scratch_path(spark, f"{label}-secondary"))
    primary, secondary = batch_writer(first), secondary or batch_writer(second)
    failures = batch_writer(f"{first}-failures")
    failures(spark.createDataFrame([], _FAILURE), -1)

    def record(batch_id: int, error: Exception) -> None:
        failures(spark.createDataFrame([(batch_id, f"{type(error).__name__}: {error}")], _FAILURE), batch_id)

    def both(rows: DataFrame, batch_id: int) -> None:
        primary(rows, batch_id)
        try:
            secondary(spark.read.parquet(os.path.join(first, f"batch={batch_id}")), batch_id)
        except Exception as error:
            (on_failure or record)(batch_id, error)

    run_batches(stream, label, both, checkpoint)
    return first, second


_FAILURE = "batch_id BIGINT, error STRING"


def dual_write_failures(spark: SparkSession, first: str) -> DataFrame:
    """(batch_id, error) of the batches that the secondary of :func:`run_dual_write` did not take, by the primary's path."""
    return spark.read.schema(_FAILURE).option("recursiveFileLookup", "true").parquet(f"{first}-failures")


def dual_write_parity(stream: DataFrame, label: str, issues: Column, key: str = "id") -> DataFrame:
    """Writes to two folders and reconciles them."""
    spark = stream.sparkSession
    first, second = run_dual_write(stream, label)

    def back(path: str) -> DataFrame:
        return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)

    return reconcile.summary(back(first), back(second), issues, key)


def run_split(stream: DataFrame, label: str, routes: dict[str, Column]) -> dict[str, str]:
    """One pass that sends each row to the folder of the first route whose condition holds; ``dead`` takes the rest."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    route = F.lit("dead")
    for name, condition in reversed(routes.items()):
        route = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(route)

    def write(rows: DataFrame, batch_id: int) -> None:
        routed = rows.withColumn("route", route)
        routed.write.mode("overwrite").partitionBy("route").parquet(os.path.join(base, f"batch={batch_id}"))

    run_batches(stream, label, write)
    return {"path": base}


def newest_number(spark: SparkSession, path: str, prefix: str) -> int | None:
    """The number of the newest finished table ``<prefix>-<number>`` in ``path``, None if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [n for n in names if n.startswith(f"{prefix}-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max((int(n.removeprefix(f"{prefix}-")) for n in done), default=None)


class LatestByTicker:
    """Newest ``n`` records per ticker within ``hours`` of the newest time seen, kept as a small state table.

    A micro-batch is cut to its newest ``n`` rows per ticker before it meets the state, so a ticker that fills the
    batch costs no more than another. State of batch b is written beside that of b - 1: a repeated batch starts
    from the same place.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, n: int = 1, hours: int = 24, path: str | None = None):
        self.spark, self.schema, self.n, self.hours = spark, schema, n, hours
        self.path = path or scratch_path(spark, "latest")
        self.last: int | None = None

    def _newest(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("ticker").orderBy(F.col("ts").desc(), F.col("id").desc())
        return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= self.n).drop("_rn")

    def _state(self, batch_id: int) -> str:
        return os.path.join(self.path, f"state-{batch_id}")

    def update(self, rows: DataFrame, batch_id: int) -> None:
        merged = self._newest(rows.select(*self.schema.fieldNames()))
        if batch_id > 0:
            merged = self._newest(merged.unionByName(self.spark.read.schema(self.schema).parquet(self._state(batch_id - 1))))
        cutoff = merged.agg(F.max("ts") - F.expr(f"interval {int(self.hours)} hours")).scalar()
        merged.where(F.col("ts") >= cutoff).write.mode("overwrite").parquet(self._state(batch_id))
        self.last = batch_id

    def current(self) -> DataFrame:
        """The newest finished state, also one that an earlier run left in ``path``."""
        self.last = newest_number(self.spark, self.path, "state") if self.last is None else self.last
        if self.last is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._state(self.last))


class RetryQueue:
    """Delivery retry queue as a state table: each batch of delivery results takes the queue one step on."""

    SCHEMA = T.StructType([T.StructField("delivery_id", T.LongType()), T.StructField("subscriber_id", T.LongType()),
                           T.StructField("attempts", T.IntegerType())])

    def __init__(self, spark: SparkSession, subscribers: DataFrame, max_attempts: int = 3, path: str | None = None):
        self.spark, self.subscribers, self.max_attempts = spark, subscribers, max_attempts
        self.path = path or scratch_path(spark, "retry")
        self.last: int | None = None

    def _state(self, batch_id: int) -> str:
        return os.path.join(self.path, f"queue-{batch_id}")

    def start(self, queue: DataFrame) -> None:
        queue.select(*self.SCHEMA.fieldNames()).write.mode("overwrite").parquet(self._state(-1))
        self.last = -1

    def update(self, results: DataFrame, batch_id: int) -> None:
        """``results`` (delivery_id, status code and, where a delivery may have several, ``ts``) decide by their newest row;
        a delivery without one waits unchanged."""
        results = telemetry.newest_results(results)
        queue = self.spark.read.schema(self.SCHEMA).parquet(self._state(batch_id - 1))
        step = telemetry.retry_step(queue, self.subscribers, results, self.max_attempts)
        again = step.where("requeued").select("delivery_id", "subscriber_id", (F.col("attempts") + 1).alias("attempts"))
        waiting = queue.join(results.select("delivery_id"), "delivery_id", "left_anti")
        again.unionByName(waiting).select(*self.SCHEMA.fieldNames()).write.mode("overwrite").parquet(self._state(batch_id))
        self.last = batch_id

    def current(self) -> DataFrame:
        """The newest finished queue, also one that an earlier run left in ``path``; empty before :meth:`start`."""
        self.last = newest_number(self.spark, self.path, "queue") if self.last is None else self.last
        if self.last is None:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self._state(self.last))
