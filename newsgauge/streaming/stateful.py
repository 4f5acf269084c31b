"""Streams with state per key: sliding request counts, and daily moments for anomalies."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsgauge.functions.text import instant_to_ntz
from newsgauge.operators.summaries import anomaly_flags
from newsgauge.session import scratch_path
from newsgauge.streaming.jobs import LATE, newest_number, timed

_MICROS = 1_000_000


#: State keys that clients and endpoints are dealt into.
BUCKETS = 128


class SlidingCounter(StatefulProcessor):
    """Requests of a (client, endpoint) in the period up to each of them, for the pairs of one bucket.

    Every call to the state costs far more than a row, so pairs share buckets, and a bucket's time is cut into slices. The state
    of a slice are the distinct request times of its pairs with their numbers, and, until the watermark passes it, the ids of its
    requests, as Arrow tables; a batch loads only the slices that its rows and their periods touch, so a busy
    client does not load all it has. A slice goes by its timer, one period after its end, with or without new data.
    """

    PAIR = ["client", "endpoint"]

    def __init__(self, period: int, slices: int):
        self.period, self.width = period, max(1, period // slices)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slices = handle.getMapState("slices", "slice bigint", "times binary, open binary")

    def _timer(self, s: int) -> int:
        return ((s + 1) * self.width + self.period) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[["client", "endpoint", "at", "op_id"]]
        new = new.assign(at=new["at"].to_numpy(np.int64), op_id=new["op_id"].to_numpy(np.int64))
        near = -(-self.period // self.width) + 1
        touched = (new["at"] // self.width).unique().tolist()
        known = {k[0] for k in self.slices.keys()}
        held = [self.slices.getValue((s,)) for s in sorted(known & {s + d for s in touched for d in range(-near, near + 1)})]
        times = pd.concat([_unpacked([x[0] for x in held], _TIMES), new[[*self.PAIR, "at"]].assign(n=1)])
        times = times.groupby([*self.PAIR, "at"], dropna=False, as_index=False, sort=False)["n"].sum().sort_values("at")
        opened = pd.concat([_unpacked([x[1] for x in held], _OPEN), new]).sort_values("at")
        # Behind the watermark nothing comes that could change a count.
        kept = opened[opened["at"] >= timerValues.getCurrentWatermarkInMs() * 1000]
        for s, *state in zip(touched, self._slices(times, _TIMES, touched), self._slices(kept, _OPEN, touched), strict=True):
            self.slices.updateValue((s,), tuple(state))
            if s not in known:
                self.handle.registerTimer(self._timer(s))
        yield self._counted(times, opened, new)

    def _slices(self, rows: pd.DataFrame, schema: pa.Schema, slices: list[int]) -> Iterator[bytes]:
        """Rows in order of time, packed for each of some slices."""
        table, at = pa.Table.from_pandas(rows, schema, preserve_index=False), rows["at"].to_numpy(np.int64)
        for s in slices:
            first, end = np.searchsorted(at, [s * self.width, (s + 1) * self.width])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, schema) as writer:
                writer.write_table(table.slice(first, end - first))
            yield out.getvalue().to_pybytes()

    def _counted(self, times: pd.DataFrame, opened: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        """Counts of the open requests with a new one of their pair in their period."""
        pair = pd.concat([x[self.PAIR] for x in (times, opened, new)]).groupby(self.PAIR, dropna=False, sort=False).ngroup().to_numpy()
        pair = np.split(pair, [len(times), len(times) + len(opened)])
        at, upto = opened["at"].to_numpy(np.int64), np.unique(np.concatenate([times["at"].to_numpy(np.int64), new["at"].to_numpy(np.int64)]))

        def within(of: np.ndarray, when: np.ndarray, n: np.ndarray) -> np.ndarray:
            # A pair and the rank of a time in one number, since both in full need not fit.
            place = of * (len(upto) + 1) + np.searchsorted(upto, when)
            order = np.argsort(place, kind="stable")
            place, total = place[order], np.concatenate([[0], np.cumsum(n[order])])
            ends = [total[np.searchsorted(place, pair[1] * (len(upto) + 1) + np.searchsorted(upto, x, "right"))] for x in (at, at - self.period)]
            return ends[0] - ends[1]

        counts = within(pair[0], times["at"].to_numpy(np.int64), times["n"].to_numpy(np.int64))
        changed = within(pair[2], new["at"].to_numpy(np.int64), np.ones(len(new), np.int64)) > 0
        changed |= at - self.period > at  # without a time, which is the lowest number: only in the batch that brings it
        return opened[["op_id", *self.PAIR, "at"]].assign(request_count=counts)[changed]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        s = ((end - 1) * 1000 - self.period) // self.width - 1
        while self._timer(s) <= end:
            if self._timer(s) == end and self.slices.containsKey((s,)):
                self.slices.removeKey((s,))
            s += 1
        return iter([])

    def close(self) -> None:
        pass


_PAIR = [("client", pa.string()), ("endpoint", pa.string()), ("at", pa.int64())]
_TIMES, _OPEN = pa.schema([*_PAIR, ("n", pa.int64())]), pa.schema([*_PAIR, ("op_id", pa.int64())])


def _unpacked(parts: list[bytes], schema: pa.Schema) -> pd.DataFrame:
    return pa.concat_tables([schema.empty_table(), *[pa.ipc.open_stream(bytes(x)).read_all() for x in parts]]).to_pandas()


def use_disk_state(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB store; a session that has another gets it for the queries started from now on."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def sliding_counts(requests: DataFrame, period_seconds: int, late: str = LATE, slices: int = 16) -> DataFrame:
    """(op_id, client, endpoint, ts, request_count) for each request of a stream (op_id, client, endpoint, ts): the requests
    of its client and endpoint in the period up to it, itself included.

    A row comes with the batch that brings it, and again when a late request changes its count, so the newest row of an
    ``op_id`` counts (:func:`jobs.run_updates`). Requests behind the watermark are not counted; :func:`jobs.progress_rows`
    tells how many. A checkpoint goes with this number of buckets.
    """
    use_disk_state(requests.sparkSession)
    rows = timed(requests.select("op_id", "client", "endpoint", "ts"), late).withColumns(
        {"at": F.unix_micros("ts"), "bucket": F.pmod(F.xxhash64("client", "endpoint"), F.lit(BUCKETS))})
    counted = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=SlidingCounter(int(period_seconds) * _MICROS, slices),
        outputStructType="op_id bigint, client string, endpoint string, at bigint, request_count bigint",
        outputMode="Update", timeMode="EventTime")
    return counted.select("op_id", "client", "endpoint", instant_to_ntz(F.timestamp_micros("at")).alias("ts"), "request_count")


class DailyMoments:
    """Number, mean and squared deviations of a score per ticker and day, as a table of partial rows that merge.

    A micro-batch adds one row per ticker and day to a folder of its own, whatever the number of its records, so any split of
    the records into batches gives the same table. :meth:`compact` puts what the batches so far add up to into one folder;
    a batch that runs again replaces its own, and one that is compacted is not read twice.
    """

    SCHEMA = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("day", T.DateType()), T.StructField("n", T.LongType()),
                           T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType())])

    def __init__(self, spark: SparkSession, score: str = "sentiment_score", path: str | None = None):
        self.spark, self.score = spark, score
        self.path = path or scratch_path(spark, "moments")

    def update(self, rows: DataFrame, batch_id: int) -> None:
        part = (rows.where(F.col(self.score).isNotNull()).groupBy("ticker", F.to_date("ts").alias("day"))
                .agg(F.count("*").alias("n"), F.avg(self.score).alias("mean"), (F.var_pop(self.score) * F.count("*")).alias("m2")))
        part.write.mode("overwrite").parquet(os.path.join(self.path, f"batch-{batch_id}"))

    @staticmethod
    def merged(parts: DataFrame) -> DataFrame:
        """One row per ticker and day: the means meet weighted, and their distances from the whole mean join the deviations."""
        day = Window.partitionBy("ticker", "day")
        whole = F.sum(F.col("n") * F.col("mean")).over(day) / F.sum("n").over(day)
        apart = F.col("n") * (F.col("mean") - F.col("whole")) * (F.col("mean") - F.col("whole"))
        return (parts.withColumn("whole", whole).groupBy("ticker", "day")
                .agg(F.sum("n").alias("n"), F.any_value("whole").alias("mean"), F.sum(F.col("m2") + apart).alias("m2")))

    def daily(self) -> DataFrame:
        """The moments so far."""
        first, last = (newest_number(self.spark, self.path, x) for x in ("upto", "batch"))
        folders = [f"upto-{first}"] if first is not None else []
        folders += [f"batch-{k}" for k in range(-1 if first is None else first + 1, -1 if last is None else last + 1) if k >= 0]
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.merged(self.spark.read.schema(self.SCHEMA).parquet(*[os.path.join(self.path, f) for f in folders]))

    def compact(self) -> None:
        """Call it between batches; older folders may be deleted after it."""
        last = newest_number(self.spark, self.path, "batch")
        if last is not None:
            self.daily().write.mode("overwrite").parquet(os.path.join(self.path, f"upto-{last}"))

    def anomalies(self, days: int = 7, z: float = 2.0) -> DataFrame:
        """What :func:`summaries.anomalies` gives for all records so far."""
        return anomaly_flags(self.daily().select("ticker", "day", F.col("mean").alias("mean_score")), days, z)
