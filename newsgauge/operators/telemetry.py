"""Operation logs: bins, alerts, percentiles, moving averages, rates and deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge.functions import predicates as P
from newsgauge.functions import vocab
from newsgauge.functions.stats import affine_scan, exact_mean, exact_quantiles, exact_sum

BIN = "15 minutes"


def in_bins(df: DataFrame, by: Sequence[str], width: str = BIN, slide: str | None = None):
    """Group by time bin and ``by``; the bin's start is column ``bin`` of :func:`bin_start`. Batch or stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return df.groupBy(window.alias("_w"), *by)


def bin_start(df: DataFrame) -> DataFrame:
    return df.withColumn("bin", F.col("_w.start")).drop("_w")


def durations(op_log: DataFrame, by: Sequence[str] = ("query_type",)) -> DataFrame:
    """Mean, maximum and number of operations per bin."""
    return bin_start(in_bins(op_log, by).agg(
        exact_mean("duration_ms").alias("avg_duration"), F.max("duration_ms").alias("max_duration"), F.count("*").alias("n")))


def counts(op_log: DataFrame, by: Sequence[str]) -> DataFrame:
    return bin_start(in_bins(op_log, by).agg(F.count("*").alias("n")))


def errors(op_log: DataFrame) -> DataFrame:
    """Errors (severity 3 or 4) per bin, backend and type."""
    return counts(op_log.where(F.col("severity").isin(3, 4)), ["backend", "error_type"])


def slow_alerts(op_log: DataFrame, threshold_ms: float) -> DataFrame:
    """Bins and query types whose mean duration is above the threshold."""
    means = bin_start(in_bins(op_log, ["query_type"]).agg(exact_mean("duration_ms").alias("avg_duration")))
    return means.where(F.col("avg_duration") > threshold_ms)


def error_alerts(op_log: DataFrame, threshold: int) -> DataFrame:
    """Bins with more errors than the threshold."""
    bad = op_log.where(F.col("severity") >= 3)
    return bin_start(in_bins(bad, []).agg(F.count("*").alias("error_count"))).where(F.col("error_count") > threshold)


def recent_means(op_log: DataFrame, last: int) -> DataFrame:
    """Mean duration per query type over the successful ones among the last ``last`` operations."""
    recent = op_log.orderBy(F.col("ts").desc(), F.col("op_id").desc()).limit(last)
    return recent.where("ok").groupBy("query_type").agg(exact_mean("duration_ms").alias("avg_duration"))


def percentiles(op_log: DataFrame, by: Sequence[str] = ("op_type",)) -> DataFrame:
    """Exact p50, p90, p95 and p99 of the duration."""
    return exact_quantiles(op_log, by, "duration_ms", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def rates(op_log: DataFrame, by: Sequence[str], width: str = "1 minute", seconds: float = 60.0) -> DataFrame:
    """Operations per second and bin."""
    return bin_start(in_bins(op_log, by, width).agg((F.count("*") / F.lit(seconds)).alias("per_second")))


def moving_average(df: DataFrame, key: str, value: str, order: Sequence[str], weight: float = 0.7, into: str = "ewma") -> tuple[DataFrame, DataFrame]:
    """Moving average a := a * (1 - weight) + value * weight of each key, from its first value: (all rows with the average
    after each, one row per key with the last one). Rows without a value are left out. ``order`` must be unique in a key."""
    rows = df.where(F.col(value).isNotNull())
    return affine_scan(rows, key, order, value, F.lit(1.0 - weight), F.col(value) * F.lit(weight), into)


def ewma(df: DataFrame, key: str, value: str, order: Sequence[str], weight: float = 0.7) -> DataFrame:
    """:func:`moving_average` after the last row of each key."""
    return moving_average(df, key, value, order, weight)[1]


def duration_sketches(op_log: DataFrame, by: Sequence[str], k: int = 400) -> DataFrame:
    """(bin, by, n, sketch): per 15-minute bin a quantile sketch of the durations, to be stored as rows. With ``k`` 400 a
    rank is off by 0.7 % or so, however many sketches are merged."""
    return bin_start(in_bins(op_log, by).agg(F.count("duration_ms").alias("n"), F.kll_sketch_agg_double("duration_ms", F.lit(k)).alias("sketch")))


def rolled_up(sketches: DataFrame, by: Sequence[str], probs: dict[str, float], k: int = 400) -> DataFrame:
    """Quantiles over any range of bins from their sketches, without the raw rows: (by, n, one column per entry of ``probs``)."""
    merged = sketches.where(F.col("n") > 0).groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(p)).alias(name) for name, p in probs.items()])


def usage_stats(requests: DataFrame, as_of, limit: int, period_seconds: int, share: float = 0.75) -> DataFrame:
    """Clients, (client, endpoint) pairs, and pairs beyond ``share`` of the limit, over the period before ``as_of``."""
    live = requests.where((F.col("ts") <= P.ntz(as_of)) & (F.col("ts") > P.ntz(as_of) - F.expr(f"interval {int(period_seconds)} seconds")))
    pairs = live.groupBy("client", "endpoint").agg(F.count("*").alias("_n"))
    clients = pairs.groupBy("client").agg(F.count("*").alias("_e"), F.count_if(F.col("_n") > limit * share).alias("_a"))
    return clients.agg(F.count("*").alias("total_clients"), F.coalesce(F.sum("_e"), F.lit(0)).cast("long").alias("total_endpoints"),
                       F.coalesce(F.sum("_a"), F.lit(0)).cast("long").alias("approaching_limit"))


def rate_limits(requests: DataFrame, limit: int, period_seconds: int, slices: int = 64) -> DataFrame:
    """Each request with the number of requests of its (client, endpoint) in the period up to it, limited or not.

    Every request counts from its time on and stops counting one period later, so the number is a running sum of
    +1 and -1, which is linear where a sliding frame would go through its rows again for each request. Time is cut
    into cells of one period, and a cell into ``slices``, so that a busy client is shared by many tasks even within one
    period: the -1 of a request lies in the cell after its own, a cell starts with as many live requests as will stop
    counting in it, and a slice with the sum of those before it in its cell, one summary row each.
    """
    period = int(period_seconds) * 1_000_000
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    steps = F.array(F.struct(at.alias("at"), F.lit(1).alias("delta")), F.struct((at + period).alias("at"), F.lit(-1).alias("delta")))
    when = F.col("_s.at")
    slice_ = F.struct("client", "endpoint", F.floor(when / period).alias("cell"),  # as a struct, nulls are equal in the join
                      F.floor(F.pmod(when, F.lit(period)) * F.lit(int(slices)) / period).alias("slice"))
    spread = requests.select("*", F.explode(steps).alias("_s")).withColumn("_slice", slice_)
    cell = Window.partitionBy("_slice.client", "_slice.endpoint", "_slice.cell")
    earlier = cell.orderBy("_slice.slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (spread.groupBy("_slice").agg(F.sum("_s.delta").alias("_sum"), F.count_if(F.col("_s.delta") < 0).alias("_ends"))
              .select("_slice", (F.coalesce(F.sum("_sum").over(earlier), F.lit(0)) + F.sum("_ends").over(cell)).alias("_before")))
    upto = Window.partitionBy("_slice").orderBy(when).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = (spread.join(before, "_slice").withColumn("request_count", F.sum("_s.delta").over(upto) + F.col("_before"))
           .where(F.col("_s.delta") > 0))
    return own.withColumns({"limited": F.col("request_count") >= limit,
                            "remaining": F.greatest(F.lit(0), limit - F.col("request_count"))}).drop("_s", "_slice", "_before")


def retry_delay(attempt: Column, base: int = vocab.RETRY["base"], factor: int = vocab.RETRY["factor"], cap: int = vocab.RETRY["cap"]) -> Column:
    """Delay in ms before a retry, without the random jitter."""
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(float(factor)), attempt))


def event_fanout(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Deliveries: every event to every active subscriber that listed its kind or ``*``.

    An event goes by two names, its kind and ``*``, and a subscriber waits under ``*`` or under kinds, never both, so
    that the join is an equi-join on the name.
    """
    names = F.when(F.array_contains("events", "*"), F.array(F.lit("*"))).otherwise(F.array_distinct("events"))
    targets = subscribers.where("active").select("subscriber_id", F.explode(names).alias("_name"))
    named = events.withColumn("_name", F.explode(F.array_distinct(F.array("event_type", F.lit("*")))))
    return named.join(targets, "_name").drop("_name")


def fanout_totals(events: DataFrame, subscribers: DataFrame, key: str = "event_id") -> DataFrame:
    """Deliveries per subscriber and kind, with the first and last ``key``: events are counted by kind before they meet
    the subscribers, so that no delivery is listed."""
    kinds = events.groupBy("event_type").agg(F.count("*").alias("deliveries"), F.min(key).alias("first_event"), F.max(key).alias("last_event"))
    return event_fanout(kinds, subscribers).select("subscriber_id", "event_type", "deliveries", "first_event", "last_event")


def newest_results(deliveries: DataFrame) -> DataFrame:
    """One status code per delivery: the newest by ``ts``, or, without that column, the lowest, so that a success counts."""
    newest = F.max_by("status_code", "ts") if "ts" in deliveries.columns else F.min("status_code")
    return deliveries.groupBy("delivery_id").agg(newest.alias("status_code"))


def retry_step(queue: DataFrame, subscribers: DataFrame, deliveries: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Outcome of one pass over the retry queue: queue items with an active subscriber and a delivery log entry.

    2xx delivers; 4xx but for 408 and 429 is permanent; all else may be tried again. What fails stays in the queue
    with one more attempt until ``max_attempts``.
    """
    alive = (queue.join(subscribers.where("active").select("subscriber_id"), "subscriber_id")
             .join(newest_results(deliveries), "delivery_id"))
    code = F.col("status_code")
    permanent = code.between(400, 499) & ~code.isin(408, 429)
    return alive.select(
        "delivery_id", "subscriber_id", "attempts", "status_code",
        F.when(code.between(200, 299), "delivered").when(permanent, "failed").otherwise("retry").alias("outcome"),
        (~code.between(200, 299) & (F.col("attempts") < max_attempts)).alias("requeued"),
        F.when(~code.between(200, 299) & ~permanent, retry_delay(F.col("attempts"))).alias("delay_ms"))


def retry_totals(queue: DataFrame, step: DataFrame) -> DataFrame:
    processed = queue.agg(F.count("*")).scalar()
    return step.agg(F.count_if(F.col("outcome") == "delivered").alias("succeeded"), F.count_if("requeued").alias("remaining")).withColumn("processed", processed)


def priority_split(rows: DataFrame, high: Column) -> DataFrame:
    """Route of each row: ``high`` or ``standard``."""
    return rows.withColumn("route", F.when(F.coalesce(high, F.lit(False)), "high").otherwise("standard"))
