"""Aggregates over scored records: means, label mixes, distributions and daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge.functions import predicates as P
from newsgauge.functions.labels import band_color
from newsgauge.functions.stats import count_where, exact_mean, exact_quantiles, exact_sum, mean_or_zero

SCORE = "sentiment_score"
LABELS = ("positive", "neutral", "negative")


def average_since(df: DataFrame, since, ticker: str | None = None) -> DataFrame:
    """Mean score since a time: one row and 0.0 without rows for one ticker, else one row per ticker."""
    recent = df.where(F.col("ts") >= P.ntz(since))
    if ticker is not None:
        return recent.where(P.ticker_is(ticker)).agg(mean_or_zero(SCORE).alias("avg_score"))
    return recent.groupBy("ticker").agg(mean_or_zero(SCORE).alias("avg_score"))


def count_rows(df: DataFrame, condition: Column | None = None) -> DataFrame:
    return (df if condition is None else df.where(condition)).agg(F.count("*").alias("n"))


def ticker_stats(df: DataFrame) -> DataFrame:
    """Mean, sample deviation, count and label counts per ticker, in one pass."""
    return df.groupBy("ticker").agg(
        exact_mean(SCORE).alias("mean_score"), F.stddev_samp(SCORE).alias("std_score"), F.count(SCORE).alias("n"),
        *[count_where(F.col("label") == l).alias(f"{l}_count") for l in LABELS])


def overall_summary(df: DataFrame) -> DataFrame:
    return df.agg(exact_mean(SCORE).alias("mean_score"), F.count("*").alias("total_articles"),
                  *[count_where(F.col("label") == l).alias(f"{l}_count") for l in LABELS])


def verification(df: DataFrame) -> DataFrame:
    """Records, distinct tickers, label counts and mean per ticker, with a total row (ticker NULL)."""
    labels = [count_where(F.col("label") == l).alias(l) for l in LABELS]
    return df.rollup("ticker").agg(F.count("*").alias("records"), F.count_distinct(F.col("ticker")).alias("tickers"),
                                   *labels, exact_mean(SCORE).alias("avg_score"))


def source_top(df: DataFrame, k: int = 10) -> DataFrame:
    """Largest sources with their mean score and colour."""
    return (df.groupBy("source").agg(F.count("*").alias("n"), exact_mean(SCORE).alias("mean_score"))
            .orderBy(F.col("n").desc(), "source").limit(k)
            .withColumn("color", band_color("mean_score")))


def boxplot(df: DataFrame, by: str = "ticker", value: str = SCORE) -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 inter-quartile ranges) and number of outliers per group."""
    q = exact_quantiles(df, [by], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    fences = q.withColumns({"_lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                            "_hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    counts = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    return counts.join(fences, by).groupBy(by).agg(
        *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).cast("long").alias("outliers"))


def histogram(df: DataFrame, value: str = SCORE, bins: int = 20) -> DataFrame:
    """Equal-width bins over the value range (the last one closed), with the overall mean and median; one bin, number 0, where
    all values are equal."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), exact_mean(value).alias("mean"))
    lo, hi, mean = (ends.select(c).scalar() for c in ("lo", "hi", "mean"))
    median = exact_quantiles(df, [], value, {"median": 0.5}).scalar()
    position = F.coalesce(F.floor(F.try_divide(F.col(value) - lo, hi - lo) * bins).cast("int"), F.lit(0))
    counts = (df.where(F.col(value).isNotNull()).groupBy(F.least(position, F.lit(bins - 1)).alias("bin"))
              .agg(F.count("*").alias("n")))
    return counts.withColumns({"mean_score": mean, "median_score": median})


def daily_series(df: DataFrame) -> DataFrame:
    """Daily means per ticker from its first to its last day (NULL on empty days)."""
    daily = df.groupBy("ticker", F.to_date("ts").cast("timestamp_ntz").alias("day")).agg(exact_mean(SCORE).alias("mean_score"))
    spans = daily.groupBy("ticker").agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    calendar = spans.select("ticker", F.explode(F.sequence("_first", "_last", F.expr("interval 1 day"))).alias("day"))
    return calendar.join(daily, ["ticker", "day"], "left")


def raw_series(df: DataFrame) -> DataFrame:
    """The points themselves, for tickers with too few of them to be worth resampling."""
    return df.select("ticker", F.col("ts").alias("day"), F.col(SCORE).alias("mean_score"))


def heatmap(df: DataFrame) -> DataFrame:
    """Mean score per ticker and date, long form."""
    return df.groupBy("ticker", F.to_date("ts").alias("date")).agg(exact_mean(SCORE).alias("mean_score"))


def heatmap_pivot(df: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Tickers by dates. The dates are given, so no extra job looks for them and the schema is known."""
    long = heatmap(df).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    wide = long.groupBy("ticker").pivot("date", list(dates)).agg(F.first("mean_score"))
    return wide.select("ticker", *[F.col(f"`{d}`").alias("d_" + d.replace("-", "_")) for d in dates])


def heatmap_grid(df: DataFrame) -> DataFrame:
    """Every ticker on every date that any record has, with a NULL mean where it has none: the cells of the pivot, without a
    column per date and without a job that looks for the dates."""
    long = heatmap(df)
    dates = long.agg(F.array_sort(F.collect_set("date"))).scalar()  # as many values as the data have days
    cells = long.select("ticker").distinct().select("ticker", F.explode(dates).alias("date"))
    return cells.join(long, ["ticker", "date"], "left")


def news_summary(df: DataFrame) -> DataFrame:
    """Rows, oldest and newest per ticker, and the grand total (ticker NULL), in one pass."""
    return df.rollup("ticker").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def label_distribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per label and their share in percent, overall or within each group of ``by``."""
    counts = df.groupBy(*by, "label").agg(F.count("*").alias("n"))
    # Windows only over the counts: at most one row per label and group.
    total = F.sum("n").over(Window.partitionBy(*by)) if by else counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percentage", F.col("n") * 100.0 / total)


def dominant_label(df: DataFrame) -> DataFrame:
    """Mean score, rows and most frequent label (first in order on a tie) per ticker, largest first."""
    per_label = df.groupBy("ticker", "label").agg(
        F.count("*").alias("_n"), exact_sum(SCORE).alias("_s"), F.count(SCORE).alias("_scored"))
    out = per_label.groupBy("ticker").agg(
        F.try_divide(F.sum("_s"), F.sum("_scored").cast("double")).alias("avg_score"), F.sum("_n").cast("long").alias("n"),
        F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("dominant_label"))
    return out.orderBy(F.col("n").desc(), "ticker")


def collection_totals(runs: DataFrame) -> DataFrame:
    """Totals over per-ticker collection runs (``items``, ``ok``)."""
    return runs.agg(F.count("*").alias("runs"), count_where(F.col("ok")).alias("succeeded"),
                    count_where(~F.col("ok")).alias("failed"), F.sum("items").cast("long").alias("total_items"),
                    F.coalesce(F.try_divide(count_where(F.col("ok")) * 100.0, F.count("*")), F.lit(0.0)).alias("success_rate"))


def top_by_ticker(df: DataFrame, n: int, highest: bool = True) -> DataFrame:
    """The ``n`` highest (or lowest) scores per ticker with their rank. The literal bound on ``row_number``
    lets Spark cut every group to ``n`` rows before the shuffle."""
    score = F.col(SCORE).desc() if highest else F.col(SCORE).asc()
    w = Window.partitionBy("ticker").orderBy(score, F.col("ts").desc(), F.col("id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).orderBy("ticker", "rank")


def latest_by_ticker(df: DataFrame, as_of, hours: int = 24, n: int = 1) -> DataFrame:
    """Newest ``n`` records per ticker among those of the last ``hours`` before ``as_of``."""
    end = P.ntz(as_of)
    fresh = df.where((F.col("ts") <= end) & (F.col("ts") >= end - F.expr(f"interval {int(hours)} hours")))
    w = Window.partitionBy("ticker").orderBy(F.col("ts").desc(), F.col("id").desc())
    return fresh.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def credibility_weighted(events: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Mean score per ticker and day, and the same weighted by the mean credibility of that day's events.

    Both sides are reduced to one row per (ticker, day) before they meet, so no ticker's rows are paired up.
    """
    trust = (events.select(F.explode("tickers").alias("ticker"), F.to_date("published_at").alias("day"), "credibility_score")
             .groupBy("ticker", "day").agg(exact_mean("credibility_score").alias("credibility"), F.count("*").alias("events")))
    tone = sentiment.groupBy("ticker", F.to_date("ts").alias("day")).agg(exact_mean(SCORE).alias("mean_score"))
    return (tone.join(trust, ["ticker", "day"])
            .withColumn("weighted_score", F.col("mean_score") * F.col("credibility")))


def move_correlation(sentiment: DataFrame, prices: DataFrame) -> DataFrame:
    """Correlation per ticker between a day's mean score and the day's relative price move.

    ``prices`` holds (ticker, day, price); the move is against the ticker's previous day.
    """
    tone = sentiment.groupBy("ticker", F.to_date("ts").alias("day")).agg(exact_mean(SCORE).alias("mean_score"))
    w = Window.partitionBy("ticker").orderBy("day")
    moves = prices.withColumn("move", F.try_divide(F.col("price"), F.lag("price").over(w)) - 1)
    both = tone.join(moves, ["ticker", "day"]).where(F.col("move").isNotNull())
    return both.groupBy("ticker").agg(F.count("*").alias("days"), F.corr("mean_score", "move").alias("correlation"))


def anomalies(df: DataFrame, days: int = 7, z: float = 2.0) -> DataFrame:
    """Daily mean per ticker with mean and deviation of the ``days`` days before it and a flag beyond ``z``.

    Rows are reduced to days first, so the window sees one row per day however many records a ticker has.
    """
    daily = df.groupBy("ticker", F.to_date("ts").alias("day")).agg(exact_mean(SCORE).alias("mean_score"))
    return anomaly_flags(daily, days, z)


def anomaly_flags(daily: DataFrame, days: int = 7, z: float = 2.0) -> DataFrame:
    """The rows (ticker, day, mean_score) of :func:`anomalies` with its other columns."""
    before = (Window.partitionBy("ticker").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date")))
              .rangeBetween(-days, -1))
    out = daily.withColumns({"base_mean": F.avg("mean_score").over(before),
                             "base_std": F.stddev_samp("mean_score").over(before)})
    return out.withColumn("anomaly", F.coalesce(
        (F.col("base_std") > 0) & (F.abs(F.col("mean_score") - F.col("base_mean")) > z * F.col("base_std")), F.lit(False)))
