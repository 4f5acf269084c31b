"""Two copies of a table: what is missing, what differs, how schemas and profiles drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from newsgauge.functions.stats import exact_mean, exact_sum
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

TOLERANCE = 1e-6


def keep_first(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """First row of each key in a declared order; Spark cuts each key to one row before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def paired(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Full outer pairing with structs ``s`` and ``t``; a missing side is NULL."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias("_k"), F.struct(*[F.col(c) for c in df.columns]).alias(name))

    return side(source, "s").join(side(target, "t"), "_k", "full_outer").withColumnRenamed("_k", key)


def issue(condition: Column, message: str | Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(message) if isinstance(message, str) else message)


def differs(name: str) -> Column:
    return ~F.col(f"s.{name}").eqNullSafe(F.col(f"t.{name}"))


def number_differs(name: str, tolerance: float = TOLERANCE) -> Column:
    s, t = F.col(f"s.{name}"), F.col(f"t.{name}")
    return (F.abs(s - t) > tolerance) | (s.isNull() != t.isNull())


def map_issues(name: str, tolerance: float = TOLERANCE) -> Column:
    """Messages for maps of numbers: presence, then size, then keys and values of the source."""
    s, t = F.col(f"s.{name}"), F.col(f"t.{name}")

    def entry(e: Column) -> Column:
        other = F.try_element_at(t, e["key"])
        return (F.when(other.isNull(), F.concat(F.lit("missing attribute "), e["key"]))
                .when(F.abs(e["value"] - other) > tolerance, F.concat(F.lit("attribute value "), e["key"])))

    one = F.array(F.when(s.isNull() != t.isNull(), F.lit("attributes presence")))
    size = F.array(F.lit("attributes size"))
    return (F.when(s.isNull() | t.isNull(), one).when(F.size(s) != F.size(t), size)
            .otherwise(F.transform(F.map_entries(s), entry)))


def sentiment_issues() -> Column:
    """Differences between two copies of a scored record."""
    plain = [issue(differs("ticker"), "ticker"), issue(number_differs("sentiment_score"), "score"),
             issue(differs("ts"), "timestamp"), issue(differs("source"), "source")]
    return F.array_compact(F.concat(F.array(*plain), map_issues("attributes")))


def event_issues() -> Column:
    """Differences between two copies of a market event; tickers count as a set."""
    s, t = F.col("s.tickers"), F.col("t.tickers")
    missing = F.transform(F.array_except(s, t), lambda x: F.concat(F.lit("missing ticker "), x))
    content_s, content_t = F.col("s.content"), F.col("t.content")
    head = [issue(differs("headline"), "headline"), issue(F.size(s) != F.size(t), "tickers size")]
    tail = [issue(content_s.isNull() != content_t.isNull(), "content presence"),
            issue(content_s != content_t, "content"), issue(differs("published_at"), "published date"),
            issue(differs("source"), "source"), issue(number_differs("credibility_score"), "credibility score")]
    per_ticker = F.when(F.size(s) == F.size(t), missing).otherwise(F.array().cast("array<string>"))
    return F.array_compact(F.concat(F.array(*head), per_ticker, F.array(*tail)))


def digested(df: DataFrame, *columns: str) -> DataFrame:
    """Long texts replaced by their SHA-256, so that a comparison moves 64 characters of each instead of the text."""
    return df.withColumns({c: F.sha2(F.col(c), 256) for c in columns})


def differences(source: DataFrame, target: DataFrame, issues: Column, key: str = "id") -> DataFrame:
    """Rows on both sides that differ, with their issues."""
    both = paired(source, target, key).where(F.col("s").isNotNull() & F.col("t").isNotNull())
    return both.select(key, issues.alias("issues")).where(F.size("issues") > 0)


def missing_ids(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Keys on one side only, and the side that lacks them."""
    s = source.select(key).distinct().withColumn("_s", F.lit(True))
    t = target.select(key).distinct().withColumn("_t", F.lit(True))
    return (s.join(t, key, "full_outer").where(F.col("_s").isNull() | F.col("_t").isNull())
            .select(key, F.when(F.col("_t").isNull(), "target").otherwise("source").alias("missing_in")))


def summary(source: DataFrame, target: DataFrame, issues: Column, key: str = "id") -> DataFrame:
    """Counts, missing rows each way, differing rows and success percentage, from one full outer join.

    Every key must be unique on the source; on the target the caller keeps one row per key (:func:`keep_first`).
    """
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    rows = paired(source, target, key).select(
        F.col("s").isNotNull().alias("_s"), F.col("t").isNotNull().alias("_t"),
        F.when(both, F.size(issues) > 0).alias("_bad"))
    counts = rows.agg(
        F.count_if("_s").alias("source_count"), F.count_if("_t").alias("target_count"),
        F.count_if(F.col("_s") & ~F.col("_t")).alias("missing_in_target"),
        F.count_if(F.col("_t") & ~F.col("_s")).alias("missing_in_source"),
        F.count_if(F.col("_bad")).alias("difference_count"),
        F.count_if(F.col("_s") & F.col("_t")).alias("_common"))
    good = F.col("_common") - F.col("difference_count")
    return counts.withColumn("success_percentage", F.when(F.col("_common") > 0, good / F.col("_common") * 100).otherwise(0.0)).drop("_common")


def probes(df: DataFrame, key: str, ts: str, number: str, recent_since: Column) -> DataFrame:
    """One row of aggregates by which two copies can be compared without a join."""
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"),
        exact_sum(number).alias("total"), exact_mean(number).alias("mean"),
        F.min(number).alias("lowest"), F.max(number).alias("highest"), F.count_if(F.col(ts) > recent_since).alias("recent"))


def probe_parity(source: DataFrame, target: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Probe rows of two copies side by side: (probe, source, target, matches)."""
    def long(df: DataFrame, name: str) -> DataFrame:
        number = [F.struct(F.lit(c).alias("probe"), _as_number(df, c).alias("v")) for c in df.columns]
        return df.select(F.explode(F.array(*number)).alias("p")).select("p.probe", F.col("p.v").alias(name))

    both = long(source, "source_value").join(long(target, "target_value"), "probe", "full_outer")
    s, t = F.col("source_value"), F.col("target_value")
    return both.withColumn("matches", F.coalesce(F.abs(s - t) <= tolerance, s.isNull() & t.isNull()))


def _as_number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column)).cast("double") / 1e6
    return F.col(column).cast("double")


# Column types that may hold the same data in both stores.
COMPATIBLE: Mapping[str, Sequence[str]] = {
    "string": ("string",), "int": ("int", "bigint"), "bigint": ("bigint",), "double": ("double",), "float": ("float", "double"),
    "timestamp": ("timestamp", "timestamp_ntz"), "timestamp_ntz": ("timestamp_ntz", "timestamp"), "date": ("date",), "boolean": ("boolean",),
}


def schema_drift(source: T.StructType, target: T.StructType) -> list[tuple[str, str | None, str | None, str]]:
    """(column, source type, target type, status) from two schemas; pure metadata."""
    s = {f.name: f for f in source.fields}
    t = {f.name: f for f in target.fields}
    out = []
    for name in [*s, *[n for n in t if n not in s]]:
        a, b = s.get(name), t.get(name)
        if b is None:
            status = "missing in target"
        elif a is None:
            status = "extra in target"
        else:
            sa, sb = a.dataType.simpleString(), b.dataType.simpleString()
            if sa != sb and sb not in COMPATIBLE.get(sa, ()):
                status = "type differs"
            elif a.nullable and not b.nullable:
                status = "nullability differs"
            else:
                status = "match"
        out.append((name, a.dataType.simpleString() if a else None, b.dataType.simpleString() if b else None, status))
    return out


def profile(df: DataFrame, columns: Sequence[str], exact_distinct: bool = True) -> DataFrame:
    """Rows, NULLs, distinct values, smallest and largest value per column, long form.

    Exact distinct counts shuffle every distinct value of every column; on very wide or very large tables pass
    ``exact_distinct=False`` for sketches that merge in one pass.
    """
    def shown(c: str, value: Column) -> Column:
        return (value.cast("decimal(38,6)") if isinstance(df.schema[c].dataType, T.NumericType) else value).cast("string")

    if not exact_distinct:
        aggs = []
        for c in columns:
            aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.approx_count_distinct(F.col(c)).alias(f"{c}_distinct"),
                     F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
        one = df.agg(F.count("*").alias("_rows"), *aggs)
        rows = [F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"{c}_nulls").alias("nulls"),
                         F.col(f"{c}_distinct").alias("distinct_values"), shown(c, F.col(f"{c}_min")).alias("min_value"), shown(c, F.col(f"{c}_max")).alias("max_value"))
                for c in columns]
        return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    out = None
    for c in columns:  # one count of values per column gives all facts; no row is multiplied
        values = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        facts = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
                           F.count("v").alias("distinct_values"), shown(c, F.min("v")).alias("min_value"), shown(c, F.max("v")).alias("max_value"))
        row = facts.select(F.lit(c).alias("column"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def profile_drift(source: DataFrame, target: DataFrame, columns: Sequence[str], exact_distinct: bool = True) -> DataFrame:
    """Profiles and schema facts of two tables per column, and ``DRIFT_DETECTED`` where they differ."""
    facts = ("rows", "nulls", "distinct_values", "min_value", "max_value")
    s = profile(source, columns, exact_distinct).select("column", *[F.col(c).alias(f"source_{c}") for c in facts])
    t = profile(target, columns, exact_distinct).select("column", *[F.col(c).alias(f"target_{c}") for c in facts])
    kinds = {name: status for name, _, _, status in schema_drift(source.schema, target.schema)}
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    same = F.lit(True)
    for c in facts:
        same = same & F.col(f"source_{c}").eqNullSafe(F.col(f"target_{c}"))
    return (s.join(t, "column", "full_outer").withColumn("schema_status", types[F.col("column")])
            .withColumn("status", F.when(same & (F.col("schema_status") == "match"), "MATCH").otherwise("DRIFT_DETECTED")))


def evolve_union(old: DataFrame, new: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Rows of both schema versions; the new one may only add the columns in ``allowed``, as optional ones."""
    for name, _, _, status in schema_drift(old.schema, new.schema):
        if status not in ("match", "nullability differs") and not (status == "extra in target" and name in allowed):
            raise ValueError(f"unsafe schema change: column {name} {status}")
    return old.unionByName(new, allowMissingColumns=True)


def migration_outcome(source: DataFrame, errors: Column) -> DataFrame:
    """Copy with an outcome per row: ``migrated``, or ``failed`` with its errors."""
    return source.withColumn("errors", errors).withColumn("outcome", F.when(F.size("errors") == 0, "migrated").otherwise("failed"))


def migration_result(outcomes: DataFrame) -> DataFrame:
    total, ok = F.count("*"), F.count_if(F.col("outcome") == "migrated")
    return outcomes.agg(total.alias("total"), ok.alias("success"), F.count_if(F.col("outcome") == "failed").alias("failure"),
                        F.when(total > 0, (ok + F.count_if(F.col("outcome") == "failed")) / total).otherwise(0.0).alias("progress"))


def _beyond(ts: str, checkpoint: Column, last_id: Column | None) -> Column:
    """Rows after the checkpoint: later, or at its time with a larger id."""
    later = F.col(ts) > checkpoint
    return later if last_id is None else later | ((F.col(ts) == checkpoint) & (F.col("id") > last_id))


def incremental_window(df: DataFrame, checkpoint: Column, window: str, now: Column, max_rows: int, ts: str = "ts",
                       last_id: Column | None = None) -> DataFrame:
    """The next batch after a checkpoint, oldest first: up to checkpoint + window, not beyond ``now``.

    A batch may end among rows of one time; the checkpoint is therefore a time and the last id copied at that time.
    Without ``last_id`` all rows of the checkpoint's time count as copied.
    """
    end = F.least(checkpoint + F.expr(f"interval {window}"), now)
    return df.where(_beyond(ts, checkpoint, last_id) & (F.col(ts) <= end)).orderBy(ts, "id").limit(max_rows)


def incremental_status(df: DataFrame, batch: DataFrame, checkpoint: Column, ts: str = "ts", last_id: Column | None = None) -> DataFrame:
    """Rows of the batch, the new checkpoint (time and id; the old one after an empty batch), and whether rows remain
    beyond it, in this window or later."""
    newest = F.max(F.struct(F.col(ts), F.col("id")))
    done = batch.agg(F.count("*").alias("migrated"), F.coalesce(newest[ts], checkpoint).alias("new_checkpoint"),
                     F.coalesce(newest["id"], F.lit(None) if last_id is None else last_id).alias("new_last_id"))
    left = df.where(_beyond(ts, checkpoint, last_id)).agg(F.count("*").alias("_beyond"))
    return done.join(left, F.lit(True)).withColumn("more_rows", F.col("_beyond") > F.col("migrated")).drop("_beyond")


def stratified_ids(df: DataFrame, key: str, sample_size: int) -> DataFrame:
    """Ids from the beginning, middle and end of the key order, a third each (the rest goes to the end).

    The middle is found by counting, not by skipping half the table.
    """
    from newsgauge.functions.stats import ranks_between

    ids = df.select(key)
    total = df.agg(F.count("*")).scalar()
    size = F.least(F.lit(sample_size), total)
    third, rest = F.floor(size / 3), size % 3
    n = sample_size // 3  # what the limits need at most; fewer rows make fewer

    def ends(order: Column, stratum: str, wanted: Column, most: int) -> DataFrame:
        place = F.row_number().over(Window.orderBy(order))
        return ids.orderBy(order).limit(most).withColumn("_place", place).where(F.col("_place") <= wanted).drop("_place").withColumn("stratum", F.lit(stratum))

    low = F.greatest(F.lit(0), F.floor(total / 2) - F.floor(third / 2))
    middle = ranks_between(ids, key, low, low + third).withColumn("stratum", F.lit("middle"))
    return (ends(F.col(key).asc(), "first", third, n).unionByName(middle)
            .unionByName(ends(F.col(key).desc(), "last", third + rest, n + 2)))
