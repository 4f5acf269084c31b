"""Statistics that give one answer whatever the partitioning, and that no hot key can overload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge.session import staged


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def exact_sum(column: str | Column) -> Column:
    """Sum of doubles in two parts: each value to 12 decimals as DECIMAL, which adds up exactly in any order, and what is left
    of it as a double. So values of 12 decimals give one answer whatever the partitioning, and no digit of others is
    lost; values of 1e12 and more are summed as doubles."""
    value = _col(column).cast("double")
    whole = F.when(F.abs(value) < 1e12, value.try_cast("decimal(24,12)"))
    rest = value - F.coalesce(whole.cast("double"), F.lit(0.0))
    return F.sum(rest) + F.coalesce(F.sum(whole).cast("double"), F.lit(0.0))


def exact_mean(column: str | Column) -> Column:
    """Mean over :func:`exact_sum`; NULL for no rows."""
    return F.try_divide(exact_sum(column), F.count(_col(column)).cast("double"))


def mean_or_zero(column: str | Column) -> Column:
    """Mean that is 0.0 for no rows."""
    return F.coalesce(exact_mean(column), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def magnitude_bin(value: Column, unit: float = 1e-3, per_e_fold: int = 64) -> Column:
    """An order-preserving bin number: bins grow with |value|, so any range of doubles needs only few."""
    return (F.signum(value) * F.floor(F.ln(1 + F.abs(value) / unit) * per_e_fold)).cast("int")


def _piece(value: Column, pieces: int = 4096) -> Column:
    """Number of the equal-width piece between ``_lo`` and ``_hi``, the ends of the bin, in which a value lies."""
    value, lo, hi = value.cast("double"), F.col("_lo").cast("double"), F.col("_hi").cast("double")
    return F.when(hi > lo, F.floor((value - lo) / (hi - lo) * pieces)).otherwise(F.lit(0).cast("bigint"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles, one column per entry of ``probs``, one row per group.

    A sort of the whole group in one task (or the in-memory count map behind ``percentile``) would follow the
    largest group. Here equal values are counted first, spread by (group, value); a histogram of bins finds
    the few bins that hold the wanted ranks, a second one cuts those between their own ends, so that values in a
    narrow range are spread as well; only the pieces with wanted ranks are sorted, each on its own.
    """
    by = list(by) or ["_all"]
    if by == ["_all"]:
        df = df.withColumn("_all", F.lit(0))
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
              .withColumn("_bin", magnitude_bin(F.col("_v"))))

    in_order = Window.partitionBy(*by).orderBy("_bin")
    bins = (counts.groupBy(*by, "_bin").agg(F.sum("_n").alias("_bin_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
            .withColumn("_end", F.sum("_bin_n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_total", F.sum("_bin_n").over(Window.partitionBy(*by))))

    def target(name: str, p: float, side: str) -> Column:
        position = F.lit(p) * (F.col("_total") - 1)
        rank = F.floor(position) if side == "lo" else F.ceil(position)
        return F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.cast("long").alias("rank"),
                        (position - F.floor(position)).alias("fraction"))

    targets = F.array(*[target(n, p, s) for n, p in probs.items() for s in ("lo", "hi")])

    def holding(bins: DataFrame, among: Column, size: str, keys: Sequence[str]) -> DataFrame:
        start = F.col("_end") - F.col(size)
        return (bins.withColumn("_held", F.filter(among, lambda t: (t["rank"] >= start) & (t["rank"] < F.col("_end"))))
                .where(F.size("_held") > 0).select(*keys, start.alias("_start"), F.col("_held").alias("_targets")))

    coarse = holding(bins, targets, "_bin_n", [*by, "_bin", "_lo", "_hi"])
    pieces = counts.join(coarse, [*by, "_bin"]).withColumn("_piece", _piece(F.col("_v")))
    along = Window.partitionBy(*by, "_bin").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    sizes = (pieces.groupBy(*by, "_bin", "_piece").agg(
                F.sum("_n").alias("_piece_n"), F.any_value("_start").alias("_from"), F.any_value("_targets").alias("_targets"))
             .withColumn("_end", F.col("_from") + F.sum("_piece_n").over(along)))
    wanted = holding(sizes, F.col("_targets"), "_piece_n", [*by, "_bin", "_piece"])

    in_piece = Window.partitionBy(*by, "_bin", "_piece").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (pieces.drop("_start", "_targets").join(wanted, [*by, "_bin", "_piece"])
              .withColumn("_upto", F.col("_start") + F.sum("_n").over(in_piece)))
    hits = (placed.select(*by, "_v", F.explode(F.filter(
                "_targets", lambda t: (t["rank"] < F.col("_upto")) & (t["rank"] >= F.col("_upto") - F.col("_n")))).alias("_t"))
            .select(*by, "_v", "_t.*"))
    ends = hits.groupBy(*by).agg(*[
        F.max(F.when((F.col("name") == n) & (F.col("side") == s), F.col(c))).alias(f"_{n}_{a}")
        for n in probs for s, c, a in (("lo", "_v", "lo"), ("hi", "_v", "hi"), ("lo", "fraction", "f"))])
    out = ends.select(*by, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n) for n in probs])
    return out.drop("_all")


def number_in_chunks(df: DataFrame, key: Sequence[str], chunk: Column | None, order: Sequence[str],
                     number: str, following: str, chunk_bits: int = 12) -> DataFrame:
    """Running number per key in ascending ``order``, and the leading order column of the key's next row.

    The same as ``row_number`` and ``lead`` over the whole key, but a key with many rows is worked on chunk by
    chunk: ``chunk`` must rise with the leading order column; without it the rows are sorted and staged, and a chunk is up to
    2**chunk_bits neighbouring rows. Only one summary row per (key, chunk) meets in one task. A null key is one too.
    """
    lead = order[0]
    columns = df.columns
    if chunk is None:
        df = staged(df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn("_id", F.monotonically_increasing_id()))
        chunk = F.shiftright("_id", chunk_bits)
    df = df.withColumn("_chunk", F.struct(*[F.col(k) for k in key], chunk.alias("_part")))  # as a struct, nulls are equal in the join
    inner = Window.partitionBy("_chunk").orderBy(*order)
    across = Window.partitionBy(*[f"_chunk.{k}" for k in key]).orderBy("_chunk._part")
    chunks = df.groupBy("_chunk").agg(F.count("*").alias("_size"), F.min(lead).alias("_first"))
    chunks = chunks.select(
        "_chunk", F.lead("_first").over(across).alias("_next"),
        F.coalesce(F.sum("_size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (df.join(chunks, "_chunk")
            .withColumns({number: F.row_number().over(inner) + F.col("_before"),
                          following: F.coalesce(F.lead(lead).over(inner), F.col("_next"))})
            .select(*columns, number, following))


def _composed(df: DataFrame, by: Sequence[str], order: str, rows: int) -> DataFrame:
    """Each row's map x -> _m * x + _b composed with those of all rows before it in its group of at most ``rows`` rows: in steps
    that double, a row takes up the map of the row 1, 2, 4, ... before it."""
    before = Window.partitionBy(*by).orderBy(order)
    step = 1
    while step < rows:
        m, b = F.lag("_m", step, 1.0).over(before), F.lag("_b", step, 0.0).over(before)
        df = df.withColumns({"_pm": m, "_pb": b}).withColumns({"_b": F.col("_m") * F.col("_pb") + F.col("_b"), "_m": F.col("_m") * F.col("_pm")})
        step *= 2
    return df.drop("_pm", "_pb")


def affine_scan(df: DataFrame, key: str, order: Sequence[str], start: str, slope: Column, shift: Column,
                into: str, chunk_bits: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per key x := slope * x + shift, row after row in ``order``, from the value of ``start`` in the key's first row.

    Returns ``df`` with x after each row as ``into``, and (key, ``into``) with x after the last one. A row is a map, and maps
    compose, so that a key of any size is worked on in chunks of 2**chunk_bits rows; one map per chunk meets in one task. A
    null key is one too.
    """
    rows = staged(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_id", F.monotonically_increasing_id()))
    chunked = rows.withColumns({"_at": F.struct(F.col(key), F.shiftright("_id", chunk_bits).alias("chunk")), "_m": slope.cast("double"), "_b": shift.cast("double")})
    inner = _composed(chunked, ["_at"], "_id", 1 << chunk_bits)
    whole = inner.groupBy("_at").agg(F.max_by(F.struct("_m", "_b"), "_id").alias("_map"), F.min_by(F.col(start).cast("double"), "_id").alias("_first"),
                                     F.min("_id").alias("_from"))
    chunks = staged(whole.select("_at", F.col("_at")[key].alias("_key"), "_map.*", "_first", "_from"))
    most = chunks.groupBy("_key").agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    upto = _composed(chunks.withColumn("_of", F.struct("_key")), ["_of"], "_from", rows.sparkSession.range(1).select(F.coalesce(most, F.lit(1))).first()[0])
    of_key = Window.partitionBy("_of").orderBy("_from")
    first = F.first("_first").over(of_key.rowsBetween(Window.unboundedPreceding, 0))
    after = upto.withColumn("_x", F.col("_m") * first + F.col("_b"))
    begun = after.select("_at", F.coalesce(F.lag("_x").over(of_key), F.col("_first")).alias("_begin"))
    each = (inner.join(begun, "_at").withColumn(into, F.col("_m") * F.col("_begin") + F.col("_b"))
            .drop("_id", "_at", "_m", "_b", "_begin"))
    last = after.groupBy("_of").agg(F.max_by("_x", "_from").alias(into)).select(F.col("_of._key").alias(key), into)
    return each, last


def ranks_between(df: DataFrame, column: str, low: Column | int, high: Column | int) -> DataFrame:
    """Rows whose 0-based position in the order of the numeric, unique ``column`` lies in [low, high).

    Positions come from a histogram of bins that grow with the value, and one of equal pieces of each bin that is hit, so
    that neither a far outlier nor a narrow range puts many rows into one task; a plain ``offset`` would pull every row
    before the range into one place.
    """
    binned = df.withColumn("_bin", magnitude_bin(F.col(column).cast("double"), 1.0))

    def hit(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
        start = F.col("_end") - F.col("_n")
        return sizes.where((F.col("_end") > low) & (start < high)).select(*keys, start.alias("_start"))

    bins = binned.groupBy("_bin").agg(F.count("*").alias("_n"), F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # a few thousand rows at most
    coarse = hit(bins.withColumn("_end", F.sum("_n").over(upto)), ["_bin", "_lo", "_hi"])
    pieces = binned.join(coarse, "_bin").withColumn("_piece", _piece(F.col(column)))
    along = Window.partitionBy("_bin").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    sizes = (pieces.groupBy("_bin", "_piece").agg(F.count("*").alias("_n"), F.any_value("_start").alias("_from"))
             .withColumn("_end", F.col("_from") + F.sum("_n").over(along)))
    inner = Window.partitionBy("_bin", "_piece").orderBy(column)
    return (pieces.drop("_start").join(hit(sizes, ["_bin", "_piece"]), ["_bin", "_piece"])
            .withColumn("_position", F.row_number().over(inner) - 1 + F.col("_start"))
            .where((F.col("_position") >= low) & (F.col("_position") < high))
            .drop("_bin", "_piece", "_lo", "_hi", "_start", "_position"))
