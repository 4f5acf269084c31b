"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target of words and a schedule, its weight over training time 0 to 1. The schedule's integral, scaled to
the target, is the source's cumulative demand. The documents of a source stand in a hashed order, repeated where the target
asks for more than one pass; a document is taken where its middle word lies within the target, and its training position is
the time at which the demand reaches that word. The mix is sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from newsgauge.llm.ordering import fresh, row_numbers, running_sums, scalar, text_of
from newsgauge.session import staged

WEIGHTS = (3, 1, 2)
#: (time, weight) knots by place in WEIGHTS: the heavy sources fade out, the light ones stay, the middle ones come in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
WORD = r"[^\x20\x09-\x0D]+"


def size_in_words(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, place, target): one row per source. A null source is one too, the last.

    Sources take ``weights`` in turn, in code-point order; ``place`` is the index of the weight. Together the targets make
    ``share`` of all words; a target above ``cap`` times its source's size is cut to it and the excess shared anew by
    weight, until none is above. That is the level at which min(cap, level * weight) sums to the whole; each round is one
    aggregate over the sources, and the driver holds two numbers.
    """
    per_source = sizes.select(F.col(source).alias("source"), F.col(size).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = staged(row_numbers(per_source, ["source"], "_rank")
                    .select("source", "source_size", (F.col("_rank") % len(weights)).cast("int").alias("place")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") + 1)
    most = cap * F.col("source_size")
    whole = share * float(scalar(ranked.agg(F.sum("source_size")))[0] or 0)
    level = 0.0
    while True:
        full = most < level * weight
        used, free = scalar(ranked.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, weight))))
        higher = (whole - (used or 0.0)) / free if free else level
        if higher <= level:
            break
        level = higher
    return ranked.select("source", "source_size", "place", F.least(most, F.lit(level) * weight).alias("target"))


def time_of(demand: Column, place: Column, schedules: Sequence = SCHEDULES) -> Column:
    """The time at which a source's cumulative demand reaches the share ``demand`` (0 to 1) of its target."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        pairs = list(zip(knots, knots[1:], strict=False))
        areas = [(w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in pairs]
        upto, segments = 0.0, []
        for ((t0, w0), (t1, w1)), area in zip(pairs, areas, strict=True):
            slope = (w1 - w0) / (t1 - t0)
            segments.append(F.struct(F.lit(upto / sum(areas)).alias("at"), F.lit(t0).alias("t"), F.lit(w0).alias("w"), F.lit(slope).alias("slope")))
            upto += area
        segment = F.element_at(F.filter(F.array(*segments), lambda s: s["at"] <= demand), -1)
        need = (demand - segment["at"]) * sum(areas)
        root = F.sqrt(F.greatest(F.lit(0.0), segment["w"] * segment["w"] + 2 * segment["slope"] * need))
        time = segment["t"] + F.coalesce(F.try_divide(2 * need, segment["w"] + root), F.lit(0.0))
        out = F.when(place == i, time).otherwise(out)
    return out


def plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = (),
         cap: float = 2.0, **options) -> DataFrame:
    """One row per document: ``key``, the columns ``keep``, size, source_size, target, and ``positions``, the training
    positions of its copies (none where it is not taken).

    Only these narrow columns are moved. Documents stand in the order of a digest of key and text, so that reruns and other
    layouts give the same mix; rows alike in both are interchangeable. A text without words is taken at no cost; where all
    of a source is empty its target is 0 and nothing of it is taken.
    """
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text).cast("binary"))).cast("binary"))
    # Names of its own for all that comes along, so that no column of ``df`` meets one that is made here.
    own = ["key", *(f"keep{i}" for i in range(len(keep)))]
    narrow = staged(df.select(*(F.col(c).alias(o) for c, o in zip([key, *keep], own, strict=True)), F.col(source).alias("from"),
                              size_in_words(text).alias("size"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("hash")))
    targets = source_targets(narrow, "from", "size", cap=cap, **options)
    placed = running_sums(narrow, "from", ["hash", "key", "size"], "size", "before").join(
        targets, F.col("from").eqNullSafe(F.col("source")))
    half = F.col("before") + F.col("size") / 2

    def share(k: Column) -> Column:
        return F.try_divide(k * F.col("source_size") + half, F.col("target"))

    passes = F.sequence(F.lit(0), F.lit(int(cap) - 1))
    taken = F.filter(F.transform(passes, share), lambda x: x < 1)
    out = placed.withColumn("shares", taken).withColumn("positions", F.transform("shares", lambda x: time_of(x, F.col("place"))))
    return out.select(*(F.col(o).alias(c) for c, o in zip([key, *keep], own, strict=True)), "size", "source_size", "target", "positions")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``df`` with all their columns, each as often as it is taken, sorted over the whole table by training position.

    Rows are told apart by their file and their place in it, or, where ``df`` does not come straight from files, by a number
    given to them in a staged copy.
    """
    columns = df.columns
    file, row, position = fresh(df, "_file", "_row", "_position").values()
    try:
        rows = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
        rows.schema  # noqa: B018  resolves the names
    except AnalysisException:
        rows = staged(df.select("*", F.lit("").alias(file), F.monotonically_increasing_id().alias(row)))
    copies = (plan(rows, key, text, source, keep=[file, row], **options)
              .select(F.col(file), F.col(row), F.explode("positions").alias(position)))
    return (rows.join(copies, [file, row]).repartitionByRange(position, row).sortWithinPartitions(position, row)
            .select(*columns))
