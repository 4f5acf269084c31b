"""Row numbers and running sums over a whole table, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge.session import staged

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number in the partition below


def in_chunks(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, str, str]:
    """``df`` sorted by ``order`` over the whole table, staged, with two more columns, whose names are returned: the chunk
    (ascending) and the row number in its chunk, from 0.

    A chunk is one range partition. Ties are dealt out by their place in the input, so that a value held by a third of
    all rows fills many chunks; rows that tie are in no defined order.
    """
    tie, number, chunk, at = fresh(df, "_tie", "_id", "_chunk", "_at").values()
    key = [F.col(c).asc_nulls_last() for c in order]
    spread = df.withColumn(tie, F.monotonically_increasing_id())
    sorted_ = spread.repartitionByRange(*key, F.col(tie)).sortWithinPartitions(*key, tie)
    numbered = sorted_.withColumn(number, F.monotonically_increasing_id())
    return staged(numbered.select(*df.columns, F.shiftright(number, _ROW_BITS).alias(chunk),
                                  F.col(number).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias(at))), chunk, at


def row_numbers(df: DataFrame, order: Sequence[str], number: str) -> DataFrame:
    """``df`` with its gapless row number from 0 in the order of ``order``, as a new column. What is summed up in one task is one
    row per chunk."""
    chunks, chunk, at = in_chunks(df, order)
    rows, start = fresh(chunks, "_n", "_start").values()
    before = Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = (chunks.groupBy(chunk).agg(F.count("*").alias(rows))
              .select(chunk, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(start)))
    return chunks.join(starts, chunk).select(*df.columns, (F.col(start) + F.col(at)).alias(number))


def running_sums(df: DataFrame, group: str, order: Sequence[str], value: str, before: str) -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over the rows of its group that precede it in ``order``, as a new column.

    ``group`` may be null (a group of its own). A group of any size is summed chunk by chunk; only one total per chunk
    and group meets in one task.
    """
    chunks, chunk, at = in_chunks(df, [group, *order])
    null, key, inner, total, offset = fresh(chunks, "_null", "_key", "_inner", "_total", "_offset").values()
    chunks = chunks.select("*", F.col(group).isNull().alias(null), F.coalesce(F.col(group).cast("string"), F.lit("")).alias(key))
    within = Window.partitionBy(chunk, null, key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(null, key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = (chunks.groupBy(null, key, chunk).agg(F.sum(value).alias(total))
              .select(null, key, chunk, F.coalesce(F.sum(total).over(across), F.lit(0)).alias(offset)))
    return (chunks.withColumn(inner, F.coalesce(F.sum(value).over(within), F.lit(0))).join(totals, [chunk, null, key])
            .select(*df.columns, (F.col(offset) + F.col(inner)).alias(before)))


def scalar(df: DataFrame) -> tuple:
    """The only row of an aggregate without keys."""
    return tuple(df.first())


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name one that no column of ``df`` has, upper or lower case alike."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        new = name
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        out[name] = new
    return out


def text_of(column: str | Column) -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
