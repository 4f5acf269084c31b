"""Substring search by an index of three-letter grams.

A text that contains a term contains all its grams, so the items whose postings hold every gram of the term are the only
candidates, and the term is then looked for in their texts alone. Terms of fewer than three letters have no grams and are
looked for everywhere.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgauge.session import drop_staged, scratch_path, staged

GRAM = 3
#: Letters in the texts of a block, unless one text has more.
_LETTERS = 1 << 21
#: Between fields; a term that contains it is not found.
_BREAK = "\u0001"


def searchable(columns: Sequence[str | Column], tags: str | None = None) -> Column:
    """One lower-case text of all fields, in which no match runs from one field into the next."""
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]
    if tags is not None:
        parts.append(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), _BREAK))
    return F.lower(F.concat_ws(_BREAK, *parts))


def grams(text: Column) -> Column:
    """The distinct runs of three letters of a text, in one pass over its letters."""
    letters = F.split(text, "")
    last = F.size(letters) - GRAM + 1
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(letters, i, GRAM), ""))
    return F.when(F.length(text) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, text): for each block of neighbouring items a row with their ids, and one for each gram with its places among them."""
    block = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        upto = np.cumsum([len(t or "") for t in texts])
        first = 0
        while first < len(texts):
            before = int(upto[first - 1]) if first else 0
            end = max(first + 1, int(np.searchsorted(upto, before + _LETTERS, "right")))
            grams_, offsets, places = _gram_places([t or "" for t in texts[first:end]])
            own, n = ids.slice(first, end - first), len(grams_)
            yield pa.RecordBatch.from_arrays([
                pa.array([None, *grams_], pa.string()), pa.array(np.full(n + 1, block)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], offsets]), pa.int32()), pa.array(places, pa.int32())),
                pa.ListArray.from_arrays(pa.array([0] + [len(own)] * (n + 1), pa.int32()), own)], names=["gram", "block", "places", "ids"])
            block, first = block + 1, end


def _gram_places(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct grams of some texts; where the places of each begin and end; and the places, rising."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if len(letters) < GRAM:
        return [], np.zeros(1, np.int64), letters[:0]
    alphabet = np.unique(letters)
    codes, base = np.zeros(int(alphabet[-1]) + 1, np.int64), len(alphabet)
    codes[alphabet] = np.arange(base)
    codes, owner = codes[letters], np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    runs = (codes[:-2] * base + codes[1:-1]) * base + codes[2:]
    inside = owner[:-2] == owner[2:]
    runs, owner = runs[inside], owner[:-2][inside]
    named = None
    if base ** GRAM * len(texts) >= 1 << 63:  # numbers for the grams, so that a gram and a place are one number
        named, runs = np.unique(runs, return_inverse=True)
    pairs = np.sort(runs * len(texts) + owner)
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    of, places = np.divmod(pairs, len(texts))
    first = np.flatnonzero(np.diff(of, prepend=-1))
    distinct = of[first] if named is None else named[of[first]]
    spelled = alphabet[np.stack([distinct // base ** 2, distinct // base % base, distinct % base], 1)].tobytes().decode("utf-32-le", "surrogatepass")
    return [spelled[k:k + GRAM] for k in range(0, len(spelled), GRAM)], np.append(first, len(pairs)), places


class TextIndex:
    """Postings of a table of texts, in a folder, ordered by gram, so that a search reads the files and row groups of its grams
    only. Items are dealt into blocks; a posting has the places in one block of the items with a gram, and a row without a
    gram the ids of the block's items. A gram that is in most texts is a row for each block, in several files."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "grams")

    def build(self, items: DataFrame, text: Column, key: str = "id") -> None:
        kind = dict(items.dtypes)[key]
        # Written before it is sorted, so that blocks are made once: finding the ranges reads all rows.
        postings = staged(items.select(F.col(key).alias("id"), text.alias("text"))
                          .mapInArrow(_postings, f"gram string, block bigint, places array<int>, ids array<{kind}>"))
        postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(os.path.join(self.path, "postings"))
        drop_staged(postings)

    def _found(self, term: str) -> DataFrame | None:
        """As :meth:`candidates`, an id for each item."""
        term = term.lower()
        wanted = sorted({term[i:i + GRAM] for i in range(len(term) - GRAM + 1)})
        if not wanted:
            return None
        index = self.spark.read.parquet(os.path.join(self.path, "postings"))
        hits = index.where(F.col("gram").isin(wanted)).groupBy("block").agg(F.collect_list("places").alias("_all"))
        held = F.reduce(F.slice("_all", 2, len(wanted)), F.element_at("_all", 1), F.array_intersect)
        blocks = index.where(F.col("gram").isNull()).select("block", "ids")
        return (hits.where(F.size("_all") == len(wanted)).select("block", held.alias("_held")).join(blocks, "block")
                .select(F.explode(F.transform("_held", lambda i: F.get("ids", i))).alias("id")))

    def candidates(self, term: str) -> DataFrame | None:
        """Ids of the items that hold every gram of the term, each once; None for a term without grams."""
        found = self._found(term)
        return None if found is None else found.distinct()

    def search(self, items: DataFrame, text: Column, term: str, key: str = "id") -> DataFrame:
        """The items with the term in their text; ``items`` and ``text`` as they were indexed."""
        found = self._found(term)
        among = items if found is None else items.join(found.withColumnRenamed("id", key), key, "left_semi")
        return among.where(text.contains(term.lower()))
