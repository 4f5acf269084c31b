"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates are dealt to blocks; in a block every dimension has a list of its vectors sorted by that component. A query walks
the lists of its non-zero dimensions from the end that its sign prefers, all to the same depth, and scores each
vector when it first meets it. What no list has shown yet scores at most the sum of the components at that depth times the
query's; the walk stops when this bound is below the kth best score, so vectors that tie with it are all seen. A score that k
vectors of the first block reach is a bound for all other blocks from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge.llm.ordering import scalar
from newsgauge.session import staged

def quantised(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) of each component, a whole number as double; null for a vector that is null, empty or has a component
    that is null or, itself or scaled, not finite."""
    scaled = F.transform(F.col(vector), lambda c: F.lit(float(scale)) * c.cast("double"))
    bad = F.exists(scaled, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # Beyond 2**52 a double is whole, and a long, which floor() gives, would not hold the largest.
    whole = lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c)
    return F.when((F.size(F.col(vector)) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(scaled, whole))


def _matrix(table: pa.Table, name: str, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one is filled up with zeros."""
    column = table.column(name).combine_chunks()
    flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class _Scores:
    """Exact inner products of the rows of ``x`` with one vector after the other.

    In doubles where no sum can leave their whole numbers, else in longs where none can leave these, else in Python's whole
    numbers; a score beyond a long is an error.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.largest = x, float(np.abs(x).max(initial=0))
        self.sizes = np.abs(x).max(1, initial=0)
        self.longs = self.last = None

    def of(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        most = float(np.abs(q).sum())
        if self.largest * most < 2.0**52:
            if 4 * len(rows) > len(self.x) and self.last is not q:  # kept for the rest of the query's walk
                self.last, self.all = q, (self.x @ q).astype(np.int64)
            return self.all[rows] if self.last is q else (self.x[rows] @ q).astype(np.int64)
        if self.longs is None:
            self.longs = np.where(np.abs(self.x) < 2.0**62, self.x, 0).astype(np.int64)
        fits = self.sizes[rows] * most < 2.0**62
        out = np.zeros(len(rows), np.int64)
        if fits.any():
            out[fits] = self.longs[rows[fits]] @ np.where(np.abs(q) < 2.0**62, q, 0).astype(np.int64)
        whole = [int(v) for v in q]
        for k in np.flatnonzero(~fits):
            score = sum(int(v) * w for v, w in zip(self.x[rows[k]], whole, strict=True))
            if not -(1 << 63) <= score < 1 << 63:
                raise OverflowError(f"a score of {score} does not fit into a long")
            out[k] = score
        return out


def threshold_search(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int,
                     least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query the places and scores of its k best rows of ``x`` (ties to the smaller id; its own row left out), and how many
    were scored. Scores below ``least``, which k others are known to reach, need not be among them."""
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
    ranked = np.take_along_axis(x.T, order, 1)
    scores = _Scores(x)
    seen = np.zeros(n, bool)
    for i, q in enumerate(queries):
        used = np.flatnonzero(q)
        up, down = used[q[used] > 0], used[q[used] < 0]
        seen[:] = False
        found, held = [], []
        kept = np.zeros(0, np.int64)
        depth, left, done = 0, n, False
        while not done:
            to = min(n, max(k, 64) if not depth else 4 * depth)
            new = np.zeros(n, bool)
            if 16 * left >= n:
                new[order[up, n - to:n - depth]] = True
                new[order[down, depth:to]] = True
            if not len(used) or 16 * left < n:  # the lists end here: the last few are scored as they are
                new[:] = True
                to = n
            new &= ~seen
            seen |= new
            place = np.flatnonzero(new)
            left -= len(place)
            place = place[rows[place] != query_rows[i]]
            score = scores.of(place, q)
            found.append(place)
            held.append(score)
            kept = np.concatenate([kept, score])
            kept = np.sort(np.partition(kept, len(kept) - k)[-k:] if len(kept) > k else kept)
            depth = to
            ends = np.concatenate([ranked[up, n - depth], ranked[down, depth - 1]])
            terms = ends * np.concatenate([q[up], q[down]])
            bound = terms.sum() + 1e-12 * np.abs(terms).sum()  # never below the true sum
            done = not left or least[i] > bound or (len(kept) >= k and kept[0] > bound)
        place, score = np.concatenate(found), np.concatenate(held)
        scored = len(place)
        if scored > k:  # only what reaches the kth score is put in order
            high = score >= kept[0]
            place, score = place[high], score[high]
        best = np.lexsort((ids[place], -score))[:k]
        yield i, place[best], score[best], scored


def top_k(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64,
          block_rows: int = 16_384, query_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of every row that fulfils ``queries``, against every row but
    itself.

    Vectors that :func:`quantised` refuses and rows without key take no part; shorter vectors count as filled up with zeros.
    A key that occurs twice is two candidates and two queries, told apart by ``query_row`` (a number without meaning), and
    each is a candidate of the other. Blocks of candidates meet blocks of queries, each pair in a task's group of bounded
    size. The first block of candidates is searched before the others; the kth score that a query has there is the bound that all
    other blocks begin with. Then the k best of a query are ranked among at most k per block.
    """
    lowest = -(1 << 63)
    rows = staged(df.select(F.col(key).cast("bigint").alias("id"), quantised(vector, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
                  .where(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("row", F.monotonically_increasing_id()))
    n, asked, width = scalar(rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))))
    blocks = max(1, -(-n // block_rows))
    # Few queries are still cut into enough parts for all cores, at the price of copies of few candidates.
    threads = df.sparkSession.sparkContext.defaultParallelism
    asking = max(1, -(-asked // query_rows), min(-(-asked // 256), -(-2 * threads // blocks)))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(asking)).cast("int")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64),) * 5]
        if left.num_rows and right.num_rows:
            ids, own = left.column("id").to_numpy(), left.column("row").to_numpy()
            query_ids, query_own, least = (right.column(c).to_numpy() for c in ("query_id", "query_row", "least"))
            for i, place, score, seen in threshold_search(_matrix(left, "v", width), ids, own, _matrix(right, "q", width), query_own, k, least):
                out.append((np.full(len(place), query_ids[i]), np.full(len(place), query_own[i]), ids[place], score, np.full(len(place), seen)))
        columns = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table(dict(zip(("query_id", "query_row", "vec_id", "score", "scored"), columns, strict=True)))

    def searched(candidates: DataFrame, wanted: DataFrame, here: range) -> DataFrame:
        left = candidates.select("id", "row", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("part"))
        right = wanted.select("query_id", "query_row", "q", "least", F.explode(F.array(*[F.lit(b) for b in here]) if len(here) < 2 else
                              F.sequence(F.lit(here[0]), F.lit(here[-1]))).alias("to"), "share")
        return (left.groupBy("block", "part").cogroup(right.groupBy("to", "share"))
                .applyInArrow(search, "query_id bigint, query_row bigint, vec_id bigint, score bigint, scored bigint"))

    wanted = rows.where("asks").select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), F.col("v").alias("q"),
                                       F.lit(lowest).cast("bigint").alias("least"), part.alias("share"))
    found = searched(rows.where(block == 0), wanted, range(1))
    if blocks > 1:
        found = staged(found)
        kth = (found.groupBy("query_row").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k)
               .select("query_row", "kth"))
        bounded = wanted.join(kth, "query_row", "left").withColumn("least", F.coalesce("kth", "least"))
        found = found.union(searched(rows.where(block > 0), bounded, range(1, blocks)))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")
