"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed letter n-grams (two and three bytes, ASCII lower-cased, everything but letters one
blank), of length one. Each language has a few centroids, found by spherical k-means among a bounded sample of its
texts. A text takes the language of the centroid with the largest cosine; it is rejected where that cosine lies far
below what labelled texts of that language and length have, or is no better than that of shuffled letters.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from newsgauge.llm import bytewords
from newsgauge.session import drop_staged, staged

UNDETERMINED = "und"
DIMENSIONS = 1 << 12
_MAX_BUCKET = 40
#: Cosines are counted in so many steps. Heads of texts stand for the lengths of these buckets.
_STEPS = 256
_HEADS = range(4, 14)
_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


@dataclass
class Model:
    """``languages[i]`` is the language of row i of ``centroids``; ``lowest[i, b]`` the least cosine with it accepted for a text
    with some 2**b n-grams."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    lowest: np.ndarray


def counts(texts: bytewords.Texts, most: int = 128) -> Iterator[np.ndarray]:
    """Blocks of at most ``most`` rows: the n-gram counts of each text, one column per hashed n-gram."""
    data = _KEEP[texts.data].astype(np.uint32)
    for low in range(0, texts.n, most):
        high = min(low + most, texts.n)
        a, b = texts.edges[low], texts.edges[high]
        part, edges = data[a:b], texts.edges[low:high + 1] - a
        row = np.repeat(np.arange(high - low, dtype=np.int64) * DIMENSIONS, np.diff(edges))
        block = np.zeros((high - low) * DIMENSIONS, np.int64)
        for size, factor in ((2, 2654435769), (3, 2246822519)):
            if len(part) < size:
                continue
            gram = part[:len(part) - size + 1].copy()
            for k in range(1, size):
                gram = (gram << np.uint32(8)) | part[k:len(part) - size + 1 + k]
            whole = row[:len(gram)] == row[size - 1:]
            whole &= gram != np.uint32(0x20202020 >> (32 - 8 * size))
            at = row[:len(gram)] + ((gram * np.uint32(factor)) >> np.uint32(20)).astype(np.int64)
            block += np.bincount(at[whole], minlength=len(block))
        yield block.reshape(high - low, DIMENSIONS)


def _vectors(block: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(block.astype(np.float32)) * idf
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(length, 1e-12)


def _bucket(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64), _MAX_BUCKET)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1500,
        clusters: int = 4, most_languages: int = 1000, spread: float = 6.0, seed: int = 1) -> Model:
    """The model of ``labelled``. Rows without text or language are not used.

    Document frequencies are counted over all usable rows. The sample for the centroids is bounded: some ``per_language``
    different texts (at most twice as many) of each of the ``most_languages`` most frequent languages, chosen by a hash of
    ``key`` and text, whole texts each; repeated rows count once there. The model holds at most ``most_languages * clusters`` centroids of
    16 KB. Without a usable row the model is empty.

    The bounds of rejection are taken from all usable rows of these languages, whole texts and for short lengths a head of
    each, by language and length. A cosine is too low if it is both more than ``spread`` deviations (by the median deviation)
    below the median and lower than those of 995 in 1,000 texts, or if it is lower than those of 19 in 20 heads with
    their characters shuffled, though not for that where it is within half of ``spread`` deviations of the median. Lengths
    with fewer than 30 texts (200 for the quantile) take the bound of the next shorter one; texts of under 16 n-grams are not rejected by cosine.
    """
    usable = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, text, F.lit(seed)).alias("pick"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not sizes:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(DIMENSIONS, np.float32), np.zeros((0, _MAX_BUCKET + 1)))
    share = F.create_map(*[F.lit(x) for pair in ((k, min(1.0, per_language / n)) for k, n in sizes.items()) for x in pair])
    # Copies share a hash: one of them is taken, and of what is left no more than the bound, in the order of the hash.
    first = Window.partitionBy("lang").orderBy("pick")
    sample = staged(usable.where(F.pmod("pick", F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))
                    .dropDuplicates(["lang", "pick"]).withColumn("place", F.row_number().over(first))
                    .where(F.col("place") <= 2 * per_language).select("text", "lang", "pick"))

    def documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for group in bytewords.groups(batch.column(0)):
                for block in counts(group):
                    seen += (block > 0).sum(0)
                    n += len(block)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *seen[at].tolist()], pa.int64())],
                                         names=["gram", "n"])

    found = {r["gram"]: r["n"] for r in usable.select("text").mapInArrow(documents_with, "gram int, n bigint")
             .groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    total = found.pop(-1, 0)
    idf = np.full(DIMENSIONS, math.log(1 + total) + 1, np.float32)  # what no text has is the surest sign of unlearned text
    for gram, n in found.items():
        idf[gram] = math.log((1 + total) / (1 + n)) + 1

    def of_language(table: pa.Table) -> pa.Table:
        table = table.sort_by("pick")
        x = np.concatenate([_vectors(b, idf)[b.any(1)] for group in bytewords.groups(table.column("text")) for b in counts(group)])
        return pa.table({"lang": table.column("lang")[:1].cast(pa.string()).combine_chunks(),
                         "centroids": pa.array([_spherical_means(x, clusters).astype(np.float32).tobytes()], pa.binary())})

    rows = sorted(sample.groupBy("lang").applyInArrow(of_language, "lang string, centroids binary").collect(), key=lambda r: r["lang"])
    drop_staged(sample)
    parts = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMENSIONS) for r in rows]
    model = Model([r["lang"] for r, p in zip(rows, parts, strict=True) for _ in p], np.concatenate(parts), idf,
                  np.zeros((sum(map(len, parts)), _MAX_BUCKET + 1)))
    if model.languages:
        model.lowest = _bounds(usable.where(F.col("lang").isin(sorted(sizes))).select("text", "lang"), model, spread)
    return model


def _head(text: str) -> tuple[str, str] | None:
    """The beginning of a text, of a length that a hash of the text picks, and its characters shuffled."""
    pick = zlib.crc32(text[:4096].encode("utf-8", "replace"))
    n = 3 * (1 << _HEADS[pick % len(_HEADS)]) // 4
    if len(text) < n:
        return None
    letters = np.frombuffer(text[:n].encode("utf-32-le"), "<u4")
    return text[:n], np.random.default_rng(pick).permutation(letters).tobytes().decode("utf-32-le")


def _bounds(usable: DataFrame, model: Model, spread: float) -> np.ndarray:
    """``lowest`` of the model: cosines counted in one pass over ``usable`` (text, lang)."""
    names = sorted(set(model.languages))
    number = {x: i for i, x in enumerate(names)}
    owner = np.array([number[x] for x in model.languages])
    centroids, idf = np.ascontiguousarray(model.centroids.T), model.idf

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def add(texts: pa.Array, own: np.ndarray) -> None:
            at = 0
            for group in bytewords.groups(texts) if len(texts) else ():
                for block in counts(group):
                    lang, total = own[at:at + len(block)], block.sum(1)
                    at += len(block)
                    cosine = _vectors(block, idf) @ centroids
                    mine = np.where((owner == lang[:, None]) | (lang[:, None] < 0), cosine, -1.0).max(1)
                    step = np.clip(mine * _STEPS, 0, _STEPS - 1).astype(np.int64)
                    cell = ((lang + 1) * (_MAX_BUCKET + 1) + _bucket(total)) * _STEPS + step
                    seen.update(dict(zip(*(x.tolist() for x in np.unique(cell[total > 0], return_counts=True)), strict=True)))

        for batch in (b.slice(k, 256) for b in batches for k in range(0, len(b), 256)):  # no copy of a whole batch
            own = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            known = own >= 0
            add(batch.column(0).filter(pa.array(known)), own[known])
            heads = [(k, h) for k, x in enumerate(batch.column(0)) if known[k] for h in [_head(x.as_py())] if h]
            add(pa.array([h[0] for _, h in heads], pa.string()), own[[k for k, _ in heads]])
            add(pa.array([h[1] for _, h in heads], pa.string()), np.full(len(heads), -1))
        at = np.array(list(seen), np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(at // _STEPS // (_MAX_BUCKET + 1) - 1, pa.int32()), pa.array(at // _STEPS % (_MAX_BUCKET + 1), pa.int32()),
            pa.array(at % _STEPS, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["lang", "bucket", "step", "n"])

    def quantiles(table: pa.Table) -> pa.Table:
        table = table.sort_by("step")
        step, n = (table.column(c).to_numpy() for c in ("step", "n"))
        total = n.sum()

        def at(x: np.ndarray, share: float) -> float:
            order = np.argsort(x, kind="stable")
            return float(x[order][np.searchsorted(np.cumsum(n[order]), share * total)])

        median = at(step, 0.5)
        deviation = 1.4826 * (at(np.abs(step - median), 0.5) + 0.5)
        low = min(at(step, 0.005), median - spread * deviation)
        return pa.table({"lang": table.column("lang")[:1], "bucket": table.column("bucket")[:1], "n": [total],
                         "usual": [(median - spread / 2 * deviation) / _STEPS], "low": [low / _STEPS], "high": [(at(step, 0.95) + 1) / _STEPS]})

    found = {(r["lang"], r["bucket"]): r for r in usable.mapInArrow(cosines, "lang int, bucket int, step int, n bigint")
             .groupBy("lang", "bucket", "step").agg(F.sum("n").alias("n")).groupBy("lang", "bucket")
             .applyInArrow(quantiles, "lang int, bucket int, n bigint, usual double, low double, high double").collect() if r["n"] >= 30}
    lowest = np.zeros((len(owner), _MAX_BUCKET + 1))
    for i in range(len(names)):
        own, sure, shuffled = None, None, None
        for b in range(_HEADS[0], _MAX_BUCKET + 1):
            own, shuffled = found.get((i, b), own), found.get((-1, b), shuffled)
            sure = own if own and own["n"] >= 200 else sure  # of fewer texts there is no such quantile
            low = sure["low"] if sure else 0.0
            if shuffled:
                low = max(low, min(shuffled["high"], own["usual"] if own else 1.0))
            lowest[owner == i, b] = low
    return lowest


def _spherical_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most ``k`` centroids of unit rows: seeds far from each other and in dense places, then alternate assignment and mean.
    Clusters of under a fiftieth of the rows are dropped, their rows being those that are like few others."""
    if not len(x):
        return np.zeros((0, DIMENSIONS), np.float32)
    around = min(len(x) - 1, max(2, len(x) // 50))
    alike = x @ x.T
    density = np.partition(alike, len(x) - 1 - around, axis=1)[:, len(x) - 1 - around]
    seeds = [int(density.argmax())]
    for _ in range(min(k, len(x)) - 1):
        seeds.append(int((density * (1 - alike[:, seeds].max(1))).argmax()))
    centroids = x[seeds]
    for _ in range(rounds):
        centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        own = (x @ centroids.T).argmax(1)
        centroids = np.stack([x[own == j].mean(0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
    size = np.bincount(own, minlength=len(centroids))
    centroids = centroids[size >= min(size.max(), max(2, len(x) / 50))]
    return centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)


def predict(model: Model, text: str = "text") -> Column:
    """A struct of ``lang_pred``, ``score`` (the largest cosine, 0 to 1) and ``rejected`` for every whole text.

    A null text or one without a letter has language ``und``, score 0 and is rejected; with an empty model, every text.
    """
    languages, centroids = np.array(model.languages, object), np.ascontiguousarray(model.centroids.T)
    idf, lowest = model.idf, model.lowest

    @arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def nearest(column: pa.Array) -> pa.Array:
        best, score, low = [], [], []
        for group in bytewords.groups(column):
            for block in counts(group):
                cosine = _vectors(block, idf) @ centroids
                best.append(cosine.argmax(1))
                score.append(np.clip(cosine.max(1), 0, 1).astype(np.float64))
                low.append(lowest[best[-1], _bucket(block.sum(1))])
        best, score, low = (np.concatenate(x) if x else np.zeros(0, int) for x in (best, score, low))
        return pa.StructArray.from_arrays(
            [pa.array(languages[best].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(score < low, pa.bool_())],
            names=["lang_pred", "score", "rejected"])

    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if not model.languages:
        return nothing
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    answer = nearest(F.when(letters, F.col(text)))
    return F.when(letters, answer).otherwise(nothing)


def identify(df: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``df`` with the struct of :func:`predict` as column ``into``; all other columns and rows stay, null and repeated ones
    too."""
    return df.withColumn(into, predict(model, text))
