"""Quality classifier by co-training.

Two views of a document have a naive Bayes classifier each: its text (hashed byte trigrams, and the shape of its wording) and
its page metadata (source, language, length, layout). Both learn from a bounded labelled sample. In every round each view
scores all unlabelled documents, and what it is confident of becomes a pseudo-label for the other view. The layout (lines and
their length) is counted from the text, so the views share that much evidence; words and marks are the text's alone. The views are
calibrated on labelled documents held back from the fit, and their calibrated odds combine to the score of a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from newsgauge.llm import bytewords
from newsgauge.llm.ordering import fresh
from newsgauge.session import drop_staged, staged

GRAMS = 1 << 13
_SHAPE_BINS, _SHAPES = 24, 4
_SOURCES, _LANGS, _BINS = 512, 64, 48
_META = _SOURCES + _LANGS + 3 * _BINS
_UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _code(value: str | None, size: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode()) % (size - 1)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for a share of nothing, else finer steps for smaller shares, up to the number of bins."""
    x = part / np.maximum(whole, 1)
    return np.minimum(np.ceil(_SHAPE_BINS / 12 * np.log2(1 + 1000 * x)), _SHAPE_BINS - 1).astype(np.int64)


def _per(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


@dataclass
class Features:
    """Of a block of texts: shares of trigrams (rows sum to 1, or 0 for a text under three bytes), and the cells that
    are set among the shape and the metadata cells."""

    grams: np.ndarray
    shape: np.ndarray
    meta: np.ndarray


def features(texts: pa.Array, sources: list, langs: list, sizes: np.ndarray, most: int = 128) -> Iterator[Features]:
    at = 0
    for group in bytewords.groups(texts):
        starts, ends, n = group.words()
        hashes = group.span_hashes(starts, ends)
        of = np.repeat(np.arange(group.n, dtype=np.uint64), n)
        first = np.unique(bytewords.mix(hashes ^ bytewords.mix(of + np.uint64(1))), return_index=True)[1]
        distinct = np.bincount(of[first].astype(np.int64), minlength=group.n)
        length = np.diff(group.edges)
        lines = _per(group.data == 10, group.edges) + 1
        shape = np.stack([_share(n - distinct, n), _share(_per(_UPPER[group.data], group.edges), length),
                          _share(_per(_MARK[group.data], group.edges), length), _share(_per(group.data >= 128, group.edges), length)], 1)
        shape += np.arange(_SHAPES) * _SHAPE_BINS
        log = lambda x: np.minimum(2 * np.log2(1 + np.maximum(x, 0)), _BINS - 1).astype(np.int64)
        own = slice(at, at + group.n)
        meta = np.stack([np.array([_code(x, _SOURCES) for x in sources[own]], np.int64),
                         _SOURCES + np.array([_code(x, _LANGS) for x in langs[own]], np.int64), _SOURCES + _LANGS + log(sizes[own]),
                         _SOURCES + _LANGS + _BINS + log(lines), _SOURCES + _LANGS + 2 * _BINS + log(length / lines)], 1)
        at += group.n
        for low in range(0, group.n, most):
            high = min(low + most, group.n)
            a, b = group.edges[low], group.edges[high]
            part, row = group.data[a:b].astype(np.uint32), np.repeat(np.arange(high - low) * GRAMS, length[low:high])
            block = np.zeros((high - low) * GRAMS, np.float32)
            if len(part) > 2:
                gram = ((part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]) * np.uint32(2654435769) >> np.uint32(19)
                whole = row[:-2] == row[2:]
                block = np.log1p(np.bincount(row[:-2][whole] + gram[whole].astype(np.int64), minlength=len(block)).astype(np.float32))
            block = block.reshape(high - low, GRAMS)
            yield Features(block / np.maximum(block.sum(1, keepdims=True), 1e-9), shape[low:high], meta[low:high])


class Counts:
    """What a view has seen of each class (0, 1): feature sums, and documents."""

    def __init__(self):
        self.grams, self.shape, self.meta = np.zeros((2, GRAMS)), np.zeros((2, _SHAPES * _SHAPE_BINS)), np.zeros((2, _META))
        self.texts, self.pages = np.zeros(2), np.zeros(2)

    def add_text(self, f: Features, label: int, rows: np.ndarray) -> None:
        self.grams[label] += f.grams[rows].sum(0)
        np.add.at(self.shape[label], f.shape[rows].ravel(), 1)
        self.texts[label] += rows.sum()

    def add_meta(self, f: Features, label: int, rows: np.ndarray) -> None:
        np.add.at(self.meta[label], f.meta[rows].ravel(), 1)
        self.pages[label] += rows.sum()

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.grams, self.shape, self.meta, self.texts, self.pages)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Counts:
        out, at = cls(), 0
        for x in (out.grams, out.shape, out.meta, out.texts, out.pages):
            x[...] = flat[at:at + x.size].reshape(x.shape)
            at += x.size
        return out


@dataclass
class Model:
    """Log-odds weights, and the calibration: a bias and a factor for each of a view's scores. ``prior`` is the share of
    class 1; without both classes nothing else is used."""

    prior: float
    usable: bool
    grams: np.ndarray
    shape: np.ndarray
    meta: np.ndarray
    text_fit: np.ndarray
    meta_fit: np.ndarray

    @classmethod
    def of(cls, c: Counts, prior: float, usable: bool) -> Model:
        odds = lambda x, smooth: np.diff(np.log((x + smooth) / (x + smooth).sum(1, keepdims=True)), axis=0)[0]
        return cls(prior, usable, odds(c.grams, 0.01), odds(c.shape, 1.0), odds(c.meta, 1.0), np.zeros(3), np.zeros(2))

    def scores(self, f: Features) -> np.ndarray:
        """Raw scores: trigrams, shape, metadata."""
        return np.stack([f.grams @ self.grams, self.shape[f.shape].sum(1), self.meta[f.meta].sum(1)], 1)

    def calibrated(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of class 1 by the text, by the metadata, and by both."""
        if not self.usable:
            same = np.full(len(raw), self.prior)
            return same, same, same
        text = self.text_fit[0] + raw[:, :2] @ self.text_fit[1:]
        meta = self.meta_fit[0] + raw[:, 2] * self.meta_fit[1]
        sure = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return sure(text), sure(meta), sure(text + meta - np.log(self.prior / (1 - self.prior)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression with a bias, by Newton steps; the bias is not held back."""
    scale = np.maximum(x.std(0), 1e-9)
    z = np.concatenate([np.ones((len(x), 1)), x / scale], 1)
    w, hold = np.zeros(z.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (p - y) + hold @ w)
    return np.concatenate([w[:1], w[1:] / scale])


def _views(batch: pa.RecordBatch) -> Iterator[Features]:
    sizes = np.nan_to_num(np.array(batch.column(3).cast(pa.float64()).to_numpy(zero_copy_only=False)))
    return features(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sizes)


def _rows(held: Counts) -> pa.RecordBatch:
    flat = held.flat()
    at = np.flatnonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.float64())], names=["cell", "x"])


def _summed(rows: DataFrame) -> Counts:
    flat = np.zeros(len(Counts().flat()))
    for r in rows.groupBy("cell").agg(F.sum("x").alias("x")).collect():  # one row per cell at most
        flat[r["cell"]] = r["x"]
    return Counts.of(flat)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
        size: str = "n_chars", label: str = "quality", most_labelled: int = 20_000, rounds: int = 2, confident: float = 0.95) -> Model:
    """The model after ``rounds`` exchanges of pseudo-labels over all of ``df``.

    At most ``most_labelled`` labelled documents are used, chosen by a hash of the key; a quarter of them calibrates. A key
    labelled more than once takes its mean label, 0.5 counting as good; null keys and labels are not used. All other
    documents are scored in every round. A labelled key that several rows have gives one of them, by hash. What a task or the driver
    holds are sums for some 9,000 cells, and three scores for each of the labelled documents held back.
    """
    votes = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key"))
             .agg((F.avg(label) >= 0.5).cast("int").alias("label")))
    sample = staged(votes.orderBy(F.xxhash64("key"), "key").limit(most_labelled)
                    .withColumn("held", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(4)) == 0))
    view = [F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(size).cast("double").alias("size")]
    known = F.broadcast(sample)  # at most most_labelled rows of 13 bytes
    docs = df.select(F.col(key).alias("key"), *view)
    # One row for each labelled key, that with the smallest hash, however often the key is repeated.
    picked = F.min_by(F.struct("text", "source", "lang", "size", "label", "held"), F.xxhash64("text", "source", "lang", "size")).alias("x")
    labelled = staged(docs.join(known, "key").groupBy("key").agg(picked).select("x.*"))
    others = docs.join(known, "key", "left_anti").select("text", "source", "lang", "size")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for batch in batches:
            y, at = batch.column(4).to_numpy(), 0
            for f in _views(batch):
                own = y[at:at + len(f.meta)]
                at += len(f.meta)
                for k in (0, 1):
                    held.add_text(f, k, own == k)
                    held.add_meta(f, k, own == k)
        yield _rows(held)

    base = _summed(labelled.where(~F.col("held")).mapInArrow(learn, "cell int, x double"))
    held_back = labelled.where("held")
    total = base.texts.sum()
    usable = bool(total and base.texts.min() > 0)
    prior = float(np.clip(base.texts[1] / total, 0.01, 0.99)) if usable else float(base.texts[1] / total) if total else 0.5

    def calibrate(model: Model) -> Model:
        def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [model.scores(f) for f in _views(batch)]
                if parts:
                    x = np.concatenate(parts)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i], pa.float64()) for i in range(3)), batch.column(4)], names=["a", "b", "c", "y"])

        rows = np.array([tuple(r) for r in held_back.mapInArrow(raw, "a double, b double, c double, y int").collect()]).reshape(-1, 4)
        if not len(set(rows[:, 3])) == 2:
            model.usable = False
            return model
        model.text_fit, model.meta_fit = _logistic(rows[:, :2], rows[:, 3]), _logistic(rows[:, 2:3], rows[:, 3])
        return model

    model = Model.of(base, prior, usable)
    if usable:
        model = calibrate(model)
    for _ in range(rounds if model.usable else 0):
        now = model

        def exchange(batches: Iterator[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            held = Counts()
            for batch in batches:
                for f in _views(batch):
                    by_text, by_meta, _ = now.calibrated(now.scores(f))
                    for k, sure in ((1, lambda p: p >= confident), (0, lambda p: p <= 1 - confident)):
                        held.add_text(f, k, sure(by_meta))
                        held.add_meta(f, k, sure(by_text))
            yield _rows(held)

        more = _summed(others.mapInArrow(exchange, "cell int, x double"))
        model = calibrate(Model.of(Counts.of(base.flat() + more.flat()), prior, True))
    drop_staged(sample, labelled)
    return model


def predict(model: Model, text: str = "text", source: str = "source", lang: str = "lang", size: str = "n_chars") -> Column:
    """A struct of text_prob, meta_prob and score, the probabilities of good quality by each view and by both, for every whole
    text. A null text counts as empty, null metadata as a value of its own."""
    @arrow_udf("struct<text_prob:double,meta_prob:double,score:double>")
    def score(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts, sources, langs, sizes], names=["t", "s", "l", "n"])
        parts = [model.calibrated(model.scores(f)) for f in _views(batch)]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 3
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in columns], names=["text_prob", "meta_prob", "score"])

    return score(F.col(text), F.col(source).cast("string"), F.col(lang).cast("string"), F.col(size).cast("double"))


def classify(df: DataFrame, model: Model, into: str = "quality", least: float = 0.5, **columns) -> DataFrame:
    """``df`` with the struct of :func:`predict` and ``kept``, whether the score is at least ``least``, as column ``into``."""
    name = fresh(df, "_p")["_p"]
    named = df.withColumn(name, predict(model, **columns))
    fields = [F.col(name)[c].alias(c) for c in ("text_prob", "meta_prob", "score")]
    return named.withColumn(into, F.struct(*fields, (F.col(name)["score"] >= least).alias("kept"))).drop(name)
