"""Text scoring: a lexicon scorer of native expressions, and the plug for a model.

Both add ``sentiment_label``, ``sentiment_score`` (-1..1) and ``confidence`` (0..1); blank text is neutral, 0, 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsgauge.functions import vocab
from newsgauge.functions.labels import signed_score

# (texts) -> (label, confidence) per text.
Scorer = Callable[[list[str]], list[tuple[str, float]]]


def words(text: Column) -> Column:
    """Lower-case words: maximal runs of letters; an empty word may stand at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")


def lexicon_score(df: DataFrame, text: str, positive: Sequence[str] = tuple(vocab.POSITIVE_WORDS),
                  negative: Sequence[str] = tuple(vocab.NEGATIVE_WORDS)) -> DataFrame:
    """Share by which one kind of word outweighs the other is the confidence, the heavier kind the label.

    Native expressions over the whole text, without a Python worker.
    """
    tokens = words(F.col(text))
    out = df.withColumn("_w", tokens)
    out = out.withColumns({"_p": F.size(F.filter("_w", lambda w: w.isin(list(positive)))),
                           "_n": F.size(F.filter("_w", lambda w: w.isin(list(negative))))})
    label = F.when(F.col("_p") > F.col("_n"), "positive").when(F.col("_p") < F.col("_n"), "negative").otherwise("neutral")
    confidence = F.when(F.col("_p") + F.col("_n") > 0, F.abs(F.col("_p") - F.col("_n")) / (F.col("_p") + F.col("_n"))).otherwise(F.lit(0.0))
    out = out.withColumns({"sentiment_label": label, "confidence": confidence})
    return out.withColumn("sentiment_score", signed_score("sentiment_label", "confidence")).drop("_w", "_p", "_n")


def model_score(df: DataFrame, text: str, load: Callable[[], Scorer], max_chars: int | None = None, batch: int = 64) -> DataFrame:
    """Scores by a model: ``load`` runs once per Python worker task and returns the scorer.

    Texts reach the worker in Arrow batches. Longer texts than ``max_chars`` are scored in pieces of that size and
    the piece scores averaged by length, so that no text is cut. A batch the scorer cannot handle is tried text by
    text; a text it fails on is neutral, 0, 0, and ``scoring_failed``.
    """
    fields = [T.StructField("sentiment_label", T.StringType()), T.StructField("sentiment_score", T.DoubleType()),
              T.StructField("confidence", T.DoubleType()), T.StructField("scoring_failed", T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for frame in batches:
            scored = score_batch(scorer, list(frame[text]), max_chars, batch)
            frame = frame.copy()
            for i, field in enumerate(fields):
                frame[field.name] = [s[i] for s in scored]
            yield frame

    return df.mapInPandas(run, schema)


def score_batch(scorer: Scorer, texts: list, max_chars: int | None, batch: int) -> list[tuple[str, float, float, bool]]:
    """(label, score, confidence, failed) per text; pieces of all texts share the scorer's batches."""
    sign = {"positive": 1.0, "negative": -1.0}
    pieces: list[tuple[int, str]] = []
    for i, value in enumerate(texts):
        if isinstance(value, str) and value.strip():
            step = max_chars or len(value)
            pieces += [(i, value[k:k + step]) for k in range(0, len(value), step)]
    found: dict[int, list[tuple[str, float, int]]] = {}
    failed: set[int] = set()
    for start in range(0, len(pieces), batch):
        part = pieces[start:start + batch]
        for (i, piece), (label, confidence, error) in zip(part, _safe(scorer, [p for _, p in part])):
            failed.update([i] if error else [])
            found.setdefault(i, []).append((label.lower(), float(confidence), len(piece)))
    out = []
    for i in range(len(texts)):
        got = found.get(i, [])
        if len(got) > 1:
            score = sum(sign.get(label, 0.0) * c * n for label, c, n in got) / sum(n for _, _, n in got)
            out.append(("positive" if score > 0 else "negative" if score < 0 else "neutral", score, abs(score), i in failed))
        elif got:
            label, confidence, _ = got[0]
            out.append((label, sign.get(label, 0.0) * confidence, confidence, i in failed))
        else:
            out.append(("neutral", 0.0, 0.0, False))
    return out


def _safe(scorer: Scorer, texts: list[str]) -> list[tuple[str, float, bool]]:
    try:
        return [(label, confidence, False) for label, confidence in scorer(texts)]
    except Exception:
        if len(texts) == 1:
            return [("neutral", 0.0, True)]
        return [r for t in texts for r in _safe(scorer, [t])]
