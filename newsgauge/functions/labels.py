"""Score labels and the scores behind them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def label5(score: str | Column) -> Column:
    """Five bands over 0..1; the upper end of each band belongs to it."""
    score = _col(score)
    return (F.when(score <= 0.2, "very_negative")
            .when(score <= 0.4, "negative")
            .when(score <= 0.6, "neutral")
            .when(score <= 0.8, "positive")
            .when(score.isNotNull(), "very_positive"))


def label3(score: str | Column, cut: float = 0.1) -> Column:
    """positive above ``cut``, negative below ``-cut``, else neutral."""
    score = _col(score)
    return F.when(score > cut, "positive").when(score < -cut, "negative").otherwise("neutral")


def band_color(score: str | Column, cut: float = 0.05) -> Column:
    score = _col(score)
    return F.when(score > cut, "green").when(score < -cut, "red").otherwise("gray")


def signed_score(label: str | Column, confidence: str | Column) -> Column:
    """Class and confidence as one score in -1..1; neutral and unknown classes give 0."""
    label, confidence = F.lower(_col(label)), _col(confidence)
    raw = F.when(label == "positive", confidence).when(label == "negative", -confidence).otherwise(F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def softmax(logits: Column) -> Column:
    """Soft-max of an array, shifted by its maximum so that exp cannot overflow."""
    exps = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda x: x / total)


def softmax_score(probabilities: Column) -> Column:
    """Score of (negative, neutral, positive) probabilities."""
    return probabilities[2] - probabilities[0]
