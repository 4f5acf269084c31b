"""Row-level text derivations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from newsgauge.functions import vocab


def not_blank(column: Column) -> Column:
    """The text, or NULL when it is NULL or only white space."""
    return F.when(F.trim(column) != "", column)


def score_text(headline: Column, summary: Column) -> Column:
    """Text to score, whole: headline, else summary; NULL when both are blank."""
    return F.coalesce(not_blank(headline), not_blank(summary))


def ellipsize(column: Column, keep: int, limit: int | None = None) -> Column:
    """First ``keep`` characters and ``...`` when the text is longer than ``limit`` (default ``keep``)."""
    limit = keep if limit is None else limit
    return F.when(F.length(column) > limit, F.concat(F.substring(column, 1, keep), F.lit("..."))).otherwise(column)


def split_csv(column: Column) -> Column:
    """Comma-separated text as an array of trimmed, non-empty parts; NULL gives an empty array."""
    parts = F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a literal map, NULL when absent."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(literal, key)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(name, r"[^./\\](\.[^./\\]*)$", 1))


def mime_type(name: Column) -> Column:
    return F.coalesce(lookup(vocab.MIME_TYPES, extension(name)), F.lit(vocab.DEFAULT_MIME))


def text_preview(name: Column, content: Column, max_chars: int = 500) -> Column:
    """Preview of text-like files, NULL for others."""
    mime = mime_type(name)
    textual = mime.startswith("text/") | mime.isin("application/json", "application/javascript", "application/xml")
    return F.when(textual, ellipsize(content, max_chars))


def enum_or(column: Column, allowed: list[str], default: str) -> Column:
    return F.when(column.isin(allowed), column).otherwise(F.lit(default))


def epoch_to_ntz(seconds: Column) -> Column:
    """Epoch seconds (UTC) as a timestamp without zone."""
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def ntz_to_epoch(ts: Column) -> Column:
    """Whole epoch seconds of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def ntz_to_instant(ts: Column) -> Column:
    """A UTC timestamp without zone as the instant it names; streams need instants for watermarks."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts))


def instant_to_ntz(ts: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def iso_to_ntz(text: Column) -> Column:
    """ISO text, with or without a trailing ``Z`` or offset, as UTC; NULL when it cannot be read."""
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), zoned).otherwise(text.try_cast("timestamp_ntz"))


def stable_id(*columns: Column) -> Column:
    """Repeatable id of a natural key, so that a rerun does not create new ids."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns]), 256)
