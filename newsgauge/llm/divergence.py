"""Quality rules by distribution divergence.

The histogram of character classes and that of common words of each text are compared with those of its language by the
Jensen-Shannon distance (the root of the divergence in bits, 0 to 1). The references are counts over all texts. Short
texts, whose histograms say little, are not judged by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from newsgauge.llm import bytewords
from newsgauge.llm.ordering import fresh
from newsgauge.session import drop_staged, staged

CELLS = 1 << 14
COMMON = 64
_CLASSES = 16
_CLASS = np.zeros(256, np.int64)  # 0: control
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[0x20], _CLASS[10] = 1, 2, 3, 4, 5
for _i, _set in enumerate((".,", "!?", ";:'\"()-", "#*$%&|<>", "@/\\=_+~^`[]{}"), start=6):
    _CLASS[list(_set.encode())] = _i
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 15, 12, 13, 14  # a character: its first byte
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class References:
    """Row i belongs to ``languages[i]``: shares of character classes, of the common words (the last column: all others),
    and the column of each word cell."""

    languages: list[str]
    classes: np.ndarray
    words: np.ndarray
    column: np.ndarray


def _sums(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _class_counts(texts: bytewords.Texts) -> np.ndarray:
    row = np.repeat(np.arange(texts.n) * _CLASSES, np.diff(texts.edges))
    out = np.bincount(row + _CLASS[texts.data], minlength=texts.n * _CLASSES).reshape(-1, _CLASSES)
    out[:, _CLASSES - 1] = 0  # later bytes of a character
    return out


def references(df: DataFrame, text: str = "text", lang: str = "lang", most_languages: int = 200) -> References:
    """Counts over all texts of each language. Rows without text or language are not counted.

    Words are counted in cells of a hash, so that what a task holds and sends is bounded; the ``COMMON`` fullest cells of
    a language stand for its common words. The ``most_languages`` languages with the most words have a reference; texts
    of others are compared with the nearest one. 32 KB a language.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            parts = [(k, np.flatnonzero(v), v) for k, v in held.items()]
            out = pa.RecordBatch.from_arrays([
                pa.array([k for k, at, _ in parts for _ in range(len(at))], pa.string()),
                pa.array(np.concatenate([at for _, at, _ in parts]), pa.int32()),
                pa.array(np.concatenate([v[at] for _, at, v in parts]), pa.int64())], names=["lang", "cell", "n"])
            held.clear()
            return out

        for batch in batches:
            names, at = batch.column(1).to_pylist(), 0
            for group in bytewords.groups(batch.column(0)):
                own = names[at:at + group.n]
                at += group.n
                different = {k: i for i, k in enumerate(dict.fromkeys(own))}
                index = np.array([different[k] for k in own])
                width = _CLASSES + CELLS
                starts, ends, n = group.words()
                cells = (group.span_hashes(starts, ends) >> np.uint64(50)).astype(np.int64)
                block = np.bincount(np.repeat(index, n) * width + _CLASSES + cells, minlength=len(different) * width)
                block = block.reshape(-1, width)
                np.add.at(block[:, :_CLASSES], index, _class_counts(group))
                for k, i in different.items():
                    held[k] = held[k] + block[i] if k in held else block[i]
            while len(held) > 64:
                yield flush()
        if held:
            yield flush()

    usable = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    cells = staged(usable.mapInArrow(count, "lang string, cell int, n bigint")
                   .groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    is_word = F.col("cell") >= _CLASSES
    totals = (cells.where(is_word).groupBy("lang").agg(F.sum("n").alias("words"))
              .orderBy(F.desc("words"), "lang").limit(most_languages))
    rank = Window.partitionBy("lang", is_word).orderBy(F.desc("n"), "cell")
    rows = (cells.join(totals, "lang").withColumn("rank", F.row_number().over(rank))
            .where(F.col("rank") <= COMMON).collect())
    drop_staged(cells)
    languages = sorted({r["lang"] for r in rows})
    place = {k: i for i, k in enumerate(languages)}
    classes, words = np.zeros((len(place), _CLASSES)), np.zeros((len(place), COMMON + 1))
    column = np.full((len(place), CELLS), COMMON, np.uint8)
    for r in rows:
        i = place[r["lang"]]
        if r["cell"] < _CLASSES:
            classes[i, r["cell"]] = r["n"]
        else:
            words[i, r["rank"] - 1] = r["n"]
            words[i, COMMON] = r["words"]
            column[i, r["cell"] - _CLASSES] = r["rank"] - 1
    words[:, COMMON] -= words[:, :COMMON].sum(1)
    return References(languages, _shares(classes), _shares(words), column)


def _shares(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(1, keepdims=True), 1e-300)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / middle), 0).sum(1)
        return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))


def base_counts(texts: bytewords.Texts, window: int = 5) -> tuple[np.ndarray, ...]:
    """Words, characters in words, symbols, repeated lines and words in repeated windows of each text, and the hashes of
    all words."""
    starts, ends, n = texts.words()
    hashes = texts.span_hashes(starts, ends)
    first_byte = (texts.data & 0xC0) != 0x80
    chars = _sums(first_byte & ~bytewords._SPACE[texts.data], texts.edges)
    symbols = _sums(_SYMBOL[texts.data], texts.edges)

    line_starts, line_ends, lines = texts.lines()
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    of = np.repeat(np.arange(texts.n, dtype=np.uint64), lines)[filled]
    known = np.unique(bytewords.mix(texts.span_hashes(line_starts[filled], line_ends[filled]) ^ bytewords.mix(of + np.uint64(1))),
                      return_index=True)[1]
    repeated_lines = np.bincount(of.astype(np.int64), minlength=texts.n) - np.bincount(of[known].astype(np.int64), minlength=texts.n)

    text_of = np.repeat(np.arange(texts.n), n)
    chained = bytewords.chain(hashes, window)
    at = np.flatnonzero(text_of[:len(chained)] == text_of[window - 1:window - 1 + len(chained)])
    keys = bytewords.mix(chained[at] ^ bytewords.mix(text_of[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + window + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + window, -1)
    covered = np.cumsum(cover)[:len(hashes)] > 0
    repeated_words = np.bincount(text_of[covered], minlength=texts.n)
    return n, chars, symbols, repeated_lines, repeated_words, hashes


def measures(refs: References, text: str = "text", lang: str = "lang") -> Column:
    """A struct for every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and js_chars and js_words,
    the distances to the reference of its language (a null or unknown language: the nearest; without references: 0)."""
    place = {k: i for i, k in enumerate(refs.languages)}
    classes, words, column = refs.classes, refs.words, refs.column

    def distances(own: np.ndarray, by_class: np.ndarray, counts: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """To the reference ``own`` of each text; ``cells`` are those of all words, one text after the other."""
        row = np.repeat(np.arange(len(own)), counts)
        common = np.bincount(row * (COMMON + 1) + column[own[row], cells], minlength=len(own) * (COMMON + 1))
        return _distance(_shares(by_class), classes[own]), _distance(_shares(common.reshape(-1, COMMON + 1)), words[own])

    @arrow_udf("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
               "js_chars:double,js_words:double>")
    def measure(texts: pa.Array, langs: pa.Array) -> pa.Array:
        own, at, out = np.array([place.get(k, -1) for k in langs.to_pylist()], np.int64), 0, []
        for group in bytewords.groups(texts):
            *base, hashes = base_counts(group)
            cells, by_class = (hashes >> np.uint64(50)).astype(np.int64), _class_counts(group)
            index = own[at:at + group.n]
            at += group.n
            if place:
                near = distances(np.maximum(index, 0), by_class, base[0], cells)
                if (unknown := index < 0).any():
                    part = cells[np.repeat(unknown, base[0])]
                    each = [np.stack(distances(np.full(unknown.sum(), i), by_class[unknown], base[0][unknown], part)) for i in place.values()]
                    best = np.stack([x.sum(0) for x in each]).argmin(0)
                    for k in (0, 1):
                        near[k][unknown] = np.stack([x[k] for x in each])[best, np.arange(len(best))]
            else:
                near = np.zeros(group.n), np.zeros(group.n)
            out.append([*base, *near])
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 7
        kinds = [pa.int64()] * 5 + [pa.float64()] * 2
        return pa.StructArray.from_arrays([pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(parts, kinds, strict=True)], names=[
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_chars", "js_words"])

    return measure(F.col(text), F.col(lang))


def judge(df: DataFrame, refs: References, text: str = "text", lang: str = "lang", into: str = "quality",
          most_chars: float = 0.25, most_words: float = 0.35, least_words: int = 50) -> DataFrame:
    """``df`` with a struct ``into``: the measures, ``base_failed`` and ``kept``.

    Base rule: fewer than 10 words, or over 20 % of the words in repeated five-word windows. Beyond it a text of at least
    ``least_words`` words is kept if its distances are at most ``most_chars`` and ``most_words``, apart from what chance alone
    adds: a sample of n words has a divergence of some cells / (8 n ln 2) bits from its own source. A null text counts as empty and fails the base rule.
    """
    name = fresh(df, "_m")["_m"]
    m = F.col(name)
    base_failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])

    def within(distance: Column, most: float, cells: int) -> Column:
        return distance * distance <= most * most + cells / (8 * math.log(2) * F.greatest(m["n_words"], F.lit(1)))

    near = within(m["js_chars"], most_chars, _CLASSES) & within(m["js_words"], most_words, COMMON + 1)
    fields = [m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_chars", "js_words")]
    verdict = F.struct(*fields, base_failed.alias("base_failed"),
                       (~base_failed & ((m["n_words"] < least_words) | near)).alias("kept"))
    return df.withColumn(name, measures(refs, text, lang)).withColumn(into, verdict).drop(name)
