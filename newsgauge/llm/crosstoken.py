"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut a text's bytes without gaps. In every batch pandas' merge_asof, keyed by document, finds for each token
start of one side the token of the other side that covers it; the union of both directions holds each overlapping pair,
once. Places where tokens of both sides end cut a document into groups. How many documents hold a pair of ids linked is counted
over the whole corpus, and each link is then rated by its count.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from newsgauge.llm.bpe import byte_letters
from newsgauge.llm.ordering import scalar
from newsgauge.llm.segments import OTHER_SPACE, segmented
from newsgauge.session import staged

#: Bytes of text that are aligned at once.
_GROUP_BYTES = 1 << 20


class ByteSide:
    """A byte-level BPE; ``path`` names its json file, or the same vocabulary as ranks, which is faster."""

    def __init__(self, path: str, pattern: str | None = None):
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [own.encode_ordinary(x) for x in texts]
            pieces = {i: b for b, i in ranks.items()}
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
            letters = byte_letters()
            pieces = {i: bytes(letters[c] for c in x) for x, i in own.get_vocab(with_added_tokens=False).items()}
        self.size = max(pieces) + 1
        self.pieces = [pieces.get(i, b"") for i in range(self.size)]

    def encode_parts(self, names: pa.Array, data: bytes) -> list[list[int]]:
        """Of segments that lie one after the other in ``data``: as one text, as its pattern cuts at their blanks."""
        return self.encode([data.decode()])


class PieceSide:
    """A sentencepiece model, which adds a blank in front of a text by itself; the segments' own blank is taken off."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = own.get_piece_size()
        closing = [own.piece_to_id("▁")]  # a blank at the end of a text, as an empty text gets none
        self.encode = lambda texts: [x if y != " " else closing for x, y in zip(own.encode([y[1:] for y in texts], num_threads=1), texts, strict=True)]
        self.pieces = [bytes([int(x[3:5], 16)]) if own.is_byte(i) else x.replace("▁", " ").encode()
                       for i, x in enumerate(own.id_to_piece(list(range(self.size))))]

    def encode_parts(self, names: pa.Array, data: bytes) -> list[list[int]]:
        """Each by itself, as its time grows faster than a text."""
        return self.encode(names.to_pylist())


def _made(kind: type, *args: str):
    """One for each worker process; it outlives the task."""
    held = sys.modules.setdefault("_newsgauge_sides", types.ModuleType("_newsgauge_sides")).__dict__
    name = repr((kind.__name__, *args))
    if name not in held:
        held[name] = kind(*args)
    return held[name]


class Aligner:
    """Both sides, and what they give for the distinct segments of texts."""

    def __init__(self, bytes_path: str, pieces_path: str, pattern: str):
        self.a, self.b = ByteSide(bytes_path, pattern), PieceSide(pieces_path)
        self.sizes = [np.array([len(p) for p in side.pieces], np.int64) for side in (self.a, self.b)]
        # Ids in decimal, closed by what follows them: another token of the group, the other side, the next group.
        self.words = [pa.array([f"{i}{mark}" for mark in marks for i in range(side.size)]) for side, marks in ((self.a, ",|"), (self.b, ",;"))]
        self.bytes = [pa.array(side.pieces, pa.binary()) for side in (self.a, self.b)]

    def _joined(self, names: pa.Array) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """(ids, number of ids per text) of each side for segments that do not end in white space; None if a side does not give
        back their bytes, cut where they are."""
        data = names.buffers()[2].to_pybytes()
        places = np.frombuffer(names.buffers()[1], np.int32)[names.offset:names.offset + len(names) + 1].astype(np.int64)
        data, ends = data[places[0]:places[-1]], places[1:] - places[0]
        out = []
        for s, side in enumerate((self.a, self.b)):
            ids = np.fromiter(chain.from_iterable(side.encode_parts(names, data)), np.int64)
            upto = np.cumsum(self.sizes[s][ids])
            at = np.minimum(np.searchsorted(upto, ends), max(len(upto) - 1, 0))
            if not len(ids) or (upto[at] != ends).any() or _concatenated(self.bytes[s].take(pa.array(ids))) != data:
                return None
            out.append((ids, np.diff(at + 1, prepend=0)))
        return out

    def _each(self, names: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """The same one by one, for any segments, and which of them both sides give back."""
        made = [side.encode(names) if names else [] for side in (self.a, self.b)]
        alike = [b"".join([self.a.pieces[i] for i in a]) == x.encode() == b"".join([self.b.pieces[i] for i in b]) for x, a, b in zip(names, *made, strict=True)]
        return [(np.array([i for ids in m for i in ids], np.int64), np.array([len(ids) for ids in m], np.int64)) for m in made], np.array(alike, bool)

    def tokens(self, segments) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of both sides, their number in each text, and which texts are kept: those whose bytes both sides give back."""
        plain = ~pc.match_substring_regex(segments.names, rf"[\t-\r ]$|{OTHER_SPACE}").to_numpy(zero_copy_only=False).astype(bool)
        joined = self._joined(segments.names.filter(pa.array(plain))) if plain.any() else None
        if joined is None:
            plain[:] = False
            joined = [(np.zeros(0, np.int64),) * 2] * 2
        rest, alike = self._each(segments.names.filter(pa.array(~plain)).to_pylist())
        place = np.zeros(len(plain), np.int64)
        place[plain], place[~plain] = np.arange(plain.sum()), plain.sum() + np.arange((~plain).sum())
        lost = np.zeros(len(plain), bool)
        lost[~plain] = ~alike
        text = np.repeat(np.arange(len(segments.counts)), segments.counts)
        good = segments.counts > 0
        good[text[lost[segments.index]]] = False
        index, text = place[segments.index[good[text]]], text[good[text]]
        ids, counts = [], []
        for whole, single in zip(joined, rest, strict=True):
            flat, sizes = (np.concatenate(x) for x in zip(whole, single, strict=True))
            taken = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat)).take(pa.array(index))
            ids.append(taken.flatten().to_numpy())
            counts.append(np.bincount(text, weights=sizes[index], minlength=len(segments.counts)).astype(np.int64))
        return ids, counts, good


def _concatenated(column: pa.Array) -> bytes:
    """The values of a binary array one after the other."""
    return column.buffers()[2].to_pybytes()[:np.frombuffer(column.buffers()[1], np.int32)[len(column)]]


def covering(starts: pd.DataFrame, tokens: pd.DataFrame) -> np.ndarray:
    """For each token start the place of the other side's token that covers it. Both frames: document, at (ascending)."""
    other = tokens.assign(place=np.arange(len(tokens)))
    return pd.merge_asof(starts, other, on="at", by="document")["place"].to_numpy()


def overlaps(documents: list[np.ndarray], starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places in a, places in b) of all pairs of tokens that share a byte, by the ascending starts of both sides."""
    a, b = (pd.DataFrame({"document": d, "at": s}) for d, s in zip(documents, starts, strict=True))
    of_a, of_b = covering(a, b), covering(b, a)
    later = starts[0][of_b] != starts[1]  # with equal starts the pair is there already
    return np.concatenate([np.arange(len(a)), of_b[later]]), np.concatenate([of_a, np.flatnonzero(later)])


def align(df: DataFrame, bytes_path: str, pieces_path: str, pattern: str, key: str = "doc_id", text: str = "text", spell: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, groups]) for each row of ``df``.

    ``groups`` spells the groups, ``a1,a2|b1;a3|b2,b3`` in decimal ids; ``pairs`` has the distinct linked id pairs of the text as
    a * (size of the second vocabulary) + b, ``times`` how often each is linked. A text that is null or empty, or whose
    bytes one side does not give back, has no tokens: zeros, empty lists and an empty digest. Rows may repeat. The
    files lie at the same paths on every machine.
    """
    fields = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
              ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    fields += [("groups", pa.string())] * spell

    def one(aligner: Aligner, keys: pa.Array, segments) -> pa.RecordBatch:
        n = len(keys)
        ids, counts, good = aligner.tokens(segments)
        documents = [np.repeat(np.arange(n), c) for c in counts]
        ends = [np.cumsum(aligner.sizes[s][ids[s]]) for s in (0, 1)]
        starts = [ends[s] - aligner.sizes[s][ids[s]] for s in (0, 1)]
        left, right = overlaps(documents, starts)
        cuts = np.intersect1d(ends[0], ends[1], assume_unique=True)  # ends grow over the whole batch, so each is of one document
        group = [np.searchsorted(cuts, e) for e in ends]
        last = [np.append(g[1:] != g[:-1], True)[:len(g)] for g in group]
        words = [aligner.words[s].take(pa.array(ids[s] + last[s] * (aligner.a, aligner.b)[s].size)) for s in (0, 1)]
        turn = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        line = pa.concat_arrays(words).take(pa.array(turn))
        places = np.frombuffer(line.buffers()[1], np.int32)[:len(line) + 1]
        spelled = line.buffers()[2] or b""
        bounds = places[np.concatenate([[0], np.cumsum(counts[0] + counts[1])])]
        lines = [bytes(memoryview(spelled)[a:b - 1]) if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

        width = aligner.a.size * aligner.b.size
        linked, times = np.unique(documents[0][left] * width + ids[0][left] * aligner.b.size + ids[1][right], return_counts=True)
        owner = linked // width
        offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
        n_groups = np.bincount(documents[0][last[0]], minlength=n)
        columns = [keys, *(pa.array(c.astype(np.int64)) for c in (counts[0], counts[1], n_groups, np.bincount(documents[0][left], minlength=n))),
                   pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in lines], pa.string()),
                   pa.ListArray.from_arrays(offsets, pa.array(linked % width)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
        if spell:
            columns.append(pa.array([x.decode() for x in lines], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[f for f, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _made(Aligner, bytes_path, pieces_path, pattern)
        for batch in batches:
            at = 0
            for texts, segments in segmented(batch.column(1), True, _GROUP_BYTES):
                yield one(aligner, batch.column(0).slice(at, texts.n), segments)
                at += texts.n

    schema = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
              + ", groups string" * spell)
    return df.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, second_size: int) -> DataFrame:
    """(pair, n, best): in how many rows of :func:`align` a pair is linked, and whether that is the most of its first id."""
    counts = staged(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
                    .withColumn("first", F.expr(f"pair div {second_size}L")))
    most = counts.groupBy("first").agg(F.max("n").alias("most"))
    return counts.join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def rate(aligned: DataFrame, counts: DataFrame, slice_pairs: int = 1 << 20) -> DataFrame:
    """The staged rows of :func:`align` without lists, with ``n_best``, the links whose pair is the most frequent of its first
    id, and ``count_sum``, the sum of the counts of all links.

    The table of counts is cut into slices of about ``slice_pairs`` pairs. The documents' distinct pairs meet one slice after
    the other, sent to the tasks whole (13 bytes a pair), so that nothing sent is larger than a slice and the pairs
    of documents are not shuffled; with several slices a row's sums are added up.
    """
    counts = staged(counts)
    slices = max(1, -(-scalar(counts.agg(F.count("*")))[0] // slice_pairs))
    rest = [c for c in aligned.columns if c not in ("pairs", "times")]
    numbered = aligned if slices == 1 else staged(aligned.withColumn("_row", F.monotonically_increasing_id()))
    key = [] if slices == 1 else ["_row"]
    parts = []
    for k in range(slices):
        held = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k).orderBy("pair").toArrow() if slices > 1 else counts.orderBy("pair").toArrow()
        pairs, n, best = (held.column(i).to_numpy() for i in range(3))

        def summed(batches, pairs=pairs, n=n, best=best):
            for batch in batches:
                links, times = batch.column("pairs"), batch.column("times")
                asked, weight = links.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, asked), max(len(pairs) - 1, 0))
                hit = pairs[at] == asked if len(pairs) else np.zeros(len(asked), bool)
                weight = np.where(hit, weight, 0)
                row = np.repeat(np.arange(batch.num_rows), np.diff(links.offsets.to_numpy()))
                sums = np.zeros((2, batch.num_rows), np.int64)
                if len(pairs):
                    np.add.at(sums[0], row, weight * best[at])
                    np.add.at(sums[1], row, weight * n[at])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key + rest), *map(pa.array, sums)], names=[*key, *rest, "n_best", "count_sum"])

        types_ = dict(numbered.dtypes)
        schema = ", ".join(f"{c} {types_[c]}" for c in key + rest) + ", n_best bigint, count_sum bigint"
        parts.append(numbered.mapInArrow(summed, schema))
    if slices == 1:
        return parts[0]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return (out.groupBy("_row", *rest).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("_row"))


def align_corpus(df: DataFrame, bytes_path: str, pieces_path: str, pattern: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for each row of ``df``; see :func:`align` and
    :func:`rate`. An empty table gives an empty result."""
    aligned = staged(align(df, bytes_path, pieces_path, pattern, key, text))
    return rate(aligned, pair_counts(aligned, _piece_count(pieces_path)), **options)


def _piece_count(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
