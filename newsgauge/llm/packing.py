"""Hierarchical residual best-fit packing of token sequences.

Documents are tokenised, given an end token and, only where longer than a sequence, cut into pieces. Pieces are dealt to
groups of bounded size; every group is packed best fit, longest first. Its nearly full bins are done, its underfull bins go
on as items of their own, and neighbouring groups are merged, a few into one, for another round, until one group is left.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgauge.llm.bpe import Merges
from newsgauge.llm.ordering import scalar
from newsgauge.llm.segments import segmented
from newsgauge.session import drop_staged, staged

_CACHED_WORDS = 50_000
#: Bytes of text whose segments are looked up together.
_GROUP_BYTES = 1 << 20


class _Encoder:
    """Token ids of whole texts, as little-endian bytes, word by word through a cache of bounded size. ``merges`` has the same
    ids for most words, many at once.

    The vocabulary drops white space and no token spans it, so the ids of a text are those of its words one after the
    other. A word's closing marks are split off, and a word of ASCII letters is looked up in lower case; both leave the ids
    as they are. What these rules do not cover goes to the tokenizer whole.
    """

    #: Python takes these for white space, the tokenizer does not.
    _NOT_SPACE = re.compile("[\x1c-\x1f]")
    _MARKS = ".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _kept(self, word: str, ids: bytes) -> bytes:
        if len(self.cache) >= _CACHED_WORDS:  # what is looked up again comes back from the older half
            self.older = dict(self.cache)
            self.cache.clear()
        if len(word) <= 64:
            self.cache[word] = ids
        return ids

    def word(self, word: str) -> bytes:
        known = self.older.get(word)
        if known is not None:
            return self._kept(word, known)
        core = word.rstrip(self._MARKS)
        if core and core[-1].isalpha() and len(core) < len(word):
            marks = word[len(core):]
            ids = self.part(core) + (self.cache.get(marks) or self._kept(marks, self.whole(marks)))
            return self._kept(word, ids)
        return self.part(word)

    def part(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            lower = word.lower()
            ids = self.cache.get(lower) or self.older.get(lower)
            if ids is None:
                ids = self._kept(lower, np.array([t.id for t in self.tokenizer.model.tokenize(lower)], "<u4").tobytes())
            return ids if lower == word else self._kept(word, ids)
        return self.cache.get(word) or self._kept(word, self.whole(word))

    def text(self, text: str) -> bytes:
        if self._NOT_SPACE.search(text):
            return self.whole(text)
        get, word = self.cache.get, self.word
        return b"".join([get(w) or word(w) for w in text.split()])


def _encoder(path: str) -> _Encoder:
    """One for each worker process; it outlives the task."""
    held = sys.modules.setdefault("_newsgauge_encoders", types.ModuleType("_newsgauge_encoders"))
    if path not in held.__dict__:
        held.__dict__[path] = _Encoder(path)
    return held.__dict__[path]


def pieces(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = 4096, end: int = 1,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text; ``vocabulary`` is a tokenizer file at the same
    path on every machine. A null or empty text is one piece, the end token alone."""
    closing = np.array([end], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] * with_ids

    def tokens(encoder: _Encoder, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as bytes: those of its segments, each distinct one looked up once for some texts."""
        for _, segments in segmented(column, False, _GROUP_BYTES):
            covered, ids, sizes = encoder.merges.segments(segments.names)
            rest = [encoder.text(x) for x in segments.names.filter(pa.array(~covered)).to_pylist()]
            ends = np.cumsum(np.concatenate([sizes * 4, [len(x) for x in rest]]).astype(np.int64))
            known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)),
                                                                                      pa.py_buffer(ids.astype("<u4").tobytes() + b"".join(rest))])
            place = np.zeros(len(covered), np.int64)
            place[covered], place[~covered] = np.arange(len(sizes)), len(sizes) + np.arange(len(rest))
            taken = known.take(pa.array(place[segments.index]))
            places = np.frombuffer(taken.buffers()[1], np.int64)[:len(taken) + 1]
            data = memoryview(taken.buffers()[2] or b"")
            bounds = places[np.concatenate([[0], np.cumsum(segments.counts)])].tolist()
            for low, high in zip(bounds, bounds[1:], strict=False):
                yield bytes(data[low:high])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for i, ids in zip(batch.column(0), tokens(encoder, batch.column(1)), strict=True):
                ids += closing
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at:at + 4 * length]
                    row = (i.as_py(), k, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for column, x in zip(out, row):  # noqa: B905  ids only where wanted
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], names=[f for f, _ in fields])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return df.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: of each item its bin and its place there, and the fill of each bin."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bin_of, offset, np.array(fill, np.int64)


def pack(items: DataFrame, item: str, size: str, capacity: int = 4096, group_rows: int = 16_384, fan_in: int = 8,
         nearly_full: float = 0.98) -> DataFrame:
    """(item, sequence_id, offset) for every row of the staged ``items``; ``item`` must be a unique long, sizes 1 to
    ``capacity``.

    A group has about ``group_rows`` items. A bin is done if filled to ``nearly_full`` or with less room than the smallest
    underfull bin of all fills, so that nothing can be added to it; all others go on. ``fan_in`` neighbouring groups are merged for
    the next round, and dealt to several again where together they hold more than twice ``group_rows`` bins. The last round
    is that in which all groups are one, or the parts of one. The sequence takes the number of its first item.
    """
    total = scalar(items.agg(F.count("*")))[0]
    groups = max(1, -(-total // group_rows))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("item", "ascending")])
        item_ids, sizes = table.column("item").to_numpy(), table.column("size").to_numpy()
        bin_of, offset, fill = best_fit(sizes, capacity)
        head = np.zeros(len(fill), np.int64)
        at_start = offset == 0
        head[bin_of[at_start]] = item_ids[at_start]
        return pa.table({"item": item_ids, "bin": head[bin_of], "offset": offset, "fill": fill[bin_of],
                         "node": pa.array(np.repeat(table.column("node").to_numpy()[:1], len(sizes)), pa.int64())})

    level = items.select(F.col(item).alias("item"), F.col(size).alias("size"), F.pmod(F.xxhash64(item), F.lit(groups)).cast("bigint").alias("node"))
    rounds: list[DataFrame] = []
    while True:
        parts = level.groupBy("node").agg(F.ceil(F.count("*") / (2 * group_rows)).alias("parts"))
        dealt = level.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("item", F.lit(len(rounds))), F.col("parts")))
        placed = staged(dealt.select("item", "size", "node", "part").groupBy("node", "part")
                        .applyInArrow(place, "item bigint, bin bigint, offset bigint, fill bigint, node bigint"))
        rounds.append(placed)
        if groups == 1:
            break
        groups = -(-groups // fan_in)
        under = placed.where((F.col("offset") == 0) & (F.col("fill") < nearly_full * capacity))
        least = scalar(under.agg(F.min("fill")))[0] or 0
        level = under.where(F.col("fill") + least <= capacity).select(
            F.col("bin").alias("item"), F.col("fill").alias("size"), F.floor(F.col("node") / fan_in).alias("node"))

    # Where each bin of a round ends up: from the last round to the first, so that the small tables are joined first.
    ends = None
    for placed in reversed(rounds):
        here = placed.select("item", "bin", "offset")
        if ends is not None:
            here = (here.join(ends, "bin", "left")
                    .select("item", F.coalesce("far", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")))
        ends = here.select(F.col("item").alias("bin"), F.col("bin").alias("far"), F.col("offset").alias("shift"))
    return here.select(F.col("item").alias(item), F.col("bin").alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = 4096, end: int = 1,
                   **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the pieces of all documents and their places.

    Every row of ``df`` is packed, also repeated rows and rows without key; an empty table gives an empty result. Pieces
    of full length are sequences of their own and take no part in the packing.
    """
    cut = staged(pieces(df, vocabulary, key, text, length, end).withColumn("_item", F.monotonically_increasing_id()))
    full = F.col("length") == length
    packed = pack(cut.where(~full), "_item", "length", length, **options)
    alone = cut.where(full).select("*", F.col("_item").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return cut.where(~full).join(packed, "_item").unionByName(alone).drop("_item")
