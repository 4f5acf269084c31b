"""Byte-pair merges of many words at once, as numpy arrays.

For the tokenizer whose words are runs of letters, single digits and runs of other marks in lower case, closed by a word end. Words of
ASCII and the letters of Latin-1 are merged here, all of a group of texts together: in every round each word takes its
pair of the lowest rank, the leftmost of equal ones. Segments with anything else are left to the tokenizer itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

_NEVER = np.iinfo(np.int32).max
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.int8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
# A quote may begin an ending such as 's, and a bar may belong to a special token.
_KIND[[0x27, 0x7C]] = _OTHER


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 bytes are themselves, the others
    follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.by_key = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.by_key]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for letter, byte in byte_letters().items():
            self.inner[byte], self.last[byte] = vocab[letter], vocab[letter + end]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], _NEVER).astype(np.int32)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie one after the other in ``data`` (``sizes`` bytes each, at least 1), and their number per word."""
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[data[ends - 1]]
        rank = np.full(len(symbols), _NEVER, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[ends - 1] = _NEVER
        word = np.arange(len(sizes))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            live = low < _NEVER
            if not live.all():
                on = np.repeat(live, sizes)
                done.append((word[~live], sizes[~live], symbols[~on]))
                symbols, rank, word, sizes, low = symbols[on], rank[on], word[live], sizes[live], low[live]
                if not len(word):
                    break
                starts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(low, sizes))
            at = hits[np.searchsorted(hits, starts)]  # the leftmost of each word
            symbols[at] = self.merged[low]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            closes = at + 2 == starts + sizes  # the pair was the last of its word
            symbols, rank = symbols[keep], rank[keep]
            at = at - np.arange(len(at))
            sizes = sizes - 1
            starts = starts - np.arange(len(starts))
            rank[at[closes]] = _NEVER
            inner = at[~closes]
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
            before = at[at > starts]
            rank[before - 1] = self.ranks(symbols[before - 1], symbols[before])
        words, counts, flat = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
        order = np.argsort(words, kind="stable")
        out = np.zeros(len(words), np.int64)
        out[words] = counts
        begins = np.cumsum(counts) - counts
        places = np.repeat(begins[order] - (np.cumsum(out) - out), out) + np.arange(len(flat))
        return flat[places].astype(np.int32), out

    def segments(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the texts ``names`` are covered, ids of these one after the other, number of ids of each)."""
        edges = np.frombuffer(names.buffers()[1], np.int32)[names.offset:names.offset + len(names) + 1].astype(np.int64)
        data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]].copy() if len(names) else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        kind = _KIND[data]
        # A letter of Latin-1 is 0xC3 and 0x80 to 0xBF, but for the signs of times and division.
        lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
        tail = data[lead + 1]
        good = (tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)
        lead, tail = lead[good], tail[good]
        kind[lead] = kind[lead + 1] = _LETTER
        data[lead[tail < 0x9F] + 1] += 0x20
        upper = (data >= 0x41) & (data <= 0x5A)
        data[upper] += 0x20
        name = np.repeat(np.arange(len(names)), np.diff(edges))
        covered = np.bincount(name[kind == _OTHER], minlength=len(names)) == 0
        new = np.ones(len(data), bool)
        if len(data):
            new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | (name[1:] != name[:-1])
        inside = (kind != _SPACE) & covered[name]
        starts = np.flatnonzero(new & inside)
        word_of = np.cumsum(new & inside)[inside] - 1
        sizes = np.bincount(word_of, minlength=len(starts))
        ids, counts = self.merge(data[inside], sizes) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        per_name = np.bincount(name[starts], weights=counts, minlength=len(names)).astype(np.int64)
        return covered, ids, per_name[covered]
