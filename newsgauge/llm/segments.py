"""Texts cut into segments that a tokenizer treats independently, so that a repeated one is tokenised once.

A segment begins at a blank that does not follow white space. No token of the tokenizers used here spans such a place, so
the ids of a text are those of its segments one after the other. A text with white space beyond ASCII, where the
patterns of tokenizers differ, is one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from newsgauge.llm.bytewords import _SPACE, Texts, groups

#: White space of Unicode that is not of ASCII, and the separators that only some libraries take for white space.
OTHER_SPACE = "[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def with_blank(texts: Texts) -> Texts:
    """Every text with a blank in front."""
    shift = np.repeat(np.arange(1, texts.n + 1), np.diff(texts.edges))
    data = np.full(len(texts.data) + texts.n, 0x20, np.uint8)
    data[np.arange(len(texts.data)) + shift] = texts.data
    return Texts(data, texts.edges + np.arange(texts.n + 1))


class Segments:
    """``names`` the distinct segments of a group of texts, ``index`` the segments of all texts by their place in ``names``,
    ``counts`` their number in each text. A text of no bytes has none."""

    def __init__(self, texts: Texts):
        data, edges = texts.data, texts.edges
        blank = np.flatnonzero(data[1:] == 0x20) + 1
        blank = blank[~_SPACE[data[blank - 1]]]
        whole = pa.StringArray.from_buffers(texts.n, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        odd = np.flatnonzero(pc.match_substring_regex(whole, OTHER_SPACE).to_numpy(zero_copy_only=False))
        if len(odd):
            blank = blank[~np.isin(np.searchsorted(edges, blank, "right") - 1, odd)]
        begins = np.zeros(len(data), bool)
        begins[edges[:-1][np.diff(edges) > 0]] = begins[blank] = True
        starts = np.flatnonzero(begins)
        cuts = np.append(starts, len(data)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        self.names: pa.Array = parts.dictionary
        self.index = parts.indices.to_numpy().astype(np.int64)
        self.counts = np.diff(np.searchsorted(starts, edges))


def segmented(column: pa.Array, blank: bool, most_bytes: int) -> Iterator[tuple[Texts, Segments]]:
    """Groups of about ``most_bytes`` of the texts of a column, with ``blank`` each with a blank in front of it where not empty."""
    for texts in groups(column, most_bytes):
        if blank:
            empty = np.diff(texts.edges) == 0
            texts = with_blank(texts)
            if empty.any():  # the blank goes again
                keep = np.ones(len(texts.data), bool)
                keep[texts.edges[:-1][empty]] = False
                texts = Texts(texts.data[keep], np.concatenate([[0], np.cumsum(np.diff(texts.edges) - empty)]))
        yield texts, Segments(texts)
