"""Words, lines and n-grams of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than blank and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``. Words, lines and sequences are
compared by 64-bit hashes: a prefix sum of random byte values times powers of an odd number gives the hash of any span
by one subtraction, and a mixing step spreads it.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in groups of about this many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 18
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a one-to-one map."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    # Kept once for each process, not for each task: functions travel with their module's values.
    kept = sys.modules.setdefault("_newsgauge_powers", types.ModuleType("_newsgauge_powers")).__dict__
    have = kept.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, GROUP_BYTES + 1), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if len(have) <= 1 << 22:  # the powers for one very long text are not kept
            kept[str(base)] = have
    return have[:n]


class Texts:
    """Consecutive texts: ``data`` their bytes, ``edges`` the n + 1 places where they begin and end."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        self.data, self.edges, self.n = data, edges, len(edges) - 1

    def lowered(self) -> Texts:
        return Texts(_LOWER[self.data], self.edges)

    def per_text(self, places: np.ndarray) -> np.ndarray:
        """How many of the ascending ``places`` lie in each text."""
        return np.diff(np.searchsorted(places, self.edges))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the number of words of each text."""
        inside = ~_SPACE[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = self.edges[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, self.per_text(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each ``\\n``-split line (at least one per text), and the number of lines of each text."""
        breaks = np.flatnonzero(self.data == 10)
        counts = self.per_text(breaks) + 1
        starts = np.sort(np.concatenate([self.edges[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.edges[1:], breaks]), kind="stable")
        return starts, ends, counts

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[self.data] * _powers(_BASE, n), out=sums[1:])
            spans = (sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts]
            return mix(spans ^ ((ends - starts).astype(np.uint64) * _U(0xD1B54A32D192ED03)))


def chain(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n]
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out = mix(out * _U(0x9FB21C651E98DF25) + hashes[k:k + n])
    return out


def groups(column: pa.Array | pa.ChunkedArray, most_bytes: int = GROUP_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow string column (null as empty), a group at a time."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from groups(chunk, most_bytes)
        return
    wide = pa.types.is_large_string(column.type)
    edges = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(edges, edges[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), len(column))
        part = column.slice(at, to - at)
        if part.null_count:  # what lies under a null is not part of the texts
            part = pc.fill_null(part.cast(pa.large_string()), "")
            own = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
            yield Texts(np.frombuffer(part.buffers()[2] or b"", np.uint8)[own[0]:own[-1]], own - own[0])
        else:
            yield Texts(data[edges[at]:edges[to]], edges[at:to + 1] - edges[at])
        at = to
    pa.default_memory_pool().release_unused()


def distinct_shingles(texts: Texts, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text; with fewer words, the whole sequence as one."""
    starts, ends, counts = texts.words()
    hashes = texts.span_hashes(starts, ends)
    chained = chain(hashes, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(chained[at:at + n - size + 1]))
        elif n:
            out.append(chain(hashes[at:at + n], n) ^ _U(n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
