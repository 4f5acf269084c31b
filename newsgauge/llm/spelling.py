"""Spelling variants: words one edit apart, found by search schemes on FM-indexes of the delimited vocabulary.

Two words one edit apart agree in one half of either of them, so a word is searched twice: one half is matched exactly and
the search goes on across the other half, allowing one inserted, deleted or replaced code point. An index is the suffix order
of ``#word#word#...#``; a state of a search is an interval of suffix ranks, and taking one more code point in front of the
match narrows the interval by two rank lookups. Matching to the right of the first half is matching in front of it in the
reversed vocabulary, so both directions are searched by the same code, one on the words and one on the reversed words.

The vocabulary is dealt to indexes of bounded size by the code points that the exact half ends with; a search visits only
the indexes that hold them. Where very many words share these, their indexes are several and each search visits all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsgauge.llm.ordering import scalar, text_of
from newsgauge.session import drop_staged, staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
#: Code points of the searched text: its end and the mark between words; letters follow.
_END, _MARK, _LETTERS = 0, 1, 2
_SEARCHES = 4096


def occurrences(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """(word): one row for each run of letters of every whole text, A-Z in lower case. Where the checksum of
    ``<key>:<run>`` is a multiple of ``every``, one code point of the run is missing, so that the corpus holds slips to find.
    A null text has no runs; a null key counts as an empty one."""
    runs = F.regexp_extract_all(F.translate(text_of(text), _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    slip = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    return rows.select(F.when(F.col("h") % every == 0, slip).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, word: str = "word", length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the distinct words of at least ``length`` code points and ``least`` occurrences."""
    return (words.where(F.char_length(word) >= length).groupBy(F.col(word).alias("word"))
            .agg(F.count("*").alias("n")).where(F.col("n") >= least))


class FMIndex:
    """Suffix order of distinct words between marks. ``letters`` are the code points in use, ascending."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        self.letters = np.unique(points)
        n = int(len(points) + len(words) + 2)
        text = np.full(n, _MARK, np.int64)
        inner = np.arange(len(points)) + 1 + np.repeat(np.arange(len(words)), sizes)
        text[inner] = np.searchsorted(self.letters, points) + _LETTERS
        text[-1] = _END
        self.marks = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # the mark in front of each word
        self.order = _suffix_order(text)
        before = text[self.order - 1]
        self.n = n
        by_letter = np.argsort(before, kind="stable")
        self.keys = before[by_letter] * (n + 1) + by_letter

    def code(self, points: np.ndarray) -> np.ndarray:
        """The letters' numbers; -1 for a code point that no word here has."""
        at = np.searchsorted(self.letters, points)
        at[at == len(self.letters)] = 0
        return np.where(self.letters[at] == points, at + _LETTERS, -1) if len(self.letters) else np.full(len(points), -1)

    def extend(self, letter, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the matches with ``letter`` in front."""
        base = letter * (self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def within_one(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``words``, places in the index) of all pairs where the last ``exact`` code points agree and what is in
        front of them differs by one edit."""
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        codes = self.code(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
        low, high = self.extend(_MARK, np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64))
        for back in range(int(exact.max(initial=0))):
            on = np.flatnonzero((back < exact) & (high > low))
            low[on], high[on] = self.extend(codes[starts[on] + sizes[on] - 1 - back], low[on], high[on])
        alive = np.flatnonzero(high > low)
        # Unedited matches: query, place of the next code point, interval. Edited ones likewise.
        plain = (alive, (sizes - exact)[alive] - 1, low[alive], high[alive])
        edited = tuple(np.zeros(0, np.int64) for _ in range(4))
        alphabet = np.arange(_LETTERS, _LETTERS + len(self.letters))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(plain[0]) or len(edited[0]):
            q, p, lo, hi = edited
            ended = p < 0
            lo2, hi2 = self.extend(np.where(ended, _MARK, codes[starts[q] + np.maximum(p, 0)]), lo, hi)
            hit = ended & (hi2 > lo2)
            found.append((q[hit], self.order[lo2[hit]]))
            on = ~ended & (hi2 > lo2)
            forward = [(q[on], p[on] - 1, lo2[on], hi2[on])]

            q, p, lo, hi = plain
            lows, highs = self.extend(alphabet[None, :], lo[:, None], hi[:, None])
            row, letter = np.nonzero(highs > lows)
            lows, highs = lows[row, letter], highs[row, letter]
            inside = p[row] >= 0
            same = inside & (alphabet[letter] == codes[starts[q[row]] + np.maximum(p[row], 0)])
            other = inside & ~same
            forward.append((q[row], p[row], lows, highs))  # the index has one code point more
            forward.append((q[row][other], p[row][other] - 1, lows[other], highs[other]))  # another one
            left = p >= 0
            forward.append((q[left], p[left] - 1, lo[left], hi[left]))  # one less
            edited = tuple(np.concatenate(c) for c in zip(*forward, strict=True))
            plain = (q[row][same], p[row][same] - 1, lows[same], highs[same])
        place, mark = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        pairs = np.unique(place * (len(self.marks) + 1) + np.searchsorted(self.marks, mark))
        return pairs // (len(self.marks) + 1), pairs % (len(self.marks) + 1)


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Places in the order of the suffixes that start there, by prefixes of doubling length."""
    n, letters = len(text), int(text.max()) + 1
    width = min(n, max(1, int(62 // np.log2(letters + 1))))
    key = np.zeros(n, np.int64)
    for k in range(width):  # the first few code points at once
        key = key * letters
        key[:n - k] += text[k:]
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(ranked[1:] != ranked[:-1])
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[:max(n - width, 0)] += rank[width:] + 1
        width *= 2


def _exact(size: Column, side: str) -> Column:
    """How many code points of a word must agree in this search: together the two searches cover the word."""
    return F.floor(size / 2) if side == "front" else F.ceil(size / 2)


def near_words(words: DataFrame, word: str = "word", index_words: int = 16_384, route: int = 4) -> DataFrame:
    """(id, near, near_n) for each of the staged ``words`` (id, word, n) and every other at one edit from it.

    An index holds about ``index_words`` words; ``route`` is the most code points by which words are dealt to indexes.
    The words must be distinct and of three code points or more.
    """
    entries, searches = [], []
    for number, side in enumerate(("front", "back")):
        # The searched half is at the end of the text, so words are reversed where the front must agree.
        text = F.reverse(F.col(word)) if side == "front" else F.col(word)
        size = F.char_length(word)
        routed = lambda exact: F.least(exact, F.lit(route)).cast("int")
        key = lambda k: F.xxhash64(F.lit(side), F.col("text").substr(-k, k))
        base = words.select("id", "n", F.col(word).alias("word"), text.alias("text"), size.alias("size"))
        lengths = F.array_distinct(F.array(*[routed(_exact(size + d, side)) for d in (-1, 0, 1)]))
        entries.append(base.withColumn("k", F.explode(lengths)).where("k > 0").withColumn("key", key(F.col("k"))).select("key", F.lit(number).alias("side"), "text", "word", "n"))
        searches.append(base.withColumn("exact", _exact(F.col("size"), side).cast("int"))
                        .withColumn("key", key(routed(F.col("exact")))).select("key", F.lit(number).alias("side"), "id", "text", "exact"))
    entries, searches = entries[0].unionByName(entries[1]), searches[0].unionByName(searches[1])
    buckets = max(1, -(-scalar(entries.agg(F.count("*")))[0] // index_words))
    bucket = (2 * F.pmod(F.col("key"), F.lit(buckets)) + F.col("side")).alias("bucket")
    # What one bucket holds too much of is dealt to several indexes; a row per bucket says to how many.
    parts = staged(entries.groupBy(bucket).agg(F.ceil(F.count("*") / (2 * index_words)).cast("int").alias("parts")))
    indexed = (entries.select("*", bucket).join(parts, "bucket")
               .select("bucket", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), "text", "word", "n"))
    asked = (searches.select("*", bucket).join(parts, "bucket")
             .select(F.col("bucket").alias("to"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), "id", F.col("text").alias("asked"), "exact"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, near, near_n = [], [], []
        if left.num_rows and right.num_rows:
            held = {t: (w, n) for t, w, n in zip(*(left.column(c).to_pylist() for c in ("text", "word", "n")), strict=True)}
            texts = sorted(held)
            index = FMIndex(texts)
            names = pa.array([held[t][0] for t in texts])
            counts = np.array([held[t][1] for t in texts], np.int64)
            all_ids, exact = right.column("id").to_numpy(), right.column("exact").to_numpy().astype(np.int64)
            for at in range(0, right.num_rows, _SEARCHES):
                a, b = index.within_one(right.column("asked").slice(at, _SEARCHES).to_pylist(), exact[at:at + _SEARCHES])
                ids.append(all_ids[at + a])
                near.append(names.take(pa.array(b)))
                near_n.append(counts[b])
        return pa.table({"id": pa.array(np.concatenate(ids) if ids else [], pa.int64()), "near": pa.chunked_array(near, pa.string()),
                         "near_n": pa.array(np.concatenate(near_n) if near_n else [], pa.int64())})

    return (indexed.groupBy("bucket", "part").cogroup(asked.groupBy("to", "slice"))
            .applyInArrow(search, "id bigint, near string, near_n bigint").repartition("id").distinct())


def roots(links: DataFrame, word: str = "word", form: str = "form") -> DataFrame:
    """(word, root) for each row of ``links``: the last word on its chain of forms, by steps that double. The driver sees one
    flag a round; chains must not be circles (here counts at least double along them)."""
    now = staged(links.select(F.col(word).alias("word"), F.col(form).alias("root")))
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = staged(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count()
        drop_staged(now)
        now = after.select("word", "root")
        now._staged_path = after._staged_path
        if not moved:
            return now


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 5, least: int = 3, times: int = 2, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of ``df``.

    ``form`` is the near word with the largest n, ties to the smallest word, where that is at least ``times`` the word's own;
    ``root`` is the end of the chain of forms, the word itself where it has none. Repeated rows count each time; an empty
    table, or one without texts, has no words. ``times`` must be more than 1.
    """
    words = staged(vocabulary(occurrences(df, key, text), "word", length, least).withColumn("id", F.monotonically_increasing_id()))
    best = (near_words(words, **options).groupBy("id")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")))
    known = F.coalesce(-F.col("best.m") >= times * F.col("n"), F.lit(False))
    found = staged(words.join(best, "id", "left").select(
        "word", F.when(known, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(known, -F.col("best.m")).alias("form_n")))
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
