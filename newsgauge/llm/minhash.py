"""Near-duplicate documents by fast similarity sketching.

A sketch has ``bins`` coordinates. In round i every shingle of a set is thrown into one bin with the value (i, hash); a bin
keeps its least value, so a bin filled in a round is not changed by later ones, and rounds end when all are full. After
``bins`` rounds each round fills the one bin of its number from all shingles, so every coordinate fills, whatever the
size of the set; two sets agree in each coordinate with a probability equal to their similarity, and the share of equal
coordinates is concentrated like that of independent draws. Rows of coordinates make bands; documents that share a band
are candidates, and candidates are verified on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsgauge.llm import bytewords
from newsgauge.llm.components import components
from newsgauge.session import drop_staged, staged

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_LOW = _U((1 << 40) - 1)
#: Bands of up to so many documents are compared by joins, larger ones in blocks.
_SMALL_BAND = 32
#: Tasks that the documents of one set are dealt to.
_SALT_PARTS = 16
_SALTS = (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))


def sketch(shingles: np.ndarray, bins: int = 512) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit shingle hashes: per bin the round and the top bits of the least hash."""
    out = np.full(bins, ~_U(0))
    n, at = len(shingles), 0
    with np.errstate(over="ignore"):
        while at < bins:
            rounds = np.arange(at, min(bins, at + max(1, 2048 // n)), dtype=np.uint64)[:, None]
            thrown = bytewords.mix(shingles + (rounds + _U(1)) * _STEP)
            place = ((thrown >> _U(32)) * _U(bins)) >> _U(32)
            np.minimum.at(out, place.ravel().astype(np.int64), ((rounds << _U(40)) | (bytewords.mix(thrown) & _LOW)).ravel())
            at += len(rounds)
            if not (out == ~_U(0)).any():
                return out
        for empty in np.flatnonzero(out == ~_U(0)).tolist():  # the round of this bin takes every shingle
            own = _U(bins + empty)
            out[empty] = (own << _U(40)) | (bytewords.mix(bytewords.mix(shingles + (own + _U(1)) * _STEP)) & _LOW).min()
    return out


def bands(sketches: np.ndarray, rows: int = 8) -> np.ndarray:
    """One key for each band of ``rows`` coordinates; the number of the band is part of it."""
    x = sketches.reshape(-1, rows)
    key = bytewords.mix(np.arange(len(x), dtype=np.uint64) + _U(77))
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = bytewords.mix(key * _U(0x9FB21C651E98DF25) + x[:, k])
    return key


def _sketched(docs: DataFrame, words: int, bins: int, rows: int) -> DataFrame:
    """(id, n, a, b, bands): size of the shingle set, two independent hashes of the set, keys of its bands."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in bytewords.groups(batch.column(1)):
                sets = bytewords.distinct_shingles(group.lowered(), words)
                with np.errstate(over="ignore"):
                    a, b = (np.array([bytewords.mix(s ^ salt).sum(dtype=np.uint64) for s in sets], np.uint64) for salt in _SALTS)
                keys = [bands(sketch(s, bins), rows) if len(s) else np.zeros(0, np.uint64) for s in sets]
                edges = np.cumsum([0, *(len(k) for k in keys)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, group.n), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))],
                    names=["id", "n", "a", "b", "bands"])
                at += group.n
    return docs.mapInArrow(of, "id bigint, n bigint, a bigint, b bigint, bands array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the sorted shingle set of each text as packed 64-bit values."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in bytewords.groups(batch.column(1)):
                sets = bytewords.distinct_shingles(group.lowered(), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, group.n), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["id", "shingles"])
                at += group.n
    return docs.mapInArrow(of, "id bigint, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the (u, v) ``pairs`` whose full sets have 100 * intersection >= percent * union."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(check, "u bigint, v bigint")


def _bitmap(shingles: np.ndarray) -> bytes:
    """One bit for each shingle, in some 16 bits a shingle, 512 to 2**15 bits."""
    bits = np.zeros(1 << min(15, max(9, (16 * len(shingles) - 1).bit_length())), np.uint8)
    bits[(shingles & _U(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _possible(inside: DataFrame, sets: DataFrame, percent: int, block: int = 4096) -> DataFrame:
    """The pairs (u, v) of a band and of different labels, one of them not of the band's largest label, that bitmaps of their sets
    leave possible.

    A bit of one bitmap that the other lacks is a shingle the other lacks, so the bound on the intersection is sure and no
    pair at ``percent`` is lost; what it rules out is never made a row. Both sides of a band are cut into blocks.
    """
    ids = inside.select("id").distinct()

    def to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_bitmap(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column(1)], pa.binary())],
                                             names=["id", "bits"])

    bits = staged(sets.join(ids, "id", "left_semi").mapInArrow(to_bits, "id bigint, bits binary"))
    rows = inside.withColumns({"ni": F.ceil(F.col("size") / block).cast("int"), "nj": F.ceil(F.col("few") / block).cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    place = lambda n: F.pmod(F.hash("id"), n)
    all_ = rows.select("band", place(F.col("ni")).alias("i"), every(F.col("nj")).alias("j"), F.lit(False).alias("few"), "id", "n", "label")
    odd = rows.where("label <> largest").select("band", every(F.col("ni")).alias("i"), place(F.col("nj")).alias("j"), F.lit(True).alias("few"), "id", "n", "label")

    def compare(table: pa.Table) -> pa.Table:
        few = table.column("few").to_numpy(zero_copy_only=False)
        id_, n, label = (table.column(c).to_numpy() for c in ("id", "n", "label"))
        maps = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("bits")]
        width = np.array([len(m) for m in maps])
        others = {w: (at, np.stack([maps[k] for k in at])) for w in np.unique(width[~few]) for at in [np.flatnonzero(~few & (width == w))]}
        folded = {}
        out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        for k in np.flatnonzero(few):
            for w, (at, block_) in others.items():
                common = min(w, width[k])
                near = (label[at] != label[k]) & (100 * np.minimum(n[at], n[k]) >= percent * np.maximum(n[at], n[k]))
                if not near.any():
                    continue
                if (w, common) not in folded:
                    folded[w, common] = np.bitwise_or.reduce(block_.reshape(len(at), -1, common), axis=1)
                y, x = folded[w, common][near], np.bitwise_or.reduce(maps[k].reshape(-1, common), axis=0)
                m, mine = n[at][near], int(n[k])
                most = np.minimum(mine - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
                hit = id_[at][near][100 * most >= percent * (m + mine - most)]
                out.append(np.stack([np.minimum(hit, id_[k]), np.maximum(hit, id_[k])], 1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table({"u": found[:, 0], "v": found[:, 1]})

    return all_.union(odd).join(bits, "id").groupBy("band", "i", "j").applyInArrow(compare, "u bigint, v bigint")


def _labelled(df: DataFrame, labels: DataFrame, column: str, into: str) -> DataFrame:
    """``into``: the component of ``column``; a node without links is its own."""
    named = labels.select(F.col("node").alias(column), F.col("label").alias("_label"))
    return df.join(named, column, "left").withColumn(into, F.coalesce("_label", column)).drop("_label")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 2, percent: int = 80,
                    bins: int = 512, rows: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``df``.

    Texts are lower-cased in A-Z; words are split at blanks. Two documents are linked if their sets of ``words``-word
    shingles have a similarity of ``percent`` or more; a component's id is its smallest ``key``. With 64 bands of 8 a pair
    at 0.8 is missed with a probability below 1e-5. A text without words, empty or null, has no shingles and is linked with
    nothing. A row without key is its own group (component null, kept). Rows that repeat a key are one document, linked
    by any of its texts.

    No pair within a group of copies is listed: equal sets are joined to their smallest key first, and a document's
    candidates are the smallest documents of its bands. Only where documents in a band still lie in different components
    after that are they compared across those components, so that no link between different texts is lost.
    """
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    all_ = staged(_sketched(docs, words, bins, rows))
    known = all_.where(F.col("id").isNotNull() & (F.col("n") > 0))

    copies = known.groupBy("a", "b", "n").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    # A set that very many documents have is dealt to several tasks.
    spread = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT_PARTS - 1))))
    same = staged(known.select("id", "a", "b", "n", F.pmod(F.xxhash64("id"), F.lit(_SALT_PARTS)).cast("int").alias("salt"))
                  .join(spread, ["a", "b", "n", "salt"]).where("id > first")
                  .select(F.col("first").alias("u"), F.col("id").alias("v"), "a", "b", "n").distinct())
    one = ["id", "a", "b", "n"]  # a text of an id: its others stay when it goes
    single = known.join(same.select(F.col("v").alias("id"), "a", "b", "n"), one, "left_anti").dropDuplicates(one)
    same = same.select("u", "v").distinct()
    member = single.select("id", "n", F.explode("bands").alias("band"))
    shared = (member.groupBy("band").agg(F.min(F.struct("id", "n")).alias("lead"), F.max("id").alias("last"))
              .where(F.col("lead.id") < F.col("last")).select("band", "lead"))
    members = staged(member.join(shared, "band"))

    def close(n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    stars = staged(members.where((F.col("id") > F.col("lead.id")) & close(F.col("n"), F.col("lead.n")))
                   .groupBy(F.col("lead.id").alias("u"), F.col("id").alias("v")).agg(F.count("*").alias("shared")))
    wanted = members.select("id").distinct()
    # Of the rows of a repeated id one for each different text: what is verified is sets, not copies of them.
    again = staged(known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    asked = docs.join(wanted, "id", "left_semi")
    sets = staged(_sets(asked.join(again, "id", "left_anti").unionByName(asked.join(again, "id", "left_semi").dropDuplicates(["id", "text"])), words))

    # The likeliest pair of each document first: most others then lie within a component and need no check.
    first = stars.groupBy("v").agg(F.max(F.struct("shared", -F.col("u"))).alias("best")).select((-F.col("best.col2")).alias("u"), "v")
    links = staged(_verified(first, sets, percent).union(same))
    labels = components(links)

    rest = stars.select("u", "v").join(first, ["u", "v"], "left_anti")
    rest = _labelled(_labelled(rest, labels, "u", "cu"), labels, "v", "cv").where("cu <> cv")
    more = staged(_verified(rest.select("u", "v"), sets, percent))
    if more.limit(1).count():
        links = links.union(more)
        labels = components(links)

    # Bands with members of several components: all of the smaller ones against the members of the others.
    placed = staged(_labelled(members.select("band", "id", "n"), labels, "id", "label"))
    by_label = placed.groupBy("band", "label").agg(F.count("*").alias("size"))
    mixed = (by_label.groupBy("band").agg(F.max(F.struct("size", "label")).alias("largest"), F.sum("size").alias("size"), F.count("*").alias("labels"))
             .where("labels > 1").select("band", "size", F.col("largest.label").alias("largest"), (F.col("size") - F.col("largest.size")).alias("few")))
    inside = staged(placed.join(mixed, "band"))
    small = inside.where(F.col("size") <= _SMALL_BAND)
    few = small.where("label <> largest").select("band", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("label").alias("xl"))
    pairs = (small.join(few, "band").where((F.col("label") != F.col("xl")) & close(F.col("n"), F.col("xn")))
             .select(F.least("id", "x").alias("u"), F.greatest("id", "x").alias("v")))
    large = inside.where(F.col("size") > _SMALL_BAND)
    across = (pairs.union(_possible(large, sets, percent)).distinct().join(stars, ["u", "v"], "left_anti"))
    last = staged(_verified(across, sets, percent))
    if last.limit(1).count():
        labels = components(links.union(last))
    drop_staged(members, stars, sets, placed, inside)
    out = _labelled(all_.select("id", "n"), labels, "id", "component_id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
