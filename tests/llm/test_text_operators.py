"""Language ID, divergence rules, near duplicates, packing and co-training against plain Python."""

import base64
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsgauge.llm import bpe, bytewords, cotrain, divergence, langid, minhash, packing
from newsgauge.llm.queries import vocabulary
from newsgauge.session import scratch_path, staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _m string, quality string"
RNG = np.random.default_rng(5)
VOCABULARY = {lang: ["".join(RNG.choice(list(letters), RNG.integers(2, 8))) for _ in range(300)]
              for lang, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"), ("cc", "éèuvwxyz"))}


ZIPF = 1 / np.arange(1, 301)
ZIPF /= ZIPF.sum()


def prose(lang, n):
    return " ".join(RNG.choice(VOCABULARY[lang], n, p=ZIPF))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(lang, 60 + i % 50), lang, f"s{i % 3}", i) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    base = prose("aa", 200).split()
    rows += [(200 + i, " ".join(base[:i] + ["zz"] + base[i + 1:]), "aa", "s0", 1) for i in range(30)]  # near copies
    rows += [(300 + i, " ".join(base), "aa", "s0", 1) for i in range(30)]  # copies
    rows += [(400, None, "aa", None, None), (401, "", None, "s1", 0), (402, "   \n", "bb", "s1", 4), (403, "one", "aa", "s1", 3),
             (404, "12 34 !!", None, "s1", 8), (405, "ONE", "aa", "s1", 3), (None, prose("bb", 40), "bb", "s2", 5),
             (None, None, None, None, None), (406, prose("cc", 30_000), "cc", "s2", 9), (407, "x " * 300, "aa", "s0", 600)]
    rows += [rows[3]] * 5  # repeated rows
    return spark.createDataFrame([(*r, "m", "q") for r in rows], SCHEMA).repartition(4).cache()


def words(text):
    return WORD.findall(text or "")


def test_spans(docs):
    texts = [r.text for r in docs.collect()]
    import pyarrow as pa
    at = 0
    for group in bytewords.groups(pa.array(texts, pa.string())):
        starts, ends, counts = group.words()
        sets = bytewords.distinct_shingles(group, 2)
        for k, n in enumerate(counts):
            w = words(texts[at])
            assert n == len(w)
            assert len(sets[k]) == (len(set(zip(w, w[1:], strict=False))) if len(w) > 1 else len(w))
            at += 1
    assert at == len(texts)


def test_language(docs, spark):
    model = langid.fit(docs)
    got = langid.identify(docs, model).select("doc_id", "text", "lang", "language.*", "_m").collect()
    assert {r._m for r in divergence.judge(docs, divergence.references(docs), into="found").collect()} == {"m"}
    assert len(got) == docs.count()
    for r in got:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert 0 <= r.score <= 1 and r.lang_pred in ("aa", "bb", "cc")
            if r.lang and len(words(r.text)) > 20 and r.doc_id != 407:
                assert r.lang_pred == r.lang and not r.rejected
    nothing = langid.fit(docs.limit(0))
    assert {r.language.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_divergence(docs):
    refs = divergence.references(docs)
    got = divergence.judge(docs, refs, into="found").collect()
    assert len(got) == docs.count() and refs.languages == ["aa", "bb", "cc"]
    for r in got:
        f, text = r.found, r.text or ""
        w, seen, lines = words(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(covered))
        assert f.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert f.kept <= (not f.base_failed) and 0 <= f.js_chars <= 1 and 0 <= f.js_words <= 1
        if r.lang and not f.base_failed and len(w) > 50:
            assert f.kept
    empty = divergence.references(docs.limit(0))
    assert {r.found.js_chars for r in divergence.judge(docs, empty, into="found").collect()} == {0.0}


def test_divergence_rejects_other_classes(spark, docs):
    refs = divergence.references(docs)
    odd = spark.createDataFrame([(1, " ".join(f"{w.upper()}!!" for w in prose("aa", 200).split()), "aa"), (2, prose("aa", 200), "aa")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.quality.kept for r in divergence.judge(odd, refs).collect()} == {1: False, 2: True}


def brute_groups(rows, percent=80):
    """Component of each id by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.setdefault(i, []).append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j] if a and b):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i][0]), root(i)) for i in ids}


def test_near_duplicates(docs):
    got = minhash.near_duplicates(docs).collect()
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def brute_kept(rows, words_=5, percent=80):
    """Ids that stay: the smallest of every group of texts linked by shingles of ``words_`` words."""
    sets = {i: {tuple(w[k:k + words_]) for k in range(max(1, len(w) - words_ + 1))} if (w := words((text or "").lower())) else set() for i, text in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if label[i] != label[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    return sorted(i for i, x in label.items() if i == x)


def test_near_duplicates_stage(spark):
    """Five words a shingle: texts with 4 in 100 words edited stay, those with 1 in 100 go."""
    rng, rows = np.random.default_rng(8), [(900, None), (901, ""), (902, "one"), (903, "One"), (904, "two words")]
    for i in range(8):
        base = prose("aa", 200).split()
        for k, edits in enumerate((0, 0, 2, 8, 8)):
            w = list(base)
            for at in rng.choice(np.arange(5, 195, 10), edits, replace=False):
                w[at] = f"y{rng.integers(1_000_000)}"
            rows.append((10 * i + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_kept(rows)
    assert len(want) > len(brute_kept(rows, 2)) and len(want) < len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_large_mixed_bands(spark, monkeypatch):
    """Copies with different numbers of edits: some linked, some just not, all in the same bands."""
    base = prose("aa", 120).split()
    rows = []
    for i in range(80):
        w = list(base)
        for j in RNG.choice(120, RNG.integers(2, 16), replace=False):
            w[j] = f"y{RNG.integers(1_000_000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "_SMALL_BAND", 4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows)


def test_sketch_is_full_and_close():
    a = RNG.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], RNG.integers(0, 2**63, 100, dtype=np.uint64)])
    same = (minhash.sketch(np.sort(a)) == minhash.sketch(np.sort(b))).mean()
    assert abs(same - 900 / 1100) < 0.1
    for n in (1, 2, 7):
        assert (minhash.sketch(a[:n]) != ~np.uint64(0)).all()


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    got = packing.pack_documents(docs, vocabulary(), group_rows=40, fan_in=2).toPandas()
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert Counter(rows) == want
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    fill = got.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 4096 and len(fill) <= 1.1 * got["length"].sum() / 4096 + 2
    assert packing.pack_documents(docs.limit(0), vocabulary()).count() == 0


@pytest.mark.parametrize("text", ["", "It's we'll DON'T", "a\x1cb", "x y z", "İstanbul ΣΑΣ. É é", "<|endoftext|> a<|startoftext|>b", "...",
                                  "a... b!? 12.5, abc.", "s.'s", "中文。字", "ﬁ ǅ ß ẞ", "x.̸ y", "naïve, café.", "don't. Won't!"])
def test_encoder_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids
    encoder = packing._Encoder(vocabulary())
    for _ in range(2):
        assert np.frombuffer(encoder.text(text), "<u4").tolist() == want


def test_merges_equal_the_tokenizer():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyzABCÉÀèßÿ .,!?-0123456789\n\t×'|…é_#$")
    texts = ["", " ", "aaaaaaaaaaaaaaa", " ÀÉÿ÷", "a×b", "x1234.5,", "Z" * 300, " ?!?... ", "don't", "<|endoftext|>"]
    texts += ["".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(vocabulary())
    covered, ids, sizes = bpe.Merges(vocabulary()).segments(pa.array(["skipped", *texts]).slice(1))
    ends = np.cumsum(sizes)
    got = [ids[a:b].tolist() for a, b in zip(ends - sizes, ends, strict=True)]
    assert got == [tokenizer.encode(x, add_special_tokens=False).ids for x, c in zip(texts, covered, strict=True) if c]
    assert covered.sum() > 1000 and not covered[[4, 8, 9]].any()


@pytest.mark.parametrize("sizes", ["1400 + id % 1700", "2600 + id % 900", "1 + id % 4095", "2049"])
def test_packing_in_groups_loses_little(spark, sizes):
    items = staged(spark.range(3000).select(F.col("id").alias("item"), F.expr(sizes).cast("bigint").alias("size")))
    alone = packing.pack(items, "item", "size").toPandas()
    grouped = packing.pack(items, "item", "size", group_rows=300, fan_in=3).toPandas()
    assert len(grouped) == len(alone) == 3000
    assert grouped["sequence_id"].nunique() <= 1.05 * alone["sequence_id"].nunique()


def test_co_training(spark):
    good = [(i, prose("aa", 80), "aa", f"s{i % 5}", 500) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{w.upper()}!!" for w in prose("aa", 80).split()), "aa", "spam", 50) for i in range(100)]
    odd = [(5000, None, None, None, None), (5001, "", "aa", "s1", 0), (None, "x", "aa", "s1", 1), good[0], good[0]]
    df = spark.createDataFrame([(*r, "m", "q") for r in good + bad + odd], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 3)] + [(1000 + i, 0) for i in range(0, 100, 3)] + [(None, 1), (7, None), (9999, 1), (0, 1)],
                                   "doc_id long, quality int")
    model = cotrain.fit(df, labels)
    got = cotrain.classify(df, model, into="found").select("doc_id", "found.*").collect()
    assert len(got) == df.count()
    right = [r.kept == (r.doc_id < 1000) for r in got if r.doc_id is not None and r.doc_id < 5000]
    assert np.mean(right) > 0.98 and all(0 <= r.score <= 1 for r in got)
    for few in (labels.limit(0), labels.where("quality = 1")):
        plain = cotrain.fit(df, few)
        assert not plain.usable and len({r.found.score for r in cotrain.classify(df, plain, into="found").collect()}) == 1


def test_language_rejects_what_no_language_has(spark):
    """Gibberish and unlearned scripts go at all lengths, clean texts stay, though some of the labelled texts are junk."""
    rng = np.random.default_rng(3)

    def text(kind, n):
        if kind in VOCABULARY:
            return " ".join(rng.choice(VOCABULARY[kind], n, p=ZIPF))
        if kind == "base64":
            return " ".join(base64.b64encode(rng.bytes(6)).decode() for _ in range(n))
        low, high = {"letters": (97, 123), "cyrillic": (0x430, 0x450), "greek": (0x3B1, 0x3CA)}[kind]
        return " ".join("".join(map(chr, rng.integers(low, high, rng.integers(2, 9)))) for _ in range(n))

    rows = [(i, text(lang, 40 + i % 200), lang) for i, lang in enumerate([*VOCABULARY] * 400)]
    rows += [(2000 + i, text(kind, 60), lang) for i, (lang, kind) in enumerate((lang, kind) for lang in VOCABULARY for kind in ("base64", "letters"))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(kind, n, text(kind, n)) for kind in (*VOCABULARY, "base64", "letters", "cyrillic", "greek") for n in (8, 20, 100, 300, 1000) for _ in range(10)]
    got = langid.identify(spark.createDataFrame(asked, "kind string, n int, text string"), model).select("kind", "n", "language.*").collect()
    assert [(r.kind, r.n, r.score) for r in got if r.rejected == (r.kind in VOCABULARY)] == []
    assert {(r.kind, r.lang_pred) for r in got if r.kind in VOCABULARY} == {(x, x) for x in VOCABULARY}


def test_language_weights_cover_all_rows(spark):
    """Document frequencies of the whole corpus, though the sample has about as many texts of each language."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(VOCABULARY["bb" if i % 10 == 0 else "aa"], 30)), "bb" if i % 10 == 0 else "aa") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    found = sum((block > 0).sum(0) for group in bytewords.groups(pa.array([r[1] for r in rows])) for block in langid.counts(group))
    assert model.idf == pytest.approx(np.log(401 / (1 + found)) + 1, rel=1e-6)


def test_repeated_ids_with_different_texts(spark):
    """A text of a repeated id keeps its links though another text of the id is a copy; different texts of a kept id stay."""
    rng = np.random.default_rng(6)
    a, b, c = (" ".join(rng.choice(VOCABULARY[lang], 100)) for lang in VOCABULARY)
    rows = [(1, a), (2, a), (2, b), (3, b + " zz"), (4, c), (4, b[:200]), (4, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted(tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted({(1, a), (4, c), (4, b[:200])})


def test_repeated_rows_are_not_compared_with_each_other(spark):
    a, b = prose("aa", 200), None
    b = a + " zz"
    rows = [(1, a)] * 3000 + [(2, b)] * 3000 + [(3, prose("bb", 100))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = {}
    verified = minhash._verified

    def counted(pairs, sets, percent):
        joined = pairs.join(sets.select(F.col("id").alias("u")), "u").join(sets.select(F.col("id").alias("v")), "v")
        seen["rows"] = seen.get("rows", 0) + joined.count()
        return verified(pairs, sets, percent)

    minhash._verified = counted
    try:
        got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    finally:
        minhash._verified = verified
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True)} and seen["rows"] <= 2


def test_samples_are_bounded_when_rows_repeat(spark, monkeypatch):
    sizes = []
    means = langid._spherical_means
    text = prose("aa", 60)
    rows = [(1, text, "aa")] * 4000 + [(i, prose("aa", 60), "aa") for i in range(10, 60)] + [(i, prose("bb", 60), "bb") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    usable = df.select("text", "lang", F.xxhash64("doc_id", "text", F.lit(1)).alias("pick"))
    assert usable.select("pick").distinct().count() == 351
    folder = scratch_path(spark, "sizes")

    def noted(x, k, rounds=10, folder=folder.removeprefix("file:")):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        open(f"{folder}/{uuid.uuid4().hex}-{len(x)}", "w").close()
        return means(x, k, rounds)

    monkeypatch.setattr(langid, "_spherical_means", noted)
    model = langid.fit(df, per_language=20)
    import os

    sizes = [int(x.split("-")[1]) for x in os.listdir(folder.removeprefix("file:"))]
    assert set(model.languages) <= {"aa", "bb"} and sizes and max(sizes) <= 40


def test_a_labelled_key_gives_one_row(spark):
    good, bad = prose("aa", 80), " ".join(f"{w.upper()}!!" for w in prose("aa", 80).split())
    rows = [(1, good, "aa", "s", 5, "m", "q")] * 3000 + [(i, good + f" x{i}", "aa", "s", 5, "m", "q") for i in range(2, 60)]
    rows += [(i, bad + f" x{i}", "aa", "t", 5, "m", "q") for i in range(100, 160)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(1, 60)] + [(i, 0) for i in range(100, 160)], "doc_id long, quality int")
    taken = []
    staged_ = cotrain.staged
    cotrain.staged = lambda x: taken.append(staged_(x)) or taken[-1]
    counts = []
    drop = cotrain.drop_staged
    cotrain.drop_staged = lambda *x: (counts.extend(y.count() for y in x), drop(*x))
    try:
        cotrain.fit(df, labels)
    finally:
        cotrain.staged, cotrain.drop_staged = staged_, drop
    assert max(counts) <= 119
