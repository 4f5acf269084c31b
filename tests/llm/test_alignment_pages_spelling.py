"""Token alignment, main text of pages and spelling variants against plain Python."""

import hashlib
import html
import re
import zlib
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from newsgauge.llm import bpe, crosstoken, spelling, wrappers

SF = "/root/testdata/sf0.001"
RANKS, JSON, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "  ", "a  b", "a  b", "a   b", "x▁y", "<|endoftext|> hi <0x0A> </s> <s>", "\n\n a\n  b\t c", "日本語 テキスト😀 é é", "a\r\nb \r\n c",
       " lead", "trail  ", "a　  b", "\x1c a", "ﬁ ½ Ⅷ", "a\x00b", "​ x", "the " * 3000, "y" * 5000, "same text", "same text"]


def aligned_by_hand(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(JSON)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = bpe.byte_letters()
    rows, count = [], Counter()

    def spans(pieces):
        out, at = [], 0
        for i, b in pieces:
            out.append((i, at, at + len(b)))
            at += len(b)
        return out

    for key, text in docs:
        want = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in second.encode(text or "") for p in [second.id_to_piece(i)]]
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            rows.append((key, 0, 0, 0, 0, "", []))
            continue
        a, b = spans(a), spans(b)
        owner = {}
        for j, (_, lo, hi) in enumerate(b):
            owner.update(dict.fromkeys(range(lo, hi), j))
        links = [(i, b[j][0]) for i, lo, hi in a for j in range(owner[lo], owner[hi - 1] + 1)]
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, lo, hi in side if low < hi <= cut) for side in (a, b)) if len(a) < 300 else None)
            low = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None
        rows.append((key, len(a), len(b), len(cuts), len(links), digest, links))
        count.update(set(links))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return [(*r[:6], sum(count[x] == most[x[0]] for x in r[6]), sum(count[x] for x in r[6])) for r in rows]


def test_alignment(spark):
    given = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()[:60]
    docs = [(r["doc_id"], r["text"]) for r in given] + [(None if i == 4 else 10**9 + i, x) for i, x in enumerate(ODD)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, pairs string, _row int").repartition(3)
    want = sorted(map(str, aligned_by_hand(docs)))
    for path, size in ((RANKS, 1 << 20), (JSON, 1500)):  # one slice of counts, and several
        got = crosstoken.align_corpus(df, path, PIECES, public_tokenizers.PATTERN, slice_pairs=size).collect()
        rows = {str(r[0]): (*r[:5], r.groups_sha256, r.n_best, r.count_sum) for r in got}
        known = {w.split(",")[0][1:]: w for w in want}
        assert len(got) == len(docs)
        for key, row in rows.items():
            text = str(row)
            assert text == known[key] or (", None, " in known[key] and str((*row[:5], None, *row[6:])) == known[key])
    assert crosstoken.align_corpus(df.limit(0), RANKS, PIECES, public_tokenizers.PATTERN).count() == 0
    spelled = crosstoken.align(df, RANKS, PIECES, public_tokenizers.PATTERN, spell=True).collect()
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in spelled)


def test_pages_given(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got = {r.page_id: r.text for r in wrappers.extract(spark.read.parquet(f"{SF}/pages.parquet").repartition(20)).collect()}
    for page in pages:
        inner = page["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[page["page_id"]] == "\n".join(x for x in blocks if x)


def made_page(i, extra=""):
    return (f'<html><body class="has-sidebar"><div><ul><li><a href=/>Home</a><li><a href=/b>About {i}</a></ul></div><div class="cookie-bar">We use cookies {i}</div>'
            f"<div><h1>Title {i}</h1><p>Body text of {i} is long and has <i>many</i> words &lt;b&gt; here.<p>Subscribe to us today!"
            f'<p>Second para {i * 7} more words&nbsp;and so on.<span class="ad">buy</span> end <div class="share">x</div></div>{extra}'
            f'<div id="comments"><p>nice {i}</div><div>All rights reserved</div><aside>{i}</aside><script>var a="<p>no"</script></body></html>')


@pytest.mark.parametrize("fan_in", [2, 16])
def test_pages_without_article(spark, fan_in):
    rows = [(i, "http://u@A.example:80/x", made_page(i)) for i in range(40)] + [(40, "http://a.example", None), (40, None, ""), (None, "b", "<p>a<br>b<p>c")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, wrapper string").repartition(7)
    pages = df.select("url", "html").withColumnRenamed("html", "page").withColumn("host", wrappers.host_of("url"))
    assert {r.host for r in wrappers.induce(pages, "host", "page", fan_in).collect()} == {"a.example", ""}
    got = {(r.page_id, r.url): r.text for r in wrappers.extract(df).collect()}
    for i in range(40):
        assert got[i, rows[i][1]] == f"Title {i}\nBody text of {i} is long and has many words <b> here.\nSecond para {i * 7} more words and so on. end"
    assert got[40, "http://a.example"] == got[40, None] == "" and got[None, "b"] == "a b\nc"
    assert wrappers.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("held", [100_000, 50])
def test_constant_texts_are_counted_exactly(spark, monkeypatch, held):
    """A text on 170 of 200 pages of its place is template, one on 169 is not, whatever the number of other texts there."""
    monkeypatch.setattr(wrappers, "_TEXTS_HELD", held)
    rows = [(i, "http://a/", "<div>" + "<p>On 170" * (i < 170) + "<p>On 169" * (i < 169) + "".join(f"<p>Own text {k} of page {i}" for k in range(30)) + "</div>")
            for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for r in wrappers.extract(df).collect():
        assert r.text == "\n".join(["On 169"] * (r.page_id < 169) + [f"Own text {k} of page {r.page_id}" for k in range(30)])


def test_rare_blocks_are_kept_in_the_wrapper(spark):
    """Of 400 pages, each with a block of another name, three have one whose text is the same on all three."""
    def name(i):
        return "q" + "".join(chr(97 + i // 26**k % 26) for k in range(2))

    rare = {0: 1, 130: 2, 390: 3}
    rows = [(i, "http://a/", f'<div class="{name(i)}"><p>Own text of page {i}</div>' + (f'<div class="zz"><p>On three pages<p>Not so {i}</div>' if i in rare else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert got == {i: f"Own text of page {i}" + (f"\nNot so {i}" if i in rare else "") for i in range(400)}


def test_copied_pages_keep_their_text(spark):
    page = "<body><nav>m</nav><article><h1>T</h1><p>All pages say this.</p></article>"
    df = spark.createDataFrame([(i, "http://a/", page) for i in range(50)], "page_id long, url string, html string")
    assert {r.text for r in wrappers.extract(df).collect()} == {"T\nAll pages say this."}


def test_pages_parsed():
    text = wrappers.content
    assert text("<div class=sidebar><article><header><h1>T</h1></header><p>a<br>b</article></div><p>no") == "T\na b"
    assert text("<p>a<p>b<table><tr><td>c<td>d</table><script>x</p>") == "a\nb\nc\nd"
    assert text("<div>" * 5000 + "x" + "</div>" * 5000 + "y") == "x\ny" and text("") == text("<!-- a") == ""
    assert text("just & text &eacute; &#65;<form>f<input></form> z") == "just & text é A\nz"
    assert text('<ul><li>a<ul><li>b</ul><li class="x" title="a>b">c</ul>') == "a\nb\nc"
    tree = wrappers.skeleton(wrappers.parse("<div><p>a<p>b</div><div><p>c</div><div><ul><li>x</ul><section>y</section></div>"))
    assert len(tree[wrappers._CHILDREN]) == 2  # the first two are folded
    assert wrappers.matching(tree, tree) == wrappers._size(tree) and wrappers.similarity(tree, wrappers.skeleton(wrappers.parse("x"))) < 0.5


def variants_by_hand(docs, length=5, least=3):
    count, lower = Counter(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for key, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            count[word] += 1
    words = {w: n for w, n in count.items() if len(w) >= length and n >= least}
    cuts = {}
    for w in words:
        for i in range(len(w)):
            cuts.setdefault(w[:i] + w[i + 1:], set()).add(w)
    near = {}
    for w in words:
        found = set(cuts.get(w, ()))
        for i in range(len(w)):
            cut = w[:i] + w[i + 1:]
            found |= {cut} & words.keys() | {x for x in cuts.get(cut, ()) if len(x) == len(w) and sum(a != b for a, b in zip(x, w, strict=True)) == 1}
        near[w] = found - {w}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


@pytest.mark.parametrize("options", [{}, {"index_words": 50, "route": 2}])
def test_variants(spark, options):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    docs += [(None, "Straße Strasse straße ÀÉÿ÷× aaaaa aaaaaa aaaa"), (None, None), (1, ""), (7, "z" * 3000 + " " + "z" * 2999), *[(5, "aaaaa aaaaaa bbaaaa aabaaa")] * 4,
             *[(6, "z" * 3000 + " " + "z" * 2999)] * 3]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(5)
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **options).collect())
    assert got == variants_by_hand(docs)
    assert spelling.variants(df.limit(0), **options).count() == 0 and spelling.variants(df.where("text IS NULL"), **options).count() == 0


def test_index_of_one_letter():
    words = ["a" * n for n in range(3, 60)]
    a, b = spelling.FMIndex(words).within_one(words, spelling.np.array([len(w) // 2 for w in words]))
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == {(i, i + d) for i in range(57) for d in (-1, 1) if 0 <= i + d < 57}
