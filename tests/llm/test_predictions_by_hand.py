"""Language prediction and quality scores of single documents, worked out again in plain Python from the fitted model."""

import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from newsgauge.llm import cotrain, langid

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), pq.read_table(f"{SF}/documents.parquet").to_pylist()


def grams(text):
    """Cells of the two- and three-byte grams; a byte that is no letter counts as a blank, and grams of blanks do not count."""
    kept = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    out = Counter()
    for size, factor in ((2, 2654435769), (3, 2246822519)):
        for i in range(len(kept) - size + 1):
            gram = kept[i:i + size]
            if gram != b" " * size:
                out[int.from_bytes(gram, "big") * factor % 2**32 >> 20] += 1
    return out


def test_language_by_hand(spark, documents):
    df, rows = documents
    model = langid.fit(df)
    got = {r.doc_id: r.language for r in langid.identify(df.select("doc_id", "text"), model).collect()}
    for r in rows:
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert got[r["doc_id"]].lang_pred == "und"
            continue
        cells = grams(text)
        vector = {c: math.log1p(n) * float(model.idf[c]) for c, n in cells.items()}
        norm = math.sqrt(math.fsum(x * x for x in vector.values()))
        cosines = [math.fsum(x / norm * float(row[c]) for c, x in vector.items()) for row in model.centroids]
        best = max(cosines)
        assert got[r["doc_id"]].score == pytest.approx(min(max(best, 0), 1), abs=1e-4)
        near = {model.languages[i] for i, x in enumerate(cosines) if x > best - 1e-4}
        assert got[r["doc_id"]].lang_pred in near
        bucket = min(int(math.log2(max(sum(cells.values()), 1))), 40)
        lowest = {model.lowest[i, bucket] for i, x in enumerate(cosines) if x > best - 1e-4}
        if all(abs(best - x) > 1e-3 for x in lowest):
            assert got[r["doc_id"]].rejected == all(best < x for x in lowest)


def test_quality_by_hand(spark, documents):
    """The combined score follows from the two views by their odds over the prior, and the kept flag from the score."""
    df, _ = documents
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = cotrain.fit(df, labels)
    assert model.usable
    got = cotrain.classify(df, model, into="q").select("doc_id", "q.*").collect()
    assert len(got) == df.count() and all(0 <= x <= 1 for r in got for x in (r.text_prob, r.meta_prob, r.score))
    assert all(r.kept == (r.score >= 0.5) for r in got)
    logit = lambda p: math.log(p / (1 - p))
    rows = [(logit(r.text_prob), logit(r.meta_prob), logit(r.score)) for r in got if all(1e-9 < x < 1 - 1e-9 for x in (r.text_prob, r.meta_prob, r.score))]
    assert len(rows) > 10
    # score's log odds = text's + metadata's - the prior's: the difference is the same for every document
    rest = np.array([c - a - b for a, b, c in rows])
    assert np.ptp(rest) < 1e-6
