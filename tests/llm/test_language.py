"""Subwords against plain Python, held-out accuracy, calibration, and rows that can't be told."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language_id
from siltstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": "ba be bi bo bu".split(), "bb": "kra kre kri kro kru".split(), "cc": "ßen ßan üln ölm ärt".split()}


def sentence(lang, k, n=30):
    rng = np.random.default_rng(zlib.crc32(f"{lang}{k}".encode()))
    return " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(n))


def plain_subwords(text):
    marked = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return sorted(g for n in (2, 3, 4) for k in range(len(marked) - n + 1) if (g := marked[k : k + n]).strip() and " " not in g[1:-1])


def test_subwords(monkeypatch):
    texts = ["Ab c", "", "12 !", "ÉTÉ-x9y", "a", "日本 語"]
    buckets, owners = language_id.subwords(texts)
    names = {}
    for k, t in enumerate(texts):
        own = plain_subwords(t)
        alone = sorted(language_id.subwords([t])[0].tolist())
        assert sorted(buckets[owners == k].tolist()) == alone and len(alone) == len(own)
        names[t] = own
    assert names["Ab c"] == sorted([" a", "ab", "b ", " c", "c ", " ab", "ab ", " c ", " ab "])
    # a long text in pieces has the subwords of the whole
    text = " ".join(sentence("cc", k) for k in range(9))
    table = np.random.default_rng(1).normal(size=(language_id.BUCKETS, 2))
    whole = language_id._means([text, "ba"], table)
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 50)
    assert len(list(language_id._pieces(text))) > 5
    np.testing.assert_allclose(language_id._means([text, "ba"], table), whole, rtol=1e-12)


def test_rejection_is_calibrated():
    """Accepted rows keep to the risk where a part of the labels can't be learned; strange texts score lower."""
    texts = [sentence(lang, k, 5) for k in range(300) for lang in SYLLABLES]
    labels = [lang for _ in range(300) for lang in SYLLABLES]
    rng = np.random.default_rng(2)
    model = language_id.fit(texts, labels)
    p = model.probabilities([sentence(lang, k, 5) for k in range(1000, 1100) for lang in SYLLABLES])
    assert (np.array(model.languages)[p.argmax(1)] == np.array([*SYLLABLES] * 100)).mean() > 0.99
    # one label of ten is wrong: scores must not promise more than nine of ten
    noisy = [lang if rng.random() > 0.1 else str(rng.choice([x for x in SYLLABLES if x != lang])) for lang in labels]
    model = language_id.fit(texts, noisy)
    p = model.probabilities([sentence(lang, k, 5) for k in range(1000, 1300) for lang in SYLLABLES]).max(1)
    assert 0.82 < p.mean() < 0.97
    assert model.least > 0.9  # a tenth of errors can't be accepted at a risk of a hundredth


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = QUERIES["op12_language_id"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    apart = [r for r in rows if r["held_out"]]
    assert len(apart) > 200 and sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in apart) >= 0.98 * len(apart)


def test_only_texts_decide(spark):
    """Held-out rows with any language, source or id are learned from as little as they are predicted by them."""
    rows = [(k, sentence(lang, k), lang, "s") for k in range(120) for lang in SYLLABLES if zlib.crc32(str(k).encode()) % 4 != 2]
    apart = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2]
    schema = "doc_id long, text string, lang string, source string"
    a = spark.createDataFrame(rows + [(k, sentence("aa", k), "aa", "s") for k in apart], schema)
    b = spark.createDataFrame(rows + [(k, sentence("aa", k), "zz", "t") for k in apart], schema).repartition(7)
    by_id = lambda df: sorted(map(tuple, language_id.predict(df, language_id.train(df)).filter("held_out").collect()))
    assert by_id(a) == by_id(b) and {r[2] for r in by_id(b)} == {"aa"}
    model = language_id.train(a)
    same = a.select(F.lit(1).alias("doc_id"), "text").distinct()
    assert {r["lang_pred"] for r in language_id.predict(same, model).collect()} == set(SYLLABLES)
    # the sample is bounded, and shared among the languages
    counts = {r["lang"]: r["count"] for r in language_id.sample(a, 30).groupBy("lang").count().collect()}
    assert set(counts) == set(SYLLABLES) and max(counts.values()) <= 10


def test_awkward_rows(spark, awkward, nothing):
    """Null, empty and letterless texts are und; all rows come back; nothing is learned from nothing."""
    labelled = spark.createDataFrame([(k, sentence(lang, k), lang) for k in range(60) for lang in SYLLABLES], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    odd = spark.createDataFrame([(1, "123 !?\n", "aa"), (2, "", None), (3, None, "x"), (4, "ba" * 400_000, "aa"), (5, "babebi kra", None), (5, "babebi kra", None), (None, "kra kre", None)], "doc_id long, text string, held_out string")
    rows = language_id.predict(odd, model).collect()
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in sorted(rows, key=lambda r: r["doc_id"] or 9)[:3]] == [("und", 0.0, True)] * 3
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 3, 4, 5, 5] and all(r["lang_pred"] in SYLLABLES for r in rows if r["score"])
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert language_id.predict(awkward, model).count() == awkward.count()
    assert language_id.train(nothing) is None and language_id.predict(nothing, None).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(awkward, None).collect()} == {"und"}
    alone = labelled.filter("lang = 'aa'")
    assert {r["lang_pred"] for r in language_id.predict(alone, language_id.train(alone)).collect()} == {"aa"}
