"""Spans of a test side of any size, and what the language model is trained on."""

import numpy as np
import pytest

from freshet.llm import langid, leaks


def test_both_ways_agree(spark, sf, monkeypatch):
    """A test side of any size: documents, items, spans and cleaned texts are the same."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{sf}/eval_items.parquet")
    docs = docs.unionByName(docs.where("doc_id < 50").selectExpr("doc_id", "concat('again ', text) text", "lang")).unionByName(docs.where("doc_id < 9").selectExpr("cast(null as long) doc_id", "text", "lang"))
    sides = (docs, "doc_id", "text", items, "item_id", "passage")
    rows = lambda f: sorted(map(str, f(*sides).collect()))
    every = (leaks.leaked, leaks.leaked_spans, leaks.cleaned)
    want = [rows(f) for f in every]
    monkeypatch.setattr(leaks, "MAX_NGRAMS", 0)
    assert all(want) and [rows(f) for f in every] == want


def test_size_of_the_sample(spark):
    lines = [f"{i} " + "word " * 100 for i in range(8)] + ["long " * 1000, "short"]
    text = "\n".join(lines)
    rows = spark.createDataFrame([(i, text, "en") for i in range(180)], "doc_id long, text string, lang string")
    got = langid.sample(rows, "doc_id", "text", "lang")
    assert len(got) == 180 and all(len(some) == langid.SAMPLE_LINES and set(some) <= set(lines[:8]) for _, some in got)  # whole lines


def test_sample_of_any_size(spark, monkeypatch):
    for n in (1, 300, 10**6, 150_000_001, 10**10, 10**13):
        want = min(n, 1.5 * langid.SAMPLE_DOCS)
        assert abs(langid.sample_limit(n) / 2**63 * n - want) < 1e-3 * want + 1
    text = "many words of one language make a line that is long enough to be counted at all"
    rows = spark.createDataFrame([(i, text, "en" if i % 3 else "de") for i in range(6000)] + [(9000, None, "fr"), (9001, "x", "xx")], "doc_id long, text string, lang string")
    got = [y for y, _ in langid.sample(rows, "doc_id", "text", "lang")]
    assert got.count("en") == got.count("de") == langid.SAMPLE_DOCS and got.count("fr") == 1 and len(got) == 2 * langid.SAMPLE_DOCS + 1
    monkeypatch.setattr(langid, "sample_limit", lambda n: -1)
    with pytest.raises(RuntimeError):
        langid.sample(rows, "doc_id", "text", "lang")


def test_features_of_long_and_odd_words():
    ws = ["a", "Donau" * 40, "橋", "é", "ab"]
    together = langid._scored(langid.features(ws, {"ab": 3}), np.eye(langid.WEIGHTS, 7, dtype=np.float32), len(ws))
    for i, w in enumerate(ws):  # a word's features don't depend on the words beside it
        alone = langid._scored(langid.features([w], {"ab": 3}), np.eye(langid.WEIGHTS, 7, dtype=np.float32), 1)
        assert np.allclose(alone[0], together[i])
        mine = sorted(int(c) for g, cols in langid.features(ws, {"ab": 3}) for k, c in zip(g, cols) if k == i)
        assert mine == sorted(int(c) for _, cols in langid.features([w], {"ab": 3}) for c in cols)
