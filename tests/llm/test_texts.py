"""Packing, leaks and languages: whole results on small inputs, with awkward texts."""

import random
import unicodedata

import numpy as np
import pytest

pytest.importorskip("freshet.llm")
from freshet.llm import langid, leaks, packing  # noqa: E402


@pytest.mark.parametrize("seed", range(8))
def test_pack(seed):
    r = np.random.default_rng(seed)
    cap = int(r.integers(1, 4000))
    sizes = np.sort(np.minimum(r.lognormal(np.log(cap / 8 + 1), 1.2, int(r.integers(1, 500))).astype(np.int64), cap))[::-1]
    place, complete = packing.pack(sizes, cap)
    assert (place >= 0).all() and np.bincount(place, weights=sizes).max() <= cap
    last = packing.finish(sizes, place, complete, cap)
    used = np.unique(last)
    assert np.bincount(last, weights=sizes).max() <= cap
    assert len(used) <= 1.25 * np.ceil(sizes.sum() / cap) + 2


def test_assign(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_WORKER", 40)
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, 5, 50, 99, 100, 101, 250, 1000, r.randrange(130)]), "x") for i in range(300)] + [(7, 60, "x")] * 40 + [(None, 5, "x"), (999, None, "x")]
    items = spark.createDataFrame(rows, "doc long, n long, container_class string")
    boxes = spark.createDataFrame([("s", 100), ("l", 1000), ("bad", 0), ("none", None)], "kind string, cap long")
    got = packing.assign(items, "doc", "n", boxes, "kind", "cap").collect()
    caps = {"s": 100, "l": 1000}
    for kind, cap in caps.items():
        mine = [x for x in got if x.container_class == kind]
        assert sum(x.size for x in mine) == sum(n for i, n, _ in rows if i is not None and n is not None)
        full = {}
        for x in mine:
            full[x.container_id] = full.get(x.container_id, 0) + x.size
            assert 0 <= x.part < x.n_parts and (x.n_parts == 1 or x.size <= cap)
        assert max(full.values()) <= cap
        assert {x.doc for x in mine if x.n_parts > 1} == {i for i, n, _ in rows if i is not None and n is not None and n > cap}
    assert {x.container_class for x in got} == {"s", "l"}
    assert packing.assign(items.limit(0), "doc", "n", boxes, "kind", "cap").count() == 0
    f = {x.container_class: x for x in packing.fill(packing.assign(items, "doc", "n", boxes, "kind", "cap"), boxes, "kind", "cap").collect()}
    assert f["s"].fill > 0.9 and f["l"].fullest <= 1000


def test_token_count(spark):
    df = spark.createDataFrame([("",), ("abc",), ("äß",), ("日本",), (None,)], "t string")
    assert [x[0] for x in df.select(packing.token_count(df.t)).collect()] == [1, 4, 5, 7, None]


PASSAGE = "The harbour office of Zürich kept a record of every chair that nobody had claimed, 44706 in spite of the cost."


def leak_tables(spark):
    w = PASSAGE.split()
    docs = {
        1: "before. " + PASSAGE + " after", 2: " ".join(w[:13]), 3: " ".join(w[:12]) + " other " + " ".join(w[13:]), 4: PASSAGE.upper().replace(" ", "\n"), 5: unicodedata.normalize("NFD", PASSAGE), 6: "…".join(w), 7: PASSAGE.replace("harbour", "har­bour​"),
        8: "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in PASSAGE), 9: "", 10: None, 11: "x " * 60_000 + PASSAGE, 12: "nothing of it",
    }
    items = [(1, PASSAGE), (2, PASSAGE), (3, "too short"), (4, None), (5, "")]
    return spark.createDataFrame([(k, v, "a") for k, v in docs.items()] + [(1, docs[1], "a"), (None, PASSAGE, "a")], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, passage string"), docs


def test_leaks(spark, monkeypatch):
    d, i, docs = leak_tables(spark)
    want = sorted((k, n) for k in (1, 2, 4, 5, 6, 7, 8, 11) for n in (1, 2))
    assert sorted(map(tuple, leaks.leaked(d, "doc_id", "text", i, "item_id", "passage").collect())) == want
    assert leaks.leaked(d, "doc_id", "text", i.limit(0), "item_id", "passage").count() == 0
    assert leaks.leaked(d.limit(0), "doc_id", "text", i, "item_id", "passage").count() == 0
    monkeypatch.setattr(leaks, "MAX_NGRAMS", 1)  # a test side that is too large for the workers
    assert sorted(map(tuple, leaks.leaked(d, "doc_id", "text", i, "item_id", "passage").collect())) == want


def test_spans_and_cleaning(spark):
    d, i, docs = leak_tables(spark)
    d = d.where("doc_id is not null").dropDuplicates(["doc_id"])
    spans = leaks.leaked_spans(d, "doc_id", "text", i, "item_id", "passage")
    got = {x.doc_id: docs[x.doc_id][x.span_start : x.span_end] for x in spans.collect()}
    assert leaks.words(got[1]) == leaks.words(PASSAGE) and got[1].startswith("The") and leaks.words(got[5]) == leaks.words(PASSAGE)
    clean = {x.doc_id: x.text for x in leaks.without_spans(d, "doc_id", "text", spans).collect()}
    assert clean[1].split() == ["before.", ".", "after"] and clean[12] == docs[12] and clean[10] is None and clean[9] == ""
    assert leaks.leaked(leaks.without_spans(d, "doc_id", "text", spans), "doc_id", "text", i, "item_id", "passage").count() == 0
    once = leaks.cleaned(d, "doc_id", "text", i, "item_id", "passage")
    assert once.columns == d.columns and {x.doc_id: x.text for x in once.collect()} == clean


def test_words_in_place():
    for t in (PASSAGE, unicodedata.normalize("NFD", "Żółć über​all"), "ﬁne ½ cup", "がぎぐ、パーティー", "áb", "", "--"):
        assert [w for w, _, _ in leaks.placed_words(t)] == leaks.words(t)


def test_some_words_in_place():
    text = "\n".join([PASSAGE, "", unicodedata.normalize("NFD", "Żółć über\u200ball"), "plain line", "\u0301x á", "ﬁne ½ cup"])
    every = leaks.placed_words(text)
    assert leaks.placed_at(text, range(len(every))) == {i: x[1:] for i, x in enumerate(every)} and leaks.placed_at(text, []) == {}


WORDS = {
    "en": "the and with harbour office bridge behind mill who has seen every chair because road closed", "de": "der die das und mit hinter mühle brücke schmale wer hat gesehen jeden stuhl weil straße gesperrt", "ru": "и в на мост за мельницей кто видел каждый стул потому что дорога закрыта была",
    "uk": "і в на міст за млином хто бачив кожен стілець тому що дорога закрита була її", "fr": "le la les et pont étroit derrière moulin qui a vu chaque chaise parce route fermée", "es": "el la los y puente estrecho detrás del molino quién ha visto cada silla porque camino cerrado",
    "pt": "o a os e ponte estreita atrás do moinho quem viu cada cadeira porque estrada fechada não", "nl": "de het en met brug achter molen wie heeft elke stoel gezien omdat weg was afgesloten", "pl": "i w na most za młynem kto widział każde krzesło ponieważ droga była zamknięta się", "ja": "橋 水車 の 後ろ の 細い 椅子 を だれ が 見た か 道 が 閉まっていた ので",
}


def line(lang, r, n=16):
    return ("" if lang == "ja" else " ").join(r.choice(WORDS[lang].split()) for _ in range(n * (3 if lang == "ja" else 1))) + "."


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    out = []
    for i in range(400):
        lang = langid.LANGUAGES[i % 10]
        out.append((i, "\n".join([line(lang, r) for _ in range(4)]), lang if r.random() > 0.1 else r.choice(langid.LANGUAGES)))
    return out


def test_languages(spark, corpus):
    r = random.Random(8)
    extra = [
        (1000, "\n".join([line("en", r), "short", line("en", r), line("de", r), line("de", r), line("de", r), line("fr", r)]), "German"),
        (1001, line("de", r, 30).encode("utf-8").decode("latin-1"), "de"),
        (1002, "", "en"), (1003, None, "en"), (1004, "tiny", None), (1005, "1234567890 " * 10, "en"), (1006, line("pl", r) * 900, None), (1007, line("ru", r, 30).encode("cp1251").decode("cp1252"), "ru"), (1008, line("nl", r), "xx"),
    ]
    df = spark.createDataFrame([(i, t, y, 1) for i, t, y in corpus + extra], "doc_id long, text string, lang string, segment_no int")
    model = langid.fit(langid.sample(df, "doc_id", "text", "lang"))
    got = {}
    for x in langid.segments(df, "doc_id", "text", "lang", model).collect():
        got.setdefault(x.doc_id, []).append(x)
    right = sum(len(got[i]) == 1 and got[i][0].lang == langid.LANGUAGES[i % 10] for i, _, _ in corpus)
    assert right >= 0.98 * len(corpus)
    assert [(x.segment_no, x.lang) for x in sorted(got[1000], key=lambda x: x.segment_no)] == [(1, "en"), (2, "de"), (3, "fr")]
    assert {x.main_lang for x in got[1000]} == {"de"} and {x.n_langs for x in got[1000]} == {3} and {x.named for x in got[1000]} == {"de"}
    assert got[1001][0].lang == "de" and got[1006][0].lang == "pl" and got[1007][0].lang == "ru" and got[1008][0].named is None
    assert not {1002, 1003, 1004, 1005} & set(got)
    assert all(0 <= x.confidence <= 1 for xs in got.values() for x in xs)


def test_held_out_accuracy(corpus):
    model = langid.fit([(y, t.split("\n")) for _, t, y in corpus])
    r = random.Random(9)
    test = [(lang, line(lang, r, 12)) for lang in langid.LANGUAGES for _ in range(30)]
    p = model.posteriors([model.ids(langid.tokens(x)) for _, x in test])
    assert np.mean([langid.LANGUAGES[q.argmax()] == lang for q, (lang, _) in zip(p, test)]) > 0.97


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(1)
    em, tr = r.normal(size=(1, 4, 3)), r.normal(size=(3, 3))
    g, pair = langid.forward_backward(em, tr, np.array([4]))
    want, wp, z = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(em[0, t, k] for t, k in enumerate(path)) + sum(tr[a, b] for a, b in zip(path, path[1:])))
        z += w
        for t, k in enumerate(path):
            want[t, k] += w
        for a, b in zip(path, path[1:]):
            wp[a, b] += w
    assert np.allclose(g[0], want / z) and np.allclose(pair, wp / z)


@pytest.mark.parametrize(("label", "lang"), [("en", "en"), ("EN-gb", "en"), ("pt_BR", "pt"), ("Deutsch", "de"), ("ger", "de"), (" fra ", "fr"), ("Ukrainian", "uk"), ("日本語", "ja"), ("", None), (None, None), ("und", None), ("-", None), ("unknown", None)])
def test_label_notations(spark, label, lang):
    assert langid.label_language(label) == lang
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(langid.label_column(df.l)).first()[0] == lang


def test_untrained_model_and_long_line():
    model = langid.fit([])
    assert np.allclose(model.posteriors([model.ids(["a", "b"])]), 0.2)
    old = langid.BATCH_WORDS
    langid.BATCH_WORDS = 50
    try:
        assert abs(model.posteriors([model.ids(["a"] * 1000)]).sum() - 1000) < 0.01
    finally:
        langid.BATCH_WORDS = old
