import random

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import language
from strandline.llm.common import crc_mod

TEXTS = {"aa": "the quick brown fox jumps over the lazy dog and runs far away from the house", "bb": "der schnelle braune fuchs springt über den faulen hund und läuft weit weg vom haus"}


def plain_phrases(symbols, known):
    """Phrases of a list of symbols by substring search; ``known`` is a string of the same symbols."""
    n, i = 0, 0
    text = "".join(map(chr, symbols))
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in known:
            j += 1
        n, i = n + 1, j
    return n


def assert_phrases(model, coded, known):
    got = model.phrases(np.concatenate(coded), np.cumsum([0, *map(len, coded)]))
    for i, c in enumerate(coded):
        for j, k in enumerate(known):
            assert got[i, j] == plain_phrases(c.tolist(), k)


def test_phrases_equal_brute_force():
    rng = random.Random(1)
    model = language.LanguageModel.learn({k: [t] for k, t in TEXTS.items()})
    known = ["".join(map(chr, model.alphabet.symbols(TEXTS[k]).tolist() + [0])) for k in model.languages]
    texts = [" ".join(rng.choices("the fox der fuchs hund runs zz é xylo über".split(), k=rng.randrange(1, 900))) for _ in range(40)]
    assert_phrases(model, [model.alphabet.symbols(t) for t in texts], known)


def test_phrases_longer_than_pieces():
    """Repeating text in which parses from different places never meet, with phrases of more than two pieces."""
    rng = random.Random(3)
    learnt = "ab" * 400 + "c" + "".join(rng.choices("abc", k=500))
    model = language.LanguageModel.learn({"xx": [learnt], "yy": ["c" * 900 + "ba" * 30]})
    known = ["".join(map(chr, model.alphabet.symbols(t).tolist() + [0])) for t in (learnt, "c" * 900 + "ba" * 30)]
    texts = ["ab" * 3000, "c" * 5000, "ba" * 700 + "c" * 700 + "ab" * 900, "a" + "ab" * 390 + "b" * 1000, "".join(rng.choices("abcd", k=4000)), "a"]
    assert_phrases(model, [model.alphabet.symbols(t) for t in texts], known)


def test_other_scripts_keep_all_their_letters():
    han = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
    model = language.LanguageModel.learn({"zh": [han], "el": ["αβγδεζηθικλμνξοπρστυφχψω" * 50]})
    assert model.begin.shape[1] == 3000 + 24 + 2
    assert model.predict([han[500:900], "λογος", "ab"])[0][:2] == ["zh", "el"]


def test_null_letterless_and_held_out(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(TEXTS[k].split(), k=30)), k, 1.0) for i, k in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame(rows + [(900, None, "aa", 0.0), (901, "12 !?", None, 0.0), (902, "", "bb", 0.0), (902, "", "bb", 0.0)], "doc_id long, text string, lang string, score double")
    model = language.fit(docs, crc_mod("doc_id", 4) != 2)
    got = language.identify(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(by[i][0] == k for i, _, k, _ in rows) and all(0 <= s <= 1 for _, s in by.values())
    assert by[900] == by[901] == by[902] == ("und", 0.0)
    none = language.fit(docs, F.lit(False))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_the_sample_is_bounded(spark):
    """Copies count once, and no more than the documents asked for reach the driver, whatever their hashes."""
    rows = [(7, "the very same text", "aa")] * 500 + [(i, f"text number {'abcdefghij'[i % 10] * (i + 1)}", "aa") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), documents=5)
    assert len(model.step.entries) < 4096 and model.languages == ["aa"]


def test_very_long_text(spark):
    model = language.LanguageModel.learn({k: [t] for k, t in TEXTS.items()})
    docs = spark.createDataFrame([(1, TEXTS["bb"] * 20_000)], "doc_id long, text string")
    assert language.identify(docs, model).first().lang_pred == "bb"


def test_languages_in_blocks_and_columns_of_any_name(spark, monkeypatch):
    texts = {f"l{i}": [f"{chr(97 + i)}{chr(98 + i)}{chr(99 + i)} " * 40] for i in range(7)}
    model = language.LanguageModel.learn(texts)
    some = [t for v in texts.values() for t in v] + ["abc bcd " * 9, "", None, "漢字"]
    whole = model.predict(some)
    monkeypatch.setattr(language, "CELLS", 1)  # one language at a time
    assert model.predict(some) == whole
    df = spark.createDataFrame([(1, t) for t in some], "doc_id long, text string").selectExpr("*", "7 AS lang_pred", "8 AS score")
    got = language.identify(df, model, extra=("text", "score", "doc_id", "lang_pred"))
    assert got.columns == ["text", "score", "doc_id", "lang_pred", "lang_pred", "score"]
    assert [(r[0], r[1], r[3], r[4]) for r in got.collect()] == [(t, 8, 7, n) for t, n in zip(some, whole[0])]
