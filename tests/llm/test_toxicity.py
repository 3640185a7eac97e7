from pyspark.sql import functions as F

from strandline.llm import toxicity


def test_fold():
    assert toxicity.fold("1d10t, L0SER!! $tupid mοron tra$h") == " idiot loser stupid moron trash "
    assert toxicity.fold("loser$$$ the") == " loser the "
    assert toxicity.fold(None) == toxicity.fold("  ") == " "


def test_exceptions_and_heaviest_entry_at_a_place():
    lex = toxicity.Lexicon({"clown": 3.0, "clown*": 1.0}, frozenset({"clown fish"}))
    assert lex.found(toxicity.fold("clown fish")) == []
    assert lex.found(toxicity.fold("a clown, clowns")) == [("clown", 3.0), ("clown*", 1.0)]


def test_found_equals_a_plain_search():
    lex = toxicity.Lexicon({"bad": 2.0, "very bad": 3.0, "badl*": 1.0})
    folded = toxicity.fold("Bad badly very bad, VERY BAD bada")
    words = folded.split()
    plain = []
    for i, w in enumerate(words):
        fits = [(wt, e) for e, wt in lex.weights.items() if (e.endswith("*") and w.startswith(e[:-1])) or words[i : i + len(e.split())] == e.split()]
        if fits:
            plain.append((max(fits)[1], max(fits)[0]))
    assert lex.found(folded) == plain


def test_learns_scores_and_filters(spark):
    rows = [(i, f"plain words number {i} here", 0) for i in range(40)] + [(100 + i, f"you awful creature number {i}", 1) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(900, None, "en"), (901, "", None), (902, "you awful creature", "en"), (902, "you awful creature", "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, F.lit(True))
    assert {"awful", "creature", "you"} <= set(lexicon.weights) and "plain" not in lexicon.weights
    scored = toxicity.score_documents(docs, lexicon)
    got = {(r.doc_id, r.score >= 0.5) for r in scored.collect()}
    assert got == {(i, bool(y)) for i, _, y in rows} | {(900, False), (901, False), (902, True)}
    assert scored.count() == docs.count()
    kept = toxicity.keep_clean(docs, lexicon)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, y in rows if not y} | {900, 901}


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert lexicon.weights == {} and toxicity.score_documents(docs, lexicon).first().score < 0.5


def test_score_by_its_definition(spark):
    """Scores of whole texts, short and very long ones, by a plain word-by-word search and the formula."""
    import math
    import random

    rng = random.Random(4)
    lex = toxicity.Lexicon({"bad": 2.0, "very bad": 3.0, "badl*": 1.5, "awful": 2.5}, frozenset({"bad luck"}), 1.3, -1.1)
    texts = [" ".join(rng.choices(["Bad", "badly", "luck", "very", "awful", "b4d", "fine", "day,", "AWFUL!"], k=rng.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", "awful " + "fine day " * 100_000]

    def plain(text):
        words = toxicity.fold(text).split()
        shielded = {i for i in range(len(words) - 1) if words[i : i + 2] == ["bad", "luck"]}
        total = 0.0
        for i, w in enumerate(words):
            fits = [wt for e, wt in lex.weights.items() if (e.endswith("*") and w.startswith(e[:-1])) or words[i : i + len(e.split())] == e.split()]
            if fits and not {i, i - 1} & shielded:
                total += max(fits)
        blanks = toxicity.fold(text).count(" ")
        return 1 / (1 + math.exp(-(lex.slope * (total / math.sqrt(1 + blanks / 100) if total else 0.0) + lex.shift)))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(df, lex).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-12 for i, t in enumerate(texts))


def test_columns_of_any_name_beside_the_score(spark):
    lexicon = toxicity.Lexicon({"bad": 3.0})
    df = spark.createDataFrame([(1, "a bad one", 5), (2, None, 6)], "doc_id long, text string, score int")
    got = toxicity.score_documents(df, lexicon, extra=("doc_id", "score", "text"))
    assert got.columns == ["doc_id", "score", "text", "score", "hits"]
    assert [(r[0], r[1], r[2], r[4]) for r in got.collect()] == [(1, 5, "a bad one", ["bad"]), (2, 6, None, [])]
