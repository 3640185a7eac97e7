import random
import re

import numpy as np
import pyarrow as pa

from strandline.llm import minhash, words
from strandline.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def near_texts(rng, groups, copies, size):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = f"v{rng.randrange(4000)}"
            base = t if rng.random() < 0.5 else base  # chains of copies of copies
            rows.append(" ".join(t))
    return rows


def test_shingle_sets_have_the_right_sizes_and_meet_rightly():
    texts = ["One two  THREE four\ttwo", "one two three FOUR two", "", None, "a", "É é", "a b", " \n x y z x y z x", "a" * 300_000 + " b c d"]
    got = words.shingle_sets(pa.array(texts), 3)
    for t, s in zip(texts, got):
        assert len(s) == len(shingles(t, 3))
    assert np.array_equal(got[0], got[1])
    parts = words.shingle_sets(pa.array(["q", *texts, "r"]).slice(1, len(texts)), 3)
    assert all(np.array_equal(x, y) for x, y in zip(got, parts))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts = near_texts(rng, 6, 25, 60) + near_texts(rng, 20, 3, 12) + [None, "", "  ", "a", "A", "a b", "x y z", "ä ö", "Ä Ö"] + ["same text here again"] * 5
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in rows], "doc_id long, text string, component_id string, kept int")
    for scheme in (minhash.Scheme(), minhash.Scheme(k=5, percent=80, bands=32, rows=4), minhash.Scheme(block=3), minhash.Scheme(block=5, carried=30)):
        got = {tuple(r) for r in minhash.near_duplicates(df, scheme).collect()}
        assert got == brute(rows, scheme.k, scheme.percent)


def test_second_pass_finds_links_past_the_smallest_member(spark):
    base = [f"w{i}" for i in range(120)]
    a, b, c = list(base), list(base), list(base)
    b[60] = "x"
    c[60], c[20], c[100] = "x", "y", "z"
    a[40], a[80] = "p", "q"
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in minhash.near_duplicates(df).collect()} == brute(rows, 3, 85)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(df).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_odd_sketches_keep_what_may_be_similar_and_drop_the_rest():
    rng = np.random.default_rng(0)
    scheme = minhash.Scheme()
    for size in (30, 200, 1500, 15000):
        passed = {}
        for j in (0.5, 0.7, 0.855, 0.95):
            shared = round(size * 2 * j / (1 + j))
            hits = 0
            for _ in range(40):
                base = rng.integers(0, 1 << 64, 2 * size - shared, dtype=np.uint64)
                x, y = np.unique(base[:size]), np.unique(np.concatenate([base[:shared], base[size:]]))
                bits, filled = minhash.odd_sketches([x, y], scheme)
                hits += int(scheme.may_be_similar(np.bitwise_count(bits[0] ^ bits[1]).sum(), len(x), len(y), *filled))
            passed[j] = hits
        assert passed[0.855] == passed[0.95] == 40 and passed[0.5] == 0 and (size < 100 or passed[0.7] <= 12)


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)] + [(7, None), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links if None not in p for x in p}
    for _ in parent:
        for a, b in links:
            if b is not None:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_null_id_with_a_text_of_its_own(spark):
    rows = [(None, "one two three four five six seven eight"), (1, "red green blue black white grey pink brown"), (2, "red green blue black white grey pink brown")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Scheme(k=3)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in out) == [(0, 0, 6), (1, 1, 6), (2, 1, 6)]


def test_an_id_with_several_texts_links_both(spark, monkeypatch):
    """Ids 1 and 2 have two texts each; each row follows its own, and of the pipeline's rows only the copies go. Both joins."""
    a, b, c = ("red green blue black white grey pink brown", "one two three four five six seven eight", "up down left right near far in out")
    rows = [(1, a), (1, b), (2, b), (3, a), (2, c), (4, c), (2, c), (9, "quite another text of some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (minhash.BROADCAST_IDS, -1):
        monkeypatch.setattr(minhash, "BROADCAST_IDS", limit)
        got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (2, 2), (2, 2), (3, 1), (4, 2), (9, 9)]
        kept = sorted(tuple(r) for r in minhash.without_copies(df).collect())
        assert kept == sorted([(1, a), (1, b), (2, c), (2, c), (9, "quite another text of some words")])
    near = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(90))), (5, "x y z"), (6, " ".join(f"w{i}" for i in range(91)))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(near).collect()) == [(5, 5), (5, 5), (6, 5)]


def test_links_just_at_the_threshold_are_found():
    """Pairs of exactly 85 in 100 of all sizes: what the bands offer and the sketches let pass."""
    rng = np.random.default_rng(2)
    scheme = minhash.Scheme()
    for shared in (17, 34, 85, 340, 1700, 8500, 17000):
        union = shared * 100 // 85
        extra = union - shared
        for n in range(30 if shared < 5000 else 8):
            base = rng.integers(0, 1 << 64, union, dtype=np.uint64)
            side = rng.integers(0, extra + 1)
            x, y = np.unique(base[: shared + side]), np.unique(np.concatenate([base[:shared], base[shared + side :]]))
            bits, filled = minhash.odd_sketches([x, y], scheme)
            assert scheme.may_be_similar(np.bitwise_count(bits[0] ^ bits[1]).sum(), len(x), len(y), *filled), (shared, n)
            bands = minhash.band_keys(minhash.signatures([x, y], scheme), scheme)
            assert (bands[0] == bands[1]).any(), (shared, n)


def test_ids_of_another_type(spark):
    df = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), ("c", "else")], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()) == [("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_words_of_regular_build_stay_apart(spark):
    """Words made of two letters in the order of the parity of ones, and their complements, share no shingle."""
    import numpy as np
    import pyarrow as pa

    from strandline.llm.words import hash_words, text_bytes, word_spans

    order = [bin(i).count("1") % 2 for i in range(1 << 14)]
    rows = []
    for n in (1 << 5, 1 << 8, 1 << 10, 1 << 14):
        rows += [(2 * n, "x y " + "".join("ab"[i] for i in order[:n])), (2 * n + 1, "x y " + "".join("ba"[i] for i in order[:n]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id and r.kept for r in got)
    rng = np.random.default_rng(1)
    block = ["".join(rng.choice(list("ab"), 8)) for _ in range(60)]
    words = {"".join(block[i] for i in rng.permutation(12)) for _ in range(30_000)} | {"".join(rng.choice(list("ab"), n)) for n in range(1, 40) for _ in range(300)}
    raw, offsets = text_bytes(pa.array([" ".join(words)]))
    starts, ends, _ = word_spans(raw, offsets)
    assert len(np.unique(hash_words(raw, starts, ends))) == len(words)


def test_columns_named_as_the_work_columns_of_copies_stay(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "other words here")], "doc_id long, text string").selectExpr("*", "7 AS _gone_id", "8 AS _gone_hash")
    got = minhash.without_copies(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
