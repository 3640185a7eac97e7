import random
import re
from collections import Counter

import numpy as np

from strandline.llm import decontaminate
from strandline.llm.hamming import BlockIndex

WORD = re.compile("[^\x20\x09-\x0d]+")


def multiset(words, k):
    k = min(k, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items, k=5, least=0.8):
    out = set()
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        for item, it in items:
            v = WORD.findall((it or "").lower())
            if not v or not w or len(w) < min(k, len(v)):
                continue
            n, kk = len(v), min(k, len(v))
            own, best = multiset(v, kk), None
            for s in range(max(1, len(w) - n + 1)):
                other = multiset(w[s : s + n], kk)
                sim = sum((own & other).values()) / sum((own | other).values())
                if sim >= least and (best is None or sim > best[0]):
                    best = sim, s
            if best:
                out.add((d, item, round(best[0], 9), best[1], min(n, len(w))))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 20, 20, 41])))) for i in range(12)] + [(90, None), (91, "  "), (92, "w1 W1 w1 w1 w1 w1 w1"), (0, "x y z")]
    items[0] = (0, "alone")
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(0, 150))]
        if d % 3:
            v = WORD.findall(rng.choice(items)[1] or "")
            for _ in range(d % 4 - 1):
                if v:
                    v[rng.randrange(len(v))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in v]
        docs.append((d, " \n".join(w)))
    docs += [(100, None), (101, ""), (102, "w1 w1 w1 w1 w1"), (103, "alone")]
    df = spark.createDataFrame([(d, t, "n") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.n_words) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == want and len({g[0] for g in got}) > 20
    kept = {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {g[0] for g in got}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.without_leaks(df, bench.limit(0)).count() == len(docs)
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g h") for i in range(9)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(0, 9, 2)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 4)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == whole and len(whole) == 5
    assert decontaminate.without_leaks(docs, bench).count() == 4


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (200, 8), dtype=np.uint8)
    queries = np.concatenate([codes[:50] ^ (rng.random((50, 8)) < 0.4) * rng.integers(0, 256, (50, 8), dtype=np.uint8), rng.integers(0, 256, (50, 8), dtype=np.uint8)]).astype(np.uint8)
    for radius in (0, 7, 23):
        q, c = BlockIndex(codes, radius).within(queries)
        plain = np.bitwise_count(queries[:, None] ^ codes[None]).sum(2) <= radius
        assert set(zip(q.tolist(), c.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(plain))))


def test_ids_of_other_types(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([("a", "x " + words + " y"), ("b", "nothing of it"), (None, words)], "doc_id string, text string")
    bench = spark.createDataFrame([(3, words)], "item_id int, text string")
    assert sorted((str(r.doc_id), r.item_id, r.first_word) for r in decontaminate.find_leaks(docs, bench).collect()) == [("None", 3, 0), ("a", 3, 1)]


def test_the_radius_holds_windows_at_the_threshold():
    """Windows whose weighted similarity is just 0.8 or above: their fingerprints lie within the radius, for items of 5 to 200 words."""
    import numpy as np

    from strandline.llm import decontaminate as dc
    from strandline.llm.words import shingle_hashes

    rng, missed, tried = np.random.default_rng(11), 0, 0
    for words in (5, 6, 8, 12, 20, 40, 80, 120, 200):
        per = words - dc.SHINGLE + 1
        for _ in range(600):
            item = rng.integers(0, 1 << 63, words).astype(np.uint64)
            window = item.copy()
            while True:  # change words one after the other, as long as the similarity holds
                trial = window.copy()
                trial[rng.integers(0, words)] = rng.integers(0, 1 << 63)
                if dc.weighted_similarity(shingle_hashes(trial, dc.SHINGLE), shingle_hashes(item, dc.SHINGLE)) < dc.SIMILARITY:
                    break
                window = trial
            if per >= 9:  # fill up to the threshold at the item's ends, where a word changes one shingle
                for k in range(1, per):
                    trial = window.copy()
                    trial[:k] = rng.integers(0, 1 << 63, k).astype(np.uint64)
                    if dc.weighted_similarity(shingle_hashes(trial, dc.SHINGLE), shingle_hashes(item, dc.SHINGLE)) < dc.SIMILARITY:
                        break
                    window = trial
            prints = [dc.simhash(dc.votes(shingle_hashes(x, dc.SHINGLE)).sum(0, dtype=np.int64)[None]) for x in (item, window)]
            tried += 1
            missed += int(np.bitwise_count(prints[0] ^ prints[1]).sum()) > dc.RADIUS
    assert tried == 5400 and missed == 0
