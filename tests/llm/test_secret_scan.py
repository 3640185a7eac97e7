"""Secret scans: patterns and Viterbi against brute force, held-out accuracy of the trained field, edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from strandline.llm import secret_scan as ss

PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
SCHEMA = "doc_id long, text string"


def by_definition(text):
    order = list(PATTERNS)
    found = [(k, *m.span()) for k, (p, group, least) in PATTERNS.items() for m in p.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "en", "ou", "che", "ri", "st", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def field():
    rng = random.Random(5)
    return ss.train([prose(rng, 60) + rng.choice([".", " x = 1;", "\n", " 12 34"]) for _ in range(500)])


def test_patterns_equal_their_definition():
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", '"', "'", " ", ":", "=", "AKIA", "Z9" * 7, "0a" * 8, "f" * 33, "abcdefg", "ſecret=", "é😀", "x", "\n", "token=short"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert sorted(ss.base_spans(text), key=lambda s: (s[1], ss.KINDS.index(s[0]))) == by_definition(text), text


@pytest.mark.parametrize("n", [1, 5, 8])
def test_viterbi_finds_the_best_path(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        score, steps, first = rng.normal(size=(3, n)), rng.normal(size=(3, 3)), rng.normal(size=3)
        begins = np.array([True, *(rng.random(n - 1) < 0.3)])
        worth = lambda p: sum(score[x, i] + (first[x] if begins[i] else steps[p[i - 1], x]) for i, x in enumerate(p))
        assert worth(ss.viterbi(score, steps, first, begins).tolist()) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=n))))


def test_blocks_of_viterbi_join():
    rng = np.random.default_rng(2)
    n, steps, first = 5 * ss.BLOCK + 7, rng.normal(size=(3, 3)), rng.normal(size=3)
    score, begins = rng.normal(size=(3, n)), rng.random(n) < 0.01
    begins[0] = True
    got, at, back = ss.viterbi(score, steps, first, begins), first + score[:, 0], []
    for t in range(1, n):
        ways = at[:, None] + (np.tile(first, (3, 1)) if begins[t] else steps)
        back.append(ways.argmax(0))
        at = ways.max(0) + score[:, t]
    want = [int(at.argmax())]
    for b in reversed(back):
        want.append(int(b[want[-1]]))
    assert got.tolist() == want[::-1]


def test_probabilities_of_tags():
    rng = np.random.default_rng(3)
    n, longest = np.array([4, 2]), 4
    score, steps, first = rng.normal(size=(2, longest, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    tag, pair = ss.expectations(score, steps, first, n)
    pairs = np.zeros((3, 3))
    for c in range(2):
        paths = list(itertools.product(range(3), repeat=int(n[c])))
        worth = np.exp([first[p[0]] + sum(score[c, i, x] for i, x in enumerate(p)) + sum(steps[a, b] for a, b in zip(p, p[1:])) for p in paths])
        worth /= worth.sum()
        for i in range(n[c]):
            assert np.allclose(tag[c, i], [sum(w for w, p in zip(worth, paths) if p[i] == x) for x in range(3)])
        for w, p in zip(worth, paths):
            for a, b in zip(p, p[1:]):
                pairs[a, b] += w
    assert np.allclose(pair, pairs) and np.allclose(tag[1, 2:], 0)


def test_field_finds_held_out_secrets_and_leaves_clean_texts_alone(field):
    rng, found, total, wrong = random.Random(77), 0, 0, 0
    for _ in range(300):
        value, name = ss.random_secret(rng), rng.choice(["pwd", "auth", "client_secret", "Credential"])
        text = f"{prose(rng, 30)} {name} = \"{value}\" {prose(rng, 30)}"
        at = text.index(value)
        spans = ss.all_spans(pa.array([text]), field)[0]
        total, found = total + 1, found + any(s <= at + 2 and e >= at + len(value) - 2 for _, s, e in spans)
        wrong += sum(k == "field" for k, _, _ in ss.all_spans(pa.array([prose(rng, 80) + " https://www.taen.com/rist 2020-01-02"]), field)[0])
    assert found >= 0.9 * total and wrong <= 3


def test_base_findings_stay_and_positions_are_code_points(spark, field):
    rng = random.Random(8)
    texts = [None, "", " ", "😀é token = \"0123456789abcdef0123456789abcdef01234567\" é", "AKIA" + "Q1" * 8, "a" * 40, "é" * 100, "password:" + "x" * 7, "\x00 token=abcdefgh"]
    texts += [f"{prose(rng, 9)} auth: {ss.random_secret(rng)} {prose(rng, 5)}" for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS spans", "2 AS kind").repartition(3)
    got = ss.find_secrets(df, field).collect()
    assert len(got) == len(rows)
    by_text = {r.doc_id: r.spans for r in got}
    for i, t in enumerate(texts):
        spans = [tuple(s) for s in by_text[i]]
        base, more = [s for s in spans if s[0] != "field"], [s for s in spans if s[0] == "field"]
        assert base == by_definition(t) and all(0 <= a < z <= len(t) and z - a >= ss.LEAST for _, a, z in more)
        assert all(z <= s or a >= e for _, a, z in more for _, s, e in base)
    assert sum(s[0] == "field" for spans in by_text.values() for s in spans) > 20
    clean = {r.doc_id: r.text for r in ss.redact(df, field).collect()}
    assert clean[0] is None and clean[3].startswith("😀é [secret]") and clean[6] == texts[6]
    assert ss.redact(df, field).columns == df.columns


def test_long_text_and_empty_table(spark, field):
    long = "token=" + "ab1" * 300_000 + " " + "word " * 200_000 + "x = 1; " * 50_000
    got = ss.find_secrets(spark.createDataFrame([(1, long)], SCHEMA), field).collect()
    assert [tuple(s) for s in got[0].spans if s["kind"] != "field"] == by_definition(long)
    assert ss.find_secrets(spark.createDataFrame([], SCHEMA), field).collect() == []
    assert ss.fit(spark.createDataFrame([(1, None)], SCHEMA)).tables[0].shape[1] == 3


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    got = __spark_entry__.queries()["op13_secret_scans"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        base = by_definition(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in PATTERNS)
        listed = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("field")] == listed
