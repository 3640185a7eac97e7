"""Importance resampling against its definition, and the CRC-32 of joined parts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import crc, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def found(text, scheme):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % scheme.buckets for k in range(1, scheme.longest + 1) for i in range(len(words) - k + 1)]


def by_definition(docs, items, scheme):
    rows = [(i, *found(t, scheme)) for i, t in docs]
    s, t = Counter(b for _, _, f in rows for b in f), Counter(b for x in items for b in found(x, scheme)[1])
    s_all, t_all, k = sum(s.values()), sum(t.values()), scheme.buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + k) / ((s[b] + 1) * (t_all + k)))) for b in range(k)]
    scored = []
    for i, n, f in rows:
        weight, h = sum(gain[b] for b in f), int(hashlib.sha256(f"{scheme.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in scored if r[1] >= scheme.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): n + 1 for n, r in enumerate(fit[: scheme.percent * len(fit) // 100])}
    return [(*r, ranks.get(id(r))) for r in scored]


def as_tuples(df):
    return [tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_equals_its_definition(spark):
    rng = np.random.default_rng(3)
    words = ["der", "Die", "das", "été", "x1", "漢字", "a-b", "tokEN", "zz" * 60]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(300)] + [(None, "x " * 30), (None, None), (500, ""), (501, " .,; "), (5, "der die das " * 9)]
    docs += [(1000 + i, "one text that hundreds of documents share, of more than twenty words: " + "a b c d e f g h i j k l m") for i in range(200)]
    items = ["Die das été", "die das été", "漢字 x1", None, "", "zz" * 60]
    scheme = resampling.Scheme(percent=30)
    got = as_tuples(resampling.resample(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame([(x,) for x in items], "text string"), scheme))
    assert sorted(got, key=key) == sorted(by_definition(docs, items, scheme), key=key)


def test_long_text_other_columns_and_drawn_rows(spark):
    docs = [(1, "lorem ipsum " * 200_000, "a"), (2, "y" * 2_000_000, "b"), (3, "dolor " * 20, None), (4, "lorem ipsum " * 10, "d")]
    df = spark.createDataFrame(docs, SCHEMA + ", digest string").selectExpr("*", "1 AS weight", "2 AS n", "3 AS rank", "4 AS _of")
    target, scheme = spark.createDataFrame([("lorem ipsum",)], "text string"), resampling.Scheme(percent=67)
    got = as_tuples(resampling.resample(df, target, scheme))
    assert sorted(got) == sorted(by_definition([d[:2] for d in docs], ["lorem ipsum"], scheme))
    drawn = resampling.drawn(df, target, scheme)
    assert drawn.columns == df.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r[0] for r in got if r[-1])


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resampling.resample(none, target).collect() == []
    assert as_tuples(resampling.resample(spark.createDataFrame([(1, "a b")], SCHEMA), target))[0][:3] == (1, 2, 3)


@pytest.mark.parametrize("seed", range(3))
def test_crc_of_joined_parts(seed):
    rng = np.random.default_rng(seed)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    cuts = np.unique(np.append(rng.integers(0, 5000, 40), [0, 1, 2, 64, 65, 129, 5000]))
    starts, ends = cuts[:-1], cuts[1:]
    parts = crc.crc_of_spans(raw, starts, ends)
    assert parts.tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts, ends)]
    joined = crc.shifted(parts[:-1], (ends - starts)[1:]) ^ parts[1:]
    assert joined.tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts[:-1], ends[1:])]
    long = np.array([100_003, 1 << 20])
    assert (crc.shifted(parts[:2], long) ^ np.array([zlib.crc32(bytes(n)) for n in long], np.uint32)).tolist() == [zlib.crc32(raw[a:b].tobytes() + bytes(n)) for a, b, n in zip(starts, ends, long)]
