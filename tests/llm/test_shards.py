import random
import zlib
from collections import defaultdict

from strandline.llm import shards


def test_sizes_slots_and_hot_texts(spark):
    rng = random.Random(6)
    rows = [(i, "é" * rng.randrange(0, 300)) for i in range(900)] + [(1000 + i, "the same") for i in range(500)] + [(3000, None), (3001, ""), (None, "x")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    for range_rows in (shards.RANGE_ROWS, 50):
        got = shards.shard(df, range_rows=range_rows).collect()
        size = lambda t: len((t or "").encode()) + 1
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows)
        slots, total = defaultdict(list), defaultdict(int)
        for r in got:
            slots[r["shard"]].append(r.slot)
            total[r["shard"]] += r.size
        assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        share = sum(total.values()) / 8
        assert all(abs(t - share) <= 2 * 601 for t in total.values())
        assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a")] * 5, "doc_id long, text string")
    got = shards.shard(df).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r.slot for r in got) == [0, 1, 2, 3, 4]
    assert shards.shard(df.limit(0)).count() == 0


def test_hot_texts_over_many_ranges(spark, monkeypatch):
    """A third of all rows are copies of one text, with ids of another type: shards near equal, groups cut at splitters alone, both joins."""
    rows = [(f"doc-{i}", f"text {i} " + "word " * (i % 40)) for i in range(2000)] + [(f"copy-{i}", "one text for a third of all " * 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    for limit in (shards.BROADCAST_RANGES, -1):
        monkeypatch.setattr(shards, "BROADCAST_RANGES", limit)
        got = shards.shard(df, range_rows=40).collect()
        slots, total = defaultdict(list), defaultdict(int)
        for r in got:
            slots[r["shard"]].append(r.slot)
            total[r["shard"]] += r.size
        assert len(got) == 3000 and sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        share = sum(total.values()) / 8
        assert all(abs(t - share) <= 2 * 300 for t in total.values())
        hot = sorted({r["shard"] for r in got if r.doc_id.startswith("copy")})
        assert hot == list(range(hot[0], hot[-1] + 1))


def test_splitters_equal_brute_force(spark):
    rng = random.Random(9)
    rows = shards.keyed(spark.createDataFrame([(i, "x" * rng.randrange(1, 500)) for i in range(400)], "doc_id long, text string")).cache()
    keys = sorted((r.h, r.d, r.size) for r in rows.collect())
    total = sum(k[2] for k in keys)
    targets = [total * i // 5 for i in range(1, 5)]
    for got, want in zip(shards.find_splitters(rows, targets, 0), targets):
        below = sum(s for h, d, s in keys if (h, d) < got)
        assert abs(below - want) == min(abs(sum(s for _, _, s in keys[:i]) - want) for i in range(len(keys) + 1))


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "é" * 2_000_000), (2, "a")], "doc_id long, text string")
    assert sorted((r.size, r.slot) for r in shards.shard(df).collect()) == [(2, 0), (4_000_001, 0)]
