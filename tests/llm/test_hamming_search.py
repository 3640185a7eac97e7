import random

from pyspark.sql import functions as F

from strandline.llm import hamming_search


def test_equals_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(10)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(base)]) for i in range(300)]
    rows += [(1000 + i, base[0]) for i in range(150)] + [(5, base[1]), (2000, None), (2050, [1.0]), (2001, [None] * 64), (2002, [float("nan")] * 64), (None, base[0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, distance int").repartition(3)
    codes = [(i, [x is not None and x == x and x > 0 for x in v]) for i, v in rows if i is not None and v and len(v) == 64]
    want = set()
    for q in {i for i, _ in codes if i % 50 == 0}:
        best = {}
        for a in (c for i, c in codes if i == q):
            for i, c in codes:
                if i != q:
                    best[i] = min(best.get(i, 99), sum(x != y for x, y in zip(a, c)))
        want |= {(q, n + 1, i, d) for n, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:10])}
    assert {tuple(r) for r in hamming_search.top_k(df, F.col("vec_id") % 50 == 0).collect()} == want


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0] * 4), (1, [1.0, 1.0] * 4)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in hamming_search.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 4)]
    assert hamming_search.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def brute(codes, k):
    return {(q, n + 1, i, d) for q, a in codes if q % 50 == 0 for n, (d, i) in enumerate(sorted((sum(x != y for x, y in zip(a, c)), i) for i, c in codes if i != q)[:k])}


def test_rounds_over_many_partitions(spark):
    """Many partitions, so several rounds with bounds; a dimension that is no multiple of eight; ties at the bound."""
    rng = random.Random(5)
    base = [[rng.choice((-1.0, 1.0)) for _ in range(13)] for _ in range(6)]
    rows = [(i, [x * rng.choice((1, 1, 1, -1)) for x in rng.choice(base)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(20)
    got = {tuple(r) for r in hamming_search.top_k(df, F.col("vec_id") % 50 == 0, k=7).collect()}
    assert got == brute([(i, [x > 0 for x in v]) for i, v in rows], 7)


def test_one_vector_of_another_length_takes_nothing_from_the_rest(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(20)]
    df = spark.createDataFrame([*rows, (50, [1.0] * 9)], "vec_id long, embedding array<float>")
    got = {tuple(r) for r in hamming_search.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()}
    assert got == brute([(i, [x > 0 for x in v]) for i, v in rows], 3)
    assert hamming_search.top_k(df, F.col("vec_id") % 50 == 0, k=3, bits=9).count() == 0
