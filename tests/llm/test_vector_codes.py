"""Product codes against their definition, annular pruning against a full search."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from strandline.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_definition(rows, scheme):
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // scheme.parts)
    whole = lambda v: [max(-vc.LARGEST, min(vc.LARGEST, math.floor(scheme.scale * x))) for x in [*v, *[0.0] * (width * scheme.parts - len(v))]]
    cut = lambda v: [whole(v)[p * width : (p + 1) * width] for p in range(scheme.parts)]
    parts = [cut(v) for _, v, _ in kept]
    seeds = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[: scheme.entries]
    books = [[parts[k][p] for k in seeds] for p in range(scheme.parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(scheme.rounds):
        for p in range(scheme.parts):
            mine = defaultdict(list)
            for x in parts:
                mine[near(x[p], books[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(c) for c in zip(*mine[e])] if e in mine else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, errors = [], defaultdict(int)
    for (i, _, g), x in zip(kept, parts):
        best = [near(x[p], books[p]) for p in range(scheme.parts)]
        error = min(sum(d for d, _ in best), vc.LONG)
        errors[g] += error
        out.append((i, g, "".join(f"{e:02x}" for _, e in best), error))
    return [(*r, min(errors[r[1]], vc.LONG), digest) for r in out]


def check(spark, rows, scheme=vc.Scheme()):
    got = [tuple(r) for r in vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), scheme).collect()]
    assert sorted(got, key=repr) == sorted(by_definition(rows, scheme), key=repr)
    return got


def test_equals_its_definition(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 16).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, [0.25] * 16, None) for i in range(60)]  # one vector many times: ties and a hot label
    rows += [(None, rng.normal(0, 1, 16).tolist(), 1), (7, [0.0] * 16, 2), (7, [-0.1] * 16, 2)]
    rows += [(300, None, 1), (301, [None] + [0.1] * 15, 1), (302, [float("nan")] * 16, 1), (303, [float("inf")] + [0.0] * 15, None)]
    assert len(check(spark, rows)) == 213


def test_unequal_lengths_huge_values_few_rows(spark):
    check(spark, [(1, [1.0, 2.0, 3.0], None), (2, [], 1), (3, [-1e-9] * 9, 1), (4, [5.5] * 24, None)])
    check(spark, [(i, [1e5 * (i % 7), -3e4 * i, 2.5, 1e30 if i == 3 else 0.0] * 4, i % 2) for i in range(40)])
    check(spark, [(1, [0.5] * 8, 1)])


def test_nothing_usable_and_clashing_names(spark):
    assert vc.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vc.compress(spark.createDataFrame([(1, None, 2), (2, [None], 2)], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, [0.5] * 8, 1)], SCHEMA).selectExpr("*", "1 AS id", "2 AS code", "3 AS v", "4 AS n", "5 AS _of")
    assert [r.code for r in vc.compress(df).collect()] == ["00" * 8]


@pytest.mark.parametrize("spread", [1, 40, 5000, 1 << 30])
def test_annulus_loses_no_nearest_entry(spread):
    rng = np.random.default_rng(spread)
    book = rng.integers(-spread, spread + 1, (37, 5))
    book[9], book[20] = book[3], -book[3]
    x = np.concatenate([rng.integers(-spread, spread + 1, (5, 400)), book.T, -book.T], 1)
    entry, best = vc.nearest(x, book)
    d = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in book.tolist()] for v in x.T.tolist()]
    assert [int(v) for v in best] == [min(r) for r in d]
    assert entry.tolist() == [r.index(min(r)) for r in d]


def test_decoding_gives_the_entries(spark):
    rows = spark.createDataFrame([(i, [i / 10 + j for j in range(8)], None) for i in range(10)], SCHEMA)
    books = vc.train(rows, vc.Scheme(rounds=0))
    got = vc.decode(vc.encode(rows, books), books).collect()
    assert all(np.allclose(r.approximation, [r.vec_id / 10 + j for j in range(8)], atol=1 / 4096) and r.error == 0 for r in got)
