"""Factors and clusters whose matrices stay tables, and books that stream by date, against direct computations."""

import datetime as dt

import numpy as np
import pytest

from strandline.operators import books as bk
from strandline.operators import models as md

D0 = dt.date(2001, 1, 1)


def panel(spark, n=14, days=120, seed=3):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=(3, days))
    r = np.stack([common[i % 3] * (0.5 + 0.1 * (i % 4)) + rng.normal(size=days) for i in range(n)])
    hole = rng.random(r.shape) < 0.1
    rows = [(f"t{i:02}", D0 + dt.timedelta(d), None if hole[i, d] else float(r[i, d])) for i in range(n) for d in range(days)]
    c = np.eye(n)
    for i in range(n):
        for j in range(i):
            both = ~hole[i] & ~hole[j]
            c[i, j] = c[j, i] = np.corrcoef(r[i, both], r[j, both])[0, 1]
    return spark.createDataFrame(rows, "ticker string, date date, ret double").repartition(4), c


@pytest.mark.parametrize("spare", [3, 24])
def test_factors_are_the_leading_eigenvectors(spark, spare):
    df, c = panel(spark)
    values, vectors = np.linalg.eigh(c)
    got = md.factors(df, components=3, spare=spare).collect()
    assert len(got) == 3 * 14
    for k in range(3):
        want = vectors[:, -1 - k] * np.sign(vectors[np.abs(vectors[:, -1 - k]).argmax(), -1 - k])
        mine = sorted((r for r in got if r.component == k), key=lambda r: r.ticker)
        assert [r.loading for r in mine] == pytest.approx(want.tolist(), abs=1e-4)
        assert mine[0].explained == pytest.approx(values[-1 - k] / 14, abs=1e-8)
    assert md.factors(df.limit(0)).count() == 0


def ward(c, clusters):
    groups, d = {i: [i] for i in range(len(c))}, {(i, j): 2 * (1 - c[i, j]) for i in range(len(c)) for j in range(i + 1, len(c))}
    while len(groups) > clusters:
        i, j = min(d, key=lambda p: (d[p], p))
        ni, nj, dij = len(groups[i]), len(groups[j]), d.pop((i, j))
        for k in set(groups) - {i, j}:
            a, b, nk = d.pop((min(i, k), max(i, k))), d.pop((min(j, k), max(j, k))), len(groups[k])
            d[min(i, k), max(i, k)] = ((ni + nk) * a + (nj + nk) * b - nk * dij) / (ni + nj + nk)
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups.values())


def test_clusters_are_those_of_merging_one_pair_at_a_time(spark):
    df, c = panel(spark, seed=8)
    for clusters in (4, 1):
        got = {}
        for r in md.ward_clusters(df, clusters).collect():
            got.setdefault(r.cluster, []).append(int(r.ticker[1:]))
        assert sorted(sorted(g) for g in got.values()) == ward(c, clusters)
        assert [min(got[k]) for k in sorted(got)] == sorted(min(g) for g in got.values())


def test_books_of_several_rules_and_strategies_stream_alike(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{k}", f"t{t}", D0 + dt.timedelta(d), float(rng.normal()), float(rng.normal(0, 0.05))) for k in range(3) for t in range(8) for d in range(60) if rng.random() > 0.1]
    df = spark.createDataFrame(rows, "strategy string, ticker string, date date, signal double, ret double").repartition(5)
    rules = {"plain": bk.Rules(top=3), "stops": bk.Rules(top=2, every=3, stop=0.05, take=0.08), "trail": bk.Rules(top=2, bottom=2, trail=0.04, weight_on_new=0.5, long_bias=0.6)}
    both = {(r.strategy, r.rules, r.date): r[3:] for r in bk.simulate(df, rules, strategy="strategy").collect()}
    assert len(both) == 3 * 3 * 60
    for name, x in rules.items():
        book = bk._Book(x)
        for d in range(60):
            date = D0 + dt.timedelta(d)
            today = {t: (s, r) for k, t, e, s, r in rows if k == "s1" and e == date}
            assert both["s1", name, date] == pytest.approx(book.move(dict(sorted(today.items()))))
    one = {(r.strategy, r.date): r[2:] for r in bk.simulate(df, rules["stops"], strategy="strategy").collect()}
    assert one == {(k, d): v for (k, name, d), v in both.items() if name == "stops"}
    assert bk.simulate(df.limit(0), rules["plain"]).count() == 0
