"""Graphs of whole series against their definition, in chunks and with ties."""

import datetime as dt
import random

import numpy as np
import pytest

from strandline.operators import graphs as gr


def brute(x, horizontal):
    out = set()
    for i in range(len(x)):
        top = float("-inf")
        for j in range(i + 1, len(x)):
            sees = (top < min(x[i], x[j])) if horizontal else top < (x[j] - x[i]) / (j - i)
            if sees:
                out.add((i, j))
            top = max(top, x[j] if horizontal else (x[j] - x[i]) / (j - i))
    return out


def many(n, seed):
    rng = random.Random(seed)
    return {
        "random": [rng.random() for _ in range(n)], "ties": [float(rng.randrange(4)) for _ in range(n)], "rising": [float(i) for i in range(n)], "falling": [float(-i) for i in range(n)],
        "walk": np.cumsum([rng.gauss(0, 1) for _ in range(n)]).tolist(), "flat": [1.0] * n, "bowl": [float((i - n / 2) ** 2) for i in range(n)], "one": [3.0],
    }


def frame(spark, series):
    return spark.createDataFrame([(k, dt.date(2000, 1, 1) + dt.timedelta(i), float(v)) for k, x in series.items() for i, v in enumerate(x)], "ticker string, date date, x double").repartition(5)


def found(edges):
    out = {}
    for r in edges.collect():
        out.setdefault(r.ticker, []).append((r.i, r.j))
        assert (r.tj - r.ti).days == r.j - r.i
    assert all(len(e) == len(set(e)) for e in out.values())
    return {k: set(e) for k, e in out.items()}


@pytest.mark.parametrize("chunk", [None, 7, 64])
def test_horizontal_edges_of_whole_series(spark, chunk):
    series = many(500, 3)
    got = found(gr.horizontal_edges(frame(spark, series), "x", chunk=chunk))
    assert all(got.get(k, set()) == brute(x, True) for k, x in series.items())


def test_natural_edges_of_whole_series(spark):
    series = many(500, 4)
    got = found(gr.natural_edges(frame(spark, series), "x"))
    assert all(got.get(k, set()) == brute(x, False) for k, x in series.items())


def test_nulls_are_left_out_and_empty_tables_have_no_edges(spark):
    df = spark.createDataFrame([("a", i, None if i % 3 == 1 else float(i * 7 % 5)) for i in range(20)], "ticker string, date int, x double")
    x = [float(i * 7 % 5) for i in range(20) if i % 3 != 1]
    assert {(r.i, r.j) for r in gr.horizontal_edges(df, "x").collect()} == brute(x, True)
    assert gr.natural_edges(df.limit(0), "x").count() == gr.horizontal_edges(df.limit(0), "x").count() == 0


def test_paths_and_spectrum_of_whole_series(spark, monkeypatch):
    x = many(300, 9)["walk"]
    edges = gr.horizontal_edges(frame(spark, {"a": x}), "x")
    near = [[] for _ in x]
    for i, j in brute(x, True):
        near[i].append(j)
        near[j].append(i)
    lengths = []
    for s in range(len(x)):
        seen, todo = {s: 0}, [s]
        for u in todo:
            for v in near[u]:
                if v not in seen:
                    seen[v] = seen[u] + 1
                    todo.append(v)
        lengths += [d for d in seen.values() if d]
    monkeypatch.setattr(gr, "SOURCES", 128)
    r = gr.path_lengths(edges).first()
    assert r.diameter == max(lengths) and r.mean_path == pytest.approx(np.mean(lengths))
    a = np.zeros((len(x), len(x)))
    for i, j in brute(x, True):
        a[i, j] = a[j, i] = 1
    want = np.linalg.eigvalsh(a)[::-1][:5]
    assert np.allclose(gr.spectrum(edges).first().eigenvalues, want, atol=1e-6)
    monkeypatch.setattr(gr, "DENSE", 10)
    i, j = np.array(sorted(brute(x, True))).T
    assert np.allclose(gr.largest_eigenvalues(i, j, len(x), 5), want, atol=1e-8)
