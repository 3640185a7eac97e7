"""Order statistics of frames against sorting each frame."""

import numpy as np
import pytest

from strandline.operators.order_stats import Quantile, Ranks, ShareBelow, with_order_stats


def plain(x, w):
    out = []
    for i in range(len(x)):
        frame = [v for v in x[max(0, i + 1 - w.n) if w.n else 0 : i + 1] if not np.isnan(v)]
        least = w.least if w.least is not None else w.n or 1
        if len(frame) < max(least, 1):
            out.append(None)
        elif isinstance(w, Quantile):
            out.append(float(np.quantile(frame, w.p)))
        else:
            out.append(None if np.isnan(x[i]) or len(frame) < 2 else sum(v < x[i] for v in frame) / (len(frame) - 1))
    return out


WANTED = {"a": Quantile("x", 21, 0.5), "b": Quantile("x", 21, 0.8, 3), "c": Quantile("x", 50, 0.0), "d": ShareBelow("x", 10), "e": ShareBelow("x", 30, 2), "f": Quantile("x", 1, 0.3)}
GROWING = {"g": Quantile("x", None, 0.5, 60), "h": ShareBelow("x", None), "i": Quantile("x", None, 1.0)}


@pytest.mark.parametrize("chunk", [None, 50, 64])
def test_frames_equal_sorting_them(spark, chunk):
    rng = np.random.default_rng(2)
    series = {"r": rng.normal(size=300), "t": rng.integers(0, 4, 300).astype(float), "n": np.where(rng.random(200) < 0.3, np.nan, rng.normal(size=200)), "s": np.array([1.5]), "m": np.full(30, np.nan)}
    df = spark.createDataFrame([(k, i, None if np.isnan(v) and i % 2 else float(v)) for k, x in series.items() for i, v in enumerate(x)], "ticker string, date int, x double").repartition(4)
    wanted = WANTED if chunk else WANTED | GROWING
    got = {}
    out = with_order_stats(df, wanted, chunk=chunk)
    assert out.columns == [*df.columns, *wanted]
    for r in out.orderBy("ticker", "date").collect():
        got.setdefault(r.ticker, []).append(r)
    for k, x in series.items():
        assert len(got[k]) == len(x)
        for name, w in wanted.items():
            for a, b in zip(got[k], plain(x, w)):
                assert (a[name] is None) == (b is None) and (b is None or a[name] == pytest.approx(b, abs=1e-12)), (k, name)


def test_one_series_and_empty_tables(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(40)], "date int, x double")
    got = [r.q for r in with_order_stats(df, {"q": Quantile("x", None, 0.5)}, key=None).orderBy("date").collect()]
    assert got == [float(np.median([v % 7 for v in range(i + 1)])) for i in range(40)]
    assert with_order_stats(df.limit(0), {"q": Quantile("x", 3, 0.5)}, key=None).count() == 0
    with pytest.raises(ValueError):
        with_order_stats(df, {"q": Quantile("x", None, 0.5)}, key=None, chunk=10)


def test_ranks():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 100):
        x = rng.integers(0, max(2, n // 3), n).astype(float)
        ranks = Ranks(x)
        low = rng.integers(0, n, 300)
        high = np.minimum(low + rng.integers(1, n + 1, 300), n)
        k = (rng.random(300) * (high - low)).astype(np.int64)
        bound = rng.integers(-1, n + 2, 300).astype(float)
        assert ranks.kth(low, high, k).tolist() == [sorted(x[a:b])[c] for a, b, c in zip(low, high, k)]
        assert ranks.below(low, high, bound).tolist() == [int((x[a:b] < c).sum()) for a, b, c in zip(low, high, bound)]
