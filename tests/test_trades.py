"""Books with stops, and rolling graph statistics, against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from strandline.operators import graphs as gr
from strandline.operators import trades as td

D0 = dt.date(2001, 1, 1)


def plain_book(rows, top, every, stop, take, trail):
    """Day by day over all names, as one would keep the book by hand."""
    days, names = sorted({d for _, d, _, _ in rows}), sorted({t for t, _, _, _ in rows})
    at = {(t, d): (r, s) for t, d, r, s in rows}
    held, gained, peak = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    seen = {t: [] for t in names}
    out, closed, due = {}, [], {t: False for t in names}
    for i, d in enumerate(days):
        here = [t for t in names if (t, d) in at]
        choice = sorted((t for t in here if at[t, d][1] is not None), key=lambda t: (-at[t, d][1], t))[:top] if i % every == 0 else None
        for t in here:
            r = at[t, d][0]
            seen[t].append(r)
            last = [x for x in seen[t][-20:] if x is not None]
            dev = np.std(last, ddof=1) if len(last) == 20 else None
            if held[t] > 0.001:
                gained[t] += r or 0.0
                peak[t] = max(peak[t], gained[t])
                fell = dev is not None and peak[t] > 0.02 and gained[t] < peak[t] - trail * dev * math.sqrt(20)
                if gained[t] < -stop or gained[t] > take or fell:
                    closed.append(gained[t])
                    held[t] = gained[t] = peak[t] = 0.0
            want = (1 / len(choice) if t in choice else 0.0) if choice is not None else 0.0 if due[t] else None
            due[t] = False
            if want is not None:
                if want > 0.001 > held[t]:
                    gained[t] = peak[t] = 0.0
                held[t] = want
            out[t, d] = held[t]
        if choice is not None:
            for t in set(names) - set(here):
                due[t] = bool(seen[t])
    return out, closed


def test_stopped_book_equals_the_daily_loop(spark):
    rng = random.Random(4)
    rows = [(f"t{t}", D0 + dt.timedelta(d), None if rng.random() < 0.03 else rng.gauss(0, 0.03), None if rng.random() < 0.1 else round(rng.gauss(0, 1), 1)) for t in range(9) for d in range(150) if rng.random() > 0.1]
    df = spark.createDataFrame(rows, "ticker string, date date, ret double, signal double").repartition(4)
    book = td.stopped_book(df, "signal", top=3, rebalance=10, stop=0.08, take=0.12, trail=0.5)
    want, closed = plain_book(rows, 3, 10, 0.08, 0.12, 0.5)
    got = book.collect()
    assert {(r.ticker, r.date): r.held for r in got} == pytest.approx(want)
    assert sorted(r.closed for r in got if r.closed is not None) == pytest.approx(sorted(closed)) and len(closed) > 20
    one = td.trade_summary(book).first()
    assert (one.trades, one.mean_profit) == (len(closed), pytest.approx(np.mean(closed)))
    assert one.concentration == pytest.approx(sum(sorted(closed)[-10:]) / sum(closed))
    daily = {r.date: r.gross for r in td.book_returns(book).collect()}
    assert daily == pytest.approx({d: sum(want[t, d] * (r or 0) for t, e, r, _ in rows if e == d) for d in daily})
    assert td.trade_summary(book.limit(0)).first().trades == 0


def plain_window(x):
    n = len(x)
    edges = [(i, j) for i in range(n) for j in range(i + 1, n) if all(x[k] < min(x[i], x[j]) for k in range(i + 1, j))]
    near = [{b if a == i else a for a, b in edges if i in (a, b)} for i in range(n)]
    d = np.array([len(s) for s in near])
    share = np.unique(d, return_counts=True)[1] / n
    corners = sum(1 for i in range(n) for a in near[i] for b in near[i] if a < b and b in near[a])
    pairs = np.array([(d[i], d[j]) for i, j in edges], float)
    flat = pairs[:, 0].std() * pairs[:, 1].std()
    mixing = ((pairs[:, 0] * pairs[:, 1]).mean() - pairs[:, 0].mean() * pairs[:, 1].mean()) / flat if flat > 1e-12 else 0.0
    return len(edges), d.std(), d.max(), 1 + n / np.log(d / 0.5).sum(), -(share * np.log2(share + 1e-10)).sum(), 3 * corners / (d * (d - 1) // 2).sum(), mixing


def test_rolling_graph_statistics_equal_each_windows_graph(spark):
    rng = random.Random(6)
    x = {"a": [rng.random() for _ in range(60)], "b": [float(rng.randrange(4)) for _ in range(50)], "c": [1.0] * 10}
    df = spark.createDataFrame([(k, D0 + dt.timedelta(i), v) for k, s in x.items() for i, v in enumerate(s)], "ticker string, date date, x double").repartition(4)
    got = {(r.ticker, (r.date - D0).days): r for r in gr.rolling_statistics(df, "x", 12).collect()}
    assert set(got) == {(k, i) for k, s in x.items() for i in range(11, len(s))}
    for (k, i), r in got.items():
        assert (r.edges, r.degree_std, r.degree_max, r.gamma, r.entropy, r.clustering, r.assortativity) == pytest.approx(plain_window(x[k][i - 11 : i + 1]), abs=1e-9)
    signal = gr.composite_signal(df.withColumn("x", df.x + 1), "x", 12)
    assert {r.ticker for r in signal.collect()} == {"a", "b"}
    q = gr.signal_quality(signal, df.withColumnRenamed("x", "r"), "r").collect()
    assert all(0 <= r.hit_rate <= 1 and -1 <= r.ic <= 1 for r in q)
