"""Recursions along one series: exponential smoothing, Kalman filters, position and stop machines.

Each runs as one grouped map per ticker (or strategy) on numpy arrays: the state of a row depends on the
row before, which no window frame expresses in less than quadratic time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandline.functions.shipping import ship
from strandline.operators.windows import KEY, TIME, ewm_alpha


def along(df: DataFrame, columns: dict[str | tuple[str, ...], Callable[[pd.DataFrame], np.ndarray]], key: str | Sequence[str] = KEY, time: str = TIME, kinds: dict[str, T.DataType] | None = None) -> DataFrame:
    """Add columns computed from each series in the order of ``time``; a tuple of names takes the columns of one array."""
    added = [c for k in columns for c in ([k] if isinstance(k, str) else k)]
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *(T.StructField(c, (kinds or {}).get(c, T.DoubleType())) for c in added)])
    names = [f.name for f in kept]

    ship(df.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time, kind="stable")[names].reset_index(drop=True)
        new: dict[str, np.ndarray] = {}
        for c, f in columns.items():
            got = f(g)
            new |= {c: got} if isinstance(c, str) else {name: got[:, i] for i, name in enumerate(c)}
        return g.assign(**new)

    return df.groupBy(*([key] if isinstance(key, str) else key)).applyInPandas(run, schema)


def values(g: pd.DataFrame, x: str) -> np.ndarray:
    return g[x].to_numpy(dtype=float, na_value=np.nan)


def ewm(x: str, adjust: bool = False, **decay: float) -> Callable[[pd.DataFrame], np.ndarray]:
    """Exponentially weighted mean; with ``adjust`` the weights of the finite past are normalised."""
    a = ewm_alpha(**decay)
    return lambda g: g[x].astype(float).ewm(alpha=a, adjust=adjust).mean().to_numpy()


def decay_smooth(x: str, alpha: float) -> Callable[[pd.DataFrame], np.ndarray]:
    """s = alpha x + (1 - alpha) s, from the first value; missing values keep the state."""

    def f(g: pd.DataFrame) -> np.ndarray:
        out, s = np.full(len(g), np.nan), np.nan
        for i, v in enumerate(values(g, x)):
            if not np.isnan(v):
                s = v if np.isnan(s) else alpha * v + (1 - alpha) * s
            out[i] = s
        return out

    return f


def adaptive_smooth(x: str, alpha: str) -> Callable[[pd.DataFrame], np.ndarray]:
    """As decay_smooth with the row's own alpha."""

    def f(g: pd.DataFrame) -> np.ndarray:
        out, s = np.full(len(g), np.nan), np.nan
        for i, (v, a) in enumerate(zip(values(g, x), values(g, alpha))):
            if not np.isnan(v):
                s = v if np.isnan(s) else a * v + (1 - a) * s
            out[i] = s
        return out

    return f


def kalman_gains(n: int, q: float, r: float, p0: float) -> np.ndarray:
    """The gains of a local level filter; they don't depend on the data."""
    out, p = np.empty(n), p0
    for i in range(n):
        p += q
        out[i] = p / (p + r)
        p *= 1 - out[i]
    return out


def kalman_level(x: str, q: float = 1e-5, r: float = 1e-2, p0: float = 1.0) -> Callable[[pd.DataFrame], np.ndarray]:
    """Local level from the first observation; missing observations keep the level."""

    def f(g: pd.DataFrame) -> np.ndarray:
        out, s, p = np.full(len(g), np.nan), np.nan, p0
        for i, v in enumerate(values(g, x)):
            if np.isnan(s):
                s = v
            else:
                p += q
                if not np.isnan(v):
                    k = p / (p + r)
                    s, p = s + k * (v - s), p * (1 - k)
            out[i] = s
        return out

    return f


def kalman_trend(x: str, q: float = 1e-4, r: float = 1e-2, velocity: bool = False) -> Callable[[pd.DataFrame], np.ndarray]:
    """Level (or its velocity) of a constant-velocity filter with unit initial covariance."""

    def f(g: pd.DataFrame) -> np.ndarray:
        step, noise = np.array([[1.0, 1.0], [0.0, 1.0]]), q * np.eye(2)
        state, cov, out = None, np.eye(2), np.full(len(g), np.nan)
        for i, v in enumerate(values(g, x)):
            if state is None:
                if np.isnan(v):
                    continue
                state = np.array([v, 0.0])
            else:
                state, cov = step @ state, step @ cov @ step.T + noise
                if not np.isnan(v):
                    k = cov[:, 0] / (cov[0, 0] + r)
                    state, cov = state + k * (v - state[0]), cov - np.outer(k, cov[0])
            out[i] = state[1 if velocity else 0]
        return out

    return f


def kalman_diagnostics(x: str, q: float, r: float, p0: float = 1.0) -> dict[tuple[str, ...], Callable[[pd.DataFrame], np.ndarray]]:
    """innovation, innovation variance and log-likelihood of the local level filter."""

    def all_of(g: pd.DataFrame) -> np.ndarray:
        out, s, p = np.full((len(g), 3), np.nan), np.nan, p0
        for i, v in enumerate(values(g, x)):
            if np.isnan(s):
                s = v
                continue
            p += q
            if np.isnan(v):
                continue
            e, var = v - s, p + r
            out[i] = e, var, -0.5 * (np.log(2 * np.pi * var) + e * e / var)
            k = p / var
            s, p = s + k * e, p * (1 - k)
        return out

    return {("innovation", "innovation_var", "loglik"): all_of}


def hysteresis(x: str, enter: float = 0.15, leave: float = 0.30) -> Callable[[pd.DataFrame], np.ndarray]:
    """Positions by rank: long above 1 - enter until below 1 - leave, short below enter until above leave."""

    def f(g: pd.DataFrame) -> np.ndarray:
        out, pos = np.zeros(len(g)), 0.0
        for i, v in enumerate(values(g, x)):
            if not np.isnan(v):
                if pos > 0 and v < 1 - leave or pos < 0 and v > leave:
                    pos = 0.0
                if pos == 0:
                    pos = 1.0 if v >= 1 - enter else -1.0 if v <= enter else 0.0
            out[i] = pos
        return out

    return f


def pair_trades(z: str, enter: float = 2.0, leave: float = 0.5, stop: float = 4.0) -> Callable[[pd.DataFrame], np.ndarray]:
    """Spread position: against the spread beyond ``enter``, flat within ``leave`` or beyond ``stop``."""

    def f(g: pd.DataFrame) -> np.ndarray:
        out, pos = np.zeros(len(g)), 0.0
        for i, v in enumerate(values(g, z)):
            if not np.isnan(v):
                if pos and (abs(v) < leave or abs(v) > stop):
                    pos = 0.0
                elif not pos and enter < abs(v) <= stop:
                    pos = -float(np.sign(v))
            out[i] = pos
        return out

    return f


def stops(ret: str, position: str, stop: float = 0.05, take: float | None = None, lookahead: bool = False) -> Callable[[pd.DataFrame], np.ndarray]:
    """Positions with a stop loss and take profit on the return since entry; a breach acts from the next
    row, with ``lookahead`` from the row itself. A new entry needs the wanted position to change."""

    def f(g: pd.DataFrame) -> np.ndarray:
        out, gained, was, barred = np.zeros(len(g)), 1.0, 0.0, False
        for i, (r, p) in enumerate(zip(values(g, ret), values(g, position))):
            p, r = (0.0 if np.isnan(p) else p), (0.0 if np.isnan(r) else r)
            if np.sign(p) != np.sign(was):
                gained, barred = 1.0, False
            was = p
            held = 0.0 if barred else p
            if held:
                gained *= 1 + np.sign(held) * r
                if gained - 1 <= -stop or take is not None and gained - 1 >= take:
                    barred = True
                    held = 0.0 if lookahead else held
            out[i] = held
        return out

    return f


def trailing_stop(ret: str, trail: float = 0.03, cooldown: int = 5) -> Callable[[pd.DataFrame], np.ndarray]:
    """Returns of a book that leaves the market for ``cooldown`` rows after falling ``trail`` from its peak."""

    def f(g: pd.DataFrame) -> np.ndarray:
        out, value, peak, rest = np.zeros(len(g)), 1.0, 1.0, 0
        for i, r in enumerate(values(g, ret)):
            if rest:
                rest -= 1
                if not rest:
                    value = peak = 1.0
                continue
            out[i] = 0.0 if np.isnan(r) else r
            value *= 1 + out[i]
            peak = max(peak, value)
            if value / peak - 1 <= -trail:
                rest = cooldown
        return out

    return f


def portfolio_stops(ret: str, stop: float = 0.05, take: float = 0.1, cooldown: int = 5) -> Callable[[pd.DataFrame], np.ndarray]:
    """Returns of a book that leaves the market for ``cooldown`` rows once it has lost ``stop`` or gained ``take`` since it last entered."""

    def f(g: pd.DataFrame) -> np.ndarray:
        out, value, rest = np.zeros(len(g)), 1.0, 0
        for i, r in enumerate(values(g, ret)):
            if rest:
                rest -= 1
                continue
            out[i] = 0.0 if np.isnan(r) else r
            value *= 1 + out[i]
            if value - 1 <= -stop or value - 1 >= take:
                value, rest = 1.0, cooldown
        return out

    return f
