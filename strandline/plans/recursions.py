"""DuckDB SQL of queries whose rows depend on the row before, and of composed queries: recursive and windowed forms of their definitions."""

from __future__ import annotations

from strandline.plans.kernels import _LP_PAIR
from strandline.plans.registry import ORACLES, PX, R, TICKER, lagged, rank, roll, staged
from strandline.plans.research import _BOOK, _DAILY, _TOP, SIG


def recursive(ctes: str, base: str, first: dict[str, str], then: dict[str, str], columns: str, tail: str, by: str = "ticker") -> str:
    """States row by row: ``first`` on the first row of each series, ``then`` from p (the row before) and r (the row itself)."""
    kept = ["date", "step", *columns.split()]
    return (
        f"WITH RECURSIVE {ctes}, rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY date) AS step FROM {base}), "
        f"k AS (SELECT {by}, {', '.join(kept)}, {', '.join(f'{e} AS {c}' for c, e in first.items())} FROM rows r WHERE step = 1 "
        f"UNION ALL SELECT r.{by}, {', '.join('r.' + c for c in kept)}, {', '.join(f'{e} AS {c}' for c, e in then.items())} FROM k p JOIN rows r ON r.{by} = p.{by} AND r.step = p.step + 1) {tail}"
    )


def out(columns: str, source: str = "k", keys: str = "ticker, date", digits: int = 6) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns.split()) + f" FROM {source}"


_LP = PX + ", b AS (SELECT ticker, date, ln(close) AS lp FROM px)"
_PRIOR = "(p.v + 1e-5)"
_GAIN = f"{_PRIOR} / ({_PRIOR} + 1e-2)"
_LEVEL = ({"s": "lp", "v": "CAST(1 AS DOUBLE)"}, {"s": f"p.s + {_GAIN} * (r.lp - p.s)", "v": f"{_PRIOR} * (1 - {_GAIN})"})

ORACLES["ss1_kalman_level"] = recursive(_LP, "b", *_LEVEL, "lp", "SELECT ticker, date, round(s, 6) + 0.0 AS trend, round(s - lp, 6) + 0.0 AS deviation FROM k")

_E, _S = "(r.lp - p.s)", f"({_PRIOR} + 1e-2)"
ORACLES["ss3_kalman_diagnostics"] = recursive(
    _LP, "b", {**_LEVEL[0], "e": "CAST(NULL AS DOUBLE)", "w": "CAST(NULL AS DOUBLE)"}, {**_LEVEL[1], "e": _E, "w": _S}, "lp",
    "SELECT ticker, date, round(e, 6) + 0.0 AS innovation, round(w, 6) + 0.0 AS innovation_var, round(-0.5 * (ln(2 * pi() * w) + e * e / w), 6) + 0.0 AS loglik FROM k",
)

_A, _P00, _P01, _P11 = "(p.a + p.b)", "(p.c00 + 2 * p.c01 + p.c11 + 1e-4)", "(p.c01 + p.c11)", "(p.c11 + 1e-4)"
_K0, _K1 = f"({_P00} / ({_P00} + 1e-2))", f"({_P01} / ({_P00} + 1e-2))"
ORACLES["ss2_kalman_trend"] = recursive(
    _LP, "b", {"a": "lp", "b": "CAST(0 AS DOUBLE)", "c00": "CAST(1 AS DOUBLE)", "c01": "CAST(0 AS DOUBLE)", "c11": "CAST(1 AS DOUBLE)"},
    {"a": f"{_A} + {_K0} * (r.lp - {_A})", "b": f"p.b + {_K1} * (r.lp - {_A})", "c00": f"{_P00} * (1 - {_K0})", "c01": f"{_P01} * (1 - {_K0})", "c11": f"{_P11} - {_K1} * {_P01}"}, "lp",
    "SELECT ticker, date, round(a, 6) + 0.0 AS level, round(b, 6) + 0.0 AS velocity FROM k",
)

ORACLES["fe4_kalman_features"] = recursive(
    _LP, "b", *_LEVEL, "lp",
    f", t AS (SELECT *, s - lp AS kalman_trend, s - lag(s, 5) OVER ({TICKER}) AS kalman_slope FROM k), u AS (SELECT *, (kalman_trend - ({roll('avg', 'kalman_trend', 63)})) / (({roll('stddev_samp', 'kalman_trend', 63)}) + 1e-10) AS kalman_zscore, "
    f"kalman_slope - lag(kalman_slope, 5) OVER ({TICKER}) AS kalman_curvature, abs(kalman_trend) AS kalman_deviation FROM t) " + out("kalman_trend kalman_zscore kalman_slope kalman_curvature kalman_deviation", "u"),
)

_ALPHA = SIG + f", v AS (SELECT *, {roll('stddev_samp', 'ret', 21)} AS vol_21d FROM g), a AS (SELECT *, CASE WHEN coalesce(vol_21d > ({roll('quantile_cont({x}, 0.8)', 'vol_21d', 126)}), false) THEN 0.1 ELSE 0.3 END AS alpha FROM v)"
ORACLES["sg6_adaptive_ema"] = recursive(
    _ALPHA, "a", {"smooth": "signal"}, {"smooth": "CASE WHEN r.signal IS NULL THEN p.smooth WHEN p.smooth IS NULL THEN r.signal ELSE r.alpha * r.signal + (1 - r.alpha) * p.smooth END"}, "signal alpha", out("smooth")
)


def _held(was: str) -> str:
    kept = f"CASE WHEN {was} > 0 AND r.k < 0.7 OR {was} < 0 AND r.k > 0.3 THEN 0.0 ELSE {was} END"
    return f"CASE WHEN r.k IS NULL THEN {was} WHEN ({kept}) <> 0 THEN {was} WHEN r.k >= 0.85 THEN 1.0 WHEN r.k <= 0.15 THEN -1.0 ELSE 0.0 END"


ORACLES["sg7_hysteresis"] = recursive(SIG + _BOOK.replace(", k AS", ", k0 AS"), "k0", {"position": _held("CAST(0.0 AS DOUBLE)")}, {"position": _held("p.position")}, "k", out("position"))

_FLIP = "sign(coalesce(r.pos, 0)) <> sign(p.was)"
_BARRED0, _GAINED0 = f"(NOT ({_FLIP}) AND p.barred)", f"(CASE WHEN {_FLIP} THEN 1.0 ELSE p.gained END)"
_HELD = f"(CASE WHEN {_BARRED0} THEN 0.0 ELSE coalesce(r.pos, 0) END)"
_GAINED1 = f"(CASE WHEN {_HELD} <> 0 THEN {_GAINED0} * (1 + sign({_HELD}) * coalesce(r.ret, 0)) ELSE {_GAINED0} END)"
ORACLES["bt11_stop_loss"] = recursive(
    SIG + _BOOK.replace(", k AS", ", k0 AS") + _TOP.replace("FROM k)", "FROM k0)"), "w",
    {"was": "CAST(coalesce(pos, 0) AS DOUBLE)", "held": "CAST(coalesce(pos, 0) AS DOUBLE)", "gained": "CAST(CASE WHEN coalesce(pos, 0) <> 0 THEN 1 + sign(pos) * coalesce(ret, 0) ELSE 1 END AS DOUBLE)", "barred": "coalesce(pos, 0) <> 0 AND sign(pos) * coalesce(ret, 0) <= -0.5"},
    {"was": "CAST(coalesce(r.pos, 0) AS DOUBLE)", "held": f"CAST({_HELD} AS DOUBLE)", "gained": f"CAST({_GAINED1} AS DOUBLE)", "barred": f"{_BARRED0} OR ({_HELD} <> 0 AND {_GAINED1} - 1 <= -0.5)"}, "ret pos",
    f", h AS (SELECT *, coalesce({lagged('held')}, 0) AS p FROM k), d AS (SELECT *, abs(p - {lagged('p')}) AS d FROM h), e AS (SELECT date, sum(p * coalesce(ret, 0)) AS gross, coalesce(sum(d), 0) AS turnover FROM d GROUP BY date) "
    "SELECT date, round(gross, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round(gross - turnover * 0.001, 6) + 0.0 AS net FROM e",
)

_OUT = "(CASE WHEN p.rest > 0 THEN 0.0 ELSE r.net END)"
_VALUE = f"(p.value * (1 + {_OUT}))"
_FELL = f"({_VALUE} / greatest(p.peak, {_VALUE}) - 1 <= -0.01)"
ORACLES["bt13_trailing_stop"] = recursive(
    _DAILY + ", one AS (SELECT 'equal' AS strategy, date, net FROM daily)", "one",
    {"stopped": "net", "value": "1 + net", "peak": "greatest(1.0, 1 + net)", "rest": "CASE WHEN (1 + net) / greatest(1.0, 1 + net) - 1 <= -0.01 THEN 5 ELSE 0 END"},
    {"stopped": _OUT, "value": f"CASE WHEN p.rest = 1 THEN 1.0 WHEN p.rest > 1 THEN p.value ELSE {_VALUE} END", "peak": f"CASE WHEN p.rest = 1 THEN 1.0 WHEN p.rest > 1 THEN p.peak ELSE greatest(p.peak, {_VALUE}) END", "rest": f"CASE WHEN p.rest > 0 THEN p.rest - 1 WHEN {_FELL} THEN 5 ELSE 0 END"},
    "net", "SELECT date, round(stopped, 6) + 0.0 AS stopped FROM k", "strategy",
)

ORACLES["ps8_smoothed_weights"] = recursive(
    SIG + _BOOK.replace(", k AS", ", k0 AS") + _TOP.replace("FROM k)", "FROM k0)"), "w", {"s": "CAST(pos AS DOUBLE)"}, {"s": "0.2 * r.pos + 0.8 * p.s"}, "pos",
    ", n AS (SELECT ticker, date, coalesce(s / nullif(sum(abs(s)) OVER (PARTITION BY date), 0), 0) AS position FROM k) " + out("position", "n"),
)

# Books with stops on summed returns: day of each date, the five best of every 21st date, and the states of each name.
_DAYS = SIG + f", dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM g)), k0 AS (SELECT g.*, day, day // 21 AS period, row_number() OVER (PARTITION BY date ORDER BY signal DESC NULLS LAST, ticker) AS place, count(signal) OVER (PARTITION BY date) AS c, {roll('stddev_samp', 'ret', 20)} AS dev FROM g JOIN dd USING (date)), t AS (SELECT *, CASE WHEN day % 21 = 0 THEN CASE WHEN signal IS NOT NULL AND place <= 5 THEN 1.0 / least(c, 5) ELSE 0.0 END WHEN period <> lag(period) OVER ({TICKER}) THEN 0.0 END AS want FROM k0)"
_ON = "p.held > 0.001"
_SUM = f"(CASE WHEN {_ON} THEN p.gained + coalesce(r.ret, 0) ELSE p.gained END)"
_TOP0 = f"(CASE WHEN {_ON} THEN greatest(p.peak, {_SUM}) ELSE p.peak END)"
_GONE = f"({_ON} AND ({_SUM} < -0.5 OR {_SUM} > 1.0 OR coalesce({_TOP0} > 0.02 AND {_SUM} < {_TOP0} - 0.3 * r.dev * sqrt(20), false)))"
_STAYS = f"(CASE WHEN {_GONE} THEN 0.0 ELSE p.held END)"
_ANEW = f"({_GONE} OR coalesce(r.want > 0.001 AND {_STAYS} < 0.001, false))"
_TRADES = (
    _DAYS, "t", {"held": "CAST(coalesce(want, 0) AS DOUBLE)", "gained": "CAST(0 AS DOUBLE)", "peak": "CAST(0 AS DOUBLE)", "closed": "CAST(NULL AS DOUBLE)"},
    {"held": f"CAST(coalesce(r.want, {_STAYS}) AS DOUBLE)", "gained": f"CASE WHEN {_ANEW} THEN 0.0 ELSE {_SUM} END", "peak": f"CASE WHEN {_ANEW} THEN 0.0 ELSE {_TOP0} END", "closed": f"CASE WHEN {_GONE} THEN {_SUM} END"}, "ret want dev",
)
ORACLES["bt24_stopped_trailing"] = recursive(
    *_TRADES, f", h AS (SELECT *, abs(held - coalesce({lagged('held')}, 0)) AS d FROM k), e AS (SELECT date, sum(held * coalesce(ret, 0)) AS gross, sum(d) AS turnover FROM h GROUP BY date) "
    "SELECT date, round(gross, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round(gross - turnover * 0.001, 6) + 0.0 AS net FROM e",
)
ORACLES["bt24_trade_concentration"] = recursive(
    *_TRADES, ", c AS (SELECT closed, row_number() OVER (ORDER BY closed DESC) AS place FROM k WHERE closed IS NOT NULL) SELECT count(*) AS trades, round(avg(closed), 5) + 0.0 AS mean_profit, round(avg(CASE WHEN closed > 0 THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS won, "
    "round(coalesce(sum(closed) FILTER (place <= 10) / nullif(sum(closed), 0), 0), 5) + 0.0 AS concentration FROM c",
)


def book_of_rules(top: int = 10, bottom: int = 0, every: int = 5, on_new: float = 1.0, bias: float = 0.5, stop: float | None = None, trail: float | None = None, cooldown: int = 5, digits: int = 6) -> str:
    """A path-dependent book date by date: the names held with weight and return since entry are one list."""
    none = "CAST([] AS STRUCT(t VARCHAR, w DOUBLE, g DOUBLE)[])"
    of = lambda names, t, field="w": f"coalesce(list_sum(list_transform(list_filter({names}, lambda q: q.t = {t}), lambda q: q.{field})), 0)"
    side = f"(CASE WHEN len(downs) > 0 THEN {bias} ELSE 1.0 END)"
    new = f"list_concat(list_transform(ups, lambda t: struct_pack(t := t, w := CAST({side} / len(ups) AS DOUBLE))), list_transform(downs, lambda t: struct_pack(t := t, w := CAST(-(1 - {side}) / len(downs) AS DOUBLE))))"
    mixed = f"list_transform(list_distinct(list_concat(list_transform(fresh, lambda y: y.t), list_transform(kept, lambda y: y.t))), lambda t: struct_pack(t := t, w := {on_new} * {of('fresh', 't')} + (1 - {on_new}) * {of('kept', 't')}))"
    fell = f"(v1 / p1 - 1 <= -{trail})" if trail is not None else "false"
    first = (
        "SELECT r.step, r.date, p.held AS old, r.ups, r.downs, p.rest, p.clock, p.value, p.peak, coalesce(list_sum(list_transform(list_filter(p.held, lambda y: r.rets[y.t] IS NOT NULL), lambda y: y.w * r.rets[y.t])), 0) AS gross, "
        "list_transform(p.held, lambda y: struct_pack(t := y.t, w := y.w, g := CASE WHEN r.rets[y.t] IS NOT NULL THEN (1 + y.g) * (1 + sign(y.w) * r.rets[y.t]) - 1 ELSE y.g END)) AS moved FROM k p JOIN d r ON r.step = p.step + 1"
    )
    second = f"SELECT *, value * (1 + gross) AS v1, greatest(peak, value * (1 + gross)) AS p1, {'moved' if stop is None else f'list_filter(moved, lambda y: y.g > -{stop})'} AS kept, {new} AS fresh FROM ({first})"
    third = f"SELECT *, CASE WHEN rest > 0 THEN 'rests' WHEN {fell} THEN 'leaves' WHEN clock % {every} = 0 THEN 'chooses' ELSE 'stays' END AS does, {mixed} AS mixed FROM ({second})"
    fourth = f"SELECT *, CASE does WHEN 'leaves' THEN {none} WHEN 'chooses' THEN list_transform(list_filter(mixed, lambda y: abs(y.w) > 1e-6), lambda y: struct_pack(t := y.t, w := y.w / list_sum(list_transform(mixed, lambda z: abs(z.w))), g := CAST(0 AS DOUBLE))) ELSE kept END AS next FROM ({third})"
    turned = f"coalesce(list_sum(list_transform(list_distinct(list_concat(list_transform(next, lambda y: y.t), list_transform(old, lambda y: y.t))), lambda t: abs({of('next', 't')} - {of('old', 't')}))), 0)"
    last = (
        f"SELECT step, date, list_transform(next, lambda y: struct_pack(t := y.t, w := y.w, g := CASE WHEN sign({of('old', 'y.t')}) = sign(y.w) THEN {of('moved', 'y.t', 'g')} ELSE 0 END)) AS held, "
        f"CASE WHEN does = 'rests' AND rest = 1 THEN 1.0 ELSE v1 END AS value, CASE WHEN does = 'rests' AND rest = 1 THEN 1.0 ELSE p1 END AS peak, CASE does WHEN 'rests' THEN rest - 1 WHEN 'leaves' THEN {cooldown} ELSE 0 END AS rest, "
        f"CASE WHEN does IN ('chooses', 'stays') THEN clock + 1 ELSE clock END AS clock, gross, {turned} AS turnover FROM ({fourth})"
    )
    ranked = "SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal DESC, ticker) AS place, count(*) OVER (PARTITION BY date) AS c FROM g WHERE signal IS NOT NULL"
    return (
        f"WITH RECURSIVE {SIG}, ranked AS ({ranked}), u AS (SELECT date, list(ticker ORDER BY place) FILTER (place <= {top}) AS ups, coalesce(list(ticker ORDER BY place) FILTER (c >= {top + bottom} AND place > c - {bottom}), []) AS downs FROM ranked GROUP BY date), "
        "a AS (SELECT date, map_from_entries(list((ticker, ret)) FILTER (ret IS NOT NULL)) AS rets FROM g GROUP BY date), "
        "d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY date) AS step, date, coalesce(rets, map_from_entries(CAST([] AS STRUCT(k VARCHAR, v DOUBLE)[]))) AS rets, coalesce(ups, CAST([] AS VARCHAR[])) AS ups, coalesce(downs, CAST([] AS VARCHAR[])) AS downs FROM a LEFT JOIN u USING (date)), "
        f"k AS (SELECT CAST(0 AS BIGINT) AS step, CAST(NULL AS DATE) AS date, {none} AS held, CAST(1 AS DOUBLE) AS value, CAST(1 AS DOUBLE) AS peak, 0 AS rest, 0 AS clock, CAST(0 AS DOUBLE) AS gross, CAST(0 AS DOUBLE) AS turnover UNION ALL {last}) "
        f"SELECT 'book' AS strategy, date, round(gross, {digits}) + 0.0 AS gross, round(turnover, {digits}) + 0.0 AS turnover, round(gross - turnover * 0.001, {digits}) + 0.0 AS net, CAST(len(held) AS BIGINT) AS names FROM k WHERE step > 0"
    )


ORACLES["bt12_path_dependent_stops"] = book_of_rules(top=5, every=5, stop=0.5)
ORACLES["bt15_smoothed_long_bias"] = book_of_rules(top=5, bottom=5, every=5, on_new=0.5, bias=0.7)
ORACLES["bt21_regime_blend"] = book_of_rules(top=5, every=5, trail=0.3, cooldown=5, on_new=0.5, digits=10)  # weights are sums of powers of one half, so six digits would often be halfway

# -- composed queries -----------------------------------------------------------------------------------------

_MOM = {f"mom_{n}d": roll("sum", "ret", n) for n in (5, 10, 21, 63)} | {"pos": "CASE WHEN ret IS NOT NULL THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END"}
_VOL = {f"vol_{n}d": roll("stddev_samp", "ret", n) for n in (5, 10, 21)}
_REV = {"lp": "ln(close)", "up": "CASE WHEN ret IS NOT NULL THEN greatest(ret, 0.0) END", "ab": "abs(ret)"}
_MOM2 = {"mom_acceleration": "mom_5d - mom_21d", "mom_reversal": "-mom_5d", "mom_consistency": roll("avg", "pos", 21), "mom_zscore": f"(mom_21d - ({roll('avg', 'mom_21d', 63)})) / (({roll('stddev_samp', 'mom_21d', 63)}) + 1e-10)"}
_VOL2 = {"vol_ratio": "vol_5d / (vol_21d + 1e-10)", "vol_zscore": f"(vol_21d - ({roll('avg', 'vol_21d', 63)})) / (({roll('stddev_samp', 'vol_21d', 63)}) + 1e-10)", "vol_regime": f"CASE WHEN coalesce(vol_21d > ({roll('quantile_cont({x}, 0.8)', 'vol_21d', 126)}), false) THEN 1.0 ELSE 0.0 END"}
_REV2 = {"ma_20_dev": f"lp - ({roll('avg', 'lp', 20)})", "ma_50_dev": f"lp - ({roll('avg', 'lp', 50)})", "bb_position": f"(lp - ({roll('avg', 'lp', 20)})) / (2 * ({roll('stddev_samp', 'lp', 20)}) + 1e-10)", "rsi_21": f"({roll('sum', 'up', 21)}) / (({roll('sum', 'ab', 21)}) + 1e-10)"}
_PANEL = [_MOM | _VOL | _REV, _MOM2 | _VOL2 | _REV2]
ORACLES["fe8_panel_builder"] = staged(
    *_PANEL, {f"{c}_rank": rank(c) for c in ("mom_5d", "mom_21d", "vol_21d", "mom_zscore")},
    keep=" ".join([f"mom_{n}d" for n in (5, 10, 21, 63)] + ["mom_consistency"] + [f"vol_{n}d" for n in (5, 10, 21)] + "rsi_21 mom_acceleration mom_reversal mom_zscore vol_ratio vol_zscore vol_regime ma_20_dev ma_50_dev bb_position mom_5d_rank mom_21d_rank vol_21d_rank mom_zscore_rank".split()),
)

_CENTRES = ("0.5 * lo", "(lo + hi) / 2", "1.5 * hi")
_POWERS = {f"e{i}": f"-pow((v - {c}) / (hi - lo + 1e-10), 2)" for i, c in enumerate(_CENTRES)}
_TOPPED = {f"x{i}": f"exp(e{i} - greatest(e0, e1, e2))" for i in range(3)}
_PROBS = {n: f"CASE WHEN hi <= lo THEN {d} ELSE x{i} / (x0 + x1 + x2) END" for i, (n, d) in enumerate((("p_low", 0.33), ("p_mid", 0.34), ("p_high", 0.33)))}
ORACLES["fe6_regime_interactions"] = staged(
    {**_MOM, **_VOL, "v": roll("stddev_samp", "ret", 63)}, {"mom_reversal": "-mom_5d", "lo": roll("quantile_cont({x}, 0.33)", "v", 252), "hi": roll("quantile_cont({x}, 0.67)", "v", 252)}, _POWERS, _TOPPED, _PROBS,
    {"state": "CASE WHEN v IS NULL OR lo IS NULL THEN 0 WHEN v <= lo THEN 0 WHEN v >= hi THEN 2 ELSE 1 END", "conf": "greatest(p_low, p_mid, p_high)", "ent": "coalesce(-(p_low * ln(p_low + 1e-10) + p_mid * ln(p_mid + 1e-10) + p_high * ln(p_high + 1e-10)), 0)"},
    {"turned": f"CASE WHEN state IS DISTINCT FROM {lagged('state')} THEN rn END"}, {"began": f"max(turned) OVER ({TICKER} ROWS UNBOUNDED PRECEDING)"},
    {"mom_x_confidence": "mom_21d * conf", "reversal_x_high": "mom_reversal * p_high", "mom_x_duration": "mom_21d * least(rn - began + 1, 20) / 20.0", "vol_x_entropy": "vol_21d * ent"},
    keep="mom_x_confidence reversal_x_high mom_x_duration vol_x_entropy",
)

ORACLES["fe32_average_correlation"] = (
    f"WITH {R}, j AS (SELECT a.ticker AS t1, b.ticker AS t2, a.date, a.ret AS x, b.ret AS y FROM r a JOIN r b ON a.date = b.date AND a.ticker < b.ticker WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL), "
    "c AS (SELECT date, CASE WHEN count(*) OVER w >= 63 THEN covar_pop(x, y) OVER w / nullif(stddev_pop(x) OVER w * stddev_pop(y) OVER w, 0) END AS c FROM j WINDOW w AS (PARTITION BY t1, t2 ORDER BY date ROWS 62 PRECEDING)) "
    "SELECT date, round(avg(c), 5) + 0.0 AS avg_corr, count(c) AS pairs FROM c GROUP BY date"
)

_DAYS = ", dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM w))"


def _held_and_backtest(f: int, factor: float) -> str:
    """SQL after a table w with ticker, date, ret and pos: positions of every f-th day held, lagged, with turnover and costs."""
    return (
        f"{_DAYS}, y AS (SELECT w.*, dd.day, dd.day // {f} AS bucket FROM w JOIN dd USING (date)), z AS (SELECT y.ticker, y.date, y.ret, coalesce(o.pos, 0.0) AS pos FROM y LEFT JOIN y o ON o.ticker = y.ticker AND o.day = y.bucket * {f}), "
        f"h AS (SELECT *, coalesce({lagged('pos')}, 0) AS p FROM z), d AS (SELECT *, abs(p - {lagged('p')}) AS d FROM h), e AS (SELECT date, sum(p * coalesce(ret, 0)) AS gross, {factor} * coalesce(sum(d), 0) AS turnover FROM d GROUP BY date) "
        "SELECT date, round(CAST(gross AS DOUBLE), 6) + 0.0 AS gross, round(CAST(turnover AS DOUBLE), 6) + 0.0 AS turnover, round(CAST(gross - turnover * 0.001 AS DOUBLE), 6) + 0.0 AS net FROM e"
    )


ORACLES["bt7_inverse_vol_long_short"] = (
    f"WITH {SIG}, v AS (SELECT *, {roll('stddev_samp', 'ret', 21)} AS vol FROM g), m AS (SELECT *, coalesce(vol, quantile_cont(vol, 0.5) OVER (PARTITION BY date)) AS u FROM v), q AS (SELECT *, sign(signal) / nullif(u, 0) AS a FROM m), "
    "w AS (SELECT *, coalesce(a / nullif(sum(abs(a)) OVER (PARTITION BY date), 0), 0) AS pos FROM q)" + _held_and_backtest(5, 0.5)
)
ORACLES["bt23_softmax_control"] = (
    f"WITH {SIG}, q AS (SELECT *, exp(signal / 2.0 - max(signal / 2.0) OVER (PARTITION BY date)) AS x FROM g), w AS (SELECT *, coalesce(x / nullif(sum(x) OVER (PARTITION BY date), 0), 0) AS pos FROM q)" + _held_and_backtest(20, 1.0)
)

ORACLES["bt8_long_short_rebalanced"] = f"""WITH {SIG}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM g)),
    x AS (SELECT g.*, dd.day, dd.day // 5 AS bucket FROM g JOIN dd USING (date) WHERE signal IS NOT NULL),
    f AS (SELECT ticker, bucket, row_number() OVER (PARTITION BY date ORDER BY signal DESC, ticker) AS u, row_number() OVER (PARTITION BY date ORDER BY signal, ticker) AS l, greatest(floor(count(*) OVER (PARTITION BY date) * 0.2), 1) AS k FROM x WHERE day % 5 = 0),
    c AS (SELECT ticker, bucket, (u <= k)::INT - (l <= k)::INT AS leg FROM f WHERE (u <= k)::INT <> (l <= k)::INT),
    kept AS (SELECT c.bucket, count(*) AS held, count(o.ticker) AS stayed FROM c LEFT JOIN c o ON o.ticker = c.ticker AND o.leg = c.leg AND o.bucket = c.bucket - 1 GROUP BY 1),
    gone AS (SELECT bucket + 1 AS bucket, count(*) AS had FROM c GROUP BY 1),
    ch AS (SELECT kept.bucket, held, (held - stayed) + coalesce(had - stayed, 0) AS changed FROM kept LEFT JOIN gone USING (bucket)),
    y AS (SELECT x.bucket, x.day, x.date, count(*) AS n, avg(x.fwd) FILTER (c.leg > 0) AS l, avg(x.fwd) FILTER (c.leg < 0) AS s FROM x JOIN c ON c.ticker = x.ticker AND c.bucket = x.bucket WHERE x.fwd IS NOT NULL GROUP BY 1, 2, 3),
    z AS (SELECT y.date, y.n, 0.5 * coalesce(l, 0) - 0.5 * coalesce(s, 0) AS gross, CASE WHEN day % 5 = 0 THEN changed / held * 0.5 ELSE 0.0 END AS turnover FROM y JOIN ch USING (bucket))
    SELECT date, n, round(gross, 6) + 0.0 AS gross, round(CAST(turnover AS DOUBLE), 6) + 0.0 AS turnover, round(CAST(gross - turnover * 0.001 AS DOUBLE), 6) + 0.0 AS net FROM z"""

ORACLES["st7_suite"] = f"WITH q AS ({ORACLES['st4_quality_checks']}) SELECT bool_and(status <> 'FAIL') AS passed, count(*) FILTER (status = 'WARN') AS warnings FROM q"

ORACLES["ml9_walk_forward_ridge"] = f"""WITH {R}, g AS (SELECT *, {roll('sum', 'ret', 5)} AS m5, {roll('sum', 'ret', 21)} AS m21, lead(ret) OVER ({TICKER}) AS y FROM r),
    dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM r)), x AS (SELECT g.ticker, g.date, dd.day, m5, m21, y FROM g JOIN dd USING (date)),
    n AS (SELECT count(*) AS n FROM dd), c AS (SELECT unnest(range(252, n - 5, 63)) AS cut FROM n), f AS (SELECT CAST((cut - 252) / 63 AS INTEGER) AS fold, greatest(cut - 504, 0) AS a, cut - 1 AS b, cut + 5 AS t0, cut + 67 AS t1 FROM c),
    s AS (SELECT fold, count(*) AS n, avg(m5) AS a1, avg(m21) AS a2, avg(y) AS ay, stddev_pop(m5) AS d1, stddev_pop(m21) AS d2, covar_pop(m5, m21) AS c12, covar_pop(m5, y) AS c1, covar_pop(m21, y) AS c2
        FROM x JOIN f ON x.day BETWEEN f.a AND f.b WHERE m5 IS NOT NULL AND m21 IS NOT NULL AND y IS NOT NULL GROUP BY fold HAVING count(*) >= 100),
    b AS (SELECT *, ((n + 1.0) * n * c1 / d1 - n * c12 / (d1 * d2) * n * c2 / d2) / (pow(n + 1.0, 2) - pow(n * c12 / (d1 * d2), 2)) / d1 AS b1, ((n + 1.0) * n * c2 / d2 - n * c12 / (d1 * d2) * n * c1 / d1) / (pow(n + 1.0, 2) - pow(n * c12 / (d1 * d2), 2)) / d2 AS b2 FROM s)
    SELECT ticker, date, b.fold, round(y, 6) + 0.0 AS target, round(ay - b1 * a1 - b2 * a2 + b1 * m5 + b2 * m21, 6) + 0.0 AS prediction FROM x JOIN f ON x.day BETWEEN f.t0 AND f.t1 JOIN b ON b.fold = f.fold WHERE m5 IS NOT NULL AND m21 IS NOT NULL"""

ORACLES["co1_dickey_fuller"] = f"""WITH {_LP}, l AS (SELECT ticker, date, lp, lag(lp) OVER ({TICKER}) AS l1, lag(lp, 2) OVER ({TICKER}) AS l2 FROM b), x AS (SELECT ticker, lp - l1 AS y, l1 AS v, l1 - l2 AS d FROM l WHERE l2 IS NOT NULL),
    s AS (SELECT ticker, count(*) AS n, var_pop(y) * count(*) AS yy, var_pop(v) * count(*) AS vv, var_pop(d) * count(*) AS dd, covar_pop(y, v) * count(*) AS yv, covar_pop(y, d) * count(*) AS yd, covar_pop(v, d) * count(*) AS vd FROM x GROUP BY ticker),
    q AS (SELECT *, (yv * dd - yd * vd) / (vv * dd - vd * vd) AS bv, (yd * vv - yv * vd) / (vv * dd - vd * vd) AS bd FROM s)
    SELECT ticker, round(bv / sqrt((yy - bv * yv - bd * yd) / (n - 3) * dd / (vv * dd - vd * vd)), 6) + 0.0 AS stat, n + 2 AS n FROM q"""

_DENSITY = ORACLES["gr10_rolling_features"].rsplit(" SELECT ticker, date, edges", 1)[0]
ORACLES["sg13_graph_signal"] = (
    f"{_DENSITY}, t AS (SELECT ticker, date, 2.0 * edges / 90 AS density FROM x) SELECT ticker, date, round(-coalesce((density - avg(density) OVER d) / nullif(stddev_samp(density) OVER d, 0), 0), 6) + 0.0 AS signal, "
    "CASE WHEN density < 0.35 THEN 'trending' WHEN density > 0.5 THEN 'noisy' ELSE 'mixed' END AS state FROM t WINDOW d AS (PARTITION BY date)"
)

# -- walk-forward models ---------------------------------------------------------------------------------------

_LEARN = (
    f"{R}, g AS (SELECT *, {roll('sum', 'ret', 5)} AS m5, {roll('sum', 'ret', 21)} AS m21, lead(ret) OVER ({TICKER}) AS y FROM r), dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM r)), "
    "xd AS (SELECT g.*, dd.day, CASE WHEN y IS NULL THEN NULL WHEN y > 0.3 THEN 2 WHEN y < -0.3 THEN 0 ELSE 1 END AS label FROM g JOIN dd USING (date)), nn AS (SELECT count(*) AS n FROM dd)"
)


def ridge(name: str, x: list[str], y: str, step: int, last: int | None = None) -> str:
    """CTEs ending with <name>_p: ticker, date, fold, target and prediction of a ridge of penalty 1 on one or two scaled features, walked forward
    over 504 days; ``last``: the last fold, whose model predicts all later days."""
    both = " AND ".join(f"{c} IS NOT NULL" for c in x)
    one, two = x[0], x[-1]
    rho = "(n * c12 / (d1 * d2))" if len(x) == 2 else "0.0"
    u, v = "(n * c1 / d1)", "(n * c2 / d2)" if len(x) == 2 else "0.0"
    det = f"(pow(n + 1.0, 2) - pow({rho}, 2))"
    end = f"cut + {4 + step}" if last is None else f"CASE WHEN cut = {252 + step * last} THEN 1000000 ELSE cut + {4 + step} END"
    kept = "" if last is None else f" WHERE cut <= {252 + step * last}"
    b2 = f"((n + 1.0) * {v} - {rho} * {u}) / {det} / d2" if len(x) == 2 else "0.0"
    return (
        f", {name}_c AS (SELECT unnest(range(252, n - 5, {step})) AS cut FROM nn), {name}_f AS (SELECT CAST((cut - 252) / {step} AS INTEGER) AS fold, greatest(cut - 504, 0) AS a, cut - 1 AS b, cut + 5 AS t0, {end} AS t1 FROM {name}_c{kept}), "
        f"{name}_s AS (SELECT fold, count(*) AS n, avg({one}) AS a1, avg({two}) AS a2, avg({y}) AS ay, stddev_pop({one}) AS d1, stddev_pop({two}) AS d2, covar_pop({one}, {two}) AS c12, covar_pop({one}, {y}) AS c1, covar_pop({two}, {y}) AS c2 "
        f"FROM xd JOIN {name}_f f ON xd.day BETWEEN f.a AND f.b WHERE {both} AND {y} IS NOT NULL GROUP BY fold HAVING count(*) >= 100), "
        f"{name}_b AS (SELECT *, ((n + 1.0) * {u} - {rho} * {v}) / {det} / d1 AS b1, {b2} AS b2 FROM {name}_s), "
        f"{name}_p AS (SELECT xd.ticker, xd.date, b.fold, {y} AS target, xd.label, ay - b1 * a1 - b2 * a2 + b1 * {one} + b2 * {two} AS prediction FROM xd JOIN {name}_f f ON xd.day BETWEEN f.t0 AND f.t1 JOIN {name}_b b ON b.fold = f.fold WHERE {both})"
    )


def daily_ic(name: str) -> str:
    """CTEs ending with <name>_i: the daily rank correlation of prediction and target of <name>_p."""
    return (
        f", {name}_k AS (SELECT *, {rank('prediction')} AS rx, {rank('target')} AS ry FROM {name}_p WHERE prediction IS NOT NULL AND target IS NOT NULL), "
        f"{name}_i AS (SELECT date, CASE WHEN count(*) > 5 THEN covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS ic FROM {name}_k GROUP BY date)"
    )


ORACLES["ml18_frozen_retraining"] = f"WITH {_LEARN}{ridge('w', ['m5', 'm21'], 'y', 126, 6)} SELECT ticker, date, fold, round(target, 6) + 0.0 AS target, round(prediction, 6) + 0.0 AS prediction FROM w_p"
ORACLES["ml11_decayed_predictions"] = (
    f"WITH {_LEARN}{ridge('w', ['m5', 'm21'], 'y', 63)}, q AS (SELECT ticker, list(prediction ORDER BY date) AS a FROM w_p GROUP BY ticker), c AS (SELECT ticker, date, count(*) OVER ({TICKER} ROWS UNBOUNDED PRECEDING) AS n FROM w_p) "
    "SELECT c.ticker, c.date, round(list_reduce(a[1:n], lambda u, v: 0.7 * u + 0.3 * v), 6) + 0.0 AS smooth FROM c JOIN q USING (ticker)"
)


def _way(name: str, signals: str, mask: str = "1.0", join: str = "") -> str:
    """CTEs ending with <name>_r: results of the lagged long-short book of a table of signals."""
    return (
        f", {name}_g AS (SELECT r.ticker, r.date, r.ret, z.signal FROM r JOIN {signals} z USING (ticker, date)), {name}_k AS (SELECT *, {rank('signal')} AS k FROM {name}_g), "
        f"{name}_t AS (SELECT *, CASE WHEN coalesce(k > 1 - 0.2, false) THEN 1.0 ELSE 0.0 END AS l, CASE WHEN coalesce(k <= 0.2, false) THEN 1.0 ELSE 0.0 END AS sh FROM {name}_k), "
        f"{name}_w AS (SELECT ticker, date, ret, {mask} * (0.5 * coalesce(l / nullif(sum(l) OVER (PARTITION BY date), 0), 0) - 0.5 * coalesce(sh / nullif(sum(sh) OVER (PARTITION BY date), 0), 0)) AS pos FROM {name}_t{join}), "
        f"{name}_h AS (SELECT *, coalesce(lag(pos) OVER ({TICKER}), 0) AS p FROM {name}_w), {name}_d AS (SELECT *, abs(p - lag(p) OVER ({TICKER})) AS d FROM {name}_h), "
        f"{name}_e AS (SELECT date, coalesce(sum(d), 0) AS turnover, sum(p * coalesce(ret, 0)) - coalesce(sum(d), 0) * 0.001 AS net FROM {name}_d GROUP BY date), "
        f"{name}_r AS (SELECT '{name}' AS way, count(net) AS n, round(avg(net), 5) + 0.0 AS mean_net, round(avg(net) / stddev_samp(net) * sqrt(252), 5) + 0.0 AS sharpe, round(avg(turnover), 5) + 0.0 AS turnover FROM {name}_e)"
    )


ORACLES["ml16_orchestrations"] = (
    f"WITH {_LEARN}{ridge('b', ['m5'], 'y', 63)}{ridge('w', ['m5', 'm21'], 'y', 63)}, zb AS (SELECT ticker, date, prediction AS signal FROM b_p), zw AS (SELECT ticker, date, prediction AS signal FROM w_p), "
    f"q AS (SELECT ticker, list(prediction ORDER BY date) AS a FROM w_p GROUP BY ticker), c AS (SELECT ticker, date, count(*) OVER ({TICKER} ROWS UNBOUNDED PRECEDING) AS n FROM w_p), zs AS (SELECT c.ticker, c.date, list_reduce(a[1:n], lambda u, v: 0.7 * u + 0.3 * v) AS signal FROM c JOIN q USING (ticker)), "
    "m AS (SELECT date, avg(ret) AS mkt FROM r GROUP BY date), mu AS (SELECT date, CASE WHEN coalesce(CASE WHEN count(mkt) OVER u >= 20 THEN sum(mkt) OVER u END > 0, false) THEN 1.0 ELSE 0.0 END AS up FROM m WINDOW u AS (ORDER BY date ROWS 19 PRECEDING)), mt AS (SELECT date, lag(up) OVER (ORDER BY date) AS on_ FROM mu)"
    + _way("baseline", "zb") + _way("with_feature", "zw") + _way("smoothed", "zs") + _way("regime", "zw", "coalesce(on_, 0)", " LEFT JOIN mt USING (date)")
    + " " + " UNION ALL ".join(f"SELECT * FROM {w}_r" for w in ("baseline", "with_feature", "smoothed", "regime"))
)
_ABLATED = {"none": ["m5", "m21"], "m5": ["m21"], "m21": ["m5"]}
ORACLES["ml13_ablation"] = (
    f"WITH {_LEARN}" + "".join(ridge(f"w_{k}", x, "y", 252) + daily_ic(f"w_{k}") for k, x in _ABLATED.items()) + " " + " UNION ALL ".join(f"SELECT '{k}' AS dropped, round(avg(ic), 5) + 0.0 AS mean_ic, count(ic) AS n FROM w_{k}_i" for k in _ABLATED)
)
ORACLES["ml17_three_classes"] = (
    f"WITH {_LEARN.replace('nn AS', 'xl AS (SELECT *, (label = 0)::INT::DOUBLE AS is0, (label = 1)::INT::DOUBLE AS is1, (label = 2)::INT::DOUBLE AS is2 FROM xd), nn AS')}"
    + "".join(ridge(f"w{c}", ["m5", "m21"], f"is{c}", 126).replace("FROM xd JOIN", "FROM xl AS xd JOIN") for c in range(3))
    + ", j AS (SELECT a.fold, a.label, round(a.prediction, 9) AS p0, round(b.prediction, 9) AS p1, round(c.prediction, 9) AS p2 FROM w0_p a JOIN w1_p b ON a.ticker = b.ticker AND a.date = b.date AND a.fold = b.fold JOIN w2_p c ON a.ticker = c.ticker AND a.date = c.date AND a.fold = c.fold), "
    "k AS (SELECT *, CASE WHEN p0 >= greatest(p0, p1, p2) THEN 0 WHEN p1 >= greatest(p0, p1, p2) THEN 1 ELSE 2 END AS got FROM j) SELECT fold, count(label) AS n, round(avg(CASE WHEN label IS NOT NULL THEN CASE WHEN got = label THEN 1.0 ELSE 0.0 END END), 5) + 0.0 AS accuracy FROM k GROUP BY fold"
)

# -- pairs ------------------------------------------------------------------------------------------------------

_PAIRS = _LP_PAIR + ", pr AS (SELECT asset1 || '|' || asset2 AS pair, date, lp1, lp2, spread FROM s)"
_NAMES = "split_part(pair, '|', 1) AS asset1, split_part(pair, '|', 2) AS asset2, date"
_Z63 = "CASE WHEN count(spread) OVER w >= 63 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END"


def _turned(pos: str) -> str:
    return f"CASE WHEN r.z IS NULL THEN {pos} WHEN {pos} <> 0 THEN CASE WHEN abs(r.z) < 0.5 OR abs(r.z) > 4 THEN 0.0 ELSE {pos} END WHEN abs(r.z) > 2 AND abs(r.z) <= 4 THEN -sign(r.z) ELSE 0.0 END"


ORACLES["bt18_pair_positions"] = recursive(
    _PAIRS + f", zs AS (SELECT pair, date, {_Z63} AS z FROM pr WINDOW w AS (PARTITION BY pair ORDER BY date ROWS 62 PRECEDING))", "zs", {"position": f"CAST({_turned('0.0')} AS DOUBLE)"}, {"position": f"CAST({_turned('p.position')} AS DOUBLE)"}, "z",
    f"SELECT {_NAMES}, round(z, 6) + 0.0 AS z, round(position, 6) + 0.0 AS position FROM k", "pair",
)


def _pair_step(a: str, b: str, c00: str, c01: str, c11: str) -> dict[str, str]:
    c00, c11 = f"({c00} + 1e-5)", f"({c11} + 1e-5)"
    h0, h1 = f"({c00} + r.lp2 * {c01})", f"({c01} + r.lp2 * {c11})"
    err, var = f"(r.lp1 - ({a} + {b} * r.lp2))", f"({h0} + r.lp2 * {h1} + 1e-3)"
    return {"a": f"{a} + {h0} / {var} * {err}", "b": f"{b} + {h1} / {var} * {err}", "c00": f"{c00} - {h0} / {var} * {h0}", "c01": f"{c01} - {h0} / {var} * {h1}", "c11": f"{c11} - {h1} / {var} * {h1}", "e": err}


ORACLES["ss5_kalman_pairs"] = recursive(
    _PAIRS, "pr", _pair_step("0.0", "0.0", "1.0", "0.0", "1.0"), _pair_step("p.a", "p.b", "p.c00", "p.c01", "p.c11"), "lp1 lp2",
    f"SELECT {_NAMES}, round(a, 6) + 0.0 AS alpha, round(b, 6) + 0.0 AS beta, round(e, 6) + 0.0 AS error FROM k", "pair",
)

ORACLES["str2_online_smoothing"] = (
    "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS ticker, ts AS date, value FROM events), q AS (SELECT ticker, list(value ORDER BY date) FILTER (value IS NOT NULL) AS a FROM e GROUP BY ticker), "
    "c AS (SELECT ticker, date, count(value) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT c.ticker, CAST(c.date AS TIMESTAMP) AS date, round(CASE WHEN n > 0 THEN list_reduce(a[1:n], lambda u, v: 0.7 * u + 0.3 * v) END, 6) + 0.0 AS smoothed FROM c LEFT JOIN q USING (ticker)"
)
