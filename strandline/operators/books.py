"""Feature panels and screens, and books whose next weights depend on their own past."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.shipping import ship
from strandline.operators import features as fe
from strandline.operators import windows as w
from strandline.operators.trading import safe_corr

KEYS = ["ticker", "date"]


def combine(blocks: Sequence[DataFrame], how: str = "inner") -> DataFrame:
    """Blocks side by side by ticker and date; a column that several have is named block{i}_{name}."""
    seen = [c for b in blocks for c in b.columns if c not in KEYS]
    named = [b.select(*KEYS, *(F.col(c).alias(f"block{i}_{c}" if seen.count(c) > 1 else c) for c in b.columns if c not in KEYS)) for i, b in enumerate(blocks)]
    return reduce(lambda a, b: a.join(b, KEYS, how), named)


def feature_panel(p: DataFrame) -> DataFrame:
    """Momentum, volatility and mean-reversion features with their cross-sectional ranks: two exchanges."""
    q = fe.add(p, fe.momentum(), fe.volatility(), fe.mean_reversion())
    q = fe.add(q, fe.cross_section())
    return q.select(*KEYS, *(c for c in q.columns if c not in p.columns and not c.startswith("_")))


def screen(df: DataFrame, columns: Sequence[str], most_missing: float = 0.15, least_variance: float = 1e-8) -> DataFrame:
    """(feature, missing, kept): one pass over all columns."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.struct(F.count(c).alias("k"), F.var_samp(c).alias("v")).alias(c) for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), (1 - F.col(f"{c}.k") / F.col("_n")).alias("missing"), F.col(f"{c}.v").alias("v")) for c in columns))).alias("e")
    return one.select(rows).select("e.feature", "e.missing", ((F.col("e.missing") <= most_missing) & F.coalesce(F.col("e.v") > least_variance, F.lit(False))).alias("kept"))


def feature_report(df: DataFrame, categories: Mapping[str, str], target: str, most_missing: float = 0.15, least: int = 5) -> DataFrame:
    """(feature, category, dates, missing, ic, t, kept): per feature the share of rows without it, and mean and t of its daily correlations with the target, over
    dates of at least ``least`` rows with both; one melt and two aggregates for all features."""
    columns = list(categories)
    tall = df.select("date", F.col(target).alias("_y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e")).select("date", "_y", "e.*")
    missing = tall.groupBy("feature").agg((1 - F.count("x") / F.count(F.lit(1))).alias("missing"))
    both = tall.where(F.col("x").isNotNull() & F.col("_y").isNotNull())
    daily = both.groupBy("feature", "date").agg(F.when(F.count(F.lit(1)) >= least, safe_corr("x", "_y")).alias("c"))
    ic = daily.groupBy("feature").agg(F.count("c").alias("dates"), F.avg("c").alias("ic"), (F.try_divide(F.avg("c"), F.stddev_samp("c")) * F.sqrt(F.count("c").cast("double"))).alias("t"))
    named = F.create_map(*(F.lit(v) for kv in categories.items() for v in kv))[F.col("feature")]
    return missing.join(ic, "feature", "left").select("feature", named.alias("category"), F.coalesce("dates", F.lit(0).cast("long")).alias("dates"), "missing", "ic", "t", (F.col("missing") <= most_missing).alias("kept"))


def filled(df: DataFrame, columns: Sequence[str], rest: float = 0.0) -> DataFrame:
    """``df`` with missing values of ``columns`` replaced by the ticker's last one, else the median of the date (of values so filled), else ``rest``."""
    df = df.withColumns({c: w.ffill(c) for c in columns})
    return df.withColumns({c: F.coalesce(F.col(c), F.percentile(c, 0.5).over(w.section()), F.lit(rest)) for c in columns})


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, corr) of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(safe_corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("e")).select("e.*")


def drop_redundant(corr: DataFrame, scores: dict[str, float], threshold: float = 0.95) -> list[str]:
    """Columns that remain when of every pair above the threshold the lower-scored one goes, best pairs first."""
    gone: set[str] = set()
    for r in sorted(corr.where(F.abs("corr") >= threshold).collect(), key=lambda r: -abs(r["corr"])):
        if r.x not in gone and r.y not in gone:
            gone.add(min((r.x, r.y), key=lambda c: (scores.get(c, 0.0), c)))
    return [c for c in scores if c not in gone]


def elastic_net(df: DataFrame, x: Sequence[str], y: str, penalty: float, mix: float) -> DataFrame:
    """Predictions of a linear model with an elastic-net penalty, fitted on the rows that have the target."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=list(x), outputCol="_x").transform(df.dropna(subset=list(x)))
    model = LinearRegression(featuresCol="_x", labelCol=y, regParam=penalty, elasticNetParam=mix, standardization=True).fit(rows.dropna(subset=[y]))
    return model.transform(rows).drop("_x")


@dataclass(frozen=True)
class Rules:
    """A book of the ``top`` and ``bottom`` names by signal, chosen every ``every`` dates.

    ``weight_on_new`` mixes new with held weights; ``long_bias`` is the long side's share; ``stop`` and ``take``
    act per name on the return since entry, ``trail`` on the book's value with ``cooldown`` dates out of the
    market; all exits act from the next date. Costs are charged on the sum of weight changes.
    """

    top: int = 10
    bottom: int = 0
    every: int = 5
    weight_on_new: float = 1.0
    long_bias: float = 0.5
    stop: float | None = None
    take: float | None = None
    trail: float | None = None
    cooldown: int = 5
    cost_bps: float = 10.0


class _Book:
    """The state of one strategy's book, moved a date at a time."""

    def __init__(self, rules: Rules):
        self.rules, self.held, self.gained = rules, {}, {}
        self.value = self.peak = 1.0
        self.rest = self.clock = 0

    def move(self, today: dict[str, tuple[float | None, float | None]]) -> tuple[float, float, float, int]:
        """(gross, turnover, net, names) of a date whose names have (signal, return); the weights change for the next date."""
        rules, held, gained = self.rules, self.held, self.gained
        got = {t: today[t][1] for t in held if t in today and today[t][1] is not None and not np.isnan(today[t][1])}
        gross = sum(held[t] * got[t] for t in got)
        old = dict(held)
        for t in got:
            gained[t] = (1 + gained.get(t, 0.0)) * (1 + np.sign(held[t]) * got[t]) - 1
        self.value *= 1 + gross
        self.peak = max(self.peak, self.value)
        for t in list(held):
            if rules.stop is not None and gained.get(t, 0.0) <= -rules.stop or rules.take is not None and gained.get(t, 0.0) >= rules.take:
                held.pop(t)
        if self.rest:
            self.rest -= 1
            if not self.rest:
                self.value = self.peak = 1.0
        elif rules.trail is not None and self.value / self.peak - 1 <= -rules.trail:
            held, self.rest = {}, rules.cooldown
        else:
            if self.clock % rules.every == 0:
                held = _chosen(today, held, rules)
            self.clock += 1
        self.gained = {t: gained.get(t, 0.0) if np.sign(old.get(t, 0.0)) == np.sign(held[t]) else 0.0 for t in held}
        self.held = held
        turnover = sum(abs(held.get(t, 0.0) - old.get(t, 0.0)) for t in held.keys() | old.keys())
        return float(gross), float(turnover), float(gross - turnover * rules.cost_bps / 1e4), len(held)


def simulate(df: DataFrame, rules: Rules | Mapping[str, Rules], signal: str = "signal", r: str = "ret", strategy: str | None = None) -> DataFrame:
    """Per date (and strategy, and name of the ``rules`` if several are given) gross, turnover, net and names of a path-dependent book.

    A date's weights depend on all names' weights of the date before, so a book is moved date by date: rows are dealt by strategy and sorted by date, and stream through
    the task, which holds the rows of one date and the weights. All sets of rules are moved along in the same pass. Rows without a date are left out.
    """
    named = rules if isinstance(rules, Mapping) else {"": rules}
    keyed = df.where(F.col("date").isNotNull()).select((F.col(strategy).cast("string") if strategy else F.lit("book")).alias("strategy"), "date", "ticker", F.col(signal).cast("double").alias("s"), F.col(r).cast("double").alias("r"))
    dealt = keyed.repartition("strategy").sortWithinPartitions("strategy", "date", "ticker")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, today, books, out = None, {}, {}, []

        def close() -> None:
            for name, book in books.items():
                out.append((*at, name, *book.move(today)))

        def table() -> pa.RecordBatch:
            kinds = [pa.string(), pa.date32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            columns = list(zip(*out)) if out else [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["strategy", "date", "rules", "gross", "turnover", "net", "names"])

        for b in batches:
            for k, date, ticker, s, ret in zip(*(b.column(c).to_pylist() for c in ("strategy", "date", "ticker", "s", "r"))):
                if (k, date) != at:
                    if at is not None:
                        close()
                    if at is None or k != at[0]:
                        books = {name: _Book(x) for name, x in named.items()}
                    at, today = (k, date), {}
                today[ticker] = s, ret
            yield table()
        if at is not None:
            close()
            yield table()

    ship(df.sparkSession)
    done = dealt.mapInArrow(run, "strategy string, date date, rules string, gross double, turnover double, net double, names long")
    return done if isinstance(rules, Mapping) else done.drop("rules")


def _chosen(today: dict, held: dict[str, float], rules: Rules) -> dict[str, float]:
    ranked = sorted((t for t, (s, _) in today.items() if s is not None and not np.isnan(s)), key=lambda t: (-today[t][0], t))
    longs, shorts = ranked[: rules.top], ranked[len(ranked) - rules.bottom :] if rules.bottom and len(ranked) >= rules.top + rules.bottom else []
    side = rules.long_bias if shorts else 1.0
    new = {t: side / len(longs) for t in longs} | {t: -(1 - side) / len(shorts) for t in shorts}
    a = rules.weight_on_new
    mixed = {t: a * new.get(t, 0.0) + (1 - a) * held.get(t, 0.0) for t in new.keys() | held.keys()}
    total = sum(map(abs, mixed.values()))
    return {t: v / total for t, v in sorted(mixed.items()) if abs(v) > 1e-6} if total else {}
