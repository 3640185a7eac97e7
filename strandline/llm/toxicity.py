"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, accents and homoglyphs to plain Latin letters, digits and signs
inside words to the letters they stand for) and all lexicon entries found in one pass of an Aho-Corasick
automaton, at word boundaries. Weights of the entries found outside exception phrases are summed and
normalised by the length of the text. Weights are log odds learnt from labelled rows; so are exceptions
(an entry with its neighbour that occurs in clean texts), and the two numbers that turn the normalised sum
into a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, placed, ship, slices

#: At most so many labelled rows are learnt from: those of the smallest hashed ids.
FIT_ROWS = 20_000
#: An entry needs so many toxic rows, and log odds so many standard errors above zero.
MIN_TOXIC, MIN_Z, MIN_WEIGHT = 3, 4.0, 1.5
#: Beginnings of longer words that may become entries (marked by a final *), in letters.
BEGINNINGS = (5, 6, 7, 8)
#: Partial counts of a task are handed on beyond so many words.
FLUSH = 200_000

# Letters that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "абвгдеёзіїјклмнорстухѕԁԛԝһ" "αβγεηικνορτυχω" "ıłøđħŧæœßþðſɑɡɩƒ",
    "abbrdee3iijklmhopctyxsdqwh" "abyenikvoptuxw" "ilodhtaobpdsagif",
)
# Digits and signs written for letters.
LEET = str.maketrans("013457@$!|", "oieastasii")
_INSIDE = re.compile(r"(?:(?<=[a-z])|(?<![\w@$!|]))[013457@$!|]+(?=[a-z])|(?<=[a-z])[013457]+(?![\w@$!|])")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_OTHER = re.compile(r"[^a-z]+")
_HAS_LEET = re.compile(r"[0-9@$|!][a-z]|[a-z][0-9]")


def fold(text: str | None) -> str:
    """A text as words of a-z, each with a blank before and after; null and empty: one blank."""
    if not text:
        return " "
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).translate(_INVISIBLE).translate(HOMOGLYPHS)
        t = "".join(c for c in t if not unicodedata.combining(c)) if not t.isascii() else t
    if _HAS_LEET.search(t):
        t = _INSIDE.sub(lambda m: m.group(0).translate(LEET), t)
    return f" {_OTHER.sub(' ', t).strip()} " if t.strip() else " "


def units(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Lexicon:
    """Entries (folded words or phrases, or beginnings of words with a final *) with weights, and phrases in which an entry doesn't count."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    slope: float = 1.0
    shift: float = -2.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (phrase, None))
            for entry, w in self.weights.items():
                a.add_word(f" {entry[:-1]}" if entry.endswith("*") else f" {entry} ", (entry, w))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def found(self, folded: str) -> list[tuple[str, float]]:
        """Entries outside exception phrases, with their weights; of those that begin at one place the heaviest."""
        if not self.weights:
            return []
        best, shielded = {}, []
        for end, (entry, weight) in self.automaton().iter(folded):
            if weight is None:
                shielded.append((end - len(entry) - 1, end))
                continue
            start = end - len(entry) + (1 if entry.endswith("*") else -1)
            if start not in best or (weight, entry) > best[start]:
                best[start] = weight, entry
        if shielded:
            best = {p: x for p, x in best.items() if not any(a <= p < b for a, b in shielded)}
        return [(e, w) for _, (w, e) in sorted(best.items())]

    def density(self, folded: str, hits: list[tuple[str, float]] | None = None) -> float:
        """Summed weights, normalised by the root of the length in words, so that one entry counts for
        more in a short text than in a long one; ``hits``: the entries, if found before."""
        hits = self.found(folded) if hits is None else hits
        if not hits:
            return 0.0
        return sum(w for _, w in hits) / math.sqrt(1 + folded.count(" ") / 100.0)

    def score(self, folded: str, hits: list[tuple[str, float]] | None = None) -> float:
        """Between 0 and 1; without entries, and without a lexicon, below one half."""
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * self.density(folded, hits) + self.shift))))


def learn(labelled: DataFrame, text: str = "text", label: str = "label") -> Lexicon:
    """Learn a lexicon from rows of text and label (1 toxic; null labels are left out).

    ``labelled`` is read twice; bound it beforehand (see ``bounded``). Word counts are taken in Spark, by
    partial counts within the tasks; only words that pass the thresholds reach the driver.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).where("label is not null")

    def count(batches: Iterable[pa.RecordBatch], phrases: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush():
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])
            seen[0].clear(), seen[1].clear()

        for b in slices(batches, "text"):
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                words = fold(t).split()
                if phrases is None:
                    seen[1 if y == 1 else 0].update({u for w in set(words) for u in units(w)})
                else:
                    seen[1 if y == 1 else 0].update({f"{v} {w}" for v, w in zip(words, words[1:]) if v in phrases or w in phrases})
            if len(seen[0]) + len(seen[1]) > FLUSH:
                yield from flush()
        yield from flush()

    schema = "word string, toxic long, clean long"
    n = {bool(r.toxic): r.n for r in rows.groupBy((F.col("label") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    sums = rows.mapInArrow(count, schema).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (n0 - F.col("clean") + 0.5))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    picked = sums.where(F.col("toxic") >= MIN_TOXIC).withColumn("w", odds).where((F.col("w") >= MIN_WEIGHT) & (F.col("w") >= MIN_Z * spread)).select("word", "w")
    weights = {r.word: float(r.w) for r in picked.collect()}
    exceptions: set[str] = set()
    if weights:
        entries = frozenset(e for e in weights if not e.endswith("*"))
        pairs = rows.mapInArrow(lambda it: count(it, entries), schema).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        exceptions = {r.word for r in pairs.where((F.col("clean") >= MIN_TOXIC) & (F.col("clean") > 4 * F.col("toxic"))).collect()}
    lexicon = Lexicon(weights, frozenset(exceptions))
    return calibrate(lexicon, rows)


def calibrate(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Fit slope and shift on a histogram of densities by label; only the histogram reaches the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, seen = shared.value, Counter()
        for b in slices(batches, "text"):
            seen.update((round(min(lex.density(fold(t)), 50.0) * 8), int(y == 1)) for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["bin", "y", "n"])

    if not lexicon.weights:
        return lexicon
    got = rows.mapInArrow(bins, "bin long, y long, n long").groupBy("bin", "y").agg(F.sum("n").alias("n")).orderBy("bin", "y").collect()
    x, y, n = (np.array([float(r[i]) for r in got]) for i in range(3))
    beta = np.array([0.0, -2.0])
    design = np.stack([x / 8, np.ones_like(x)], 1)
    for _ in range(50):  # logistic regression with a small ridge, by Newton steps
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (n * (y - p)) - 1e-2 * beta
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return Lexicon(lexicon.weights, lexicon.exceptions, float(max(beta[0], 0.0)), float(beta[1]))


def bounded(docs: DataFrame, labels: DataFrame, train, label: str = "toxic", rows: int = FIT_ROWS, text: str = "text") -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that fulfil ``train``, a condition on doc_id.

    Of repeated labels of one document the largest counts. The bounded list of ids is small enough to
    be broadcast, so no text is exchanged.
    """
    picked = labels.where(train & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(picked), "doc_id").select("text", "label")


def score_documents(docs: DataFrame, lexicon: Lexicon, text: str = "text", extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``extra`` columns, score (0 to 1) and hits (entries found) of each whole text; null and empty texts
    get the score of a text without entries. A narrow map: rows stay as they are."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kept, names, schema = placed(docs, extra, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in slices(batches, "text"):
            folded = list(map(fold, b.column("text").to_pylist()))
            hits = list(map(lex.found, folded))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(list(map(lex.score, folded, hits)), pa.float64()), pa.array([[e for e, _ in h] for h in hits], pa.list_(pa.string()))],
                [*names, "score", "hits"],
            )

    return kept.mapInArrow(run, f"{schema}{', ' if names else ''}score double, hits array<string>").toDF(*extra, "score", "hits")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``: a narrow map."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in slices(batches, text):
            yield b.filter(pa.array([lex.score(fold(t)) < threshold for t in b.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, train, rows: int = FIT_ROWS) -> Lexicon:
    """Learn from a bounded sample; the sample is checkpointed, as it is read several times."""
    return learn(cut(bounded(docs, labels, train, rows=rows)))
