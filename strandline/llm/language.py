"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut greedily into the longest
phrases that occur in a language's labelled text; the language that needs the fewest phrases per symbol
wins. Whole texts are parsed, all texts of a batch and all languages in step, by numpy look-ups in one sparse table
of the automata's transitions. Long texts are parsed from many places at once: a parse begun at any place soon
ends a phrase where the true parse ends one, and from there both are the same; what lies before is parsed on from the piece before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import placed, ship, slices

#: Labelled text that a language is learnt from: documents at most, and symbols at most; symbols of all languages together.
FIT_DOCUMENTS, FIT_SYMBOLS, ALL_SYMBOLS = 400, 60_000, 1_200_000
#: Symbols between the places at which the parse of a long text is begun.
PIECE = 256
#: Places times languages that are parsed at once, at five bytes each.
CELLS = 1 << 25
UNDETERMINED = "und"


class Alphabet:
    """Letters of the labelled text, lower-cased, as numbers from 2; other letters are 1, and any run of non-letters is one 0."""

    def __init__(self, letters: Sequence[str]):
        self.letters = list(letters)
        self.number = {c: i + 2 for i, c in enumerate(self.letters)}
        self.table = np.zeros(0x250, np.int32)
        for p in range(0x250):
            c = chr(p)
            if c.isalpha():
                self.table[p] = self.number.get(c.lower(), 1)

    def symbols(self, text: str | None) -> np.ndarray:
        """The symbols of a text, without leading and trailing non-letters; empty if it has no letter."""
        if not text:
            return np.zeros(0, np.int32)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if int(points.max()) < len(self.table):
            out = self.table[points]
        else:
            distinct, at = np.unique(points, return_inverse=True)
            out = np.array([self.number.get(chr(p).lower(), 1) if chr(p).isalpha() else 0 for p in distinct.tolist()], np.int32)[at]
        letter = np.flatnonzero(out)
        if not len(letter):
            return out[:0]
        out = out[letter[0] : letter[-1] + 1]
        blank = out == 0
        return out[~(blank & np.append(False, blank[:-1]))]


def suffix_automaton(symbols: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of each state of the smallest automaton of all substrings; state 1 begins, 0 is none."""
    size = 2 * len(symbols) + 2
    link, length = [0] * size, [0] * size
    rows: list[dict[int, int]] = [{} for _ in range(size)]
    last, count = 1, 2
    for c in symbols:
        new, count = count, count + 1
        length[new] = length[last] + 1
        p = last
        while p and c not in rows[p]:
            rows[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = rows[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone, count = count, count + 1
                length[clone], rows[clone], link[clone] = length[p] + 1, dict(rows[q]), link[q]
                while p and rows[p].get(c) == q:
                    rows[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return rows[:count]


class Transitions:
    """Sparse rows laid over each other: the entry of a state and a symbol stands at base[state] + symbol, with its owner."""

    TRIES = 48

    def __init__(self, rows: list[dict[int, int]], width: int):
        taken, low, top = bytearray(4 * width), 0, 0
        base = np.zeros(max(len(rows), 1), np.int64)
        many = sorted((s for s, r in enumerate(rows) if len(r) > 1), key=lambda s: (-len(rows[s]), s))
        for s in many:  # the first place where all entries of the row are free, soon given up
            symbols = sorted(rows[s])
            at = taken.find(0, max(low, symbols[0]))
            for _ in range(self.TRIES):
                if not any(taken[at - symbols[0] + c] for c in symbols):
                    break
                at = taken.find(0, at + 1)
            else:
                at, low = max(top, symbols[0]), taken.find(0, low + 1)
            base[s] = b = at - symbols[0]
            for c in symbols:
                taken[b + c] = 1
            top = max(top, b + symbols[-1] + 1)
            if top + 3 * width > len(taken):
                taken.extend(bytes(len(taken)))
        one = [s for s, r in enumerate(rows) if len(r) == 1]
        free = np.flatnonzero(np.frombuffer(taken, np.uint8)[:top] == 0)
        free = np.concatenate([free[free >= width], np.arange(max(top, width), max(top, width) + len(one))])[: len(one)]
        base[one] = free - np.array([next(iter(rows[s])) for s in one], np.int64) if one else free
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        place = base[owner] + np.array([c for r in rows for c in r], np.int64)
        self.base = base.astype(np.int32)
        self.entries = np.full(int(base.max()) + width + 1, -1, np.int64)  # owner and next state in one number
        self.entries[place] = owner << 32 | np.array([t for r in rows for t in r.values()], np.int64)

    def __call__(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states; 0 where there is none."""
        got = self.entries[self.base[states] + symbols]
        return np.where(got >> 32 == states, got & 0xFFFFFFFF, 0)


@dataclass
class LanguageModel:
    """Alphabet and the automata of all languages in one table: a few MB a language, ``ALL_SYMBOLS`` bounds the whole."""

    alphabet: Alphabet
    languages: list[str]
    step: Transitions
    begin: np.ndarray  # [language, symbol]: the state after the first symbol of a phrase

    @classmethod
    def learn(cls, texts: Mapping[str, Sequence[str]], symbols: int = FIT_SYMBOLS) -> LanguageModel:
        """Learn from texts by language, of each at most ``symbols`` symbols, in the order given."""
        letters = sorted({c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha() and len(c) == 1})
        alphabet, languages = Alphabet(letters), sorted(texts)
        symbols = min(symbols, ALL_SYMBOLS // max(len(languages), 1))
        rows: list[dict[int, int]] = [{}]
        begin = np.zeros((len(languages), len(letters) + 2), np.int64)
        for j, name in enumerate(languages):
            joined: list[int] = []
            for t in texts[name]:
                joined += alphabet.symbols(t).tolist() + [0]
                if len(joined) >= symbols:
                    break
            base = len(rows)
            rows += [{c: base + t for c, t in row.items()} for row in suffix_automaton(joined[:symbols])]
            for c, t in rows[base + 1].items():
                begin[j, c] = t
        return cls(alphabet, languages, Transitions(rows, len(letters) + 2), begin)

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of phrases [text, language] of texts whose symbols lie one behind the other.

        A phrase ends before a symbol that doesn't continue it and the next begins with that symbol; a symbol that no
        phrase begins with is a phrase of its own.
        """
        at_once = max(1, CELLS // (len(symbols) + 1))
        languages = range(0, len(self.languages), at_once)
        return np.concatenate([self._phrases(symbols, offsets, i, min(i + at_once, len(self.languages))) for i in languages], 1)

    def _phrases(self, symbols: np.ndarray, offsets: np.ndarray, since: int, upto: int) -> np.ndarray:
        """As ``phrases``, for the languages numbered ``since`` to ``upto`` - 1."""
        counts, k, step, width = np.diff(offsets), upto - since, self.step, self.begin.shape[1]
        pieces = -(-counts // PIECE)
        owner = np.repeat(np.arange(len(counts)), pieces)
        begins = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        ends = np.minimum(begins + PIECE, offsets[1:][owner])
        order = np.argsort(begins - ends, kind="stable")
        # A lane per piece and language; every language has its own stretch of ``starts``, the places where phrases begin.
        n = len(symbols) + 1
        stretch, fresh = np.tile(np.arange(k) * n, len(order)), np.tile(np.arange(k) * width, len(order))
        first = self.begin[since:upto].ravel()
        starts = np.zeros(n * k, bool)
        text = np.append(symbols, 0)
        at, till, size = (np.repeat(x[order], k) for x in (begins, ends, ends - begins))
        state = np.zeros(len(at), np.int64)
        sizes = (ends - begins)[order]
        active = len(at)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            while size[active - 1] <= t:
                active -= 1
            c = text[at[:active] + t]
            nxt = step(state[:active], c)
            dead = nxt == 0
            starts[(stretch[:active] + at[:active] + t)[dead]] = True
            state[:active] = np.where(dead, first[fresh[:active] + c], nxt)
        # The parse of a piece goes on into the next ones until it begins a phrase where the next piece's own parse does.
        further, joins = np.zeros(len(at), np.int64), till.copy()
        stop = np.repeat(offsets[1:][owner[order]], k)
        on = np.flatnonzero(joins < stop)
        while len(on):
            c = text[joins[on]]
            nxt = step(state[on], c)
            dead = nxt == 0
            met = dead & starts[stretch[on] + joins[on]]
            further[on[dead & ~met]] += 1
            state[on] = np.where(dead, first[fresh[on] + c], nxt)
            on = on[~met]
            joins[on] += 1
            on = on[joins[on] < stop[on]]
        before = np.zeros(n * k + 1, np.int32)  # phrases that begin before each place
        np.cumsum(starts, out=before[1:])
        # Of the next pieces' own phrases, those before the joint aren't in the true parse.
        lane = before[stretch + till] - before[stretch + at] + further - (before[stretch + joins] - before[stretch + till])
        out = np.zeros((len(counts), k), np.int64)
        np.add.at(out, owner[order], lane.reshape(-1, k))
        # Where a parse joins no other within the next piece, that piece's own continuation is void: follow the joints.
        wide = np.flatnonzero((joins > till + PIECE) & (stop > till + PIECE))
        for text_at, j in {(int(owner[order[x // k]]), x % k) for x in wide.tolist()}:
            mine = np.flatnonzero(owner[order] == text_at)
            mine = mine[np.argsort(begins[order[mine]])] * k + j
            total, here, i = 0, int(at[mine[0]]), 0
            while True:
                x = mine[i]
                total += int(before[stretch[x] + till[x]] - before[stretch[x] + here] + further[x])
                if joins[x] >= stop[x]:
                    break
                here = int(joins[x])
                i = int(np.searchsorted(till[mine], here, side="right"))
            out[text_at, j] = total
        return out

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the winner's share when rates are weighed by their distance.

        A text that is null or has no letter is ``und`` with score 0. Of equal rates the first name wins.
        """
        coded = [self.alphabet.symbols(t) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64)
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        n = self.phrases(np.concatenate([*coded, np.zeros(0, np.int32)]), offsets)
        rate = n / np.maximum(np.diff(offsets), 1)[:, None]
        best = rate.argmin(1)
        excess = (rate - rate.min(1, keepdims=True)) / np.maximum(rate.min(1, keepdims=True), 1e-9)
        share = 1 / np.exp(-np.minimum(excess * 8, 60)).sum(1)
        has = np.diff(offsets) > 0
        return [self.languages[i] if h else UNDETERMINED for i, h in zip(best.tolist(), has.tolist())], np.where(has, share, 0.0).tolist()


def fit(docs: DataFrame, train: Column, documents: int = FIT_DOCUMENTS, symbols: int = FIT_SYMBOLS, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from a bounded sample of labelled rows: per language at most ``documents`` distinct texts of the smallest
    hashes, whatever their number, and of those ``symbols`` symbols.

    Distinct texts per language are counted first (roughly), so the sample's share of each is known. Equal texts count once, so
    at most ``documents`` rows a language reach the driver, of each at most ``symbols`` characters.
    """
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not counts:
        return LanguageModel.learn({})
    # A hash below the limit is met by twice ``documents`` rows on average.
    limits = F.create_map(*(x for r in counts for x in (F.lit(r.lang), F.lit(min(2**65 * documents // max(r.n, 1), 2**64 - 1) - 2**63).cast("long"))))
    near = rows.where(F.col("h") <= F.element_at(limits, F.col("lang"))).select("lang", "h", F.substring("text", 1, symbols).alias("text"))
    one = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    texts: dict[str, list[str]] = {}
    for r in sorted(one.withColumn("k", least).where(F.col("k") <= documents).collect(), key=lambda r: (r.lang, r.h)):
        texts.setdefault(r.lang, []).append(r.text)
    return LanguageModel.learn(texts, symbols)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``extra`` columns, lang_pred and score (0 to 1) of each whole text: a narrow map, rows as they were.

    Letters that no labelled text has are one symbol alike; a text of such letters alone costs every language the same, so the first name wins.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, columns, schema = placed(docs, extra, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            names, scores = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    return kept.mapInArrow(run, f"{schema}{', ' if columns else ''}lang_pred string, score double").toDF(*extra, "lang_pred", "score")
