"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact confirmation.

Every window of as many words as a benchmark item has is a candidate for that item. Windows are
fingerprinted by SimHash over their word shingles; all items of that length within the radius are found by
Hamming blocks; candidates are confirmed by the exact weighted similarity of their shingle multisets. A
window that lacks so many of the benchmark's shingles that no item can reach the threshold is passed over
before it is fingerprinted; that is exact (its similarity would be below the threshold) and makes the
usual, clean document cost one look-up per word. The benchmark is sent to the tasks in blocks of bounded
size, so it may be of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import ship, slices
from strandline.llm.hamming import BlockIndex
from strandline.llm.words import hash_words, shingle_hashes, text_bytes, word_spans

#: Words of a shingle, the least similarity, and the radius in 64 bits: at similarity 0.8 the expected
#: distance is under 10 bits with a standard deviation of 2.9, so 23 is beyond four and a half of them.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
#: Words of benchmark items sent to the tasks at a time.
ITEM_WORDS = 2_000_000
_FILTER_BITS = 20
#: Windows fingerprinted at a time.
WINDOWS = 4_096


def simhash(counts: np.ndarray) -> np.ndarray:
    """Fingerprints [row, 8 bytes] of summed votes [row, 64]; a tie gives a 1."""
    return np.packbits(counts >= 0, 1)


def votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit of each hash: int16 [shingle, 64]."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), 1)
    return bits.astype(np.int16) * 2 - 1


def weighted_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Shared weight over joint weight of two multisets, each shingle weighing as often as it occurs."""
    if not len(x) and not len(y):
        return 0.0
    values, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = (np.bincount(part, minlength=len(values)) for part in (at[: len(x)], at[len(x) :]))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


@dataclass
class _Length:
    """Items of one length in words."""

    words: int
    k: int
    items: np.ndarray  # item numbers
    shingles: list[np.ndarray]
    known: np.ndarray  # sorted distinct shingles of all its items
    index: BlockIndex


class Benchmark:
    """Benchmark items prepared for matching; those without words can't be matched and are left out."""

    def __init__(self, item_ids: list, texts: list[str | None], k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity = similarity
        raw, offsets = text_bytes(pa.array(texts, pa.string()))
        starts, ends, first = word_spans(raw, offsets)
        h = hash_words(raw, starts, ends)
        by_length: dict[int, list[int]] = {}
        sets = {}
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if b > a:
                by_length.setdefault(b - a, []).append(i)
                sets[i] = shingle_hashes(h[a:b], k)
        self.lengths = []
        for n, items in sorted(by_length.items()):
            prints = np.concatenate([simhash(votes(sets[i]).sum(0, dtype=np.int64)[None]) for i in items])
            self.lengths.append(_Length(n, min(k, n), np.array(items), [sets[i] for i in items], np.unique(np.concatenate([sets[i] for i in items])), BlockIndex(prints, radius)))
        self.ids = item_ids
        self._words = {int(i): x.words for x in self.lengths for i in x.items}
        self.k = k
        self.filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for kk in {x.k for x in self.lengths}:
            every = np.unique(np.concatenate([x.known for x in self.lengths if x.k == kk]))
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[every >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[kk] = bits, every

    def _known(self, shingles: np.ndarray, k: int) -> np.ndarray:
        bits, every = self.filters[k]
        out = bits[shingles >> np.uint64(64 - _FILTER_BITS)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = every[np.minimum(np.searchsorted(every, shingles[at]), len(every) - 1)] == shingles[at]
        return out

    def words_of(self, item: int) -> int:
        return self._words[item]

    def matches(self, words: np.ndarray, shingles: dict[int, np.ndarray]) -> list[tuple[int, float, int]]:
        """(item number, similarity, first word) of the best window for each item that a text holds."""
        best: dict[int, tuple[float, int]] = {}
        hit = {k: self._known(s, k) for k, s in shingles.items()}
        for length in self.lengths:
            n, k = length.words, length.k
            if len(words) < n:
                # A text shorter than the item is one window of its own.
                if len(words) >= k and hit[k].any():
                    self._confirm(length, np.array([0]), shingles[k], len(words) - k + 1, best)
                continue
            if not hit[k].any():
                continue
            s, per = shingles[k], n - k + 1
            own = hit[k].copy()
            at = np.flatnonzero(own)
            own[at] = length.known[np.minimum(np.searchsorted(length.known, s[at]), len(length.known) - 1)] == s[at]
            total = np.concatenate([[0], np.cumsum(own)])
            enough = total[per:] - total[:-per] >= math.ceil(2 * self.similarity / (1 + self.similarity) * per - 1e-9)
            self._confirm(length, np.flatnonzero(enough), s, per, best)
        return [(i, sim, w) for i, (sim, w) in sorted(best.items())]

    def _confirm(self, length: _Length, windows: np.ndarray, s: np.ndarray, per: int, best: dict) -> None:
        for a in range(0, len(windows), WINDOWS):
            some = windows[a : a + WINDOWS]
            low, high = int(some[0]), int(some[-1]) + per
            summed = np.zeros((high - low + 1, 64), np.int32)
            np.cumsum(votes(np.ascontiguousarray(s[low:high])), 0, out=summed[1:])
            prints = simhash(summed[some - low + per] - summed[some - low])
            for q, c in zip(*(x.tolist() for x in length.index.within(prints))):
                w = int(some[q])
                sim = weighted_similarity(s[w : w + per], length.shingles[c])
                item = int(length.items[c])
                if sim >= self.similarity and sim > best.get(item, (0.0, 0))[0]:
                    best[item] = sim, w


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each text for each item it holds.

    Words are runs of non-blanks, A-Z lower-cased; a window has the item's number of words (a shorter text
    is one window), shingles ``k`` words (or the whole item, if shorter), each weighing as often as it
    occurs. Of equal windows the first counts. Texts that are null, empty or without words hold nothing,
    as do such items; a repeated item_id counts once per distinct text; a repeated document per row. Items
    are read in blocks of ``ITEM_WORDS`` words; documents are never exchanged.
    """
    ship(docs.sparkSession)
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    parts = [_mapped(docs.select("doc_id", text), bench, text, id_type) for bench in _blocks(benchmark, k, similarity, radius)]
    return reduce(DataFrame.unionByName, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item (as find_leaks finds them)."""
    ship(docs.sparkSession)
    for bench in _blocks(benchmark, k, similarity, radius):
        docs = _mapped(docs, bench, text)
    return docs


def _blocks(benchmark: DataFrame, k: int, similarity: float, radius: int) -> Iterator[Benchmark]:
    """The benchmark in parts of about ``ITEM_WORDS`` words; one at least."""
    items = benchmark.select("item_id", F.col("text").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // (ITEM_WORDS * 6)) + 1
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = mine.orderBy("item_id", "text").collect()
        yield Benchmark([r.item_id for r in rows], [r.text for r in rows], k, similarity, radius)


def _mapped(docs: DataFrame, benchmark: Benchmark, text: str, id_type: str | None = None) -> DataFrame:
    """The leaks of each text if ``id_type`` is given, else the rows without any."""
    shared = docs.sparkSession.sparkContext.broadcast(benchmark)
    item_type = {"string": pa.string(), "int": pa.int32()}.get(id_type, pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for b in slices(batches, text, 2 << 20):
            raw, offsets = text_bytes(b.column(text))
            starts, ends, first = word_spans(raw, offsets)
            h = hash_words(raw, starts, ends)
            found, clean = [], []
            for row, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                matches = bench.matches(h[a:z], {k: shingle_hashes(h[a:z], k) for k in bench.filters if z - a >= k})
                clean.append(not matches)
                if id_type:
                    found += [(row, bench.ids[i], sim, w, min(z - a, bench.words_of(i))) for i, sim, w in matches]
            if id_type:
                rows, items, sims, firsts, lengths = zip(*found) if found else [()] * 5
                arrays = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(items, item_type), pa.array(sims, pa.float64()), pa.array(firsts, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "similarity", "first_word", "n_words"])
            else:
                yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {id_type}, similarity double, first_word long, n_words long" if id_type else docs.schema)
