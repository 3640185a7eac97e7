"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The vocabulary is read once on the driver and sent to the tasks (32,000 pieces; its size is fixed by the
model file). A text is normalised (white space to the mark U+2581, one mark in front) and cut into words
at marks that follow another symbol and at line ends; no piece of the vocabulary crosses such a place, which
is checked on loading. Distinct words of a batch are then merged together: all symbols lie in one flat array, each round
takes the lowest-ranked pair of every word by a segmented minimum, merges it in all words at once, leftmost
first, and compacts the array, until no pair is left. Long words have several segments: what happens to a symbol reaches no
further than the longest piece, so a pair that is the lowest within a segment and its neighbours, each wider than two such
pieces, merges as if its turn had come. Symbols without a piece fall back to bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.common import placed, ship, slices

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Words whose symbols share the arrays of a merge; few enough for the processor's cache.
MERGED_AT_ONCE = 16000
#: Rounds after which words that allow one merge a round (long runs of one sign) are ended merge by merge.
ROUNDS = 300
_NO_RANK = np.int64(1 << 62)
codecs.register_error("strandline_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceTable:
    """Pieces, scores and kinds of a SentencePiece BPE model, with the pair table that merging needs."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], kinds: Sequence[str], eos: int, unk: int):
        self.pieces, self.eos, self.unk = list(pieces), eos, unk
        usable = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in usable):
            raise ValueError("a piece crosses a word boundary; this model needs whole-text merging")
        order = {i: r for r, i in enumerate(sorted(usable.values(), key=lambda i: (-scores[i], i)))}
        # Two pieces of one score would be ordered by position alone; equal ranks keep that law.
        by_score: dict[float, int] = {}
        self.rank = {i: by_score.setdefault(scores[i], r) for i, r in order.items()}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "byte"}
        self.usable = usable
        left, right, merged, hasty = [], [], [], set()
        for piece, i in usable.items():
            for cut in range(1, len(piece)):
                a, b = usable.get(piece[:cut]), usable.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
                    hasty.update(x for x in (a, b) if self.rank[i] < self.rank[x])
        n = len(self.pieces)
        keys = np.array(left, np.int64) * n + np.array(right, np.int64)
        at = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_piece = keys[at], np.array(merged, np.int64)[at]
        self.pair_rank = np.array([self.rank[i] for i in self.pair_piece.tolist()], np.int64)
        self.rank_is_hasty = np.zeros(max(self.rank.values(), default=0) + 2, bool)
        self.rank_is_hasty[[self.rank[i] for i in hasty]] = True
        # What each id decodes to; bytes of neighbouring ids form characters.
        shown = {"normal": lambda p: p.replace(MARK, " ").encode(), "byte": lambda p: bytes([int(p[3:5], 16)]), "unknown": lambda _: " ⁇ ".encode()}
        self.raw = [shown.get(k, lambda _: b"")(p) for p, k in zip(pieces, kinds)]
        self.silent = frozenset(i for i, b in enumerate(self.raw) if not b)
        #: Characters of a segment.
        self.reach = 2 * max(map(len, usable), default=1) + 2
        self._known: dict[str, tuple[int, ...]] = {}
        self._pair_of: dict[tuple[int, int], tuple[int, int]] = {}

    @classmethod
    def load(cls, path: str) -> PieceTable:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "normal" for i in ids]
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], kinds, sp.eos_id(), sp.unk_id())

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_pair_of": {}}

    def merge(self, words: Sequence[str]) -> list[tuple[int, ...]]:
        """Ids of each word, by merge rounds over all words at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        # A character without a piece gets an id past the vocabulary, so it joins no pair.
        n = len(self.pieces)
        id_of = np.array([self.usable.get(chr(p), n + j) for j, p in enumerate(distinct.tolist())], np.int64)
        symbol, word = id_of[inverse] if len(distinct) else np.zeros(0, np.int64), np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word, done_order = [], [], []
        order = np.arange(len(symbol))
        place = order - np.repeat(np.cumsum(lengths) - lengths, lengths)
        segment = np.cumsum(place % self.reach == 0)
        rank, piece = self._pairs(symbol, word)
        rounds = 0
        while len(symbol):
            if rounds == ROUNDS:
                cuts = np.flatnonzero(np.append(True, word[1:] != word[:-1])).tolist()
                kept = np.concatenate([a + self._one_by_one(symbol[a:b]) for a, b in zip(cuts, [*cuts[1:], len(symbol)])])
                symbol, word, order = symbol[kept], word[kept], order[kept]
                break
            rounds += 1
            begin = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            sizes = np.diff(np.append(begin, len(symbol)))
            low = np.minimum.reduceat(rank, begin)
            owner = word[begin]
            starts = np.append(True, owner[1:] != owner[:-1])
            words_low = np.minimum.reduceat(low, np.flatnonzero(starts))
            if (words_low == _NO_RANK).any():  # words without a pair leave the array
                over = np.repeat((words_low == _NO_RANK)[np.cumsum(starts) - 1], sizes)
                done_symbol.append(symbol[over]), done_word.append(word[over]), done_order.append(order[over])
                keep = ~over
                symbol, word, order, segment, rank, piece = (x[keep] for x in (symbol, word, order, segment, rank, piece))
                continue
            # A segment's lowest pair has its turn if the neighbours' aren't lower; of equal ones that open better pairs the left is first.
            before = np.where(starts, _NO_RANK, np.append(0, low[:-1]))
            after = np.append(np.where(starts[1:], _NO_RANK, low[1:]), _NO_RANK)
            hasty = self.rank_is_hasty[np.minimum(low, len(self.rank_is_hasty) - 1)]
            turn = (low <= after) & np.where(hasty, low < before, low <= before)
            hit = np.flatnonzero((rank == np.repeat(low, sizes)) & (rank != _NO_RANK))
            has_turn = np.repeat(turn, sizes)[hit]
            # Leftmost first: of a run of overlapping hits every second one merges, up to the first without its turn; where a
            # merge may open a better pair, only the first hit of the segment does.
            new_run = np.append(True, (np.diff(hit) != 1) | (rank[hit[1:]] != rank[hit[:-1]]))
            run = np.flatnonzero(new_run)
            length = np.diff(np.append(run, len(hit)))
            within = np.arange(len(hit)) - np.repeat(run, length)
            halted = np.cumsum(~has_turn)
            free = halted == np.repeat(halted[run] - ~has_turn[run], length)
            first = np.append(True, segment[hit[1:]] != segment[hit[:-1]])
            hit = hit[np.where(self.rank_is_hasty[rank[hit]], first & has_turn, (within % 2 == 0) & free)]
            symbol[hit] = piece[hit]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            hit -= np.arange(len(hit))  # where the merged symbols stand after compaction
            symbol, word, order, segment, rank, piece = (x[stay] for x in (symbol, word, order, segment, rank, piece))
            # Only pairs that touch a merged symbol are new.
            touched = np.zeros(len(symbol), bool)
            touched[hit] = touched[hit[hit > 0] - 1] = True
            stale = np.flatnonzero(touched)
            after = np.minimum(stale + 1, len(symbol) - 1)
            rank[stale], piece[stale] = self._rank(symbol[stale], symbol[after], (word[stale] == word[after]) & (after > stale))
        done_symbol.append(symbol), done_word.append(word), done_order.append(order)
        symbol, word, order = map(np.concatenate, (done_symbol, done_word, done_order))
        back = np.argsort(order, kind="stable")
        symbol, word = symbol[back], word[back]
        stops = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        flat = symbol.tolist()
        spelled = {n + j: self.spell(chr(p)) for j, p in enumerate(distinct.tolist()) if id_of[j] >= n}
        out = [tuple(flat[a:b]) for a, b in zip(stops, stops[1:])]
        if spelled:
            for k in np.unique(word[symbol >= n]).tolist():
                out[k] = tuple(chain.from_iterable(spelled.get(i, (i,)) for i in out[k]))
        return out

    def _one_by_one(self, symbol: np.ndarray) -> np.ndarray:
        """Merges one word in place, the lowest and leftmost pair first; the places of the symbols that are left."""
        at = symbol.tolist()
        n, size = len(self.pieces), len(at)
        if not self._pair_of:
            left, right = np.divmod(self.pair_keys, n)
            self._pair_of.update(zip(zip(left.tolist(), right.tolist()), zip(self.pair_rank.tolist(), self.pair_piece.tolist())))
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(self._pair_of[x][0], i, x) for i, x in enumerate(zip(at, at[1:])) if x in self._pair_of]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i] if at[i] >= 0 else size
            if j >= size or (at[i], at[j]) != pair:
                continue
            at[i], at[j] = self._pair_of[pair][1], -1
            after[i] = after[j]
            if after[j] < size:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < size and (at[a], at[b]) in self._pair_of:
                    heappush(heap, (self._pair_of[at[a], at[b]][0], a, (at[a], at[b])))
        symbol[:] = at
        return np.flatnonzero(symbol >= 0)

    def _pairs(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pair that begins at each symbol."""
        return self._rank(symbol, np.append(symbol[1:], 0), np.append(word[1:] == word[:-1], False)[: len(symbol)])

    def _rank(self, left: np.ndarray, right: np.ndarray, same_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.pieces)
        key = np.where(same_word & (left < n) & (right < n), left * n + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == key
        return np.where(found, self.pair_rank[at], _NO_RANK), np.where(found, self.pair_piece[at], 0)

    def spell(self, char: str) -> tuple[int, ...]:
        """Bytes of a character that has no piece."""
        return tuple(self.byte_id.get(b, self.unk) for b in char.encode("utf-8", "replace")) if self.byte_id else (self.unk,)

    def encode(self, texts: Sequence[str | None], remember: int = 200_000) -> list[list[int]]:
        """Ids of each whole text with the end id; null counts as empty. Words met before are looked up."""
        split = [_WORD.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        known = self._known
        if len(known) > remember:
            known.clear()
        new = list(set().union(*split).difference(known))
        for a in range(0, len(new), MERGED_AT_ONCE):
            known.update(zip(new[a : a + MERGED_AT_ONCE], self.merge(new[a : a + MERGED_AT_ONCE])))
        out = [[*chain.from_iterable(map(known.__getitem__, words)), self.eos] for words in split]
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: marks become spaces, the first is dropped, byte runs are read as UTF-8."""
        if not self.silent.isdisjoint(ids[:-1]):  # ids that show nothing part the bytes around them
            runs: list[list[int]] = [[]]
            for i in ids:
                runs.append([]) if i in self.silent else runs[-1].append(i)
            text = "".join(b"".join(map(self.raw.__getitem__, r)).decode("utf-8", "strandline_each_byte") for r in runs)
        else:
            text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "strandline_each_byte")
        first = next((i for i in ids if self.raw[i]), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text


def encode_documents(docs: DataFrame, table: PieceTable, text: str = "text", extra: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``extra`` columns, ids array<int> (with the end id) and decoded string of each whole text.

    A narrow map: no shuffle. Nulls and empty texts give the end id alone and an empty text. Rows are
    kept as they are, repeated ones included; columns not named are left out, so clashing names do no harm.
    """
    return _mapped(docs, table, text, extra, "ids array<int>, decoded string", lambda ids, texts: [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())])


def digest_documents(docs: DataFrame, table: PieceTable, text: str = "text", extra: Sequence[str] = ("doc_id",)) -> DataFrame:
    """As encode_documents, with n_tokens, ids_sha256 and decoded_sha256 in place of ids and text."""

    def columns(ids: list[list[int]], texts: list[str]) -> list[pa.Array]:
        sha = [hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for i in ids]
        return [pa.array(list(map(len, ids)), pa.int64()), pa.array(sha, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]

    return _mapped(docs, table, text, extra, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _mapped(docs: DataFrame, table: PieceTable, text: str, extra: Sequence[str], schema: str, columns) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kept, names, given = placed(docs, extra, text)
    made = [x.strip().split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for b in slices(batches, "text", 1 << 20):
            ids = pieces.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *columns(ids, list(map(pieces.decode, ids)))], [*names, *made])

    return kept.mapInArrow(run, f"{given}{', ' if names else ''}{schema}").toDF(*extra, *made)
