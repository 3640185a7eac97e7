"""Vectorised words and shingles of Arrow text columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. All work is done on the
UTF-8 bytes with numpy; no Python string is made. Hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240229)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], np.uint64)  # the first n bytes of a block
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at a time.
WINDOW = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word, and for each text the number of its first word (one more entry at the end). ``apart``: bytes that part words."""
    solid = ~apart[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts, ends = solid.copy(), solid.copy()
    if len(raw):
        starts[1:] &= ~solid[:-1] | edge[1:-1]
        ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal words equal wherever they stand.

    Each block of eight bytes is mixed with a key of its place before the blocks are summed, so words of a regular build (complements, swapped
    or shifted blocks) don't cancel out, as they do in a sum that is linear in the bytes.
    """
    low = np.zeros(len(raw) + 8, np.uint8)
    low[:-8] = LOWER[raw]
    eight = np.ndarray((len(raw) + 1,), "<u8", low, 0, (1,))  # the eight bytes from every place
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOW)))
        length = ends[at:upto] - starts[at:upto]
        blocks = (length + 7) >> 3
        first = np.cumsum(blocks) - blocks
        place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        values = eight[np.repeat(starts[at:upto], blocks) + 8 * place]
        last = first + blocks - 1
        values[last] &= _KEEP[length - 8 * (blocks - 1)]
        summed = np.add.reduceat(mix(values ^ mix((place.astype(np.uint64) + np.uint64(1)) * _STEP)), first)
        out[at:upto] = mix(summed + length.astype(np.uint64) * _STEP)
        at = upto
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; with fewer words, of the whole sequence; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h += words[j : n - k + 1 + j] * _PLACE[j % len(_PLACE)] if j < len(_PLACE) else mix(words[j : n - k + 1 + j] + np.uint64(j))
    return mix(h)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles."""
    raw, offsets = text_bytes(column)
    starts, ends, first = word_spans(raw, offsets)
    h = hash_words(raw, starts, ends)
    return [np.unique(shingle_hashes(h[a:b], k)) for a, b in zip(first[:-1], first[1:])]
