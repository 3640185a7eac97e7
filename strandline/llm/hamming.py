"""Multi-index Hamming look-ups on binary codes held as rows of bytes.

A code is cut into blocks of one byte. If two codes of m blocks differ in at most R bits, some block differs
in at most R // m bits (the pigeonhole law), so every code within radius R is found by looking up each
block of the query in a table that lists, for all 256 byte values, the codes whose block is that near.
"""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_BYTE_DISTANCE = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


class BlockIndex:
    """Index of codes [code, byte] for look-ups within a fixed radius."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = np.ascontiguousarray(codes, np.uint8), radius
        self.blocks = codes.shape[1]
        per_block = radius // self.blocks
        self.near = [[np.flatnonzero(_BYTE_DISTANCE[value][self.codes[:, b]] <= per_block) for value in range(256)] for b in range(self.blocks)]

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, code row) of all pairs within the radius, each once."""
        rows, hits = [], []
        n = len(self.codes)
        for b in range(self.blocks):
            column = queries[:, b]
            for value in np.unique(column).tolist():
                near = self.near[b][value]
                if len(near):
                    q = np.flatnonzero(column == value)
                    rows.append(np.repeat(q, len(near))), hits.append(np.tile(near, len(q)))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(rows).astype(np.int64) * n + np.concatenate(hits))
        q, c = pair // n, pair % n
        ok = _POP[queries[q] ^ self.codes[c]].sum(1) <= self.radius
        return q[ok], c[ok]
