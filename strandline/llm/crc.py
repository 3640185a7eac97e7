"""CRC-32 of many byte strings at once, and of strings joined from parts whose CRC-32 is known.

Appending bytes is linear over GF(2): crc(x + y) is crc(x), shifted by the length of y, xor crc(y). Shifts by up to
``DIRECT`` bytes are four table look-ups; longer ones are composed of powers of two.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Lengths with a table of their own, a power of two.
DIRECT = 64
#: Fixed value: the polynomial, bits reversed.
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


_BYTE = _byte_table()


def zero_byte(crc: np.ndarray) -> np.ndarray:
    """Shift by one byte."""
    return _BYTE[crc & np.uint32(255)] ^ (crc >> np.uint32(8))


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & np.uint32(255)] ^ table[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ table[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    direct = np.empty((DIRECT, 4, 256), np.uint32)
    direct[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, DIRECT):
        direct[n] = zero_byte(direct[n - 1])
    powers = [zero_byte(direct[DIRECT - 1])]
    while len(powers) < 32:
        powers.append(_apply(powers[-1], powers[-1]))
    return direct, powers


_SHIFT, _POWERS = _tables()
_FLAT = [np.ascontiguousarray(_SHIFT[:, b]).reshape(-1) for b in range(4)]


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``crc`` after ``length`` more bytes, before these are xored in."""
    at = (length & (DIRECT - 1)) << 8
    out = _FLAT[0][at + (crc & np.uint32(255))] ^ _FLAT[1][at + ((crc >> np.uint32(8)) & np.uint32(255))]
    out ^= _FLAT[2][at + ((crc >> np.uint32(16)) & np.uint32(255))] ^ _FLAT[3][at + (crc >> np.uint32(24))]
    blocks = length // DIRECT
    for table in _POWERS:
        if not blocks.any():
            break
        odd = np.flatnonzero(blocks & 1)
        out[odd] = _apply(table, out[odd])
        blocks = blocks >> 1
    return out


def crc_of_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of the bytes ``raw``."""
    length = ends - starts
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero(length <= DIRECT)
    short = short[np.argsort((DIRECT - length[short]).astype(np.uint8), kind="stable")]  # the longest first
    at, register = starts[short], np.full(len(short), 0xFFFFFFFF, np.uint32)
    left = np.bincount(length[short], minlength=DIRECT + 2)[::-1].cumsum()[::-1]  # spans of a length or more
    for p in range(DIRECT):
        n = int(left[p + 1])
        if n == 0:
            break
        r = register[:n]
        register[:n] = _BYTE[(r ^ raw[at[:n] + p]) & np.uint32(255)] ^ (r >> np.uint32(8))
    out[short] = ~register
    for i in np.flatnonzero(length > DIRECT).tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]])
    return out
