"""Hashes of the words of whole batches of texts.

Words are runs of bytes other than 20 and 09-0D, A-Z lower-cased. Those of
SHORT bytes or fewer are hashed together, by sums of powers; longer ones, for
which such sums are weaker, one by one.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHORT, CHUNK = 64, 1 << 18
_U = np.uint64
_R = 0x9FB21C651E98DF25
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 64, 256, _U)
_VALUE[65:91] = _VALUE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_R, CHUNK + SHORT), _powers(pow(_R, -1, 1 << 64), CHUNK + SHORT)


def hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie end to end, and n + 1 offsets into them."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    start, stop = [], []
    for a in range(0, len(data), 1 << 20):  # the edges of words, by parts
        space = _SPACE[data[max(a - 1, 0) : a + (1 << 20) + 1]]
        if a == 0:
            space = np.append(True, space)
        if a + (1 << 20) >= len(data):
            space = np.append(space, True)
        word = ~space[1:-1]
        cut = np.zeros(len(word) + 1, bool)  # texts part words too
        lo, hi = np.searchsorted(offsets, [a, a + len(word)], "left")[0], np.searchsorted(offsets, a + len(word), "right")
        cut[offsets[lo:hi] - a] = True
        start.append(a + np.flatnonzero(word & (space[:-2] | cut[:-1])))
        stop.append(a + 1 + np.flatnonzero(word & (space[2:] | cut[1:])))
    start, stop = np.concatenate(start), np.concatenate(stop)
    size = stop - start
    out = np.empty(len(start), _U)
    with np.errstate(over="ignore"):
        for a in range(0, len(data), CHUNK):
            lo, hi = np.searchsorted(start, [a, a + CHUNK])
            if lo == hi:
                continue
            part = data[a : a + CHUNK + SHORT]
            sums = np.zeros(len(part) + 1, _U)
            np.cumsum(_VALUE[part] * _UP[: len(part)], out=sums[1:])
            s = start[lo:hi] - a
            x = (sums[s + np.minimum(size[lo:hi], SHORT)] - sums[s]) * _DOWN[s]
            x ^= size[lo:hi].astype(_U) * _U(0x9E3779B97F4A7C15)
            x ^= x >> _U(32)
            x *= _U(0xD6E8FEB86659FD93)
            out[lo:hi] = x ^ (x >> _U(29))
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : stop[k]].tobytes().lower())
    return out, np.searchsorted(start, offsets)
