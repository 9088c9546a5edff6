"""Batch text helpers used inside Arrow tasks: packed UTF-8, token bounds, hashes.

Everything works on one Arrow batch at a time, in pieces of about `CHUNK` bytes, so
the memory of a task does not depend on how many rows a partition has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once (a longer single text is one piece).
CHUNK = 1 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)

SPACE, WORD, OTHER = 0, 1, 2
#: Byte classes: ASCII white space and controls, letters/digits/non-ASCII, the rest.
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[:33] = SPACE
CLASSES[127:] = WORD
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    CLASSES[_lo:_hi] = WORD
#: ASCII lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorting is faster here than numpy's hashing unique)."""
    keys = np.sort(keys)
    if not len(keys):
        return keys
    first = np.empty(len(keys), bool)
    first[0] = True
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return keys[first]


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1024)
        for name, base in (("up", _MULT), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts add up to about `limit` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(kinds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of maximal runs of one non-zero byte class within a row."""
    if not len(kinds):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.empty(len(kinds) + 1, bool)
    cut[0] = cut[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=cut[1:-1])
    cut[at] = True
    bounds = np.flatnonzero(cut)
    keep = kinds[bounds[:-1]] != 0
    starts, ends = bounds[:-1][keep], bounds[1:][keep]
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from one running sum over the piece."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and classes of the lower-cased word and punctuation runs."""
    kinds = CLASSES[data]
    starts, ends, rows = runs(kinds, at)
    return run_hashes(LOWER[data], starts, ends), rows, kinds[starts] if len(starts) else kinds[:0]
