"""Words of UTF-8 texts as numpy arrays, a batch at a time.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``.  All functions work on one byte array
holding many texts and the array of their bounds, in pieces that bound the scratch memory,
so a text of any length is handled whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
MARKS = SPACE.copy()  # blanks and ASCII punctuation
MARKS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_PIECE = 1 << 20
_PLACES = 64  # places of a word with drawn values of their own; later ones are derived by mixing

_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(0, 2**64, (_PLACES, 256), dtype=np.uint64)
_FAR = _draw.integers(0, 2**64, 1, dtype=np.uint64)[0] | np.uint64(1)
_BYTE[:, SPACE] = 0
_FOLDED = _BYTE.copy()
_FOLDED[:, ord("A") : ord("Z") + 1] = _BYTE[:, ord("a") : ord("z") + 1]
_BARE = _FOLDED.copy()
_BARE[:, MARKS] = 0
WORD_BASE = int(_draw.integers(0, 2**62, dtype=np.uint64)) * 8 + 5


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base % 2**64))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits; one-to-one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(column: pa.Array | pa.ChunkedArray):
    """(first row, row after the last, bytes, bounds) of runs of texts with about a megabyte, or one longer text."""
    data, bounds = texts(column)
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _PIECE, "right")) - 1)
        yield a, b, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


def _cuts(data: np.ndarray, bounds: np.ndarray) -> list[int]:
    """Where to cut the bytes: at bounds of texts or between words, about every piece."""
    cuts, n = [0], len(data)
    while n - cuts[-1] > 2 * _PIECE:
        at = cuts[-1] + _PIECE
        own = int(bounds[np.searchsorted(bounds, at)])
        while at < own and not SPACE[data[at]]:
            gap = np.flatnonzero(SPACE[data[at : min(own, at + _PIECE)]])
            at = at + int(gap[0]) if len(gap) else min(own, at + _PIECE)
        cuts.append(at)
    return cuts + [n] if n > cuts[-1] else cuts


def split(data: np.ndarray, bounds: np.ndarray, fold: bool = False, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word, and the number of words before each text.

    ``fold`` lower-cases A-Z in the hashes; ``bare`` does so and parts words at ASCII punctuation too.  Equal
    words have equal hashes; a hash is the sum of one drawn value per byte and place, so no order of letters in words
    of any length makes two others' sums meet by rule.
    """
    table, gap = (_BARE, MARKS) if bare else (_FOLDED if fold else _BYTE, SPACE)
    starts, ends, hashes = [], [], []
    cuts = _cuts(data, bounds)
    for lo, hi in zip(cuts, cuts[1:]):
        part = data[lo:hi]
        solid = ~gap[part]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        stops = solid.copy()
        stops[:-1] &= ~solid[1:]
        inner = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi, "right")] - lo
        at = inner[inner < hi - lo]
        begins[at] = solid[at]
        at = inner[inner > 0] - 1
        stops[at] = solid[at]
        begin = np.flatnonzero(begins)
        if not len(begin):
            continue
        reach = np.diff(begin, append=hi - lo)
        place = np.arange(begin[0], hi - lo) - np.repeat(begin, reach)
        value = table.ravel()[(place & (_PLACES - 1)) << 8 | part[begin[0] :]]
        if int(reach.max()) > _PLACES:
            far = np.flatnonzero((place >= _PLACES) & solid[begin[0] :])
            value[far] = mix(value[far] + (place[far] >> 6).astype(np.uint64) * _FAR)
        hashes.append(mix(np.add.reduceat(value, begin - begin[0])))
        starts.append(begin + lo)
        ends.append(np.flatnonzero(stops) + 1 + lo)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return start, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(start, bounds)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` consecutive words (fewer words: none)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, base = hashes[: len(hashes) - n + 1].copy(), np.uint64(WORD_BASE)
    for k in range(1, n):
        out *= base
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def sequence(hashes: np.ndarray) -> np.uint64:
    """A hash of all words in order and of their number."""
    return mix(np.array([mix(hashes + np.arange(1, len(hashes) + 1, dtype=np.uint64) * np.uint64(WORD_BASE)).sum(dtype=np.uint64)]))[0]


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """``grams`` for long windows, in time independent of ``n``."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up = powers(WORD_BASE, len(hashes) + 1)
    back = powers(pow(WORD_BASE, -1, 2**64), len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * back[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * up[n - 1 : n - 1 + count])


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a run of ``length`` from one of ``starts``."""
    if not len(starts):
        return np.zeros(total, bool)
    change = np.zeros(total + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, total), -1)
    return np.cumsum(change[:-1]) > 0
