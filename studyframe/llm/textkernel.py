"""Word and shingle hashing over whole Arrow batches of text, in numpy.

Words are maximal runs of bytes outside space and \\t..\\r, so they can be cut in UTF-8 without decoding.
Text is worked on in slices of whole words, so the peak memory of a task follows the slice and the number
of words, not the length of the longest text.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once. A text longer than this is hashed in several cuts at white space.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate(([_U(1)], np.full(n, _U(base), dtype=_U))))


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTES = _seeded(256, 17)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_POWER, _BACK = _powers(_BASE, SLICE_BYTES), _powers(_INVERSE, SLICE_BYTES)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A hash of data[start:end] for each span; with fold, A-Z count as a-z."""
    global _POWER, _BACK
    if len(_POWER) < len(data) + 1:  # a single word beyond the slice size
        power, back = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
    else:
        power, back = _POWER, _BACK
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum((_FOLDED if fold else _BYTES)[data] * power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(_U))


def resting(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a partition's batches, after which freed memory goes back: the worker stays for later stages."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


class Words:
    """The words of some texts: hashes, and for text d the words offsets[d]:offsets[d + 1]; chars: code points of each word."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, chars: np.ndarray):
        self.hashes, self.offsets, self.chars = hashes, offsets, chars


def _cut(data: np.ndarray, bounds: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of data; bounds: positions where a text begins. Gives starts, hashes, code points."""
    word = ~SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = bounds[bounds < len(data)]
    start[inner] |= word[inner]
    end = np.zeros(len(data) + 1, dtype=bool)
    end[1:] = word
    end[1:-1] &= ~word[1:]
    inner = inner[inner > 0]
    end[inner] |= word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    lead = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return starts, span_hashes(data, starts, ends, fold), lead[ends] - lead[starts]


def words_of(data: np.ndarray, bounds: np.ndarray, fold: bool) -> Words:
    """Words of texts data[bounds[d]:bounds[d + 1]]."""
    size, at, parts = len(data), 0, []
    while at < size:
        upto = min(size, at + SLICE_BYTES)
        if upto < size:
            gaps = np.flatnonzero(SPACE[data[at:upto]])
            edge = np.searchsorted(bounds, upto, side="right") - 1
            back = max(at + gaps[-1] + 1 if len(gaps) else at, bounds[edge])
            while back <= at:  # one word fills the slice: go on to its end
                more = np.flatnonzero(SPACE[data[upto : upto + SLICE_BYTES]])
                back = upto + more[0] if len(more) else min(size, upto + SLICE_BYTES)
                nxt = np.searchsorted(bounds, at, side="right")
                if nxt < len(bounds):
                    back = min(back, bounds[nxt])
                if back == upto + SLICE_BYTES and not len(more) and back < size:
                    upto, back = back, at
            upto = back
        lo, hi = np.searchsorted(bounds, at), np.searchsorted(bounds, upto)
        starts, hashes, chars = _cut(data[at:upto], bounds[lo:hi] - at, fold)
        parts.append((starts + at, hashes, chars))
        at = upto
    starts, hashes, chars = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int32))
    return Words(hashes, np.searchsorted(starts, bounds), chars)


def texts(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of up to limit bytes, or one longer text: first and last (exclusive) row, bytes, bounds. Null is empty."""
    first = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        chunk = chunk.fill_null("").cast(pa.large_string())
        _, offsets, data = chunk.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(chunk):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
            stop = min(stop, len(chunk))
            yield first + row, first + stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            row = stop
        first += len(chunk)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words of one text, and the index of its first word."""
    h, n = words.hashes, len(words.hashes)
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        acc = h[: n - k + 1].copy()
        for j in range(1, k):
            acc *= _U(0xD6E8FEB86659FD93)
            acc += h[j : n - k + 1 + j]
    last = np.repeat(words.offsets[1:], np.diff(words.offsets))[: n - k + 1]
    inside = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return mix(acc[inside]), inside


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; one shingle of all words where there are fewer, none without words."""
    grams, first = windows(words, k)
    cuts = np.searchsorted(first, words.offsets)
    out = []
    for d in range(len(words.offsets) - 1):
        own = grams[cuts[d] : cuts[d + 1]]
        n = words.offsets[d + 1] - words.offsets[d]
        if 0 < n < k:
            acc = _U(n)
            with np.errstate(over="ignore"):
                for x in words.hashes[words.offsets[d] : words.offsets[d + 1]]:
                    acc = acc * _U(0xA24BAED4963EE407) + x
            own = mix(np.array([acc], dtype=_U))
        out.append(np.unique(own))
    return out
