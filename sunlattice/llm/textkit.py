"""Words, shingles and their hashes for whole batches of texts, as array operations over UTF-8 bytes.

A word is a run of digits, ASCII letters and bytes of 0x80 and more; A-Z and the capitals of Latin-1 count as small letters. A shingle is SHINGLE words
in a row; a text of 1 to SHINGLE-1 words has one shingle, all its words; a text without words has none.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes that are worked on at a time; bounds the memory of the arrays, whatever the length of a batch or of a text.
PIECE = 1 << 20

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and of its inverse, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts (one more at the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _cuts(word: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Piece borders that split no word: after about PIECE bytes, at a byte that isn't of a word or where a text starts."""
    out, n = [0], len(word)
    while out[-1] < n:
        at = out[-1] + PIECE
        if at < n:
            next_text = int(offsets[np.searchsorted(offsets, at)])
            gap, step = at, PIECE // 16
            while gap < next_text:
                free = np.flatnonzero(~word[gap : min(gap + step, next_text)])
                if len(free):
                    gap += int(free[0])
                    break
                gap += step
            at = min(gap, next_text)
        out.append(min(at, n))
    return out


def lower(data: np.ndarray) -> np.ndarray:
    out = LOWER[data]
    lead = np.flatnonzero(out[:-1] == 0xC3) + 1
    capital = lead[(out[lead] >= 0x80) & (out[lead] <= 0x9E) & (out[lead] != 0x97)]
    out[capital] += 0x20
    return out


class Words:
    """start, end (bytes), hash of every word of a batch; first[i] is the number of words before text i.

    prefixes: numbers of bytes; prefix[k] has the hash of each word's first so many bytes, 0 where the word isn't longer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()):
        word = IS_WORD[data]
        borders = np.zeros(len(data) + 1, bool)
        borders[offsets] = True
        starts, ends, hashes, heads = [], [], [], [[] for _ in prefixes]
        cuts = _cuts(word, offsets)
        for a, b in zip(cuts, cuts[1:], strict=False):
            w, edge = word[a:b], borders[a : b + 1].copy()
            edge[0] = edge[-1] = True
            begins, stops = w.copy(), w.copy()
            begins[1:] &= ~w[:-1] | edge[1:-1]
            stops[:-1] &= ~w[1:] | edge[1:-1]
            s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            power, inverse = _power(max(b - a + 1, PIECE))
            with np.errstate(over="ignore"):
                run = np.zeros(b - a + 1, np.uint64)
                np.cumsum((lower(data[a:b]).astype(np.uint64) + np.uint64(1)) * power[: b - a], out=run[1:])
                hashes.append(mix((run[e] - run[s]) * inverse[s] + (e - s).astype(np.uint64)))
                for k, head in zip(prefixes, heads, strict=True):
                    head.append(np.where(e - s > k, mix((run[np.minimum(s + k, e)] - run[s]) * inverse[s] + np.uint64(k << 20)), np.uint64(0)))
            starts.append(s + a)
            ends.append(e + a)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.end, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
        self.prefix = [join(head, np.uint64) for head in heads]
        self.first = np.searchsorted(self.start, offsets)


def word_hash(text: str) -> list[int]:
    """Hashes of the words of one text, for tests and small tables."""
    return Words(*utf8(pa.array([text]))).hash.tolist()


def shingles(words: Words, n: int = SHINGLE, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles in order of place, and where each text's start. short: a text of fewer words has one, all its words."""
    h, first = words.hash, words.first
    counts = np.diff(first)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    with np.errstate(over="ignore"):
        x = h.copy()
        for k in range(1, min(n, len(h))):
            x[: len(h) - k] = x[: len(h) - k] * np.uint64(0x9FB21C651E98DF25) + h[k:]
    keep = np.ones(len(h), bool)
    # the last n-1 words of a text begin no shingle
    for k in range(1, n):
        at = first[1:][counts >= k] - k
        keep[at] = False
    out_counts = np.maximum(counts - n + 1, 0)
    if short and n > 1:
        few = np.flatnonzero((counts > 0) & (counts < n))
        for i in few.tolist():
            with np.errstate(over="ignore"):
                v = np.uint64(counts[i])
                for w in h[first[i] : first[i + 1]]:
                    v = v * np.uint64(0x9FB21C651E98DF25) + w
            x[first[i]] = v
            keep[first[i]] = True
        out_counts[few] = 1
    return mix(x[keep]), np.concatenate([[0], np.cumsum(out_counts)])


def pieces_of(column, most: int = 4 * PIECE):
    """(first row, last row + 1) of runs of rows with about `most` bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets = utf8(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def lean(rows):
    """An iterator function for mapInArrow that gives freed memory back to the machine when it ends: workers live on, and share it with the executor."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return run
