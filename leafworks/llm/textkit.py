"""Vectorised word, line and shingle primitives over Arrow string buffers.

Everything here works on the raw UTF-8 bytes of a whole Arrow batch with
numpy: no Python loop runs per word. Hashes are 64-bit polynomial hashes
with a final mixing step, computed from prefix sums modulo 2**64.

Memory: text is taken in slices of about ``SLICE`` bytes (one document at
least), and hashing walks each slice in blocks, so a very long document
costs a few bytes of work space per byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, and bytes hashed at once.
SLICE, BLOCK = 1 << 21, 1 << 18

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_WORD = 1 << 64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 steps)."""
    x = x + U((salt * _ODD + _ODD) % _WORD)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U), 11)
_P = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_INV = pow(_P, -1, _WORD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_UP, _DOWN = _powers(_P, BLOCK + 1), _powers(_INV, BLOCK + 1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.fill_null("") if arr.null_count else arr
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    if not len(arr) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(arr: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``size`` bytes."""
    data, offs = buffers(arr)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds; a document's end ends a run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cuts = offs[1:-1]
    first[cuts[cuts < n]] = True
    first &= inside
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cuts[cuts > 0] - 1] = True
    last &= inside
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; starts ascend and spans don't overlap."""
    out = np.empty(len(starts), U)
    i, n = 0, len(starts)
    while i < n:
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        size = int(ends[j - 1] - base)
        up, down = (_UP, _DOWN) if size <= BLOCK else (_powers(_P, size + 1), _powers(_INV, size + 1))
        total = np.zeros(size + 1, U)
        np.cumsum(table[data[base : base + size]] * up[:size], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * U(_ODD))
        i = j
    return out


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of documents."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offs = offs
        self.starts, self.ends = spans(~SPACE[self.data], offs)
        #: words[at[d]:at[d + 1]] are the words of document d
        self.at = np.searchsorted(self.starts, offs)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


_STEP = 0xA0761D6478BD642F


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(_STEP) + h[j : j + n]
    return mix(out, k)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per document, the sorted distinct hashes of its k-word shingles.

    A document with fewer words has one shingle, the whole sequence; one
    without words has none.
    """
    h = words.hashes()
    win = windows(h, k)
    at = words.at
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = hi - lo
        if n >= k:
            yield np.unique(win[lo : hi - k + 1])
        elif n:
            yield windows(h[lo:hi], n)
        else:
            yield np.zeros(0, U)


def text_sets(arr: pa.Array | pa.ChunkedArray, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """``shingle_sets`` of every row of a string column, in order."""
    for _, data, offs in slices(arr):
        yield from shingle_sets(Words(data, offs, lower), k)


def set_print(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set of hashes, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = mix(s, 3).sum(dtype=U), mix(s, 5).sum(dtype=U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: a product of incidences, blocked by columns."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)  # whole numbers to 2**24
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        part = np.zeros((n, 4096), np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        out += part @ part.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def code_points(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Code points of each document."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of a flag or number per position over each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
