"""Vectorised text kernels for Arrow batches.

Texts stay UTF-8 bytes in one buffer; words, shingles and rolling hashes come
from prefix sums over it, so no Python object is made per word. Batches are cut
into pieces of a quarter megabyte, one whole text at least, to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
np.seterr(over="ignore")  # hashes wrap
_MULT = U64(0x9E3779B97F4A7C55)
#: Text bytes handled at once; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_table(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    if lower:
        t[65:91] = t[97:123]
    return t


_TABLE = {False: _byte_table(False), True: _byte_table(True)}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Marks ASCII bytes other than letters and digits.
NON_LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each."""
    if len(_POWERS[0]) < n:
        inverse = U64(pow(int(_MULT), -1, 1 << 64))
        size = max(n, 1 << 19)
        for k, base in enumerate((_MULT, inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def growing(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of whole texts of the first columns, each run up to twice as long as the one before."""
    limit = least
    for b in batches:
        data, offsets = buffers(b.column(0))
        first, rows = 0, len(offsets) - 1
        while first < rows:
            end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            end = min(max(end, first + 1), rows)
            yield data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
            first, limit = end, min(2 * limit, most)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts."""
    data, offsets = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a piece, with 64-bit hashes of their bytes.

    ``bounds[i]:bounds[i + 1]`` are the words of text i. ``space`` marks the
    bytes that are in no word, white space by default.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE):
        n = len(data)
        self.data, self.lower = data, lower
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~space[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.bounds = np.searchsorted(self.starts, offsets)
        self._sums = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            p, _ = powers(len(self.data) + 1)
            self._sums = np.zeros(len(self.data) + 1, U64)
            np.cumsum(_TABLE[self.lower][self.data] * p[:-1], out=self._sums[1:])
        return self._sums

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, inverse = powers(len(self.data) + 1)
        return mix((self.sums[ends] - self.sums[starts]) * inverse[starts] + (ends - starts).astype(U64))

    @property
    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


_SHINGLE = mix(np.arange(11, 43, dtype=U64)) | U64(1)


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` entries, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for k in range(width):
        total += hashes[k : k + n] * _SHINGLE[k]
    return mix(total)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts of a piece and their bounds by text.

    A text of fewer words than ``width`` has its whole sequence as its one
    shingle; a text without words has none. Repeats are kept.
    """
    h = words.hashes
    counts = np.diff(words.bounds)
    full = combine(h, width)
    n_out = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(n_out)])
    out = np.zeros(bounds[-1], U64)
    long_texts = counts >= width
    source = np.repeat(words.bounds[:-1][long_texts] - bounds[:-1][long_texts], n_out[long_texts])
    place = np.ones(len(out), bool)
    for i in np.flatnonzero((counts > 0) & ~long_texts):
        own = h[words.bounds[i] : words.bounds[i + 1]]
        place[bounds[i]] = False
        out[bounds[i]] = mix(np.array([(own * _SHINGLE[8 : 8 + len(own)]).sum() + U64(len(own))], U64))[0]
    at = np.flatnonzero(place)
    out[at] = full[at + source]
    return out, bounds


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct values of each text, ascending."""
    for i in range(len(bounds) - 1):
        part = np.sort(values[bounds[i] : bounds[i + 1]])
        yield part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part


def split_buckets(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by bucket, the buckets that occur and their bounds."""
    bucket = ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return order, found, np.append(first, len(keys))
