"""Text columns of Arrow batches as numpy byte views, cut into slices of bounded size.

Operators that look at every byte run numpy over these views. Nothing here knows Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Bytes of text that are worked on at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20

# ASCII white space: \x20 and \x09 to \x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Polynomials modulo a power of two are equal for some regular texts of 1024 bytes and more, whatever the base.
LONG_SPAN = 1000
_BASE = 0x9E3779B97F4A7C15 | 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit words (the splitmix64 step)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mixed = _mixed
_TABLE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                globals()[name] = np.multiply.accumulate(steps)


class Rolling:
    """Polynomial hashes modulo 2**64 of any substring of ``data``."""

    def __init__(self, data: np.ndarray):
        self.data = data
        _grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * _powers[: len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of substrings. Those of over ``LONG_SPAN`` bytes are hashed by another function."""
        found = _mixed((self.sums[ends] - self.sums[starts]) * _inverses[starts])
        for i in np.flatnonzero(ends - starts > LONG_SPAN):
            found[i] = xxhash.xxh3_64_intdigest(memoryview(self.data[starts[i] : ends[i]]))
        return found

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each position on."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return _mixed((self.sums[width:] - self.sums[:n]) * _inverses[:n])


class TextSlice:
    """Rows ``lo`` to ``hi`` of a text column: their bytes in ``data``, row i from ``offsets[i]`` to ``offsets[i + 1]``."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def row(self, i: int) -> memoryview:
        return memoryview(self.data[self.offsets[i] : self.offsets[i + 1]])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the first word of each row (one entry more than rows)."""
        solid = ~IS_SPACE[self.data]
        n = len(solid)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        edge = np.zeros(n + 1, dtype=bool)  # a row begins or ends before this byte
        edge[self.offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:n]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """Slices of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield TextSlice(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices start, start + 1, ... of each span, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
# Spans of up to this many bytes are compared by words.
_WORD_SPAN = 32


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; behind the end are zeros."""
    padded = np.concatenate([data, np.zeros(_WORD_SPAN + 8, np.uint8)])
    return np.ndarray(len(data) + _WORD_SPAN, "<u8", padded, strides=(1,))


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each span of ``data`` has the bytes of the span ``at`` to ``to`` of ``others``."""
    lengths = ends - starts
    same = lengths == to - at
    if not len(same):
        return same
    left = _words(data)
    right = left if others is data else _words(others)
    for k in range(0, _WORD_SPAN, 8):
        some = np.flatnonzero(same & (lengths > k)) if k else slice(None)
        n = np.clip(lengths[some] - k, 0, 8)
        same[some] &= (left[starts[some] + k] ^ right[np.minimum(at[some], len(others)) + k]) & _LOW_BYTES[n] == 0
    some = np.flatnonzero(same & (lengths > _WORD_SPAN))
    if len(some):
        n = lengths[some]
        equal = data[spans_of(starts[some], n)] == others[spans_of(at[some], n)]
        same[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans by their bytes: the hash and one span of each content, and for each span the place of its content.

    Contents are found by hash and compared; those that collide come last.
    """
    hashes, sample, which = np.unique(Rolling(data).spans(starts, ends), return_index=True, return_inverse=True)
    others = np.flatnonzero(sample[which] != np.arange(len(which)))
    like = sample[which[others]]
    odd = others[~same_bytes(data, starts[others], ends[others], data, starts[like], ends[like])]
    if len(odd):
        place: dict[bytes, int] = {}
        more, known = [], []
        for i in odd.tolist():
            raw = data[starts[i] : ends[i]].tobytes()
            if raw not in place:
                place[raw] = len(sample) + len(more)
                more.append(i)
                known.append(which[i])
            which[i] = place[raw]
        hashes, sample = np.append(hashes, hashes[known]), np.append(sample, more)
    return hashes, sample, which
