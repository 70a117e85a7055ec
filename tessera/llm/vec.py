"""Vectorised text kernels shared by the training-data operators.

Everything here works on the UTF-8 bytes of an Arrow string column, one slice of
bounded size at a time, so a worker's memory follows ``SLICE_BYTES`` (or the one
longest text) and not the batch.  Hashes are fixed functions of the bytes: a task
that is run again after a lost executor gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one set of numpy passes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes hashed at once: a longer text is taken in blocks that end between words.
BLOCK_BYTES = 4 << 20

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h *= _M1
    h ^= h >> U64(27)
    h *= _M2
    h ^= h >> U64(31)
    return h


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * _MUL)


def byte_table(separators: bytes, fold_case: bool = False) -> np.ndarray:
    """A value for each byte: 0 for separators, else a fixed random odd number (A-Z as a-z on request)."""
    table = constants(256, 7) | U64(1)
    if fold_case:
        table[65:91] = table[97:123]
    table[np.frombuffer(separators, dtype=np.uint8)] = 0
    return table


#: Words between blanks: ``[^\x20\x09-\x0D]+``.
BLANK_WORDS = byte_table(bytes([32, *range(9, 14)]))
BLANK_WORDS_FOLDED = byte_table(bytes([32, *range(9, 14)]), True)
#: Letters and digits after A-Z are folded: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM_WORDS = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)

_P = 0x5851F42D4C957F2D
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, dtype=U64), "i": np.ones(1, dtype=U64)}


def _upto(name: str, base: int, n: int) -> np.ndarray:
    have = _powers[name]
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        _powers[name] = have
    return have[:n]


def _gap(data: np.ndarray, table: np.ndarray, at: int) -> int:
    """The first separator from ``at`` on, or the end."""
    while at < len(data):
        found = np.flatnonzero(table[data[at : at + 4096]] == 0)
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(data)


def _words(data: np.ndarray, cuts: np.ndarray, table: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of a block; no word goes across a cut."""
    n = len(data)
    v = table[data]
    is_word = v != 0
    begin, stop = is_word.copy(), is_word.copy()
    begin[1:] &= ~is_word[:-1]
    stop[:-1] &= ~is_word[1:]
    begin[cuts] = is_word[cuts]
    stop[cuts - 1] = is_word[cuts - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    v *= _upto("p", _P, n)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(v, out=total[1:])
    h = total[end] - total[start]
    h *= _upto("i", _PINV, n)[start] if n else U64(1)
    return start + shift, end + shift, mix(h)


class Words:
    """Words of a slice of texts.

    ``hash``: 64-bit hash of each word; ``first``: index of the first word of each text
    (one more entry than texts); ``start``/``end``: byte positions in ``data``.
    """

    __slots__ = ("data", "offsets", "start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        n, lo, parts = len(data), 0, []
        while lo < n or not parts:
            hi = _gap(data, table, lo + BLOCK_BYTES)
            cuts = offsets[1:-1]
            parts.append(_words(data[lo:hi], cuts[(cuts > lo) & (cuts < hi)] - lo, table, lo))
            lo = hi
        self.start, self.end, self.hash = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True))
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of each run of k words inside one text."""
        h = self.hash
        m = len(h) - k + 1
        if m <= 0:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        inside = np.ones(len(h), dtype=bool)
        counts = self.counts()
        for back in range(1, k):
            ends = self.first[1:][counts >= back] - back
            inside[ends] = False
        at = np.flatnonzero(inside)
        at = at[at < m]
        return sequence_hash(h, at, k), at


def sequence_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i], ..., h[i + k - 1] for each i in at, order-sensitive."""
    out = np.zeros(len(at), dtype=U64)
    for j in range(k):
        out *= _MUL
        out += h[at + j]
    return mix(out)


class Runs:
    """Hashes of runs of consecutive words, order-sensitive, in constant time for each run whatever its length."""

    __slots__ = ("total", "back")

    def __init__(self, h: np.ndarray):
        self.total = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(h * _upto("p", _P, len(h)), out=self.total[1:])
        self.back = _upto("i", _PINV, len(h))

    def __call__(self, at: np.ndarray, k: int) -> np.ndarray:
        """The hash of words i, ..., i + k - 1 for each i in at."""
        return mix((self.total[at + k] - self.total[at]) * self.back[at])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is null) of an Arrow string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()) if not pa.types.is_binary(column.type) else column, np.int32
    null = column.is_null().to_numpy(zero_copy_only=False)
    if null.any():
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if raw is not None and len(column) else np.zeros(len(column) + 1, dtype=np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return bytes_, offsets, null


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one row."""
    data, offsets, _ = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
