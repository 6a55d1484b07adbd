"""Vectorised views of text columns as UTF-8 bytes.

A text column reaches Python as an Arrow string array: one byte buffer and row
offsets.  Everything here works on slices of that buffer, a few megabytes at a
time and always whole rows, so no Python object is made per word and memory is
bounded by the slice or by the longest single text, whichever is larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are looked at together.
CHUNK = 1 << 20
#: Words and lines of so many bytes are hashed by BLAKE2b.  A polynomial modulo 2**64 has texts of 1,024
#: bytes (Thue-Morse sequences) that are equal for every base and code; of so few bytes there are none.
LONG = 256

_rng = np.random.default_rng(20240607)
#: A random odd 64-bit number for every byte value, and the base of the polynomial.
BYTE_CODE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = int(_rng.integers(0, 1 << 62)) * 8 + 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: [\x20\x09-\x0D]
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
#: Every ASCII byte that is not a letter or a digit parts words; bytes of longer code points never do.
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (at least)."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK + CHUNK // 2)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every input bit (splitmix64's finisher)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets (from 0) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.empty(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def row_slices(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to `limit` bytes each, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of codes[i:j], still times BASE**i."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) that depend on the content and length only."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def content_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end), safe at any length."""
    h = span_hash(prefix_hash(BYTE_CODE[data]), start, end)
    if len(long := np.flatnonzero(end - start >= LONG)):
        raw = memoryview(data.tobytes())
        digests = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start[long].tolist(), end[long].tolist())]
        h[long] = np.frombuffer(b"".join(digests), np.uint64)
    return h


def words(data: np.ndarray, offs: np.ndarray, parts: np.ndarray = WHITE, fold: np.ndarray = SAME):
    """(first byte, end byte, row, 64-bit hash) of every word, in order.  Words are runs of bytes for
    which `parts` is false within one row; the hash is of the bytes as `fold` maps them."""
    n = len(data)
    if n == 0:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, np.uint64)
    inside = ~parts[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    rows = offs[:-1][offs[:-1] < offs[1:]]
    first[rows] = inside[rows]
    last[rows[1:] - 1] = inside[rows[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offs, start, "right") - 1
    return start, end, row, content_hash(fold[data], start, end)


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, and the index of the first word of each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(out[at] + U64(k)), at


def row_starts(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted array of row numbers, and its length last."""
    return np.searchsorted(row, np.arange(n + 1))


def fold_sets(values: np.ndarray, bounds: np.ndarray, salt: int = 0) -> np.ndarray:
    """One 64-bit hash for each segment values[bounds[i]:bounds[i+1]]; empty segments get 0."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    if len(values):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ U64(salt)), out=sums[1:])
        out = mix(sums[bounds[1:]] - sums[bounds[:-1]] + (bounds[1:] - bounds[:-1]).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        out[bounds[1:] == bounds[:-1]] = 0
    return out
