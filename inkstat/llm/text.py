"""Words of an Arrow string column as NumPy arrays: positions and 64-bit hashes, without a Python object per word.

A column is read as the bytes behind it, in pieces of bounded size, whatever the number or the
length of the texts. Hashes of different words agree with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U = np.uint64
SPACE = b" \t\n\x0b\x0c\r"


def byte_class(members: bytes) -> np.ndarray:
    """True for every byte that is in ``members``."""
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


# words of the word-shingle operators: everything but ASCII white space, A-Z lower-cased
PLAIN = ~byte_class(SPACE)
# words without punctuation: ASCII letters and digits, and every byte of a non-ASCII character
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z."""
    v = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    v[65:91] = v[97:123]
    return v


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n, of an odd p."""
    p = 0x9E3779B97F4A7C15
    out = []
    for base in (p, pow(p, -1, 1 << 64)):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each; a longer text is a slice of its own."""
    offs = buffers(batch.column(column))[1]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start bytes, sizes and hashes of all words, and the first word's index of every row (one entry more than rows).

    The bytes are taken in parts that end between words, so that temporary arrays stay small for
    a text of any length.
    """
    n = len(buf)
    all_starts, all_sizes, all_hashes = [], [], []
    value, at = byte_values(), 0
    while at < n:
        end = min(n, at + PIECE)
        while end < n and member[buf[end]] and member[buf[end - 1]]:  # a word is never cut
            inner = offs[np.searchsorted(offs, end, "left")]
            step = np.flatnonzero(~member[buf[end : min(n, end + 4096)]])
            stop = end + int(step[0]) if len(step) else min(n, end + 4096)
            if inner <= stop:
                end = int(inner)
                break
            end = stop
        part = buf[at:end]
        inside = member[part]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = offs[np.searchsorted(offs, at, "left") : np.searchsorted(offs, end, "left")] - at
        begin[edges] = inside[edges]
        starts = np.flatnonzero(begin)
        if len(starts):
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            cut = edges[edges > 0] - 1
            last[cut] = inside[cut]
            ends = np.flatnonzero(last) + 1
            up, down = powers(1 << (len(part) - 1).bit_length() if len(part) > 1 else 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(value[part] * up[: len(part)], out=total[1:])
            all_hashes.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
            all_starts.append(starts + at)
            all_sizes.append(ends - starts)
        at = end
    starts = np.concatenate(all_starts) if all_starts else np.empty(0, np.int64)
    hashes = np.concatenate(all_hashes) if all_hashes else np.empty(0, np.uint64)
    sizes = np.concatenate(all_sizes) if all_sizes else np.empty(0, np.int64)
    return starts, sizes, hashes, np.searchsorted(starts, offs, "left")


def windows(hashes: np.ndarray, k: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every k words in a row and whether they stand in one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= U(0xD6E8FEB86659FD93)
        h += hashes[j : n + j]
        h ^= h >> U(29)
    inside = np.ones(n, bool)
    for j in range(1, k):
        ends = first[1:-1] - j
        inside[ends[(ends >= 0) & (ends < n)]] = False
    return mix(h), inside


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; a text of fewer words is one shingle, one without words none."""
    _, _, hashes, first = words(buf, offs)
    h, inside = windows(hashes, k, first)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            short = hashes[a : a + 1] + U(b - a)
            for x in hashes[a + 1 : b]:
                short = mix(short) + x
            out.append(mix(short))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def list_column(parts: list[np.ndarray], dtype: str = "int64") -> pa.ListArray:
    """A list column from one array per row."""
    flat = np.concatenate(parts) if parts else np.empty(0, dtype)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat.view(dtype) if flat.dtype.itemsize == 8 and dtype == "int64" else flat.astype(dtype)))
