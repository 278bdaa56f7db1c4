"""Build-up depth under hash-ordered permutations, many documents and permutations at a time."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

CHUNK = 1 << 15  # hashes at a time, so that a round's arrays stay in the cache
SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4


def _md5_first(words: list[np.ndarray | None], shape: tuple[int, ...]) -> np.ndarray:
    """First 32 bits of the md5 of one-block messages, given as 16 little-endian words; None is a word of zeros."""
    start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(shape, x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(SINES[i])
        if words[g] is not None:
            f += words[g]
        turned = f << np.uint32(TURNS[i])
        f >>= np.uint32(32 - TURNS[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return (a + np.uint32(start[0])).byteswap()


@lru_cache(maxsize=64)
def _tails(length: int, n: int, first: int, last: int, seed: int) -> np.ndarray:
    """Words of what stands behind a prefix of ``length`` bytes, for permutations first..last-1 and n units."""
    out = np.zeros((last - first, n, 64), np.uint8)
    for r in range(first, last):
        for i in range(n):
            tail = f"{r}:{i}:{seed}".encode()
            out[r - first, i, length : length + len(tail) + 1] = [*tail, 128]
            out[r - first, i, 56:64] = list((8 * (length + len(tail))).to_bytes(8, "little"))
    return out.view("<u4")


def draws(docs: list[str], n: int, first: int, last: int, seed: int) -> np.ndarray:
    """First 32 bits of md5(doc:permutation:unit:seed) as (document, permutation, unit)."""
    out = np.empty((len(docs), last - first, n), np.int64)
    heads = [f"{d}:".encode() for d in docs]
    for length in {len(h) for h in heads}:
        at = [j for j, h in enumerate(heads) if len(h) == length]
        if length + len(f"{last}:{n}:{seed}") > 55:  # more than one block
            for j in at:
                out[j] = [[int(hashlib.md5(heads[j] + f"{r}:{i}:{seed}".encode()).hexdigest()[:8], 16) for i in range(n)] for r in range(first, last)]
            continue
        tails = _tails(length, n, first, last, seed)
        front = np.frombuffer(b"".join(heads[j].ljust(64, b"\0") for j in at), "<u4").reshape(-1, 16)
        step = max(1, CHUNK // tails[..., 0].size)
        for s in range(0, len(at), step):
            block = front[s : s + step]
            words = [block[:, None, None, k] | tails[None, :, :, k] if tails[..., k].any() or block[:, k].any() else None for k in range(16)]
            out[at[s : s + step]] = _md5_first(words, (len(block), *tails.shape[:2]))
    return out


def depth_totals(orders: np.ndarray, incoming: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Summed depth of the key units as (document, permutation).

    orders: (document, permutation, place) -> unit; incoming: (document, unit, unit) is true where the
    second is a predictor of the first; keys: (document, unit) -> how often the unit counts.
    """
    docs, reps, n = orders.shape
    depth = np.full((docs, reps, n), -1, np.int64)  # not read yet
    rows, cols = np.arange(docs)[:, None], np.arange(reps)[None, :]
    for place in range(n):
        unit = orders[:, :, place]
        depth[rows, cols, unit] = np.where(incoming[rows, unit], depth, -1).max(axis=2) + 1
    return (depth * keys[:, None, :]).sum(axis=2)


def totals(docs: list[str], n: int, edges: list[list[tuple[int, int]]], keys: list[list[int]], first: int, last: int, seed: int):
    """Yields per document: the total in document order, and for the permutations first..last-1 their sum, sum of squares and how many lie below it."""
    step = max(1, CHUNK // ((last - first) * n))
    for s in range(0, len(docs), step):
        part = slice(s, s + step)
        incoming, count = np.zeros((len(docs[part]), n, n), bool), np.zeros((len(docs[part]), n), np.int64)
        for j, (es, ks) in enumerate(zip(edges[part], keys[part])):
            for src, dst in es:
                if 0 <= src < n and 0 <= dst < n:
                    incoming[j, dst, src] = True
            for k in ks:
                if 0 <= k < n:
                    count[j, k] += 1
        order = np.sort(draws(docs[part], n, first, last, seed) << 31 | np.arange(n), axis=2) & (2**31 - 1)
        plain = np.broadcast_to(np.arange(n), (len(count), 1, n))
        seen, null = depth_totals(plain, incoming, count)[:, 0], depth_totals(order, incoming, count)
        yield from zip(seen.tolist(), null.sum(axis=1).tolist(), (null * null).sum(axis=1).tolist(), (null < seen[:, None]).sum(axis=1).tolist())
