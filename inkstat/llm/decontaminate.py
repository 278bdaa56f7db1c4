"""Benchmark decontamination by seeds of characters, counted along diagonals, and exact edit distances.

An item is held by a document if its edit distance, in characters, to some part of the text is at
most ``share`` of its length; this is the verdict, computed exactly (bit-parallel) for every candidate.

Items of up to ``EXACT`` characters: every text is searched for them whole, with the same bit vectors
over many parts of the text at once, so none is missed. Where ``share`` allows fewer than two edits,
an item counts as whole words (it is compared with a space on either side).

Longer items: a *seed* is a run of characters of the item that stands unchanged in the text, either
``2 * HALF`` in a row, or two runs of ``HALF`` around one character that may have been replaced, lost
or followed by an inserted one. Seeds are looked up from every character of every text and from every
character of every item. Those of one place of the item lie within ``share * length`` diagonals (text
place - item place), so they are counted in stretches of twice that width which overlap by half. A
stretch of enough seeds is a candidate. A seed weighs what it says: the logarithm of how much likelier it is
in a copy of the item than by chance, judged by the other items. How much is enough comes from ``RECALL``:
of ``TRIALS`` random sets of edits, exactly as many as ``share`` allows, that share must leave as much.
So recall is not 1 by proof for these items: edits at the limit that are placed to spare fewer seeds than
random ones (after every third character, say) are missed more often.

Items go to the tasks in groups of at most ``ITEMS`` items, one pass over the texts per group, so
what is broadcast has a fixed bound. Texts are searched whole, next to the scan, in parts of bounded
size that overlap by more than an item.

Comparison is on words of letters and digits, A-Z lower-cased, joined by spaces. Nulls: a null text or
item has no words and matches nothing; rows without an id are left out. Rows of one doc_id are one
document. Empty tables give empty results; other columns do not matter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.llm import text as X
from inkstat.llm.scratch import small_batches

RECALL, TRIALS = 0.995, 1000
HALF = 3
#: by the gap between the halves of a seed in the text: the gaps in the item
GAPS = {0: (0, 1), 1: (1,), 2: (1,)}
EXACT, LANES = 62, 2048
ITEMS = 2_000
BITS = 22
#: seeds whose log likelihood ratio is below this are left out, as far as half of an item's stay
PLAIN_SEED = 2.0
HITS, COUNTERS = 1 << 21, 1 << 22


@lru_cache(maxsize=64)
def surviving(chars: int, share: float, gap: int) -> np.ndarray:
    """Which seeds of an item of ``chars`` characters are left (a row per trial) after ``int(share * chars)`` edits at random places."""
    rng = np.random.default_rng([chars, int(share * 1000)])
    edited = np.zeros((TRIALS, chars), bool)
    np.put_along_axis(edited, np.argsort(rng.random((TRIALS, chars)), 1)[:, : int(share * chars)], True, 1)
    total = np.concatenate([np.zeros((TRIALS, 1), np.int32), np.cumsum(edited, 1, dtype=np.int32)], 1)
    n, b = chars - HALF - HALF - gap + 1, HALF + gap
    return (total[:, HALF : HALF + n] == total[:, :n]) & (total[:, b + HALF : b + HALF + n] == total[:, b : b + n])


def seed_halves(chars: np.ndarray) -> np.ndarray:
    """A hash of the ``HALF`` characters from every place; fewer than places."""
    n = max(0, len(chars) - HALF + 1)
    h = np.full(n, 0x2545F491, np.uint32)
    for j in range(HALF):
        h += chars[j : j + n]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h


def seed_keys(halves: np.ndarray, gap: int) -> np.ndarray:
    """A key of ``BITS`` bits for the seed at every place."""
    n = max(0, len(halves) - HALF - gap)
    h = halves[:n] * np.uint32(0x85EBCA6B)
    h += halves[HALF + gap : HALF + gap + n]
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - BITS)
    return h


def plain(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words of all rows, each behind a space, and where every row begins; a space closes the last."""
    at = offs + np.arange(len(offs))
    raw = np.insert(buf, offs, 32) if len(buf) else np.full(len(offs), 32, np.uint8)
    inside = X.ALNUM[raw]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[at] = True
    low = np.where(inside, raw, 32).astype(np.uint8)
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    first = keep & ((low & 0xC0) != 0x80)
    return np.frombuffer(low[keep].tobytes().decode().encode("utf-32-le"), np.uint32), (np.cumsum(first) - first)[at]


def as_text(chars: np.ndarray) -> str:
    return chars.tobytes().decode("utf-32-le")


def edit_distance(item: str, text: str) -> tuple[int, int]:
    """The smallest edit distance of ``item`` to any part of ``text``, and where the first such part ends (Myers' bit vectors)."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(xv | up)), up & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def ends_within(item: str, chars: np.ndarray, limit: int) -> np.ndarray:
    """Places of ``chars`` where a part ends whose distance to ``item`` (64 characters at most) is ``limit`` at most."""
    m, n = len(item), len(chars)
    lap = m + limit
    width = -(-n // LANES)
    letters = np.unique(np.frombuffer(item.encode("utf-32-le"), np.uint32))
    masks = np.zeros(len(letters) + 1, np.uint64)
    for i, c in enumerate(item):
        masks[np.searchsorted(letters, ord(c))] |= X.U(1) << X.U(i)
    spot = np.minimum(np.searchsorted(letters, chars), len(letters) - 1)
    eqs = np.concatenate([np.zeros(lap, np.uint64), masks[np.where(letters[spot] == chars, spot, len(letters))], np.zeros(width * LANES - n, np.uint64)])
    lanes = np.arange(LANES) * width
    one, top = X.U(1), X.U(m - 1)
    plus, minus, score = np.full(LANES, ~X.U(0)), np.zeros(LANES, np.uint64), np.full(LANES, m, np.int64)
    out = []
    for j in range(lap + width):
        eq = eqs[lanes + j]
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus), plus & xh
        score += ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64)
        up, down = up << one, down << one
        plus, minus = down | ~(xv | up), up & xv
        if j >= lap:
            out.append((lanes + (j - lap))[score <= limit])
    ends = np.concatenate(out) if out else np.empty(0, np.int64)
    return np.sort(ends[ends < n])


class Index:
    """A group of items: the short ones, and the seeds of the others."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        texts = [t.encode() for _, t in items]
        chars, begin = plain(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        self.ids = [i for i, _ in items]
        self.texts = [as_text(chars[a:b]).strip() for a, b in zip(begin[:-1], begin[1:])]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.limit = np.array([int(share * n) for n in self.size.tolist()], np.int64)
        self.sought = [f" {t} " if d < 2 else t for t, d in zip(self.texts, self.limit.tolist())]
        self.short = np.flatnonzero((self.size > 0) & (self.size <= EXACT)).tolist()
        self.long = np.flatnonzero(self.size > EXACT)
        self.width = (self.limit + 1).astype(np.int32)
        self.most = int(self.size.max(initial=0))
        self.lap = 2 * self.most + 2 * int(self.width.max(initial=1))
        keys, item, at, kind = [], [], [], []
        for i in self.long.tolist():
            halves = seed_halves(np.frombuffer(self.texts[i].encode("utf-32-le"), np.uint32))
            for gap in (0, 1):
                k = seed_keys(halves, gap)
                keys.append(k)
                item.append(np.full(len(k), i, np.int32))
                at.append(np.arange(len(k), dtype=np.int32))
                kind.append(np.full(len(k), gap, np.int8))
        keys, item, at, kind = (np.concatenate(c) if c else np.empty(0, np.int32) for c in (keys, item, at, kind))
        # a seed that other items have, too, says less: how much likelier it is in the item's copy than in a stretch of any text
        own = keys.astype(np.int64) * max(1, len(items)) + item
        _, where, many = np.unique(own, return_inverse=True, return_counts=True)
        others = np.bincount(keys.astype(np.int64), minlength=1 << BITS)[keys] - many[where]
        chance = 1 - np.exp(-2 * self.width[item] * (others / max(1, len(keys)) + 1e-6))
        weight = np.maximum(0.1, np.log((1 - share) ** (2 * HALF) / chance)).astype(np.float32)
        # seeds that say little are left out, but never more than half of an item's
        order = np.lexsort((-weight, item))
        rank = np.empty(len(item), np.int64)
        rank[order] = np.arange(len(item)) - np.searchsorted(item, item[order])
        used = (weight >= PLAIN_SEED) | (2 * rank < self.size[item])
        weight[~used] = 0
        self.need, cut = np.zeros(len(items)), np.searchsorted(item, np.arange(len(items) + 1))
        for i in sorted(self.long.tolist(), key=lambda i: int(self.size[i])):
            mine, gap = weight[cut[i] : cut[i + 1]], kind[cut[i] : cut[i + 1]]
            left = sum(surviving(int(self.size[i]), share, g).astype(np.float32) @ mine[gap == g] for g in (0, 1))
            self.need[i] = max(1e-3, 0.999 * np.sort(left)[int((1 - RECALL) * TRIALS)])
        self.tables = {}
        for kinds in sorted(set(GAPS.values())):
            of = np.flatnonzero(np.isin(kind, kinds) & used)
            of = of[np.argsort(keys[of], kind="stable")]
            begin = np.zeros((1 << BITS) + 1, np.int32)
            begin[1:] = np.cumsum(np.bincount(keys[of].astype(np.int64), minlength=1 << BITS))
            self.tables[kinds] = begin, np.diff(begin) > 0, item[of], at[of], weight[of]

    def seeded(self, chars: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to): parts of the text that hold enough seeds of a long item."""
        if not len(self.long):
            return []
        room = np.zeros(len(self.size), np.int64)
        room[self.long] = (len(chars) + self.most) // self.width[self.long] + 3
        base = np.cumsum(room) - room
        counts, halves = np.zeros(int(room.sum())), seed_halves(chars)
        for gap, kinds in GAPS.items():
            begin, mark, item, at, weight = self.tables[kinds]
            keys = seed_keys(halves, gap)
            pos = np.flatnonzero(mark[keys])
            keys = keys[pos]
            lo = begin[keys]
            many = begin[keys + np.uint32(1)] - lo
            upto = np.cumsum(many, dtype=np.int64)
            a = 0
            while a < len(pos):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
                n = many[a:b]
                done = upto[a:b] - n
                spot = np.arange(done[0], upto[b - 1]) + np.repeat(lo[a:b] - done, n)
                who = item[spot]
                diagonal = np.repeat(pos[a:b].astype(np.int32), n) - at[spot] + np.int32(self.most)
                counts += np.bincount(base[who] + diagonal // self.width[who], weights=weight[spot], minlength=len(counts))
                a = b
        need = np.repeat(self.need, room)
        full = counts.copy()
        full[:-1] += counts[1:]
        out = []
        cells = np.flatnonzero((full >= need) & (need > 0))
        owner = np.searchsorted(base + room, cells, "right")
        for i, cell in zip(owner.tolist(), (cells - base[owner]).tolist()):
            w = int(self.width[i])
            a = cell * w - self.most
            out.append((i, a, a + 2 * w + int(self.size[i])))
        return out

    def candidates(self, chars: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to): parts of the text where an item can be; parts of one item that meet are one."""
        if not len(self.size):
            return []
        out, size = set(), max(self.lap, COUNTERS * int(np.mean(self.width)) // max(1, len(self.long)))
        for a in range(0, max(1, len(chars) - self.lap), size):
            part = chars[a : a + size + self.lap]
            out.update((i, x + a, y + a) for i, x, y in self.seeded(part))
            for i in self.short:
                m, d = len(self.sought[i]), int(self.limit[i])
                for cell in np.unique(ends_within(self.sought[i], part, d) // m).tolist():
                    out.add((i, a + cell * m - m - d, a + cell * m + m))
        merged: list[tuple[int, int, int]] = []
        for i, x, y in sorted(out):
            if merged and merged[-1][0] == i and x <= merged[-1][2]:
                merged[-1] = (i, merged[-1][1], max(y, merged[-1][2]))
            else:
                merged.append((i, x, y))
        return merged


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.25, step: int = 1) -> DataFrame:
    """(doc_id, item_id, distance, item_chars, start_word): the best place of every item that a document holds.

    ``docs(doc_id, text)`` are searched for ``benchmark(item_id, text)``, from every place whatever ``step`` is.
    """
    spark = small_batches(docs.sparkSession)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    groups = max(1, -(-items.count() // ITEMS))
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance long, item_chars long, start_word long"
    parts = []
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        shared = spark.sparkContext.broadcast(Index(sorted((r["item_id"], r["text"]) for r in rows), share))

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for piece in X.pieces(batch):
                    chars, begin = plain(*X.buffers(piece.column("text")))
                    ids, best = piece.column("doc_id").to_pylist(), {}
                    for item, x, y in index.candidates(chars):
                        n, sought = int(index.size[item]), index.sought[item]
                        side = (len(sought) - n) // 2
                        for row in range(max(0, int(np.searchsorted(begin, x, "right")) - 1), min(len(ids), int(np.searchsorted(begin, y, "left")))):
                            first = int(begin[row])
                            a, b = max(first, x), min(int(begin[row + 1]) + 1, y)
                            if b - a < n - index.limit[item]:
                                continue
                            distance, end = edit_distance(sought, as_text(chars[a:b]))
                            if distance <= share * n:
                                start = a + max(0, end - side - n)
                                place = max(0, int(np.count_nonzero(chars[first:start] == 32)) - 1)
                                best[row, item] = min(best.get((row, item), (distance, place)), (distance, place))
                    found = [(ids[r], index.ids[i], d, int(index.size[i]), at) for (r, i), (d, at) in sorted(best.items())]
                    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(5)], names=[c.split()[0] for c in schema.split(", ")])

        parts.append(docs.mapInArrow(search, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    first = F.min(F.struct("distance", "start_word", "item_chars"))
    return out.groupBy("doc_id", "item_id").agg(first.alias("b")).select("doc_id", "item_id", "b.distance", "b.item_chars", "b.start_word")
