"""Alignment of two tokenizers over whole texts: shared token ends, memoised by windows of ids.

Every text is tokenised whole by a byte-level BPE (A, of space + text) and a piece model (B, which adds the space
itself). Where an A token and a B token that are marked with a space start at the same byte, the ends before them are shared:
these anchors cut a document into windows of ids. A window's alignment depends on its ids alone, so it is looked up by
the pair of id tuples and computed once per task. Inside a window every byte where both sides end a
token closes a group, and links the two tokens that end there. No token is empty, so a group has one link.

Counts: two tokens that end together in one string are suffixes of each other, so the pairs that can
ever be linked follow from the two vocabularies (``Pairs``, below a million for 50k and 32k ids, whatever the corpus).
Links are stored as places in that list; tasks count them into an array of that fixed size, the counts are
added by one exchange and go to all tasks as one array.

Texts that are null or empty, or whose tokens do not spell space + text, have no tokens. Ids (and null or repeated
ones) are only handed through: a row in is a row out. Very long texts are one row, never cut. An empty table gives an
empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.llm.scratch import Scratch

CACHE = 300_000
LONGEST = 48
SPACE_MARK = "▁"
# what stands for a part with white space at an edge, and for one whose tokens spell something else
EDGE, UNLIKE = "edge", "unlike"
APART = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pairs:
    """Both tokenizers with the bytes of every token, and the list of pairs that can be linked."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        letters = byte_letters()
        vocabulary = sorted((i, w) for w, i in self.a.get_vocab(with_added_tokens=True).items())
        self.a_bytes = {i: bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for i, w in vocabulary}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(w[3:5], 16)]) if self.b.is_byte(i) else w.replace(SPACE_MARK, " ").encode() for i, w in enumerate(names)}
        self.a_length, self.a_space = self.facts(self.a_bytes)
        self.b_length, self.b_space = self.facts(self.b_bytes)
        # words between single spaces can be tokenised one by one unless a piece reaches over a space
        self.apart = not any(SPACE_MARK in w.lstrip(SPACE_MARK) for w in names)
        self.keys = self.possible()
        # an id as text with what follows it in the text form of groups: A's, then B's ids
        self.n_a, self.n_b = len(self.a_length), len(self.b_length)
        self.forms = [f"{i}{mark}" for size, marks in ((self.n_a, ",|"), (self.n_b, (",", ";", ""))) for mark in marks for i in range(size)]

    @staticmethod
    def facts(tokens: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        length, space = np.zeros(max(tokens) + 1, dtype=np.int64), np.zeros(max(tokens) + 1, dtype=bool)
        for i, w in tokens.items():
            length[i], space[i] = len(w), w[:1] == b" "
        return length, space

    def possible(self) -> np.ndarray:
        """Sorted keys ``a * 2**32 + b`` of all pairs in which one token is a suffix of the other."""
        found: set[int] = set()
        by_a: dict[bytes, list[int]] = {}
        by_b: dict[bytes, list[int]] = {}
        for table, by in ((self.a_bytes, by_a), (self.b_bytes, by_b)):
            for i, w in table.items():
                by.setdefault(w, []).append(i)
        for a, w in self.a_bytes.items():
            found.update((a << 32) + b for at in range(len(w)) for b in by_b.get(w[at:], ()))
        for b, w in self.b_bytes.items():
            found.update((a << 32) + b for at in range(len(w)) for a in by_a.get(w[at:], ()))
        return np.array(sorted(found), dtype=np.int64)


@lru_cache(maxsize=2)
def pairs_of(byte_level: str, pieces: str) -> Pairs:
    """One instance per Python worker."""
    return Pairs(byte_level, pieces)


class Aligner:
    """Tokenises and aligns texts; the two memories are bounded and only save time."""

    def __init__(self, pairs: Pairs):
        self.p = pairs
        self.parts: dict[str, tuple[int, int, str, bytes] | str] = {}
        self.windows: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}
        self.odd: set[str] = set()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both sides, and whether both spell space + text."""
        spelled = [b" " + t.encode() for t in texts]
        a = [x.ids for x in self.p.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.p.b.encode(texts, num_threads=1)
        length, good = [len(x) for x in spelled], [True] * len(texts)
        for side, of, size in ((a, self.p.a_bytes, self.p.a_length), (b, self.p.b_bytes, self.p.b_length)):
            flat = array("I", chain.from_iterable(side))
            stops = np.concatenate([[0], np.cumsum(size[np.frombuffer(flat, "<u4")])])[np.cumsum([0, *map(len, side)])] if flat else np.zeros(len(side) + 1, dtype=int)
            # all at once if they do, else one by one
            if np.diff(stops).tolist() != length or b"".join(map(of.__getitem__, flat)) != b"".join(spelled):
                good = [g and b"".join(map(of.__getitem__, x)) == s for g, x, s in zip(good, side, spelled)]
        return a, b, good

    def meet(self, split: list[list[str]]) -> bool:
        """Tokenise and align the parts of texts that are not known yet; whether all parts are plain ones."""
        met = set().union(*split)
        fresh = met - self.parts.keys()
        if len(self.parts) + len(fresh) > CACHE:  # start anew with the parts of these texts
            self.parts, self.windows, self.odd, fresh = {}, {}, set(), met
        edges = {w for w in fresh if not w or w[0].isspace() or w[-1].isspace()}
        self.parts.update(dict.fromkeys(edges, EDGE))
        found = self.whole(list(fresh - edges))
        self.parts.update(found)
        self.odd.update(edges, (w for w, x in found.items() if x is UNLIKE))
        return self.odd.isdisjoint(met)

    def whole(self, texts: list[str]) -> dict[str, tuple[int, int, str, bytes] | str]:
        """Each text, tokenised in one go: token numbers, groups, links; ``UNLIKE`` where the tokens do not spell it."""
        a, b, good = self.encode(texts)
        out: dict[str, tuple[int, int, str, bytes] | str] = {t: UNLIKE for t, g in zip(texts, good) if not g}
        texts, a, b = ([x for x, g in zip(side, good) if g] for side in (texts, a, b))
        if not texts:
            return out
        # texts laid end to end: every one starts with a space on both sides, so they are apart at anchors
        windows, first = self.anchored(array("I", chain.from_iterable(a)).tobytes(), array("I", chain.from_iterable(b)).tobytes(), np.cumsum([0, *map(len, a)])[:-1])
        fresh = self.learn([w for w in set(windows) if w not in self.windows])
        hits = [self.windows[w] if w in self.windows else fresh[w] for w in windows]
        self.windows.update((w, x) for w, x in fresh.items() if len(w[0]) + len(w[1]) <= 8 * LONGEST)
        for text, left, right, s, e in zip(texts, a, b, first, [*first[1:], len(hits)]):
            groups, links = zip(*hits[s:e])
            out[text] = (len(left), len(right), ";".join(groups), b"".join(links))
        return out

    def documents(self, texts: list[str]) -> list[tuple[int, int, str, bytes]]:
        """Token numbers, groups and links of every text; nothing where the tokens do not spell space + text.

        A token of either side starts at a single space between two other characters, so the parts between such spaces
        are tokenised by themselves, each different one once; a text with a part that is not spelled is tokenised in one go.
        """
        if self.p.apart:
            split = [t.split(" ") for t in texts]
            plain = self.meet(split)
            found = [list(map(self.parts.__getitem__, words)) for words in split]
            # white space around a space: cut only where both neighbours are other characters
            loose = {} if plain else {n: APART.split(texts[n]) for n, f in enumerate(found) if EDGE in f}
            fresh = set().union(*loose.values())
            more = {w: x for w in fresh if (x := self.parts.get(w, EDGE)) is not EDGE}
            more |= self.whole([w for w in fresh if w not in more])
            for n, words in loose.items():
                found[n] = [more[w] for w in words]
            for w in {w for words in split for w in words if len(w) > LONGEST}:
                self.parts.pop(w, None)
        else:
            plain, found = False, [[UNLIKE]] * len(texts)
        unlike = set() if plain else {n for n, f in enumerate(found) if UNLIKE in f}
        again = self.whole([texts[n] for n in unlike])
        out = []
        for n, parts in enumerate(found):
            if n in unlike:
                parts = [again[texts[n]]]
            if parts[0] is UNLIKE:
                out.append((0, 0, "", b""))
            else:
                n_a, n_b, groups, links = zip(*parts)
                out.append((sum(n_a), sum(n_b), ";".join(groups), b"".join(links)))
        return out

    def learn(self, windows: list[tuple[bytes, bytes]]) -> dict[tuple[bytes, bytes], tuple[str, bytes]]:
        """Align windows, given as pairs of id tuples: their text form and their links' places in the list of pairs.

        Both sides of a window spell the same bytes, so windows laid end to end still share all their ends.
        """
        if not windows:
            return {}
        left, right = np.frombuffer(b"".join([a for a, _ in windows]), "<u4"), np.frombuffer(b"".join([b for _, b in windows]), "<u4")
        a_end, b_end = np.cumsum(self.p.a_length[left]), np.cumsum(self.p.b_length[right])
        a_last = b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end
        b_last = a_end[np.minimum(np.searchsorted(a_end, b_end), len(a_end) - 1)] == b_end
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        # A's tokens of a group, then B's: a token is moved back by the other side's tokens in front of it
        a_sizes, b_sizes = np.bincount(a_group), np.bincount(b_group)
        a_place = np.arange(len(left)) + (np.cumsum(b_sizes) - b_sizes)[a_group]
        b_place = np.arange(len(right)) + np.cumsum(a_sizes)[b_group]
        a_count, b_count = (np.array([len(w[side]) // 4 for w in windows]) for side in (0, 1))
        a_stop, b_stop = np.cumsum(a_count), np.cumsum(b_count)
        b_form = b_last.astype(np.int64)
        b_form[b_stop - 1] = 2
        forms = np.empty(len(left) + len(right), dtype=np.int64)
        forms[a_place], forms[b_place] = left + self.p.n_a * a_last, 2 * self.p.n_a + right + self.p.n_b * b_form
        text = list(map(self.p.forms.__getitem__, forms.tolist()))
        links = np.searchsorted(self.p.keys, (left[a_last].astype(np.int64) << 32) + right[b_last]).astype("<u4").tobytes()
        groups = (4 * np.cumsum(a_last)[a_stop - 1]).tolist()
        stops = (a_stop + b_stop).tolist()
        return {w: ("".join(text[s:e]), links[u:v]) for w, s, e, u, v in zip(windows, [0, *stops], stops, [0, *groups], groups)}

    def anchored(self, a: bytes, b: bytes, starts: np.ndarray) -> tuple[list[tuple[bytes, bytes]], list[int]]:
        """Windows of ids, cut where both sides start a space-marked token at the same byte, and the window at each A token of ``starts``."""
        left, right = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
        i, j = np.flatnonzero(self.p.a_space[left]), np.flatnonzero(self.p.b_space[right])
        a_start, b_start = np.cumsum(self.p.a_length[left])[i] - self.p.a_length[left[i]], np.cumsum(self.p.b_length[right])[j] - self.p.b_length[right[j]]
        near = np.minimum(np.searchsorted(b_start, a_start), len(b_start) - 1)
        shared = b_start[near] == a_start
        first = np.searchsorted(i[shared], starts).tolist()
        ai, bj = (4 * i[shared]).tolist(), (4 * j[near[shared]]).tolist()
        return [(a[s:e], b[u:v]) for s, e, u, v in zip(ai, [*ai[1:], len(a)], bj, [*bj[1:], len(b)])], first


ALIGNED = "doc_id {id}, n_a long, n_b long, groups string, links binary"


def alignments(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, groups, links) of every row of ``docs(doc_id, text)``.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``; ``links`` are places in ``Pairs.keys`` as 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(pairs_of(byte_level, pieces))
        gc.disable()  # the memories are millions of small objects without cycles
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            # a bounded amount of text at a time, so long texts do not pile up as lists of words
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 20):
                    size += len(texts[end])
                    end += 1
                rows = [(0, 0, "", b"")] * (end - at)
                full = [n for n in range(at, end) if texts[n]]
                for n, found in zip(full, aligner.documents([texts[n] for n in full])):
                    rows[n - at] = found
                n_a, n_b, groups, links = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.string()), pa.array(links, pa.binary())],
                    names=["doc_id", "n_a", "n_b", "groups", "links"])
                at = end
        gc.enable()

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED.format(id=docs.schema["doc_id"].dataType.simpleString()))


def pair_counts(links: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, n): how many links hold the pair, over all rows of ``links(links)``. A task sends a row per pair that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_pairs, dtype=np.int64)
        for batch in batches:
            met = np.frombuffer(b"".join(x or b"" for x in batch.column(0).to_pylist()), "<u4")
            counts += np.bincount(met, minlength=n_pairs)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held])], names=["pair", "n"])

    return links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_table(links: DataFrame, byte_level: str, pieces: str) -> tuple[np.ndarray, np.ndarray]:
    """(count, best) of every possible pair: its corpus-wide links, and whether no pair of its B id has more."""
    pairs = pairs_of(byte_level, pieces)
    count = np.zeros(len(pairs.keys), dtype=np.int64)
    met = pair_counts(links, len(count)).toPandas()  # at most one row per possible pair
    count[met["pair"].to_numpy()] = met["n"].to_numpy()
    b = pairs.keys & 0xFFFFFFFF
    top = np.zeros(int(b.max()) + 1, dtype=np.int64)
    np.maximum.at(top, b, count)
    return count, (count == top[b]) & (count > 0)


def score_links(aligned: DataFrame, count: np.ndarray, best: np.ndarray) -> DataFrame:
    """``aligned`` with n_links, n_best and count_sum in place of ``links``."""
    kept = [c for c in aligned.columns if c != "links"]
    held = aligned.sparkSession.sparkContext.broadcast((count, best))  # as long as the list of pairs, which the vocabularies bound
    kinds = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = held.value
        for batch in batches:
            links = [np.frombuffer(x or b"", "<u4") for x in batch.column(len(kept)).to_pylist()]
            sums = [[len(x) for x in links], [int(np.count_nonzero(best[x])) for x in links], [int(count[x].sum()) for x in links]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *(pa.array(s, pa.int64()) for s in sums)], names=[*kept, "n_links", "n_best", "count_sum"])

    return aligned.select(*kept, "links").mapInArrow(run, f"{kinds}, n_links long, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str, keep: dict | None = None) -> DataFrame:
    """Alignment of every document with its links scored by corpus-wide counts.

    ``keep`` names the columns to store, as expressions over doc_id, n_a, n_b, groups; by default these four. The stored
    table is read twice, for the counts and for the scores; texts are tokenised once.
    """
    keep = keep or {c: F.col(c) for c in ("doc_id", "n_a", "n_b", "groups")}
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(alignments(docs, byte_level, pieces).select(*(e.alias(c) for c, e in keep.items()), "links"), "aligned")
    return score_links(rows, *pair_table(rows, byte_level, pieces))
