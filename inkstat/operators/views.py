"""Prose views that know where they come from: sentences and findings in offsets of the source.

A substitution leaves segments (place in the new text, place in the old one, whether it moves on with
the text). A chain composes them, so a view carries a short list of segments and not one number per
character; a binary search takes any place back. Replacement text stands where its match began.

Views and sentences are made per document inside a task, next to the scan; nothing is shuffled. A null
text is empty and has no sentences.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkstat.functions import patterns as P
from inkstat.functions import text as T

TEXT_BYTES = 1 << 22


def rows_within(docs: DataFrame, columns: list[str], schema: str, each: Callable[..., Iterator[tuple]]) -> DataFrame:
    """The rows that ``each`` makes of every row's ``columns``, behind its doc_id, in Arrow batches of bounded size."""
    types = StructType.fromDDL(schema)
    out = StructType().add(docs.schema["doc_id"])
    for field in types:
        out = out.add(field)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for key, *values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                for row in each(*values):
                    held.append((key, *row))
                size += sum(len(v) for v in values if isinstance(v, str))
                if size > TEXT_BYTES or len(held) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)] if held else [pa.array([], f.type) for f in arrow], schema=arrow)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return docs.select("doc_id", *columns).mapInArrow(run, out)


class OffsetMap:
    """Segments of a view: from ``places`` on it reads the source from ``sources`` on, or, where it does not move, stands at that one place."""

    def __init__(self, places: np.ndarray, sources: np.ndarray, moves: np.ndarray):
        self.places, self.sources, self.moves = places, sources, moves

    @classmethod
    def from_segments(cls, segments: list[tuple[int, int, bool]]) -> OffsetMap:
        places, sources, moves = zip(*segments) if segments else ((0,), (0,), (True,))
        return cls(np.array(places, dtype=np.int64), np.array(sources, dtype=np.int64), np.array(moves, dtype=bool))

    def segment(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.places, at, side="right") - 1

    def source(self, at: np.ndarray) -> np.ndarray:
        k = self.segment(at)
        return self.sources[k] + self.moves[k] * (at - self.places[k])

    def after(self, later: OffsetMap) -> OffsetMap:
        """The map of a view of this view."""
        kept = np.flatnonzero(later.moves)
        if not len(kept):
            begins = np.empty(0, dtype=np.int64)
        else:
            # this map's own borders, where they lie inside what the later step keeps
            ends = np.append(later.places[1:], np.iinfo(np.int64).max)[kept]
            k = np.searchsorted(later.sources[kept], self.places, side="right") - 1
            shifted = self.places - later.sources[kept][k] + later.places[kept][k]
            begins = shifted[(k >= 0) & (shifted < ends[k])]
        places = np.union1d(later.places, begins)
        between = later.source(places)
        return OffsetMap(places, self.source(between), later.moves[later.segment(places)] & self.moves[self.segment(between)])

    def span(self, start: int, end: int, length: int) -> tuple[int, int]:
        """Source span of the view's ``start`` to ``end``, of a view of ``length`` characters."""
        if not length:
            return 0, 0
        start = max(0, min(start, length - 1))
        end = max(start + 1, min(end, length))
        first, last = self.source(np.array([start, end - 1])).tolist()
        return first, last + 1


class View:
    """A text with its offset map."""

    def __init__(self, text: str, base: int = 0):
        self.text, self.map = text, OffsetMap.from_segments([(0, base, True)])

    def replace(self, pattern: re.Pattern, replacement: str | Callable[[re.Match], str]) -> None:
        pieces, segments, at, new = [], [], 0, 0
        fixed = isinstance(replacement, str) and "\\" not in replacement
        for match in pattern.finditer(self.text):
            if match.start() > at:
                pieces.append(self.text[at:match.start()])
                segments.append((new, at, True))
                new += match.start() - at
            put = replacement if fixed else replacement(match) if callable(replacement) else match.expand(replacement)
            if put:
                pieces.append(put)
                segments.append((new, match.start(), False))
                new += len(put)
            at = match.end()
        if not at:
            return
        if at < len(self.text):
            pieces.append(self.text[at:])
            segments.append((new, at, True))
        self.text, self.map = "".join(pieces), self.map.after(OffsetMap.from_segments(segments))


STEPS = [(re.compile(pattern), replacement.replace("$1", r"\g<1>")) for pattern, replacement in T.PROSE_STEPS]
FLOATS = re.compile(T.FLOAT_BLOCK)
CAPTION = re.compile(r"(?s)\\caption\*?\s*(?:\[[^\]]*\])?\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}")


def prose(tex: str | None, captions: bool = False, base: int = 0) -> View:
    """The prose view of a text; with ``captions``, a float leaves its captions behind."""
    view = View(tex or "", base)
    for pattern, replacement in STEPS:
        if captions and pattern.pattern == FLOATS.pattern:
            view.replace(pattern, lambda m: " ".join(" xxcaptionxx " + c for c in CAPTION.findall(m.group(0))) + " ")
        else:
            view.replace(pattern, replacement)
    return view


PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]+)*")
SENTENCE_GAP = re.compile(rf"(?<=[.!?])\s+(?={P.SENTENCE_START})")
SHORT_FORM = re.compile(rf"(?i)\b(?:{P.ABBREVIATIONS})\.$")
LONGEST_FORM = max(map(len, P.ABBREVIATIONS.split("|"))) + 1


def sentence_places(text: str) -> Iterator[tuple[int, int, int]]:
    """(paragraph start, start, end) of every sentence; lines without an empty one between them are one paragraph."""
    for paragraph in PARAGRAPH.finditer(text):
        start, stop = paragraph.span()
        gaps = [g.span() for g in SENTENCE_GAP.finditer(text, start, stop)]
        at = start
        for end, after in [*gaps, (stop, stop)]:
            if end < stop and SHORT_FORM.search(text, max(at, end - LONGEST_FORM), end):
                continue
            if text[at:end].strip():
                yield start, at, end
            at = after


def prose_views(docs: DataFrame, tex: str = "tex", captions: bool = False) -> DataFrame:
    """(doc_id, prose, segments): the view and its segments (place, source, moves)."""

    def each(text: str | None) -> Iterator[tuple]:
        view = prose(text, captions)
        yield view.text, [{"place": p, "source": s, "moves": m} for p, s, m in zip(view.map.places.tolist(), view.map.sources.tolist(), view.map.moves.tolist())]

    return rows_within(docs, [tex], "prose string, segments array<struct<place: long, source: long, moves: boolean>>", each)


def sentence_spans(docs: DataFrame, tex: str = "tex", captions: bool = False) -> DataFrame:
    """Sentences of the prose view: (doc_id, ord, para, text, view_start, view_end, tex_start, tex_end), ends exclusive, in code points."""

    def each(text: str | None) -> Iterator[tuple]:
        view = prose(text, captions)
        for n, (para, start, end) in enumerate(sentence_places(view.text)):
            yield n, para, view.text[start:end].strip(), start, end, *view.map.span(start, end, len(view.text))

    return rows_within(docs, [tex], "ord int, para long, text string, view_start long, view_end long, tex_start long, tex_end long", each)


def source_spans(views: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with ``segments`` of ``prose_views`` and a span of the view: adds tex_start, tex_end in offsets of the source."""

    def place(at):
        held = F.element_at(F.filter("segments", lambda s: s["place"] <= at), -1)
        return T.let(held, lambda s: s["source"] + F.when(s["moves"], at - s["place"]).otherwise(0))

    return views.withColumns({"tex_start": place(F.col(start)), "tex_end": place(F.col(end) - 1) + 1})
