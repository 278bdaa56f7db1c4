"""Quality rules as a short-circuit cascade, ordered by what they reject per second of work.

Every rule has statistics that it reads; a statistic is computed at most once per text and only if
a rule that is reached asks for it. Cost and selectivity of each rule are measured on the first
``sample_rows`` rows; the cascade runs the rules by falling rejection per cost and stops at the
first that rejects. The order changes the work, never the verdict: a text is kept if no rule
rejects it.

Nulls: a null text has no words and is rejected as too short. A row without doc_id is judged like
any other. Very long texts are judged whole, one at a time. Repeated rows give repeated results;
an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.llm.scratch import small_batches
from inkstat.llm.text import SPACE

SYMBOLS = "#*$%&|<>"
SPACES = SPACE.decode()
UPPER = bytes(range(0x41, 0x5B))
LETTERS = UPPER + bytes(range(0x61, 0x7B))


class Stats:
    """Statistics of one text, each computed when first read."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        seen = Counter(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(seen) == max(0, len(w) - 4):
            return 0
        covered, upto = 0, 0
        for i, gram in enumerate(zip(w, w[1:], w[2:], w[3:], w[4:])):
            if seen[gram] > 1:
                covered += i + 5 - max(i, upto)
                upto = i + 5
        return covered

    @cached_property
    def n_exclaims(self) -> int:
        return self.text.count("!")

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, UPPER))

    @cached_property
    def n_letters(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, LETTERS))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Stats], bool]


BASE_RULES = (
    Rule("few_words", lambda s: s.n_words < 10),
    Rule("repeated_windows", lambda s: 100 * s.n_repeat_words > 20 * s.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("repeated_lines", lambda s: 4 * s.n_dup_lines > 3 * len(s.lines)),
    Rule("word_length", lambda s: s.word_chars > 20 * s.n_words or s.word_chars < 2 * s.n_words),
    Rule("exclaims", lambda s: 5 * s.n_exclaims > s.n_words),
    Rule("capitals", lambda s: 2 * s.n_upper > s.n_letters),
)


def texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int) -> list[int]:
    """Rules by falling rejection per second on the sample; one row per rule and task comes back."""

    def measure(batches):
        seconds, rejected, rows = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in texts(batch):
                rows += 1
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += rule.rejects(Stats(text))
                    seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(rejected, pa.int64())], names=["rule", "seconds", "rejected"])

    sample = docs.select("text").limit(sample_rows).mapInArrow(measure, "rule int, seconds double, rejected long")
    found = {r["rule"]: r["rejected"] / (r["seconds"] + 1e-9) for r in sample.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()}
    return sorted(range(len(rules)), key=lambda i: (-found.get(i, 0.0), i))


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, report: tuple[str, ...] = (), sample_rows: int = 500) -> DataFrame:
    """(doc_id, kept, failed_rule, then the statistics named in ``report``), one row per row of ``docs(doc_id, text)``.

    ``failed_rule`` is the one the cascade stopped at, so it depends on the measured order; the
    rest does not.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    order = cascade_order(docs, rules, sample_rows)

    def judge(batches):
        for batch in batches:
            stats = [Stats(t) for t in texts(batch)]
            failed = [next((rules[i].name for i in order if rules[i].rejects(s)), None) for s in stats]
            values = [pa.array([getattr(s, name) for s in stats], pa.int64()) for name in report]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f is None for f in failed], pa.bool_()), pa.array(failed, pa.string()), *values], names=["doc_id", "kept", "failed_rule", *report])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(judge, f"doc_id {kind}, kept boolean, failed_rule string" + "".join(f", {name} long" for name in report))
