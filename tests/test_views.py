"""Prose views, sentence spans and quote spans against models that keep one offset per character."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from inkstat.functions import text as T
from inkstat.operators import citation as C
from inkstat.operators import views as V

PIECES = [r"\emph{", "}", "$a$", r"\cite{k}", " ", "\n", "\n\n", "Word", "x. ", "Y", r"\section{T}", r"\begin{figure}\caption{C d}", r"\end{figure}", "~", r"\%", "{",
          r"\begin{itemize}", r"\item", r"\ref{a}", "% MISSING INPUT q\n", "e.g. ", "é😀", r"\begin{quote}", r"\end{quote}", r"\href{u}{v}", r"\thmref{t}", r"\begin{align*}", r"\end{align*}"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(n)]


def per_character(text):
    origin = list(range(len(text)))
    for pattern, replacement in V.STEPS:
        out, places, at = [], [], 0
        for m in pattern.finditer(text):
            put = m.expand(replacement)
            out += [text[at:m.start()], put]
            places += origin[at:m.start()] + [origin[m.start()]] * len(put)
            at = m.end()
        text, origin = "".join(out) + text[at:], places + origin[at:]
    return text, origin


def test_segments_equal_an_offset_per_character():
    for tex in random_texts(800, 1):
        text, origin = per_character(tex)
        view = V.prose(tex)
        assert view.text == text
        if text:
            assert view.map.source(np.arange(len(text))).tolist() == origin
            assert len(view.map.places) <= len(text)


def test_spark_view_and_spans(spark):
    texts = [*random_texts(200, 2), "", None, r"a \begin{Verbatim}q $ z\end{Verbatim} b \thmref{t:x} c \crefname{a}{b} \hyperref[l]{m}", "word " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tex string").withColumn("segments", F.lit("x"))
    native = {r.doc_id: r.p for r in df.select("doc_id", T.prose_view(F.col("tex")).alias("p")).collect()}
    views = V.prose_views(df)
    rows = V.source_spans(views.withColumns({"start": F.lit(3), "end": F.lit(7)})).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, origin = per_character(texts[r.doc_id] or "")
        assert r.prose == text and native[r.doc_id] in (text, None if texts[r.doc_id] is None else text)
        if len(text) >= 7:
            assert (r.tex_start, r.tex_end) == (origin[3], origin[6] + 1)
    verbatim = native[len(random_texts(200, 2)) + 2]
    assert verbatim.startswith("a xxverbatimxx b xxrefxx c a b")


def test_sentence_spans(spark):
    tex = "Intro \\emph{one} e.g. Two words. \\textbf{Next} is \\cite{a}!\nSame paragraph goes on? Yes.\n\nNew \\begin{figure}\\caption{Shown here.}\\end{figure} one. et al. Works"
    df = spark.createDataFrame([(1, tex), (2, None), (3, "")], "doc_id int, tex string")
    rows = V.sentence_spans(df).orderBy("ord").collect()
    assert [(r.text, tex[r.tex_start:r.tex_end]) for r in rows] == [
        ("Intro one e.g. Two words.", "Intro \\emph{one} e.g. Two words."), ("Next is xxcitexx !", "\\textbf{Next} is \\cite{a}!"), ("Same paragraph goes on?", "Same paragraph goes on?"), ("Yes.", "Yes."),
        ("New one. et al. Works", "New \\begin{figure}\\caption{Shown here.}\\end{figure} one. et al. Works")]
    assert {r.doc_id for r in rows} == {1} and len({r.para for r in rows}) == 2
    held = V.sentence_spans(df, captions=True).where("text LIKE '%xxcaptionxx Shown here.%'").first()
    assert tex[held.tex_start:held.tex_end].startswith("New \\begin{figure}")


def find(quote, source):
    """A plain search by words."""
    norm = lambda s: " ".join(re.findall("[a-z0-9%]+", re.sub(r"\\[a-z]+\*?", " ", s.lower())))
    if not quote or not source:
        return None
    if quote in source:
        return source.index(quote), source.index(quote) + len(quote)
    q, s = norm(quote), norm(source)
    at = s.find(q) if q else -1
    if at < 0 and len(q) > 50:
        at = s.find(q[:50])
    words = [m.span() for m in re.finditer("[A-Za-z0-9%]+", source)]
    first = s[:max(at, 0)].count(" ")
    if at < 0 or not q or first >= len(words):
        return None
    return words[first][0], words[min(len(words) - 1, first + len(q.split()) - 1)][1]


def test_quote_spans_equal_a_plain_search(spark):
    rng = random.Random(4)
    parts = ["The", "model", "fails", "(often)", "12%", "é", "--", "on", "long", "\\emph{x}", "a", "texts,", "\n"]
    cases = [("", "a"), ("a", ""), (None, "a"), ("a", None), ("...", "a b"), ("A b", "x a  b.")]
    for _ in range(300):
        source = " ".join(rng.choices(parts, k=rng.randint(1, 60)))
        words = source.split(" ")
        k = rng.randrange(len(words))
        quote = rng.choice([" ", "  ", ", "]).join(words[k:k + rng.randint(1, 25)])
        cases.append((rng.choice([quote, quote.upper(), quote + " end", quote + rng.choice(["!", "é"])]), source))
    df = spark.createDataFrame([(i, q, s) for i, (q, s) in enumerate(cases)], "doc_id long, quote string, source string")
    verified = C.verify_quotes(df)
    for r in verified.collect():
        assert (tuple(r.span) if r.span else None) == find(r.quote, r.source), (r.quote, r.source)
    total = C.quote_statistics(verified, []).first()
    assert total.n == len(cases) - 1 and total.unverified == sum(find(q, s) is None for q, s in cases if q is not None)
