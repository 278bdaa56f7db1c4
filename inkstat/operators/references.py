"""Reference lists and citation markers of plain text.

A numbered list is read in text order by a fold that carries the next wanted number: a marker opens an
entry only if it is that number, any other one (a repeat, a citation inside of an entry) is text of the entry it
stands in. A list with fewer than three such entries is taken as author-year and cut behind a year that ends an
entry. All steps are column functions over one row's text; a null text has no entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstat.functions import text as T

# What ends a list, an entry, a title, and what an author list is made of.
LINE_NUMBER = r"(?m)^[ \t]*\d{1,4}[ \t]*(?:\n|\z)"
CHECKLIST = r"(?im)Agents4Science\s+AI\s+Involvement\s+Checklist|IMPORTANT, please|NeurIPS Paper Checklist|^\s*A\s+Appendix"
ENTRY_END = r"(?:19|20)\d{2}[a-z]?\s*[.)]\s*(?:doi:\s*\S+\s*|URL\s+\S+\s*|Available[^.]{0,40}\.\s*)*(?=[A-ZÀ-Þ])"
LEADING_LINK = r"^(?:URL\s+|doi:\s*|Available at\s+|https?://)\S*(?:\s+[a-z0-9._\-/~%?=]+)*[.,]?\s*"
ARXIV = r"(?i)arxiv[:\s/]*(\d{4}\.\d{4,5})"
TITLE_STOP = (r"\b(In\s|Proceedings|Advances in|Conference|Workshop|Journal|Transactions|[Aa]rXiv|IEEE|ACM|preprint|URL\s|https?://|pp\.|vol\.|Vol\.|volume\s)")
LOWER_OK = ["and", "van", "von", "der", "de", "di", "del", "la", "le", "el", "et", "al", "dos", "da", "bin"]
SENTENCE_END = r"(?<!\b[A-Z])(?<!\bInc)(?<!\bLtd)(?<!\bJr)(?<!\bpp)(?<!\bvol)(?<!\beds)(?<!\bNo)[.?]\s+"
WORD = r"[A-Za-zÀ-ÿ'\-]+"
SURNAME_FIRST = r"^([A-ZÀ-Þ][A-Za-zÀ-ÿ'\-]{1,})\s*,"
SURNAME_LAST = r"^(?:[A-ZÀ-Þ][A-Za-zÀ-ÿ'\-]*\.?\s+){1,3}([A-ZÀ-Þ][A-Za-zÀ-ÿ'\-]{2,})\b"
MOST, FEWEST = 300, 3
LONGEST = 600


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def numbered_entries(text: Column) -> Column:
    """array<struct(number, raw)> of the entries that open with the next wanted [N]."""
    parts = F.split(F.regexp_replace(text, r"(?=\[\d{1,3}\])", T.MARK), T.MARK)

    def cut(p: Column) -> Column:
        number = F.transform(p, lambda x: F.try_to_number(F.regexp_extract(x, r"^\[(\d{1,3})\]", 1), F.lit("999")).cast("int"))
        # the fold: how many entries are open, and the parts that opened one
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("k"))
        fold = F.aggregate(number, start, lambda s, x: F.struct(
            F.when((x == s["n"] + 1) & (x <= MOST), s["n"] + 1).otherwise(s["n"]).alias("n"),
            F.when((x == s["n"] + 1) & (x <= MOST), F.array_append(s["at"], s["k"])).otherwise(s["at"]).alias("at"), (s["k"] + 1).alias("k")))
        return T.let(F.array_append(fold["at"], F.size(p)), lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda a, i: F.struct(
            (i + 1).alias("number"), F.array_join(F.slice(p, a + 1, F.get(at, i + 1) - a), "").alias("raw"))))

    return T.let(parts, cut)


def author_year_entries(text: Column) -> Column:
    """array<struct(number, raw)>: cut behind a year that ends an entry and is followed by a name."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), f"({ENTRY_END})", "$1" + T.MARK), T.MARK)
    return F.transform(parts, lambda x, i: F.struct((i + 1).alias("number"), x.alias("raw")))


def guessed_title(raw: Column) -> Column:
    """The first sentence that reads like a title and not like authors or a venue; empty if none does."""
    text = F.regexp_replace(raw, r"^.*?\(\d{4}[a-z]?\)\.?\s*(?=.)", "")

    def candidate(sentence: Column) -> Column:
        words = F.regexp_extract_all(sentence, F.lit(WORD), F.lit(0))
        low = F.size(F.filter(words, lambda w: w.rlike("^[a-zß-öø-ÿ]") & ~F.lower(w).isin(LOWER_OK)))
        authors = (F.size(words) == 0) | (low / F.size(words) < 0.25)
        stop = F.regexp_instr(sentence, F.lit(TITLE_STOP))
        title = F.when(stop > 0, F.substring(sentence, F.lit(1), stop - 1)).otherwise(sentence)
        strip = lambda c: F.regexp_replace(c, r"^[ .,;:]+|[ .,;:]+$", "")
        title = F.regexp_replace(strip(squeeze(title)), r"^(?:In|Technical [Rr]eport|Preprint)\s+", "")
        title = strip(F.regexp_replace(title, r",?\s*(?:19|20)\d\d[a-z]?$", ""))
        return F.when(~authors & ((stop == 0) | (stop > 15)), T.let(title, lambda t: F.when(F.size(F.split(t, r"\s+")).between(3, 30), t)))

    return F.coalesce(F.get(F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: candidate(F.trim(s))), lambda t: t.isNotNull() & (t != "")), F.lit(0)), F.lit(""))


def reference_list(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, number, raw, title, surname, year, arxiv) of every entry of at least five words; ``raw`` is cut to 600 characters."""
    clean = F.get(F.split(F.regexp_replace(F.col(text), LINE_NUMBER, ""), CHECKLIST, 2), F.lit(0))
    entries = T.let(clean, lambda t: T.let(numbered_entries(t), lambda e: F.when(F.size(e) >= FEWEST, e).otherwise(author_year_entries(t))))
    rows = docs.select("doc_id", F.explode(entries).alias("e")).select("doc_id", "e.number", "e.raw")
    raw = squeeze(F.regexp_replace("raw", r"^\s*\[\d{1,3}\]\s*", ""))
    raw = F.regexp_replace(F.regexp_replace(raw, r"-\s+(?=[a-z])", ""), LEADING_LINK, "")
    rows = rows.withColumn("raw", raw).where(F.size(F.filter(F.split("raw", " "), lambda w: w != "")) >= 5)
    found = lambda pattern: F.nullif(F.regexp_extract("raw", pattern, 1), F.lit(""))
    return rows.select(
        "doc_id", "number", F.substring("raw", 1, LONGEST).alias("raw"), guessed_title(F.col("raw")).alias("title"), F.coalesce(found(SURNAME_FIRST), found(SURNAME_LAST)).alias("surname"),
        found(r"\b((?:19|20)\d{2})[a-z]?\b").cast("int").alias("year"), found(ARXIV).alias("arxiv"))


def citation_markers(docs: DataFrame, text: str, ranges: bool = True) -> DataFrame:
    """(doc_id, numbers, n_markers, n_author_year): distinct cited numbers in ascending order, markers with numbers, markers with a year.

    ``[3-5]`` cites 3, 4 and 5; without ``ranges`` its two ends alone.
    """
    clean = F.regexp_replace(F.col(text), LINE_NUMBER, "")
    markers = F.regexp_extract_all("clean", F.lit(r"\[(\d{1,3}(?:\s*[,\-–]\s*\d{1,3})*)\]"), F.lit(1))

    def of_part(part: Column) -> Column:
        ends = F.transform(F.split(part, r"[\-–]"), lambda x: F.trim(x).cast("int"))
        low, high = F.array_min(ends), F.array_max(ends)
        return F.when(F.lit(ranges) & (F.size(ends) == 2) & (high <= MOST), F.sequence(low, high)).otherwise(ends)

    numbers = F.flatten(F.transform("m", lambda m: F.flatten(F.transform(F.split(m, ","), of_part))))
    kept = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.between(1, MOST))))
    named = F.regexp_count("clean", F.lit(r"\([^()]{0,80}?\b(?:19|20)\d\d[a-z]?\)"))
    return docs.select("doc_id", F.coalesce(clean, F.lit("")).alias("clean")).withColumn("m", markers).select("doc_id", kept.alias("numbers"), F.size("m").alias("n_markers"), named.alias("n_author_year"))
