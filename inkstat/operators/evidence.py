"""Evidence gap: displayed instances of a document that aggregates results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstat.functions import patterns as P
from inkstat.functions import text as T
from inkstat.operators import structure as S
from inkstat.operators.views import rows_within

ENVIRONMENT = S.compiled(r"\\begin\{(?i:" + "|".join(P.EXHIBIT_ENVS) + r")\}")
CAPTION, QUOTE, RELATED = S.compiled(P.EXHIBIT_CAPTION), S.compiled(P.EXHIBIT_QUOTE), S.compiled(r"(?i)\\section\*?\{[^}]*related[^}]*\}")


def applicable_documents(parsed_cells: DataFrame, min_rows: int = 2, min_numbers: int = 4) -> DataFrame:
    """Documents with a table of at least two body rows and four numeric cells (by default)."""
    per = parsed_cells.where(~F.col("is_header")).groupBy("doc_id", "tbl").agg(
        F.count_distinct("r").alias("rows"), F.count_if(F.col("cell.kind") == "number").alias("numbers"))
    return per.where((F.col("rows") >= min_rows) & (F.col("numbers") >= min_numbers)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_result_tables"))


def exhibits(docs: DataFrame, tex: str = "tex") -> DataFrame:
    """(doc_id, kind, pos): display environments, announcing captions, long quotes outside Related Work.

    The related-work span runs from its heading to the next section heading of the same row, so
    the exclusion needs no join.
    """

    def each(text: str | None) -> Iterator[tuple]:
        text = (text or "").replace(T.MARK, " ")
        for kind, pattern in (("env", ENVIRONMENT), ("caption", CAPTION)):
            for shown in pattern.finditer(text):
                yield kind, shown.start()
        quotes = [m.start() for m in QUOTE.finditer(text)]
        related = RELATED.search(text) if quotes else None
        start = related.start() if related else len(text)
        behind = text.find("\\section", start + 9)
        for at in quotes:
            if at < start or 0 <= behind <= at:
                yield "quote", at

    return rows_within(docs, [tex], "kind string, pos int", each)


def titled_without_exhibit(docs: DataFrame, shown: DataFrame, tex: str = "tex") -> DataFrame:
    """Sections named for cases whose span holds no exhibit: interval anti-join on the document."""
    head = r"\\(?:sub){0,2}section\*?\{[^{}]*\}"
    secs = docs.select("doc_id", F.explode(S.find_all(F.col(tex), head)).alias("m")).where(F.col("m.match").rlike(P.EXHIBIT_TITLE)).select(
        "doc_id", F.col("m.start").alias("a"), (F.col("m.start") + F.length("m.match") + F.length("m.rest")).alias("b"), F.col("m.match").alias("heading"),
        F.size(F.filter(F.split("m.rest", r"\s+"), lambda x: x != "")).alias("words"), F.size(F.regexp_extract_all("m.rest", F.lit(P.PERCENT), F.lit(0))).alias("percent_tokens"))
    e = shown.select(F.col("doc_id").alias("e_doc"), "pos")
    return secs.join(e, (F.col("doc_id") == F.col("e_doc")) & (F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b")), "left_anti")


def gap_scores(docs: DataFrame, applicable: DataFrame, shown: DataFrame, appendix: DataFrame, words: Column) -> DataFrame:
    """1 when an applicable document displays nothing, else 0; null when not applicable."""
    base = docs.select("doc_id", words.alias("words")).join(applicable, "doc_id", "left").join(appendix.select("doc_id", "appendix_start"), "doc_id", "left")
    placed = shown.join(appendix.select("doc_id", "appendix_start"), "doc_id", "left")
    agg = placed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_exhibits"), F.count_if(F.col("kind") == "env").alias("n_env"), F.count_if(F.col("kind") == "caption").alias("n_caption"),
        F.count_if(F.col("kind") == "quote").alias("n_quote"), F.every(F.coalesce(F.col("pos") >= F.col("appendix_start"), F.lit(False))).alias("appendix_only"))
    j = base.join(agg, "doc_id", "left").na.fill(0, ["n_exhibits", "n_env", "n_caption", "n_quote"])
    ok = F.col("n_result_tables").isNotNull()
    return j.select(
        "doc_id", ok.alias("applicable"), "n_exhibits", "n_env", "n_caption", "n_quote", F.coalesce("appendix_only", F.lit(False)).alias("appendix_only"),
        F.when(ok, F.when(F.col("n_exhibits") > 0, 0.0).otherwise(1.0)).alias("score"),
        F.when(ok, F.col("n_exhibits") / F.greatest(F.lit(1), F.col("words")) * 10000).alias("exhibits_per10k"))


def acknowledge(scores: DataFrame, admission: str) -> DataFrame:
    """A full gap (1.0) counts half when the text admits it."""
    return scores.withColumn("score", F.when((F.col("score") == 1.0) & F.col("text").rlike(admission), 0.5).otherwise(F.col("score")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def prose_words(tex: Column) -> Column:
    return word_count(T.prose_view(tex))
