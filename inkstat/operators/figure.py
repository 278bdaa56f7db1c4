"""Figure transcripts: expository kinds, scores and broken enumerations. Input: fig_id, ord, line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstat.functions import patterns as P

GLOSS_TOP, GLOSS_MIN, MIN_STAGES = 3, 60, 2


def body_lines(lines: DataFrame) -> DataFrame:
    """Lines without running heads, renumbered from zero inside the figure."""
    kept = lines.where(~F.col("line").rlike(P.FIGURE_HEADER))
    return kept.withColumn("top", F.row_number().over(Window.partitionBy("fig_id").orderBy("ord")) - 1)


def figure_kinds(lines: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row per figure with a flag per expository kind and the score over all six.

    A stage label counts from two on; a one-sentence gloss under the title counts as thesis box;
    experimental content comes from the hand-verdict table.
    """
    x = F.col("line")
    gloss = (F.col("top") < GLOSS_TOP) & (F.length(x) >= GLOSS_MIN) & x.rlike(r"[.!?]\s*$") & ~x.contains("?") & x.rlike(P.FIGURE_GLOSS)
    hits = {k: F.count_if(x.rlike(p)) for k, p in P.FIGURE_KINDS.items()}
    hits["thesis_box"] = F.count_if(x.rlike(P.FIGURE_KINDS["thesis_box"]) | gloss)
    agg = body_lines(lines).groupBy("fig_id").agg(F.count(F.lit(1)).alias("n_lines"), *[c.alias(f"n_{k}") for k, c in hits.items()])
    if verdicts is not None:
        agg = agg.join(verdicts.select("fig_id", F.lit(True).alias("_v")), "fig_id", "left")
    flag = {k: F.col(f"n_{k}") >= (MIN_STAGES if k == "enumerated_stage" else 1) for k in P.FIGURE_KINDS}
    flag["experimental_content"] = F.coalesce(F.col("_v"), F.lit(False)) if verdicts is not None else F.lit(False)
    total = sum((flag[k].cast("int") for k in P.FIGURE_ORDER), F.lit(0))
    pattern_only = sum((flag[k].cast("int") for k in P.FIGURE_ORDER if k != "experimental_content"), F.lit(0))
    return agg.select("fig_id", "n_lines", *[flag[k].alias(k) for k in P.FIGURE_ORDER], (total / 6.0).alias("score"), (pattern_only / 5.0).alias("score_pattern_only"))


def latest_transcripts(transcripts: DataFrame) -> DataFrame:
    """Of several transcripts of a figure the latest (by ``version``) wins."""
    return transcripts.groupBy("fig_id").agg(F.max_by("lines", "version").alias("lines"))


def _ordinal(token: Column) -> Column:
    roman = F.lit(None).cast("int")
    for name, value in P.ROMAN.items():
        roman = F.when(F.lower(token) == name, value).otherwise(roman)
    return F.when(token.rlike(r"^\d+$"), token.cast("int")).otherwise(roman)


def enumeration_gaps(lines: DataFrame) -> DataFrame:
    """Numbered label words of a figure: three or more ordinals that skip one inside their range."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("line", F.lit(P.ENUM_LABEL), F.lit(1)).alias("w"), F.regexp_extract_all("line", F.lit(P.ENUM_LABEL), F.lit(2)).alias("n"))
    seen = lines.select("fig_id", F.explode(pairs).alias("p")).select("fig_id", F.lower("p.w").alias("word"), _ordinal(F.col("p.n")).alias("n")).where(F.col("n") > 0).distinct()
    s = seen.groupBy("fig_id", "word").agg(F.count(F.lit(1)).alias("labels"), F.min("n").alias("lo"), F.max("n").alias("hi")).where(F.col("labels") >= 3)
    return s.withColumn("gap", F.col("hi") - F.col("lo") + 1 > F.col("labels"))
