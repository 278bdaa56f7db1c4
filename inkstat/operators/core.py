"""Score aggregation shared by all measures, and token-level score reductions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null on a zero denominator, never 0."""
    return F.when(denominator > 0, numerator / denominator)


def weak(denominator: Column, min_units: int = 3) -> Column:
    return F.coalesce(denominator, F.lit(0)) < min_units


def plane_aggregate(scores: DataFrame, item: Sequence[str], strict_items: int | None = None) -> DataFrame:
    """Mean of plane means per item over (item, plane, measure, value); missing values are skipped.

    With ``strict_items`` the aggregate is null unless that many measures are present.
    """
    planes = scores.where(F.col("value").isNotNull()).groupBy(*item, "plane").agg(F.avg("value").alias("p"), F.count(F.lit(1)).alias("c"))
    out = planes.groupBy(*item).agg(F.avg("p").alias("aggregate"), F.sum("c").alias("n_measures"), F.count(F.lit(1)).alias("n_planes"))
    if strict_items is not None:
        out = out.withColumn("aggregate", F.when(F.col("n_measures") == strict_items, F.col("aggregate")))
    return out


def mean_skip(*cols: Column) -> Column:
    """Mean of the non-null columns; null if all are."""
    present = F.array_compact(F.array(*cols))
    return F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(present), F.lit(0))


def named_aggregates(macro: Column, xsec: Column, argument: Column, citation: Column, evidence: Column) -> dict[str, Column]:
    """agg3 (structure and citation, both required), agg4 (with the evidence gap where it applies),
    det4 and the five-measure mean over planes; the structure plane skips a missing side."""
    structure = mean_skip(macro, xsec)
    both = structure.isNotNull() & citation.isNotNull()
    return {
        "agg3": F.when(both, mean_skip(structure, citation)),
        "agg4": F.when(both, mean_skip(structure, citation, evidence)),
        "det4": mean_skip(structure, citation, evidence),
        "mean5": mean_skip(structure, mean_skip(argument, citation), evidence),
    }


def document_label(statuses: DataFrame, doc: str = "doc_id", status: str = "status") -> DataFrame:
    """Four-state document label from instance statuses."""
    n = lambda s: F.count_if(F.col(status) == s)
    c = statuses.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), n("violation").alias("v"), n("consistent").alias("c"), n("inconclusive").alias("i"), n("not_applicable").alias("na"))
    return c.select(doc, "n", (
        F.when(F.col("na") == F.col("n"), "NA").when(F.col("v") > 0, "positive").when((F.col("c") > 0) & (F.col("i") == 0), "negative")
        .when((F.col("c") > 0) & (F.col("i") > 0), "negative_incomplete").otherwise("inconclusive")).alias("label"))


def evidence_instances(rows: DataFrame, doc: str, kind: str, order: str) -> DataFrame:
    """Number the instances of a document per kind from one and give them padded ids."""
    k = F.row_number().over(Window.partitionBy(doc, kind).orderBy(order))
    return rows.withColumn("instance_id", F.format_string("%s:%s:%04d", F.col(doc).cast("string"), F.col(kind), k))


def count_bands(scores: DataFrame, count: str, value: str, bands: Sequence[tuple[int, int]], by: Sequence[str] = ()) -> DataFrame:
    """describe-style aggregates of a score by right-open bands of its unit count."""
    band = F.lit(None).cast("string")
    for lo, hi in bands:
        band = F.when((F.col(count) >= lo) & (F.col(count) < hi), F.lit(f"{lo}_{hi}")).otherwise(band)
    return scores.where(F.col(value).isNotNull()).groupBy(*by, band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


# --------------------------------------------------------------------------- token score reductions


def window_plan(docs: DataFrame, length: str, k: int, width: int, minimum: int = 64) -> DataFrame:
    """Start offsets of up to k evenly spaced windows; documents under ``minimum`` tokens are skipped."""
    t = F.col(length)
    n = F.greatest(F.lit(1), F.least(F.lit(k), F.floor(t / width)))
    planned = docs.where(t >= minimum).withColumn("_n", n.cast("int")).withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.floor(F.col("window") * F.greatest(t - width, F.lit(0)) / F.greatest(F.lit(1), F.col("_n") - 1))
    return planned.withColumn("start", start.cast("bigint")).drop("_n")


def cross_perplexity(tokens: DataFrame) -> DataFrame:
    """Mean over windows of mean(-logp) / mean(cross entropy)."""
    per = tokens.groupBy("doc_id", "window").agg((F.avg(-F.col("logp")) / F.avg("xent")).alias("r"))
    return per.groupBy("doc_id").agg(F.avg("r").alias("score"), F.count(F.lit(1)).alias("n_windows"))


def perturbation_z(rows: DataFrame, minimum: int = 5) -> DataFrame:
    """(logp - mean perturbed) / max(population sd, 1e-6), mean over windows with enough perturbations."""
    per = rows.groupBy("doc_id", "window").agg(
        F.max(F.when(F.col("perturbation") == 0, F.col("logp"))).alias("o"), F.count_if(F.col("perturbation") > 0).alias("n"),
        F.avg(F.when(F.col("perturbation") > 0, F.col("logp"))).alias("m"), F.stddev_pop(F.when(F.col("perturbation") > 0, F.col("logp"))).alias("s"))
    ok = per.where((F.col("n") >= minimum) & F.col("o").isNotNull())
    return ok.groupBy("doc_id").agg(F.avg((F.col("o") - F.col("m")) / F.greatest("s", F.lit(1e-6))).alias("score"), F.count(F.lit(1)).alias("n_windows"))


def sampling_discrepancy(tokens: DataFrame) -> DataFrame:
    """(sum ll - sum mean) / sqrt(sum var)."""
    return tokens.groupBy("doc_id").agg(((F.sum("ll") - F.sum("mean_ref")) / F.sqrt(F.sum("var_ref"))).alias("score"))


def temperature_sensitivity(tokens: DataFrame) -> DataFrame:
    """(|mean logp at T1 - mean logp at T2| - expectation) / sd, from per-token columns."""
    return tokens.groupBy("doc_id").agg(
        ((F.abs(F.avg("logp_t1") - F.avg("logp_t2")) - F.avg("expected")) / F.nullif(F.sqrt(F.avg("variance")), F.lit(0.0))).alias("score"))


def pmi_edges(conditional: DataFrame, marginal: DataFrame) -> DataFrame:
    """mean logp(dst given src) - mean logp(dst), the first token skipped, rounded to five places."""
    c = conditional.where("pos > 0").groupBy("doc_id", "src", "dst").agg(F.avg("logp").alias("c"))
    m = marginal.where("pos > 0").groupBy("doc_id", "dst").agg(F.avg("logp").alias("m"))
    return c.where("src <> dst").join(m, ["doc_id", "dst"]).select("doc_id", "src", "dst", F.round(F.col("c") - F.col("m"), 5).alias("weight"))


def ensemble_mean(reviews: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """Numeric review fields replaced by half-even rounded ensemble means."""
    return reviews.groupBy(by).agg(F.count(F.lit(1)).alias("n_reviews"), *[F.bround(F.avg(f), 0).cast("bigint").alias(f) for f in fields])
