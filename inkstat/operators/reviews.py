"""Review-corpus preparation: normalization, aggregates, quality flags and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstat.operators import ranks, resample, stats


def first_int(text: Column) -> Column:
    """First integer in a free-text field ("8: accept" -> 8)."""
    return F.nullif(F.regexp_extract(text, r"-?\d+", 0), F.lit("")).cast("int")


def normalize_reviews(reviews: DataFrame) -> DataFrame:
    """overall, soundness, confidence whatever the year called them."""
    return reviews.select(
        "paper_id", "review_id", first_int(F.coalesce("rating", "recommendation")).alias("overall"),
        first_int(F.coalesce("soundness", "correctness", "novelty")).alias("soundness"), first_int(F.col("confidence")).alias("confidence"))


def tier_of(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for tier in ("poster", "notable", "spotlight", "oral"):
        out = F.when(F.lower(text).contains(tier), tier).otherwise(out)
    return out


def resolve_decision(decision: Column, venue: Column) -> Column:
    """struct(accept, tier, venue): the decision reply, else the venue string."""
    d, v = F.lower(decision), F.lower(venue)
    has = F.coalesce(decision, F.lit("")) != ""
    by_reply = d.startswith("accept") | (d.contains("accept") & ~d.contains("reject"))
    by_venue = (
        F.when(F.coalesce(v, F.lit("")) == "", None).when(v.startswith("submitted") | v.contains("reject"), False)
        .when(v.startswith("iclr") | tier_of(venue).isNotNull(), True))
    return F.struct(F.when(has, by_reply).otherwise(by_venue).alias("accept"), tier_of(F.when(has, decision).otherwise(venue)).alias("tier"), F.when(has, decision).otherwise(venue).alias("venue"))


def review_aggregates(reviews: DataFrame, dims: Sequence[str], klass: str) -> DataFrame:
    """Per paper: count, mean/min/max rating, dimension means, mean class, shares of class >= 1 and = 4."""
    return reviews.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.avg("rating").alias("rating_mean"), F.min("rating").alias("rating_min"), F.max("rating").alias("rating_max"),
        *[F.avg(d).alias(f"{d}_mean") for d in dims], F.avg(klass).alias("class_mean"),
        F.avg((F.col(klass) >= 1).cast("int")).alias("share_any"), F.avg((F.col(klass) == 4).cast("int")).alias("share_top"))


def join_decisions(papers: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted list as a left join: accept flag and tier (reject when absent)."""
    return papers.join(accepted.select("paper_id", "tier", F.lit(True).alias("accept")), "paper_id", "left").withColumns(
        {"accept": F.coalesce("accept", F.lit(False)), "tier": F.coalesce("tier", F.lit("reject"))})


def decision_group(accept: Column, tier: Column) -> tuple[Column, Column]:
    """(five-way group, four-way fold): undecided, reject, poster, spotlight (or notable), oral."""
    five = F.when(accept.isNull(), "undecided").when(~accept, "reject").when(tier == "oral", "oral").when(tier.isin("spotlight", "notable"), "spotlight").otherwise("poster")
    four = F.when(five.isin("poster", "spotlight"), "accept").otherwise(five)
    return five, four


def score_stratum(rating: Column) -> Column:
    """Half-even integer score clamped to 1..10."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.bround(rating, 0).cast("int")))


def quota_sample(pool: DataFrame, stratum: str, key: str, per: int, have: DataFrame | None = None) -> DataFrame:
    """First rows of every stratum in key order until ``per`` are held, counting what is already there."""
    w = Window.partitionBy(stratum).orderBy(key)
    top = pool.withColumn("position", F.row_number().over(w)).where(F.col("position") <= per)
    if have is None:
        return top
    counts = have.groupBy(stratum).agg(F.count(F.lit(1)).alias("_have"))
    return top.join(counts, stratum, "left").where(F.col("position") <= per - F.coalesce("_have", F.lit(0))).drop("_have")


def fraction_band(fraction: Column) -> Column:
    """0 for exactly zero, then left-open bands up to 0.05, 0.25, 0.5, 0.639 and above."""
    out = F.lit(5)
    for i, hi in ((4, 0.639), (3, 0.50), (2, 0.25), (1, 0.05)):
        out = F.when(fraction <= hi, i).otherwise(out)
    return F.when(fraction.isNull(), None).when(fraction == 0, 0).otherwise(out)


def band_class_sample(papers: DataFrame, per_band: int) -> DataFrame:
    """Half the band quota per decision class, papers with a known id first."""
    w = Window.partitionBy("band", "accept").orderBy(F.col("known_id").isNull(), "paper_id")
    rows = papers.withColumn("band", fraction_band(F.col("fraction_ai"))).where(F.col("band").isNotNull())
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= max(1, per_band // 2))


def bin_sample(papers: DataFrame, per: int, min_bin: int = 12, seed: int = 0) -> DataFrame:
    """``per`` hash-drawn papers per half-point rating bin that holds at least ``min_bin``."""
    binned = papers.withColumn("bin", stats.half_point(F.col("rating")))
    sizes = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_bin)
    return resample.hash_sample(binned.join(sizes.select("bin"), "bin"), ["bin"], "paper_id", F.lit(per), seed)


def top_up(pool: DataFrame, done: DataFrame, cell: Sequence[str], key: str, target: int, seed: int = 0) -> DataFrame:
    """Hash-drawn rows that lift every cell to ``target``, finished ones excluded and counted."""
    have = done.groupBy(*cell).agg(F.count(F.lit(1)).alias("_have"))
    rest = pool.join(done.select(key), key, "left_anti").join(have, list(cell), "left")
    need = F.greatest(F.lit(0), target - F.coalesce("_have", F.lit(0)))
    return resample.hash_sample(rest.withColumn("_need", need), cell, key, F.col("_need"), seed).drop("_have", "_need")


def round_robin(rows: DataFrame, bucket: str, key: str, n: int, forced: DataFrame, seed: int = 0) -> DataFrame:
    """``n`` rows in all: the forced ones, then one per bucket in turn, hash order inside a bucket."""
    rest = rows.join(forced.select(key), key, "left_anti").withColumn("_h", F.struct(resample.hash_int(F.col(key), F.lit(seed)).alias("h"), F.col(key).alias("k")))
    turn = rest.withColumn("_turn", F.row_number().over(Window.partitionBy(bucket).orderBy("_h"))).where(F.col("_turn") <= n)
    left = n - forced.select(key).distinct().count()
    picked = turn.orderBy("_turn", bucket).limit(max(0, left)).select(key, bucket)
    return rows.join(forced.select(key), key, "left_semi").select(key, bucket).unionByName(picked)


def replacement_quota(retired: DataFrame, replaced: DataFrame, cell: Sequence[str]) -> DataFrame:
    """How many like-for-like replacements each cell still needs."""
    need = retired.groupBy(*cell).agg(F.count(F.lit(1)).alias("retired"))
    got = replaced.groupBy(*cell).agg(F.count(F.lit(1)).alias("replaced"))
    return need.join(got, list(cell), "full").na.fill(0, ["retired", "replaced"]).withColumn("need", F.greatest(F.lit(0), F.col("retired") - F.col("replaced")))


def quality_flags(papers: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(flag -> count, excluded ids with their flags)."""
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    flagged = papers.select("paper_id", flags.alias("flags"))
    counts = flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    return counts, flagged.where(F.size("flags") > 0)


def length_trim(papers: DataFrame, words: str = "n_words", min_reviews: int = 3) -> DataFrame:
    """Keep papers inside the 1st-99th percentile of length with enough reviews."""
    q = ranks.quantiles(papers, [], words, {"_lo": 0.01, "_hi": 0.99}).drop("n").withColumn("_one", F.lit(1))
    return papers.withColumn("_one", F.lit(1)).join(F.broadcast(q), "_one").where(F.col(words).between(F.col("_lo"), F.col("_hi")) & (F.col("n_reviews") >= min_reviews)).drop("_one", "_lo", "_hi")


def strata_keys(papers: DataFrame, domain: Column) -> DataFrame:
    """Folded domain, year x domain stratum and rating band."""
    r = F.bround("rating", 0).cast("int")
    band = F.when(r <= 3, "<=3").when(r >= 8, ">=8").otherwise(r.cast("string"))
    return papers.withColumn("domain_fold", domain).withColumn("stratum", F.concat_ws("/", F.col("year").cast("string"), "domain_fold")).withColumn("band", band)


def authorship_report(papers: DataFrame) -> DataFrame:
    """Per authorship band: papers, share, accept rate, mean rating, accept gap at the paper level."""
    total = papers.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    b = papers.groupBy(fraction_band(F.col("fraction_ai")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("accept").cast("int")).alias("accept_rate"), F.avg("rating").alias("mean_rating"), F.stddev_samp("rating").alias("sd_rating"))
    return b.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("band", "n", (F.col("n") / F.col("_n")).alias("share"), "accept_rate", "mean_rating", "sd_rating")


def accept_gap_at_rating(papers: DataFrame, min_side: int = 20) -> DataFrame:
    """Accept rate of papers at fraction zero against the rest, inside every half-point rating."""
    lv = stats.half_point(F.col("rating"))
    zero = F.col("fraction_ai") == 0
    acc = F.col("accept").cast("int")
    return papers.groupBy(lv.alias("level")).agg(
        F.count_if(zero).alias("n_zero"), F.count_if(~zero).alias("n_rest"), (F.avg(F.when(zero, acc)) - F.avg(F.when(~zero, acc))).alias("gap"),
    ).where((F.col("n_zero") >= min_side) & (F.col("n_rest") >= min_side))


def assemble_scores(files: Sequence[DataFrame]) -> DataFrame:
    """Union of score files (paper_id, system, value); a later file overrides an earlier one."""
    out = None
    for priority, f in enumerate(files):
        part = f.select("paper_id", "system", "value", F.lit(priority).alias("priority"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("value").isNotNull()).groupBy("paper_id", "system").agg(F.max_by("value", "priority").alias("value"))
