"""Registered queries of the statistics operators (F)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from inkstat.operators import pair_eval, resample, stats
from inkstat.plans.inputs import RECORD_LONG, RECORDS, auroc_sql, record_scores, records
from inkstat.plans.registry import query

SYS = ["system"]
R = f"WITH {RECORD_LONG} "


def rank_sql(col: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {col}) + (count(*) OVER (PARTITION BY {by}, {col}) - 1) / 2.0::DOUBLE)"


def rho_sql(source: str, by: str, x: str, y: str) -> str:
    return f"""SELECT {by}, count(*) AS n, corr(rx, ry) AS rho FROM (
      SELECT {by}, {rank_sql(x, by)} AS rx, {rank_sql(y, by)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {by}"""


def labelled(t):
    """Rejected papers are label 1."""
    return record_scores(t).withColumn("label", (~F.col("accept")).cast("int"))


LAB = R + ", lab AS (SELECT *, CASE WHEN accept THEN 0 ELSE 1 END AS label FROM rl) "


@query("f1_describe", R + """SELECT system, count(*) AS n, avg(value) AS mean, median(value) AS median, min(value) AS min, max(value) AS max
  FROM rl GROUP BY system""", "mean median min max")
def f1(t):
    return stats.describe(record_scores(t), SYS, "value")


TWO = f"""SELECT a.*, 2 * auroc - 1 AS cliff, auroc * n_pos * n_neg AS u,
    sign(auroc - 0.5) * greatest(abs((auroc - 0.5) * n_pos * n_neg) - 0.5, 0)
      / sqrt(n_pos::DOUBLE * n_neg / 12 * ((n_pos + n_neg + 1) - ties / ((n_pos + n_neg)::DOUBLE * (n_pos + n_neg - 1)))) AS z
  FROM ({auroc_sql('lab', 'system')}) a JOIN (
    SELECT system, sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT system, value, count(*) AS c FROM lab GROUP BY 1, 2) GROUP BY 1) USING (system)""".replace("ORDER BY s)", "ORDER BY value)").replace("system, s)", "system, value)").replace("WHERE s IS", "WHERE value IS")


@query("f2_cliffs_delta", LAB + f"SELECT system, cliff FROM ({TWO})", "cliff")
def f2(t):
    return stats.two_sample(labelled(t), SYS, "value").select("system", "cliff")


@query("f3_mann_whitney_z", LAB + f"SELECT system, n_pos, n_neg, u, z FROM ({TWO})", "u z")
def f3(t):
    return stats.two_sample(labelled(t), SYS, "value").select("system", "n_pos", "n_neg", "u", "z")


@query("f3_mann_whitney_p")
def f3p(t):
    return stats.mann_whitney(labelled(t), SYS, "value").select("system", "z", "mwu_p")


@query("f4_compare_groups", LAB + f"""SELECT q.system, n_pos, n_neg, auroc, cliff, z, 1 - auroc AS auroc_neg_over_pos, d.* EXCLUDE (system)
  FROM ({TWO}) q JOIN (SELECT system, {', '.join(f"{f}(value) FILTER (label = {k}) AS {s}_{n}" for k, s in ((1, 'pos'), (0, 'neg')) for f, n in (('avg', 'mean'), ('median', 'median'), ('min', 'min'), ('max', 'max')))}
    FROM lab GROUP BY system) d USING (system)""", "auroc cliff z auroc_neg_over_pos pos_mean pos_median pos_min pos_max neg_mean neg_median neg_min neg_max")
def f4(t):
    return stats.compare_groups(labelled(t), SYS, "value").drop("u")


@query("f5_confound_audit", LAB + f"""SELECT system, auroc, auroc > 0.7 AS flagged, pos_median, neg_median FROM ({TWO})
  JOIN (SELECT system, median(value) FILTER (label = 1) AS pos_median, median(value) FILTER (label = 0) AS neg_median FROM lab GROUP BY 1) USING (system)""",
       "auroc pos_median neg_median")
def f5(t):
    return stats.confound_audit(labelled(t), SYS, "value")


@query("f6_spearman", R + rho_sql("rl", "system", "value", "rating") + " HAVING count(*) >= 10", "rho")
def f6(t):
    return stats.spearman(record_scores(t), SYS, "value", "rating", min_n=10, min_distinct=3)


@query("f7_spearman_ordinal", R + """SELECT system, count(*) AS n, corr(rx, ry) AS rho FROM (
    SELECT system, row_number() OVER (PARTITION BY system ORDER BY value, paper_id) AS rx,
      row_number() OVER (PARTITION BY system ORDER BY rating, paper_id) AS ry FROM rl) GROUP BY system HAVING count(*) >= 4""", "rho")
def f7(t):
    return stats.spearman_ordinal(record_scores(t), SYS, "value", "rating", "paper_id")


PARTIAL = f"""SELECT system, count(*) AS n, (corr(rx, ry) - corr(rx, rz) * corr(ry, rz)) / sqrt((1 - corr(rx, rz) ** 2) * (1 - corr(ry, rz) ** 2)) AS rho
  FROM (SELECT system, {rank_sql('value', 'system')} AS rx, {rank_sql('rating', 'system')} AS ry, {rank_sql('n_words', 'system')} AS rz FROM rl) GROUP BY system"""


@query("f8_partial_spearman", R + PARTIAL, "rho")
def f8(t):
    return stats.partial_spearman(record_scores(t), SYS, "value", "rating", "n_words")


@query("f9_partial_spearman_strata", R + f"""SELECT system, count(*) AS n, corr(rx - mx, ry - my) AS rho FROM (
    SELECT *, avg(rx) OVER (PARTITION BY system, domain) AS mx, avg(ry) OVER (PARTITION BY system, domain) AS my FROM (
      SELECT system, domain, {rank_sql('value', 'system')} AS rx, {rank_sql('rating', 'system')} AS ry FROM rl)) GROUP BY system""", "rho")
def f9(t):
    return stats.partial_spearman_strata(record_scores(t), SYS, "value", "rating", "domain")


@query("f10_within_stratum", R + f"""SELECT system, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n, sum(n * rho) / sum(n) AS pooled_rho, avg(rho) AS mean_rho,
    count(*) FILTER (rho < 0) AS n_negative FROM ({rho_sql('rl', 'system, year', 'value', 'rating')}) WHERE n >= 25 GROUP BY system""", "pooled_rho mean_rho")
def f10(t):
    return stats.within_stratum(record_scores(t), SYS, "value", "rating", "year")


# --- resampling: statistics of sums at 2,000 replicates and AUROC at 1,000 over all systems; Spearman at 20 over one, which
# keeps the replicate x row table of both sides small

REPS = 20
BOOT = 2000
AUROC_REPS = 1000
POISSON = "(" + " + ".join(f"(u >= {int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))})::BIGINT" for k in range(12)) + ")"


def counted_sql(source: str, columns: str, key: str = "paper_id", replicates: int = BOOT) -> str:
    """How often a row counts in each replicate: two halves of its md5, mixed in 32 bits, through the steps of Poisson(1)."""
    cut = "& 4294967295::UBIGINT"
    mixed = "xor({0}, {0} >> 16) * 2146121005::UBIGINT " + cut + " AS {0}1, xor({0}1, {0}1 >> 15) * 2221713035::UBIGINT " + cut + " AS {0}2, xor({0}2, {0}2 >> 16)"
    return f"""bh AS (SELECT *, md5({key} || ':0') AS h FROM {source}), bk AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS hi, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS lo FROM bh),
  bd AS (SELECT {columns}, rep, (hi + rep::UBIGINT * 2654435769::UBIGINT) {cut} AS a, {mixed.format('a')} AS a3, xor(a3, lo) AS b, {mixed.format('b')} AS u, {POISSON} AS k FROM bk, (SELECT unnest(range(1, {replicates + 1})) AS rep))"""


H = "CAST('0x' || substr(md5(rep || ':' || rn || ':0'), 1, 8) AS BIGINT)"


def draws_sql(source: str, by: str, key: str = "paper_id") -> str:
    return f"""nm AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {key}) AS rn, count(*) OVER (PARTITION BY {by}) AS n0 FROM {source}),
  dr AS (SELECT {by}, rep, {H} % n0 + 1 AS rn FROM nm, (SELECT unnest(range(1, {REPS + 1})) AS rep)),
  sm AS (SELECT nm.*, rep FROM dr JOIN nm USING ({by}, rn))"""


CI = "count(m) AS replicates, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high"
AGG = ", ag AS (SELECT * FROM rl WHERE system = 'agg')"


def agg_only(t):
    return labelled(t).where(F.col("system") == "agg")


@query("f11_bootstrap_mean", R + ", " + counted_sql("rl", "system, year, value") + f""" SELECT system, year, n, mean, replicates, ci_low, ci_high
  FROM (SELECT system, year, count(*) AS n, avg(value) AS mean FROM rl GROUP BY 1, 2) JOIN
  (SELECT system, year, {CI} FROM (SELECT system, year, rep, sum(value * k) / nullif(sum(k), 0)::DOUBLE AS m FROM bd GROUP BY ALL) GROUP BY ALL) USING (system, year)""", "mean ci_low ci_high")
def f11(t):
    return resample.bootstrap_mean(record_scores(t), ["system", "year"], "paper_id", "value", BOOT)


@query("f12_bootstrap_auroc", LAB + ", " + counted_sql("lab", "system, year, label, value", replicates=AUROC_REPS) + f""",
  bc AS (SELECT system, year, rep, value, sum(k * label)::DOUBLE AS p, sum(k * (1 - label))::DOUBLE AS n FROM bd GROUP BY ALL),
  bb AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY system, year, rep ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM bc),
  b AS (SELECT system, year, rep, sum(p * (f + 0.5::DOUBLE * n)) / nullif(sum(p) * sum(n), 0) AS a FROM bb GROUP BY ALL), c AS (SELECT system, year, list_sort(list(a)) AS l FROM b WHERE a IS NOT NULL GROUP BY ALL)
  SELECT system, year, n_pos, n_neg, auroc, l[len(l) * 25 // 1000 + 1] AS ci_low, l[greatest(len(l) * 975 // 1000, 1)] AS ci_high FROM ({auroc_sql('lab', 'system, year', 'value')}) JOIN c USING (system, year)""",
       "auroc ci_low ci_high")
def f12(t):
    return resample.bootstrap_auroc(labelled(t), ["system", "year"], "paper_id", "value", AUROC_REPS)


@query("f13_bootstrap_spearman", R + AGG + ", " + draws_sql("ag", "year") + f""" SELECT p.*, replicates, ci_low, ci_high
  FROM ({rho_sql('ag', 'year', 'value', 'rating')}) p JOIN (SELECT year, {CI} FROM (
    SELECT year, rho AS m FROM ({rho_sql('sm', 'year, rep', 'value', 'rating')})) GROUP BY year) USING (year)""", "rho ci_low ci_high")
def f13(t):
    return resample.bootstrap_spearman(agg_only(t), ["year"], "paper_id", "value", "rating", REPS)


@query("f14_weighted_mean_ci", R + ", " + counted_sql("rl", "system, year, value, n_words") + f""" SELECT system, year, n, mean, replicates, ci_low, ci_high
  FROM (SELECT system, year, count(*) AS n, sum(value * n_words) / sum(n_words) AS mean FROM rl GROUP BY 1, 2) JOIN
  (SELECT system, year, {CI} FROM (SELECT system, year, rep, sum(value * n_words * k) / nullif(sum(n_words * k), 0)::DOUBLE AS m FROM bd GROUP BY ALL) GROUP BY ALL) USING (system, year)""", "mean ci_low ci_high")
def f14(t):
    return resample.bootstrap_mean(record_scores(t), ["system", "year"], "paper_id", "value", BOOT, weight="n_words")


@query("f15_paired_difference_ci", f"WITH {RECORDS}, ag AS (SELECT paper_id, domain, agg - xsec AS value FROM rec WHERE xsec IS NOT NULL), " + counted_sql("ag", "domain, value") + f"""
  SELECT domain, n, mean, replicates, ci_low, ci_high FROM (SELECT domain, count(*) AS n, avg(value) AS mean FROM ag GROUP BY 1) JOIN
  (SELECT domain, {CI} FROM (SELECT domain, rep, sum(value * k) / nullif(sum(k), 0)::DOUBLE AS m FROM bd GROUP BY ALL) GROUP BY ALL) USING (domain)""", "mean ci_low ci_high")
def f15(t):
    paired = records(t).withColumn("diff", F.col("agg") - F.col("xsec"))
    return resample.bootstrap_mean(paired, ["domain"], "paper_id", "diff", BOOT)


@query("f16_difference_of_means_ci", LAB + ", " + counted_sql("lab", "system, year, label, value") + f"""
  SELECT system, year, difference, replicates, ci_low, ci_high FROM (SELECT system, year, avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0) AS difference FROM lab GROUP BY 1, 2)
  JOIN (SELECT system, year, {CI} FROM (SELECT system, year, rep, sum(value * k) FILTER (label = 1) / nullif(sum(k) FILTER (label = 1), 0)::DOUBLE - sum(value * k) FILTER (label = 0) / nullif(sum(k) FILTER (label = 0), 0)::DOUBLE AS m FROM bd GROUP BY ALL) GROUP BY ALL)
  USING (system, year)""", "difference ci_low ci_high")
def f16(t):
    return resample.bootstrap_difference(labelled(t), ["system", "year"], "paper_id", "value", "label", BOOT)


KW = f"""SELECT system, CAST(sum(n) AS BIGINT) AS n, count(*) AS k,
    (12 / (sum(n) * (sum(n) + 1.0::DOUBLE)) * sum(sr * sr / n) - 3 * (sum(n) + 1)) / (1 - max(ties) / (sum(n)::DOUBLE ** 3 - sum(n))) AS h FROM (
    SELECT system, grp, count(*) AS n, sum(r) AS sr FROM (SELECT system, grp, {rank_sql('value', 'system')} AS r FROM rl) GROUP BY 1, 2)
  JOIN (SELECT system, sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT system, value, count(*) AS c FROM rl GROUP BY 1, 2) GROUP BY 1) USING (system) GROUP BY system"""


@query("f17_kruskal_wallis", R + KW, "h")
def f17(t):
    return stats.kruskal_wallis(record_scores(t), SYS, "value", "grp")


@query("f17_kruskal_wallis_p")
def f17p(t):
    return stats.kruskal_with_p(record_scores(t), SYS, "value", "grp")


DIFF = f"WITH {RECORDS}, d AS (SELECT domain, round(agg - xsec, 6) AS diff FROM rec WHERE xsec IS NOT NULL)"


def diffs(t):
    return records(t).select("domain", F.round(F.col("agg") - F.col("xsec"), 6).alias("diff"))


@query("f18_wilcoxon", DIFF + f""", r AS (SELECT domain, diff, {rank_sql('abs(diff)', 'domain')} AS r FROM d WHERE diff <> 0),
  s AS (SELECT domain, count(*) AS n, coalesce(sum(r) FILTER (diff > 0), 0) AS w_plus, coalesce(sum(r) FILTER (diff < 0), 0) AS w_minus FROM r GROUP BY 1),
  k AS (SELECT domain, sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT domain, abs(diff) AS a, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1)
  SELECT domain, n, w_plus, w_minus, least(w_plus, w_minus) AS w,
    (least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1.0::DOUBLE) * (2 * n + 1) / 24 - ties / 48) AS z FROM s JOIN k USING (domain) WHERE n >= 5""",
       "w_plus w_minus w z")
def f18(t):
    return stats.wilcoxon(diffs(t), ["domain"], "diff")


@query("f18_wilcoxon_p")
def f18p(t):
    return stats.wilcoxon_with_p(diffs(t), ["domain"], "diff")


@query("f20_cohens_d", R + """SELECT system, count(value) AS n, (avg(value) FILTER (NOT accept) - avg(value) FILTER (accept))
    / sqrt((var_pop(value) FILTER (accept) + var_pop(value) FILTER (NOT accept)) / 2) AS d FROM rl GROUP BY system""", "d")
def f20(t):
    return stats.cohens_d(record_scores(t), SYS, "value", "accept")


@query("f21_calibration_fit")
def f21(t):
    scores = agg_only(t)
    cal = stats.fit_calibration(scores, "value")
    return scores.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(stats.apply_calibration(F.col("value"), cal)).alias("mean_p")).withColumns(
        {k: F.lit(v) for k, v in cal.items() if k != "n"})


@query("f22_logistic_fit")
def f22(t):
    return stats.fit_logistic(records(t), ["fraction_ai", "rating", "n_words"], "accept")


CAL = {"a": -0.2, "b": 1.1, "mu": 0.5, "sd": 0.29}
P_SQL = "1 / (1 + exp(-(-0.2::DOUBLE + 1.1::DOUBLE * (value - 0.5::DOUBLE) / 0.29::DOUBLE)))"


@query("f23_calibrated_spread", R + f"""SELECT year, count(*) AS n, avg(p) AS mean, quantile_cont(p, 0.1) AS p10, quantile_cont(p, 0.9) AS p90,
    quantile_cont(p, 0.9) - quantile_cont(p, 0.1) AS spread FROM (SELECT year, {P_SQL} AS p FROM rl WHERE system = 'agg') GROUP BY year""", "mean p10 p90 spread")
def f23(t):
    from inkstat.operators import ranks

    p = agg_only(t).select("year", stats.apply_calibration(F.col("value"), CAL).alias("p"))
    q = ranks.quantiles(p, ["year"], "p", {"p10": 0.1, "p90": 0.9})
    return q.join(p.groupBy("year").agg(F.avg("p").alias("mean")), "year").withColumn("spread", F.col("p90") - F.col("p10"))


@query("f24_percentile_rank", R + f"SELECT system, paper_id, {rank_sql('value', 'system')} / count(*) OVER (PARTITION BY system) * 100 AS pct FROM rl", "pct")
def f24(t):
    return stats.percentile_rank(record_scores(t).select("system", "paper_id", "value"), SYS, "value").select("system", "paper_id", "pct")


@query("f25_ordinal_percentile", R + """SELECT system, paper_id, (row_number() OVER (PARTITION BY system ORDER BY value, paper_id) - 1)
    / greatest(1, count(*) OVER (PARTITION BY system) - 1)::DOUBLE AS pct FROM rl""", "pct")
def f25(t):
    return stats.ordinal_percentile(record_scores(t).select("system", "paper_id", "value"), SYS, "value", "paper_id").select("system", "paper_id", "pct")


@query("f26_robust_minmax", R + """, o AS (SELECT system, paper_id, CASE WHEN system = 'bino' THEN -value ELSE value END AS s FROM rl),
  q AS (SELECT system, quantile_cont(s, 0.01) AS p1, quantile_cont(s, 0.99) AS p99 FROM o GROUP BY 1)
  SELECT system, paper_id, least(1, greatest(0, (s - p1) / greatest(1e-12, p99 - p1))) AS mm FROM o JOIN q USING (system)""", "mm")
def f26(t):
    o = pair_eval.orient(record_scores(t), {"bino": -1}).select("system", "paper_id", "s")
    return stats.robust_minmax(o, SYS, "s").select("system", "paper_id", "mm")


@query("f27_definitional_map", R + """SELECT system, paper_id, CASE system WHEN 'agg' THEN least(1, greatest(0, value)) WHEN 'xsec' THEN least(1, greatest(0, value))
    WHEN 'nts' THEN least(1, greatest(0, (10 - value) / 9)) END AS def FROM rl""", "def")
def f27(t):
    kind = F.when(F.col("system").isin("agg", "xsec"), "fraction").when(F.col("system") == "nts", "rating10")
    return record_scores(t).select("system", "paper_id", stats.definitional(F.col("value"), kind).alias("def"))


@query("f28_zscore_composite", f"""WITH {RECORDS}, z AS (SELECT paper_id, (bino - avg(bino) OVER w) / nullif(stddev_pop(bino) OVER w, 0) AS z_bino,
    (nts - avg(nts) OVER w) / nullif(stddev_pop(nts) OVER w, 0) AS z_nts, (xsec - avg(xsec) OVER w) / nullif(stddev_pop(xsec) OVER w, 0) AS z_xsec
    FROM rec WINDOW w AS (PARTITION BY year))
  SELECT paper_id, z_bino, z_nts, z_xsec, (coalesce(z_bino, 0) + coalesce(z_nts, 0) + coalesce(z_xsec, 0)) / nullif((z_bino IS NOT NULL)::INT + (z_nts IS NOT NULL)::INT + (z_xsec IS NOT NULL)::INT, 0) AS m FROM z""",
       "z_bino z_nts z_xsec m")
def f28(t):
    return stats.zscores(records(t).select("paper_id", "year", "bino", "nts", "xsec"), ["year"], ["bino", "nts", "xsec"], "m").select(
        "paper_id", "z_bino", "z_nts", "z_xsec", "m")


@query("f29_year_centred", R + """SELECT system, paper_id, value - avg(value) OVER (PARTITION BY system, year) + avg(value) OVER (PARTITION BY system) AS centred FROM rl""", "centred")
def f29(t):
    return stats.centred(record_scores(t), SYS, "year", "value", "centred").select("system", "paper_id", "centred")


@query("f30_level_means", R + """SELECT system, round_even(rating * 2, 0) / 2 AS level, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd
  FROM rl GROUP BY 1, 2 HAVING count(value) >= 40""", "level mean sd")
def f30(t):
    return stats.level_means(record_scores(t), SYS, stats.half_point(F.col("rating")), "value", 40)


PS = f"""WITH {RECORDS}, r AS (SELECT *, (year || '/' || domain) AS stratum FROM rec WHERE NOT (grp = 'oral' AND year = 1997)),
  c AS (SELECT grp, stratum, count(*) AS c FROM r GROUP BY 1, 2),
  common AS (SELECT stratum, sum(c) AS t FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT grp) FROM r)),
  k AS (SELECT c.*, t / sum(t) OVER (PARTITION BY grp) AS share, sum(c) OVER (PARTITION BY grp) AS nl FROM c JOIN common USING (stratum)),
  w AS (SELECT paper_id, r.grp, agg, share / (c / nl::DOUBLE) AS weight FROM r LEFT JOIN k USING (grp, stratum)) """


@query("f31_poststratification", PS + """SELECT grp, count(weight) AS n, sum(agg * weight) / sum(weight) AS wmean, sum(weight) AS wsum,
  count(*) - count(weight) AS n_dropped FROM w GROUP BY grp""", "wmean wsum")
def f31(t):
    rows = records(t).where(~((F.col("grp") == "oral") & (F.col("year") == 1997))).withColumn("stratum", F.concat_ws("/", F.col("year").cast("string"), "domain"))
    w = stats.poststratify(rows, "grp", "stratum")
    dropped = w.groupBy("grp").agg(F.count_if(F.col("weight").isNull()).alias("n_dropped"))
    return stats.weighted_mean(w, ["grp"], "agg", "weight").join(dropped, "grp")


@query("f32_staircase", R + f""", o AS (SELECT *, CASE grp WHEN 'reject' THEN 0 WHEN 'poster' THEN 1 WHEN 'spotlight' THEN 2 ELSE 3 END AS level FROM rl),
  g AS (SELECT system, level, count(*) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS sd FROM o GROUP BY 1, 2),
  a AS (SELECT b.system, b.level + 1 AS level, auroc FROM (SELECT unnest([0, 1, 2]) AS level) x JOIN ({auroc_sql("(SELECT system, k AS level, value, CASE WHEN level = k THEN 0 ELSE 1 END AS label FROM o, (SELECT unnest([0, 1, 2]) AS k) WHERE level IN (k, k + 1))", 'system, level', 'value')}) b USING (level))
  SELECT system, level, n, mean, median, sd, mean - lag(mean) OVER (PARTITION BY system ORDER BY level) AS delta_mean, 2 * auroc - 1 AS cliff
  FROM g LEFT JOIN a USING (system, level)""", "mean median sd delta_mean cliff")
def f32(t):
    level = F.when(F.col("grp") == "reject", 0).when(F.col("grp") == "poster", 1).when(F.col("grp") == "spotlight", 2).otherwise(3)
    return stats.staircase(record_scores(t).withColumn("level", level), SYS, "level", "value", 4)


@query("f32_ordinal_trend", R + ", o AS (SELECT *, CASE grp WHEN 'reject' THEN 0 WHEN 'poster' THEN 1 WHEN 'spotlight' THEN 2 ELSE 3 END AS level FROM rl) "
       + rho_sql("o", "system", "level", "value"), "rho")
def f32b(t):
    level = F.when(F.col("grp") == "reject", 0).when(F.col("grp") == "poster", 1).when(F.col("grp") == "spotlight", 2).otherwise(3)
    return stats.spearman(record_scores(t).withColumn("level", level), SYS, "level", "value")


GAP = """, q AS (SELECT year, quantile_cont(rating, 0.33333) AS q33, quantile_cont(rating, 0.66667) AS q67, quantile_cont(rating, 0.25) AS q25, quantile_cont(rating, 0.75) AS q75
    FROM rec GROUP BY year),
  sp AS (SELECT rec.paper_id, year, split, side FROM rec JOIN q USING (year), (VALUES ('tercile', 'low'), ('tercile', 'high'), ('quartile', 'low'), ('quartile', 'high'),
      ('decision', 'low'), ('decision', 'high'), ('absolute', 'low'), ('absolute', 'high')) AS x(split, side)
    WHERE CASE split || side WHEN 'tercilelow' THEN rating <= q33 WHEN 'tercilehigh' THEN rating >= q67 WHEN 'quartilelow' THEN rating <= q25
      WHEN 'quartilehigh' THEN rating >= q75 WHEN 'decisionlow' THEN grp = 'reject' WHEN 'decisionhigh' THEN grp = 'oral' WHEN 'absolutelow' THEN rating <= 4 ELSE rating >= 7 END),
  m AS (SELECT year, system, median(value) AS med, min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS d, count(*) AS c FROM rl GROUP BY 1, 2),
  hit AS (SELECT rl.year, rl.system, paper_id, CASE WHEN d <= 2 OR med = lo OR med = hi THEN value >= hi ELSE value > med END::INT AS hit FROM rl JOIN m USING (year, system) WHERE c >= 20),
  gaps AS (SELECT *, share_high - share_low AS gap FROM (SELECT hit.year, system, split, count(*) FILTER (side = 'low') AS n_low, count(*) FILTER (side = 'high') AS n_high,
      100 * avg(hit) FILTER (side = 'low') AS share_low, 100 * avg(hit) FILTER (side = 'high') AS share_high FROM hit JOIN sp USING (year, paper_id) GROUP BY 1, 2, 3)
    WHERE n_low >= 8 AND n_high >= 8)"""


@query("f33_yearly_gap", R + GAP + " SELECT * FROM gaps", "share_low share_high gap")
def f33(t):
    return stats.yearly_gap(record_scores(t))


@query("f34_gap_trend", R + GAP + f""", g AS (SELECT split, system, count(*) AS years, avg(gap) AS mean_gap, count(*) FILTER (gap < 0) AS negative, median(gap) AS median_gap FROM gaps GROUP BY 1, 2)
  SELECT g.*, least(1, 2 * list_sum(list_transform(range(0, least(negative, years - negative) + 1), lambda k: exp(lgamma(years + 1) - lgamma(k + 1) - lgamma(years - k + 1) - years * ln(2))))) AS sign_p,
    rho AS trend_rho FROM g JOIN ({rho_sql('gaps', 'split, system', 'year', 'gap')}) USING (split, system) WHERE years >= 4""", "mean_gap median_gap sign_p trend_rho")
def f34(t):
    return stats.gap_trend(stats.yearly_gap(record_scores(t)), ["split", "system"])


@query("f19_sign_test", R + GAP + """ SELECT system, count(*) AS n, count(*) FILTER (gap < 0) AS negative,
  least(1, 2 * list_sum(list_transform(range(0, least(count(*) FILTER (gap < 0), count(*) FILTER (gap >= 0)) + 1), lambda k: exp(lgamma(count(*) + 1) - lgamma(k + 1) - lgamma(count(*) - k + 1) - count(*) * ln(2))))) AS p
  FROM gaps WHERE split = 'tercile' GROUP BY system""", "p")
def f19(t):
    g = stats.yearly_gap(record_scores(t)).where(F.col("split") == "tercile")
    s = g.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") < 0).alias("negative"))
    return s.withColumn("p", stats.sign_test_p(F.col("negative"), F.col("n")))


@query("f35_quartile_bins", f"""WITH {RECORDS}, q AS (SELECT year, quantile_cont(rating, 0.25) AS a, quantile_cont(rating, 0.5) AS b, quantile_cont(rating, 0.75) AS c FROM rec GROUP BY 1)
  SELECT year, (rating >= a)::INT + (rating >= b)::INT + (rating >= c)::INT AS bin, count(*) AS n, avg(agg) AS mean_agg FROM rec JOIN q USING (year) GROUP BY 1, 2""", "mean_agg")
def f35(t):
    return stats.quartile_bin(records(t), ["year"], "rating").groupBy("year", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("agg").alias("mean_agg"))


@query("f36_tercile_outcomes", R + """, q AS (SELECT system, quantile_cont(value, 0.33333) AS a, quantile_cont(value, 0.66667) AS b FROM rl GROUP BY 1)
  SELECT system, CASE WHEN value <= a THEN 'low' WHEN value >= b THEN 'high' ELSE 'middle' END AS tercile, count(*) AS n, avg(rating) AS mean_rating,
    100 * avg(accept::INT) AS accept_rate FROM rl JOIN q USING (system) GROUP BY 1, 2""", "mean_rating accept_rate")
def f36(t):
    return stats.tercile_outcomes(record_scores(t), SYS, "value")


MATCHED = f"""SELECT * FROM ({auroc_sql("(SELECT *, round_even(rating * 2, 0) / 2 AS bin FROM lab)", 'system, bin', 'value')}) WHERE n_pos >= 10 AND n_neg >= 10"""


@query("f37_matched_rating_auroc", LAB + f"SELECT system, count(*) AS n_bins, avg(auroc) AS pooled_auroc FROM ({MATCHED}) GROUP BY system", "pooled_auroc")
def f37(t):
    binned = labelled(t).withColumn("bin", stats.half_point(F.col("rating")))
    return stats.grouped_auroc(binned, SYS, "bin", "value", 10).groupBy("system").agg(F.count(F.lit(1)).alias("n_bins"), F.avg("auroc").alias("pooled_auroc"))


@query("f38_per_year_auroc", LAB + f"""SELECT system, count(*) AS n_years, count(*) FILTER (auroc > 0.5) AS above, min(auroc) AS min_auroc, max(auroc) AS max_auroc
  FROM ({auroc_sql('lab', 'system, year', 'value')}) WHERE n_pos >= 15 AND n_neg >= 15 GROUP BY system""", "min_auroc max_auroc")
def f38(t):
    per = stats.grouped_auroc(labelled(t), SYS, "year", "value", 15)
    return per.groupBy("system").agg(F.count(F.lit(1)).alias("n_years"), F.count_if(F.col("auroc") > 0.5).alias("above"),
                                     F.min("auroc").alias("min_auroc"), F.max("auroc").alias("max_auroc"))


DIMS = ["rating", "n_words", "fraction_ai"]


@query("f39_dimension_matrix", R + """, d AS (SELECT system, value, unnest(['rating', 'n_words', 'fraction_ai']) AS dim, unnest([rating, n_words::DOUBLE, fraction_ai]) AS y FROM rl) """
       + rho_sql("d", "system, dim", "value", "y") + " HAVING count(*) >= 30", "rho")
def f39(t):
    long = record_scores(t).withColumn("n_words", F.col("n_words").cast("double")).unpivot(["system", "value"], DIMS, "dim", "y")
    return stats.spearman(long, ["system", "dim"], "value", "y", min_n=30)


@query("f40_incremental_grid", f"""WITH {RECORDS}, g AS (SELECT agg AS value, rating, unnest(['bino', 'nts', 'xsec', 'n_words']) AS control, unnest([bino, nts, xsec, n_words::DOUBLE]) AS z FROM rec),
  k AS (SELECT * FROM g WHERE z IS NOT NULL)
  SELECT control, count(*) AS n, (corr(rx, ry) - corr(rx, rz) * corr(ry, rz)) / sqrt((1 - corr(rx, rz) ** 2) * (1 - corr(ry, rz) ** 2)) AS rho
  FROM (SELECT control, {rank_sql('value', 'control')} AS rx, {rank_sql('rating', 'control')} AS ry, {rank_sql('z', 'control')} AS rz FROM k) GROUP BY control""", "rho")
def f40(t):
    wide = records(t).withColumn("n_words", F.col("n_words").cast("double")).withColumnRenamed("agg", "score")
    grid = wide.unpivot(["score", "rating"], ["bino", "nts", "xsec", "n_words"], "control", "z")
    return stats.partial_spearman(grid, ["control"], "score", "rating", "z", min_n=50)


@query("f41_cross_system", R + """, p AS (SELECT a.system || ' x ' || b.system AS pair, a.value AS x, b.value AS y FROM rl a JOIN rl b ON a.paper_id = b.paper_id AND a.system < b.system) """
       + rho_sql("p", "pair", "x", "y"), "rho")
def f41(t):
    return stats.cross_system(records(t), ["agg", "bino", "nts", "xsec"], min_n=50)


@query("f42_common_subset", R + """, c AS (SELECT paper_id FROM rl GROUP BY 1 HAVING count(DISTINCT system) = 4), k AS (SELECT rl.* FROM rl SEMI JOIN c USING (paper_id)) """
       + rho_sql("k", "system", "value", "rating"), "rho")
def f42(t):
    return stats.spearman(stats.common_subset(record_scores(t), "paper_id", ["bino", "nts", "agg", "xsec"]), SYS, "value", "rating", min_n=30)


@query("f43_equal_n_gap", LAB + f""", ag AS (SELECT year, paper_id, label, value FROM lab WHERE system = 'agg'), mn AS (SELECT min(c) AS n_min FROM (SELECT count(*) AS c FROM ag GROUP BY year)),
  r AS (SELECT ag.*, rep, n_min, row_number() OVER (PARTITION BY year, rep ORDER BY CAST('0x' || substr(md5(paper_id || ':' || rep), 1, 8) AS BIGINT), paper_id) AS rn
    FROM ag, mn, (SELECT unnest(range(1, 6)) AS rep)),
  g AS (SELECT year, rep, max(n_min) AS n_min, avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0) AS gap FROM r WHERE rn <= n_min GROUP BY 1, 2)
  SELECT year, max(n_min) AS n_min, avg(gap) AS mean_gap FROM g GROUP BY year""", "mean_gap")
def f43(t):
    return resample.equal_n_gap(agg_only(t).select("year", "paper_id", "label", "value"), ["year"], "paper_id", "value", "label", 5)


@query("f44_two_axis", LAB + f"""SELECT a.system, auroc AS provenance_auroc, rho AS quality_rho FROM ({auroc_sql('lab', 'system', 'value')}) a
  JOIN ({rho_sql('lab', 'system', 'value', 'rating')}) USING (system)""", "provenance_auroc quality_rho")
def f44(t):
    rows = labelled(t)
    return stats.two_sample(rows, SYS, "value").select("system", F.col("auroc").alias("provenance_auroc")).join(
        stats.spearman(rows, SYS, "value", "rating").select("system", F.col("rho").alias("quality_rho")), "system")


@query("f45_clean_layer", R + """, c AS (SELECT *, unnest(CASE WHEN fraction_ai = 0 THEN ['zero', 'low'] WHEN fraction_ai <= 0.05 THEN ['low'] ELSE [] END) AS layer FROM rl) """
       + rho_sql("c", "layer, system", "value", "rating") + " HAVING count(*) >= 30", "rho")
def f45(t):
    tagged = pair_eval.stratified(record_scores(t), {"zero": F.col("fraction_ai") == 0, "low": F.col("fraction_ai") <= 0.05}).withColumnRenamed("stratum", "layer")
    return stats.spearman(tagged, ["layer", "system"], "value", "rating", min_n=30)


@query("f46_quantiles_by_group", f"""WITH {RECORDS} SELECT grp, count(*) AS n, quantile_cont(fraction_ai, 0.5) AS median, quantile_cont(fraction_ai, 0.75) AS p75,
    quantile_cont(fraction_ai, 0.9) AS p90, quantile_cont(fraction_ai, 0.99) AS p99 FROM rec GROUP BY grp""", "median p75 p90 p99")
def f46(t):
    from inkstat.operators import ranks

    return ranks.quantiles(records(t), ["grp"], "fraction_ai", {"median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99})


BANDS = [("= 0", 0.0, 1e-9), ("0-0.05", 1e-9, 0.05), ("0.05-0.15", 0.05, 0.15), ("0.15-0.30", 0.15, 0.30), ("0.30-0.50", 0.30, 0.50), ("> 0.50", 0.50, 1.01)]


@query("f46_accept_rate_by_band", f"WITH {RECORDS} SELECT CASE " + " ".join(f"WHEN fraction_ai >= {lo!r} AND fraction_ai < {hi!r} THEN '{n}'" for n, lo, hi in BANDS)
       + " END AS band, count(*) AS n, 100 * avg(accept::INT) AS accept_rate FROM rec GROUP BY 1 HAVING count(*) >= 20", "accept_rate")
def f46b(t):
    return stats.rate_by_band(records(t), "fraction_ai", BANDS, "accept", 20)
