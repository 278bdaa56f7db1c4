"""Registered queries of the paired evaluation (E operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstat.operators import pair_eval as E
from inkstat.operators import stats
from inkstat.plans.inputs import BENCH_LONG, BENCH_ORIENTED, BENCH_WIDE, DIRECTIONS, auroc_sql, bench_scores, bench_wide
from inkstat.plans.registry import query


def oriented(t):
    return E.orient(bench_scores(t), DIRECTIONS)


def sides_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, pair_id, max(CASE WHEN label = 1 THEN s END) AS a, max(CASE WHEN label = 0 THEN s END) AS h
      FROM {source} GROUP BY {by}, pair_id HAVING a IS NOT NULL AND h IS NOT NULL"""


def pair_acc_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n_pairs, count(*) FILTER (a > h) AS wins, count(*) FILTER (a = h) AS ties,
      (count(*) FILTER (a > h) + 0.5::DOUBLE * count(*) FILTER (a = h)) / count(*) AS pair_acc
      FROM ({sides_sql(source, by)}) GROUP BY {by}"""


def threshold_sql(source: str, by: str, k: str) -> str:
    """Threshold: the negative at position k of the descending order."""
    return f"""SELECT {by}, s AS threshold FROM (
        SELECT {by}, s, row_number() OVER (PARTITION BY {by} ORDER BY s DESC) - 1 AS p, count(*) OVER (PARTITION BY {by}) AS n
        FROM {source} WHERE label = 0) WHERE p = {k}"""


K_A = "greatest(0, CAST(floor(n * 0.05::DOUBLE) AS BIGINT) - 1)"
K_B = "CAST(floor(n * 0.05::DOUBLE) AS BIGINT)"


def tpr_sql(source: str, by: str, k: str) -> str:
    return f"""SELECT {by}, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
      count(*) FILTER (label = 1 AND s > threshold) AS tp, count(*) FILTER (label = 0 AND s > threshold) AS fp,
      max(threshold) AS threshold,
      count(*) FILTER (label = 1 AND s > threshold) / count(*) FILTER (label = 1)::DOUBLE AS tpr,
      count(*) FILTER (label = 0 AND s > threshold) / count(*) FILTER (label = 0)::DOUBLE AS actual_fpr
      FROM {source} JOIN ({threshold_sql(source, by, k)}) USING ({by}) GROUP BY {by}"""


@query("e1_pair_accuracy", f"WITH {BENCH_ORIENTED} {pair_acc_sql('o', 'system')}", "pair_acc")
def e1(t):
    return E.pair_accuracy(oriented(t))


@query("e2_auroc", f"WITH {BENCH_ORIENTED} {auroc_sql('o', 'system')}", "auroc")
def e2(t):
    return E.auroc(oriented(t))


@query("e3_tpr_at_fpr_a", f"WITH {BENCH_ORIENTED} {tpr_sql('o', 'system', K_A)}", "tpr actual_fpr threshold")
def e3(t):
    return E.tpr_at_fpr(oriented(t), variant="A")


@query("e4_tpr_at_fpr_b", f"WITH {BENCH_ORIENTED} {tpr_sql('o', 'system', K_B)}", "tpr actual_fpr threshold")
def e4(t):
    return E.tpr_at_fpr(oriented(t), variant="B")


PRF = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, tp / n_pos::DOUBLE AS recall,
  CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (tp + fp + n_pos) ELSE 0 END AS f1"""


@query("e5_prf_at_threshold", f"WITH {BENCH_ORIENTED} SELECT system, tp, fp, {PRF}, actual_fpr FROM ({tpr_sql('o', 'system', K_A)})",
       "precision recall f1 actual_fpr")
def e5(t):
    return E.prf_at_threshold(oriented(t))


@query("e6_best_f1", f"""WITH {BENCH_ORIENTED}, c AS (
    SELECT system, s, min(value) AS v, sum(label) AS p, sum(1 - label) AS n FROM o GROUP BY system, s),
  w AS (SELECT system, s AS threshold, v, sum(p) OVER (PARTITION BY system ORDER BY s DESC) - p AS tp,
         sum(n) OVER (PARTITION BY system ORDER BY s DESC) - n AS fp, sum(p) OVER (PARTITION BY system) AS n_pos FROM c
        UNION ALL SELECT system, NULL, NULL, sum(p), sum(n), sum(p) FROM c GROUP BY system),
  f AS (SELECT system, threshold, v, {PRF} FROM w),
  r AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY round(f1, 12) DESC, v ASC NULLS LAST) AS k FROM f)
  SELECT system, f1, precision, recall, threshold FROM r WHERE k = 1""", "f1 precision recall threshold")
def e6(t):
    return E.best_f1(oriented(t))


@query("e7_win_loss_cliff", f"""WITH {BENCH_ORIENTED} SELECT system, count(*) AS n_pairs, count(*) FILTER (a > h) AS win,
  count(*) FILTER (a < h) AS loss, count(*) FILTER (a = h) AS tie, avg(a) AS mean_pos, avg(h) AS mean_neg,
  (count(*) FILTER (a > h) + 0.5::DOUBLE * count(*) FILTER (a = h)) / count(*) AS pair_acc,
  (count(*) FILTER (a > h) - count(*) FILTER (a < h)) / count(*)::DOUBLE AS cliff
  FROM ({sides_sql('o', 'system')}) GROUP BY system""", "mean_pos mean_neg pair_acc cliff")
def e7(t):
    return E.win_loss(oriented(t))


STRATA_SQL = """, st AS (SELECT * FROM (SELECT *, unnest(['all', CASE WHEN tier >= 2 THEN 'tier_ge2' END,
    CASE WHEN pool = 'cited' THEN 'cited' END, CASE WHEN pool = 'widened' THEN 'widened' END]) AS stratum FROM o)
  WHERE stratum IS NOT NULL)"""


@query("e8_strata", f"""WITH {BENCH_ORIENTED}{STRATA_SQL} SELECT p.*, a.auroc
  FROM ({pair_acc_sql('st', 'stratum, system')}) p JOIN ({auroc_sql('st', 'stratum, system')}) a USING (stratum, system)""", "pair_acc auroc")
def e8(t):
    strata = {"all": F.lit(True), "tier_ge2": F.col("tier") >= 2, "cited": F.col("pool") == "cited", "widened": F.col("pool") == "widened"}
    by = ["stratum", "system"]
    tagged = E.stratified(oriented(t), strata)
    return E.pair_accuracy(tagged, by).join(E.auroc(tagged, by).select(*by, "auroc"), by)


@query("e9_length_control", f"""WITH {BENCH_LONG}, f AS (
    SELECT system, regr_slope(value, ln(words)) AS b, avg(value) AS my, avg(ln(words)) AS mx FROM bs GROUP BY system),
  o AS (SELECT bs.*, round(value - (my + b * (ln(words) - mx)), 9) * CASE WHEN system IN ('price', 'tax') THEN -1 ELSE 1 END AS s
        FROM bs JOIN f USING (system))
  SELECT p.system, n_pairs, pair_acc, auroc FROM ({pair_acc_sql('o', 'system')}) p JOIN ({auroc_sql('o', 'system')}) a USING (system)""",
       "pair_acc auroc")
def e9(t):
    scores = E.orient(E.length_controlled(bench_scores(t), "words"), DIRECTIONS)
    return E.pair_accuracy(scores).join(E.auroc(scores).select("system", "auroc"), "system").select("system", "n_pairs", "pair_acc", "auroc")


POOLED = f"""SELECT p.system, n_pairs, pair_acc, auroc, tpr FROM ({pair_acc_sql('o', 'system')}) p
  JOIN ({auroc_sql('o', 'system')}) a USING (system) JOIN ({tpr_sql('o', 'system', K_A)}) USING (system)"""


@query("e10_pooled_halves", f"""WITH {BENCH_LONG}, h AS (
    SELECT 'first:' || pair_id AS pair_id, label, system, value FROM bs WHERE pool = 'cited'
    UNION ALL SELECT 'second:' || pair_id, label, system, value FROM bs WHERE pool = 'widened'),
  o AS (SELECT *, CASE WHEN system IN ('price', 'tax') THEN -value ELSE value END AS s FROM h) {POOLED}""", "pair_acc auroc tpr")
def e10(t):
    scores = bench_scores(t)
    halves = {"first": scores.where(F.col("pool") == "cited"), "second": scores.where(F.col("pool") == "widened")}
    return E.pooled_metrics(E.orient(E.pool_halves(halves), DIRECTIONS))


@query("e11_seed_variance", f"""WITH {BENCH_ORIENTED}, m AS (SELECT p.tier AS draw, p.system, pair_acc, auroc
    FROM ({pair_acc_sql('o', 'tier, system')}) p JOIN ({auroc_sql('o', 'tier, system')}) a USING (tier, system))
  SELECT system, count(DISTINCT draw) AS n_draws, avg(pair_acc) AS pair_acc_mean, avg(auroc) AS auroc_mean,
    coalesce(stddev_samp(pair_acc), 0) AS pair_acc_sd, coalesce(stddev_samp(auroc), 0) AS auroc_sd FROM m GROUP BY system""",
       "pair_acc_mean auroc_mean pair_acc_sd auroc_sd")
def e11(t):
    by = ["tier", "system"]
    draws = E.pooled_metrics(oriented(t), by).withColumnRenamed("tier", "draw")
    return E.seed_variance(draws, "draw", ["pair_acc", "auroc"])


@query("e12_field_separability", f"""WITH {BENCH_LONG}, o AS (SELECT pair_id, label, system, d, value * d AS s FROM bs, (VALUES (1), (-1)) AS x(d)),
  m AS (SELECT p.system, p.d, n_pairs, pair_acc, auroc, mean_pos * p.d AS mean_pos, mean_neg * p.d AS mean_neg
    FROM ({pair_acc_sql('o', 'system, d')}) p JOIN ({auroc_sql('o', 'system, d')}) a USING (system, d)
    JOIN (SELECT system, d, avg(a) AS mean_pos, avg(h) AS mean_neg FROM ({sides_sql('o', 'system, d')}) GROUP BY 1, 2) USING (system, d))
  SELECT * FROM m WHERE n_pairs >= 5 AND pair_acc >= 0.5 ORDER BY pair_acc DESC, auroc DESC, system DESC, d DESC LIMIT 24""",
       "pair_acc auroc mean_pos mean_neg")
def e12(t):
    return E.field_separability(bench_scores(t))


@query("e13_feature_balance", f"""WITH {BENCH_LONG}, o AS (SELECT *, value AS s FROM bs), pr AS ({sides_sql('o', 'system')}),
  it AS (SELECT system, 1 AS label, a AS s FROM pr UNION ALL SELECT system, 0, h FROM pr)
  SELECT system, count(*) AS n, count(*) FILTER (a > h) AS pos_larger, count(*) FILTER (a = h) AS ties, count(*) FILTER (a < h) AS neg_larger,
    quantile_cont(a, 0.5) AS pos_median, quantile_cont(h, 0.5) AS neg_median, max(auroc) AS auroc,
    quantile_cont(h, 0.5) / nullif(quantile_cont(a, 0.5), 0) AS ratio, max(greatest(auroc, 1 - auroc)) AS separability
  FROM pr JOIN ({auroc_sql('it', 'system')}) USING (system) GROUP BY system""", "pos_median neg_median auroc ratio separability")
def e13(t):
    return E.feature_balance(E.orient(bench_scores(t), {}))


@query("e14_retrieval_audit", """WITH v AS (SELECT vec_id // 2 AS pair_id, vec_id % 2 AS side, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
  n AS (SELECT pair_id, side, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
  l AS (SELECT * FROM n WHERE side = 0), r AS (SELECT * FROM n WHERE side = 1),
  x AS (SELECT l.pair_id AS i, r.pair_id AS j, l.label, list_dot_product(l.e, r.e) AS s FROM l, r),
  k AS (SELECT o.i, max(o.label) AS tier, max(o.s) AS cos, 1 + count(*) FILTER (x.s > o.s AND x.j <> o.i) AS rank
        FROM x JOIN (SELECT * FROM x WHERE i = j) o ON x.i = o.i GROUP BY o.i)
  SELECT coalesce(CAST(tier AS VARCHAR), 'all') AS tier, count(*) AS n, avg(cos) AS mean_cos, count(*) FILTER (rank = 1) AS top1,
    count(*) FILTER (rank <= 3) AS top3, count(*) FILTER (rank <= 10) AS top10, median(rank) AS median_rank
  FROM k GROUP BY ROLLUP (tier)""", "mean_cos median_rank")
def e14(t):
    return E.retrieval_audit(
        t.embeddings.where("vec_id % 2 = 0").selectExpr("vec_id div 2 AS pair_id", "embedding AS vec", "label AS tier"),
        t.embeddings.where("vec_id % 2 = 1").selectExpr("vec_id div 2 AS pair_id", "embedding AS vec"), "tier")


FUNNEL_STAGES = ["h1", "h2", "h3", "h4"]


def funnel_rows(t):
    return t.lineitem.select(
        F.col("l_suppkey").alias("query_id"),
        F.when(F.col("l_discount") <= 0.05, "pass").otherwise("fail").alias("h1"),
        F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass").alias("h2"),
        F.when(F.col("l_quantity") >= 25, "pass").when(F.col("l_quantity") >= 20, "unknown").otherwise("fail").alias("h3"),
        F.when(F.col("l_tax") < 0.06, "pass").otherwise("fail").alias("h4"),
    )


FUNNEL_SQL = """fr AS (SELECT l_suppkey AS query_id, CASE WHEN l_discount <= 0.05 THEN 'pass' ELSE 'fail' END AS h1,
    CASE WHEN l_returnflag = 'R' THEN 'fail' ELSE 'pass' END AS h2,
    CASE WHEN l_quantity >= 25 THEN 'pass' WHEN l_quantity >= 20 THEN 'unknown' ELSE 'fail' END AS h3,
    CASE WHEN l_tax < 0.06 THEN 'pass' ELSE 'fail' END AS h4 FROM lineitem)"""


@query("e15_filter_funnel", f"""WITH {FUNNEL_SQL}, e AS (
    SELECT 0 AS pos, 'all' AS stage, query_id, true AS alive, false AS fail FROM fr
    UNION ALL SELECT 1, 'h1', query_id, h1 = 'pass', h1 = 'fail' FROM fr
    UNION ALL SELECT 2, 'h2', query_id, h1 = 'pass' AND h2 = 'pass', h2 = 'fail' FROM fr
    UNION ALL SELECT 3, 'h3', query_id, h1 = 'pass' AND h2 = 'pass' AND h3 = 'pass', h3 = 'fail' FROM fr
    UNION ALL SELECT 4, 'h4', query_id, h1 = 'pass' AND h2 = 'pass' AND h3 = 'pass' AND h4 = 'pass', h4 = 'fail' FROM fr)
  SELECT pos, stage, count(*) FILTER (alive) AS rows_left, count(DISTINCT query_id) FILTER (alive) AS queries_left,
    count(*) FILTER (fail) AS fail_any FROM e GROUP BY pos, stage""")
def e15(t):
    return E.filter_funnel(funnel_rows(t), FUNNEL_STAGES)


@query("e15_fail_reasons", f"""WITH {FUNNEL_SQL} SELECT h1 || '|' || h3 AS reason, count(*) AS n, count(DISTINCT query_id) AS n_queries
  FROM fr WHERE h1 = 'fail' OR h3 = 'fail' GROUP BY 1""")
def e15b(t):
    failing = funnel_rows(t).where((F.col("h1") == "fail") | (F.col("h3") == "fail"))
    per_query = failing.groupBy(F.concat_ws("|", "h1", "h3").alias("reason"), "query_id").agg(F.count(F.lit(1)).alias("n"))
    return per_query.groupBy("reason").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_queries"))


@query("e16_composition", f"""WITH {BENCH_WIDE} SELECT CASE WHEN grouping(tier) = 1 THEN 'all' ELSE CAST(tier AS VARCHAR) END AS tier,
    CASE WHEN grouping(pool) = 1 THEN 'all' ELSE pool END AS pool, count(*) AS n FROM bw GROUP BY CUBE (tier, pool)""")
def e16(t):
    return E.composition(bench_wide(t), "tier", "pool")


@query("e16_index_quartiles", f"""WITH {BENCH_LONG}, r AS (SELECT system, label, value, row_number() OVER (PARTITION BY system, label ORDER BY value) - 1 AS p,
    count(*) OVER (PARTITION BY system, label) AS n FROM bs)
  SELECT system, label, max(n) AS n, max(CASE WHEN p = n // 4 THEN value END) AS q1, max(CASE WHEN p = 3 * n // 4 THEN value END) AS q3,
    quantile_cont(value, 0.5) AS median FROM r GROUP BY system, label""", "q1 q3 median")
def e16b(t):
    return E.index_quartiles(bench_scores(t), ["system", "label"], "value")


@query("e17_variant_agreement", f"""WITH {BENCH_WIDE}, w AS (SELECT pool AS variant, quantity AS x, price AS y FROM bw),
  r AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY x) + (count(*) OVER (PARTITION BY variant, x) - 1) / 2.0::DOUBLE AS rx,
     rank() OVER (PARTITION BY variant ORDER BY y) + (count(*) OVER (PARTITION BY variant, y) - 1) / 2.0::DOUBLE AS ry FROM w)
  SELECT variant, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY variant HAVING count(*) > 10""", "rho")
def e17(t):
    wide = bench_wide(t).withColumn("item_id", F.col("pair_id") * 2 + F.col("label"))
    base = wide.select("item_id", F.col("price").alias("base"))
    variants = wide.select("item_id", F.col("pool").alias("variant"), F.col("quantity").alias("score"))
    return stats.spearman(variants.join(base, "item_id"), ["variant"], "score", "base", min_n=11)


@query("e18_run_diff", f"""WITH {BENCH_LONG} SELECT system, count(*) AS n,
    count(*) FILTER (value IS NOT DISTINCT FROM CASE WHEN pair_id % 10 = 0 THEN value + 0.5 ELSE value END) AS identical,
    max(abs(value - CASE WHEN pair_id % 10 = 0 THEN value + 0.5 ELSE value END)) AS max_abs_diff FROM bs GROUP BY system""", "max_abs_diff")
def e18(t):
    run = bench_scores(t).select("item_id", "system", "value", "pair_id")
    shifted = F.when(F.col("pair_id") % 10 == 0, F.col("value") + 0.5).otherwise(F.col("value"))
    return E.run_diff(run, run.withColumn("value", shifted), ["item_id", "system"])
