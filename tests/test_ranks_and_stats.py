"""Rank core, paired metrics and statistics against brute-force models."""

import math
import random

import hashlib
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstat.operators import pair_eval, ranks, resample, stats


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 else ("cold" if i % 2 else "mild")
        # a third of one group shares a single value
        v = 0.0 if rng.random() < 0.33 else float(rng.randint(-400, 400)) / 8
        rows.append((i, g, rng.randint(0, 1), v, float(rng.randint(0, 50)), float(rng.randint(0, 9)), rng.choice("abcd")))
    return rows


@pytest.fixture(scope="module")
def frame(spark, sample):
    return spark.createDataFrame(sample, "id long, g string, label int, v double, y double, z double, s string").repartition(5)


def test_ranges_of_a_group_do_not_share_a_task(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.col("id") * 1.0).alias("v")).repartition("g")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few rows would be put together again
    try:
        sizes = [r["count"] for r in ranks.rank_cells(df, ["g"], "v").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sum(sizes) == 20_000 and max(sizes) < 9_000


def avg_ranks(values):
    order = sorted(values)
    first, count = {}, {}
    for i, v in enumerate(order):
        first.setdefault(v, i)
        count[v] = count.get(v, 0) + 1
    return [first[v] + (count[v] + 1) / 2 for v in values]


def corr(a, b):
    return float(np.corrcoef(a, b)[0, 1])


def groups(sample):
    out = {}
    for r in sample:
        out.setdefault(r[1], []).append(r)
    return out


def auroc(pos, neg):
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_average_ranks_match_sorting(frame, sample):
    got = dict(rows_of(ranks.with_ranks(frame, ["g"], {"v": "r"}), "id", "r"))
    for rs in groups(sample).values():
        for r, want in zip(rs, avg_ranks([x[3] for x in rs])):
            assert got[r[0]] == want


def test_numbering_is_dense_and_ordered(frame, sample):
    got = rows_of(ranks.numbered(frame.select("g", "id"), ["g"], "id"), "g", "id", "rn")
    for g, rs in groups(sample).items():
        ids = sorted(r[0] for r in rs)
        assert sorted((i, n) for gg, i, n in got if gg == g) == [(i, k + 1) for k, i in enumerate(ids)]


def test_quantiles_are_linear_percentiles(frame, sample):
    got = {r["g"]: r for r in ranks.quantiles(frame, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}).collect()}
    for g, rs in groups(sample).items():
        v = [r[3] for r in rs]
        assert [got[g][k] for k in "amz"] == pytest.approx([np.percentile(v, p) for p in (10, 50, 99)])


def test_ungrouped_quantiles(frame, sample):
    assert ranks.quantiles(frame, [], "v", {"m": 0.5}).first()["m"] == np.median([r[3] for r in sample])


def test_auroc_cliff_and_symmetry(frame, sample):
    got = {r["g"]: r for r in stats.two_sample(frame, ["g"], "v").collect()}
    flipped = {r["g"]: r["auroc"] for r in stats.two_sample(frame.withColumn("v", -F.col("v")), ["g"], "v").collect()}
    for g, rs in groups(sample).items():
        want = auroc([r[3] for r in rs if r[2] == 1], [r[3] for r in rs if r[2] == 0])
        assert got[g]["auroc"] == pytest.approx(want)
        assert got[g]["cliff"] == pytest.approx(2 * want - 1)
        assert got[g]["auroc"] + flipped[g] == pytest.approx(1)


def test_mann_whitney_p_small_case(spark):
    df = spark.createDataFrame([("x", 1, float(v)) for v in (1, 2, 3, 9, 9)] + [("x", 0, float(v)) for v in (4, 5, 6, 9)], "g string, label int, v double")
    r = stats.mann_whitney(df, ["g"], "v").first()
    n1, n0, n, ties = 5, 4, 9, 3**3 - 3
    sd = math.sqrt(n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (abs(r["u"] - n1 * n0 / 2) - 0.5) / sd
    assert r["u"] == 7.0
    assert r["mwu_p"] == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_chi_square_tail(spark):
    df = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3), (11.070497693516351, 5)], "h double, k int")
    assert [r[0] for r in df.select(stats.chi2_tail("h", "k")).collect()] == pytest.approx([0.05] * 4, abs=1e-9)


@pytest.mark.parametrize("k,n,p", [(0, 9, 2 / 512), (4, 9, 1.0), (2, 9, 2 * (1 + 9 + 36) / 512), (5, 5, 2 / 32)])
def test_sign_test(spark, k, n, p):
    df = spark.createDataFrame([(k, n)], "k long, n long")
    assert df.select(stats.sign_test_p(F.col("k"), F.col("n"))).first()[0] == pytest.approx(p)


def test_spearman_and_partials(frame, sample):
    rho = dict(rows_of(stats.spearman(frame, ["g"], "v", "y"), "g", "rho"))
    part = dict(rows_of(stats.partial_spearman(frame, ["g"], "v", "y", "z"), "g", "rho"))
    strat = dict(rows_of(stats.partial_spearman_strata(frame, ["g"], "v", "y", "s"), "g", "rho"))
    for g, rs in groups(sample).items():
        rx, ry, rz = (np.array(avg_ranks([r[i] for r in rs])) for i in (3, 4, 5))
        assert rho[g] == pytest.approx(corr(rx, ry))
        zz = np.vstack([rz, np.ones_like(rz)]).T
        res = [a - zz @ np.linalg.lstsq(zz, a, rcond=None)[0] for a in (rx, ry)]
        assert part[g] == pytest.approx(corr(*res))
        lv = np.array([r[6] for r in rs])
        cx, cy = rx.copy(), ry.copy()
        for s in "abcd":
            cx[lv == s] -= rx[lv == s].mean()
            cy[lv == s] -= ry[lv == s].mean()
        assert strat[g] == pytest.approx(corr(cx, cy))


def test_row_order_does_not_matter(frame):
    a = rows_of(stats.spearman(frame, ["g"], "v", "y"), "g", "n", "rho")
    b = rows_of(stats.spearman(frame.orderBy(F.desc("id")).repartition(3), ["g"], "v", "y"), "g", "n", "rho")
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("variant", ["A", "B"])
def test_tpr_thresholds_differ_by_one_order_statistic(spark, variant):
    neg = list(range(20))
    pos = [18.5, 17.5, 3.0, 19.5]
    df = spark.createDataFrame([("s", 0, float(v)) for v in neg] + [("s", 1, float(v)) for v in pos], "system string, label int, s double")
    r = pair_eval.tpr_at_fpr(df, variant=variant).first()
    desc = sorted(neg, reverse=True)
    thr = desc[max(0, int(0.05 * 20) - 1)] if variant == "A" else desc[int(0.05 * 20)]
    assert r["threshold"] == thr
    assert r["tpr"] == sum(p > thr for p in pos) / 4
    assert r["actual_fpr"] == sum(n > thr for n in neg) / 20


def test_pair_accuracy_ties_missing_and_direction(spark):
    rows = [(1, 1, "s", 3.0), (1, 0, "s", 1.0), (2, 1, "s", 2.0), (2, 0, "s", 2.0), (3, 1, "s", 9.0), (4, 0, "s", 5.0), (5, 1, "s", 0.0), (5, 0, "s", 4.0)]
    df = spark.createDataFrame(rows, "pair_id int, label int, system string, value double")
    up = pair_eval.pair_accuracy(pair_eval.orient(df, {})).first()
    down = pair_eval.pair_accuracy(pair_eval.orient(df, {"s": -1})).first()
    assert (up["n_pairs"], up["wins"], up["ties"], up["pair_acc"]) == (3, 1, 1, 0.5)
    assert down["pair_acc"] == 0.5 and down["wins"] == 1
    assert pair_eval.auroc(pair_eval.orient(df, {})).first()["n_pos"] == 4  # all items, not only complete pairs


def test_best_f1_equals_exhaustive_sweep(spark):
    rng = random.Random(3)
    pos, neg = [rng.randint(0, 12) / 2 for _ in range(30)], [rng.randint(-4, 9) / 2 for _ in range(40)]

    def f1(t):
        tp, fp = sum(x > t for x in pos), sum(x > t for x in neg)
        p, r = (tp / (tp + fp) if tp + fp else 0.0), tp / len(pos)
        return 2 * p * r / (p + r) if p + r else 0.0

    df = spark.createDataFrame([("s", 1, v, 1) for v in pos] + [("s", 0, v, 1) for v in neg], "system string, label int, value double, d int").withColumn("s", F.col("value"))
    vals = sorted(set(pos + neg))
    assert pair_eval.best_f1(df).first()["f1"] == pytest.approx(max(f1(t) for t in [*vals, vals[0] - 1]))


def test_kruskal_and_wilcoxon_reference_values(spark):
    data = {"a": [2.9, 3.0, 2.5, 2.6, 3.2], "b": [3.8, 2.7, 4.0, 2.4], "c": [2.8, 3.4, 3.7, 2.2, 2.0]}
    df = spark.createDataFrame([("x", g, v) for g, vs in data.items() for v in vs], "grp string, g string, v double")
    r = stats.kruskal_with_p(df, ["grp"], "v", "g").first()
    assert r["h"] == pytest.approx(0.7714285714285722)
    assert r["p"] == pytest.approx(0.6799647735788936)
    d = spark.createDataFrame([("x", float(v)) for v in (6, 8, 14, 16, 23, 24, 28, 29, 41, -48, 49, 56, 60, -67, 75, 0)], "k string, d double")
    w = stats.wilcoxon_with_p(d, ["k"], "d").first()
    assert (w["n"], w["w"]) == (15, 24.0)


def test_logistic_fits_recover_the_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.4 + 1.3 * x)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "v double, label int")
    cal = stats.fit_calibration(df, "v")
    z = (x - x.mean()) / x.std()
    p = 1 / (1 + np.exp(-(cal["a"] + cal["b"] * z)))
    grad = np.array([(y - p).sum() - 2e-3 * cal["a"], ((y - p) * z).sum() - 2e-3 * cal["b"]])
    assert np.abs(grad).max() < 1e-6
    terms = dict(rows_of(stats.fit_logistic(df, ["v"], "label"), "term", "coefficient"))
    q = 1 / (1 + np.exp(-(terms["intercept"] + terms["v"] * z)))
    assert abs((y - q).sum()) < 1e-4


def test_poststratification_weights_sum_to_n(frame):
    w = stats.poststratify(frame, "g", "s").groupBy("g").agg(F.sum("weight").alias("w"), F.count("weight").alias("n")).collect()
    assert all(r["w"] == pytest.approx(r["n"]) for r in w)


def test_bootstrap_is_reproducible_and_covers(frame):
    a = resample.bootstrap_mean(frame.where("g = 'mild'"), ["g"], "id", "v", 60).first()
    b = resample.bootstrap_mean(frame.where("g = 'mild'").repartition(7), ["g"], "id", "v", 60).first()
    assert (a["ci_low"], a["ci_high"]) == (pytest.approx(b["ci_low"]), pytest.approx(b["ci_high"]))
    assert a["ci_low"] < a["mean"] < a["ci_high"]
    n = resample.resample(frame.where("g = 'mild'"), ["g"], "id", 5).groupBy("rep").agg(F.sum("copies").alias("n")).collect()
    assert {r["n"] for r in n} == {frame.where("g = 'mild'").count()}


def test_retrieval_rank_is_exact(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(60, 8)), rng.normal(size=(60, 8))
    left = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], "pair_id long, vec array<double>")
    right = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(b)], "pair_id long, vec array<double>")
    got = dict(rows_of(pair_eval.retrieval_ranks(left, right, block=16), "pair_id", "rank"))
    s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert got == {i: int(1 + (s[i] > s[i, i]).sum()) for i in range(60)}


def test_replicate_draws_are_poisson_and_keyed():
    rng = np.random.default_rng(2)
    high, low = (rng.integers(0, 2**32, 3000) for _ in range(2))
    copies = resample.draws(high, low, 400)
    share = [np.mean(copies == k) for k in range(4)]
    assert share == pytest.approx([math.exp(-1), math.exp(-1), math.exp(-1) / 2, math.exp(-1) / 6], abs=2e-3)
    assert abs(np.corrcoef(copies[:, 0], copies[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(copies[0], copies[1])[0, 1]) < 0.2
    assert (resample.draws(high[:5], low[:5], 400) == copies[:5]).all()
    assert not (resample.draws(high[:5], low[5:10], 400) == copies[:5]).all()


def test_replicate_sums_equal_a_plain_sum(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(i) % 700 if i < 900 else None, float(rng.normal()) if i % 50 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g int, v double").repartition(5)
    got = resample.replicate_sums(df, ["g"], "id", ["v"], 30).collect()
    digest = [hashlib.md5(f"{i}:0".encode()).hexdigest() for i, *_ in rows]
    copies = resample.draws(np.array([int(d[:8], 16) for d in digest]), np.array([int(d[8:16], 16) for d in digest]), 30)
    want = {}
    for (_, g, v), c in zip(rows, copies):
        want[g] = want.get(g, 0) + c * (v or 0.0)
    assert len(got) == 30 * len(want)
    for r in got:
        assert r["v"] == pytest.approx(want[r["g"]][r["rep"] - 1], abs=1e-9)


def test_bootstrap_width_is_the_standard_error(spark):
    rng = np.random.default_rng(4)
    v = rng.gamma(2.0, size=4000)
    df = spark.createDataFrame([(i, i % 2, float(x)) for i, x in enumerate(v)], "id long, label int, v double")
    one = resample.bootstrap_mean(df.withColumn("g", F.lit("a")), ["g"], "id", "v", 2000).first()
    assert one["ci_high"] - one["ci_low"] == pytest.approx(2 * 1.96 * v.std() / math.sqrt(len(v)), rel=0.08) and one["replicates"] == 2000
    two = resample.bootstrap_difference(df.withColumn("g", F.lit("a")), ["g"], "id", "v", "label", 2000).first()
    assert two["ci_low"] < two["difference"] < two["ci_high"]


def test_fits_tell_whether_they_converged(spark):
    apart = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, y int")
    mixed = spark.createDataFrame([(float(i), int(i > 5) ^ int(i in (2, 8))) for i in range(12)], "x double, y int")
    assert not stats.fit_logistic(apart, ["x"], "y", 5).first()["converged"]
    assert stats.fit_logistic(mixed, ["x"], "y").first()["converged"] and stats.fit_calibration(mixed, "x", "y")["converged"]


@pytest.mark.parametrize("by", [["g"], []])
def test_numbering_of_large_groups_equals_that_of_small_ones(spark, by):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), i, rng.randrange(40)) for i in range(4000)] + [("c", 5000, 1), (None, 5001, 2), ("a", 5002, None)]
    df = spark.createDataFrame(rows, "g string, id long, v int").withColumn("k", F.struct("v", "id")).withColumn("k", F.when(F.col("v").isNotNull(), F.col("k")))
    got = {r["id"]: r["rn"] for r in ranks.numbered(df, by, "k", large=300).collect()}
    want = {r["id"]: r["rn"] for r in ranks.numbered(df, by, "k").collect()}
    kept = [r for r in rows if r[2] is not None and (r[0] is not None or not by)]
    model = {i: 1 + sum((v, i) > (w, j) for h, j, w in kept if not by or h == g) for g, i, v in kept[:50] + kept[-2:]}
    assert got == want and len(got) == len(kept) and all(got[i] == n for i, n in model.items())


def test_numbering_of_small_groups_moves_rows_once(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("g"), "id")
    out = ranks.numbered(df, ["g"], "id")
    out.collect()
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count(" Exchange ") == 1
