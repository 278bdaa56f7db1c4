"""Statistics over groups: rank tests, correlations, calibration, weighting and yearly splits.

Order-based statistics share the rank core; the rest are plain (partially aggregated) sums. No
operator sorts a whole group in one task, and group statistics return to the rows by join, not
by a window over the group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkstat.operators import ranks
from inkstat.session import cut

# --------------------------------------------------------------------------- tail probabilities


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|); applied to one row per group."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def chi2_tail(h: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi2_df >= h) by the finite recurrence for integer degrees of freedom."""

    def tail(x, k):
        if x is None or x != x or k < 1:
            return None
        half = x / 2.0
        q, term, start = (math.exp(-half), math.exp(-half), 2) if k % 2 == 0 else (math.erfc(math.sqrt(half)), 0.0, 1)
        if k % 2 == 1:
            term = math.sqrt(2 * x / math.pi) * math.exp(-half)
        for j in range(start, int(k), 2):
            if k % 2 == 0:
                term *= half / (j / 2)
                q += term
            else:
                q += term
                term *= x / (j + 2)
        return min(1.0, q)

    return pd.Series([tail(x, k) for x, k in zip(h, df)])


def sign_test_p(k: Column, n: Column) -> Column:
    """Two-sided exact binomial(n, 1/2) p of k successes, n small (a count of years)."""
    low = F.least(k, n - k)
    body = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), low),
        F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, j: F.struct((acc["term"] * (n - j) / (j + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.least(F.lit(1.0), 2 * body)


# --------------------------------------------------------------------------- describe and groups


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, min, max; nulls and NaN leave before anything is counted."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cell = ranks.rank_cells(ok, by, value)
    v = F.col(value).cast("double")
    basic = cell.groupBy(*by).agg((F.sum(v * F.col("n")) / F.sum("n")).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return ranks.quantiles_from(cell, by, value, {"median": 0.5}).join(basic, list(by)) if by else _side_by_side(
        ranks.quantiles_from(cell, by, value, {"median": 0.5}), basic)


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two single-row frames."""
    return a.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one").drop("_one")


def two_sample(df: DataFrame, by: Sequence[str], value: str, label: str = "label") -> DataFrame:
    """AUROC, Cliff's delta, Mann-Whitney U and tie-corrected z of label 1 against label 0.

    z uses the continuity correction; ``mwu_p`` is its two-sided normal tail.
    """
    cell = ranks.cells(
        df, by, value, n_pos=F.count_if(F.col(label) == 1), n_neg=F.count_if(F.col(label) == 0)
    )
    cell = ranks.cumulate(cell, by, value, ["n_pos", "n_neg"])
    t = (F.col("n_pos") + F.col("n_neg")).cast("double")
    out = cell.groupBy(*by).agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"),
        F.sum(F.col("n_pos").cast("double") * (F.col("before_n_neg") + 0.5 * F.col("n_neg"))).alias("u"),
        F.sum(t * t * t - t).alias("_ties"),
    ).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    gap = F.col("u") - n1 * n0 / 2
    return (
        out.withColumn("auroc", F.col("u") / (n1 * n0))
        .withColumn("cliff", 2 * F.col("auroc") - 1)
        .withColumn("z", F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)) / F.nullif(sd, F.lit(0.0)))
        .drop("_ties")
    )


def mann_whitney(df: DataFrame, by: Sequence[str], value: str, label: str = "label") -> DataFrame:
    return two_sample(df, by, value, label).withColumn("mwu_p", normal_two_sided("z"))


def compare_groups(df: DataFrame, by: Sequence[str], value: str, label: str = "label") -> DataFrame:
    """describe of both sides next to Cliff's delta and both AUROC orientations."""
    d = describe(df, [*by, label], value)
    wide = d.groupBy(*by).agg(*[
        F.max(F.when(F.col(label) == lab, F.col(c))).alias(f"{tag}_{c}")
        for lab, tag in ((1, "pos"), (0, "neg")) for c in ("mean", "median", "min", "max")
    ])
    return two_sample(df, by, value, label).join(wide, list(by)).withColumn("auroc_neg_over_pos", 1 - F.col("auroc"))


def confound_audit(df: DataFrame, by: Sequence[str], value: str, limit: float = 0.70) -> DataFrame:
    """AUROC of a trivial feature against the label; flagged above ``limit``, with side medians."""
    med = ranks.quantiles(df, [*by, "label"], value, {"m": 0.5}).groupBy(*by).agg(
        F.max(F.when(F.col("label") == 1, F.col("m"))).alias("pos_median"), F.max(F.when(F.col("label") == 0, F.col("m"))).alias("neg_median"))
    return two_sample(df, by, value).join(med, list(by)).select(
        *by, "auroc", (F.col("auroc") > limit).alias("flagged"), "pos_median", "neg_median")


# --------------------------------------------------------------------------- rank correlation


def rank_table(df: DataFrame, by: Sequence[str], cols: Sequence[str], extra: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Distinct (by, extra, cols) rows with multiplicity ``n`` and centred average ranks ``r_<col>``."""
    by, cols = list(by), list(cols)
    ok = df
    for c in cols:
        ok = ok.where(F.col(c).isNotNull())
    mult = F.sum(weight) if weight else F.count(F.lit(1))
    base = ok.groupBy(*by, *extra, *cols).agg(mult.alias("n"))
    out = base
    for c in cols:
        cell = base.groupBy(*by, c).agg(F.sum("n").alias("n"))
        table = ranks.cumulate(cell, by, c, ["n"]).select(
            *by, c, (F.col("before_n") + F.col("n") / 2.0 - F.col("total_n") / 2.0).alias(f"r_{c}"))
        out = out.join(table, [*by, c])
    return out


def _dot(a: str, b: str) -> Column:
    return F.sum(F.col(a) * F.col(b) * F.col("n"))


def _rho(sxy: Column, sxx: Column, syy: Column) -> Column:
    return sxy / F.nullif(F.sqrt(sxx * syy), F.lit(0.0))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 2, min_distinct: int = 1, weight: str | None = None) -> DataFrame:
    """Spearman with average ranks; null when a side is constant, no row below the guards."""
    rx, ry = f"r_{x}", f"r_{y}"
    out = rank_table(df, by, [x, y], weight=weight).groupBy(*by).agg(
        F.sum("n").alias("n"), _rho(_dot(rx, ry), _dot(rx, rx), _dot(ry, ry)).alias("rho"),
        *([F.count_distinct(x).alias("_dx"), F.count_distinct(y).alias("_dy")] if min_distinct > 1 else []),
    ).where(F.col("n") >= min_n)
    if min_distinct > 1:
        out = out.where((F.col("_dx") >= min_distinct) & (F.col("_dy") >= min_distinct)).drop("_dx", "_dy")
    return out


def spearman_ordinal(df: DataFrame, by: Sequence[str], x: str, y: str, key: str, min_n: int = 4) -> DataFrame:
    """Spearman on ordinal ranks: ties are ordered by ``key``."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, *[F.struct(c, key).alias(f"_{i}") for i, c in enumerate((x, y))])
    # numbers are added to the rows, nothing is joined back by key
    first = ranks.numbered(ok, by, "_0", "_r0").drop("_0")
    both = ranks.numbered(first, by, "_1", "_r1", like=ok)
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_r0", "_r1").alias("rho")).where(F.col("n") >= min_n)


def partial_spearman(df: DataFrame, by: Sequence[str], x: str, y: str, z: str, min_n: int = 3) -> DataFrame:
    """Rank correlation of x and y after removing the linear effect of the rank of z."""
    r = {c: f"r_{c}" for c in (x, y, z)}
    s = rank_table(df, by, [x, y, z]).groupBy(*by).agg(
        F.sum("n").alias("n"),
        *[_rho(_dot(r[a], r[b]), _dot(r[a], r[a]), _dot(r[b], r[b])).alias(k) for a, b, k in ((x, y, "_xy"), (x, z, "_xz"), (y, z, "_yz"))],
    ).where(F.col("n") >= min_n)
    num = F.col("_xy") - F.col("_xz") * F.col("_yz")
    den = F.sqrt((1 - F.col("_xz") * F.col("_xz")) * (1 - F.col("_yz") * F.col("_yz")))
    return s.select(*by, "n", (num / F.nullif(den, F.lit(0.0))).alias("rho"))


def partial_spearman_strata(df: DataFrame, by: Sequence[str], x: str, y: str, stratum: str) -> DataFrame:
    """Correlation of ranks after subtracting the stratum mean rank on both sides."""
    rx, ry = f"r_{x}", f"r_{y}"
    per = rank_table(df, by, [x, y], extra=[stratum]).groupBy(*by, stratum).agg(
        F.sum("n").alias("_n"), F.sum(F.col(rx) * F.col("n")).alias("_x"), F.sum(F.col(ry) * F.col("n")).alias("_y"),
        _dot(rx, ry).alias("_xy"), _dot(rx, rx).alias("_xx"), _dot(ry, ry).alias("_yy"))
    within = [F.sum(F.col(f"_{a}{b}") - F.col(f"_{a}") * F.col(f"_{b}") / F.col("_n")) for a, b in ("xy", "xx", "yy")]
    return per.groupBy(*by).agg(F.sum("_n").alias("n"), _rho(*within).alias("rho"))


def within_stratum(df: DataFrame, by: Sequence[str], x: str, y: str, stratum: str, min_cell: int = 25) -> DataFrame:
    """Spearman inside each cell of at least ``min_cell`` rows: n-weighted pool, plain mean, negatives."""
    cell = spearman(df, [*by, stratum], x, y, min_n=min_cell).where(F.col("rho").isNotNull())
    return cell.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("rho")) / F.sum("n")).alias("pooled_rho"),
        F.avg("rho").alias("mean_rho"), F.count_if(F.col("rho") < 0).alias("n_negative"))


# --------------------------------------------------------------------------- tests on more groups


def kruskal_wallis(df: DataFrame, by: Sequence[str], value: str, group: str) -> DataFrame:
    """Tie-corrected H over the levels of ``group`` with its chi-square tail."""
    by = list(by)
    base = df.where(F.col(value).isNotNull()).groupBy(*by, value, group).agg(F.count(F.lit(1)).alias("m"))
    cell = ranks.cumulate(base.groupBy(*by, value).agg(F.sum("m").alias("n")), by, value, ["n"])
    ranked = base.join(cell.withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2.0), [*by, value])
    per = ranked.groupBy(*by, group).agg(F.sum("m").alias("_n"), F.sum(F.col("rank") * F.col("m")).alias("_r"))
    sums = per.groupBy(*by).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"))
    t = F.col("n").cast("double")
    ties = cell.groupBy(*by).agg(F.sum(t * t * t - t).alias("_t"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("_t") / (n * n * n - n))
    return sums.join(ties, by).select(*by, "n", "k", h.alias("h"))


def kruskal_with_p(df: DataFrame, by: Sequence[str], value: str, group: str) -> DataFrame:
    return kruskal_wallis(df, by, value, group).withColumn("p", chi2_tail("h", F.col("k") - 1))


def wilcoxon(df: DataFrame, by: Sequence[str], diff: str, min_n: int = 5) -> DataFrame:
    """Signed-rank test of paired differences: zeros removed, W = smaller rank sum, normal z."""
    nonzero = df.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).withColumn("_a", F.abs(F.col(diff)))
    cell = ranks.cells(nonzero, by, "_a", n=F.count(F.lit(1)), up=F.count_if(F.col(diff) > 0))
    cell = ranks.cumulate(cell, by, "_a", ["n"]).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2.0)
    t = F.col("n").cast("double")
    s = cell.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"),
        F.sum(t * t * t - t).alias("_t")).where(F.col("n") >= min_n)
    n = F.col("n").cast("double")
    w = F.least("w_plus", "w_minus")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48)
    return s.select(*by, "n", "w_plus", "w_minus", w.alias("w"), z.alias("z"))


def wilcoxon_with_p(df: DataFrame, by: Sequence[str], diff: str, min_n: int = 5) -> DataFrame:
    return wilcoxon(df, by, diff, min_n).withColumn("p", normal_two_sided("z"))


def cohens_d(df: DataFrame, by: Sequence[str], value: str, flag: str) -> DataFrame:
    """(mean without flag - mean with flag) / sqrt(mean of the two population variances)."""
    yes, no = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), ((F.avg(no) - F.avg(yes)) / F.sqrt((F.var_pop(yes) + F.var_pop(no)) / 2)).alias("d"))


# --------------------------------------------------------------------------- logistic fits


def _newton(step, start: list[float], iterations: int, tolerance: float = 1e-10) -> tuple[list[float], int, bool]:
    """Coefficients, steps taken, and whether the last step was below the tolerance."""
    import numpy as np

    beta, turn, still = np.array(start, dtype=float), 0, False
    while turn < iterations and not still:
        gradient, hessian = step(beta)
        move = np.linalg.solve(hessian, gradient)
        if not np.isfinite(move).all():
            break
        beta, turn, still = beta + move, turn + 1, bool(np.abs(move).max() < tolerance)
    return [float(b) for b in beta], turn, still


def _newton_sums(df: DataFrame, xs: Sequence[Column], beta, y: Column, weight: Column) -> tuple:
    """Gradient and information matrix of the logistic log-likelihood: one aggregate row."""
    import numpy as np

    k = len(xs)
    t = F.lit(0.0)
    for b, x in zip(beta, xs):
        t = t + F.lit(float(b)) * x
    p = 1 / (1 + F.exp(-t))
    grad = [F.sum(weight * (y - p) * x).alias(f"g{i}") for i, x in enumerate(xs)]
    info = [F.sum(weight * p * (1 - p) * xs[i] * xs[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
    row = df.agg(*grad, *info).first()
    h = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
    return np.array([row[f"g{i}"] for i in range(k)]), h


def fit_calibration(df: DataFrame, value: str, label: str = "label", ridge: float = 1e-3, iterations: int = 40) -> dict[str, float]:
    """1-D logistic of the label on the standardized score with an L2 term on both coefficients.

    The data are first reduced to distinct (value, label) counts, stored once; every Newton step is one
    aggregate over them and only the two coefficients reach the driver. ``converged`` is false where the steps did not end.
    """
    import numpy as np

    cell = cut(df.where(F.col(value).isNotNull()).groupBy(value, label).agg(F.count(F.lit(1)).alias("n")))
    v, w = F.col(value).cast("double"), F.col("n")
    m = cell.agg((F.sum(v * w) / F.sum(w)).alias("mu"), F.sum(v * v * w).alias("ss"), F.sum(w).alias("n")).first()
    var = cell.agg((F.sum((v - F.lit(m["mu"])) * (v - F.lit(m["mu"])) * w) / F.sum(w)).alias("v")).first()["v"]
    sd = math.sqrt(var) or 1.0
    xs = [F.lit(1.0), (v - F.lit(m["mu"])) / F.lit(sd)]

    def step(beta):
        g, h = _newton_sums(cell, xs, beta, F.col(label).cast("double"), w)
        return g - 2 * ridge * beta, h + 2 * ridge * np.eye(2)

    (a, b), turns, converged = _newton(step, [0.0, 0.0], iterations)
    return {"a": a, "b": b, "mu": float(m["mu"]), "sd": sd, "n": int(m["n"]), "iterations": turns, "converged": converged}


def apply_calibration(value: Column, cal: dict[str, float]) -> Column:
    return 1 / (1 + F.exp(-(F.lit(cal["a"]) + F.lit(cal["b"]) * (value - F.lit(cal["mu"])) / F.lit(cal["sd"]))))


def fit_logistic(df: DataFrame, predictors: Sequence[str], label: str, iterations: int = 60) -> DataFrame:
    """k-D Newton logistic on standardized predictors; one row per term, with whether the steps ended (separable data never do)."""
    import numpy as np

    ok = df.where(F.col(label).isNotNull())
    for p in predictors:
        ok = ok.where(F.col(p).isNotNull())
    s = ok.agg(*[F.avg(p).alias(f"m_{p}") for p in predictors], *[F.stddev_pop(p).alias(f"s_{p}") for p in predictors]).first()
    ok = cut(ok.select(*dict.fromkeys([*predictors, label])))  # read by every step
    xs = [F.lit(1.0)] + [(F.col(p) - F.lit(float(s[f"m_{p}"]))) / F.lit(float(s[f"s_{p}"] or 1.0)) for p in predictors]
    y = F.col(label).cast("double")

    def step(beta):
        g, h = _newton_sums(ok, xs, beta, y, F.lit(1.0))
        return g, h + 1e-8 * np.eye(len(xs))

    beta, _, converged = _newton(step, [0.0] * len(xs), iterations, 1e-9)
    rows = [(term, b, converged) for term, b in zip(["intercept", *predictors], beta)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, converged boolean")


# --------------------------------------------------------------------------- normalization


def percentile_rank(df: DataFrame, by: Sequence[str], value: str, name: str = "pct") -> DataFrame:
    """Average rank / n * 100 inside the group."""
    cell = ranks.rank_cells(df, by, value).select(*by, value, (F.col("avg_rank") / F.col("total_n") * 100).alias(name))
    return df.join(cell, [*by, value])


def ordinal_percentile(df: DataFrame, by: Sequence[str], value: str, key: str, name: str = "pct") -> DataFrame:
    """(position - 1) / (n - 1), equal values ordered by ``key``."""
    ok = df.where(F.col(value).isNotNull()).withColumn("_o", F.struct(F.col(value), F.col(key)))
    cell = ranks.cumulate(ranks.cells(ok, by, "_o"), by, "_o", ["n"]).select(
        *by, F.col(f"_o.{key}").alias(key), (F.col("before_n") / F.greatest(F.lit(1), F.col("total_n") - 1)).alias(name))
    return df.join(cell, [*by, key])


def robust_minmax(df: DataFrame, by: Sequence[str], value: str, name: str = "mm") -> DataFrame:
    """(v - p1) / (p99 - p1) clipped to [0, 1]; apply to oriented scores for a direction."""
    q = ranks.quantiles(df, by, value, {"_p1": 0.01, "_p99": 0.99}).drop("n")
    raw = (F.col(value) - F.col("_p1")) / F.greatest(F.lit(1e-12), F.col("_p99") - F.col("_p1"))
    return df.join(q, list(by)).withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))).drop("_p1", "_p99")


def definitional(value: Column, kind: Column) -> Column:
    """Map a score to [0, 1] by what it is: a fraction stays, a 1-10 rating is reversed, else null."""
    mapped = F.when(kind == "fraction", value).when(kind == "rating10", (10.0 - value) / 9.0)
    return F.when(mapped.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), mapped)))


def zscores(df: DataFrame, by: Sequence[str], columns: Sequence[str], composite: str | None = None) -> DataFrame:
    """Add z_<col> (population sd inside ``by``) and their plain mean as ``composite``."""
    st = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.join(st, list(by))
    out = out.withColumns({f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns})
    if composite:
        z = F.array_compact(F.array(*[F.col(f"z_{c}") for c in columns]))
        out = out.withColumn(composite, F.aggregate(z, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(z), F.lit(0)))
    return out.drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def centred(df: DataFrame, by: Sequence[str], inner: str, value: str, name: str) -> DataFrame:
    """value - mean of its ``inner`` group + mean over ``by`` (each from one aggregate)."""
    cell = df.groupBy(*by, inner).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    total = cell.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("_all"))
    means = cell.join(total, list(by)).select(*by, inner, (F.col("_all") - F.col("_s") / F.col("_n")).alias("_shift"))
    return df.join(means, [*by, inner]).withColumn(name, F.col(value) + F.col("_shift")).drop("_shift")


def half_point(rating: Column) -> Column:
    return F.bround(rating * 2, 0) / 2


def level_means(df: DataFrame, by: Sequence[str], level: Column, value: str, min_cell: int) -> DataFrame:
    """Mean, population sd and n per rounded rating level holding at least ``min_cell`` rows."""
    return df.groupBy(*by, level.alias("level")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).where(F.col("n") >= min_cell)


# --------------------------------------------------------------------------- weighting


def poststratify(df: DataFrame, level: str, stratum: str) -> DataFrame:
    """Weights that give every level the pooled stratum mix, on strata present in every level.

    Rows in other strata get a null weight (the dropped ones). Weight = (target share of the
    stratum) / (its share inside the level), both over the common support.
    """
    cells = df.groupBy(level, stratum).agg(F.count(F.lit(1)).alias("_c"))
    n_levels = cells.agg(F.count_distinct(level).alias("_levels"))
    common = (
        cells.groupBy(stratum).agg(F.count(F.lit(1)).alias("_k"), F.sum("_c").alias("_t"))
        .withColumn("_one", F.lit(1)).join(F.broadcast(n_levels.withColumn("_one", F.lit(1))), "_one")
        .where(F.col("_k") == F.col("_levels")).select(stratum, "_t", "_one")
    )
    target = common.join(F.broadcast(common.groupBy("_one").agg(F.sum("_t").alias("_nt"))), "_one").select(stratum, (F.col("_t") / F.col("_nt")).alias("_share"))
    kept = cells.join(target, stratum)
    per_level = kept.groupBy(level).agg(F.sum("_c").alias("_nl"))
    weights = kept.join(per_level, level).select(level, stratum, (F.col("_share") / (F.col("_c") / F.col("_nl"))).alias("weight"))
    return df.join(weights, [level, stratum], "left")


def weighted_mean(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.where(F.col(weight).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("wmean"), F.sum(weight).alias("wsum"))


# --------------------------------------------------------------------------- yearly splits


def split_tags(df: DataFrame, by: Sequence[str], rating: str = "rating", decision: str = "grp") -> DataFrame:
    """Repeat each row per split definition it belongs to: (split, side low|high).

    tercile/quartile by the percentiles of the rating inside ``by``, decision reject vs oral,
    absolute <= 4 vs >= 7.
    """
    q = ranks.quantiles(df, by, rating, {"q33": 0.33333, "q67": 0.66667, "q25": 0.25, "q75": 0.75}).drop("n")
    r = F.col(rating)
    rules = {
        ("tercile", "low"): r <= F.col("q33"), ("tercile", "high"): r >= F.col("q67"),
        ("quartile", "low"): r <= F.col("q25"), ("quartile", "high"): r >= F.col("q75"),
        ("decision", "low"): F.col(decision) == "reject", ("decision", "high"): F.col(decision) == "oral",
        ("absolute", "low"): r <= 4, ("absolute", "high"): r >= 7,
    }
    tags = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("split"), F.lit(d).alias("side"))) for (s, d), c in rules.items()]))
    return df.join(q, list(by)).withColumn("_t", F.explode(tags)).select(*df.columns, "_t.split", "_t.side")


def share_above_median(df: DataFrame, by: Sequence[str], value: str, min_rows: int = 20) -> DataFrame:
    """Flag ``hit``: above the group's median; where the median is an extreme (or only two values
    exist) the carriers are the rows at the top value."""
    cell = ranks.rank_cells(df, by, value)
    med = ranks.quantiles_from(cell, by, value, {"_med": 0.5})
    ends = cell.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_d"))
    rule = med.join(ends, list(by)).where(F.col("n") >= min_rows).drop("n")
    binary = (F.col("_d") <= 2) | (F.col("_med") == F.col("_lo")) | (F.col("_med") == F.col("_hi"))
    hit = F.when(binary, F.col(value) >= F.col("_hi")).otherwise(F.col(value) > F.col("_med"))
    return df.join(rule, list(by)).withColumn("hit", hit.cast("int")).drop("_med", "_lo", "_hi", "_d")


def yearly_gap(df: DataFrame, min_side: int = 8) -> DataFrame:
    """Share of low- and high-rated papers above the year's median score and the gap, per split."""
    by = ["year", "system"]
    flagged = share_above_median(df, by, "value")
    keyed = split_tags(df.select("year", "paper_id", "rating", "grp").distinct(), ["year"])
    cell = flagged.select(*by, "paper_id", "hit").join(keyed.select("year", "paper_id", "split", "side"), ["year", "paper_id"]).groupBy(
        *by, "split").agg(
        F.count_if(F.col("side") == "low").alias("n_low"), F.count_if(F.col("side") == "high").alias("n_high"),
        (100 * F.avg(F.when(F.col("side") == "low", F.col("hit")))).alias("share_low"),
        (100 * F.avg(F.when(F.col("side") == "high", F.col("hit")))).alias("share_high"))
    return cell.where((F.col("n_low") >= min_side) & (F.col("n_high") >= min_side)).withColumn("gap", F.col("share_high") - F.col("share_low"))


def gap_trend(gaps: DataFrame, by: Sequence[str], min_years: int = 4) -> DataFrame:
    """Mean/median gap, negative years, sign test and rank trend over years."""
    gaps = cut(gaps)  # a few rows per year, read three times below
    s = gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("years"), F.avg("gap").alias("mean_gap"), F.count_if(F.col("gap") < 0).alias("negative"),
    ).where(F.col("years") >= min_years).withColumn("sign_p", sign_test_p(F.col("negative"), F.col("years")))
    med = ranks.quantiles(gaps, by, "gap", {"median_gap": 0.5}).drop("n")
    return s.join(med, list(by)).join(spearman(gaps, by, "year", "gap").select(*by, F.col("rho").alias("trend_rho")), list(by))


def quartile_bin(df: DataFrame, by: Sequence[str], value: str, name: str = "bin") -> DataFrame:
    """0..3: how many of the group's quartile cuts are <= value."""
    q = ranks.quantiles(df, by, value, {"_a": 0.25, "_b": 0.5, "_c": 0.75}).drop("n")
    count = sum(((F.col(value) >= F.col(c)).cast("int") for c in ("_a", "_b", "_c")), F.lit(0))
    return df.join(q, list(by)).withColumn(name, count).drop("_a", "_b", "_c")


def tercile_outcomes(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Mean rating and accept rate of the low/middle/high score terciles."""
    q = ranks.quantiles(df, by, score, {"_a": 0.33333, "_b": 0.66667}).drop("n")
    s = F.col(score)
    third = F.when(s <= F.col("_a"), "low").when(s >= F.col("_b"), "high").otherwise("middle")
    return df.where(s.isNotNull()).join(q, list(by)).groupBy(*by, third.alias("tercile")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean_rating"), (100 * F.avg(F.col("accept").cast("int"))).alias("accept_rate"))


def grouped_auroc(df: DataFrame, by: Sequence[str], cell: str, value: str, min_side: int, label: str = "label") -> DataFrame:
    """AUROC per cell with at least ``min_side`` rows on both sides."""
    return two_sample(df, [*by, cell], value, label).where((F.col("n_pos") >= min_side) & (F.col("n_neg") >= min_side)).select(
        *by, cell, "n_pos", "n_neg", "auroc")


def common_subset(df: DataFrame, item: str, systems: Sequence[str]) -> DataFrame:
    """Rows of the items every listed system scored."""
    full = df.where(F.col("system").isin(list(systems))).groupBy(item).agg(F.count_distinct("system").alias("_k")).where(F.col("_k") == len(systems))
    return df.join(full.select(item), item, "left_semi")


def staircase(df: DataFrame, by: Sequence[str], level: str, value: str, n_levels: int) -> DataFrame:
    """Group statistics per ordered level 0..n_levels-1 with the step from the level below.

    ``delta_mean`` is the difference of means and ``cliff`` Cliff's delta against that level.
    """
    keys = [*by, level]
    basic = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    basic = basic.join(ranks.quantiles(df, keys, value, {"median": 0.5}), keys)
    below = basic.select(*by, (F.col(level) + 1).alias(level), F.col("mean").alias("_below"))
    steps = F.array_compact(F.array(
        F.when(F.col(level) > 0, F.struct(F.col(level).alias("to"), F.lit(1).alias("label"))),
        F.when(F.col(level) < n_levels - 1, F.struct((F.col(level) + 1).alias("to"), F.lit(0).alias("label")))))
    stepped = df.withColumn("_s", F.explode(steps)).select(*by, value, F.col("_s.to").alias(level), F.col("_s.label").alias("label"))
    cliff = two_sample(stepped, keys, value).select(*keys, "cliff")
    return basic.join(below, keys, "left").join(cliff, keys, "left").withColumn("delta_mean", F.col("mean") - F.col("_below")).drop("_below")


def cross_system(wide: DataFrame, systems: Sequence[str], min_n: int = 50) -> DataFrame:
    """Spearman for every pair of system columns of one wide row (no self-join)."""
    pairs = [(a, b) for i, a in enumerate(systems) for b in systems[i + 1:]]
    entries = [F.struct(F.lit(f"{a} x {b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs]
    return spearman(wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*"), ["pair"], "x", "y", min_n=min_n)


def rate_by_band(df: DataFrame, value: str, bands: Sequence[tuple[str, float, float]], flag: str, min_n: int) -> DataFrame:
    """Share of ``flag`` in right-open bands holding at least ``min_n`` rows, in percent."""
    band = F.lit(None).cast("string")
    for name, lo, hi in reversed(bands):
        band = F.when((F.col(value) >= lo) & (F.col(value) < hi), name).otherwise(band)
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(F.col(flag).cast("int"))).alias("accept_rate")).where(F.col("n") >= min_n)
