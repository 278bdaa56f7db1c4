"""Paired evaluation of scores: one row per pair side, any number of systems at once.

``scores`` is long: item_id, pair_id, label (1 positive, 0 negative), system, value. ``orient``
turns every system so that higher means more positive; all operators below work on the oriented
``s`` and group by ``by`` (at least the system, plus strata, draws, rounds ... as wanted).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstat.operators import ranks

SYSTEM = ("system",)


def orient(scores: DataFrame, directions: dict[str, int]) -> DataFrame:
    """Add ``d`` (+1/-1 per system, +1 when unlisted) and the oriented score ``s``."""
    d = F.lit(1)
    for system, sign in directions.items():
        d = F.when(F.col("system") == system, F.lit(sign)).otherwise(d)
    return scores.where(F.col("value").isNotNull()).withColumn("d", d).withColumn("s", F.col("value") * F.col("d"))


def sides(scores: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Complete pairs as (by, pair_id, a, h); pairs missing a side leave the denominator."""
    return (
        scores.groupBy(*by, "pair_id")
        .agg(
            F.max(F.when(F.col("label") == 1, F.col("s"))).alias("a"),
            F.max(F.when(F.col("label") == 0, F.col("s"))).alias("h"),
        )
        .where(F.col("a").isNotNull() & F.col("h").isNotNull())
    )


def pair_accuracy(scores: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """(wins + ties/2) / complete pairs."""
    return (
        sides(scores, by)
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("a") > F.col("h")).alias("wins"),
             F.count_if(F.col("a") == F.col("h")).alias("ties"))
        .withColumn("pair_acc", (F.col("wins") + 0.5 * F.col("ties")) / F.col("n_pairs"))
    )


def win_loss(scores: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Wins, losses, ties, paired Cliff (w-l)/n and the side means over complete pairs."""
    return (
        sides(scores, by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.count_if(F.col("a") > F.col("h")).alias("win"),
            F.count_if(F.col("a") < F.col("h")).alias("loss"),
            F.count_if(F.col("a") == F.col("h")).alias("tie"),
            F.avg("a").alias("mean_pos"),
            F.avg("h").alias("mean_neg"),
        )
        .withColumn("pair_acc", (F.col("win") + 0.5 * F.col("tie")) / F.col("n_pairs"))
        .withColumn("cliff", (F.col("win") - F.col("loss")) / F.col("n_pairs"))
    )


def label_cells(scores: DataFrame, by: Sequence[str] = SYSTEM, value: str = "s") -> DataFrame:
    """Distinct scores with positive/negative counts and the counts of all smaller scores."""
    cell = ranks.cells(
        scores, by, value,
        n_pos=F.count_if(F.col("label") == 1),
        n_neg=F.count_if(F.col("label") == 0),
    )
    return ranks.cumulate(cell, by, value, ["n_pos", "n_neg"])


def _auroc_sum() -> Column:
    return F.sum(F.col("n_pos").cast("double") * (F.col("before_n_neg") + 0.5 * F.col("n_neg")))


def auroc_from(cell: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """P(positive > negative) + P(tie)/2 over all available items, from rank sums."""
    return (
        cell.groupBy(*by)
        .agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), _auroc_sum().alias("_u"))
        .withColumn("auroc", F.col("_u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0)))
        .drop("_u")
    )


def auroc(scores: DataFrame, by: Sequence[str] = SYSTEM, value: str = "s") -> DataFrame:
    return auroc_from(label_cells(scores, by, value), by)


def _above(counter: str) -> Column:
    return F.col(f"total_{counter}") - F.col(f"before_{counter}") - F.col(f"n_{counter[2:]}")


def flagged(variant: str, fpr: float = 0.05) -> Column:
    """Cells strictly above the negatives' order statistic at ``fpr``.

    The threshold is the k-th largest negative (zero-based): ``A`` takes k = max(0, int(fpr*n)-1),
    ``B`` takes k = int(fpr*n). A cell lies above it exactly when at most k negatives score at
    least as high.
    """
    k = F.floor(F.col("total_n_neg") * F.lit(fpr))
    if variant == "A":
        k = F.greatest(F.lit(0), k - 1)
    return (F.col("total_n_neg") - F.col("before_n_neg")) <= k


def tpr_at_fpr(scores: DataFrame, by: Sequence[str] = SYSTEM, variant: str = "A", fpr: float = 0.05) -> DataFrame:
    """TPR and the actual FPR when everything strictly above the threshold is flagged."""
    hit = flagged(variant, fpr)
    return (
        label_cells(scores, by)
        .groupBy(*by)
        .agg(
            F.sum("n_pos").alias("n_pos"),
            F.sum("n_neg").alias("n_neg"),
            F.sum(F.when(hit, F.col("n_pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(hit, F.col("n_neg")).otherwise(0)).alias("fp"),
            F.max(F.when(~hit & (F.col("n_neg") > 0), F.col("s"))).alias("threshold"),
        )
        .withColumn("tpr", F.col("tp") / F.nullif(F.col("n_pos"), F.lit(0)))
        .withColumn("actual_fpr", F.col("fp") / F.nullif(F.col("n_neg"), F.lit(0)))
    )


def _prf(tp: Column, fp: Column, n_pos: Column) -> tuple[Column, Column, Column]:
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = tp / n_pos
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return precision, recall, f1


def prf_at_threshold(scores: DataFrame, by: Sequence[str] = SYSTEM, variant: str = "A") -> DataFrame:
    """Precision, recall, F1 at the threshold of ``tpr_at_fpr``."""
    base = tpr_at_fpr(scores, by, variant).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("n_pos"))
    return base.select(*by, "tp", "fp", p.alias("precision"), r.alias("recall"), f.alias("f1"), "actual_fpr")


def best_f1(scores: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Best F1 over all distinct scores as thresholds plus one that flags everything.

    Equal F1: the smallest raw score wins, and the flag-everything threshold only if strictly better.
    """
    cell = label_cells(scores.withColumn("s", F.struct("s", "value")), by).select(
        *by, F.col("s.s").alias("s"), F.col("s.value").alias("value"), "n_pos", "n_neg",
        "before_n_pos", "before_n_neg", "total_n_pos", "total_n_neg",
    ).where((F.col("total_n_pos") > 0) & (F.col("total_n_neg") > 0))
    tp, fp = (F.col(f"total_{c}") - F.col(f"before_{c}") - F.col(c) for c in ("n_pos", "n_neg"))
    p, r, f = _prf(tp, fp, F.col("total_n_pos"))
    ap, ar, af = _prf(F.col("total_n_pos"), F.col("total_n_neg"), F.col("total_n_pos"))
    swept = cell.select(
        *by,
        F.struct(f.alias("f1"), (-F.col("value")).alias("_o"), p.alias("precision"), r.alias("recall"), F.col("s").alias("threshold")).alias("c"),
        F.struct(af.alias("f1"), F.lit(0.0).alias("_o"), ap.alias("precision"), ar.alias("recall"), F.lit(None).cast("double").alias("threshold")).alias("e"),
    )
    best = swept.groupBy(*by).agg(F.max("c").alias("c"), F.first("e").alias("e"))
    pick = F.when(F.col("e.f1") > F.col("c.f1"), F.col("e")).otherwise(F.col("c"))
    return best.select(*by, pick.alias("b")).select(*by, "b.f1", "b.precision", "b.recall", "b.threshold")


def pooled_metrics(scores: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Pair accuracy, AUROC and TPR (variant A) in one table: the benchmark row of a system."""
    hit = flagged("A")
    ranked = (
        label_cells(scores, by)
        .groupBy(*by)
        .agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), _auroc_sum().alias("_u"),
             F.sum(F.when(hit, F.col("n_pos")).otherwise(0)).alias("_tp"))
    )
    return pair_accuracy(scores, by).join(ranked, list(by)).select(
        *by, "n_pairs", "pair_acc",
        (F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"),
        (F.col("_tp") / F.col("n_pos")).alias("tpr"),
    )


def stratified(scores: DataFrame, strata: dict[str, Column]) -> DataFrame:
    """Repeat each row once per stratum whose predicate it meets; group by ``stratum`` afterwards."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in strata.items()]))
    return scores.withColumn("stratum", F.explode(tags))


def length_controlled(scores: DataFrame, words: str, by: Sequence[str] = SYSTEM, min_items: int = 20) -> DataFrame:
    """Replace ``value`` by its residual on ln(words), fitted over both labels together."""
    x = F.log(F.col(words).cast("double"))
    usable = F.col("value").isNotNull() & (F.col(words) > 0)
    fit = (
        scores.where(usable).groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"), F.regr_slope("value", x).alias("_b"), F.avg("value").alias("_my"), F.avg(x).alias("_mx"))
    )
    resid = F.round(F.col("value") - (F.col("_my") + F.coalesce(F.col("_b"), F.lit(0.0)) * (x - F.col("_mx"))), 9)
    return (
        # one row per system; a join by exchange would leave all rows of a system in one task from here on
        scores.join(F.broadcast(fit), list(by))
        .where((F.col("_n") < min_items) | usable)
        .withColumn("value", F.when(F.col("_n") < min_items, F.col("value")).otherwise(resid))
        .drop("_n", "_b", "_my", "_mx")
    )


def pool_halves(halves: dict[str, DataFrame]) -> DataFrame:
    """Union benchmark halves under prefixed pair keys, so equal ids never collide."""
    out = None
    for tag, half in halves.items():
        part = half.withColumn("pair_id", F.concat_ws(":", F.lit(tag), F.col("pair_id").cast("string")))
        out = part if out is None else out.unionByName(part)
    return out


def seed_variance(per_draw: DataFrame, draw: str, metrics: Sequence[str], by: Sequence[str] = SYSTEM) -> DataFrame:
    """Mean and sample standard deviation of each metric over draws (0 for a single draw)."""
    return per_draw.groupBy(*by).agg(
        F.count_distinct(draw).alias("n_draws"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_sd") for m in metrics],
    )


def field_separability(scores: DataFrame, min_pairs: int = 5, top: int = 24) -> DataFrame:
    """Every field in both directions: pair accuracy >= 1/2, best ``top`` rows of the report."""
    both = scores.where(F.col("value").isNotNull()).withColumn("d", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn(
        "s", F.col("value") * F.col("d"))
    by = ["system", "d"]
    return (
        win_loss(both, by).join(auroc(both, by), by)
        .where((F.col("n_pairs") >= min_pairs) & (F.col("pair_acc") >= 0.5))
        .select("system", "d", "n_pairs", "pair_acc", "auroc", (F.col("mean_pos") * F.col("d")).alias("mean_pos"), (F.col("mean_neg") * F.col("d")).alias("mean_neg"))
        .orderBy(F.desc("pair_acc"), F.desc("auroc"), F.desc("system"), F.desc("d"))
        .limit(top)
    )


def feature_balance(scores: DataFrame) -> DataFrame:
    """Trivial features on complete pairs: side medians, ratio, AUROC, separability, larger/tie counts."""
    pairs = sides(scores)
    items = pairs.select(
        "system", F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("a").alias("s")),
                                    F.struct(F.lit(0).alias("label"), F.col("h").alias("s")))).alias("x")
    ).select("system", "x.label", "x.s")
    med = ranks.quantiles(items, ["system", "label"], "s", {"median": 0.5})
    med = med.groupBy("system").agg(
        F.max(F.when(F.col("label") == 1, F.col("median"))).alias("pos_median"),
        F.max(F.when(F.col("label") == 0, F.col("median"))).alias("neg_median"),
    )
    counts = pairs.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > F.col("h")).alias("pos_larger"),
        F.count_if(F.col("a") == F.col("h")).alias("ties"), F.count_if(F.col("a") < F.col("h")).alias("neg_larger"),
    )
    return (
        counts.join(med, "system").join(auroc(items).select("system", "auroc"), "system")
        .withColumn("ratio", F.col("neg_median") / F.nullif(F.col("pos_median"), F.lit(0.0)))
        .withColumn("separability", F.greatest(F.col("auroc"), 1 - F.col("auroc")))
    )


def filter_funnel(candidates: DataFrame, stages: Sequence[str], query: str = "query_id") -> DataFrame:
    """Survivors after each stage in order (rows, distinct queries) and the rows failing it at all.

    ``stages`` are columns holding pass / fail / unknown. One row per stage; the distinct count
    is taken over (stage, query) groups, so a hot query is a single partial-aggregated key.
    """
    alive = F.lit(True)
    entries = [F.struct(F.lit(0).alias("pos"), F.lit("all").alias("stage"), F.lit(True).alias("alive"), F.lit(False).alias("fail"))]
    for i, stage in enumerate(stages, 1):
        alive = alive & (F.col(stage) == "pass")
        entries.append(F.struct(F.lit(i).alias("pos"), F.lit(stage).alias("stage"), alive.alias("alive"), (F.col(stage) == "fail").alias("fail")))
    per_query = (
        candidates.select(query, F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.pos", "e.stage", query)
        .agg(F.count_if(F.col("e.alive")).alias("alive"), F.count_if(F.col("e.fail")).alias("fail"))
    )
    return per_query.groupBy("pos", "stage").agg(
        F.sum("alive").alias("rows_left"), F.count_if(F.col("alive") > 0).alias("queries_left"), F.sum("fail").alias("fail_any")
    )


def index_quartiles(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles by position: sorted[n//4], the median, sorted[3n//4]."""
    cell = ranks.rank_cells(df, group, value)
    n = F.col("total_n")
    q = ranks.order_statistics(cell, group, value, {"q1": F.floor(n / 4), "q3": F.floor(n * 3 / 4)})
    return q.join(ranks.quantiles_from(cell, group, value, {"median": 0.5}).drop("n"), list(group))


def composition(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Crosstab counts with margins (nulls of the cube become 'all')."""
    return df.cube(rows, cols).agg(F.count(F.lit(1)).alias("n"), F.grouping(rows).alias("_r"), F.grouping(cols).alias("_c")).select(
        F.when(F.col("_r") == 1, F.lit("all")).otherwise(F.col(rows).cast("string")).alias(rows),
        F.when(F.col("_c") == 1, F.lit("all")).otherwise(F.col(cols).cast("string")).alias(cols),
        "n",
    )


def run_diff(run: DataFrame, released: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Identical scores per system between a rerun and a release (nulls count as equal)."""
    both = run.select(*keys, F.col("value").alias("now")).join(released.select(*keys, F.col("value").alias("then")), list(keys), "full")
    return both.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("now").eqNullSafe(F.col("then"))).alias("identical"),
        F.max(F.abs(F.col("now") - F.col("then"))).alias("max_abs_diff"),
    )


def retrieval_ranks(left: DataFrame, right: DataFrame, block: int = 1024) -> DataFrame:
    """Cosine of every left vector with its counterpart and the counterpart's exact rank.

    ``left``/``right``: pair_id, vec. The rank is 1 + the number of right vectors strictly more
    similar. Vectors are packed into blocks of bounded size; a block of left meets each block of
    right once as a dense matrix product inside a task, which emits one count per left vector
    and never a pair.
    """
    import numpy as np
    import pandas as pd

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    def unit(df: DataFrame) -> DataFrame:
        wide = df.select("pair_id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
        return wide.select("pair_id", F.transform("vec", lambda x: x / F.sqrt(dot("vec", "vec"))).alias("vec"))

    def packed(df: DataFrame, row: Column) -> DataFrame:
        # dense numbering keeps every block at most ``block`` vectors long
        return (
            ranks.numbered(df, [], "pair_id").withColumn("block", F.floor((F.col("rn") - 1) / block))
            .groupBy("block").agg(F.collect_list(row).alias("rows"))
        )

    own = unit(left).join(unit(right).withColumnRenamed("vec", "other"), "pair_id").withColumn("cos", dot("vec", "other"))
    lb = packed(own.select("pair_id", "vec", "cos"), F.struct("pair_id", "vec", "cos"))
    rb = packed(own.select("pair_id", F.col("other").alias("vec")), F.struct("pair_id", "vec")).select(
        F.col("block").alias("other"), F.col("rows").alias("against"))
    # block ids are dense, so the grid needs only the number of pairs
    last = own.agg(F.floor((F.count(F.lit(1)) - 1) / block).alias("last"))
    grid = rb.select("other").join(F.broadcast(last)).select("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("block"))
    work = grid.join(lb, "block").join(rb, "other").select("rows", "against")

    def count_above(batches):
        for pdf in batches:
            for rows, against in zip(pdf["rows"], pdf["against"]):
                ids = np.array([r["pair_id"] for r in rows])
                sims = np.array([r["vec"] for r in rows]) @ np.array([r["vec"] for r in against]).T
                foreign = ids[:, None] != np.array([r["pair_id"] for r in against])[None, :]
                above = ((sims > np.array([r["cos"] for r in rows])[:, None]) & foreign).sum(axis=1)
                yield pd.DataFrame({"pair_id": ids, "above": above})

    counted = work.mapInPandas(count_above, "pair_id long, above long")
    return own.select("pair_id", "cos").join(
        counted.groupBy("pair_id").agg((F.sum("above") + 1).alias("rank")), "pair_id")


def retrieval_audit(left: DataFrame, right: DataFrame, stratum: str) -> DataFrame:
    """Mean cosine, top-1/3/10 counts and median rank of the true counterpart, per stratum and overall."""
    ranked = retrieval_ranks(left.select("pair_id", "vec"), right.select("pair_id", "vec")).join(
        left.select("pair_id", F.col(stratum).cast("string").alias(stratum)), "pair_id")
    tagged = ranked.withColumn(stratum, F.explode(F.array(F.col(stratum), F.lit("all"))))
    top = tagged.groupBy(stratum).agg(
        F.avg("cos").alias("mean_cos"), *[F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in (1, 3, 10)])
    return top.join(ranks.quantiles(tagged, [stratum], "rank", {"median_rank": 0.5}), stratum)
