"""Argument order: labels by vote, strongest predictors, build-up depth and the shuffle null.

``edges``: doc_id, src, dst, weight with unit positions 0..n-1; ``key_units``: doc_id, ord, kind.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstat.functions import text as T
from inkstat.operators import shuffles

DRAWS = 300_000  # units times permutations of one row
# fixed values: statuses in the order they are checked
STATUSES = ["no_intro", "too_short", "labels_pending", "labels_only", "no_key", "pmi_pending", "ok"]


def majority_label(votes: DataFrame, known: list[str]) -> DataFrame:
    """Most common label over runs (unknown -> none); ties go to the label met first."""
    v = votes.withColumn("label", F.when(F.lower(F.trim("label")).isin(known), F.lower(F.trim("label"))).otherwise("none"))
    per = v.groupBy("doc_id", "ord", "label").agg(F.count(F.lit(1)).alias("c"), F.min("run").alias("first"))
    return per.groupBy("doc_id", "ord").agg(F.max(F.struct("c", (-F.col("first")).alias("f"), "label")).alias("b"), F.sum("c").alias("runs"), F.count(F.lit(1)).alias("d")).select(
        "doc_id", "ord", F.col("b.label").alias("label"), (F.col("d") == 1).alias("unanimous"), "runs")


def top_predictors(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest incoming edges of every unit, NaN and self excluded; ties to the lower source."""
    ok = edges.where(F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("src") != F.col("dst")))
    w = Window.partitionBy("doc_id", "dst").orderBy(F.desc("weight"), "src")
    return ok.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def build_up_depth(predictors: DataFrame) -> DataFrame:
    """depth = 1 + the deepest predictor that precedes the unit, else 0, in document order.

    A document's units are few; the fold over them is the recurrence itself.
    """
    chain = predictors.groupBy("doc_id", "dst").agg(F.collect_list(F.when(F.col("src") < F.col("dst"), F.col("src"))).alias("back")).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("dst", "back"))).alias("units"))
    depth = F.aggregate(
        "units", F.create_map().cast("map<int,int>"),
        lambda acc, u: F.map_concat(acc, F.create_map(u["dst"].cast("int"), F.coalesce(
            F.array_max(F.transform(u["back"], lambda s: F.coalesce(F.try_element_at(acc, s.cast("int")), F.lit(0)) + 1)), F.lit(0)))))
    return chain.select("doc_id", F.explode(depth).alias("dst", "depth"))


def argued_scores(predictors: DataFrame, key_units: DataFrame, depth: DataFrame, sizes: DataFrame) -> DataFrame:
    """declared / key units per document: a key unit is argued when its strongest predictor precedes it."""
    best = predictors.where("rank = 1").select("doc_id", F.col("dst").alias("ord"), F.col("src").alias("pred"))
    k = key_units.join(best, ["doc_id", "ord"], "left").join(depth.withColumnRenamed("dst", "ord"), ["doc_id", "ord"], "left")
    argued = F.coalesce(F.col("pred") < F.col("ord"), F.lit(False))
    gap = F.abs(F.col("pred") - F.col("ord"))
    d = k.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_key"), F.count_if(argued).alias("n_argued"), F.count_if(gap == 1).alias("n_adjacent"), F.median(gap).alias("distance_median"),
        F.avg(F.coalesce("depth", F.lit(0))).alias("build_up_mean"), F.count_if(F.col("depth") >= 2).alias("n_deep"))
    j = sizes.join(d, "doc_id", "left").na.fill(0, ["n_key", "n_argued", "n_adjacent", "n_deep"])
    den = F.nullif(F.col("n_key"), F.lit(0))
    return j.select(
        "doc_id", "n_units", "n_key", "n_argued", ((F.col("n_key") - F.col("n_argued")) / den).alias("score"), (F.col("n_key") < 3).alias("weak"),
        F.coalesce(F.col("n_key") / F.nullif(F.col("n_units"), F.lit(0)), F.lit(0.0)).alias("coverage"), "build_up_mean", (F.col("n_deep") / den).alias("deep_rate"),
        (F.col("n_adjacent") / den).alias("adjacent_rate"), "distance_median")


def declared_by_kind(predictors: DataFrame, key_units: DataFrame) -> DataFrame:
    best = predictors.where("rank = 1").select("doc_id", F.col("dst").alias("ord"), F.col("src").alias("pred"))
    k = key_units.join(best, ["doc_id", "ord"], "left")
    return k.groupBy("kind").agg(F.count(F.lit(1)).alias("n_key"), F.avg((~F.coalesce(F.col("pred") < F.col("ord"), F.lit(False))).cast("int")).alias("declared_rate"))


def depth_in_order(order: Column, incoming: Column) -> Column:
    """Map unit -> depth when units are read in ``order``; ``incoming`` lists every unit's predictors. What is not read yet has no depth to build on."""
    return F.aggregate(order, F.create_map().cast("map<int,int>"), lambda seen, unit: F.map_concat(seen, F.create_map(
        unit, F.coalesce(F.array_max(F.transform(F.get(incoming, unit), lambda s: F.try_element_at(seen, s) + 1)), F.lit(0)))))


def shuffle_null(predictors: DataFrame, key_units: DataFrame, sizes: DataFrame, permutations: int = 300, seed: int = 0) -> DataFrame:
    """Mean build-up of the key units against hash-ordered permutations of the document's units.

    A document is dealt out once, with its edges and keys; its permutations are made and summed next to it, as whole numbers, so
    nothing of their size moves. A document of many units is dealt as several blocks of permutations. Adds the null mean, its
    population sd, the difference, z and the share of permutations below the observation.
    """
    pred = predictors.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))).alias("edges"))
    keys = key_units.groupBy("doc_id").agg(F.collect_list(F.col("ord").cast("int")).alias("keys"))
    step = F.greatest(F.lit(1), F.least(F.lit(permutations), F.floor(F.lit(DRAWS) / F.col("n_units")).cast("int")))
    base = sizes.where("n_units > 0").select("doc_id", F.col("n_units").cast("int").alias("n_units")).join(pred, "doc_id").join(keys, "doc_id").withColumn("step", step)
    base = base.select("doc_id", F.col("doc_id").cast("string").alias("name"), "n_units", "edges", "keys", "step", F.explode(F.sequence(F.lit(1), F.lit(permutations), F.col("step"))).alias("first"))
    # the work is in the rows, not in their bytes
    base = base.repartition(4 * base.sparkSession.sparkContext.defaultParallelism, "doc_id", "first")

    def run(batches):
        for batch in batches:
            doc, groups = batch.column(0), {}
            for j, (n, step, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_units", "step", "first")))):
                groups.setdefault((n, first, min(first + step, permutations + 1)), []).append(j)
            names, edges, units = (batch.column(c).to_pylist() for c in ("name", "edges", "keys"))
            for (n, first, last), at in groups.items():
                found = shuffles.totals([names[j] for j in at], n, [[(e["src"], e["dst"]) for e in edges[j]] for j in at], [units[j] for j in at], first, last, seed)
                seen, s1, s2, below = zip(*found)
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(at)), pa.array([len(units[j]) for j in at], pa.int64()), *(pa.array(x, pa.int64()) for x in (seen, s1, s2, below))],
                                                 names=["doc_id", "size", "seen", "s1", "s2", "below"])

    kind = dict(base.dtypes)["doc_id"]
    per = base.mapInArrow(run, f"doc_id {kind}, size long, seen long, s1 long, s2 long, below long").groupBy("doc_id").agg(
        F.max("size").alias("size"), F.max("seen").alias("seen"), *[F.sum(c).alias(c) for c in ("s1", "s2", "below")])
    # whole numbers until here: equal permutations give a spread of zero, not of rounding
    n, wide = F.lit(permutations), "decimal(38,0)"
    spread = n.cast("decimal(9,0)") * F.col("s2").cast("decimal(20,0)") - F.col("s1").cast("decimal(19,0)") * F.col("s1").cast("decimal(19,0)")
    rows = per.select("doc_id", (F.col("seen") / F.col("size")).alias("observed"), (F.col("s1") / (n * F.col("size"))).alias("null_mean"),
                      (F.sqrt(spread.cast(wide).cast("double")) / (n * F.col("size"))).alias("null_sd"), (F.col("below") / n).alias("null_pct"))
    gap = F.col("observed") - F.col("null_mean")
    return rows.select("*", gap.alias("abu"), (gap / F.when(F.col("null_sd") > 0, F.col("null_sd")).otherwise(1e-9)).alias("abu_z"))


def eligibility(n_words: Column, n_sentences: Column, n_labelled: Column, n_scored: Column, labels_stage: Column) -> Column:
    """Status of a document in the argument pipeline."""
    return (
        F.when(n_words.isNull() | (n_words < 80), "no_intro").when(n_sentences < 4, "too_short").when(n_labelled < n_sentences, "labels_pending")
        .when(labels_stage, "labels_only").when(n_scored < n_sentences, "pmi_pending").otherwise("ok"))
