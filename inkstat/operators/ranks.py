"""Rank core: cumulative counts over sorted distinct values, without one task holding a group.

Every order-based statistic of the engine (AUROC, TPR thresholds, Spearman, Mann-Whitney,
Kruskal-Wallis, exact percentiles, percentile ranks, row numbering) reduces to *cells*, one row
per (group, distinct value) with counts, plus the counts of all smaller values. A plain window
over the group would sort the whole group in one task; a group here may be a third of the data.

``cumulate`` therefore cuts each group into value ranges first. The cut points come from the
values with the smallest hashes (a bounded, deterministic sample, so a recomputed task sees the
same cuts), each range is summed in its own task, and the range totals, at most ``RANGES`` rows
per group, are added in front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstat.session import cut

RANGES = 60
SAMPLE = 960  # below the planner's limit up to which row_number() <= k is pruned before the shuffle
STEP = 8  # cut points are searched by every eighth first
LARGE = 100_000  # rows of a group that one task may well sort


def cells(df: DataFrame, group: Sequence[str], value: str, **measures: Column) -> DataFrame:
    """One row per (group, value); ``measures`` are aggregate columns, ``n`` by default."""
    aggs = measures or {"n": F.count(F.lit(1))}
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(*[c.alias(k) for k, c in aggs.items()])
    )


def _ranges(cell: DataFrame, group: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    by_hash = Window.partitionBy(*group).orderBy("_hash", value)
    return _cuts(
        cell.select(*group, value, *measures, F.xxhash64(value).alias("_hash"))
        .withColumn("_pick", F.row_number().over(by_hash))
        .where(F.col("_pick") <= SAMPLE)
        .groupBy(*group)
        # whole cells are kept so that this branch reads the same exchange as the rows it cuts
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(value, *measures))), lambda c: c[value]).alias("_values")),
        group,
    )


def _cuts(values: DataFrame, group: Sequence[str]) -> DataFrame:
    """RANGES - 1 cut points of the sorted ``_values`` of a group, and every STEP-th of them."""
    cuts = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.lit(RANGES - 1)),
            lambda i: F.get(F.col("_values"), (i * F.size("_values") / RANGES).cast("int")),
        )
    )
    return values.select(*group, cuts.alias("_cuts")).withColumn("_coarse", F.filter("_cuts", lambda c, i: i % STEP == STEP - 1))


def _range_of(value: str) -> Column:
    """How many cut points are at or below the value."""
    ahead = STEP * F.size(F.filter("_coarse", lambda c: c <= F.col(value)))
    return ahead + F.size(F.filter(F.slice("_cuts", ahead + 1, F.lit(STEP)), lambda c: c <= F.col(value)))


def cumulate(cell: DataFrame, group: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    """Add ``before_<m>`` (sum over smaller values) and ``total_<m>`` for every measure."""
    group = list(group)
    keyed = cell if group else cell.withColumn("_all", F.lit(0))
    keys = group or ["_all"]
    cuts = _ranges(keyed, keys, value, [c for c in cell.columns if c not in (*keys, value)])
    # without a group the cuts are one row; with groups their number decides, and AQE measures it
    ranged = keyed.join(cuts if group else F.broadcast(cuts), keys, "left").withColumn(
        "_range", _range_of(value)
    ).drop("_cuts", "_coarse")
    # the join leaves rows dealt by group, which the windows below would take over, all ranges of a group in one task
    ranged = ranged.repartition(*keys, "_range")

    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    # at most RANGES rows per group from here on
    offsets = totals.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_s_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(overall).alias(f"total_{m}") for m in measures],
    )
    out = ranged.withColumns({f"_i_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures}).join(
        offsets, [*keys, "_range"]
    )
    return out.select(
        *[c for c in cell.columns],
        *[(F.col(f"_i_{m}") + F.col(f"_o_{m}")).alias(f"before_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def rank_cells(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Cells with ``n``, ``before_n``, ``total_n`` and the average rank ``avg_rank`` (ties share it)."""
    out = cumulate(cells(df, group, value), group, value, ["n"])
    return out.withColumn("avg_rank", F.col("before_n") + (F.col("n") + 1) / F.lit(2.0))


def with_ranks(df: DataFrame, group: Sequence[str], ranks: dict[str, str]) -> DataFrame:
    """Attach average ranks within ``group``: ``ranks`` maps a value column to its rank column."""
    for value, name in ranks.items():
        table = rank_cells(df, group, value).select(*group, value, F.col("avg_rank").alias(name))
        df = df.join(table, [*group, value])
    return df


def numbered(df: DataFrame, group: Sequence[str], key: str, name: str = "rn", large: int = LARGE, like: DataFrame | None = None) -> DataFrame:
    """Exact row numbers 1..n inside ``group`` by a unique ``key``; rows with a null key or group get none.

    Groups of up to ``large`` rows are numbered by a window each. The rows of larger ones are cut into value ranges where they
    are and move once, dealt by range; sizes, cut points and totals of ranges are counted without moving rows. They are taken
    from ``like`` if it is given: the same groups and keys from a table that is cheaper to read.
    """
    keys = list(group) or ["_all"]

    def known(rows: DataFrame) -> DataFrame:
        rows = (rows if group else rows.withColumn("_all", F.lit(0))).where(F.col(key).isNotNull())
        for c in group:
            rows = rows.where(F.col(c).isNotNull())
        return rows

    out, base = known(df), known(df if like is None else like).select(*keys, key)
    big = cut(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large))  # a row per ``large`` rows at most
    if big.isEmpty():
        return out.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(key)).cast("bigint")).drop("_all")
    some = base.join(F.broadcast(big), keys).where(F.pmod(F.xxhash64(key), F.floor(F.col("_n") / SAMPLE) + 1) == 0)
    cuts = cut(_cuts(some.groupBy(*keys).agg(F.array_sort(F.collect_set(key)).alias("_values")), keys))
    totals = base.join(F.broadcast(cuts), keys).groupBy(*keys, _range_of(key).alias("_range")).agg(F.count(F.lit(1)).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_range", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_ahead"))  # RANGES rows of a large group, none of others
    ranged = out.join(F.broadcast(cuts), keys, "left").withColumn("_range", F.coalesce(_range_of(key), F.lit(0))).drop("_cuts", "_coarse")
    inside = F.rank().over(Window.partitionBy(*keys, "_range").orderBy(key))
    ranged = ranged.repartition(*keys, "_range").withColumn("_inside", inside).join(F.broadcast(offsets), [*keys, "_range"], "left")
    return ranged.select(*df.columns, (F.col("_inside") + F.coalesce("_ahead", F.lit(0))).cast("bigint").alias(name))


def quantiles(df: DataFrame, group: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group; ``n`` is the row count."""
    return quantiles_from(rank_cells(df, group, value), group, value, points)


def _at(value: str, position: Column) -> Column:
    hit = (F.col("before_n") <= position) & (position < F.col("before_n") + F.col("n"))
    return F.max(F.when(hit, F.col(value)))


def quantiles_from(cell: DataFrame, group: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    where = {name: (F.col("total_n") - 1) * F.lit(float(p)) for name, p in points.items()}
    picked = cell.groupBy(*group).agg(
        F.sum("n").alias("n"),
        *[_at(value, F.floor(x)).alias(f"_lo_{k}") for k, x in where.items()],
        *[_at(value, F.ceil(x)).alias(f"_hi_{k}") for k, x in where.items()],
    )
    frac = {k: (F.col("n") - 1) * F.lit(float(p)) for k, p in points.items()}
    return picked.select(
        *group,
        "n",
        *[
            (F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (x - F.floor(x))).cast("double").alias(k)
            for k, x in frac.items()
        ],
    )


def order_statistics(cell: DataFrame, group: Sequence[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """Values at zero-based ascending positions (columns over ``total_n``), one row per group."""
    return cell.groupBy(*group).agg(F.sum("n").alias("n"), *[_at(value, p).alias(k) for k, p in picks.items()])
