"""Mix sources to target weights by hash-random order and distributed prefix sums.

Each source has a budget of words. Its documents get hash-random keys; a source is cut into key
ranges, each range is sorted and summed in a task of its own, and the totals of the ranges, a few
rows per source, are added in front. A document below the cut is taken whole, the one at the cut
in part, so that a source gives exactly ``floor(target)`` words; a budget over the source's size
takes whole epochs first.

Nulls: a null text has size 0; a null source is a source of its own, the last one. A row without
doc_id takes part like any other. Equal rows are interchangeable. An empty table, or one without
a word, gives targets and takes of 0. Columns of the table are kept out of the way: only those of
the result are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstat.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
RANGE_ROWS = 2_000


def n_words(text: str = "text") -> Column:
    """Words between ASCII white space; 0 for a null."""
    return F.expr(f"coalesce(regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0)").cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, docs, target): water filling over the sources ``(source, source_size, docs)``.

    A source that would be above ``most`` times its size stops there and its excess is shared by
    weight among the others. In the end those with the smallest ``most * size / weight`` are full,
    so the level follows from running sums in that order.
    """
    cycle = F.expr(f"element_at(array({','.join(map(str, weights))}), cast((k - 1) % {len(weights)} + 1 AS int))")
    # code-point order is the byte order of UTF-8; one row per source is numbered here
    ranked = sources.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))).withColumn("w", cycle.cast("double"))
    ranked = ranked.withColumn("full", F.col("source_size").cast("double") * most).withColumn("turn", F.col("full") / F.col("w"))
    order = Window.orderBy("turn", "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"full_before": F.coalesce(F.sum("full").over(before), F.lit(0.0)), "w_from": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)), "all_words": F.sum("source_size").over(Window.partitionBy()).cast("double") * share})
    ranked = ranked.withColumn("level", (F.col("all_words") - F.col("full_before")) / F.col("w_from"))
    # the first source, in this order, that stays below its limit sets the level for all after it
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "k", "level"))).over(Window.partitionBy())["level"])
    return ranked.select("source", "source_size", "docs", F.when(F.col("level").isNull(), F.col("full")).otherwise(F.least("full", F.col("w") * F.col("level"))).alias("target"))


def mix_to_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS, seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, text_hash), one row per document of ``docs(doc_id, text, source)``."""
    scratch = Scratch(docs.sparkSession)
    key = F.xxhash64(F.lit(seed), "doc_id")
    rows = scratch.save(docs.select("doc_id", "source", n_words().alias("size"), key.alias("key"), F.xxhash64("text").alias("text_hash")), "sizes")
    sources = scratch.save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, share, most), "sources")
    plan = sources.withColumnRenamed("source", "s").withColumn("ranges", F.expr(f"cast(ceil(docs / {range_rows}) AS long)"))
    same = F.col("source").eqNullSafe(F.col("s"))
    # equal ranges of the random key hold about equally many documents; a hot source has many of them
    placed = rows.join(plan.select("s", "ranges"), same).withColumn("range", F.expr("cast(floor((key / 18446744073709551616.0D + 0.5D) * ranges) AS long)")).drop("s", "ranges")
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "text_hash")
    summed = scratch.save(placed.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))), "ranges")
    totals = summed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    front = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("t"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(front), F.lit(0)).alias("front"))
    cut = summed.join(totals, F.col("source").eqNullSafe(F.col("t")) & (F.col("range") == F.col("r"))).join(plan.select("s", "source_size", "target"), same)
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) AS long) div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, budget - whole * F.col("source_size")).otherwise(F.lit(0))
    begin = F.col("front") + F.col("upto") - F.col("size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - begin))
    out = scratch.save(cut.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_hash"), "mix")
    scratch.drop("sizes", "sources", "ranges")
    return out


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: one row per whole epoch, and the first words of a document at the cut.

    ``n_chars``, where there is one, is that of the text returned. A document of which nothing is
    taken is left out. Rows of the same id, source and text are one document with their joint take.
    """
    by = ["_id", "_source", "_text"]
    mix = mix_to_targets(docs, **options).where("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_text"))
    mix = mix.agg(F.sum("taken").alias("_taken"), F.first("size").alias("_size"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.xxhash64("text") == F.col("_text"))
    held = docs.join(mix, same).withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy("_size"))).where("_row = 1")
    held = held.withColumns({"_whole": F.expr("_taken div _size"), "_part": F.expr("_taken % _size")})
    copies = held.withColumn("_copy", F.explode(F.expr("sequence(1L, _whole + if(_part > 0, 1L, 0L))")))
    cut = F.expr("_copy > _whole")
    head = F.expr("array_join(slice(regexp_extract_all(text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, cast(_part AS int)), '')")
    copies = copies.withColumn("text", F.when(cut, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return copies.select(*docs.columns)
