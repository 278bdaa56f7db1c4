"""A cleaning pipeline over documents: five stages, each written as Parquet and read again by the next.

Rows of ``documents`` that a stage keeps have the same columns; the last stage returns a row per
document of the token file. A stage works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstat.llm.decontaminate import contaminated
from inkstat.llm.jaccard import jaccard_components
from inkstat.llm.mixing import mixed_documents
from inkstat.llm.queries import learnable, table
from inkstat.llm.scratch import Scratch
from inkstat.llm.tokens import token_digests
from inkstat.llm.toxicity import score_toxicity
from inkstat.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the network learns from four folds of five of the labels."""
    return score_toxicity(docs, learnable(spark, sf_dir, "toxic"), tuple(docs.columns)).where("score < 0.5").select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``_key`` for every row, equal for rows that are equal in all columns; ids can be null or repeated."""
    return docs.withColumn("_key", F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of every component at a 5-word Jaccard similarity of 0.8.

    Each row is a text of its own, whether its id is null or repeated: of near copies one row stays,
    without an id only if none has one; texts of one id that are no near copies all stay. Of equal rows one stays.
    """
    rows = keyed(docs)
    links = cut(jaccard_components(rows.select(F.col("_key").alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("_key"), "component_id").distinct())
    members = links.union(links.select("component_id", "component_id")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))
    leaders = members.join(rows.select("_key", "doc_id"), "_key").groupBy("component_id").agg(first.alias("first")).select("first._key")
    return rows.join(members.join(leaders, "_key", "left_anti").select("_key"), "_key", "left_anti").dropDuplicates(["_key"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whether their id is null or repeated."""
    rows = keyed(docs)
    leaks = contaminated(rows.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(leaks, "_key", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at weights 5, 2, 1: a row per epoch of a document, the one at the cut shortened."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Start, number and checksum of each document's ids, read back from the token file."""
    return token_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", keep_one_of_near_copies), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("token_file", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if number:
            scratch.drop(STAGES[number - 1][0])
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
