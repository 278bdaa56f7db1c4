"""Registered queries of the package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstat.llm import sql as S
from inkstat.llm.align import align_tokenizers
from inkstat.llm.chat import as_log, conversation_digests, format_chats
from inkstat.llm.codes import books_digest, compress_vectors, with_label_error
from inkstat.llm.decontaminate import contaminated
from inkstat.llm.jaccard import jaccard_components
from inkstat.llm.language import predict_language
from inkstat.llm.learning import fold_of
from inkstat.llm.licenses import scan_licenses
from inkstat.llm.mixing import mix_to_targets
from inkstat.llm.quality_model import score_quality
from inkstat.llm.quality_rules import quality_cascade
from inkstat.llm.secrets import BASE_KINDS, scan_secrets
from inkstat.llm.tokens import token_digests
from inkstat.llm.toxicity import score_toxicity
from inkstat.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the quality cascade, with the statistics of the base rules."""
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality_cascade(table(spark, sf_dir, "documents"), report=stats)
    return rows.select("doc_id", *stats, F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words").alias("base_failed"), "kept")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents at a shingle similarity of 0.8."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def learnable(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """The labels of four folds of five."""
    return table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0).select("doc_id", F.col(label).alias("label"))


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from four folds of five."""
    return judged(score_quality(table(spark, sf_dir, "documents"), learnable(spark, sf_dir, "quality")), 0.3)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts by base kind, a digest of the base spans, all spans."""
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE_KINDS))

    def listed(found):
        return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    counts = [F.size(F.filter(F.transform("findings", lambda f: f["kind"]), lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, sources weighing 5, 2, 1."""
    return mix_to_targets(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents, read back from the file that was written."""
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three folds of four."""
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    found = predict_language(table(spark, sf_dir, "documents"), ~held_out & F.col("doc_id").isNotNull())
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four folds of five."""
    return judged(score_toxicity(table(spark, sf_dir, "documents"), learnable(spark, sf_dir, "toxic")), 0.5)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with the best place of each."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that quotes the template, formatted, read back from the files and parsed."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return conversation_digests(format_chats(as_log(rows.union(quoting))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code of every vector, its error, the error of its label, and a digest of the codebooks."""
    codes, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.lit("" if books is None else books_digest(books))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level and a piece tokenizer over every document, with corpus-wide counts of linked ids."""
    groups = F.col("groups")
    n_groups = F.when(groups == "", 0).otherwise(F.regexp_count(groups, F.lit(";")) + 1).cast("long")
    keep = {"doc_id": F.col("doc_id"), "n_a": F.col("n_a"), "n_b": F.col("n_b"), "n_groups": n_groups, "groups_sha256": F.when(groups == "", "").otherwise(F.sha2(groups, 256))}
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_quality_rules, op3_jaccard_join, op4_quality_model, op5_secret_scan,
        op6_mixing, op7_token_file, op8_language_id, op9_toxicity, op10_decontamination,
        op11_chat_format, op12_vector_codes, op13_token_alignment,
    )
}
ORACLES = {"op1_license_scan": S.LICENSES, "op2_quality_rules": S.QUALITY, "op3_jaccard_join": S.JACCARD, "op11_chat_format": S.CHATS, "op12_vector_codes": S.CODES}
