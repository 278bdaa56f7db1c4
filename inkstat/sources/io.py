"""Sources and sinks: benchmark tables, JSON lines, CSV, Parquet, multi-file LaTeX documents."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstat.functions import text as T
from inkstat.session import cut, shared_folder

PAIRS = (
    "pair_id STRING, source STRING, ai_paper_id STRING, human_paper_id STRING, sim_tier INT, pool STRING, relation STRING, "
    "specter2_cosine DOUBLE, tfidf_similarity DOUBLE, ai_body_words INT, human_body_words INT, human_arxiv STRING, human_venue STRING, human_rating DOUBLE")
PAPERS = (
    "paper_id STRING, pair_ids ARRAY<STRING>, source STRING, label INT, role STRING, title STRING, arxiv STRING, venue STRING, body_words INT, body_tex STRING, body_txt STRING")
SCORES = (
    "paper_id STRING, pair_id STRING, source STRING, label INT, role STRING, binoculars DOUBLE, detectgpt DOUBLE, fast_detectgpt DOUBLE, nts DOUBLE, pangram DOUBLE")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint directory (shared on a cluster)."""
    root = shared_folder(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_bench(spark: SparkSession, folder: str, tables: Sequence[str] = ("pairs", "papers", "scores")) -> dict[str, DataFrame]:
    """Released tables under their declared schemas (no inference, prunable columns)."""
    schemas = {"pairs": PAIRS, "papers": PAPERS, "scores": SCORES}
    return {t: spark.read.schema(schemas[t]).parquet(f"{folder}/{t}.parquet") for t in tables}


def number(value: Column) -> Column:
    """Double from anything: empty, 'None' and non-numbers are null."""
    return F.nullif(F.nullif(F.trim(value), F.lit("")), F.lit("None")).try_cast("double")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; not strict drops torn lines, strict fails on the first one."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV as text, columns cast afterwards; numbers go through ``number``."""
    raw = spark.read.option("header", "true").option("escape", '"').schema(", ".join(f"`{c}` STRING" for c in columns)).csv(path)
    null = lambda c: F.nullif(F.nullif(F.col(c), F.lit("")), F.lit("None"))
    return raw.select(*[(number(F.col(c)).cast(k) if k != "string" else null(c)).alias(c) for c, k in columns.items()])


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Fixed column list; other columns are ignored. The job commit makes the replace atomic."""
    df.select(*columns).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def pattern_dimension(spark: SparkSession, path: str, most: int = 1000) -> list[tuple[str, str]]:
    """Ordered (name, pattern) rules of a TSV dimension, for ``first_match``.

    Every rule becomes a branch of one CASE expression, so a file of more than ``most`` rules is an error. Order is that of the lines of one file.
    """
    rows = spark.read.option("header", "true").option("sep", "\t").option("quote", "").csv(path).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path} has more than {most} rules")
    return [(r[0], r[1]) for r in rows]


def read_sources(spark: SparkSession, folder: str, suffix: str = ".tex") -> DataFrame:
    """All source files below ``folder/<doc>/`` as (doc_id, path, text), one row per file."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("full"))
    tail = F.regexp_extract("full", re.escape(folder.rstrip("/").split("/")[-1]) + r"/(.+)$", 1)
    return raw.select(F.regexp_extract(tail, r"^([^/]+)/", 1).alias("doc_id"), F.regexp_extract(tail, r"^[^/]+/(.+)$", 1).alias("path"), "text")


def root_file(files: DataFrame, rule: int = 1) -> DataFrame:
    """The main file of every document among those with a document class.

    Rule 1: has a document body, most inputs, longest, of equal ones the last path. Rule 2 (body required): shallowest, then
    main.tex before conference/paper names before others, then longest.
    """
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    body = F.col("text").rlike(r"\\begin\{document\}")
    c = files.where(F.col("text").rlike(r"\\documentclass") & ((F.lit(rule) == 2) | ~F.col("path").contains("/"))).withColumns({
        "_b": body.cast("int"), "_i": F.regexp_count("text", F.lit(r"\\(?:input|include)\{")), "_l": F.length("text"), "_d": F.size(F.split("path", "/")),
        "_p": F.when(base == "main.tex", 0).when(base.rlike("conference|paper"), 1).otherwise(2)})
    if rule == 1:
        key = F.max(F.struct("_b", "_i", "_l", "path"))
    else:
        c = c.where("_b = 1")
        key = F.min(F.struct("_d", "_p", (-F.col("_l")).alias("c"), "path"))
    return c.groupBy("doc_id").agg(key.alias("k")).select("doc_id", F.col("k.path").alias("root"))


# fixed value: the macros that read another file, with one or two arguments
INCLUDE = r"\\(?:input|include|subfile)\{([^}]+)\}|\\(?:sub)?import\{([^}]*)\}\{([^}]+)\}"


def _folded(path: Column) -> Column:
    """A path without ``.`` and empty steps, each ``..`` taking back the step before it."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    back = lambda held, x: (x == "..") & (F.size(held) > 0) & (F.coalesce(F.element_at(F.concat(F.array(F.lit("..")), held), -1), F.lit("..")) != "..")
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), lambda held, x: F.when(back(held, x), F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array_append(held, x))), "/")


def _places(name: Column, here: Column, root: Column) -> Column:
    """Paths that an include may mean, best first: as written, from the root's folder, from the including file's, flattened, by its last part; ``..`` is followed."""
    folder = lambda path: F.regexp_extract(path, r"^(.*/)?", 0)
    names = F.array(name, F.concat(folder(root), name), F.concat(folder(here), name), F.regexp_replace(name, "/", "__"), F.element_at(F.split(name, "/"), -1))
    plain = F.transform(names, _folded)
    return F.flatten(F.transform(plain, lambda p: F.array(p, F.concat(p, F.lit(".tex")))))


def expand_includes(files: DataFrame, roots: DataFrame, depth: int = 12) -> DataFrame:
    """(doc_id, tex, missing, cut): the root's text with includes in place, each file once, and the names not found or below ``depth``.

    A file is its stretches of text and the includes between them. Each round resolves the
    includes of one level by a join on paths; a place in the document is the list of positions on
    the way to it, so the first place of a file is the smallest and the text follows by sorting.
    Comments are stripped first, so a commented include stays out.
    """
    clean = files.select("doc_id", "path", T.strip_comments(F.col("text")).alias("text"))
    macros = F.regexp_extract_all("text", F.lit("(" + INCLUDE + ")"), F.lit(1))
    part = lambda m, g: F.regexp_extract(m, INCLUDE, g)
    names = F.transform(macros, lambda m: F.trim(F.when(part(m, 1) != "", part(m, 1)).otherwise(F.concat(part(m, 2), F.when((part(m, 2) != "") & ~part(m, 2).endswith("/"), "/").otherwise(""), part(m, 3)))))
    parts = cut(clean.select("doc_id", "path", F.split("text", INCLUDE, -1).alias("leads"), names.alias("names")))
    includes = parts.select("doc_id", F.col("path").alias("here"), F.posexplode("names").alias("k", "name"))
    paths = parts.select("doc_id", "path")

    level = cut(roots.select("doc_id", "root", F.array().cast("array<int>").alias("at"), F.col("root").alias("path")).join(paths, ["doc_id", "path"], "left_semi").select("doc_id", "root", "at", "path"))
    met, lost, deep = level, None, None
    for n in range(depth + 1):
        asked = level.withColumnRenamed("path", "here").join(includes, ["doc_id", "here"]).select("doc_id", "root", "here", "name", F.concat("at", F.array(2 * F.col("k") + 1)).alias("at"))
        if n == depth:
            deep = asked.select("doc_id", "at", "name")
            break
        tried = asked.select("doc_id", "root", "at", "name", F.posexplode(_places(F.col("name"), F.col("here"), F.col("root"))).alias("turn", "path"))
        found = tried.join(paths, ["doc_id", "path"], "left_semi").groupBy("doc_id", "root", "at").agg(F.min_by("path", "turn").alias("path"))
        missing = cut(asked.join(found, ["doc_id", "at"], "left_anti").select("doc_id", "at", "name"))
        lost = missing if lost is None else lost.unionByName(missing)
        first = met.unionByName(found.select("doc_id", "root", "at", "path")).groupBy("doc_id", "path").agg(F.min("at").alias("first"))
        level = cut(found.join(first, ["doc_id", "path"]).where("at = first").select("doc_id", "root", "at", "path"))
        if level.isEmpty():
            break
        met = met.unionByName(level)
    first = met.groupBy("doc_id", "path").agg(F.min("at").alias("at"))
    k = F.size("leads")
    text = first.join(parts, ["doc_id", "path"]).select("doc_id", F.col("at").alias("up"), k.alias("k"), F.posexplode("leads").alias("p", "lead"))
    text = text.select("doc_id", F.concat("up", F.array(2 * F.col("p"))).alias("at"), F.concat(F.when(F.col("p") > 0, "\n").otherwise(""), "lead", F.when(F.col("p") < F.col("k") - 1, "\n").otherwise("")).alias("text"))
    if lost is not None:
        # a place inside a repeated file was never visited, so every missing name is in the text
        text = text.unionByName(lost.select("doc_id", "at", F.concat(F.lit("% MISSING INPUT "), "name").alias("text")))
    out = text.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("tex"))

    def listed(rows: DataFrame | None, name: str) -> DataFrame:
        rows = out.select("doc_id", F.lit(None).cast("array<int>").alias("at"), F.lit("").alias("name")).limit(0) if rows is None else rows
        return rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias(name))

    out = out.join(listed(lost, "missing"), "doc_id", "left").join(listed(deep, "cut"), "doc_id", "left")
    return out.select("doc_id", "tex", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("missing", "cut")))


def exclude(papers: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept papers, dropped papers with their reason)."""
    return papers.join(exclusions.select("paper_id"), "paper_id", "left_anti"), papers.join(exclusions.select("paper_id", "reason"), "paper_id")


def review_scalar(final: Column) -> Column:
    """Overall, else Rating, of a review's JSON text, if numeric."""
    return F.coalesce(number(F.get_json_object(final, "$.final.Overall")), number(F.get_json_object(final, "$.final.Rating")))


# --------------------------------------------------------------------------- release tables


def pair_items(pairs: DataFrame, papers: DataFrame) -> DataFrame:
    """Two item rows per pair (label 1 and 0) with the paper attributes of their side."""
    sides = F.array(
        F.struct(F.lit(1).alias("label"), F.col("ai_paper_id").alias("paper_id"), F.lit("ai").alias("role")),
        F.struct(F.lit(0).alias("label"), F.col("human_paper_id").alias("paper_id"), F.lit("human").alias("role")))
    items = pairs.select("pair_id", "sim_tier", "pool", F.explode(sides).alias("s")).select("pair_id", "sim_tier", "pool", "s.*")
    return items.join(papers, "paper_id")


def dedupe_papers(items: DataFrame) -> DataFrame:
    """One row per paper with all its pairs; sources of a shared anchor are concatenated."""
    return items.groupBy("paper_id").agg(
        F.max("label").alias("label"), F.sort_array(F.collect_set("pair_id")).alias("pair_ids"), F.array_join(F.sort_array(F.collect_set("source")), "+").alias("source"))


def wide_scores(items: DataFrame, scores: DataFrame, systems: Sequence[str]) -> DataFrame:
    """One row per (source, paper) with a column per system (missing stays null)."""
    wide = scores.where(F.col("system").isin(list(systems))).groupBy("source", "paper_id").pivot("system", list(systems)).agg(F.max("value"))
    return items.join(wide, ["source", "paper_id"], "left")


def coverage_snapshot(wide: DataFrame, systems: Sequence[str], stamp: Column) -> DataFrame:
    """Papers and non-null count per system at one moment; append it to the snapshot table."""
    counts = wide.agg(F.count(F.lit(1)).alias("n_papers"), *[F.count(s).alias(s) for s in systems])
    return counts.withColumn("stamp", stamp)
