"""Cross-section sentence recycling.

Input ``units``: doc_id, units ARRAY<STRUCT<sec INT, role STRING, toks ARRAY<STRING>>>, in
document order (one row per document, tokens lower-cased). N-grams are built next to the scan;
only those occurring at least twice inside their document can ever matter, and they are the only
rows that reach a shuffle. The duplicate filter compares hashes, which can only let extra grams
through; the grouping that follows compares the grams themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstat.functions import patterns as P
from inkstat.functions import text as T
from inkstat.operators import stats
from inkstat.session import cut

N, TAU, MIN_TOK, CEIL = 8, 0.5, 8, 0.10


def units_from_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every line of a document is a section, every sentence in it a unit."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x != "")
    per_line = F.transform(
        lines,
        lambda line, sec: F.transform(
            T.sentences(line),
            lambda s: F.struct(sec.cast("int").alias("sec"), F.when(sec == 0, "summary").otherwise("body").alias("role"), T.tokens(F.lower(s)).alias("toks")),
        ),
    )
    return docs.select("doc_id", F.flatten(per_line).alias("units"))


def _bearing(gram: Column) -> Column:
    """Whether a gram holds a sentinel; such grams are left out."""
    return gram.contains("xx") & gram.rlike(r"\b(?:" + "|".join(P.SENTINELS) + r")\b")


def _repeats(n: int) -> Column:
    """(n, ord, sec, role, n_tokens, pos, gram) of the grams whose hash occurs again in the document.

    Hashes are sorted and compared with their neighbours, so a text of many repeats costs no pairs; a gram's text is built only
    where its hash came twice.
    """
    def hashes(u: Column, ord_: Column) -> Column:
        return T.let(F.transform(u["toks"], lambda w: F.xxhash64(w)), lambda w: F.when(F.size(w) >= n, F.transform(
            F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda p: F.struct(F.xxhash64(F.slice(w, p, n)).alias("h"), ord_.cast("int").alias("ord"), (p - 1).cast("int").alias("pos")))))

    def kept(g: Column) -> Column:
        hash_at = lambda i: F.get(g, i)["h"]
        return F.filter(g, lambda x, i: F.coalesce(x["h"] == hash_at(i - 1), F.lit(False)) | F.coalesce(x["h"] == hash_at(i + 1), F.lit(False)))

    def row(x: Column) -> Column:
        return T.let(F.get(F.col("units"), x["ord"]), lambda u: F.struct(
            F.lit(n).alias("n"), x["ord"].alias("ord"), u["sec"].alias("sec"), u["role"].alias("role"), F.size(u["toks"]).alias("n_tokens"), x["pos"].alias("pos"),
            F.array_join(F.slice(u["toks"], x["pos"] + 1, n), " ").alias("gram")))

    return F.transform(T.let(F.sort_array(F.flatten(F.array_compact(F.transform("units", hashes)))), kept), row)


def repeated_grams(units: DataFrame, *ns: int) -> DataFrame:
    """Gram occurrences of every length (column n) whose gram occurs again in the same document, one row each; texts are read once."""
    each = F.flatten(F.array(*[_repeats(n) for n in ns or (N,)]))
    return units.select("doc_id", F.explode(each).alias("g")).select("doc_id", "g.*").where(~_bearing(F.col("gram")))


def gram_owners(units: DataFrame, n: int = N) -> DataFrame:
    """First occurrence of every repeated gram: the unit that owns it, and how often it occurs."""
    return repeated_grams(units, n).drop("n").groupBy("doc_id", "gram").agg(
        F.min(F.struct("ord", "sec")).alias("o"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(
        "doc_id", "gram", F.col("o.ord").alias("owner_ord"), F.col("o.sec").alias("owner_sec"), "n")


def recycled_units(units: DataFrame, *ns: int, cliches: DataFrame | None = None) -> DataFrame:
    """Units with covered tokens by gram length n: count, longest run, most frequent source unit.

    A token is covered inside a gram first seen in an earlier unit of another section. Sources tie
    to the one met first.
    """
    occ = repeated_grams(units, *ns)
    if cliches is not None:
        occ = occ.withColumn("h1", F.xxhash64("gram")).withColumn("h2", F.hash("gram")).join(cliches.select("h1", "h2"), ["h1", "h2"], "left_anti")
    text, unit = ["n", "doc_id"], ["n", "doc_id", "ord", "sec", "role", "n_tokens"]
    same = Window.partitionBy(*text, "gram")
    # few rows, read twice below: covered tokens and sources
    hits = cut(
        occ.withColumn("o", F.min(F.struct("ord", "sec", "role")).over(same))
        .where((F.col("o.ord") < F.col("ord")) & (F.col("o.sec") != F.col("sec")))
        .select(*unit, "pos", F.col("o.ord").alias("src_ord"), F.col("o.role").alias("src_role"))
    )
    along = Window.partitionBy(*text, "ord").orderBy("pos")
    # a gram adds n tokens unless the next one starts earlier; a run breaks where the gap exceeds n
    stepped = hits.withColumn("step", F.least(F.col("n"), F.coalesce(F.lead("pos").over(along) - F.col("pos"), F.col("n")))).withColumn(
        "run", F.sum(F.when(F.col("pos") - F.lag("pos").over(along) <= F.col("n"), 0).otherwise(1)).over(along))
    runs = stepped.groupBy(*unit, "run").agg(F.sum("step").alias("len"))
    covered = runs.groupBy(*unit).agg(F.sum("len").alias("covered"), F.max("len").alias("longest_run"))
    sources = hits.groupBy(*text, "ord", "src_ord", "src_role").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("p")).groupBy(*text, "ord").agg(
        F.max(F.struct("c", (-F.col("p")).alias("first"), "src_ord", "src_role")).alias("s"))
    return covered.join(sources.select(*text, "ord", F.col("s.src_ord").alias("src_ord"), F.col("s.src_role").alias("src_role")), [*text, "ord"])


def sentence_rows(units: DataFrame, n: int = N, tau: float = TAU, cliches: DataFrame | None = None) -> DataFrame:
    """One row per covered unit with r, eligibility and the recycled verdict."""
    r = F.col("covered") / F.col("n_tokens")
    eligible = F.col("n_tokens") >= MIN_TOK
    return recycled_units(units, n, cliches=cliches).select(
        "doc_id", "ord", "sec", "role", "n_tokens", "covered", "longest_run", "src_ord", "src_role", r.alias("r"),
        eligible.alias("eligible"), (eligible & (r >= tau)).alias("recycled"))


def document_scores(units: DataFrame, n: int = N, tau: float = TAU, cliches: DataFrame | None = None) -> DataFrame:
    """recycled / eligible per document with its numerator, denominator and observations."""
    sizes = F.transform("units", lambda u: F.size(u["toks"]))
    base = units.select(
        "doc_id", F.size("units").alias("n_sentences"),
        F.size(F.filter(sizes, lambda s: s >= MIN_TOK)).alias("n_eligible"),
        F.size(F.filter("units", lambda u: (F.size(u["toks"]) >= MIN_TOK) & (u["role"] == "body"))).alias("n_eligible_body"),
        F.aggregate(sizes, F.lit(0), lambda a, s: a + s).alias("n_words"),
    )
    rows = sentence_rows(units, n, tau, cliches)
    rec = rows.groupBy("doc_id").agg(
        F.count_if("recycled").alias("n_recycled"),
        F.count_if(F.col("recycled") & (F.col("role") == "body")).alias("n_recycled_body"),
        F.sum("covered").alias("covered"), F.max("longest_run").alias("longest_repeat"),
        F.sum(F.when(F.col("eligible"), F.col("r"))).alias("sum_r"))
    joined = base.join(rec, "doc_id", "left").na.fill(0, ["n_recycled", "n_recycled_body", "covered", "longest_repeat"]).na.fill(0.0, ["sum_r"])
    score = F.when(F.col("n_eligible") > 0, F.col("n_recycled") / F.col("n_eligible"))
    summary = F.col("n_eligible") - F.col("n_eligible_body")
    return joined.select(
        "doc_id", "n_sentences", "n_eligible", "n_recycled", "n_words", score.alias("score"),
        (F.col("n_eligible") < 3).alias("weak"),
        F.when(F.col("n_sentences") > 0, F.col("n_eligible") / F.col("n_sentences")).alias("coverage"),
        F.when(score.isNotNull(), F.least(F.lit(1.0), score / CEIL)).alias("score_agg"),
        F.when(F.col("n_eligible_body") > 0, F.col("n_recycled_body") / F.col("n_eligible_body")).alias("score_body"),
        F.when(summary > 0, (F.col("n_recycled") - F.col("n_recycled_body")) / summary).alias("score_summary"),
        (F.col("covered") / F.greatest(F.col("n_words"), F.lit(1))).alias("repeat_word_rate"),
        F.when(F.col("n_eligible") > 0, F.col("sum_r") / F.col("n_eligible")).alias("mean_r"),
        "longest_repeat",
    )


def recycled_by_pair(units: DataFrame, n: int = N, tau: float = TAU) -> DataFrame:
    """Corpus counts of recycled sentences per source role > role."""
    rows = sentence_rows(units, n, tau).where("recycled")
    return rows.groupBy(F.concat_ws(">", "src_role", "role").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def frequent_grams(units: DataFrame, min_docs: int, n: int = N) -> DataFrame:
    """Grams present in at least ``min_docs`` documents, as two hashes (96 bits) and the count.

    Each document contributes a gram once before the shuffle, and the count is a partial
    aggregate, so a stock phrase of the whole corpus costs one row per task.
    """
    # texts are distinct by their hash codes; structs would be compared in pairs
    grams = F.array_distinct(F.flatten(F.transform("units", lambda u: T.grams(u["toks"], n))))
    once = units.select(F.explode(grams).alias("gram")).where(~_bearing(F.col("gram")))
    return once.groupBy(F.xxhash64("gram").alias("h1"), F.hash("gram").alias("h2")).agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def sweep(units: DataFrame, ns: list[int], taus: list[float]) -> DataFrame:
    """Corpus totals for every (n, tau): eligible, recycled, mean score."""
    eligible = F.size(F.filter("units", lambda u: F.size(u["toks"]) >= MIN_TOK))
    totals = units.agg(F.sum(eligible).alias("n_eligible"))
    rows = recycled_units(units, *ns).where(F.col("n_tokens") >= MIN_TOK).select("n", (F.col("covered") / F.col("n_tokens")).alias("r"), F.explode(F.array(*[F.lit(t) for t in taus])).alias("tau"))
    out = rows.groupBy("n", "tau").agg(F.count_if(F.col("r") >= F.col("tau")).alias("n_recycled"))
    return out.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").select(
        "n", "tau", "n_recycled", "n_eligible", (F.col("n_recycled") / F.col("n_eligible")).alias("score"))


def separation(units: DataFrame, labels: DataFrame) -> DataFrame:
    """AUROC of the document score against a binary label."""
    scored = document_scores(units).select("doc_id", "score").join(labels, "doc_id").withColumn("system", F.lit("redundancy"))
    return stats.two_sample(scored, ["system"], "score").select("system", "n_pos", "n_neg", "auroc", "cliff")
