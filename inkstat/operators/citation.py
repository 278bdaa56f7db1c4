"""Citation sentences and relation claims.

``tag_sentences`` works on (doc_id, para, ord, text); the only state, the works already seen in
the paragraph, is a window over that paragraph and is updated after the sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstat.functions import patterns as P
from inkstat.functions import text as T

WEAVING = ("BUNDLE", "MULTI", "REL")
MIN_CITING = 8


def raw_sentences(paragraph: Column) -> Column:
    """Sentence split that also opens at macros, parentheses and ties."""
    cut = rf"(?<=[.!?])(?<!(?i:\b(?:et al|e\.g|i\.e|cf|vs|Fig|Eq|Sec|Tab|resp|approx|no|etc|al)\.))\s+(?=[A-Z\\(\[~0-9])"
    return F.filter(F.split(F.trim(paragraph), cut), lambda s: ~s.rlike(r"^\s*$"))


def merge_paragraphs(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, sec, ord, text) to paragraphs with their predecessor as context.

    A chunk joins the one before it when that one does not end a sentence or it starts in lower
    case or with a digit; paragraphs under eight words are dropped.
    """
    w = Window.partitionBy("doc_id", "sec").orderBy("ord")
    prev = F.lag("text").over(w)
    starts = prev.isNull() | (prev.rlike(r"[.!?:]\s*[\)\]\"']*$") & ~F.col("text").rlike(r"^[a-z0-9]"))
    grouped = chunks.withColumn("starts", starts.cast("int")).withColumn("grp", F.sum("starts").over(w))
    merged = grouped.groupBy("doc_id", "sec", "grp").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("c")).select(
        "doc_id", "sec", "grp", F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("text"))
    words = F.size(F.regexp_extract_all(F.regexp_replace("text", P.CITE, " "), F.lit(r"[A-Za-z]{2,}"), F.lit(0)))
    kept = merged.where(words >= 8)
    order = Window.partitionBy("doc_id", "sec").orderBy("grp")
    return kept.select("doc_id", "sec", (F.row_number().over(order) - 1).alias("para"), "text", F.coalesce(F.lag("text").over(order), F.lit("")).alias("context"))


def tag_sentences(sents: DataFrame) -> DataFrame:
    """Add works, tags and the weaving flag to every sentence."""
    s = sents.withColumn("groups", T.cite_keys(F.col("text"))).withColumn("groups", F.filter("groups", lambda g: F.size(g) > 0)).withColumns({
        "works": F.array_distinct(F.flatten("groups")), "body": F.regexp_replace("text", P.CITE, " ")})
    w = Window.partitionBy("doc_id", "para").orderBy("ord")
    s = s.withColumns({
        "seen": F.size(F.array_distinct(F.flatten(F.collect_list("works").over(w.rowsBetween(Window.unboundedPreceding, -1))))),
        "next_cited": F.coalesce(F.size(F.lead("groups").over(w)) > 0, F.lit(False)),
        "cited": F.size("groups") > 0, "n_works": F.size("works"),
    })
    has = lambda p: F.col("body").rlike(p)
    s = s.withColumns({"cue": has(P.CUE), "selfr": has(P.SELF), "grp": has(P.GROUP)})
    tag = {
        "BUNDLE": F.exists("groups", lambda g: F.size(F.array_distinct(g)) >= 2),
        "MULTI": (F.size("groups") >= 2) & (F.col("n_works") >= 2),
        "REL": (F.col("n_works") >= 2) & F.col("cue"),
        "REL1": (F.col("n_works") == 1) & (has(P.REL1) | has(P.REL1_INIT) | (F.col("grp") & (F.col("seen") >= 2))),
        "SELF": F.col("selfr") & (F.col("cue") | has(P.ANAPHOR) | (F.col("cited") & has(P.USES))) & (F.col("cited") | (F.col("seen") > 0) | F.col("next_cited")),
        "SYNTH": ~F.col("cited") & ~F.col("selfr") & (F.col("seen") >= 2) & (has(P.SYNTH_INIT) | (F.col("grp") & F.substring("body", 1, 70).rlike(P.GROUP))),
    }
    s = s.withColumn("tags", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tag.items()])))
    return s.select(*sents.columns, "works", "n_works", "tags", F.arrays_overlap("tags", F.array(*[F.lit(x) for x in WEAVING])).alias("weaving"))


def paragraph_rows(tagged: DataFrame) -> DataFrame:
    """Per paragraph: citing, weaving and self sentences, distinct works, and the chain verdict."""
    works = tagged.select("doc_id", "para", F.explode("works").alias("w")).distinct().groupBy("doc_id", "para").agg(F.count(F.lit(1)).alias("n_works"))
    rows = tagged.groupBy("doc_id", "para").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.col("n_works") > 0).alias("n_citing"), F.count_if("weaving").alias("n_weaving"),
        F.count_if(F.array_contains("tags", "SELF")).alias("n_self"))
    j = rows.join(works, ["doc_id", "para"], "left").na.fill(0, ["n_works"])
    return j.withColumns({"eligible": F.col("n_works") >= 3, "rw_chain": (F.col("n_works") >= 3) & (F.col("n_weaving") == 0)})


def isolation_scores(tagged: DataFrame) -> DataFrame:
    """isolated / citing sentences per document; weak below eight citing sentences."""
    doc = paragraph_rows(tagged).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_paragraphs"), F.sum("n_citing").alias("n_citing"), F.sum("n_weaving").alias("n_weaving"), F.sum("n_self").alias("n_self"),
        F.count_if("eligible").alias("n_eligible"), F.count_if("rw_chain").alias("n_chain"))
    den = F.nullif(F.col("n_citing"), F.lit(0))
    return doc.select(
        "doc_id", "n_paragraphs", "n_citing", "n_weaving", ((F.col("n_citing") - F.col("n_weaving")) / den).alias("score"), (F.col("n_citing") < MIN_CITING).alias("weak"),
        (F.col("n_weaving") / den).alias("co_citation_rate"), (F.col("n_self") / den).alias("self_positioning_rate"),
        (F.col("n_chain") / F.nullif(F.col("n_eligible"), F.lit(0))).alias("chain_rate"))


def verify_claims(claims: DataFrame) -> DataFrame:
    """Verdict of every relation claim against its paragraph.

    Input: kind, quote, target_phrase, targets, criterion, content, self_involved, other_side, keys,
    ctx_keys, text, context. Adds kind (possibly corrected), targets_verified, quote_verified,
    verdict (concrete / vague / inconclusive / not_a_unit) and reason.
    """
    c = claims.withColumns({
        "kind": F.when(F.col("kind").isin(P.CLAIM_KINDS), F.col("kind")),
        "window_keys": F.transform(F.array_union("keys", "ctx_keys"), F.lower),
        "window_text": T.normalize_quote(F.regexp_replace(F.concat_ws(" ", "text", "context"), P.CITE, " ")),
        "plain": F.regexp_replace("text", P.CITE, " "), "bare_quote": F.regexp_replace("quote", P.CITE, " "),
    })
    c = c.withColumn("targets_verified", F.filter("targets", lambda x: F.array_contains("window_keys", F.lower(x)) | (
        (F.length(T.normalize_quote(x)) >= 3) & F.col("window_text").contains(T.normalize_quote(x)))))
    phrase, verified = F.col("target_phrase"), F.size("targets_verified") > 0
    loose = (F.col("other_side") == "general") & ~verified & ~F.col("quote").rlike(P.CITE) & ~((phrase != "") & phrase.rlike(P.PRIOR_CLASS))
    no_cue = (F.coalesce(F.col("kind"), F.lit("")) == "comparison") & ~F.col("self_involved") & ~F.col("bare_quote").rlike(P.COMPARE_CUE)
    limit = F.col("bare_quote").rlike(P.LIMIT_CUE)
    guard = (
        F.when((phrase != "") & phrase.rlike(P.OWN_PHRASE), "own_phrase").when(F.col("other_side") == "own_work", "own_work")
        .when(loose, "general").when(no_cue & ~limit, "description"))
    c = c.withColumns({"guard": guard, "kind": F.when(guard.isNull() & no_cue & limit, "limitation").otherwise(F.col("kind"))})
    pieces = F.filter(F.transform(F.split("bare_quote", r"\.\.\.|…"), lambda f: F.trim(f)), lambda f: F.size(F.filter(F.split(f, r"\s+"), lambda x: x != "")) >= 3)
    c = c.withColumn("quote_verified", (F.size(pieces) > 0) & F.forall(pieces, lambda f: quote_found(f, F.col("plain"))))
    missing = F.array_compact(F.array(
        F.when(~verified, "no_target"), F.when((F.col("kind") == "comparison") & (F.col("criterion") == ""), "no_criterion"), F.when(F.col("content") == "", "no_content")))
    c = c.withColumn("missing", F.array_join(missing, "+"))
    reason = (
        F.when(F.col("guard").isNotNull(), F.col("guard")).when(F.col("kind").isNull(), "bad_kind").when(~F.col("quote_verified"), "quote_unverified")
        .when((F.size("targets") > 0) & ~verified, "target_unverified").otherwise(F.col("missing")))
    verdict = (
        F.when(F.col("guard").isNotNull(), "not_a_unit").when(reason.isin("bad_kind", "quote_unverified", "target_unverified"), "inconclusive")
        .when(F.col("missing") != "", "vague").otherwise("concrete"))
    return c.withColumns({"verdict": verdict, "reason": reason}).drop("guard", "missing", "window_keys", "window_text", "plain", "bare_quote")


def quote_found(quote: Column, source: Column) -> Column:
    """Exact, else normalized, else by the first 50 normalized characters of a longer quote."""
    nq, ns = T.normalize_quote(quote), T.normalize_quote(source)
    return source.contains(quote) | ((nq != "") & (ns.contains(nq) | ((F.length(nq) > 50) & ns.contains(F.substring(nq, 1, 50)))))


def quote_span(quote: Column, source: Column) -> Column:
    """struct(start, end) of a quote in its source, in code points, or null.

    An exact hit counts as it stands. Else both are normalized, the hit is counted in words and these are the
    runs of letters, digits and % of the source; a quote of over 50 normalized characters can hit by its first 50.
    """
    word = "[A-Za-z0-9%]"
    pieces = F.regexp_extract_all(source, F.lit(f"{word}+|[^A-Za-z0-9%]+"), F.lit(0))

    def by_words(nq: Column, ns: Column) -> Column:
        whole = F.instr(ns, nq)
        hit = F.when(whole > 0, whole).when(F.length(nq) > 50, F.instr(ns, F.substring(nq, 1, 50))).otherwise(0)

        def place(at: Column) -> Column:
            before = F.regexp_count(F.substring(ns, F.lit(1), at - 1), F.lit(" "))
            wanted = F.greatest(F.regexp_count(nq, F.lit(" ")) + 1, F.lit(1))

            def cut(parts: Column) -> Column:
                # words and what is between them take turns
                lead = F.when(F.get(parts, F.lit(0)).rlike(f"^{word}"), 0).otherwise(1)
                words = F.floor((F.size(parts) - lead + 1) / 2).cast("int")
                last = F.least(words - 1, before + wanted - 1)
                upto = lambda n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda x, y: x + F.length(y))
                return F.when(before < words, F.struct(upto(2 * before + lead).alias("start"), upto(2 * last + lead + 1).alias("end")))

            return T.let(pieces, cut)

        return F.when((nq != "") & (hit > 0), T.let(hit, place))

    def find(at: Column) -> Column:
        exact = F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end"))
        return F.when(at > 0, exact).otherwise(T.let(T.normalize_quote(quote), lambda nq: T.let(T.normalize_quote(source), lambda ns: by_words(nq, ns))))

    return F.when((quote != "") & (source != ""), T.let(F.instr(source, quote), find))


def verify_quotes(quotes: DataFrame) -> DataFrame:
    """(doc_id, quote, source) with the span of each quote; those without one are unverified."""
    return quotes.withColumn("span", quote_span(F.col("quote"), F.col("source")))


def quote_statistics(verified: DataFrame, by: list[str]) -> DataFrame:
    """Number of quotes and of unverified ones."""
    return verified.where("quote IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("span").isNull()).alias("unverified"))


def dedupe_claims(claims: DataFrame, order: str) -> DataFrame:
    """One row per (document, kind, sorted targets, criterion-or-content prefix) with its occurrences.

    Inconclusive claims are never merged: their key is their own position.
    """
    key_text = F.substring(T.normalize_quote(F.when(F.col("criterion") != "", F.col("criterion")).otherwise(F.col("content"))), 1, 60)
    own = F.when(F.col("verdict") == "inconclusive", F.col(order).cast("string"))
    keyed = claims.withColumns({"k_targets": F.array_join(F.sort_array(F.transform("targets_verified", F.lower)), "|"), "k_text": key_text, "k_own": F.coalesce(own, F.lit(""))})
    return keyed.groupBy("doc_id", "kind", "k_targets", "k_text", "k_own").agg(
        F.min(order).alias("first_claim"), F.min_by("verdict", order).alias("verdict"), F.min_by("reason", order).alias("reason"),
        F.min_by("self_involved", order).alias("self_involved"), F.count(F.lit(1)).alias("occurrences")).drop("k_own")


def claim_metrics(claims: DataFrame) -> DataFrame:
    """Verdict counts and rates per document."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    d = claims.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_claims"), n("concrete").alias("n_concrete"), n("vague").alias("n_vague"), n("inconclusive").alias("n_inconclusive"),
        F.count_if(F.col("self_involved") & (F.col("verdict") != "inconclusive")).alias("n_self"))
    decided = F.nullif(F.col("n_concrete") + F.col("n_vague"), F.lit(0))
    return d.withColumns({
        "concrete_rate": F.col("n_concrete") / decided, "vague_rate": F.col("n_vague") / decided, "inconclusive_rate": F.col("n_inconclusive") / F.nullif(F.col("n_claims"), F.lit(0))})


def claim_reasons(claims: DataFrame) -> DataFrame:
    return claims.groupBy("kind", "verdict", "reason").agg(F.count(F.lit(1)).alias("n"))


def median_run(runs: DataFrame, by: str, run: str, value: str) -> DataFrame:
    """Of repeated runs keep the one whose value is closest to their median (first on a tie)."""
    med = runs.where(F.col(value).isNotNull()).groupBy(by).agg(F.median(value).alias("med"))  # a handful of runs per group
    gap = F.abs(F.col(value) - F.col("med"))
    return runs.where(F.col(value).isNotNull()).join(med, by).groupBy(by).agg(
        F.min(F.struct(gap.alias("g"), F.col(run).alias("run"), F.col(value).alias("value"))).alias("b"), F.count(F.lit(1)).alias("n_runs")).select(
        by, F.col("b.run").alias(run), F.col("b.value").alias(value), "n_runs")
