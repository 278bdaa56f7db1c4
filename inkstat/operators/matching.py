"""Candidate pools, hard filters, ranking and one-to-one assignment."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstat.functions import patterns as P
from inkstat.functions import text as T
from inkstat.operators import ranks
from inkstat.operators.postings import weights_of
from inkstat.session import cut

SIGNATURE = 4  # longs of hashed words per title

# --------------------------------------------------------------------------- pools


def pool_union(listed: DataFrame, bib: DataFrame) -> DataFrame:
    """Merge both candidate sources per (query_id, cand_id): sources, bib keys; versions stripped.

    listed: query_id, cand_id; bib: query_id, key, cand_id. Rows without an id are left to the
    title queue.
    """
    strip = F.regexp_replace("cand_id", r"v\d+$", "").alias("cand_id")
    a = listed.where(F.col("cand_id").isNotNull()).select("query_id", strip, F.lit("listed").alias("source"), F.lit(None).cast("string").alias("key"))
    b = bib.where(F.col("cand_id").isNotNull()).select("query_id", strip, F.lit("bib").alias("source"), "key")
    return a.unionByName(b).groupBy("query_id", "cand_id").agg(
        F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_set("key")).alias("bib_keys"))


def title_queue(rows: DataFrame, junk: str) -> DataFrame:
    """Titles without an id, deduplicated by normal form, with how many queries ask for them."""
    ok = rows.where(F.col("cand_id").isNull() & (F.size(F.split(F.trim("title"), r"\s+")) >= 4) & ~F.col("title").rlike(junk))
    per = ok.groupBy(T.normalize_title(F.col("title")).alias("norm"), "query_id").agg(F.min("title").alias("title"))
    return per.groupBy("norm").agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n_queries"))


def merge_titles(pool: DataFrame, waiting: DataFrame, resolved: DataFrame) -> DataFrame:
    """Put resolved titles (norm -> cand_id) back into the pool of every query that waits for them."""
    back = waiting.withColumn("norm", T.normalize_title(F.col("title"))).join(resolved, "norm").select(
        "query_id", "cand_id", F.array(F.lit("title")).alias("sources"), F.array().cast("array<string>").alias("bib_keys"))
    both = pool.unionByName(back)
    return both.groupBy("query_id", "cand_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("bib_keys")))).alias("bib_keys"))


def title_candidates(parsed: DataFrame, known: DataFrame, jaccard: float, containment: float) -> DataFrame:
    """Pairs (id, known_id) that can match, both sides (id, words) of at least four words; see ``fuzzy_title_join``."""
    frequency = known.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))

    def placed(df: DataFrame, side: str) -> DataFrame:
        """One row per title and word: its place among the words of the title, their number, their bits."""
        bits = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(64 * SIGNATURE)).cast("int"))
        part = lambda q: F.aggregate(F.filter("bits", lambda h: F.floor(h / 64) == q), F.lit(0).cast("bigint"), lambda x, h: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), h % 64)))
        each = df.select("id", F.explode("words").alias("w")).join(frequency, "w", "left")
        order = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "w"))).alias("o"))
        # the sorted list holds the words, so no second copy of them moves
        named = order.withColumn("words", F.col("o.w")).withColumn("bits", bits).select("id", "o", *[part(q).alias(f"{side}{q}") for q in range(SIGNATURE)])
        return named.select(F.col("id").alias(f"{side}_id"), F.size("o").alias(f"{side}_n"), *[f"{side}{q}" for q in range(SIGNATURE)], F.posexplode("o").alias(f"{side}_at", "x")).where(
            F.col("x.f") > 0).withColumn("w", F.col("x.w")).drop("x")

    def reach(n: Column, share: float) -> Column:
        return n - F.ceil(n * F.lit(share) - 1e-9).cast("int")

    probe, entries = placed(parsed, "p"), placed(known, "k")
    pn, kn = F.col("p_n"), F.col("k_n")
    absent = lambda a, b: sum((F.bit_count(F.col(f"{a}{q}").bitwiseAND(F.bitwise_not(f"{b}{q}"))) for q in range(SIGNATURE)), F.lit(0))
    most = F.least(pn - absent("p", "k"), kn - absent("k", "p"))
    contained = (F.col("p_at") <= reach(pn, containment)) & (most >= pn * F.lit(containment) - 1e-9)
    alike = (F.col("p_at") <= reach(pn, jaccard)) & (F.col("k_at") <= reach(kn, jaccard)) & (most >= (pn + kn - most) * F.lit(jaccard) - 1e-9)
    probe = probe.where(F.col("p_at") <= reach(pn, min(jaccard, containment)))
    return probe.join(entries, "w").where(contained | alike).select(F.col("p_id").alias("id"), F.col("k_id").alias("known_id")).distinct()


def fuzzy_title_join(parsed: DataFrame, known: DataFrame, jaccard: float = 0.85, containment: float = 0.92) -> DataFrame:
    """Distinct titles of ``parsed`` that match distinct titles of ``known`` (column title).

    Equal titles are collapsed first, so a much-copied title multiplies no pairs. With the words of both sides in one order, rare
    ones first, a match by containment shares one of the first |P| - ceil(containment * |P|) + 1 words of P, a match by jaccard one of
    such a prefix of both. Bit sets of the hashed words bound what two titles can share, so a pair that cannot match ends inside the
    join; ids move for the others, the titles themselves only for pairs the bound leaves, and their words decide.
    """
    def titles(df: DataFrame) -> DataFrame:
        norm = df.select(T.normalize_title(F.col("title")).alias("norm")).where(F.col("norm") != "").groupBy("norm").agg(F.count(F.lit(1)).alias("copies"))
        return cut(norm.select(F.monotonically_increasing_id().alias("id"), "norm", "copies"))

    words = lambda c: F.array_distinct(F.split(c, " "))
    p, k = titles(parsed), titles(known).select(F.col("id").alias("known_id"), F.col("norm").alias("known"), F.col("copies").alias("known_copies"))
    pw, kw = p.select("id", words(F.col("norm")).alias("words")), k.select(F.col("known_id").alias("id"), words(F.col("known")).alias("words"))
    # under four words only the same word set can pass, which is an equality
    same = F.array_join(F.sort_array("words"), " ").alias("key")
    short = pw.where(F.size("words") < 4).select("id", same).join(kw.where(F.size("words") < 4).select(F.col("id").alias("known_id"), same), "key").select("id", "known_id")

    pairs = title_candidates(*(x.where(F.size("words") >= 4) for x in (pw, kw)), jaccard, containment)
    full = pairs.unionByName(short).join(p, "id").join(k, "known_id").select("norm", "copies", "known", "known_copies", words(F.col("norm")).alias("words"), words(F.col("known")).alias("kw"))
    common = F.size(F.array_intersect("words", "kw"))
    jac = common / F.size(F.array_union("words", "kw"))
    con = common / F.size("words")
    return full.where((jac >= jaccard) | ((F.size("words") >= 4) & (con >= containment))).select("norm", "known", jac.alias("jaccard"), con.alias("containment"), "copies", "known_copies")


def best_title_match(pairs: DataFrame, bonus: float = 0.05, cutoff: float = 0.9) -> DataFrame:
    """Best match per title by jaccard plus an author bonus; below the cut-off nothing is kept."""
    score = F.col("jaccard") + F.when(F.col("author_match"), bonus).otherwise(0.0)
    return pairs.withColumn("score", score).where(F.col("score") >= cutoff).groupBy("norm").agg(F.max(F.struct("score", "known")).alias("b")).select("norm", "b.known", "b.score")


# --------------------------------------------------------------------------- hard filters


def human_filter(fraction_by_id: Column, fraction_by_title: Column, year: Column, limit: float = 0.05) -> Column:
    """struct(pass, by): a verified fraction within the limit, else an old enough year (even then)."""
    f = F.coalesce(fraction_by_id, fraction_by_title)
    return (
        F.when(f <= limit, F.struct(F.lit("pass").alias("verdict"), F.lit("fraction").alias("by")))
        .when(year <= 2024, F.struct(F.lit("pass").alias("verdict"), F.lit("year<=2024").alias("by")))
        .otherwise(F.struct(F.lit("fail").alias("verdict"), F.when(f.isNotNull(), "fraction>limit").otherwise("2025+ unverified").alias("by"))))


def venue_filter(accepted: Column, tier: Column, listed_venue: Column, comment: Column) -> Column:
    """struct(verdict, venue, by): acceptance record, then the listed venue, then the comment."""
    hit = F.coalesce(F.nullif(F.regexp_extract(comment, P.VENUE_DATED, 0), F.lit("")), F.nullif(F.regexp_extract(comment, P.VENUE_ACCEPTED, 0), F.lit("")))
    clean = comment.isNotNull() & (comment != "") & ~comment.rlike(P.VENUE_BAD) & hit.isNotNull()
    row = lambda v, venue, by: F.struct(F.lit(v).alias("verdict"), venue.alias("venue"), F.lit(by).alias("by"))
    return (
        F.when(F.coalesce(accepted, F.lit(False)), row("pass", F.trim(F.concat_ws(" ", F.lit("accepted"), tier)), "record"))
        .when(listed_venue.isNotNull(), row("pass", listed_venue, "list"))
        .when(clean, row("pass", F.substring(F.regexp_replace(hit, r"\s+", " "), 1, 40), "comment"))
        .otherwise(row("fail", F.coalesce(F.nullif(F.substring(comment, 1, 40), F.lit("")), F.lit("preprint")), "none")))


def contribution_type(title: Column, abstract: Column) -> Column:
    """Heuristic type; the first rule that holds decides."""
    t, a = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(abstract, F.lit("")))
    both = F.concat(t, F.lit(" "), F.substring(a, 1, 900))
    opening = F.substring(a, 1, 400)
    return (
        F.when(t.rlike(P.TYPE_SURVEY), "survey").when(t.rlike(P.TYPE_BENCHMARK), "benchmark").when(t.rlike(P.TYPE_DATASET) & ~t.rlike(P.TYPE_NOT_DATASET), "dataset")
        .when(t.rlike(P.TYPE_QUESTION) | t.rlike(P.TYPE_ANALYSIS), "analysis").when(both.rlike(P.TYPE_FRAMEWORK), "framework").when(a.rlike(P.TYPE_METHOD), "method")
        .when(opening.contains("benchmark") & opening.rlike(P.TYPE_RELEASE), "benchmark").otherwise("method"))


def incompatible(a: Column, b: Column) -> Column:
    """Unordered incompatible type pairs."""
    out = F.lit(False)
    for x, y in P.TYPE_INCOMPATIBLE:
        out = out | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return out


def source_filter(body_words: Column, n_sections: Column, error: Column, min_words: int = 2500, min_sections: int = 4) -> Column:
    return F.when(body_words.isNotNull(), F.when((body_words >= min_words) & (n_sections >= min_sections), "pass").otherwise("fail")).when(error, "fail").otherwise("unknown")


# --------------------------------------------------------------------------- shortlists and ranking


def shortlist(survivors: DataFrame, order: Sequence[Column], n: int = 7) -> DataFrame:
    """Top-n per query (the feature of a shortlist) and how many survived in all."""
    w = Window.partitionBy("query_id").orderBy(*order)
    counts = survivors.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_survivors"))
    # row_number() <= n is pruned per task before the shuffle, so a hot query costs n rows per task
    return survivors.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).join(counts, "query_id")


def pack_batches(queries: DataFrame, key: str, done: DataFrame | None = None, size: int = 12) -> DataFrame:
    """Number the queries in key order, finished ones left out, and cut them into batches."""
    todo = queries.select(key).distinct()
    if done is not None:
        todo = todo.join(done.select(key), key, "left_anti")
    return ranks.numbered(todo, [], key).select(key, F.floor((F.col("rn") - 1) / size).alias("batch"))


def judged_override(cands: DataFrame) -> DataFrame:
    """Judged type and tier replace the heuristic ones; final flags and the reject reason string."""
    judged = F.col("judged_type").isNotNull()
    c = cands.withColumns({"type": F.coalesce("judged_type", "heur_type"), "type_source": F.when(judged, "judged").otherwise("heuristic")})
    c = c.withColumn("h3", F.when(F.col("type") == F.col("query_type"), "pass").otherwise("fail"))
    first = (F.col("h1") == "pass") & (F.col("h2") == "pass") & (F.col("h3") == "pass")
    reasons = F.concat_ws(
        ";", F.when(F.col("h1") == "fail", F.concat(F.lit("H1:"), F.col("h1_by"))), F.when(F.col("h2") == "fail", F.concat(F.lit("H2:"), F.col("venue"))),
        F.when(F.col("h3") == "fail", F.concat(F.lit("H3:"), F.col("type"), F.lit("!="), F.col("query_type"))), F.when(F.col("h4") == "fail", "H4:short/unstructured tex"))
    c = c.withColumns({"hard_pass": first & (F.col("h4") == "pass"), "h4_pending": first & (F.col("h4") == "unknown"), "_r": reasons})
    return c.withColumn("reject_reason", F.when((F.col("_r") == "") & F.col("tier").isNull(), "not shortlisted for tier judging").otherwise(F.col("_r"))).drop("_r")


def rank_key(ratio_max: float = 2.5) -> Column:
    """Ascending sort key: tier, parent, rated, length ratio, artifacts, year, id."""
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)
    return F.struct(
        (-F.coalesce(F.col("tier"), F.lit(0))).cast("int").alias("k1"), flag(F.col("relation") == "parent").alias("k2"), flag(F.col("rating").isNotNull()).alias("k3"),
        flag(F.col("body_ratio") <= ratio_max).alias("k4"), (-(F.col("has_code").cast("int") + F.col("has_figure").cast("int"))).alias("k5"),
        (-F.coalesce(F.col("year"), F.lit(0))).cast("int").alias("k6"), F.col("cand_id").alias("k7"))


def ranked_candidates(cands: DataFrame) -> DataFrame:
    """Eligible rows with their sort key and position inside the query."""
    elig = cands.where((F.col("hard_pass") | F.col("h4_pending")) & (F.coalesce("tier", F.lit(0)) >= 1)).withColumn("key", rank_key())
    # positions come from the rank core: a query may hold a third of all candidates
    return ranks.numbered(elig, ["query_id"], "key", "position")


# --------------------------------------------------------------------------- assignment


def assign(ranked: DataFrame, reserved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One-to-one assignment by rounds: (assigned, conflicts).

    Every open query proposes its best free candidate; a candidate takes the best proposal by
    (sort key, query) for good. Losers stay in the pool. Each round keeps only pairs whose two
    sides are free and writes them to the checkpoint folder, so lineage never grows.
    """
    pairs = ranked.select("query_id", "cand_id", "key", F.coalesce("tier", F.lit(0)).alias("tier"))
    if reserved is not None:
        pairs = pairs.join(reserved.select("cand_id"), "cand_id", "left_anti")
    pairs = cut(pairs)
    won, lost = [], []
    for n in count(1):  # each round but the last assigns a candidate, so it ends
        best = pairs.groupBy("query_id").agg(F.min(F.struct("key", "cand_id", "tier")).alias("b")).select("query_id", "b.cand_id", "b.key", "b.tier")
        judged = best.groupBy("cand_id").agg(F.min(F.struct("key", "query_id", "tier")).alias("w")).select("cand_id", F.col("w.query_id").alias("query_id"), F.col("w.tier").alias("tier"))
        accepted = cut(judged.withColumn("round", F.lit(n)))
        if accepted.isEmpty():
            break
        won.append(accepted)
        kept = accepted.select("cand_id", F.col("query_id").alias("kept"), F.col("tier").alias("kept_tier"))
        lost.append(cut(best.join(kept, "cand_id").where(F.col("query_id") != F.col("kept")).select(
            "cand_id", "kept", "kept_tier", F.col("query_id").alias("bumped"), F.col("tier").alias("bumped_tier"), F.lit(n).alias("round"))))
        pairs = cut(pairs.join(accepted.select("query_id"), "query_id", "left_anti").join(accepted.select("cand_id"), "cand_id", "left_anti"))
    empty = accepted.select("cand_id", F.lit(None).cast("bigint").alias("kept"), F.lit(0).alias("kept_tier"), F.lit(None).cast("bigint").alias("bumped"), F.lit(0).alias("bumped_tier"), F.lit(0).alias("round")).limit(0)
    return _union(won or [accepted]), _union(lost or [empty])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def serial_assign(ranked: DataFrame, order: str = "query_id") -> DataFrame:
    """What results when queries pick in turn, each its best candidate nobody earlier took.

    All candidates prefer the earlier query, so rejecting later proposers round by round reaches
    the same unique outcome without visiting queries one at a time. ranked: query, cand_id, position.
    """
    pairs = cut(ranked.select(order, "cand_id", "position"))
    while True:  # each round but the last refuses a pair
        best = pairs.groupBy(order).agg(F.min(F.struct("position", "cand_id")).alias("b")).select(order, "b.cand_id", "b.position")
        holder = best.groupBy("cand_id").agg(F.min(order).alias("_first"))
        refused = cut(best.join(holder, "cand_id").where(F.col(order) > F.col("_first")).select(order, "cand_id"))
        if refused.isEmpty():
            return best
        pairs = cut(pairs.join(refused, [order, "cand_id"], "left_anti"))


def spread_shortlist(ranked: DataFrame, k: int = 3) -> DataFrame:
    """Top-k per query in query order, leaving out candidates that are an earlier query's first pick."""
    first = serial_assign(ranked).select("cand_id", F.col("query_id").alias("owner"))
    free = ranked.join(first, "cand_id", "left").where(F.col("owner").isNull() | (F.col("owner") >= F.col("query_id"))).drop("owner")
    w = Window.partitionBy("query_id").orderBy("position")
    return free.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


def alternates(ranked: DataFrame, assigned: DataFrame, k: int = 2) -> DataFrame:
    """Next k ranked candidates of every assigned query that nobody holds."""
    free = ranked.join(assigned.select("query_id").distinct(), "query_id", "left_semi").join(assigned.select("cand_id").distinct(), "cand_id", "left_anti")
    w = Window.partitionBy("query_id").orderBy("key")
    return free.withColumn("alternate", F.row_number().over(w)).where(F.col("alternate") <= k)


def no_candidate_reasons(queries: DataFrame, cands: DataFrame, assigned: DataFrame) -> DataFrame:
    """Why a query stays without a candidate, from aggregates of its candidate rows."""
    ok = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
    h1, h2 = F.col("h1") == "pass", F.col("h2") == "pass"
    a = cands.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), ok(h1).alias("a1"), ok(h1 & h2).alias("a2"), ok(F.col("hard_pass")).alias("a3"),
        ok((F.col("hard_pass") | F.col("h4_pending")) & (F.coalesce("tier", F.lit(0)) >= 1)).alias("a4"))
    open_ = queries.join(assigned.select("query_id"), "query_id", "left_anti").join(a, "query_id", "left")
    return open_.select("query_id", (
        F.when(F.col("n").isNull(), "empty candidate pool").when(F.col("a1") == 0, "no human-verified citation").when(F.col("a2") == 0, "no accepted citation among verified")
        .when(F.col("a3") == 0, "hard filters leave none").when(F.col("a4") == 0, "tier-0 survivors only").otherwise("all ranked candidates taken")).alias("reason"))


def relaxed_rank(judged: DataFrame) -> DataFrame:
    """Fill level 4..0 by (tier, same type), the caveats of the level, and the order inside a query."""
    t, same = F.coalesce("tier", F.lit(-1)), F.coalesce("same_type", F.lit(False))
    level = F.when((t >= 2) & same, 4).when(t >= 2, 3).when((t == 1) & same, 2).when(t == 1, 1).otherwise(0)
    j = judged.withColumn("level", level)
    low = F.when(F.col("level") == 0, "similarity_tier_0_or_unjudged").when(F.col("level").isin(1, 2), "similarity_tier_1")
    kind = F.when(F.col("level") == 0, "contribution_type_unchecked").when(F.col("level").isin(1, 3), "contribution_type_mismatch")
    j = j.withColumn("caveats", F.concat_ws(";", low, kind))
    key = F.struct((-F.col("level")).alias("a"), (-t).alias("b"), (-F.coalesce("rating", F.lit(0.0))).alias("c"), (-F.col("sim")).alias("d"), "cand_id")
    return ranks.numbered(j.withColumn("key", key), ["query_id"], "key", "position")


def merge_widened(draft: DataFrame, widened: DataFrame) -> DataFrame:
    """Add widened pairs for queries that still have none and pass the length recheck."""
    ok = widened.where((F.col("body_words") >= 2500) & (F.col("n_sections") >= 4)).join(draft.select("query_id"), "query_id", "left_anti")
    return draft.withColumn("pool", F.lit("cited")).unionByName(ok.select("query_id", "cand_id").withColumn("pool", F.lit("widened")))


def caveat_flags(pairs: DataFrame) -> DataFrame:
    """Caveats of a pair and whether it is ready (none)."""
    c = F.array_compact(F.array(
        F.when(F.coalesce("body_ratio", F.lit(0.0)) > 2.5, "body_ratio_over_2.5"), F.when(F.col("tier") == 1, "similarity_tier_1"),
        F.when(F.col("extended"), "eprint_may_be_extended"), F.when(F.col("shared_anchor"), "anchor_shared")))
    return pairs.withColumn("caveats", F.when(F.col("cand_id").isNull(), F.array().cast("array<string>")).otherwise(c)).withColumn(
        "ready", F.col("cand_id").isNotNull() & (F.size("caveats") == 0))


# --------------------------------------------------------------------------- text neighbours


def words_by_id(docs: DataFrame, stop: Sequence[str] = tuple(P.STOP_WORDS)) -> DataFrame:
    """(doc_id, w): words in any script of the texts of an id, one list for each text that is not null."""
    # terms of one id are counted in one row, so only texts that share an id move
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = docs.select("doc_id", F.array("text").alias("texts"))
    else:
        texts = docs.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    words = lambda text: F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(list(stop)))
    return texts.select("doc_id", F.filter(F.transform("texts", words), lambda w: w.isNotNull()).alias("w"))


def term_counts(docs: DataFrame, stop: Sequence[str] = tuple(P.STOP_WORDS)) -> DataFrame:
    """(doc_id, term, tf): uni- and bigrams of words in any script, counted inside of the row of their text."""
    follow = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    rows = words_by_id(docs, stop).select(
        "doc_id", F.sort_array(F.concat(F.flatten("w"), F.flatten(F.transform("w", follow)))).alias("t"))
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.get("t", i - 1) != F.get("t", i - 2)))
    rows = rows.withColumn("at", F.when(F.size("t") > 0, starts))
    ends = F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("t") + 1))
    # neither term nor, below, doc_id is filtered against null: that would be done for one reader of the terms only and make two exchanges of them
    runs = F.zip_with("at", ends, lambda a, b: F.struct(F.coalesce(F.get("t", a - 1), F.lit("")).alias("term"), (b - a).alias("tf")))
    return rows.select("doc_id", F.explode(runs).alias("r")).select("doc_id", "r.term", "r.tf")


def tfidf_weights(docs: DataFrame, min_df: int = 2, stop: Sequence[str] = tuple(P.STOP_WORDS), only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, w): uni- and bigrams of words in any script, (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), l2-normalized.

    Every term counts for the lengths; ``only`` (column term) leaves the weights of its terms. All terms move once, dealt by
    term; lengths are summed where the terms are, and the weights asked for move to them.
    """
    counts = term_counts(docs, stop).repartition("term")
    n = docs.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    # reading tf and doc_id keeps this branch on the same exchange as the weights below
    df = counts.groupBy("term").agg(F.count(F.when((F.col("tf") > 0) | F.col("doc_id").isNull(), 1)).alias("df")).where(F.col("df") >= min_df)
    idf = df.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one").select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    # a hash of the terms of one part: sorting all terms of all texts for a merge would spill them
    raw = counts.join(idf.hint("shuffle_hash"), "term").select("doc_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    length = raw.groupBy(F.col("doc_id").alias("_doc")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    kept = raw if only is None else raw.join(only.select("term").distinct(), "term", "left_semi")
    return kept.join(length, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "term", (F.col("w") / F.col("length")).alias("w"))


def search_weights(docs: DataFrame, terms: DataFrame, min_df: int = 2, stop: Sequence[str] = tuple(P.STOP_WORDS)) -> DataFrame:
    """``tfidf_weights`` of the terms a search asks for; the terms of all texts move as packed postings."""
    return weights_of(docs, words_by_id(docs, stop), terms, min_df)


def few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` to be broadcast if it is counted to have at most ``rows`` rows, so that the other side of a join need not move."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top_neighbours(queries: DataFrame, docs: DataFrame, k: int = 3, champions: int = 12, split: int = 100_000) -> DataFrame:
    """The k most similar documents of every query by cosine, exactly; ties go to the smaller id.

    Both sides are (doc_id, term, w) with lengths of at most 1 and no negative weights. Sums over the
    ``champions`` heaviest documents of each term pick a few documents whose cosines give every
    query a floor below its k-th best. Its most frequent terms are then set aside for as long as all
    of them together stay under that floor: a document that shares only those cannot get among the
    best. The other terms meet the postings, sums that cannot reach the floor any more are dropped,
    and what was set aside is added for the rest. Postings of a term move in parts of about
    ``split`` documents, or stay where they are if what meets them is a few rows. A query with no k documents in common keeps all terms; one that shares no
    term, or has none, gives no row. ``docs`` is read several times, so it should be written before.
    """
    q = queries.select(F.col("doc_id").alias("query_id"), "term", F.col("w").alias("wq"))
    shared = docs.join(few(queries.select("term").distinct()), "term", "left_semi")
    stats = cut(shared.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("top")))
    parts = F.ceil(F.col("df") / split)
    postings = docs.join(few(stats), "term").select(
        F.col("doc_id").alias("cand_id"), "term", "w", F.pmod(F.xxhash64("doc_id"), parts).alias("part"))

    def dots(pairs: DataFrame, terms: DataFrame) -> DataFrame:
        wanted = pairs.select("query_id", "cand_id").join(terms.select("query_id", "term", "wq"), "query_id")
        return few(wanted).join(postings.drop("part"), ["cand_id", "term"]).select("query_id", "cand_id", (F.col("wq") * F.col("w")).alias("s"))

    def sums(found: DataFrame) -> DataFrame:
        return found.groupBy("query_id", "cand_id").agg(F.sum("s").alias("s"))

    def best(found: DataFrame, by: str, n: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc(by), "cand_id")
        return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)

    heavy = Window.partitionBy("term").orderBy(F.desc("w"), "cand_id")
    first = postings.drop("part").withColumn("_n", F.row_number().over(heavy)).where(F.col("_n") <= champions)
    guess = sums(q.join(first, "term").select("query_id", "cand_id", (F.col("wq") * F.col("w")).alias("s")))
    floors = best(sums(dots(cut(best(guess, "s", max(champions, k))), q)), "s", k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("s")).otherwise(0.0).alias("floor"))

    # a millionth of a millionth of slack would do for sums in another order; ties of rounded cosines need more
    frequent = Window.partitionBy("query_id").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.least(F.sum(F.col("wq") * F.col("top")).over(frequent), F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(frequent)))
    ordered = cut(q.join(stats, "term").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - 1e-8).withColumn("reach", reach))
    aside = ordered.where(F.col("reach") < F.col("floor"))
    bounds = ordered.groupBy("query_id").agg(
        F.first("floor").alias("floor"), F.coalesce(F.max(F.when(F.col("reach") < F.col("floor"), F.col("reach"))), F.lit(0.0)).alias("rest"))
    met = ordered.where(F.col("reach") >= F.col("floor")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).select("query_id", "term", "wq", "part")
    met = sums(few(met).join(postings, ["term", "part"]).select("query_id", "cand_id", (F.col("wq") * F.col("w")).alias("s")))
    open_ = cut(met.join(bounds, "query_id").where(F.col("s") + F.col("rest") >= F.col("floor")).select("query_id", "cand_id", "s"))
    found = sums(open_.unionByName(dots(open_, aside))).withColumn("sim", F.round("s", 9)).where(F.col("sim") > 0)
    return best(found, "sim", k).select("query_id", "cand_id", "sim", "position")


def source_coverage(pairs: DataFrame, n: int = 6, accept: float = 0.85) -> DataFrame:
    """Share of sentences (>= 12 words) of ``text`` with a word n-gram found in ``other``."""
    sents = pairs.select("pair_id", F.posexplode(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 12)).alias("k", "s"))
    words = lambda c: F.split(T.normalize_title(c), " ")
    grams = sents.select("pair_id", "k", F.explode(T.grams(words(F.col("s")), n)).alias("g"))
    other = pairs.select("pair_id", F.explode(F.array_distinct(T.grams(words(F.col("other")), n))).alias("g"))
    hits = grams.join(other, ["pair_id", "g"], "left_semi").groupBy("pair_id", "k").agg(F.lit(1).alias("hit"))
    total = sents.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    cov = total.join(hits.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_hit")), "pair_id", "left").na.fill(0, ["n_hit"])
    return cov.withColumn("coverage", F.col("n_hit") / F.col("n_sentences")).withColumn("accepted", F.col("coverage") >= accept)


def best_version(versions: DataFrame, by: str, min_title: float = 0.9) -> DataFrame:
    """Among versions whose title is close enough: highest coverage (three places), then most words."""
    ok = versions.where(F.col("title_sim") >= min_title)
    key = F.struct(F.round("coverage", 3).alias("coverage"), F.col("body_words").alias("body_words"), F.col("version").alias("version"))
    return ok.groupBy(by).agg(F.max(key).alias("b")).select(by, "b.version", "b.coverage", "b.body_words")


def near_misses(cands: DataFrame, k: int = 3) -> DataFrame:
    """The most similar candidates that a hard filter blocked."""
    w = Window.partitionBy("query_id").orderBy(F.desc("tier"), F.desc("rating"), "cand_id")
    return cands.where(~F.col("hard_pass") & F.col("body_words").isNotNull()).withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
