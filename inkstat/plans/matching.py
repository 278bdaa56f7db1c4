"""Registered queries of candidate generation, filtering and matching (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstat.functions import patterns as P
from inkstat.functions import text as T
from inkstat.operators import matching as M
from inkstat.plans.registry import query
from inkstat.plans.structure import q
from inkstat.session import cut

NT = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query("g1_title_normalize", f"SELECT p_partkey, {NT.format(x="p_brand || '  ' || p_name || '!' || p_type")} AS norm FROM part")
def g1(t):
    return t.part.select("p_partkey", T.normalize_title(F.concat("p_brand", F.lit("  "), "p_name", F.lit("!"), "p_type")).alias("norm"))


def listed(t):
    return t.lineitem.select(F.col("l_suppkey").alias("query_id"), F.when(F.col("l_linenumber") != 3, F.concat(F.lit("p"), F.col("l_partkey"), F.lit("v"), F.col("l_linenumber"))).alias("cand_id"))


def bib(t):
    return t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("query_id"), F.concat(F.lit("k"), F.col("l_orderkey") % 50).alias("key"), F.concat(F.lit("p"), F.col("l_partkey")).alias("cand_id"))


POOL = """src AS (SELECT l_suppkey AS query_id, 'p' || l_partkey AS cand_id, 'listed' AS source, NULL AS key FROM lineitem WHERE l_linenumber <> 3
    UNION ALL SELECT l_suppkey, 'p' || l_partkey, 'bib', 'k' || (l_orderkey % 50) FROM lineitem WHERE l_returnflag = 'R'),
  pool AS (SELECT query_id, cand_id, array_to_string(list_sort(list(DISTINCT source)), ' ') AS sources, coalesce(array_to_string(list_sort(list(DISTINCT key) FILTER (key IS NOT NULL)), ' '), '') AS bib_keys FROM src GROUP BY 1, 2)"""


@query("g2_pool_union", f"WITH {POOL} SELECT * FROM pool")
def g2(t):
    return M.pool_union(listed(t), bib(t)).select("query_id", "cand_id", F.array_join("sources", " ").alias("sources"), F.array_join("bib_keys", " ").alias("bib_keys"))


@query("g2_title_queue", f"""WITH r AS (SELECT l_suppkey AS query_id, p_name || ' of ' || p_brand || ' ' || p_type AS title FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 3)
  SELECT {NT.format(x='title')} AS norm, min(title) AS title, count(DISTINCT query_id) AS n_queries FROM r WHERE len(regexp_split_to_array(trim(title), '\\s+')) >= 4 AND NOT regexp_matches(title, 'PROMO') GROUP BY 1""")
def g2b(t):
    rows = t.lineitem.where("l_linenumber = 3").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("query_id"), F.concat("p_name", F.lit(" of "), "p_brand", F.lit(" "), "p_type").alias("title"), F.lit(None).cast("string").alias("cand_id"))
    return M.title_queue(rows, "PROMO")


@query("g3_resolved_titles", f"""WITH {POOL}, w AS (SELECT DISTINCT l_suppkey AS query_id, 'p' || p_partkey AS cand_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 3 AND p_partkey % 2 = 0),
  a AS (SELECT query_id, cand_id FROM pool UNION ALL SELECT * FROM w)
  SELECT query_id, count(DISTINCT cand_id) AS n_candidates FROM a GROUP BY 1""")
def g3(t):
    name = F.concat(F.lit("Part number "), F.col("p_partkey"), F.lit(" of "), F.col("p_brand"))
    waiting = t.lineitem.where("l_linenumber = 3").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("query_id"), name.alias("title")).distinct()
    resolved = t.part.where("p_partkey % 2 = 0").select(T.normalize_title(name).alias("norm"), F.concat(F.lit("p"), "p_partkey").alias("cand_id"))
    merged = M.merge_titles(M.pool_union(listed(t), bib(t)), waiting, resolved)
    return merged.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"))


FIRST_LINE = "string_split(text, chr(10))[1]"


@query("g4_fuzzy_title_join", f"""WITH l AS (SELECT doc_id, {NT.format(x=FIRST_LINE)} AS norm FROM documents), p AS (SELECT norm, list_distinct(string_split(norm, ' ')) AS w, count(*) AS copies FROM l WHERE doc_id % 2 = 0 AND norm <> '' GROUP BY 1),
  k AS (SELECT norm AS known, list_distinct(string_split(norm, ' ')) AS kw, count(*) AS known_copies FROM l WHERE doc_id % 2 = 1 AND norm <> '' GROUP BY 1),
  x AS (SELECT *, len(list_intersect(w, kw)) AS c FROM p, k)
  SELECT norm, known, c / (len(w) + len(kw) - c)::DOUBLE AS jaccard, c / len(w)::DOUBLE AS containment, copies, known_copies FROM x WHERE c / (len(w) + len(kw) - c)::DOUBLE >= 0.85 OR (len(w) >= 4 AND c / len(w)::DOUBLE >= 0.92)""", "jaccard containment")
def g4(t):
    title = t.documents.select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"))
    return M.fuzzy_title_join(title.where("doc_id % 2 = 0"), title.where("doc_id % 2 = 1"))


@query("g4_best_title_match", f"""WITH l AS (SELECT doc_id, {NT.format(x=FIRST_LINE)} AS norm FROM documents), p AS (SELECT norm, list_distinct(string_split(norm, ' ')) AS w FROM l WHERE doc_id % 2 = 0 AND norm <> '' GROUP BY 1),
  k AS (SELECT norm AS known, list_distinct(string_split(norm, ' ')) AS kw FROM l WHERE doc_id % 2 = 1 AND norm <> '' GROUP BY 1), x AS (SELECT *, len(list_intersect(w, kw)) AS c FROM p, k),
  y AS (SELECT norm, known, c / (len(w) + len(kw) - c)::DOUBLE + CASE WHEN length(known) % 2 = 0 THEN 0.05 ELSE 0 END AS score, c / (len(w) + len(kw) - c)::DOUBLE AS j, len(w) AS lw, c / len(w)::DOUBLE AS con FROM x)
  SELECT norm, known, score FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, known DESC) AS r FROM y WHERE (j >= 0.85 OR (lw >= 4 AND con >= 0.92)) AND score >= 0.9) WHERE r = 1""", "score")
def g4b(t):
    title = t.documents.select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"))
    pairs = M.fuzzy_title_join(title.where("doc_id % 2 = 0"), title.where("doc_id % 2 = 1"))
    return M.best_title_match(pairs.withColumn("author_match", F.length("known") % 2 == 0))


@query("g5_human_filter", """SELECT o_orderkey AS cand_id, CASE WHEN f <= 0.05 THEN 'pass' WHEN y <= 2024 THEN 'pass' ELSE 'fail' END AS verdict,
  CASE WHEN f <= 0.05 THEN 'fraction' WHEN y <= 2024 THEN 'year<=2024' WHEN f IS NOT NULL THEN 'fraction>limit' ELSE '2025+ unverified' END AS "by"
  FROM (SELECT o_orderkey, year(o_orderdate) + 26 AS y, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 40) / 400.0::DOUBLE END, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 30) / 300.0::DOUBLE END) AS f FROM orders)""")
def g5(t):
    k = F.col("o_orderkey")
    verdict = M.human_filter(F.when(k % 3 == 0, (k % 40) / 400.0), F.when(k % 5 == 0, (k % 30) / 300.0), F.year("o_orderdate") + 26)
    return t.orders.select(k.alias("cand_id"), verdict.alias("v")).select("cand_id", "v.verdict", "v.by")


COMMENTS = ["Accepted at the ICLR main track", "NeurIPS 2023 camera ready", "ICML 2024 workshop on things", "12 pages, 3 figures", "To appear in Findings of ACL", "Published in TMLR, 2024"]


@query("g6_venue_filter", f"""WITH c AS (SELECT p_partkey, (['{"', '".join(COMMENTS)}', ''])[p_partkey % 7 + 1] AS com FROM part),
  h AS (SELECT *, coalesce(nullif(regexp_extract(com, {q(P.VENUE_DATED)}), ''), nullif(regexp_extract(com, {q(P.VENUE_ACCEPTED)}), '')) AS hit FROM c)
  SELECT p_partkey AS cand_id, CASE WHEN p_partkey % 11 = 0 THEN 'pass' WHEN p_partkey % 13 = 0 THEN 'pass' WHEN com <> '' AND NOT regexp_matches(com, {q(P.VENUE_BAD)}) AND hit IS NOT NULL THEN 'pass' ELSE 'fail' END AS verdict,
    CASE WHEN p_partkey % 11 = 0 THEN 'accepted oral' WHEN p_partkey % 13 = 0 THEN 'KDD 2020' WHEN com <> '' AND NOT regexp_matches(com, {q(P.VENUE_BAD)}) AND hit IS NOT NULL THEN substr(hit, 1, 40) ELSE coalesce(nullif(substr(com, 1, 40), ''), 'preprint') END AS venue,
    CASE WHEN p_partkey % 11 = 0 THEN 'record' WHEN p_partkey % 13 = 0 THEN 'list' WHEN com <> '' AND NOT regexp_matches(com, {q(P.VENUE_BAD)}) AND hit IS NOT NULL THEN 'comment' ELSE 'none' END AS "by" FROM h""")
def g6(t):
    k = F.col("p_partkey")
    comment = F.get(F.array(*[F.lit(c) for c in [*COMMENTS, ""]]), (k % 7).cast("int"))
    v = M.venue_filter(k % 11 == 0, F.lit("oral"), F.when(k % 13 == 0, "KDD 2020"), comment)
    return t.part.select(k.alias("cand_id"), v.alias("v")).select("cand_id", "v.*")


TITLES = ["A survey of rings", "RingBench: a benchmark", "A corpus of rings", "Why do rings fail?", "Rings for robots", "Understanding rings", "Ring nets"]
ABSTRACTS = ["we propose a ring", "we present a framework for evaluating rings", "a large benchmark that we release", "rings"]


def type_expr(k):
    title = F.get(F.array(*[F.lit(x) for x in TITLES]), (k % 7).cast("int"))
    abstract = F.get(F.array(*[F.lit(x) for x in ABSTRACTS]), (k % 4).cast("int"))
    return M.contribution_type(title, abstract)


def type_sql(k: str) -> str:
    title = f"(['{"', '".join(x.lower() for x in TITLES)}'])[{k} % 7 + 1]"
    abstract = f"(['{"', '".join(ABSTRACTS)}'])[{k} % 4 + 1]"
    rx = lambda s, p: f"regexp_matches({s}, {q(p)})"
    return f"""CASE WHEN {rx(title, P.TYPE_SURVEY)} THEN 'survey' WHEN {rx(title, P.TYPE_BENCHMARK)} THEN 'benchmark' WHEN {rx(title, P.TYPE_DATASET)} AND NOT {rx(title, P.TYPE_NOT_DATASET)} THEN 'dataset'
      WHEN {rx(title, P.TYPE_QUESTION)} OR {rx(title, P.TYPE_ANALYSIS)} THEN 'analysis' WHEN {rx(f"{title} || ' ' || {abstract}", P.TYPE_FRAMEWORK)} THEN 'framework' WHEN {rx(abstract, P.TYPE_METHOD)} THEN 'method'
      WHEN contains({abstract}, 'benchmark') AND {rx(abstract, P.TYPE_RELEASE)} THEN 'benchmark' ELSE 'method' END"""


@query("g7_type_classifier", f"""WITH a AS (SELECT p_partkey AS cand_id, {type_sql('p_partkey')} AS type, {type_sql('(p_partkey // 7)')} AS other FROM part), i AS (SELECT * FROM (VALUES {', '.join(f"('{x}', '{y}')" for x, y in P.TYPE_INCOMPATIBLE)}) AS v(x, y))
  SELECT cand_id, type, other, EXISTS (SELECT 1 FROM i WHERE (x = type AND y = other) OR (x = other AND y = type)) AS incompatible FROM a""")
def g7(t):
    d = t.part.select(F.col("p_partkey").alias("cand_id"), type_expr(F.col("p_partkey")).alias("type"), type_expr(F.expr("p_partkey div 7")).alias("other"))
    return d.withColumn("incompatible", M.incompatible(F.col("type"), F.col("other")))


@query("g8_source_filter", """SELECT o_orderkey AS cand_id, CASE WHEN o_orderkey % 10 > 0 THEN CASE WHEN o_orderkey % 6000 >= 2500 AND o_orderkey % 9 >= 4 THEN 'pass' ELSE 'fail' END WHEN o_orderkey % 20 = 0 THEN 'fail' ELSE 'unknown' END AS verdict FROM orders""")
def g8(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("cand_id"), M.source_filter(F.when(k % 10 > 0, k % 6000), F.when(k % 10 > 0, k % 9), k % 20 == 0).alias("verdict"))


# --- candidate rows: a supplier is a query, the parts it ships are its candidates -------------


def candidates(t):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("cand_id")).agg(
        F.max("l_linenumber").alias("ln"), F.max("l_returnflag").alias("rf"), F.max("l_discount").alias("d"), F.max("l_quantity").alias("qt"), F.max("l_extendedprice").alias("ep"),
        F.max(F.year("l_shipdate")).alias("year"), F.max("l_linestatus").alias("ls"), F.max("l_tax").alias("tx"))
    pf = lambda c: F.when(c, "pass").otherwise("fail")
    types = F.array(*[F.lit(x) for x in ("method", "analysis", "benchmark")])
    return rows.select(
        "query_id", "cand_id", F.when(F.col("ln") < 7, F.col("ln") % 4).cast("int").alias("tier"), F.when(F.col("rf") == "R", "parent").otherwise("cited").alias("relation"),
        F.when(F.col("d") > 0.04, F.col("qt") / 5).alias("rating"), (F.col("ep") / 20000).alias("body_ratio"), (F.col("ls") == "O").alias("has_code"), (F.col("tx") > 0.04).alias("has_figure"), F.col("year").cast("int").alias("year"),
        pf(F.col("qt") > 10).alias("h1"), F.lit("year").alias("h1_by"), pf(F.col("tx") < 0.07).alias("h2"), F.lit("arxiv").alias("venue"), F.when(F.col("ep") > 30000, "pass").when(F.col("ep") > 15000, "unknown").otherwise("fail").alias("h4"),
        F.get(types, (F.col("cand_id") % 3).cast("int")).alias("heur_type"), F.when(F.col("ln") % 2 == 0, F.get(types, (F.col("query_id") % 3).cast("int"))).alias("judged_type"), F.get(types, (F.col("query_id") % 3).cast("int")).alias("query_type"),
        F.when(F.col("ep") > 5000, (F.col("ep") / 10).cast("bigint")).alias("body_words"))


CAND = """lc AS (SELECT l_suppkey AS query_id, l_partkey AS cand_id, max(l_linenumber) AS ln, max(l_returnflag) AS rf, max(l_discount) AS d, max(l_quantity) AS qt, max(l_extendedprice) AS ep, max(year(l_shipdate)) AS year, max(l_linestatus) AS ls, max(l_tax) AS tx FROM lineitem GROUP BY 1, 2),
  c0 AS (SELECT query_id, cand_id, CASE WHEN ln < 7 THEN ln % 4 END AS tier, CASE WHEN rf = 'R' THEN 'parent' ELSE 'cited' END AS relation, CASE WHEN d > 0.04 THEN qt / 5 END AS rating, ep / 20000 AS body_ratio, ls = 'O' AS has_code, tx > 0.04 AS has_figure, year,
     CASE WHEN qt > 10 THEN 'pass' ELSE 'fail' END AS h1, CASE WHEN tx < 0.07 THEN 'pass' ELSE 'fail' END AS h2, CASE WHEN ep > 30000 THEN 'pass' WHEN ep > 15000 THEN 'unknown' ELSE 'fail' END AS h4,
     CASE WHEN ln % 2 = 0 THEN query_id % 3 = query_id % 3 ELSE cand_id % 3 = query_id % 3 END AS same, ln % 2 = 0 AS judged, (['method', 'analysis', 'benchmark'])[CASE WHEN ln % 2 = 0 THEN query_id % 3 ELSE cand_id % 3 END + 1] AS type, (['method', 'analysis', 'benchmark'])[query_id % 3 + 1] AS query_type,
     CASE WHEN ep > 5000 THEN CAST(floor(ep / 10) AS BIGINT) END AS body_words FROM lc),
  cf AS (SELECT *, h1 = 'pass' AND h2 = 'pass' AND same AND h4 = 'pass' AS hard_pass, h1 = 'pass' AND h2 = 'pass' AND same AND h4 = 'unknown' AS h4_pending FROM c0),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(tier, 0) DESC, relation = 'parent' DESC, rating IS NOT NULL DESC, body_ratio <= 2.5 DESC, has_code::INT + has_figure::INT DESC, year DESC, cand_id) AS position
     FROM cf WHERE (hard_pass OR h4_pending) AND coalesce(tier, 0) >= 1)"""
C = f"WITH {CAND} "


def flagged(t):
    return M.judged_override(candidates(t))


@query("g9_shortlist", C + """, s AS (SELECT * FROM cf WHERE h1 = 'pass' AND h2 = 'pass' AND h4 <> 'fail'), n AS (SELECT query_id, count(*) AS n_survivors FROM s GROUP BY 1)
  SELECT query_id, cand_id, CAST(position AS INT) AS position, n_survivors FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relation = 'parent' DESC, same DESC, h4 = 'pass' DESC, rating IS NOT NULL DESC, year DESC, cand_id) AS position FROM s) JOIN n USING (query_id) WHERE position <= 7""")
def g9(t):
    survivors = flagged(t).where("h1 = 'pass' AND h2 = 'pass' AND h4 <> 'fail'")
    order = [F.desc(F.col("relation") == "parent"), F.desc(F.col("h3") == "pass"), F.desc(F.col("h4") == "pass"), F.desc(F.col("rating").isNotNull()), F.desc("year"), F.asc("cand_id")]
    return M.shortlist(survivors, order).select("query_id", "cand_id", "position", "n_survivors")


@query("g10_batch_packing", """SELECT c_custkey AS query_id, (row_number() OVER (ORDER BY c_custkey) - 1) // 12 AS batch FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def g10(t):
    queries = t.customer.select(F.col("c_custkey").alias("query_id"))
    done = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("query_id"))
    return M.pack_batches(queries, "query_id", done)


@query("g11_judged_override", C + """SELECT query_id, cand_id, type, CASE WHEN judged THEN 'judged' ELSE 'heuristic' END AS type_source, hard_pass, h4_pending,
  CASE WHEN h1 = 'pass' AND h2 = 'pass' AND same AND h4 <> 'fail' AND tier IS NULL THEN 'not shortlisted for tier judging' ELSE concat_ws(';', CASE WHEN h1 = 'fail' THEN 'H1:year' END, CASE WHEN h2 = 'fail' THEN 'H2:arxiv' END, CASE WHEN NOT same THEN 'H3:' || type || '!=' || query_type END, CASE WHEN h4 = 'fail' THEN 'H4:short/unstructured tex' END) END AS reject_reason FROM cf""")
def g11(t):
    return flagged(t).select("query_id", "cand_id", "type", "type_source", "hard_pass", "h4_pending", "reject_reason")


@query("g12_multi_key_rank", C + "SELECT query_id, cand_id, position FROM rk")
def g12(t):
    return M.ranked_candidates(flagged(t)).select("query_id", "cand_id", "position")


@query("g13_assignment")
def g13(t):
    assigned, _ = M.assign(M.ranked_candidates(flagged(t)))
    return assigned


@query("g13_conflicts")
def g13b(t):
    return M.assign(M.ranked_candidates(flagged(t)))[1]


@query("g14_alternates")
def g14(t):
    ranked = M.ranked_candidates(flagged(t))
    return M.alternates(ranked, M.assign(ranked)[0]).select("query_id", "cand_id", "alternate")


@query("g14_no_candidate_reasons", C + """, q AS (SELECT c_custkey AS query_id FROM customer WHERE c_custkey % 3 > 0), a AS (SELECT query_id, count(*) AS n, max((h1 = 'pass')::INT) AS a1, max((h1 = 'pass' AND h2 = 'pass')::INT) AS a2, max(hard_pass::INT) AS a3, max(((hard_pass OR h4_pending) AND coalesce(tier, 0) >= 1)::INT) AS a4 FROM cf GROUP BY 1)
  SELECT query_id, CASE WHEN n IS NULL THEN 'empty candidate pool' WHEN a1 = 0 THEN 'no human-verified citation' WHEN a2 = 0 THEN 'no accepted citation among verified' WHEN a3 = 0 THEN 'hard filters leave none' WHEN a4 = 0 THEN 'tier-0 survivors only' ELSE 'all ranked candidates taken' END AS reason FROM q LEFT JOIN a USING (query_id)""")
def g14b(t):
    queries = t.customer.select(F.col("c_custkey").alias("query_id"))
    assigned = queries.where("query_id % 3 = 0")
    return M.no_candidate_reasons(queries, flagged(t), assigned)


STOPS = ", ".join(f"'{w}'" for w in P.STOP_WORDS)
TFIDF = f"""tk AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOPS})) AS w FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)),
  tm AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tk), tf AS (SELECT doc_id, term, count(*) AS tf FROM tm GROUP BY 1, 2),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM tk)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY 1 HAVING count(*) >= 2), wt AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
  nv AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM wt)"""


def tfidf_sides(t):
    docs = t.documents.select("doc_id", "text")
    items = t.benchmark.select((-1 - F.col("item_id")).alias("doc_id"), "text")
    both = docs.unionByName(items)
    # a search reads the terms of its queries only; they are written once, read for both sides
    vec = cut(M.search_weights(both, M.term_counts(items)))
    return vec.where("doc_id < 0"), vec.where("doc_id >= 0")


@query("g15_tfidf_neighbours", f"""WITH {TFIDF}, s AS (SELECT q.doc_id AS query_id, d.doc_id AS cand_id, round(sum(q.w * d.w), 9) AS sim FROM nv q JOIN nv d ON q.term = d.term AND q.doc_id < 0 AND d.doc_id >= 0 GROUP BY 1, 2)
  SELECT query_id, cand_id, sim, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cand_id) AS position FROM s WHERE sim > 0) WHERE position <= 3""", "sim")
def g15(t):
    queries, docs = tfidf_sides(t)
    return M.top_neighbours(queries, docs)


@query("g16_spread_shortlist")
def g16(t):
    return M.spread_shortlist(M.ranked_candidates(flagged(t))).select("query_id", "cand_id", "position", "pick")


@query("g17_widened_merge", C + """, d AS (SELECT query_id, min(cand_id) AS cand_id FROM rk WHERE query_id % 2 = 0 AND position = 1 GROUP BY 1), w AS (SELECT query_id, min(cand_id) AS cand_id FROM cf WHERE body_words >= 2500 GROUP BY 1)
  SELECT query_id, cand_id, 'cited' AS pool FROM d UNION ALL SELECT query_id, cand_id, 'widened' FROM w ANTI JOIN d USING (query_id)""")
def g17(t):
    c = flagged(t)
    draft = M.ranked_candidates(c).where("position = 1 AND query_id % 2 = 0").select("query_id", "cand_id")
    widened = c.where("body_words >= 2500").groupBy("query_id").agg(F.min("cand_id").alias("cand_id")).withColumns({"body_words": F.lit(3000), "n_sections": F.lit(5)})
    return M.merge_widened(draft, widened)


def relaxed(t):
    c = flagged(t)
    return M.relaxed_rank(c.withColumns({"same_type": F.col("h3") == "pass", "sim": F.col("body_ratio")}))


@query("g18_relaxed_rank", C + """, l AS (SELECT *, CASE WHEN tier >= 2 AND same THEN 4 WHEN tier >= 2 THEN 3 WHEN tier = 1 AND same THEN 2 WHEN tier = 1 THEN 1 ELSE 0 END AS level FROM cf)
  SELECT query_id, cand_id, CAST(level AS INT) AS level, concat_ws(';', CASE WHEN level = 0 THEN 'similarity_tier_0_or_unjudged' WHEN level IN (1, 2) THEN 'similarity_tier_1' END, CASE WHEN level = 0 THEN 'contribution_type_unchecked' WHEN level IN (1, 3) THEN 'contribution_type_mismatch' END) AS caveats,
    row_number() OVER (PARTITION BY query_id ORDER BY level DESC, coalesce(tier, -1) DESC, coalesce(rating, 0) DESC, body_ratio DESC, cand_id) AS position FROM l""")
def g18(t):
    return relaxed(t).select("query_id", "cand_id", "level", "caveats", "position")


@query("g18_relaxed_fill")
def g18b(t):
    return M.serial_assign(relaxed(t))


@query("g19_pair_caveats", C + """SELECT query_id, cand_id, concat_ws(' ', CASE WHEN body_ratio > 2.5 THEN 'body_ratio_over_2.5' END, CASE WHEN tier = 1 THEN 'similarity_tier_1' END, CASE WHEN has_code THEN 'eprint_may_be_extended' END, CASE WHEN cand_id % 9 = 0 THEN 'anchor_shared' END) AS caveats,
  NOT (body_ratio > 2.5 OR coalesce(tier = 1, false) OR has_code OR cand_id % 9 = 0) AS ready FROM cf""")
def g19(t):
    pairs = flagged(t).withColumns({"extended": F.col("has_code"), "shared_anchor": F.col("cand_id") % 9 == 0})
    return M.caveat_flags(pairs).select("query_id", "cand_id", F.array_join("caveats", " ").alias("caveats"), "ready")


WORDS12 = "len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) >= 12"


@query("g20_source_coverage", f"""WITH v AS (SELECT doc_id AS pair_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 3 <> 2), chr(10)) AS other FROM documents),
  se AS (SELECT pair_id, unnest(l) AS s, unnest(range(len(l))) AS k FROM (SELECT pair_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {WORDS12}) AS l FROM v)),
  sw AS (SELECT pair_id, k, string_split({NT.format(x='s')}, ' ') AS w FROM se), ow AS (SELECT pair_id, string_split({NT.format(x='other')}, ' ') AS w FROM v),
  sg AS (SELECT DISTINCT pair_id, k, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS g FROM sw), og AS (SELECT DISTINCT pair_id, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS g FROM ow),
  h AS (SELECT pair_id, count(DISTINCT k) AS n_hit FROM sg SEMI JOIN og USING (pair_id, g) GROUP BY 1)
  SELECT pair_id, n_sentences, coalesce(n_hit, 0) AS n_hit, coalesce(n_hit, 0) / n_sentences::DOUBLE AS coverage, coalesce(n_hit, 0) / n_sentences::DOUBLE >= 0.85 AS accepted FROM (SELECT pair_id, count(*) AS n_sentences FROM se GROUP BY 1) LEFT JOIN h USING (pair_id)""", "coverage")
def g20(t):
    kept = F.filter(F.split("text", "\n"), lambda x, i: (i + 1) % 3 != 2)
    return M.source_coverage(t.documents.select(F.col("doc_id").alias("pair_id"), "text", F.array_join(kept, "\n").alias("other")))


@query("g21_best_version", """SELECT query_id, version, coverage, body_words FROM (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS version, round(l_discount, 3) AS coverage, CAST(l_quantity AS BIGINT) AS body_words,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY round(l_discount, 3) DESC, CAST(l_quantity AS BIGINT) DESC, l_orderkey * 10 + l_linenumber DESC) AS k FROM lineitem WHERE 1 - l_tax >= 0.95) WHERE k = 1""", "coverage")
def g21(t):
    v = t.lineitem.select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"), (1 - F.col("l_tax")).alias("title_sim"), F.col("l_discount").alias("coverage"), F.col("l_quantity").cast("bigint").alias("body_words"))
    return M.best_version(v, "query_id", 0.95)


@query("g22_near_misses", C + """SELECT query_id, cand_id, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC NULLS LAST, rating DESC NULLS LAST, cand_id) AS position FROM cf WHERE NOT hard_pass AND body_words IS NOT NULL) WHERE position <= 3""")
def g22(t):
    return M.near_misses(flagged(t)).select("query_id", "cand_id", "position")
