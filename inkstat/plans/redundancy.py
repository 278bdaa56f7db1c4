"""Registered queries of the recycling measure (C1-C6) and of sentences and tokens (B10, B11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstat.functions import patterns as P
from inkstat.functions import text as T
from inkstat.operators import redundancy as R
from inkstat.plans.inputs import UNITS, auroc_sql, grams_sql
from inkstat.plans.registry import query


def units(t):
    return R.units_from_blocks(t.documents)


BASE = f"WITH {UNITS}, {grams_sql(8)} "

DOC = """SELECT d.doc_id, n_sentences, n_eligible, coalesce(n_recycled, 0) AS n_recycled, n_words,
    CASE WHEN n_eligible > 0 THEN coalesce(n_recycled, 0) / n_eligible::DOUBLE END AS score, n_eligible < 3 AS weak,
    CASE WHEN n_sentences > 0 THEN n_eligible / n_sentences::DOUBLE END AS coverage,
    CASE WHEN n_eligible > 0 THEN least(1, coalesce(n_recycled, 0) / n_eligible::DOUBLE / 0.1) END AS score_agg,
    CASE WHEN n_eligible_body > 0 THEN coalesce(n_recycled_body, 0) / n_eligible_body::DOUBLE END AS score_body,
    CASE WHEN n_eligible > n_eligible_body THEN coalesce(n_recycled - n_recycled_body, 0) / (n_eligible - n_eligible_body)::DOUBLE END AS score_summary,
    coalesce(covered, 0) / greatest(n_words, 1)::DOUBLE AS repeat_word_rate, CASE WHEN n_eligible > 0 THEN coalesce(sum_r, 0) / n_eligible END AS mean_r,
    coalesce(longest_repeat, 0) AS longest_repeat
  FROM (SELECT documents.doc_id, CAST(count(u.ord) AS INT) AS n_sentences, CAST(count(*) FILTER (len(toks) >= 8) AS INT) AS n_eligible,
          count(*) FILTER (len(toks) >= 8 AND role = 'body') AS n_eligible_body, CAST(coalesce(sum(len(toks)), 0) AS INT) AS n_words
        FROM documents LEFT JOIN u ON u.doc_id = documents.doc_id GROUP BY 1) d
  LEFT JOIN (SELECT doc_id, count(*) FILTER (recycled) AS n_recycled, count(*) FILTER (recycled AND role = 'body') AS n_recycled_body,
          CAST(sum(covered) AS BIGINT) AS covered, max(longest_run) AS longest_repeat, sum(CASE WHEN eligible THEN r END) AS sum_r FROM rw GROUP BY 1) c ON c.doc_id = d.doc_id"""
DOC_FLOATS = "score coverage score_agg score_body score_summary repeat_word_rate mean_r"


@query("b10_sentences", f"WITH {UNITS} SELECT doc_id, CAST(sec AS INT) AS sec, CAST(k AS INT) AS ord, s AS sentence FROM sn")
def b10(t):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    sents = t.documents.select("doc_id", F.posexplode(lines).alias("sec", "line"))
    return sents.select("doc_id", "sec", F.posexplode(T.sentences(F.col("line"))).alias("ord", "sentence"))


@query("b11_content_tokens", f"""WITH {UNITS}, w AS (SELECT doc_id, unnest(toks) AS w FROM u)
  SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (w NOT IN ({', '.join(f"'{w}'" for w in [*P.STOP_WORDS, *P.SENTINELS])}) AND NOT regexp_matches(w, '^[0-9]')) AS n_content
  FROM w GROUP BY doc_id""")
def b11(t):
    toks = t.documents.select("doc_id", T.tokens(F.lower(F.col("text"))).alias("toks"))
    return toks.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.size(T.content_tokens(F.col("toks"))).cast("bigint").alias("n_content")).where("n_tokens > 0")


@query("c1_redundancy_units", f"WITH {UNITS} SELECT doc_id, CAST(ord AS INT) AS ord, CAST(sec AS INT) AS sec, role, CAST(len(toks) AS INT) AS n_tokens FROM u")
def c1(t):
    return units(t).select("doc_id", F.posexplode("units").alias("ord", "u")).select("doc_id", "ord", "u.sec", "u.role", F.size("u.toks").alias("n_tokens"))


@query("c2_gram_first_occurrence", BASE + """SELECT doc_id, gram, CAST(o_ord AS INT) AS owner_ord, CAST(o_sec AS INT) AS owner_sec, n FROM f WHERE n > 1""")
def c2(t):
    return R.gram_owners(units(t))


@query("c3_recycled_sentences", BASE + """SELECT doc_id, CAST(ord AS INT) AS ord, CAST(sec AS INT) AS sec, role, CAST(n_tokens AS INT) AS n_tokens, covered, longest_run,
  CAST(src_ord AS INT) AS src_ord, src_role, r, eligible, recycled FROM rw""", "r")
def c3(t):
    return R.sentence_rows(units(t))


@query("c4_redundancy_score", BASE + DOC, DOC_FLOATS)
def c4(t):
    return R.document_scores(units(t))


@query("c4_recycled_by_pair", BASE + "SELECT src_role || '>' || role AS pair, count(*) AS n FROM rw WHERE recycled GROUP BY 1")
def c4b(t):
    return R.recycled_by_pair(units(t))


@query("c4_separation_auroc", BASE + f""", s AS (SELECT 'redundancy' AS system, quality AS label, score FROM ({DOC}) JOIN labels USING (doc_id))
  SELECT system, n_pos, n_neg, auroc, 2 * auroc - 1 AS cliff FROM ({auroc_sql('s', 'system', 'score')})""", "auroc cliff")
def c4c(t):
    return R.separation(units(t), t.labels.select("doc_id", F.col("quality").alias("label")))


@query("c5_cliche_grams", BASE + "SELECT count(*) AS n_grams, CAST(sum(d) AS BIGINT) AS occurrences FROM (SELECT gram, count(DISTINCT doc_id) AS d FROM g GROUP BY 1 HAVING d >= 3)")
def c5(t):
    return R.frequent_grams(units(t), 3).agg(F.count(F.lit(1)).alias("n_grams"), F.sum("n_docs").alias("occurrences"))


def filtered_grams_sql() -> str:
    """grams_sql over grams that are not frequent."""
    first, rest = grams_sql(8).split(",\n  f AS", 1)
    return first.replace("g AS (", "g0 AS (", 1) + """,
  cl AS (SELECT gram FROM g0 GROUP BY gram HAVING count(DISTINCT doc_id) >= 3),
  g AS (SELECT g0.* FROM g0 ANTI JOIN cl USING (gram)),\n  f AS""" + rest


@query("c5_cliche_filtered_score", f"WITH {UNITS}, {filtered_grams_sql()} {DOC}", DOC_FLOATS)
def c5b(t):
    u = units(t)
    return R.document_scores(u, cliches=R.frequent_grams(u, 3))


SWEEP = f"WITH {UNITS}, {grams_sql(6, '6')}, {grams_sql(8, '8')}, {grams_sql(10, '10')}, e AS (SELECT count(*) AS n_eligible FROM u WHERE len(toks) >= 8) " + " UNION ALL ".join(
    f"""SELECT CAST({n} AS INT) AS n, tau, count(*) FILTER (r >= tau) AS n_recycled, max(n_eligible) AS n_eligible, count(*) FILTER (r >= tau) / max(n_eligible)::DOUBLE AS score
    FROM rw{n}, e, (SELECT unnest([0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE]) AS tau) WHERE eligible GROUP BY tau""" for n in (6, 8, 10))


@query("c6_parameter_sweep", SWEEP, "score")
def c6(t):
    return R.sweep(units(t), [6, 8, 10], [0.4, 0.5, 0.6])
