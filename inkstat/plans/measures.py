"""Registered queries of citation (C14-C19), evidence (C20-C23), figure (C24-C26), argument (C27-C32),
score aggregation (C33-C38), token reductions (D) and quote location (B18, B21, B22, B24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstat.functions import patterns as P
from inkstat.functions import text as T
from inkstat.operators import argument as A
from inkstat.operators import citation as C
from inkstat.operators import core
from inkstat.operators import evidence as E
from inkstat.operators import figure as G
from inkstat.operators import references as RF
from inkstat.operators import structure as S
from inkstat.operators import tables as TB
from inkstat.plans.inputs import BENCH_LONG, TEX, bench_scores, tex_docs
from inkstat.plans.registry import query
from inkstat.plans.structure import CELLS, TOK, names, q

# --- citation sentences: every prose line of the wrapped paper is a paragraph -----------------

ABBR_RAW = r"et al|e\.g|i\.e|cf|vs|Fig|Eq|Sec|Tab|resp|approx|no|etc|al"


def citation_sentences(t):
    lines = F.filter(F.split("tex", "\n"), lambda x: (x != "") & ~x.startswith("\\"))
    par = tex_docs(t).select("doc_id", F.posexplode(lines).alias("para", "line"))
    return par.select("doc_id", "para", F.posexplode(C.raw_sentences(F.col("line"))).alias("ord", "text"))


CS = TEX + rf""", cp AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS para FROM (SELECT doc_id, list_filter(string_split(tex, chr(10)), lambda x: x <> '' AND NOT starts_with(x, '\')) AS l FROM tx)),
  cs AS (SELECT doc_id, para, unnest(l) AS text, unnest(range(len(l))) AS ord FROM (SELECT doc_id, para, list_filter(string_split(
     regexp_replace(regexp_replace(trim(line), '([.!?])\s+([A-Z\\(\[~0-9])', '\1' || chr(1) || '\2', 'g'), '(?i)\b((?:{ABBR_RAW})\.)' || chr(1), '\1 ', 'g'), chr(1)), lambda s: NOT regexp_matches(s, '^\s*$')) AS l FROM cp)),
  c1 AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, {q(P.CITE)}, 1), lambda g: list_filter(regexp_split_to_array(g, '[,\s]+'), lambda k: k <> '')), lambda g: len(g) > 0) AS groups, regexp_replace(text, {q(P.CITE)}, ' ', 'g') AS body FROM cs),
  c2 AS (SELECT *, list_distinct(flatten(groups)) AS works FROM c1),
  c3 AS (SELECT *, coalesce(len(list_distinct(flatten(list(works) OVER (PARTITION BY doc_id, para ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))), 0) AS seen,
      coalesce(len(lead(groups) OVER (PARTITION BY doc_id, para ORDER BY ord)) > 0, false) AS next_cited, len(groups) > 0 AS cited, len(works) AS n_works,
      regexp_matches(body, {q(P.CUE)}) AS cue, regexp_matches(body, {q(P.SELF)}) AS selfr, regexp_matches(body, {q(P.GROUP)}) AS grp FROM c2),
  tg AS (SELECT doc_id, para, ord, text, works, n_works, list_filter([CASE WHEN len(list_filter(groups, lambda g: len(list_distinct(g)) >= 2)) > 0 THEN 'BUNDLE' END, CASE WHEN len(groups) >= 2 AND n_works >= 2 THEN 'MULTI' END,
      CASE WHEN n_works >= 2 AND cue THEN 'REL' END, CASE WHEN n_works = 1 AND (regexp_matches(body, {q(P.REL1)}) OR regexp_matches(body, {q(P.REL1_INIT)}) OR (grp AND seen >= 2)) THEN 'REL1' END,
      CASE WHEN selfr AND (cue OR regexp_matches(body, {q(P.ANAPHOR)}) OR (cited AND regexp_matches(body, {q(P.USES)}))) AND (cited OR seen > 0 OR next_cited) THEN 'SELF' END,
      CASE WHEN NOT cited AND NOT selfr AND seen >= 2 AND (regexp_matches(body, {q(P.SYNTH_INIT)}) OR (grp AND regexp_matches(substr(body, 1, 70), {q(P.GROUP)}))) THEN 'SYNTH' END], lambda x: x IS NOT NULL) AS tags FROM c3),
  tw AS (SELECT *, list_has_any(tags, ['BUNDLE', 'MULTI', 'REL']) AS weaving FROM tg),
  pa AS (SELECT doc_id, para, count(*) FILTER (n_works > 0) AS n_citing, count(*) FILTER (weaving) AS n_weaving, count(*) FILTER (list_contains(tags, 'SELF')) AS n_self,
      len(list_distinct(flatten(list(works)))) AS nw FROM tw GROUP BY 1, 2)"""


@query("c14_citation_tags", f"WITH {CS} SELECT doc_id, CAST(para AS INT) AS para, CAST(ord AS INT) AS ord, CAST(n_works AS INT) AS n_works, array_to_string(tags, ' ') AS tags, weaving FROM tw")
def c14(t):
    return C.tag_sentences(citation_sentences(t)).select("doc_id", "para", "ord", "n_works", F.array_join("tags", " ").alias("tags"), "weaving")


@query("c15_citation_isolation", f"""WITH {CS} SELECT doc_id, count(*) AS n_paragraphs, CAST(sum(n_citing) AS BIGINT) AS n_citing, CAST(sum(n_weaving) AS BIGINT) AS n_weaving,
  (sum(n_citing) - sum(n_weaving)) / nullif(sum(n_citing), 0)::DOUBLE AS score, sum(n_citing) < 8 AS weak, sum(n_weaving) / nullif(sum(n_citing), 0)::DOUBLE AS co_citation_rate,
  sum(n_self) / nullif(sum(n_citing), 0)::DOUBLE AS self_positioning_rate, count(*) FILTER (nw >= 3 AND n_weaving = 0) / nullif(count(*) FILTER (nw >= 3), 0)::DOUBLE AS chain_rate FROM pa GROUP BY doc_id""",
       "score co_citation_rate self_positioning_rate chain_rate")
def c15(t):
    return C.isolation_scores(C.tag_sentences(citation_sentences(t)))


# --- claims: a citing sentence stands in for an extracted claim, every third quote is altered -

def claims(t):
    s = citation_sentences(t).where(F.col("text").rlike(r"\\cite"))
    keys = F.array_distinct(F.flatten(T.cite_keys(F.col("text"))))
    n = F.col("doc_id") + F.col("para") + F.col("ord")
    return s.select(
        "doc_id", (F.col("para") * 1000 + F.col("ord")).cast("bigint").alias("claim_id"),
        F.when(n % 5 == 4, "other").otherwise(F.get(F.array(*[F.lit(k) for k in P.CLAIM_KINDS]), (n % 4).cast("int"))).alias("kind"),
        F.when(n % 3 == 0, F.concat(F.col("text"), F.lit(" zzz unseen words here"))).when(n % 3 == 1, F.lower("text")).otherwise(F.substring("text", 1, 60)).alias("quote"),
        F.when(n % 7 == 0, "our method").when(n % 7 == 1, "existing methods").otherwise("").alias("target_phrase"),
        F.when(n % 2 == 0, keys).otherwise(F.array(F.lit("Nobody2020"))).alias("targets"),
        F.when(n % 4 == 1, "speed of inference").otherwise("").alias("criterion"), F.when(n % 6 == 5, "").otherwise("is slow on long inputs").alias("content"),
        (n % 2 == 1).alias("self_involved"), F.when(n % 11 == 0, "own_work").when(n % 11 < 4, "general").otherwise("prior_work").alias("other_side"),
        keys.alias("keys"), F.array().cast("array<string>").alias("ctx_keys"), "text", F.lit("").alias("context"))


NORM = "trim(regexp_replace(regexp_replace(lower({x}), '\\\\[a-z]+\\*?', ' ', 'g'), '[^a-z0-9%]+', ' ', 'g'))"
FOUND = "(contains(plain, f) OR ({nf} <> '' AND (contains({np}, {nf}) OR (length({nf}) > 50 AND contains({np}, substr({nf}, 1, 50))))))".format(nf=NORM.format(x="f"), np=NORM.format(x="plain"))
CL = CS + rf""", cl0 AS (SELECT doc_id, para * 1000 + ord AS claim_id, text, works AS keys, doc_id + para + ord AS n FROM c2 WHERE contains(text, '\cite')),
  cl1 AS (SELECT *, CASE WHEN n % 5 = 4 THEN NULL ELSE (['limitation', 'comparison', 'use', 'extension'])[n % 4 + 1] END AS kind0,
     CASE WHEN n % 3 = 0 THEN text || ' zzz unseen words here' WHEN n % 3 = 1 THEN lower(text) ELSE substr(text, 1, 60) END AS quote,
     CASE WHEN n % 7 = 0 THEN 'our method' WHEN n % 7 = 1 THEN 'existing methods' ELSE '' END AS target_phrase, CASE WHEN n % 2 = 0 THEN keys ELSE ['Nobody2020'] END AS targets,
     CASE WHEN n % 4 = 1 THEN 'speed of inference' ELSE '' END AS criterion, CASE WHEN n % 6 = 5 THEN '' ELSE 'is slow on long inputs' END AS content, n % 2 = 1 AS self_involved,
     CASE WHEN n % 11 = 0 THEN 'own_work' WHEN n % 11 < 4 THEN 'general' ELSE 'prior_work' END AS other_side, regexp_replace(text, {q(P.CITE)}, ' ', 'g') AS plain FROM cl0),
  cl2 AS (SELECT *, regexp_replace(quote, {q(P.CITE)}, ' ', 'g') AS bq, {NORM.format(x="plain || ' '")} AS wt FROM cl1),
  cl3 AS (SELECT *, list_filter(targets, lambda x: list_contains(list_transform(keys, lambda k: lower(k)), lower(x)) OR (length({NORM.format(x='x')}) >= 3 AND contains(wt, {NORM.format(x='x')}))) AS tv,
     coalesce(kind0, '') = 'comparison' AND NOT self_involved AND NOT regexp_matches(bq, {q(P.COMPARE_CUE)}) AS no_cue, regexp_matches(bq, {q(P.LIMIT_CUE)}) AS lim FROM cl2),
  cl4 AS (SELECT *, CASE WHEN target_phrase <> '' AND regexp_matches(target_phrase, {q(P.OWN_PHRASE)}) THEN 'own_phrase' WHEN other_side = 'own_work' THEN 'own_work'
     WHEN other_side = 'general' AND len(tv) = 0 AND NOT regexp_matches(quote, {q(P.CITE)}) AND NOT (target_phrase <> '' AND regexp_matches(target_phrase, {q(P.PRIOR_CLASS)})) THEN 'general'
     WHEN no_cue AND NOT lim THEN 'description' END AS guard, list_filter(list_transform(regexp_split_to_array(bq, '\.\.\.|…'), lambda f: trim(f)), lambda f: len(list_filter(regexp_split_to_array(f, '\s+'), lambda w: w <> '')) >= 3) AS fr FROM cl3),
  cl5 AS (SELECT *, CASE WHEN guard IS NULL AND no_cue AND lim THEN 'limitation' ELSE kind0 END AS kind, len(fr) > 0 AND len(list_filter(fr, lambda f: NOT {FOUND})) = 0 AS qv FROM cl4),
  cl6 AS (SELECT *, array_to_string(list_filter([CASE WHEN len(tv) = 0 THEN 'no_target' END, CASE WHEN kind = 'comparison' AND criterion = '' THEN 'no_criterion' END, CASE WHEN content = '' THEN 'no_content' END], lambda x: x IS NOT NULL), '+') AS missing FROM cl5),
  cl7 AS (SELECT *, CASE WHEN guard IS NOT NULL THEN guard WHEN kind IS NULL THEN 'bad_kind' WHEN NOT qv THEN 'quote_unverified' WHEN len(targets) > 0 AND len(tv) = 0 THEN 'target_unverified' ELSE missing END AS reason FROM cl6),
  cl AS (SELECT *, CASE WHEN guard IS NOT NULL THEN 'not_a_unit' WHEN reason IN ('bad_kind', 'quote_unverified', 'target_unverified') THEN 'inconclusive' WHEN missing <> '' THEN 'vague' ELSE 'concrete' END AS verdict FROM cl7),
  cd AS (SELECT doc_id, kind, array_to_string(list_sort(list_transform(tv, lambda x: lower(x))), '|') AS k_targets, substr({NORM.format(x="CASE WHEN criterion <> '' THEN criterion ELSE content END")}, 1, 60) AS k_text,
     CASE WHEN verdict = 'inconclusive' THEN CAST(claim_id AS VARCHAR) ELSE '' END AS k_own, claim_id, verdict, reason, self_involved FROM cl WHERE verdict <> 'not_a_unit'),
  ce AS (SELECT doc_id, kind, k_targets, k_text, min(claim_id) AS first_claim, arg_min(verdict, claim_id) AS verdict, arg_min(reason, claim_id) AS reason, arg_min(self_involved, claim_id) AS self_involved, count(*) AS occurrences FROM cd GROUP BY doc_id, kind, k_targets, k_text, k_own)"""


def verified(t):
    return C.verify_claims(claims(t))


def deduped(t):
    return C.dedupe_claims(verified(t).where("verdict <> 'not_a_unit'"), "claim_id")


@query("c16_claim_verdicts", f"WITH {CL} SELECT doc_id, claim_id, kind, verdict, reason, qv AS quote_verified FROM cl")
def c16(t):
    return verified(t).select("doc_id", "claim_id", "kind", "verdict", "reason", "quote_verified")


@query("c17_claim_dedupe", f"WITH {CL} SELECT * FROM ce")
def c17(t):
    return deduped(t)


@query("c18_claim_metrics", f"""WITH {CL} SELECT doc_id, count(*) AS n_claims, count(*) FILTER (verdict = 'concrete') AS n_concrete, count(*) FILTER (verdict = 'vague') AS n_vague, count(*) FILTER (verdict = 'inconclusive') AS n_inconclusive,
  count(*) FILTER (self_involved AND verdict <> 'inconclusive') AS n_self, count(*) FILTER (verdict = 'concrete') / nullif(count(*) FILTER (verdict IN ('concrete', 'vague')), 0)::DOUBLE AS concrete_rate,
  count(*) FILTER (verdict = 'vague') / nullif(count(*) FILTER (verdict IN ('concrete', 'vague')), 0)::DOUBLE AS vague_rate, count(*) FILTER (verdict = 'inconclusive') / count(*)::DOUBLE AS inconclusive_rate FROM ce GROUP BY doc_id""",
       "concrete_rate vague_rate inconclusive_rate")
def c18(t):
    return C.claim_metrics(deduped(t))


@query("c18_claim_reasons", f"WITH {CL} SELECT kind, verdict, reason, count(*) AS n FROM cl GROUP BY 1, 2, 3")
def c18b(t):
    return C.claim_reasons(verified(t))


@query("c19_median_run", """WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS run, min(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2), m AS (SELECT doc_id, median(value) AS med, count(*) AS n_runs FROM r GROUP BY 1)
  SELECT doc_id, run, value, n_runs FROM (SELECT r.*, n_runs, row_number() OVER (PARTITION BY doc_id ORDER BY abs(value - med), run) AS k FROM r JOIN m USING (doc_id)) WHERE k = 1""", "value")
def c19(t):
    runs = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("run")).agg(F.min("l_extendedprice").alias("value"))
    return C.median_run(runs, "doc_id", "run", "value")


# --- evidence ---------------------------------------------------------------------------------

RX_ENV = r"\\begin\{(?i:" + "|".join(P.EXHIBIT_ENVS) + r")\}"
EX = TOK + f""", {CELLS}, ap AS (SELECT doc_id, count(*) AS n_result_tables FROM (SELECT doc_id, tbl, count(DISTINCT r) AS rows, count(*) FILTER (regexp_matches(raw, '[0-9]')) AS nums FROM ce WHERE r > 0 GROUP BY 1, 2) WHERE rows >= 2 AND nums >= 3 GROUP BY 1),
  xs AS (SELECT doc_id, kind, p.o AS pos FROM (
    SELECT doc_id, 'env' AS kind, unnest(l) AS p FROM (SELECT doc_id, ({{}}) AS l FROM tx)
    UNION ALL SELECT doc_id, 'caption', unnest(l) FROM (SELECT doc_id, ({{}}) AS l FROM tx)))"""


def positions_sql(pattern: str) -> str:
    """Start offsets of all matches: cumulative lengths of the parts in front of them."""
    parts = f"string_split(regexp_replace(tex, {q('(' + pattern + ')')}, chr(1) || '\\1', 'g'), chr(1))"
    return f"list_transform(range(1, len({parts})), lambda i: {{'o': list_sum(list_transform(({parts})[1:i], lambda s: length(s)))}})"


EX = EX.replace("({})", "(" + positions_sql(RX_ENV) + ")", 1).replace("({})", "(" + positions_sql(P.EXHIBIT_CAPTION.replace(r"\b(an ", r"\b(?:an ")) + ")", 1)


def result_documents(t):
    return E.applicable_documents(TB.parsed_tables(TB.table_cells(tex_docs(t))))


@query("c20_evidence_applicability", f"WITH {TEX}, {CELLS} SELECT doc_id, count(*) AS n_result_tables FROM (SELECT doc_id, tbl, count(DISTINCT r) AS rows, count(*) FILTER (regexp_matches(raw, '^[0-9\\\\]')) AS nums FROM ce WHERE r > 0 GROUP BY 1, 2) WHERE rows >= 2 AND nums >= 3 GROUP BY 1")
def c20(t):
    # the wrapped tables hold three numeric cells each
    cells = TB.parsed_tables(TB.table_cells(tex_docs(t)))
    return E.applicable_documents(cells, min_numbers=3)


@query("c21_exhibit_events", f"WITH {EX} SELECT doc_id, kind, CAST(pos AS INT) AS pos FROM xs")
def c21(t):
    return E.exhibits(tex_docs(t))


def gap_rows(t):
    docs = tex_docs(t)
    tok = S.tex_tokens(docs)
    appendix = S.outline(tok).groupBy("doc_id").agg(F.min("appendix_start").alias("appendix_start"))
    applicable = E.applicable_documents(TB.parsed_tables(TB.table_cells(docs)), min_numbers=3)
    return E.gap_scores(docs, applicable, E.exhibits(docs), appendix, E.word_count(F.col("tex")))


@query("c22_evidence_gap", f"""WITH {EX}, aps AS (SELECT doc_id, min(appendix_start) AS a FROM ol GROUP BY 1),
  xa AS (SELECT doc_id, count(*) AS n, count(*) FILTER (kind = 'env') AS e, count(*) FILTER (kind = 'caption') AS c, bool_and(coalesce(pos >= a, false)) AS ao FROM xs LEFT JOIN aps USING (doc_id) GROUP BY 1)
  SELECT tx.doc_id, n_result_tables IS NOT NULL AS applicable, coalesce(n, 0) AS n_exhibits, coalesce(e, 0) AS n_env, coalesce(c, 0) AS n_caption, CAST(0 AS BIGINT) AS n_quote, coalesce(ao, false) AS appendix_only,
    CASE WHEN n_result_tables IS NOT NULL THEN CASE WHEN coalesce(n, 0) > 0 THEN 0.0 ELSE 1.0 END END AS score,
    CASE WHEN n_result_tables IS NOT NULL THEN coalesce(n, 0) / greatest(1, len(list_filter(regexp_split_to_array(tex, '\\s+'), lambda x: x <> '')))::DOUBLE * 10000 END AS exhibits_per10k
  FROM tx LEFT JOIN ap USING (doc_id) LEFT JOIN xa USING (doc_id)""", "score exhibits_per10k")
def c22(t):
    return gap_rows(t)


@query("c22_titled_without_exhibit", f"""WITH {TEX}, sg AS (SELECT doc_id, unnest(string_split(regexp_replace(tex, '(\\\\(?:sub)*section\\*?\\{{[^{{}}]*\\}})', chr(1) || '\\1', 'g'), chr(1))) AS seg FROM tx)
  SELECT doc_id, count(*) AS n FROM sg WHERE regexp_matches(seg, '(?i)^\\\\(?:sub)*section\\*?\\{{[^{{}}]*error analysis') AND NOT regexp_matches(seg, {q(RX_ENV)}) AND NOT regexp_matches(seg, {q(P.EXHIBIT_CAPTION)}) GROUP BY 1""")
def c22b(t):
    docs = tex_docs(t)
    return E.titled_without_exhibit(docs, E.exhibits(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("c23_acknowledged_gap", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\b(limited|without)\\b') THEN 0.5 ELSE 1.0 END AS score FROM documents", "score")
def c23(t):
    return E.acknowledge(t.documents.select("doc_id", "text", F.lit(1.0).alias("score")), r"(?i)\b(limited|without)\b").select("doc_id", "score")


# --- figures: the lines of a document are a transcript, with stage labels put in front --------

def figure_lines(t, outer: bool = False):
    """fig_id, ord, line; with ``outer`` a text without lines gives one row without ord and line."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    rows = t.documents.select(F.col("doc_id").alias("fig_id"), (F.posexplode_outer if outer else F.posexplode)(lines).alias("ord", "raw"))
    n = F.col("fig_id") + F.col("ord")
    lead = (
        F.when(n % 7 == 0, F.concat(F.lit("Step "), F.col("ord") + 1, F.lit(" "))).when(n % 11 == 3, "Legend ").when(n % 13 == 5, "Baseline: ")
        .when(n % 17 == 2, "Key insight ").when(n % 19 == 4, "✓ ").when((F.col("ord") == 0) & (F.col("fig_id") % 5 == 0), "We leverage this idea and combine it to improve everything: ").otherwise(""))
    return rows.select("fig_id", "ord", F.concat(lead, F.col("raw")).alias("line"))


FG = """fg AS (SELECT fig_id, ord, CASE WHEN n % 7 = 0 THEN 'Step ' || (ord + 1) || ' ' WHEN n % 11 = 3 THEN 'Legend ' WHEN n % 13 = 5 THEN 'Baseline: ' WHEN n % 17 = 2 THEN 'Key insight ' WHEN n % 19 = 4 THEN '✓ '
    WHEN ord = 0 AND fig_id % 5 = 0 THEN 'We leverage this idea and combine it to improve everything: ' ELSE '' END || raw AS line FROM (
  SELECT *, fig_id + ord AS n FROM (SELECT doc_id AS fig_id, unnest(l) AS raw, unnest(range(len(l))) AS ord FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents))))"""
KIND_SQL = {k: f"regexp_matches(line, {q(p)})" for k, p in P.FIGURE_KINDS.items()}
FK = FG + f""", fb AS (SELECT *, row_number() OVER (PARTITION BY fig_id ORDER BY ord) - 1 AS top FROM fg WHERE NOT regexp_matches(line, {q(P.FIGURE_HEADER)})),
  fk AS (SELECT fig_id, count(*) AS n_lines, bool_or({KIND_SQL['notation_key']}) AS notation_key, bool_or({KIND_SQL['comparison_arm']}) AS comparison_arm, bool_or({KIND_SQL['evaluative_mark']}) AS evaluative_mark,
    bool_or({KIND_SQL['thesis_box']} OR (top < 3 AND length(line) >= 60 AND regexp_matches(line, '[.!?]\\s*$') AND NOT contains(line, '?') AND regexp_matches(line, {q(P.FIGURE_GLOSS)}))) AS thesis_box,
    count(*) FILTER ({KIND_SQL['enumerated_stage']}) >= 2 AS enumerated_stage FROM fb GROUP BY 1)"""


@query("c24_figure_kinds", f"""WITH {FK}, v AS (SELECT *, fig_id % 9 = 1 AS experimental_content FROM fk)
  SELECT *, (notation_key::INT + comparison_arm::INT + evaluative_mark::INT + thesis_box::INT + enumerated_stage::INT + experimental_content::INT) / 6.0::DOUBLE AS score,
    (notation_key::INT + comparison_arm::INT + evaluative_mark::INT + thesis_box::INT + enumerated_stage::INT) / 5.0::DOUBLE AS score_pattern_only FROM v""", "score score_pattern_only")
def c24(t):
    verdicts = t.documents.where("doc_id % 9 = 1").select(F.col("doc_id").alias("fig_id"))
    return G.figure_kinds(figure_lines(t), verdicts)


@query("c25_latest_transcript_score", f"""WITH {FK}, s AS (SELECT fig_id, (notation_key::INT + comparison_arm::INT + evaluative_mark::INT + thesis_box::INT + enumerated_stage::INT) / 5.0::DOUBLE AS s FROM fk)
  SELECT d.doc_id AS fig_id, s AS score FROM documents d LEFT JOIN s ON s.fig_id = d.doc_id""", "score")
def c25(t):
    # a text without lines has an empty transcript, which overrides the old one as any other does
    line = F.when(F.col("ord").isNotNull(), F.struct("ord", "line"))
    current = figure_lines(t, outer=True).groupBy("fig_id").agg(F.array_sort(F.collect_list(line)).alias("lines")).withColumn("version", F.lit(2))
    old = t.documents.select(F.col("doc_id").alias("fig_id"), F.array(F.struct(F.lit(0).alias("ord"), F.lit("Legend").alias("line"))).alias("lines"), F.lit(1).alias("version"))
    latest = G.latest_transcripts(current.unionByName(old)).select("fig_id", F.inline("lines"))
    return t.documents.select(F.col("doc_id").alias("fig_id")).join(G.figure_kinds(latest).select("fig_id", F.col("score_pattern_only").alias("score")), "fig_id", "left")


@query("c26_enumeration_gaps", f"""WITH {FG}, e AS (SELECT DISTINCT fig_id, lower(regexp_extract(m, {q(P.ENUM_LABEL)}, 1)) AS word, lower(regexp_extract(m, {q(P.ENUM_LABEL)}, 2)) AS tok FROM (SELECT fig_id, unnest(regexp_extract_all(line, {q(P.ENUM_LABEL)})) AS m FROM fg)),
  o AS (SELECT DISTINCT fig_id, word, coalesce(try_cast(tok AS INT), CASE tok {' '.join(f"WHEN '{k}' THEN {v}" for k, v in P.ROMAN.items())} END) AS n FROM e)
  SELECT fig_id, word, count(*) AS labels, min(n) AS lo, max(n) AS hi, max(n) - min(n) + 1 > count(*) AS gap FROM o WHERE n > 0 GROUP BY 1, 2 HAVING count(*) >= 3""")
def c26(t):
    return G.enumeration_gaps(figure_lines(t))


# --- argument: units are conversation turns, an edge weight comes from the vectors of both ----

LABELS = ["purchase", "click", "view"]


@query("c27_majority_label", """WITH v AS (SELECT user_id AS doc_id, CAST(event_id % 50 AS BIGINT) AS ord, event_id AS run, CASE WHEN event_type IN ('purchase', 'click', 'view') THEN event_type ELSE 'none' END AS label FROM events),
  p AS (SELECT doc_id, ord, label, count(*) AS c, min(run) AS f FROM v GROUP BY 1, 2, 3)
  SELECT doc_id, ord, label, d = 1 AS unanimous, CAST(runs AS BIGINT) AS runs FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY c DESC, f) AS k, sum(c) OVER (PARTITION BY doc_id, ord) AS runs, count(*) OVER (PARTITION BY doc_id, ord) AS d FROM p) WHERE k = 1""")
def c27(t):
    votes = t.events.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 50).alias("ord"), F.col("event_id").alias("run"), F.col("event_type").alias("label"))
    return A.majority_label(votes, LABELS)


def edges(t):
    """Lines of an order as units; the weight of an edge is a fixed function of both ends."""
    # lines move once, by order; what follows is per order
    lines = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey").repartition("doc_id")
    units = lines.groupBy("doc_id", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    per = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p", "s"))).alias("u"))
    pair = F.flatten(F.transform("u", lambda a, i: F.transform("u", lambda b, j: F.struct(
        i.alias("src"), j.alias("dst"), F.when((a["p"] + b["s"]) % 13 != 0, F.pmod(a["p"] * 31 + b["s"] * 17 + i * 7, F.lit(101)) / 10.0).otherwise(F.lit(float("nan"))).alias("weight")))))
    return per.select("doc_id", F.inline(pair))


ED = """un AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber),
  ed AS (SELECT a.doc_id, a.i AS src, b.i AS dst, CASE WHEN (a.p + b.s) % 13 <> 0 THEN ((a.p * 31 + b.s * 17 + a.i * 7) % 101) / 10.0::DOUBLE END AS weight FROM un a JOIN un b USING (doc_id) WHERE a.i <> b.i),
  tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, dst ORDER BY weight DESC, src) AS rank FROM ed WHERE weight IS NOT NULL) WHERE rank <= 1),
  RECURSIVE_PLACEHOLDER"""


def key_units(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey").repartition("doc_id")
    rows = lines.groupBy("doc_id", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p"))).alias("u"))
    units = per.select("doc_id", F.size("u").alias("n_units"), F.posexplode("u").alias("ord", "x"))
    keys = units.where(F.col("x.p") % 2 == 0).select("doc_id", "ord", F.when(F.col("x.p") % 3 == 0, "claim").otherwise("contribution").alias("kind"))
    return keys, units.groupBy("doc_id").agg(F.max("n_units").alias("n_units"))


KEYS = ED.replace(",\n  RECURSIVE_PLACEHOLDER", "") + """, ku AS (SELECT doc_id, i AS ord, CASE WHEN p % 3 = 0 THEN 'claim' ELSE 'contribution' END AS kind FROM un WHERE p % 2 = 0),
  sz AS (SELECT doc_id, CAST(count(*) AS INT) AS n_units FROM un GROUP BY 1),
  dp AS (SELECT un.doc_id, i AS dst, CAST(0 AS BIGINT) AS depth FROM un LEFT JOIN tp ON tp.doc_id = un.doc_id AND tp.dst = i AND tp.src < i WHERE tp.src IS NULL
    UNION ALL SELECT tp.doc_id, tp.dst, dp.depth + 1 FROM tp JOIN dp ON dp.doc_id = tp.doc_id AND dp.dst = tp.src WHERE tp.src < tp.dst),
  dz AS (SELECT dp.* FROM dp SEMI JOIN tp ON tp.doc_id = dp.doc_id AND tp.dst = dp.dst)"""
RK = "WITH RECURSIVE " + KEYS


@query("c28_top_predictors", f"WITH {ED.replace('rank <= 1', 'rank <= 2').replace(',' + chr(10) + '  RECURSIVE_PLACEHOLDER', '')} SELECT doc_id, CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, weight, CAST(rank AS INT) AS rank FROM tp", "weight")
def c28(t):
    return A.top_predictors(edges(t), 2)


@query("c29_build_up_depth", RK + " SELECT doc_id, CAST(dst AS INT) AS dst, CAST(depth AS INT) AS depth FROM dz")
def c29(t):
    return A.build_up_depth(A.top_predictors(edges(t), 1))


@query("c30_argued_score", RK + """, k AS (SELECT ku.*, tp.src AS pred, coalesce(dz.depth, 0) AS depth FROM ku LEFT JOIN tp ON tp.doc_id = ku.doc_id AND tp.dst = ku.ord LEFT JOIN dz ON dz.doc_id = ku.doc_id AND dz.dst = ku.ord),
  a AS (SELECT doc_id, count(*) AS n_key, count(*) FILTER (pred < ord) AS n_argued, count(*) FILTER (abs(pred - ord) = 1) AS adj, median(abs(pred - ord)) AS distance_median, avg(depth) AS build_up_mean, count(*) FILTER (depth >= 2) AS deep FROM k GROUP BY 1)
  SELECT doc_id, n_units, coalesce(n_key, 0) AS n_key, coalesce(n_argued, 0) AS n_argued, (n_key - n_argued) / n_key::DOUBLE AS score, coalesce(n_key, 0) < 3 AS weak, coalesce(n_key, 0) / n_units::DOUBLE AS coverage, build_up_mean,
    deep / n_key::DOUBLE AS deep_rate, adj / n_key::DOUBLE AS adjacent_rate, distance_median FROM sz LEFT JOIN a USING (doc_id)""", "score coverage build_up_mean deep_rate adjacent_rate distance_median")
def c30(t):
    pred = A.top_predictors(edges(t), 1)
    keys, sizes = key_units(t)
    return A.argued_scores(pred, keys, A.build_up_depth(pred), sizes)


@query("c30_declared_by_kind", RK + " SELECT kind, count(*) AS n_key, avg(CASE WHEN pred < ord THEN 0 ELSE 1 END) AS declared_rate FROM (SELECT ku.*, tp.src AS pred FROM ku LEFT JOIN tp ON tp.doc_id = ku.doc_id AND tp.dst = ku.ord) GROUP BY kind", "declared_rate")
def c30b(t):
    return A.declared_by_kind(A.top_predictors(edges(t), 1), key_units(t)[0])


# each unit has at most one predictor here, so a depth is a walk along them as far as they precede in the drawn order
NULLS = KEYS + """, hk AS (SELECT DISTINCT doc_id FROM ku), he AS (SELECT DISTINCT doc_id FROM tp),
  hs AS (SELECT doc_id, rep, i, CASE WHEN rep = 0 THEN i ELSE CAST('0x' || substr(md5(doc_id || ':' || rep || ':' || i || ':0'), 1, 8) AS BIGINT) END AS h FROM un SEMI JOIN hk USING (doc_id) SEMI JOIN he USING (doc_id), (SELECT unnest(range(0, 301)) AS rep)),
  ps AS (SELECT doc_id, rep, i, row_number() OVER (PARTITION BY doc_id, rep ORDER BY h, i) AS pos FROM hs),
  fw AS (SELECT d.doc_id, d.rep, tp.src, tp.dst FROM tp JOIN ps d ON d.doc_id = tp.doc_id AND d.i = tp.dst JOIN ps s ON s.doc_id = tp.doc_id AND s.i = tp.src AND s.rep = d.rep WHERE s.pos < d.pos),
  wk AS (SELECT doc_id, rep, i AS unit, 0 AS depth FROM ps ANTI JOIN fw ON fw.doc_id = ps.doc_id AND fw.rep = ps.rep AND fw.dst = ps.i
    UNION ALL SELECT fw.doc_id, fw.rep, fw.dst, wk.depth + 1 FROM fw JOIN wk ON wk.doc_id = fw.doc_id AND wk.rep = fw.rep AND wk.unit = fw.src),
  mn AS (SELECT wk.doc_id, rep, avg(depth) AS m FROM wk JOIN ku ON ku.doc_id = wk.doc_id AND ku.ord = wk.unit GROUP BY 1, 2),
  ob AS (SELECT doc_id, m AS observed FROM mn WHERE rep = 0),
  nl AS (SELECT doc_id, max(observed) AS observed, avg(m) AS null_mean, stddev_pop(m) AS null_sd, avg((m < observed)::INT) AS null_pct FROM mn JOIN ob USING (doc_id) WHERE rep > 0 GROUP BY 1)"""


@query("c31_shuffle_null", "WITH RECURSIVE " + NULLS + " SELECT *, observed - null_mean AS abu, (observed - null_mean) / CASE WHEN null_sd > 0 THEN null_sd ELSE 1e-9 END AS abu_z FROM nl", "observed null_mean null_sd null_pct abu abu_z")
def c31(t):
    keys, sizes = key_units(t)
    return A.shuffle_null(A.top_predictors(edges(t), 1), keys, sizes)


@query("c32_eligibility", """SELECT doc_id, CASE WHEN w < 80 THEN 'no_intro' WHEN s < 4 THEN 'too_short' WHEN doc_id % 5 = 0 THEN 'labels_pending' WHEN doc_id % 7 = 0 THEN 'labels_only' WHEN doc_id % 3 = 0 THEN 'pmi_pending' ELSE 'ok' END AS status
  FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w, len(string_split(text, '. ')) AS s FROM documents)""")
def c32(t):
    words, sents = E.word_count(F.col("text")), F.size(F.split("text", r"\. "))
    d = F.col("doc_id")
    return t.documents.select("doc_id", A.eligibility(words, sents, F.when(d % 5 == 0, sents - 1).otherwise(sents), F.when(d % 3 == 0, sents - 1).otherwise(sents), d % 7 == 0).alias("status"))


# --- score aggregation -------------------------------------------------------------------------


@query("c33_ratio_score", """SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag = 'R') / nullif(count(*) FILTER (l_quantity > 10), 0)::DOUBLE AS score, count(*) FILTER (l_returnflag = 'R') AS numerator, count(*) FILTER (l_quantity > 10) AS denominator,
  count(*) FILTER (l_quantity > 10) < 3 AS weak FROM lineitem GROUP BY 1""", "score")
def c33(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("n"), F.count_if(F.col("l_quantity") > 10).alias("d"))
    return a.select("doc_id", *T.ratio_score(F.col("n"), F.col("d")))


@query("c34_plane_aggregate", f"""WITH {BENCH_LONG}, p AS (SELECT item_id, CASE WHEN system IN ('quantity', 'price') THEN 'first' ELSE 'second' END AS plane, value FROM bs WHERE value > 0.02),
  a AS (SELECT item_id, plane, avg(value) AS v, count(*) AS c FROM p GROUP BY 1, 2)
  SELECT item_id, avg(v) AS aggregate, CAST(sum(c) AS BIGINT) AS n_measures, count(*) AS n_planes FROM a GROUP BY 1""", "aggregate")
def c34(t):
    rows = bench_scores(t).where(F.col("value") > 0.02).withColumn("plane", F.when(F.col("system").isin("quantity", "price"), "first").otherwise("second"))
    return core.plane_aggregate(rows, ["item_id"])


@query("c35_named_aggregates", """WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 17) / 17.0::DOUBLE END AS m, CASE WHEN c_custkey % 9 > 0 THEN (c_custkey % 13) / 13.0::DOUBLE END AS x, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 11) / 11.0::DOUBLE END AS a,
    CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 7) / 7.0::DOUBLE END AS c, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 2)::DOUBLE END AS e FROM customer), p AS (SELECT *, list_avg([m, x]) AS st, list_avg([a, c]) AS ar FROM s)
  SELECT id, (st + c) / 2 AS agg3, CASE WHEN st IS NOT NULL AND c IS NOT NULL THEN list_avg([st, c, e]) END AS agg4, list_avg([st, c, e]) AS det4, list_avg([st, ar, e]) AS mean5 FROM p""", "agg3 agg4 det4 mean5")
def c35(t):
    k = F.col("c_custkey")
    part = lambda m, keep: F.when(k % keep > 0, (k % m) / F.lit(float(m)))
    named = core.named_aggregates(part(17, 3), part(13, 9), part(11, 5), part(7, 7), F.when(k % 4 > 0, (k % 2).cast("double")))
    return t.customer.select(k.alias("id"), *[c.alias(n) for n, c in named.items()])


@query("c36_document_label", """WITH s AS (SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'A' THEN 'consistent' WHEN l_quantity < 8 THEN 'violation' WHEN l_quantity < 30 THEN 'inconclusive' ELSE 'not_applicable' END AS status FROM lineitem),
  c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (status = 'violation') AS v, count(*) FILTER (status = 'consistent') AS c, count(*) FILTER (status = 'inconclusive') AS i, count(*) FILTER (status = 'not_applicable') AS na FROM s GROUP BY 1)
  SELECT doc_id, n, CASE WHEN na = n THEN 'NA' WHEN v > 0 THEN 'positive' WHEN c > 0 AND i = 0 THEN 'negative' WHEN c > 0 THEN 'negative_incomplete' ELSE 'inconclusive' END AS label FROM c""")
def c36(t):
    status = F.when(F.col("l_returnflag") == "A", "consistent").when(F.col("l_quantity") < 8, "violation").when(F.col("l_quantity") < 30, "inconclusive").otherwise("not_applicable")
    return core.document_label(t.lineitem.select(F.col("l_orderkey").alias("doc_id"), status.alias("status")))


@query("c37_evidence_instances", """SELECT l_orderkey AS doc_id, l_returnflag AS type, printf('%d:%s:%04d', l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber)) AS instance_id
  FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem)""")
def c37(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("type"), "l_linenumber").distinct()
    return core.evidence_instances(rows, "doc_id", "type", "l_linenumber").drop("l_linenumber")


@query("c38_count_bands", """WITH d AS (SELECT l_orderkey, count(*) AS n, avg(l_discount) AS s FROM lineitem GROUP BY 1) SELECT CASE WHEN n < 3 THEN '0_3' WHEN n < 5 THEN '3_5' ELSE '5_1000000' END AS band, count(*) AS n, avg(s) AS mean, min(s) AS min, max(s) AS max FROM d GROUP BY 1""", "mean min max")
def c38(t):
    d = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"), F.avg("l_discount").alias("s"))
    return core.count_bands(d, "c", "s", [(0, 3), (3, 5), (5, 1000000)])


# --- token-level reductions: the lines of an order are the tokens of its windows --------------


@query("d1_window_plan", """WITH d AS (SELECT doc_id, n_chars, greatest(1, least(3, n_chars // 512)) AS n FROM documents WHERE n_chars >= 64)
  SELECT doc_id, n_chars, CAST(w AS INT) AS "window", CAST(floor(w * greatest(n_chars - 512, 0) / greatest(1, n - 1)::DOUBLE) AS BIGINT) AS start FROM (SELECT *, unnest(range(n)) AS w FROM d)""")
def d1(t):
    return core.window_plan(t.documents.select("doc_id", "n_chars"), "n_chars", 3, 512)


def tokens(t):
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("window"), (-F.col("l_quantity") / 10).alias("logp"), (F.col("l_tax") + 1).alias("xent"))


@query("d2_cross_perplexity", """WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS w, avg(l_quantity / 10) / avg(l_tax + 1) AS r FROM lineitem GROUP BY 1, 2) SELECT doc_id, avg(r) AS score, count(*) AS n_windows FROM w GROUP BY 1""", "score")
def d2(t):
    return core.cross_perplexity(tokens(t))


@query("d3_perturbation_z", """WITH r AS (SELECT l_suppkey AS doc_id, l_linenumber AS w, (l_orderkey % 12) AS p, max(l_quantity) AS logp FROM lineitem GROUP BY 1, 2, 3),
  g AS (SELECT doc_id, w, max(logp) FILTER (p = 0) AS o, count(*) FILTER (p > 0) AS n, avg(logp) FILTER (p > 0) AS m, stddev_pop(logp) FILTER (p > 0) AS s FROM r GROUP BY 1, 2)
  SELECT doc_id, avg((o - m) / greatest(s, 1e-6)) AS score, count(*) AS n_windows FROM g WHERE n >= 5 AND o IS NOT NULL GROUP BY 1""", "score")
def d3(t):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("window"), (F.col("l_orderkey") % 12).alias("perturbation")).agg(F.max("l_quantity").alias("logp"))
    return core.perturbation_z(rows)


@query("d4_sampling_discrepancy", "SELECT l_orderkey AS doc_id, (sum(-l_quantity) - sum(-l_quantity - l_tax)) / sqrt(sum(l_discount + 1)) AS score FROM lineitem GROUP BY 1", "score")
def d4(t):
    return core.sampling_discrepancy(t.lineitem.select(F.col("l_orderkey").alias("doc_id"), (-F.col("l_quantity")).alias("ll"), (-F.col("l_quantity") - F.col("l_tax")).alias("mean_ref"), (F.col("l_discount") + 1).alias("var_ref")))


@query("d5_temperature_sensitivity", "SELECT l_orderkey AS doc_id, (abs(avg(-l_quantity) - avg(-l_quantity * (1 + l_tax))) - avg(l_discount)) / nullif(sqrt(avg(l_tax + 0.5)), 0) AS score FROM lineitem GROUP BY 1", "score")
def d5(t):
    x = -F.col("l_quantity")
    return core.temperature_sensitivity(t.lineitem.select(F.col("l_orderkey").alias("doc_id"), x.alias("logp_t1"), (x * (1 + F.col("l_tax"))).alias("logp_t2"), F.col("l_discount").alias("expected"), (F.col("l_tax") + 0.5).alias("variance")))


@query("d6_pmi_edges", """WITH c AS (SELECT l_suppkey AS doc_id, l_linenumber % 3 AS src, l_linenumber AS dst, avg(-l_quantity) AS c FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1, 2, 3), m AS (SELECT l_suppkey AS doc_id, l_linenumber AS dst, avg(-l_quantity - l_tax) AS m FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1, 2)
  SELECT doc_id, src, dst, round(c - m, 5) AS weight FROM c JOIN m USING (doc_id, dst) WHERE src <> dst""", "weight")
def d6(t):
    base = t.lineitem.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("src"), F.col("l_linenumber").alias("dst"), (F.col("l_orderkey") % 5).alias("pos"), "l_quantity", "l_tax")
    return core.pmi_edges(base.withColumn("logp", -F.col("l_quantity")), base.withColumn("logp", -F.col("l_quantity") - F.col("l_tax")))


@query("d7_reviewer_ensemble", "SELECT l_orderkey AS paper_id, count(*) AS n_reviews, CAST(round_even(avg(l_linenumber), 0) AS BIGINT) AS rating, CAST(round_even(avg(l_quantity), 0) AS BIGINT) AS soundness FROM lineitem GROUP BY 1")
def d7(t):
    return core.ensemble_mean(t.lineitem.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("rating"), F.col("l_quantity").alias("soundness")), "paper_id", ["rating", "soundness"])


@query("d8_fraction_table", f"WITH {BENCH_LONG} SELECT label, count(*) AS n, avg(value) AS mean, count(*) FILTER (value = 0) / count(*)::DOUBLE AS share_zero FROM bs WHERE system = 'discount' GROUP BY 1", "mean share_zero")
def d8(t):
    rows = bench_scores(t, ["discount"])
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.avg((F.col("value") == 0).cast("int")).alias("share_zero"))


# --- paragraphs, bibliography, reference lists, quotes ----------------------------------------


@query("b18_paragraphs", f"""WITH ln AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS ord FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)),
  a AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY ord) AS pv FROM ln),
  b AS (SELECT *, sum(CASE WHEN pv IS NULL OR (regexp_matches(pv, '[.!?:]\\s*[\\)\\]"'']*$') AND NOT regexp_matches(text, '^[a-z0-9]')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM a),
  m AS (SELECT doc_id, grp, string_agg(text, ' ' ORDER BY ord) AS text FROM b GROUP BY 1, 2), k AS (SELECT * FROM m WHERE len(regexp_extract_all(regexp_replace(text, {q(P.CITE)}, ' ', 'g'), '[A-Za-z]{{2,}}')) >= 8)
  SELECT doc_id, CAST(row_number() OVER w - 1 AS INT) AS para, text, coalesce(lag(text) OVER w, '') AS context FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY grp)""")
def b18(t):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    chunks = t.documents.select("doc_id", F.lit(0).alias("sec"), F.posexplode(lines).alias("ord", "text"))
    return C.merge_paragraphs(chunks).select("doc_id", "para", "text", "context")


@query("b21_bibliography", """SELECT o_orderkey // 20 AS doc_id, 'key' || o_orderkey AS key, 'On ' || o_orderpriority || ' things' AS title, CASE WHEN o_orderkey % 2 = 0 THEN printf('%04d.%05d', o_orderkey % 9000, o_orderkey) END AS arxiv FROM orders""")
def b21(t):
    entry = F.concat(F.lit("@article{key"), F.col("o_orderkey"), F.lit(",\n  title = {{On}  "), F.col("o_orderpriority"), F.lit(" things},\n"),
                     F.when(F.col("o_orderkey") % 2 == 0, F.format_string("  eprint = {%04d.%05d},\n", F.col("o_orderkey") % 9000, F.col("o_orderkey"))).otherwise(""), F.lit("}\n"))
    # twenty consecutive orders make up one bibliography, so no group grows with the data
    bibs = t.orders.select(F.expr("o_orderkey div 20").alias("doc_id"), entry.alias("e")).groupBy("doc_id").agg(F.array_join(F.collect_list("e"), "").alias("bib"))
    return S.bibliography(bibs)


@query("b22_reference_list", """SELECT o_orderkey // 20 AS doc_id, CAST(row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) AS INT) AS number, 'Smith' AS surname, CAST(year(o_orderdate) AS INT) AS year, 'A study of ' || o_orderpriority AS title FROM orders""")
def b22(t):
    per = t.orders.groupBy(F.expr("o_orderkey div 20").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.year("o_orderdate").alias("y"), "o_orderpriority"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] J. Smith and A. Doe. A study of "), x["o_orderpriority"], F.lit(". In Proc., "), x["y"].cast("string"), F.lit("."))), "\n")
    return RF.reference_list(per.select("doc_id", text.alias("refs")), "refs").select("doc_id", "number", "surname", "year", "title")


@query("b22_author_year_list", """SELECT o_orderkey // 20 AS doc_id, CAST(row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) AS INT) AS number, 'Óscar' AS surname, CAST(year(o_orderdate) AS INT) AS year,
    'On the ' || o_orderpriority || ' of large orders' AS title, '2301.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS arxiv FROM orders""")
def b22_author_year(t):
    """No numbers of their own: entries end at a year; citations of numbers inside of an entry open none."""
    entry = F.concat(F.lit("Óscar, M. and van der Berg, Karl. On the "), F.col("o_orderpriority"), F.lit(" of large\norders. arXiv:2301."), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"),
                     F.lit(" [2]. In Proceedings of [1] Things, "), F.year("o_orderdate").cast("string"), F.lit(".")).alias("e")
    per = t.orders.groupBy(F.expr("o_orderkey div 20").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", entry))).alias("r"))
    refs = RF.reference_list(per.select("doc_id", F.array_join(F.transform("r", lambda x: x["e"]), "\n").alias("refs")), "refs")
    return refs.select("doc_id", "number", "surname", "year", "title", "arxiv")


@query("b22_citation_markers", """WITH o AS (SELECT o_orderkey AS doc_id, o_custkey % 90 + 1 AS a, o_orderkey % 9 AS w, o_custkey % 290 + 1 AS b FROM orders)
  SELECT doc_id, list_sort(list_distinct(list_concat(list_transform(range(a, a + w + 1), lambda x: x::INT), [b::INT, 7::INT]))) AS numbers, 3::INT AS n_markers, 1::INT AS n_author_year FROM o""")
def b22_markers(t):
    a, w, b = F.col("o_custkey") % 90 + 1, F.col("o_orderkey") % 9, F.col("o_custkey") % 290 + 1
    said = F.concat(F.lit("As shown ["), a.cast("string"), F.lit(" – "), (a + w).cast("string"), F.lit(", "), b.cast("string"), F.lit("]\n12\nand (see Doe, 1999b) by [7] and ["), b.cast("string"), F.lit("], x[4] = [0.5] of 2001."))
    return RF.citation_markers(t.orders.select(F.col("o_orderkey").alias("doc_id"), F.replace(said, F.lit("x[4]"), F.lit("x")).alias("body")), "body")


@query("b24_quote_location", f"""WITH x AS (SELECT doc_id, text AS plain, CASE WHEN doc_id % 3 = 0 THEN replace(substr(text, 5, 40), ' ', '  ') WHEN doc_id % 3 = 1 THEN substr(text, 5, 40) ELSE substr(text, 1, 80) || ' not in the source' END AS f FROM documents)
  SELECT doc_id, {FOUND} AS verified FROM x""")
def b24(t):
    s, d = F.col("text"), F.col("doc_id")
    quote = F.when(d % 3 == 0, F.regexp_replace(F.substring(s, 5, 40), " ", "  ")).when(d % 3 == 1, F.substring(s, 5, 40)).otherwise(F.concat(F.substring(s, 1, 80), F.lit(" not in the source")))
    return t.documents.select("doc_id", C.quote_found(quote, s).alias("verified"))
