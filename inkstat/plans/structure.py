"""Registered queries of document structure (B) and cross-section reuse (C7-C13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstat.functions import patterns as P
from inkstat.functions import text as T
from inkstat.operators import citation as C24
from inkstat.operators import crossref as C
from inkstat.operators import structure as S
from inkstat.operators import tables as TB
from inkstat.operators import views as V
from inkstat.plans.inputs import TEX, tex_docs
from inkstat.plans.registry import query
from inkstat.session import cut


def q(pattern: str) -> str:
    """A pattern as a SQL literal; the oracle's engine has no possessive quantifiers and needs none."""
    return "'" + pattern.replace("*+", "*").replace("'", "''") + "'"


def chain_sql(text: str, steps) -> str:
    for pattern, repl in steps:
        text = f"regexp_replace({text}, {q(pattern)}, {q(repl.replace('$1', chr(92) + '1'))}, 'g')"
    return text


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def rules_sql(text: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(p)}) THEN {q(n)}" for n, p in rules) + f" ELSE {q(default)} END"


CLEAN = chain_sql("raw_title", [(r"\\label\s*\{[^{}]*\}", " "), (r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " "), (r"[{}$~]", " "), (r"\s+", " ")])
STEP = "CASE WHEN name IN {envs} AND kind = 'begin' THEN 1 WHEN name IN {envs} AND kind = 'end' THEN -1 ELSE 0 END"

TOK = TEX + f""",
  pt AS (SELECT doc_id, unnest(p) AS seg, unnest(range(len(p))) AS k FROM (SELECT doc_id, string_split(regexp_replace(tex, {q('(' + S.TOKEN_AT + ')')}, chr(1) || '\\1', 'g'), chr(1)) AS p FROM tx)),
  po AS (SELECT *, CAST(sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY k) - length(seg) AS BIGINT) AS "offset" FROM pt),
  pm AS (SELECT doc_id, "offset", seg, regexp_extract(seg, {q('^(?:' + S.TOKEN_AT + ')')}) AS m FROM po WHERE k > 0),
  tk AS (SELECT doc_id, "offset", m, substr(seg, length(m) + 1) AS rest, length(m) AS width,
    CASE WHEN regexp_matches(m, '^\\\\(?:sub)*section') THEN 'head' WHEN starts_with(m, '\\begin{{') THEN 'begin' WHEN starts_with(m, '\\end{{') THEN 'end'
      WHEN starts_with(m, '\\label{{') THEN 'label' WHEN starts_with(m, '\\appendix') THEN 'appendix' WHEN regexp_matches(m, '^\\\\[cC]ite') THEN 'cite' ELSE 'ref' END AS kind,
    (length(regexp_extract(m, '^\\\\(?:sub)*section')) - 8) // 3 + 1 AS level, regexp_extract(m, {q(r"section\*?\s*(?:\[[^\]]*\])?" + P.BRACED)}, 1) AS raw_title,
    regexp_matches(m, '^\\\\(?:sub)*section\\*') AS starred,
    CASE WHEN regexp_matches(m, '^\\\\(begin|end)\\{{') THEN regexp_extract(m, '\\{{([A-Za-z]+)', 1) ELSE regexp_extract(m, {q('^' + P.REF_MACRO)}, 1) END AS name,
    trim(regexp_extract(m, '\\{{([^}}]+)\\}}', 1)) AS arg, regexp_extract(m, {q('^' + P.REF_MACRO)}, 2) AS refargs FROM pm),
  t0 AS (SELECT * FROM tk WHERE kind <> 'ref' OR NOT regexp_matches(name, {q(P.REF_BLACKLIST)})),
  t1 AS (SELECT *, coalesce(min(CASE WHEN kind = 'begin' AND name = 'document' THEN "offset" + width END) OVER (PARTITION BY doc_id), 0) AS ds,
      min(CASE WHEN kind = 'end' AND name = 'document' THEN "offset" END) OVER (PARTITION BY doc_id) AS de, CASE WHEN kind = 'head' THEN trim({CLEAN}) END AS title FROM t0),
  t2 AS (SELECT *, CASE WHEN kind = 'head' THEN {rules_sql('lower(title)', P.ROLES, 'Other')} END AS role FROM t1 WHERE "offset" >= ds AND "offset" <= de),
  t3 AS (SELECT *, CAST(sum(CASE WHEN kind = 'head' AND level = 1 THEN 1 ELSE 0 END) OVER u - 1 AS BIGINT) AS top,
      coalesce(sum({STEP.format(envs=names(P.FLOAT_ENVS))}) OVER b, 0) AS fd, sum({STEP.format(envs=names(P.FLOAT_ENVS))}) OVER u AS fa,
      coalesce(sum({STEP.format(envs=names(P.MATH_ENVS))}) OVER b, 0) AS md,
      min(CASE WHEN kind = 'appendix' OR (kind = 'head' AND level = 1 AND regexp_matches(title, '(?i)^(?:Appendix|Appendices|Supplementary|Acknowledg)')) THEN "offset" END) OVER (PARTITION BY doc_id) AS mark,
      max(CASE WHEN kind = 'head' AND level = 1 AND role = 'Conclusion' THEN "offset" END) OVER (PARTITION BY doc_id) AS concl
    FROM t2 WINDOW u AS (PARTITION BY doc_id ORDER BY "offset"), b AS (PARTITION BY doc_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  t4 AS (SELECT *, last_value(CASE WHEN kind = 'begin' AND name IN {names(P.FLOAT_ENVS)} AND fd = 0 THEN name END IGNORE NULLS) OVER b AS outer_float,
      coalesce(mark, min(CASE WHEN kind = 'head' AND level = 1 AND "offset" > concl AND regexp_matches(title, {q(P.APPENDIX_TITLE)}) THEN "offset" END) OVER (PARTITION BY doc_id)) AS appendix_start
    FROM t3 WINDOW b AS (PARTITION BY doc_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ol AS (SELECT *, coalesce("offset" >= appendix_start, false) AS in_appendix FROM t4),
  se AS (SELECT * FROM (SELECT doc_id, "offset", level, title, role, top, starred, "offset" + width AS body_start, kind, in_appendix, appendix_start,
      lead("offset") OVER (PARTITION BY doc_id ORDER BY "offset") AS nx,
      min(CASE WHEN kind = 'end' OR level = 1 THEN "offset" END) OVER (PARTITION BY doc_id ORDER BY "offset" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt
    FROM ol WHERE kind = 'head' OR (kind = 'end' AND name = 'document')) WHERE kind = 'head'),
  bo AS (SELECT * FROM se WHERE level = 1 AND NOT in_appendix AND role <> 'Appendix'),
  la AS (SELECT * FROM (SELECT doc_id, arg AS label, "offset", CASE WHEN top >= 0 THEN top END AS top, in_appendix,
      CASE WHEN fd > 0 AND regexp_matches(outer_float, '^table|tabular|longtable') THEN 'table' WHEN fd > 0 AND starts_with(outer_float, 'algorithm') THEN 'algorithm'
        WHEN fd > 0 THEN 'figure' WHEN md > 0 THEN 'equation' ELSE 'section' END AS kind,
      row_number() OVER (PARTITION BY doc_id, arg ORDER BY "offset") AS rn FROM ol WHERE kind = 'label') WHERE rn = 1),
  re AS (SELECT e.*, coalesce(la.kind, 'undefined') AS dst_kind, la.top AS dst_section, coalesce(la.in_appendix, false) AS dst_in_appendix FROM (
      SELECT doc_id, "offset", name AS macro, CASE WHEN top >= 0 THEN top END AS src_section, in_appendix AS src_in_appendix, unnest(l) AS label, unnest(range(len(l))) AS k FROM (
        SELECT *, list_filter(list_transform(string_split(array_to_string(regexp_extract_all(refargs, '\\{{([^{{}}]*)\\}}', 1), ','), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM ol WHERE kind = 'ref')) e
    LEFT JOIN la USING (doc_id, label)),
  al0 AS (SELECT doc_id, kind, arg AS label, "offset", width, regexp_matches(rest, '^\\s*$') AS blank,
      last_value(CASE WHEN kind = 'head' THEN {{'e': "offset" + width, 's': "offset", 'l': level, 't': top}} END IGNORE NULLS) OVER b AS h,
      last_value(CASE WHEN kind IN ('label', 'begin') THEN "offset" END IGNORE NULLS) OVER b AS bl,
      lead(CASE WHEN kind = 'head' THEN {{'e': "offset" + width, 's': "offset", 'l': level, 't': top}} END) OVER (PARTITION BY doc_id ORDER BY "offset") AS n
    FROM ol WINDOW b AS (PARTITION BY doc_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  al AS (SELECT doc_id, label, l AS alias_level, t AS alias_top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY "offset" DESC, gap, s) AS rn FROM (
      SELECT doc_id, label, "offset", "offset" - h.e AS gap, h.s, h.l, h.t FROM al0 WHERE kind = 'label' AND h IS NOT NULL AND "offset" - h.e <= 120 AND (bl IS NULL OR bl < h.e)
      UNION ALL SELECT doc_id, label, "offset", n.s - "offset" - width, n.s, n.l, n.t FROM al0 WHERE kind = 'label' AND n IS NOT NULL AND blank)) WHERE rn = 1 AND t >= 0),
  lo AS (SELECT la.doc_id, la.label, la.top, la."offset", bo.role AS home_role, alias_level, la.kind, ab.top IS NOT NULL AND alias_level = 1 AS is_alias,
      CASE WHEN ab.top IS NOT NULL AND alias_level = 1 THEN 'S:' || alias_top ELSE 'L:' || la.label END AS object
    FROM la JOIN bo ON bo.doc_id = la.doc_id AND bo.top = la.top LEFT JOIN al ON al.doc_id = la.doc_id AND al.label = la.label LEFT JOIN bo ab ON ab.doc_id = la.doc_id AND ab.top = alias_top),
  ob AS (SELECT doc_id, 'S:' || top AS object, 'section' AS kind, top AS home, role AS home_role, "offset" FROM bo
    UNION ALL SELECT doc_id, object, CASE WHEN alias_level IS NOT NULL THEN 'subsection' WHEN kind = 'section' THEN 'other' ELSE kind END, top, home_role, "offset" FROM lo WHERE NOT is_alias),
  nu AS (SELECT doc_id, top, app AS in_appendix, CASE WHEN app THEN chr(CAST(64 + k AS INT)) ELSE CAST(k AS VARCHAR) END AS number FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, app ORDER BY "offset") AS k FROM (SELECT *, in_appendix OR role = 'Appendix' AS app FROM se WHERE level = 1 AND NOT starred))),
  pr AS (SELECT ol.doc_id, ol.top AS src, ol."offset", rest FROM ol JOIN bo ON bo.doc_id = ol.doc_id AND bo.top = ol.top WHERE fa = 0 AND NOT ol.in_appendix),
  k1 AS (SELECT doc_id, 'K1' AS parser, src, "offset", k, CASE WHEN dst_kind = 'undefined' THEN NULL WHEN away THEN 'appendix' ELSE object END AS target,
      CASE WHEN dst_kind = 'undefined' THEN 'label never declared' WHEN NOT away AND object IS NULL THEN 'label declared outside the body' END AS why FROM (
    SELECT re.doc_id, src_section AS src, re."offset", re.k, dst_kind, lo.object, dst_in_appendix OR (dst_section IS NOT NULL AND db.top IS NULL) AS away
    FROM re JOIN bo ON bo.doc_id = re.doc_id AND bo.top = re.src_section LEFT JOIN lo ON lo.doc_id = re.doc_id AND lo.label = re.label LEFT JOIN bo db ON db.doc_id = re.doc_id AND db.top = dst_section
    WHERE NOT src_in_appendix)),
  n2 AS (SELECT doc_id, src, "offset", unnest(l) AS p, unnest(range(len(l))) AS k FROM (SELECT *, list_filter(flatten(list_transform(regexp_extract_all(rest, {q(S.SECTION_NUMBER)}),
      lambda x: [regexp_extract(x, {q(S.SECTION_NUMBER)}, 1), regexp_extract(x, {q(S.SECTION_NUMBER)}, 2)])), lambda x: x <> '') AS l FROM pr)),
  k2 AS (SELECT n2.doc_id, 'K2' AS parser, src, n2."offset", k, CASE WHEN nu.top IS NULL THEN NULL WHEN bo.top IS NULL THEN 'appendix' ELSE 'S:' || nu.top END AS target,
      CASE WHEN nu.top IS NULL THEN 'printed number not found' END AS why FROM n2 LEFT JOIN nu ON nu.doc_id = n2.doc_id AND nu.number = split_part(p, '.', 1) LEFT JOIN bo ON bo.doc_id = nu.doc_id AND bo.top = nu.top),
  nr AS (SELECT doc_id, top, lag(top) OVER w AS pv, lead(top) OVER w AS nx FROM bo WINDOW w AS (PARTITION BY doc_id ORDER BY "offset")),
  d3 AS (SELECT doc_id, src, "offset", unnest(l) AS w, unnest(range(len(l))) AS k FROM (SELECT *, regexp_extract_all(rest, {q(S.DEICTIC)}, 1) AS l FROM pr)),
  k3 AS (SELECT d3.doc_id, 'K3' AS parser, src, d3."offset", k, 'S:' || t AS target, CASE WHEN t IS NULL THEN 'no adjacent section' END AS why
      FROM (SELECT d3.*, CASE WHEN lower(w) IN ('previous', 'preceding', 'prior', 'last') THEN pv ELSE nx END AS t FROM d3 JOIN nr ON nr.doc_id = d3.doc_id AND nr.top = d3.src) d3),
  m3 AS (SELECT doc_id, src, "offset", lower(trim(unnest(l))) AS nm, unnest(range(len(l))) AS k FROM (SELECT *, regexp_extract_all(rest, {q(S.NAMED)}, 1) AS l FROM pr)),
  ur AS (SELECT doc_id, role, min(top) AS top FROM bo GROUP BY 1, 2 HAVING count(*) = 1),
  tw AS (SELECT DISTINCT doc_id, top, lower(w) AS w FROM (SELECT doc_id, top, unnest(regexp_extract_all(title, {q(P.TOKEN)})) AS w FROM bo) WHERE length(w) > 2 AND lower(w) NOT IN {names(P.STOP_WORDS)}),
  nw AS (SELECT DISTINCT doc_id, src, "offset", k, w FROM (SELECT *, unnest(regexp_extract_all(nm, {q(P.TOKEN)})) AS w FROM m3) WHERE length(w) > 2 AND w NOT IN {names(P.STOP_WORDS)}),
  nc AS (SELECT doc_id, src, "offset", k, count(*) AS need FROM nw GROUP BY ALL),
  nh AS (SELECT doc_id, src, "offset", k, min(top) AS tt FROM (SELECT nw.doc_id, src, nw."offset", k, tw.top, count(*) AS got FROM nw JOIN tw ON tw.doc_id = nw.doc_id AND tw.w = nw.w GROUP BY ALL)
      JOIN nc USING (doc_id, src, "offset", k) WHERE got = need GROUP BY ALL HAVING count(*) = 1),
  k4 AS (SELECT m.doc_id, 'K3' AS parser, m.src, m."offset", m.k + 100, 'S:' || coalesce(ur.top, tt), CASE WHEN coalesce(ur.top, tt) IS NULL THEN 'section name not matched' END
      FROM (SELECT *, CASE {' '.join(f"WHEN nm = {q(k)} THEN {q(v)}" for k, v in S.ROLE_WORDS.items())} END AS role FROM m3) m LEFT JOIN ur ON ur.doc_id = m.doc_id AND ur.role = m.role
      LEFT JOIN nh ON nh.doc_id = m.doc_id AND nh.src = m.src AND nh."offset" = m."offset" AND nh.k = m.k),
  k5 AS (SELECT doc_id, 'K3', src, "offset", unnest(range(1, len(l) + 1)) + 200, 'appendix', NULL FROM (SELECT *, regexp_extract_all(rest, {q(S.APPENDIX_WORD)}) AS l FROM pr)),
  ev AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4 UNION ALL SELECT * FROM k5),
  r0 AS (SELECT ev.*, try_cast(substr(target, 3) AS BIGINT) AS tt, coalesce(src = intro AND starts_with(target, 'S:') AND try_cast(substr(target, 3) AS BIGINT) > intro, false) AS c
      FROM ev JOIN (SELECT doc_id, min(top) AS intro FROM bo GROUP BY 1) USING (doc_id)),
  r1 AS (SELECT *, CASE WHEN tt <= lag(tt) OVER (PARTITION BY doc_id, c ORDER BY "offset", parser, k) THEN 1 ELSE 0 END AS br FROM r0),
  r2 AS (SELECT *, sum(br) OVER (PARTITION BY doc_id, c ORDER BY "offset", parser, k) AS run FROM r1),
  r3 AS (SELECT doc_id, run, count(*) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, run) AS rn FROM r2 WHERE c GROUP BY 1, 2),
  rd AS (SELECT r2.* EXCLUDE (tt, c, br, run), c AND r3.run IS NOT NULL AS roadmap FROM r2 LEFT JOIN (SELECT * FROM r3 WHERE rn = 1 AND len >= 2) r3 ON r3.doc_id = r2.doc_id AND r3.run = r2.run),
  rc AS (SELECT ob.doc_id, ob.object, kind, home, home_role, count(*) FILTER (src = home) AS n_local, count(DISTINCT src) FILTER (src <> home AND NOT roadmap) AS reach,
      count(DISTINCT src) FILTER (src <> home) AS reach_incl_roadmap, count(DISTINCT src) FILTER (src > home AND NOT roadmap) AS backward, count(DISTINCT src) FILTER (src < home AND NOT roadmap) AS forward
    FROM ob LEFT JOIN rd ON rd.doc_id = ob.doc_id AND rd.target = ob.object GROUP BY 1, 2, 3, 4, 5)"""

W = f"WITH {TOK} "
RX_BODY = r"(?s)(?:" + P.BODY_END.replace("(?i)", "(?i:") + ")).*$"
BODY_SQL = f"regexp_replace(regexp_replace(tex, '(?s)^.*?\\\\begin\\{{document\\}}', ''), {q(RX_BODY)}, '')"
TRIM_SQL = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query("b1_strip_comments", f"WITH {TEX} SELECT doc_id, regexp_replace(tex, '(^|[^\\\\])%[^\\n]*', '\\1', 'g') AS text FROM tx")
def b1(t):
    return tex_docs(t).select("doc_id", T.strip_comments(F.col("tex")).alias("text"))


@query("b1_strip_comments_pairs", f"WITH {TEX} SELECT doc_id, regexp_replace(tex, '(?m)^((?:\\\\[^\\n]|[^\\\\%\\n])*)%[^\\n]*', '\\1', 'g') AS text FROM tx")
def b1b(t):
    return tex_docs(t).select("doc_id", T.strip_comments_pairs(F.col("tex")).alias("text"))


def tokens(t):
    return S.tex_tokens(tex_docs(t))


def token_table(t):
    """The outline written once to the checkpoint folder: the operators below read it many times."""
    return cut(S.outline(tokens(t)))


@query("b2_sections", W + """SELECT doc_id, CAST("offset" AS INT) AS "offset", CAST(level AS INT) AS level, title, role, top, starred, CAST(body_start AS INT) AS body_start,
  CAST(CASE WHEN level = 1 THEN nt ELSE nx END AS INT) AS "end", in_appendix FROM se""")
def b2(t):
    return S.sections(tokens(t)).drop("appendix_start")


@query("b3_section_roles", f"WITH {TEX}, h AS (SELECT unnest(regexp_extract_all(tex, {q(r'\\\\(?:sub)*section' + r'\\*?' + P.BRACED)}, 1)) AS raw_title FROM tx)".replace("\\\\\\\\", "\\\\") .replace("\\\\*", "\\*")
       + f" SELECT raw_title AS title, {rules_sql('lower(trim(' + CLEAN + '))', P.ROLES, 'Other')} AS role, count(*) AS n FROM h GROUP BY 1, 2")
def b3(t):
    titles = tex_docs(t).select(F.explode(F.regexp_extract_all("tex", F.lit(r"\\(?:sub)*section\*?" + P.BRACED), F.lit(1))).alias("title"))
    return titles.groupBy("title").agg(F.count(F.lit(1)).alias("n")).withColumn("role", T.role_of(F.col("title")))


@query("b4_appendix_boundary", W + 'SELECT doc_id, CAST(min(appendix_start) AS INT) AS appendix_start, count(*) FILTER (level = 1 AND in_appendix) AS n_appendix_sections FROM se GROUP BY doc_id')
def b4(t):
    return S.sections(tokens(t)).groupBy("doc_id").agg(
        F.min("appendix_start").alias("appendix_start"), F.count_if((F.col("level") == 1) & F.col("in_appendix")).alias("n_appendix_sections"))


@query("b5_labels", W + 'SELECT doc_id, label, CAST("offset" AS INT) AS "offset", top, kind, in_appendix FROM la')
def b5(t):
    return S.labels(tokens(t)).select("doc_id", "label", "offset", "top", "kind", "in_appendix")


@query("b6_abstract", f"WITH {TEX} SELECT doc_id, regexp_extract(tex, '(?s)\\\\begin\\{{abstract\\}}(.*?)\\\\end\\{{abstract\\}}', 1) AS abstract FROM tx")
def b6(t):
    return tex_docs(t).select("doc_id", T.abstract_of(F.col("tex")).alias("abstract"))


# the rules of the view, written apart from the operator: one environment at a time, no look-ahead
CUT_ENVS = [("tcolorbox tcblisting lstlisting verbatim Verbatim minted mdframed framed alltt promptbox listing boxedverbatim shaded tabbing exampleblock prompt chat dialogue quote quotation verse", " xxverbatimxx "),
            ("figure table algorithm algorithmic wrapfigure wraptable sidewaystable tabular tabularx longtable minipage tikzpicture boxedminipage comment", " "),
            ("equation align gather multline eqnarray displaymath flalign alignat", " xxmathxx ")]
PROSE_SQL = [(rf"(?s)\\begin\{{{e}\*?\}}.*?\\end\{{{e}\*?\}}", put) for group, put in CUT_ENVS for e in group.split()] + [
    (r"(?s)\$\$.*?\$\$|\\\[.*?\\\]", " xxmathxx "), (r"\$[^$]*\$", " xxmathxx "), (r"\\[cC]ite[a-z]*\*?(?:\[[^\]]*\])*\{[^}]*\}", " xxcitexx "), (r"\\(?:[A-Za-z]*[cC]|auto|eq|page|[Ss]ec|fig|tab|)ref\{[^{}]*\}", " xxrefxx "),
    (r"\\(?:label|caption|centering|footnote|includegraphics|maketitle|bibliography|bibliographystyle)(?:\[[^\]]*\])?(?:\{[^{}]*\})?", " "), (r"\\(?:sub)*section\*?\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", "\n\n$1.\n\n"), (r"\\paragraph\{([^{}]*)\}", "\n\n$1. "),
    (r"\\(?:begin|end)\{[A-Za-z]+\*?\}", "\n"), (r"\\item\b", "\n"), (r"\\(?:emph|text[a-z]*|underline|mbox)\{([^{}]*)\}", "$1"), (r"\\[A-Za-z]+\*?\s*", " "), (r"[{}~]", " "), (r"\\([%&])", "$1"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]


@query("b7_prose_view", f"WITH {TEX} SELECT doc_id, {chain_sql('tex', PROSE_SQL)} AS prose FROM tx")
def b7(t):
    return tex_docs(t).select("doc_id", T.prose_view(F.col("tex")).alias("prose"))


@query("b7_prose_by_segments", f"WITH {TEX} SELECT doc_id, {chain_sql('tex', PROSE_SQL)} AS prose, true AS has_map FROM tx")
def b7_segments(t):
    views = V.prose_views(tex_docs(t))
    ends = V.source_spans(views.withColumns({"start": F.lit(0), "end": F.length("prose")}))
    return ends.select("doc_id", "prose", (F.col("tex_start") < F.col("tex_end")).alias("has_map"))


# every line of a text becomes a paragraph of two sentences whose places follow from its length
LINE_WORDS = "trim(regexp_replace(l, '[^A-Za-z]+', ' ', 'g'))"
ONE, TWO = ("Aaa \\emph{", "} see e.g. Bbb in \\Secref{s:x} and $x_1$ \\cite[p.~3]{k, m} zzz."), " Ccc \\href{u}{v} \\textbf{ends}."


@query("b10_sentence_spans", f"""WITH ln AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents)),
  w AS (SELECT doc_id, i, {LINE_WORDS} AS w FROM ln),
  x AS (SELECT *, 'Aaa ' || w || CASE WHEN w = '' THEN '' ELSE ' ' END || 'see e.g. Bbb in xxrefxx and xxmathxx xxcitexx zzz.' AS one, 'Ccc u v ends.' AS two, length(w) + {len(ONE[0]) + len(ONE[1])} AS n1, {len(TWO)} AS n2 FROM w),
  p AS (SELECT *, sum(n1 + n2 + 2) OVER u - (n1 + n2 + 2) AS tex, sum(length(one) + length(two) + 3) OVER u - (length(one) + length(two) + 3) AS view FROM x WINDOW u AS (PARTITION BY doc_id ORDER BY i))
  SELECT doc_id, CAST(2 * i AS INT) AS ord, view::BIGINT AS para, one AS text, view::BIGINT AS view_start, (view + length(one))::BIGINT AS view_end, tex::BIGINT AS tex_start, (tex + n1)::BIGINT AS tex_end FROM p
  UNION ALL SELECT doc_id, CAST(2 * i + 1 AS INT), view::BIGINT, two, (view + length(one) + 1)::BIGINT, (view + length(one) + 1 + length(two))::BIGINT, (tex + n1 + 1)::BIGINT, (tex + n1 + n2)::BIGINT FROM p""")
def b10_spans(t):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    tex = F.array_join(F.transform(lines, lambda l: F.concat(F.lit(ONE[0]), F.trim(F.regexp_replace(l, "[^A-Za-z]+", " ")), F.lit(ONE[1] + TWO + "\n\n"))), "")
    return V.sentence_spans(t.documents.select("doc_id", tex.alias("tex")))


@query("b24_quote_spans", """WITH q AS (SELECT doc_id, doc_id % 4 AS kind, length(coalesce(text, '')) AS n, substr(md5(doc_id::VARCHAR), 1, 12) AS h FROM documents)
  SELECT doc_id, CASE WHEN kind <> 3 THEN n + 1 END AS start, CASE kind WHEN 0 THEN n + 1 + 47 WHEN 1 THEN n + 1 + 47 WHEN 2 THEN n + 1 + 47 + 55 END AS "end" FROM q""")
def b24_spans(t):
    """Quotes at known places behind a text: literal, in another spelling, long with another end, and absent."""
    h = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12)
    said = F.concat(F.lit("Zq"), h, F.lit(" holds; (Beta, gamma) is 12%, not")).alias("said")  # 47 characters
    more = ", as the longer remark on this very page goes on to say."
    source = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said, F.lit(more), F.lit(" "), F.coalesce("text", F.lit("")))
    spelled = F.concat(F.lit("zq"), h, F.lit(" HOLDS beta -- gamma is 12% not"))
    quote = (F.when(F.col("doc_id") % 4 == 0, said).when(F.col("doc_id") % 4 == 1, spelled)
             .when(F.col("doc_id") % 4 == 2, F.concat(spelled, F.lit(" as the longer remark on this very page went on to say"))).otherwise(F.concat(F.lit("never "), said)))
    found = C24.verify_quotes(t.documents.select("doc_id", quote.alias("quote"), source.alias("source")))
    return found.select("doc_id", F.col("span.start").cast("bigint").alias("start"), F.col("span.end").cast("bigint").alias("end"))


@query("b8_body_and_flat_view", f"WITH {TEX} SELECT doc_id, length(body) AS body_chars, {TRIM_SQL.format(x=chain_sql('body', T.FLAT_STEPS))} AS flat FROM (SELECT doc_id, {BODY_SQL} AS body FROM tx)")
def b8(t):
    body = tex_docs(t).select("doc_id", T.body_of(F.col("tex")).alias("body"))
    return body.select("doc_id", F.length("body").cast("bigint").alias("body_chars"), T.flat_view(F.col("body")).alias("flat"))


DETEX = TRIM_SQL.format(x=chain_sql("regexp_replace(tex, '(^|[^\\\\])%[^\\n]*', '\\1', 'g')", T.DETEX_STEPS))
DEMD = TRIM_SQL.format(x=chain_sql("text", T.MARKDOWN_STEPS))


@query("b9_accepted_text", f"""WITH {TEX}, a AS (SELECT doc_id, {DETEX} AS a FROM tx), b AS (SELECT doc_id, {DEMD} AS b FROM documents)
  SELECT doc_id, CASE WHEN length(a) > 2000 THEN 'tex' WHEN length(b) > 2000 THEN 'ocr' END AS origin, CASE WHEN length(a) > 2000 THEN a WHEN length(b) > 2000 THEN b END AS text
  FROM a JOIN b USING (doc_id)""")
def b9(t):
    both = tex_docs(t).join(t.documents.select("doc_id", "text"), "doc_id")
    return both.select("doc_id", T.accepted_text(F.col("tex"), F.col("text")).alias("x")).select("doc_id", "x.text", "x.origin")


@query("b12_reference_events", W + 'SELECT doc_id, label, CAST("offset" AS INT) AS "offset", macro, src_section, src_in_appendix, CAST(k AS INT) AS k, dst_section, dst_kind, dst_in_appendix FROM re')
def b12(t):
    return S.reference_events(token_table(t))


@query("b13_text_section_references", f"""WITH {TEX}, h AS (SELECT doc_id, unnest(l) AS hit, unnest(range(len(l))) AS k FROM (SELECT doc_id, regexp_extract_all(tex, {q(P.TEXT_SECTION)}) AS l FROM tx))
  SELECT doc_id, CAST(k AS INT) AS k, unnest(l) AS target, CAST(unnest(range(len(l))) AS INT) AS j FROM (SELECT *, regexp_extract_all(hit, '[A-Z]?\\d+(?:\\.\\d+)*|\\b[A-Z]\\b') AS l FROM h)""")
def b13(t):
    return S.text_section_references(tex_docs(t), "tex")


CELLS = f"""tb AS (SELECT doc_id, unnest(l) AS body, unnest(range(len(l))) AS tbl FROM (SELECT doc_id, regexp_extract_all(tex, '(?s)\\\\begin\\{{tabular\\}}\\{{lcc\\}}(.*?)\\\\end\\{{tabular', 1) AS l FROM tx)),
  rw AS (SELECT doc_id, tbl, unnest(l) AS row, unnest(range(len(l))) AS r FROM (SELECT *, list_filter(string_split(body, '\\\\'), lambda x: NOT regexp_matches(x, '^[\\s&]*$')) AS l FROM tb)),
  ce AS (SELECT doc_id, tbl, r, trim(unnest(string_split(row, '&'))) AS raw, unnest(range(len(string_split(row, '&')))) AS c FROM rw)"""


@query("b14_table_cells", f"""WITH {TEX}, {CELLS} SELECT doc_id, CAST(tbl AS INT) AS tbl, CAST(r AS INT) AS r, CAST(c AS INT) AS c, raw, r = 0 AS is_header FROM ce""")
def b14(t):
    return TB.parsed_tables(TB.table_cells(tex_docs(t))).select("doc_id", "tbl", "r", "c", "raw", "is_header")


@query("b15_number_cells", f"""WITH {TEX}, {CELLS}, p AS (SELECT *, regexp_extract(raw, '([0-9]+\\.[0-9]) \\\\pm', 1) AS a, regexp_extract(raw, '\\\\textbf\\{{([0-9.]+)\\}}', 1) AS b, regexp_matches(raw, '^1,234$') AS k FROM ce),
  v AS (SELECT *, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN k THEN '1234' END AS printed FROM p)
  SELECT doc_id, CAST(tbl AS INT) AS tbl, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CASE WHEN printed IS NULL THEN 'text' ELSE 'number' END AS kind, CAST(printed AS DOUBLE) AS value, printed,
    CASE WHEN a <> '' THEN 0.4::DOUBLE END AS std, b <> '' AS is_bold, false AS is_percent FROM v""")
def b15(t):
    return TB.table_cells(tex_docs(t)).select("doc_id", "tbl", "r", "c", T.number_cell(F.col("raw")).alias("x")).select("doc_id", "tbl", "r", "c", "x.*")


@query("b16_metric_direction", f"""WITH {TEX}, {CELLS} SELECT doc_id, CAST(tbl AS INT) AS tbl, CAST(c AS INT) AS c, CAST(CASE WHEN lower(raw) = 'acc' THEN 1 WHEN lower(raw) = 'loss' THEN -1 ELSE 1 END AS INT) AS direction FROM ce WHERE r = 0""")
def b16(t):
    return TB.column_names(TB.parsed_tables(TB.leading_cells(TB.table_cells(tex_docs(t))))).select("doc_id", "tbl", "c", "direction")


# every line of a text is a table with spans, breaks inside of cells, options, rules and groups; {n} its length, {i} its number
GRID = """¤begin{table*}[t]¤caption{Error of {run ¤emph{{i}}}, lower is better}¤label{t:{i}}¤begin{tabular}[t]{@{}lcc@{}} ¤toprule
¤multirow{2}{*}{Model} & ¤multicolumn{2}{c}{¤textbf{Test}} ¤¤ ¤cmidrule(lr){2-3}
 & ¤makecell{Acc¤¤(top)} & Loss ¤¤[2pt] ¤midrule
Base & ¤shortstack{1¤¤2} & ¤textbf{{n}.25} ¤¤
¤multicolumn{3}{l}{¤textit{Group {i}}} ¤¤
Plain & 7 & 8 ¤¤
¤multirow{2}{*}{Ours} & {n}.5 ¤pm 0.1 & {a & b} ¤¤
 & {n} & x ¤& y ¤¤ ¤hline
Last & {n}~¤% & (3) ¤¤ ¤bottomrule
¤end{tabular}¤end{table*}
"""
GRID_LINES = "SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS tbl FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents)"


def grid_docs(t):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    one = lambda l, i: F.replace(F.replace(F.lit(GRID.replace("¤", "\\")), F.lit("{i}"), i.cast("string")), F.lit("{n}"), F.length(l).cast("string"))
    return t.documents.select("doc_id", F.array_join(F.transform(lines, one), "").alias("tex"))


@query("b14_table_rows", f"""WITH g AS ({GRID_LINES}), x AS (SELECT doc_id, CAST(tbl AS INT) AS tbl, length(l)::VARCHAR AS n, tbl::VARCHAR AS i FROM g)
  SELECT doc_id, tbl, 2::INT AS r, 'Base' AS name, 'Base' AS own_name, NULL AS row_group, '1' AS one, '\\textbf{{' || n || '.25}}' AS two FROM x
  UNION ALL SELECT doc_id, tbl, 4::INT, 'Plain', 'Plain', 'Group ' || i, '7', '8' FROM x
  UNION ALL SELECT doc_id, tbl, 5::INT, 'Ours', 'Ours', NULL, n || '.5', '{{a & b}}' FROM x
  UNION ALL SELECT doc_id, tbl, 6::INT, 'Ours', '', NULL, n, 'x \\& y' FROM x
  UNION ALL SELECT doc_id, tbl, 7::INT, 'Last', 'Last', 'Ours', n, '(3)' FROM x""")
def b14_rows(t):
    rows = TB.body_rows(TB.parsed_tables(TB.table_cells(grid_docs(t))))
    cell = lambda k: F.get("cells", F.lit(k))
    return rows.select("doc_id", "tbl", "r", "name", "own_name", "row_group", cell(1)["cell"]["printed"].alias("one"), cell(2)["raw"].alias("two"))


@query("b16_column_names", f"""WITH g AS ({GRID_LINES}) SELECT doc_id, CAST(tbl AS INT) AS tbl, c, header, d AS direction FROM g,
  (VALUES (0::INT, 'Model', -1::INT), (1::INT, 'Test | Acc (top)', 1::INT), (2::INT, 'Test | Loss', -1::INT)) AS v(c, header, d)""")
def b16_names(t):
    return TB.column_names(TB.parsed_tables(TB.leading_cells(TB.table_cells(grid_docs(t))))).select("doc_id", "tbl", "c", "header", "direction")


@query("b17_rounding_matches", """WITH p AS (SELECT p_size AS doc_id, CAST(round(p_retailprice * 10) AS BIGINT) AS m FROM part),
  n AS (SELECT doc_id, m / 1000.0::DOUBLE AS v FROM p), c AS (SELECT doc_id, (m // 100) / 10.0::DOUBLE AS v FROM p)
  SELECT a.doc_id, count(*) AS n FROM n a JOIN c b ON a.doc_id = b.doc_id AND a.v - 0.5::DOUBLE * power(10::DOUBLE, -3) < b.v + 0.5::DOUBLE * power(10::DOUBLE, -1)
    AND b.v - 0.5::DOUBLE * power(10::DOUBLE, -1) < a.v + 0.5::DOUBLE * power(10::DOUBLE, -3) GROUP BY 1""")
def b17(t):
    m = F.round(F.col("p_retailprice") * 10).cast("bigint")
    rows = t.part.select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("id"), m.alias("m"))
    num = rows.select("doc_id", "id", F.format_string("%d.%03d", F.expr("m div 1000"), F.col("m") % 1000).alias("printed"))
    cell = rows.select("doc_id", "id", F.format_string("%d.%d", F.expr("m div 1000"), F.expr("(m div 100) % 10")).alias("printed"))
    return S.rounding_match_counts(num, cell)


COUNT = lambda p: f"CAST(len(regexp_extract_all(body, {q(p)})) AS INT)"


@query("b19_structural_metrics", f"""WITH {TEX}, b AS (SELECT doc_id, tex, {BODY_SQL} AS body FROM tx)
  SELECT doc_id, {COUNT(chr(92)*2 + 'section' + chr(92) + '*?' + chr(92) + '{')} AS n_sections, {COUNT(chr(92)*2 + 'subsection')} AS n_subsections, 0::INT AS n_figures, {COUNT(chr(92)*2 + 'begin' + chr(92) + '{table')} AS n_tables, 0::INT AS n_algorithms,
    {COUNT(chr(92)*2 + 'begin' + chr(92) + '{equation')} AS n_equations, {COUNT(P.CITE)} AS n_cite_cmds,
    CAST(len(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(body, {q(P.CITE)}, 1), lambda g: regexp_split_to_array(g, '[,\\s]+'))), lambda x: x <> ''))) AS INT) AS n_unique_cites,
    {COUNT(chr(92)*2 + '(?:auto|c|C|eq)?ref' + chr(92) + '*?' + chr(92) + '{')} AS n_internal_refs, contains(body, '{{Related Work}}') AS has_related_work, contains(tex, '\\appendix') AS has_appendix, 0::INT AS n_github FROM b""")
def b19(t):
    return S.structural_metrics(tex_docs(t))


@query("b20_citation_roles", f"""WITH {TEX}, p AS (SELECT doc_id, unnest(l) AS part, unnest(range(len(l))) AS k FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(tex, '(?s)^.*?\\\\begin\\{{document\\}}', ''), '(\\\\section\\*?\\{{[^}}]*\\}})', chr(1) || '\\1', 'g'), chr(1)) AS l FROM tx)),
  s AS (SELECT doc_id, CASE WHEN k = 0 THEN 'other' ELSE {rules_sql("lower(regexp_extract(part, '^" + chr(92)*2 + "section" + chr(92) + "*?" + chr(92) + "{([^}]*)" + chr(92) + "}', 1))", P.CITE_SECTIONS, 'other')} END AS section,
     unnest(flatten(list_transform(regexp_extract_all(part, {q(P.CITE)}, 1), lambda g: string_split(g, ',')))) AS key FROM p)
  SELECT doc_id, trim(key) AS key, section, count(*) AS n FROM s WHERE trim(key) <> '' GROUP BY 1, 2, 3""")
def b20(t):
    return S.citation_roles(tex_docs(t))


@query("b23_method_figures", f"""WITH {TEX} SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(tex, {q(r"\\\\caption\\s*(?:\\[[^\\]]*\\])?\\s*".replace(chr(92)*2, chr(92)) + P.BRACED)}, 1), lambda c: regexp_matches(c, {q(P.METHOD_FIGURE)}))[1:3],
  lambda c: substr(c, 1, 160)), '|') AS captions FROM tx""")
def b23(t):
    return S.method_figures(tex_docs(t)).select("doc_id", F.array_join("captions", "|").alias("captions"))


@query("c7_declared_objects", W + 'SELECT doc_id, object, kind, home, home_role, CAST("offset" AS INT) AS "offset" FROM ob')
def c7(t):
    return C.objects(token_table(t))


@query("c8_heading_aliases", W + "SELECT doc_id, label, alias_top, CAST(alias_level AS INT) AS alias_level FROM al")
def c8(t):
    return S.heading_aliases(tokens(t))


@query("c9_section_numbers", W + "SELECT doc_id, top, number, in_appendix FROM nu")
def c9(t):
    return S.section_numbers(tokens(t))


def roadmapped(tok):
    return C.mark_roadmap(C.pointers(tok), S.body_sections(tok))


@query("c10_pointer_events", W + 'SELECT doc_id, parser, src, CAST("offset" AS INT) AS "offset", CAST(k AS INT) AS k, target, why FROM ev')
def c10(t):
    return C.pointers(token_table(t))


@query("c11_roadmap", W + "SELECT doc_id, count(*) AS n_roadmap, min(target) AS first_target FROM rd WHERE roadmap GROUP BY doc_id")
def c11(t):
    return roadmapped(token_table(t)).where("roadmap").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_roadmap"), F.min("target").alias("first_target"))


def reached(t):
    tok = token_table(t)
    ev = cut(roadmapped(tok))
    return C.reach(C.objects(tok), ev), ev


@query("c12_reach", W + "SELECT *, reach > 0 AS reused FROM rc")
def c12(t):
    return reached(t)[0]


@query("c13_crossref_score", W + """SELECT o.*, coalesce(n_events, 0) AS n_events, coalesce(n_resolved, 0) AS n_resolved, coalesce(appendix_pointers, 0) AS appendix_pointers, coalesce(n_roadmap, 0) AS n_roadmap,
    n_resolved / nullif(n_events, 0)::DOUBLE AS coverage FROM (
  SELECT doc_id, count(*) AS n_objects, count(*) FILTER (reach > 0) AS n_reused, count(*) FILTER (n_local > 0 OR reach_incl_roadmap > 0) AS n_referenced, avg(reach) AS mean_reach, max(reach) AS max_reach,
    CAST(sum(backward) AS BIGINT) AS backward_links, CAST(sum(forward) AS BIGINT) AS forward_links, (count(*) - count(*) FILTER (reach > 0)) / count(*)::DOUBLE AS score, count(*) < 3 AS weak,
    count(*) FILTER (reach_incl_roadmap > 0) / count(*)::DOUBLE AS reuse_rate_incl_roadmap FROM rc GROUP BY 1) o
  LEFT JOIN (SELECT doc_id, count(*) AS n_events, count(target) AS n_resolved, count(*) FILTER (target = 'appendix') AS appendix_pointers, count(*) FILTER (roadmap) AS n_roadmap FROM rd GROUP BY 1) e USING (doc_id)""",
       "mean_reach score reuse_rate_incl_roadmap coverage")
def c13(t):
    return C.document_scores(*reached(t))


@query("c13_reuse_by_kind", W + "SELECT kind, count(*) AS n, count(*) FILTER (reach > 0) AS n_reused, avg((reach > 0)::INT) AS reuse_rate FROM rc GROUP BY 1", "reuse_rate")
def c13b(t):
    return C.reuse_rates(reached(t)[0], "kind")


@query("c13_unresolved_reasons", W + "SELECT parser, why, count(*) AS n FROM ev WHERE why IS NOT NULL GROUP BY 1, 2")
def c13c(t):
    return C.unresolved_reasons(C.pointers(token_table(t)))
