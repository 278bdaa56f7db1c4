"""Inputs the registered queries derive from the given tables, with the same rule as SQL.

Each function returns a DataFrame; the constant of the same name holds the common table
expressions that build it on the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- paired scores: an order is a pair, its early and late lines are the two sides ------------

DIRECTIONS = {"quantity": 1, "price": -1, "discount": 1, "tax": -1}
SYSTEMS = list(DIRECTIONS)


def bench_wide(t) -> DataFrame:
    """One row per pair side: pair_id, label, four scores, words, tier, pool."""
    return (
        t.lineitem.groupBy(
            F.col("l_orderkey").alias("pair_id"), (F.col("l_linenumber") <= 3).cast("int").alias("label")
        )
        .agg(
            F.max("l_quantity").alias("quantity"),
            F.max("l_extendedprice").alias("price"),
            F.min("l_discount").alias("discount"),
            F.max("l_tax").alias("tax"),
            (F.sum("l_linenumber") * 40 + F.count(F.lit(1))).alias("words"),
        )
        .withColumn("tier", (F.col("pair_id") % 4).cast("int"))
        .withColumn("pool", F.when(F.col("pair_id") % 3 == 0, "widened").otherwise("cited"))
    )


BENCH_WIDE = """bw AS (
  SELECT l_orderkey AS pair_id, CAST(l_linenumber <= 3 AS INT) AS label, max(l_quantity) AS quantity,
         max(l_extendedprice) AS price, min(l_discount) AS discount, max(l_tax) AS tax,
         CAST(sum(l_linenumber) * 40 + count(*) AS BIGINT) AS words, CAST(l_orderkey % 4 AS INT) AS tier,
         CASE WHEN l_orderkey % 3 = 0 THEN 'widened' ELSE 'cited' END AS pool
  FROM lineitem GROUP BY 1, 2, 8, 9)"""


def bench_scores(t, systems: list[str] | None = None) -> DataFrame:
    """Long form: item_id, pair_id, label, words, tier, pool, system, value."""
    names = systems or SYSTEMS
    return (
        bench_wide(t)
        .withColumn("item_id", F.col("pair_id") * 2 + F.col("label"))
        .unpivot(["item_id", "pair_id", "label", "words", "tier", "pool"], names, "system", "value")
    )


BENCH_LONG = BENCH_WIDE + """, bs AS (
  SELECT pair_id * 2 + label AS item_id, pair_id, label, words, tier, pool,
         unnest(['quantity', 'price', 'discount', 'tax']) AS system,
         unnest([quantity, price, discount, tax]) AS value FROM bw)"""

# oriented scores: quantity and discount point up, price and tax down
BENCH_ORIENTED = BENCH_LONG + """, o AS (
  SELECT *, CASE WHEN system IN ('price', 'tax') THEN -value ELSE value END AS s FROM bs)"""

# average rank and AUROC of column s inside a partition, as a reusable pattern
def auroc_sql(source: str, by: str, value: str = "s") -> str:
    """AUROC through average ranks: (sum of positive ranks - n1(n1+1)/2) / (n1 n0)."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg,
      (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0)
        / nullif(CAST(sum(label) AS DOUBLE) * sum(1 - label), 0) AS auroc
    FROM (SELECT *, rank() OVER ({part} ORDER BY {value})
                  + (count(*) OVER (PARTITION BY {keys}{value}) - 1) / 2.0 AS r
          FROM {source} WHERE {value} IS NOT NULL) {group}"""


# --- records: an order is a paper of a year, its price decides rating and decision ------------

RECORD_SYSTEMS = ["bino", "nts", "agg", "xsec"]


def records(t) -> DataFrame:
    """paper_id, year, rating, grp, accept, domain, n_words and four system scores."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("paper_id"),
            F.year("o_orderdate").cast("int").alias("year"),
            (F.pmod(cents, F.lit(37)) / F.lit(4.0) + 1).alias("rating"),
            F.when(F.substring("o_orderpriority", 1, 1).isin("1"), "oral").when(F.substring("o_orderpriority", 1, 1) == "2", "spotlight")
            .when(F.substring("o_orderpriority", 1, 1) == "3", "poster").otherwise("reject").alias("grp"),
            F.col("c_mktsegment").alias("domain"),
            (F.pmod(cents, F.lit(9000)) + 500).alias("n_words"),
            (F.pmod(cents, F.lit(101)) / F.lit(100.0)).alias("fraction_ai"),
            F.col("c_acctbal").alias("bino"),
            (F.pmod(cents, F.lit(53)) / F.lit(10.0)).alias("nts"),
            (F.pmod(cents, F.lit(1009)) / F.lit(1009.0)).alias("agg"),
            F.when(F.pmod(cents, F.lit(11)) != 0, (F.pmod(cents + F.col("o_custkey"), F.lit(997)) / F.lit(997.0))).alias("xsec"),
        )
        .withColumn("accept", F.col("grp") != "reject")
    )


RECORDS = """rec0 AS (
  SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, substr(o_orderpriority, 1, 1) AS pr
  FROM orders JOIN customer ON o_custkey = c_custkey),
rec AS (
  SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS INT) AS year, (cents % 37) / 4.0::DOUBLE + 1 AS rating,
         CASE pr WHEN '1' THEN 'oral' WHEN '2' THEN 'spotlight' WHEN '3' THEN 'poster' ELSE 'reject' END AS grp,
         c_mktsegment AS domain, (cents % 9000) + 500 AS n_words, (cents % 101) / 100.0::DOUBLE AS fraction_ai,
         c_acctbal AS bino, (cents % 53) / 10.0::DOUBLE AS nts, (cents % 1009) / 1009.0::DOUBLE AS agg,
         CASE WHEN cents % 11 <> 0 THEN ((cents + o_custkey) % 997) / 997.0::DOUBLE END AS xsec,
         pr NOT IN ('4', '5') AS accept
  FROM rec0)"""


def record_scores(t) -> DataFrame:
    """Long form of ``records`` with one row per system that has a score."""
    keep = ["paper_id", "year", "rating", "grp", "accept", "domain", "n_words", "fraction_ai"]
    return records(t).unpivot(keep, RECORD_SYSTEMS, "system", "value").where(F.col("value").isNotNull())


RECORD_LONG = RECORDS + """, rl AS (
  SELECT * FROM (SELECT paper_id, year, rating, grp, accept, domain, n_words, fraction_ai,
         unnest(['bino', 'nts', 'agg', 'xsec']) AS system, unnest([bino, nts, agg, xsec]) AS value FROM rec)
  WHERE value IS NOT NULL)"""


# --- units: a line of a document is a section, a sentence of the line a unit ------------------

ABBR = r"et al|e\.g|i\.e|cf|vs|Fig|Figs|Eq|Eqs|Sec|Secs|Tab|Tabs|resp|approx|no|etc|al|Dr|Prof|w\.r\.t|a\.k\.a|Alg|App"


def sentences_sql(text: str) -> str:
    """List of sentences: mark every candidate break, then take back those after an abbreviation."""
    marked = rf"""regexp_replace({text}, '([.!?])(\s+)([A-Z0-9(\["''“])', '\1\2' || chr(1) || '\3', 'g')"""
    kept = rf"""regexp_replace({marked}, '(?i)\b((?:{ABBR})\.\s+)' || chr(1), '\1', 'g')"""
    return rf"""list_filter(list_transform(string_split({kept}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


TOKENS_SQL = r"""regexp_extract_all(lower(s), '[a-z][a-z\-'']*|\d+(?:\.\d+)?')"""

UNITS = f"""ln AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS sec FROM (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)),
  sn AS (SELECT doc_id, sec, unnest(ss) AS s, unnest(range(len(ss))) AS k FROM (SELECT doc_id, sec, {sentences_sql('line')} AS ss FROM ln)),
  u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, k) - 1 AS ord, sec, CASE WHEN sec = 0 THEN 'summary' ELSE 'body' END AS role,
     {TOKENS_SQL} AS toks FROM sn)"""


def grams_sql(n: int, tag: str = "") -> str:
    return f"""g{tag} AS (SELECT doc_id, ord, sec, role, p - 1 AS pos, array_to_string(toks[p:p + {n - 1}], ' ') AS gram FROM (
    SELECT *, unnest(range(1, len(toks) - {n - 2})) AS p FROM u WHERE len(toks) >= {n})),
  f{tag} AS (SELECT doc_id, gram, min(ord) AS o_ord, arg_min(sec, ord) AS o_sec, arg_min(role, ord) AS o_role, count(*) AS n FROM g{tag} GROUP BY 1, 2),
  h{tag} AS (SELECT g{tag}.*, o_ord, o_role FROM g{tag} JOIN f{tag} USING (doc_id, gram) WHERE o_ord < ord AND o_sec <> sec),
  cv{tag} AS (SELECT doc_id, ord, unnest(range(pos, pos + {n})) AS q FROM h{tag}),
  cd{tag} AS (SELECT DISTINCT doc_id, ord, q FROM cv{tag}),
  rn{tag} AS (SELECT doc_id, ord, count(*) AS len FROM (SELECT *, q - row_number() OVER (PARTITION BY doc_id, ord ORDER BY q) AS grp FROM cd{tag}) GROUP BY doc_id, ord, grp),
  sr{tag} AS (SELECT doc_id, ord, o_ord AS src_ord, o_role AS src_role FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY c DESC, p) AS k FROM (
      SELECT doc_id, ord, o_ord, o_role, count(*) AS c, min(pos) AS p FROM h{tag} GROUP BY 1, 2, 3, 4)) WHERE k = 1),
  rw{tag} AS (SELECT u.doc_id, u.ord, u.sec, u.role, len(toks) AS n_tokens, covered, longest_run, src_ord, src_role, covered / len(toks)::DOUBLE AS r,
      len(toks) >= 8 AS eligible, len(toks) >= 8 AND covered / len(toks)::DOUBLE >= 0.5 AS recycled
    FROM u JOIN (SELECT doc_id, ord, CAST(sum(len) AS BIGINT) AS covered, max(len) AS longest_run FROM rn{tag} GROUP BY 1, 2) USING (doc_id, ord) JOIN sr{tag} USING (doc_id, ord))"""


# --- LaTeX: every document wrapped as a paper, the same template in both dialects -------------

_TITLES = "['Introduction', 'Related Work', 'Method', 'Experiments', 'Discussion and Limitations', 'Conclusion', 'Proofs and Details']"

# {i} zero-based line number, {k} section number, {l} the line, {title} its section title; ¤ stands for a backslash
_TEX_LINE = """
  CASE WHEN {i} = 0 THEN '¤begin{{abstract}}' || {l} || '¤end{{abstract}}' || chr(10) || chr(10) ELSE
    CASE WHEN {i} % 3 = 1 AND {k} = 6 AND doc_id % 2 = 0 THEN '¤appendix' || chr(10) ELSE '' END ||
    CASE WHEN {i} % 3 = 1 THEN '¤section' || CASE WHEN {k} % 7 = 4 THEN '*' ELSE '' END || '{{' || {title} || '}}'
         || CASE WHEN {k} % 5 <> 3 THEN '¤label{{sec:' || {k} || '}}' ELSE '' END || chr(10)
         WHEN {i} % 6 = 2 THEN '¤subsection{{' || CASE WHEN ({i} + doc_id) % 5 = 0 THEN 'Error Analysis ' ELSE 'Part ' END || {i} || '}}¤label{{sub:' || {i} || '}}' || chr(10) ELSE '' END ||
    {l} ||
    CASE WHEN {i} % 2 = 0 THEN ' As in Section~¤ref{{sec:' || (({i} + doc_id) % 9) || '}}, see Table ¤ref{{tab:' || ({i} % 6) || '}} ¤cite{{key' || ({i} % 5) || ', key' || (doc_id % 7) || '}}.'
         WHEN {i} % 4 = 3 THEN ' See Sections ' || ({i} % 5 + 1) || ' and ' || ({i} % 3 + 1) || ' for the method. This was shown in the previous section, and proofs are in the Method section.'
         ELSE ' Unlike ¤citet{{key' || (({i} + doc_id) % 11) || '}}, we use ¤cite{{key1}}. % note 5¤% done' || chr(10) END ||
    CASE WHEN {i} % 5 = 4 THEN chr(10) || '¤begin{{table}}¤caption{{Accuracy results of case ' || {i} || '. Overview of failure case tests, higher is better}}¤label{{tab:' || {i} || '}}'
         || '¤begin{{tabular}}{{lcc}} Model & Acc & Loss ¤¤ A & ' || length({l}) || '.' || (doc_id % 10) || ' ¤pm 0.4 & 1,234 ¤¤ B & ¤textbf{{' || (doc_id % 50) || '.5}} & n/a ¤¤ ¤end{{tabular}}¤end{{table}}' || chr(10) ELSE '' END ||
    CASE WHEN {i} % 7 = 5 THEN chr(10) || '¤begin{{equation}} a = b ¤label{{eq:' || {i} || '}}¤end{{equation}}' || chr(10) ELSE '' END ||
    CASE WHEN {i} % 11 = 7 AND doc_id % 3 = 0 THEN chr(10) || '¤begin{{quote}} shown text ¤end{{quote}}' || chr(10) ELSE '' END ||
    CASE WHEN {i} % 2 = 0 THEN chr(10) || chr(10) ELSE chr(10) END
  END"""
_TEX_HEAD = "'¤documentclass{{article}}' || chr(10) || '¤begin{{document}}' || chr(10) || "
_TEX_TAIL = " || '¤bibliography{{refs}}' || chr(10) || '¤end{{document}}' || chr(10)"


def tex_docs(t) -> DataFrame:
    """doc_id, tex."""
    line = _TEX_LINE.format(i="i", l="l", k="((i - 1) div 3)", title=f"get(array({_TITLES[1:-1]}), cast(((i - 1) div 3) % 7 as int))")
    lines = r"filter(split(text, '\n'), x -> x <> '')"
    expr = f"replace({_TEX_HEAD.format()} array_join(transform({lines}, (l, i) -> {line}), ''){_TEX_TAIL.format()}, '¤', chr(92))"
    return t.documents.select("doc_id", F.expr(expr).alias("tex"))


TEX = "tx AS (SELECT doc_id, replace({head} array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda l, j: {line}), ''){tail}, '¤', chr(92)) AS tex FROM documents)".format(
    head=_TEX_HEAD.format(), tail=_TEX_TAIL.format(),
    line=_TEX_LINE.format(i="(j - 1)", l="l", k="((j - 2) // 3)", title=f"({_TITLES})[((j - 2) // 3) % 7 + 1]"))
