"""Registered queries of review preparation (H) and version analytics (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstat.functions import text as T
from inkstat.operators import reviews as R
from inkstat.operators import stats
from inkstat.operators import versions as V
from inkstat.plans.inputs import RECORDS, TEX, auroc_sql, records, tex_docs
from inkstat.plans.paired import K_B, pair_acc_sql, threshold_sql
from inkstat.plans.registry import query
from inkstat.plans.statistics import BOOT, counted_sql, rank_sql

# --- reviews: the lines of an order are the reviews of a paper --------------------------------


def raw_reviews(t):
    k = F.col("l_linenumber")
    score = F.concat((F.col("l_quantity") % 10 + 1).cast("int").cast("string"), F.lit(": fair"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("paper_id"), k.alias("review_id"), F.when(k % 2 == 0, score).alias("rating"), F.when(k % 2 == 1, score).alias("recommendation"),
        F.when(k % 3 == 0, F.concat(F.col("l_tax").cast("string"), F.lit(" good"))).alias("soundness"), F.when(k % 3 == 1, F.lit("4 excellent")).alias("correctness"), F.lit("n/a 2").alias("novelty"),
        F.when(k % 5 > 0, F.concat(F.lit("Confidence -"), k.cast("string"))).alias("confidence"))


@query("h1_review_normalize", """SELECT l_orderkey AS paper_id, l_linenumber AS review_id, CAST(l_quantity % 10 + 1 AS INT) AS overall, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 3 = 1 THEN 4 ELSE 2 END AS INT) AS soundness,
  CASE WHEN l_linenumber % 5 > 0 THEN -l_linenumber END AS confidence FROM lineitem""")
def h1(t):
    return R.normalize_reviews(raw_reviews(t))


@query("h1_decision_cascade", """SELECT o_orderkey AS paper_id, CASE WHEN k = 0 THEN true WHEN k = 1 THEN false WHEN k = 2 THEN true WHEN k = 3 THEN false WHEN k = 4 THEN NULL ELSE NULL END AS accept,
  CASE WHEN k = 0 THEN 'oral' WHEN k = 2 THEN 'poster' END AS tier FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)""")
def h1b(t):
    k = F.col("o_orderkey") % 6
    d = R.resolve_decision(F.when(k == 0, "Accept (Oral)").when(k == 1, "Reject"), F.when(k == 2, "ICLR 2024 poster").when(k == 3, "Submitted to ICLR 2024").when(k == 5, "arXiv"))
    return t.orders.select(F.col("o_orderkey").alias("paper_id"), d.alias("d")).select("paper_id", "d.accept", "d.tier")


def reviews(t):
    return t.lineitem.select(F.col("l_orderkey").alias("paper_id"), (F.col("l_quantity") % 10 + 1).alias("rating"), (F.col("l_linenumber") % 4 + 1).alias("soundness"), (F.col("l_suppkey") % 5).alias("pred"))


@query("h2_review_aggregates", """SELECT l_orderkey AS paper_id, count(*) AS n_reviews, avg(l_quantity % 10 + 1) AS rating_mean, min(l_quantity % 10 + 1) AS rating_min, max(l_quantity % 10 + 1) AS rating_max, avg(l_linenumber % 4 + 1) AS soundness_mean,
  avg(l_suppkey % 5) AS class_mean, avg((l_suppkey % 5 >= 1)::INT) AS share_any, avg((l_suppkey % 5 = 4)::INT) AS share_top FROM lineitem GROUP BY 1""", "rating_mean rating_min rating_max soundness_mean class_mean share_any share_top")
def h2(t):
    return R.review_aggregates(reviews(t), ["soundness"], "pred")


@query("h3_accepted_join", "SELECT o_orderkey AS paper_id, o_orderpriority = '1-URGENT' AS accept, CASE WHEN o_orderpriority = '1-URGENT' THEN 'oral' ELSE 'reject' END AS tier FROM orders")
def h3(t):
    accepted = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("paper_id"), F.lit("oral").alias("tier"))
    return R.join_decisions(t.orders.select(F.col("o_orderkey").alias("paper_id")), accepted)


@query("h4_decision_groups", """SELECT p, five, CASE WHEN five IN ('poster', 'spotlight') THEN 'accept' ELSE five END AS four, count(*) AS n FROM (SELECT o_orderpriority AS p, CASE WHEN o_orderstatus = 'P' THEN 'undecided' WHEN o_orderpriority LIKE '5%' THEN 'reject' WHEN o_orderpriority LIKE '1%' THEN 'oral' WHEN o_orderpriority LIKE '2%' THEN 'spotlight' ELSE 'poster' END AS five FROM orders) GROUP BY 1, 2, 3""")
def h4(t):
    pr = F.substring("o_orderpriority", 1, 1)
    accept = F.when(F.col("o_orderstatus") != "P", pr != "5")
    five, four = R.decision_group(accept, F.when(pr == "1", "oral").when(pr == "2", "notable").otherwise("poster"))
    return t.orders.select(F.col("o_orderpriority").alias("p"), five.alias("five"), four.alias("four")).groupBy("p", "five", "four").agg(F.count(F.lit(1)).alias("n"))


@query("h5_score_strata", f"WITH {RECORDS} SELECT greatest(1, least(10, CAST(round_even(rating, 0) AS INT))) AS stratum, count(*) AS n FROM rec GROUP BY 1")
def h5(t):
    return records(t).groupBy(R.score_stratum(F.col("rating")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("h6_quota_sample", """WITH h AS (SELECT o_orderpriority AS s, count(*) FILTER (o_orderkey % 1000 = 0) AS have FROM orders GROUP BY 1)
  SELECT s AS stratum, o_orderkey AS paper_id FROM (SELECT o_orderpriority AS s, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders WHERE o_orderkey % 1000 <> 0) JOIN h USING (s) WHERE p <= 20 - have""")
def h6(t):
    o = t.orders.select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderkey").alias("paper_id"))
    return R.quota_sample(o.where("paper_id % 1000 <> 0"), "stratum", "paper_id", 20, o.where("paper_id % 1000 = 0")).select("stratum", "paper_id")


BAND_SQL = "CASE WHEN fraction_ai = 0 THEN 0 WHEN fraction_ai <= 0.05 THEN 1 WHEN fraction_ai <= 0.25 THEN 2 WHEN fraction_ai <= 0.5 THEN 3 WHEN fraction_ai <= 0.639 THEN 4 ELSE 5 END"


@query("h7_band_class_sample", f"""WITH {RECORDS} SELECT band, accept, paper_id FROM (SELECT {BAND_SQL} AS band, accept, paper_id, row_number() OVER (PARTITION BY {BAND_SQL}, accept ORDER BY paper_id % 3 = 0, paper_id) AS p FROM rec) WHERE p <= 10""")
def h7(t):
    rows = records(t).withColumn("known_id", F.when(F.col("paper_id") % 3 != 0, F.lit("id")))
    return R.band_class_sample(rows, 20).select("band", "accept", "paper_id")


HASH = "CAST('0x' || substr(md5({k} || ':0'), 1, 8) AS BIGINT)"


@query("h8_bin_sample", f"""WITH {RECORDS}, b AS (SELECT paper_id, round_even(rating * 2, 0) / 2 AS bin FROM rec)
  SELECT bin, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {HASH.format(k='paper_id')}, paper_id) AS p, count(*) OVER (PARTITION BY bin) AS n FROM b) WHERE n >= 12 AND p <= 40""", "bin")
def h8(t):
    return R.bin_sample(records(t), 40).select("bin", "paper_id")


@query("h9_top_up", f"""WITH {RECORDS}, d AS (SELECT * FROM rec WHERE paper_id % 200 = 7), h AS (SELECT year, grp, count(*) AS have FROM d GROUP BY 1, 2), r AS (SELECT * FROM rec WHERE paper_id % 200 <> 7)
  SELECT year, grp, paper_id FROM (SELECT r.year, r.grp, paper_id, coalesce(have, 0) AS have, row_number() OVER (PARTITION BY r.year, r.grp ORDER BY {HASH.format(k='paper_id')}, paper_id) AS p FROM r LEFT JOIN h ON h.year = r.year AND h.grp = r.grp) WHERE p <= greatest(0, 15 - have)""")
def h9(t):
    rows = records(t).select("year", "grp", "paper_id")
    return R.top_up(rows, rows.where("paper_id % 200 = 7"), ["year", "grp"], "paper_id", 15).select("year", "grp", "paper_id")


@query("h10_round_robin", f"""WITH q AS (SELECT o_orderkey AS paper_id, o_orderpriority AS bucket FROM orders), f AS (SELECT * FROM q WHERE paper_id IN (3, 11)),
  r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {HASH.format(k='paper_id')}, paper_id) AS turn FROM q ANTI JOIN f USING (paper_id))
  SELECT paper_id, bucket FROM f UNION ALL (SELECT paper_id, bucket FROM r ORDER BY turn, bucket LIMIT 28)""")
def h10(t):
    rows = t.orders.select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("bucket"))
    return R.round_robin(rows, "bucket", "paper_id", 30, rows.where("paper_id IN (3, 11)"))


@query("h16_replacement_quota", f"""WITH {RECORDS}, a AS (SELECT year, accept, count(*) FILTER (paper_id % 9 = 0) AS retired, count(*) FILTER (paper_id % 11 = 0) AS replaced FROM rec WHERE paper_id % 9 = 0 OR paper_id % 11 = 0 GROUP BY 1, 2)
  SELECT *, greatest(0, retired - replaced) AS need FROM a""")
def h16(t):
    r = records(t)
    return R.replacement_quota(r.where("paper_id % 9 = 0"), r.where("paper_id % 11 = 0"), ["year", "accept"])



def rules():
    return {"words<1500": F.col("n_words") < 1500, "no_xsec": F.col("xsec").isNull(), "low_score": F.col("agg") < 0.05}


@query("h11_quality_flags", f"""WITH {RECORDS}, f AS (SELECT unnest(list_filter([CASE WHEN n_words < 1500 THEN 'words<1500' END, CASE WHEN xsec IS NULL THEN 'no_xsec' END, CASE WHEN agg < 0.05 THEN 'low_score' END], lambda x: x IS NOT NULL)) AS flag FROM rec)
  SELECT flag, count(*) AS n FROM f GROUP BY 1""")
def h11(t):
    return R.quality_flags(records(t), rules())[0]


@query("h11_excluded_ids", f"WITH {RECORDS} SELECT paper_id FROM rec WHERE n_words < 1500 OR xsec IS NULL OR agg < 0.05")
def h11b(t):
    return R.quality_flags(records(t), rules())[1].select("paper_id")


@query("h12_length_trim", f"""WITH {RECORDS}, q AS (SELECT quantile_cont(n_words::DOUBLE, 0.01) AS lo, quantile_cont(n_words::DOUBLE, 0.99) AS hi FROM rec) SELECT paper_id, n_words FROM rec, q WHERE n_words BETWEEN lo AND hi AND paper_id % 6 >= 3""")
def h12(t):
    return R.length_trim(records(t).withColumn("n_reviews", F.col("paper_id") % 6)).select("paper_id", "n_words")


@query("h13_strata_keys", f"""WITH {RECORDS}, s AS (SELECT year || '/' || CASE WHEN domain IN ('BUILDING', 'MACHINERY') THEN 'cs' ELSE 'other' END AS stratum, CASE WHEN round_even(rating, 0) <= 3 THEN '<=3' WHEN round_even(rating, 0) >= 8 THEN '>=8' ELSE CAST(CAST(round_even(rating, 0) AS INT) AS VARCHAR) END AS band FROM rec)
  SELECT stratum, band, count(*) AS n FROM s GROUP BY 1, 2""")
def h13(t):
    domain = F.when(F.col("domain").isin("BUILDING", "MACHINERY"), "cs").otherwise("other")
    return R.strata_keys(records(t), domain).groupBy("stratum", "band").agg(F.count(F.lit(1)).alias("n"))


@query("h14_authorship_report", f"WITH {RECORDS} SELECT {BAND_SQL} AS band, count(*) AS n, count(*) / (SELECT count(*) FROM rec)::DOUBLE AS share, avg(accept::INT) AS accept_rate, avg(rating) AS mean_rating, stddev_samp(rating) AS sd_rating FROM rec GROUP BY 1", "share accept_rate mean_rating sd_rating")
def h14(t):
    return R.authorship_report(records(t))


@query("h14_accept_gap_at_rating", f"""WITH {RECORDS} SELECT round_even(rating * 2, 0) / 2 AS level, count(*) FILTER (fraction_ai = 0) AS n_zero, count(*) FILTER (fraction_ai <> 0) AS n_rest, avg(accept::INT) FILTER (fraction_ai = 0) - avg(accept::INT) FILTER (fraction_ai <> 0) AS gap
  FROM rec GROUP BY 1 HAVING count(*) FILTER (fraction_ai = 0) >= 5 AND count(*) FILTER (fraction_ai <> 0) >= 5""", "level gap")
def h14b(t):
    return R.accept_gap_at_rating(records(t), 5)


@query("h14_rating_trend", f"WITH {RECORDS} SELECT year, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT year, {rank_sql('fraction_ai', 'year')} AS rx, {rank_sql('rating', 'year')} AS ry FROM rec) GROUP BY year", "rho")
def h14c(t):
    return stats.spearman(records(t), ["year"], "fraction_ai", "rating")


@query("h14_rating_by_class", """SELECT l_suppkey % 5 AS pred, count(*) AS n, avg(l_quantity % 10 + 1) AS mean_rating, stddev_samp(l_quantity % 10 + 1) AS sd_rating FROM lineitem GROUP BY 1""", "mean_rating sd_rating")
def h14d(t):
    return reviews(t).groupBy("pred").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean_rating"), F.stddev_samp("rating").alias("sd_rating"))


@query("h15_score_assembly", """SELECT c_custkey AS paper_id, 'a' AS system, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END AS value FROM customer""", "value")
def h15(t):
    base = t.customer.select(F.col("c_custkey").alias("paper_id"), F.lit("a").alias("system"), F.col("c_acctbal").alias("value"))
    later = base.where("paper_id % 3 = 0").withColumn("value", -F.col("value"))
    return R.assemble_scores([base, later, base.where("paper_id % 7 = 0").withColumn("value", F.lit(None).cast("double"))])


# --- versions: the wrapped paper and an edited copy -------------------------------------------


def edited(t):
    d = F.col("doc_id") % 5
    x = F.col("tex")
    new = (
        F.when(d == 0, F.regexp_replace(x, r"\\cite\{key1\}", "")).when(d == 1, F.regexp_replace(x, "case 4", "case 44")).when(d == 2, F.regexp_replace(x, r"\\label\{sec:0\}", ""))
        .when(d == 3, F.concat(x, F.lit(" and \\cite{key99} closes 7 of 9 cases"))).otherwise(x))
    return tex_docs(t).select("doc_id", new.alias("tex"))


ED = TEX + r""", ty AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(tex, '\cite{key1}', '') WHEN 1 THEN replace(tex, 'case 4', 'case 44') WHEN 2 THEN replace(tex, '\label{sec:0}', '')
    WHEN 3 THEN tex || ' and \cite{key99} closes 7 of 9 cases' ELSE tex END AS tex FROM tx)"""


def facts_sql(src: str, tag: str) -> str:
    def keys(p):
        return rf"list_sort(list_distinct(list_filter(list_transform(string_split(array_to_string(regexp_extract_all(tex, '{p}', 1), ','), ','), lambda x: trim(x)), lambda x: x <> '')))"
    return rf"""SELECT doc_id, {keys(r'\\cite[A-Za-z]*\*?\s*(?:\[[^\]]*\]\s*)*\{([^}]*)\}')} AS cites{tag}, list_sort(list_distinct(regexp_extract_all(tex, '\\label\{{([^}}]*)\}}', 1))) AS labels{tag},
      {keys(r'\\(?:ref|eqref|autoref|Cref|cref|pageref)\*?\{([^}]*)\}')} AS refs{tag}, len(list_filter(regexp_split_to_array(tex, '\s+'), lambda w: w <> '')) AS words{tag} FROM {src}"""


BIB = "['key0', 'key1', 'key2', 'key3', 'key4', 'key5', 'key6', 'key7', 'key8', 'key9']"
DIFF = "list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
GD = ED + f""", fa AS ({facts_sql('tx', '')}), fb AS ({facts_sql('ty', '1')}), j AS (SELECT * FROM fa JOIN fb USING (doc_id)),
  gd AS (SELECT doc_id, {DIFF.format(a='cites', b='cites1')} AS cites_removed, {DIFF.format(a='cites1', b='cites')} AS cites_added,
    list_filter(cites1, lambda x: NOT list_contains({BIB}, x) AND NOT list_contains(cites, x)) AS dangling_new,
    {DIFF.format(a='labels', b='labels1')} AS labels_removed, {DIFF.format(a='refs1', b='labels1')} AS refs_undefined, words1 / greatest(1, words)::DOUBLE AS word_ratio FROM j),
  nb AS (SELECT doc_id, v, number, count(*) AS n FROM (SELECT doc_id, v, unnest(regexp_extract_all(regexp_replace(' ' || regexp_replace(regexp_replace(regexp_replace(tex, '(^|[^\\\\])%[^\\n]*', '\\1', 'g'), {"'" + V.COMMANDS.replace("'", "''") + "'"}, ' ', 'g'), '([^0-9.%])', '\\1 ', 'g') || ' ', '([A-Za-z_.\\-]) (\\d)', '\\1\\2', 'g'), '[ ](\\d+(?:\\.\\d+)?%?) ', 1)) AS number
    FROM (SELECT doc_id, 0 AS v, tex FROM tx UNION ALL SELECT doc_id, 1, tex FROM ty)) GROUP BY 1, 2, 3)"""


def guards(t):
    bib = t.documents.select("doc_id", F.array(*[F.lit(f"key{i}") for i in range(10)]).alias("bib_keys"))
    return V.set_guards(V.version_facts(tex_docs(t)), V.version_facts(edited(t)), bib)


LISTS = ["cites_removed", "cites_added", "dangling_new", "labels_removed", "refs_undefined"]


@query("i1_set_guards", f"WITH {GD} SELECT doc_id, {', '.join(f'''array_to_string({c}, ' ') AS {c}''' for c in LISTS)}, word_ratio FROM gd", "word_ratio")
def i1(t):
    return guards(t).select("doc_id", *[F.array_join(c, " ").alias(c) for c in LISTS], "word_ratio")


@query("i2_number_guard")
def i2(t):
    return V.number_guard(V.number_counts(tex_docs(t)), V.number_counts(edited(t)))


@query("i2_number_guard_orders", """WITH a AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 13 AS VARCHAR) AS number, count(*) FILTER (o_orderstatus <> 'P') AS n, count(*) FILTER (o_orderstatus <> 'F') AS m FROM orders GROUP BY 1, 2)
  SELECT doc_id, count(*) FILTER (m = 0) AS n_lost, count(*) FILTER (n = 0) AS n_added, count(*) FILTER (m < n AND n >= 2) AS n_thinned FROM a GROUP BY 1""")
def i2b(t):
    rows = t.orders.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 13).cast("string").alias("number"), "o_orderstatus")
    count = lambda cond: rows.where(cond).groupBy("doc_id", "number").agg(F.count(F.lit(1)).alias("n"))
    return V.number_guard(count("o_orderstatus <> 'P'"), count("o_orderstatus <> 'F'"))


@query("i3_violations", f"""WITH {GD} SELECT doc_id, concat_ws(' ', CASE WHEN len(cites_removed) > 0 THEN 'cited_works_removed' END, CASE WHEN len(cites_added) > 0 THEN 'cited_works_added' END, CASE WHEN len(dangling_new) > 0 THEN 'dangling_cites' END,
    CASE WHEN len(refs_undefined) > 0 THEN 'refs_undefined' END, CASE WHEN word_ratio NOT BETWEEN 0.8 AND 1.25 THEN 'word_ratio' END) AS violations, CASE WHEN len(labels_removed) > 0 THEN 'labels_removed' ELSE '' END AS soft_flags FROM gd""")
def i3(t):
    none = t.documents.select("doc_id", *[F.lit(0).cast("bigint").alias(c) for c in ("n_lost", "n_added", "n_thinned")])
    v = V.violations(guards(t), none)
    return v.select("doc_id", F.array_join("violations", " ").alias("violations"), F.array_join("soft_flags", " ").alias("soft_flags"))


# --- rounds: events of a user are the rounds of a revised paper -------------------------------


def scores(t):
    e = F.col("event_id")
    return t.events.groupBy(F.col("event_type").alias("arm"), F.col("user_id").alias("code"), (e % 4).cast("int").alias("round"), F.concat(F.lit("m"), (e % 3).cast("string")).alias("item")).agg(
        F.max("value").alias("score"), F.count(F.lit(1)).alias("denominator"))


SC = """sc AS (SELECT event_type AS arm, user_id AS code, CAST(event_id % 4 AS INT) AS round, 'm' || (event_id % 3) AS item, max(value) AS score, count(*) AS denominator FROM events GROUP BY 1, 2, 3, 4),
  z AS (SELECT arm, code, item, score AS s0, denominator AS d0 FROM sc WHERE round = 0), hu AS (SELECT DISTINCT user_id AS code, 'm' || k AS item, ((user_id * 7 + k * 13) % 40)::DOUBLE AS human FROM events, (SELECT unnest([0, 1, 2]) AS k))"""


def human(t):
    users = t.events.select(F.col("user_id").alias("code")).distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return users.select("code", F.concat(F.lit("m"), F.col("k").cast("string")).alias("item"), F.pmod(F.col("code") * 7 + F.col("k") * 13, F.lit(40)).cast("double").alias("human"))


@query("i4_shrinking_denominator", f"WITH {SC} SELECT arm, code, round, item, s0, score, d0, denominator FROM sc JOIN z USING (arm, code, item) WHERE round > 0 AND denominator < d0 AND score < s0", "s0 score")
def i4(t):
    return V.shrinking_denominator(scores(t))


def file_pair(t):
    a = tex_docs(t).select("doc_id", F.lit("main.tex").alias("file"), F.col("tex").alias("text"))
    return a, edited(t).select("doc_id", F.lit("main.tex").alias("file"), F.col("tex").alias("text"))


@query("i5_paragraph_changes")
def i5(t):
    return V.paragraph_changes(*file_pair(t))


@query("i6_apply_verdicts", f"WITH {ED} SELECT doc_id, 'main.tex' AS file, CASE WHEN doc_id % 2 = 0 THEN ty.tex ELSE tx.tex END AS text FROM tx JOIN ty USING (doc_id)")
def i6(t):
    a, b = file_pair(t)
    verdicts = V.paragraph_changes(a, b).withColumn("verdict", F.when(F.col("doc_id") % 2 == 0, "keep").otherwise("revert"))
    return V.apply_verdicts(a, b, verdicts).select("doc_id", "file", "text")


@query("i7_retired_suppression", """WITH u AS (SELECT doc_id, 'Section "' || substr(text, 1, 40) || '" is rarely used elsewhere' AS unit FROM documents), r AS (SELECT doc_id, 'section "' || substr(text, 1, 40) || '" is rarely used elsewhere in it' AS k FROM documents WHERE doc_id % 3 = 0)
  SELECT u.* FROM u WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def i7(t):
    quoted = F.concat(F.lit('Section "'), F.substring("text", 1, 40), F.lit('" is rarely used elsewhere'))
    units = t.documents.select("doc_id", quoted.alias("unit"))
    retired = t.documents.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("- "), quoted, F.lit(" in it"))).otherwise("figure 2 may stay").alias("instance"))
    return V.drop_retired(units, retired)


@query("i8_findings_list", """WITH u AS (SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'A' THEN 'xsec' WHEN 'N' THEN 'macro' ELSE 'citation' END AS measure, l_linenumber * 100000 + l_partkey AS ord, 'p' || l_partkey AS unit FROM lineitem),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, measure ORDER BY ord) AS p, count(*) OVER (PARTITION BY doc_id, measure) AS c FROM u)
  SELECT doc_id, measure, CAST(CASE measure WHEN 'xsec' THEN 0 WHEN 'macro' THEN 1 ELSE 2 END AS INT) AS measure_order, CAST(p AS INT) AS position, unit, greatest(0, c - 2) AS n_more FROM n WHERE p <= 2""")
def i8(t):
    m = F.when(F.col("l_returnflag") == "A", "xsec").when(F.col("l_returnflag") == "N", "macro").otherwise("citation")
    units = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), m.alias("measure"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"), F.concat(F.lit("p"), F.col("l_partkey")).alias("unit"))
    return V.findings(units, ["xsec", "macro", "citation"], 2)


@query("i9_edit_size", f"""WITH {ED}, l AS (SELECT doc_id, doc_id % 5 AS d, tex, string_split(rtrim(tex, chr(10)), chr(10)) AS a FROM tx), c AS (SELECT doc_id, len(a) AS lines, CASE d WHEN 0 THEN len(list_filter(a, lambda x: contains(x, '\\cite{{key1}}'))) WHEN 1 THEN len(list_filter(a, lambda x: contains(x, 'case 4')))
    WHEN 2 THEN len(list_filter(a, lambda x: contains(x, '\\label{{sec:0}}'))) ELSE 0 END AS m, CASE d WHEN 3 THEN 1 ELSE 0 END AS extra FROM l)
  SELECT doc_id, CAST(m + extra AS BIGINT) AS lines_added, CAST(m AS BIGINT) AS lines_removed FROM c""")
def i9(t):
    return V.edit_size(*file_pair(t)).select("doc_id", "lines_added", "lines_removed")


@query("i10_latest_records", """SELECT user_id AS code, round, ts, event_id, event_type AS exec, value FROM (SELECT *, CAST(event_id % 4 AS INT) AS round, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def i10(t):
    log = t.events.select(F.col("user_id").alias("code"), (F.col("event_id") % 4).cast("int").alias("round"), "ts", "event_id", F.col("event_type").alias("exec"), "value")
    return V.latest_records(log, ["code", "round"], "ts", "event_id")


EFF = SC + """, p AS (SELECT sc.*, s0, d0, human, score - s0 AS diff FROM sc JOIN z USING (arm, code, item) LEFT JOIN hu USING (code, item) WHERE round > 0), """ + counted_sql("p", "arm, round, item, diff", "code") + f""",
  ci AS (SELECT arm, round, item, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (SELECT arm, round, item, rep, sum(diff * k) / nullif(sum(k), 0)::DOUBLE AS m FROM bd GROUP BY ALL) GROUP BY ALL),
  wr AS (SELECT arm, round, item, diff, {rank_sql('abs(diff)', 'arm, round, item')} AS r FROM p WHERE diff <> 0),
  wk AS (SELECT arm, round, item, sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT arm, round, item, abs(diff) AS a, count(*) AS c FROM wr GROUP BY ALL) GROUP BY ALL),
  ws AS (SELECT arm, round, item, count(*) AS n, least(coalesce(sum(r) FILTER (diff > 0), 0), coalesce(sum(r) FILTER (diff < 0), 0)) AS w FROM wr GROUP BY ALL)"""


@query("i11_effects", f"""WITH {EFF} SELECT p.arm, p.round, p.item, count(*) AS n, avg(s0) AS mean_r0, avg(score) AS mean_rn, avg(diff) AS mean_diff, count(*) FILTER (diff < 0) AS n_decreased, count(*) FILTER (diff > 0) AS n_increased,
    count(*) FILTER (diff < 0 AND denominator < d0) AS n_masked, avg(denominator / d0::DOUBLE) AS denominator_ratio, count(*) FILTER (score <= human) AS n_at_or_below_human, count(*) FILTER (s0 <= human) AS n_at_or_below_human_r0,
    max(ci_low) AS ci_low, max(ci_high) AS ci_high, max(w) AS wilcoxon_w, max((w - ws.n * (ws.n + 1) / 4.0::DOUBLE) / sqrt(ws.n * (ws.n + 1.0::DOUBLE) * (2 * ws.n + 1) / 24 - ties / 48)) AS wilcoxon_z
  FROM p JOIN ci USING (arm, round, item) LEFT JOIN ws ON ws.arm = p.arm AND ws.round = p.round AND ws.item = p.item AND ws.n >= 5 LEFT JOIN wk ON wk.arm = p.arm AND wk.round = p.round AND wk.item = p.item GROUP BY 1, 2, 3""",
       "mean_r0 mean_rn mean_diff denominator_ratio ci_low ci_high wilcoxon_w wilcoxon_z")
def i11(t):
    return V.effects(scores(t), human(t), BOOT)


@query("i12_interactions", f"""WITH {SC}, d AS (SELECT sc.arm, sc.code, sc.item, CASE sc.arm WHEN 'click' THEN 'm0' WHEN 'view' THEN 'm1' ELSE 'm2' END AS target, s0, score - s0 AS diff FROM sc JOIN z USING (arm, code, item) WHERE round = 1),
  g AS (SELECT arm, code, s0 AS t0, diff AS tdiff FROM d WHERE item = target)
  SELECT d.arm, target, item, count(*) AS n, avg(diff) AS mean_diff, count(*) FILTER (diff > 0) AS n_increased, count(*) FILTER (diff < 0) AS n_decreased, avg(diff) FILTER (t0 > 0) AS mean_diff_defect, count(*) FILTER (t0 > 0) AS n_defect,
    count(*) FILTER (tdiff < 0 AND diff > 0 AND item <> target) AS n_target_down_item_up FROM d LEFT JOIN g ON g.arm = d.arm AND g.code = d.code GROUP BY 1, 2, 3""", "mean_diff mean_diff_defect")
def i12(t):
    target = F.when(F.col("arm") == "click", "m0").when(F.col("arm") == "view", "m1").otherwise("m2")
    return V.interactions(scores(t).withColumn("target", target))


@query("i13_complete_cases", """WITH d AS (SELECT DISTINCT user_id AS code, event_id // 4 % 2 AS arm, event_id % 4 AS round FROM events WHERE event_type IN ('view', 'click') AND event_id % 4 IN (1, 2, 3)) SELECT code FROM d GROUP BY 1 HAVING count(*) = 6""")
def i13(t):
    p = t.events.select(F.col("user_id").alias("code"), F.pmod(F.floor(F.col("event_id") / 4), F.lit(2)).alias("arm"), (F.col("event_id") % 4).cast("int").alias("round"), F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "nothing_to_fix").otherwise("failed").alias("exec"))
    return V.complete_cases(p, 2, [1, 2, 3])


@query("i14_carry_forward", f"""WITH {SC}, k AS (SELECT DISTINCT arm, code, item FROM sc), s AS (SELECT *, CAST(unnest(range(4)) AS INT) AS round FROM k)
  SELECT arm, code, item, round, last_value(score IGNORE NULLS) OVER (PARTITION BY arm, code, item ORDER BY round) AS score FROM s LEFT JOIN sc USING (arm, code, item, round)""", "score")
def i14(t):
    return V.carry_forward(scores(t), [0, 1, 2, 3])


@query("i15_distance_to_human", f"""WITH {SC}, h AS (SELECT item, avg(human) AS human_mean FROM hu GROUP BY 1), d AS (SELECT arm, round, item, avg(score) AS mean, max(human_mean) AS human_mean, abs(avg(score) - max(human_mean)) AS distance FROM sc JOIN h USING (item) GROUP BY 1, 2, 3)
  SELECT *, sum(distance) OVER (PARTITION BY arm, round) AS total FROM d""", "mean human_mean distance total")
def i15(t):
    return V.distance_to_human(scores(t), human(t))


@query("i16_guard_breaks", """WITH w AS (SELECT event_id % 3 AS arm, user_id AS code, event_id % 4 AS round, min(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 END) AS worst FROM events GROUP BY 1, 2, 3), t AS (SELECT arm, count(*) AS n_rounds FROM w GROUP BY 1)
  SELECT arm, CAST(worst AS INT) AS worst, count(*) AS n, max(n_rounds) AS n_rounds, count(*) / max(n_rounds)::DOUBLE AS share FROM w JOIN t USING (arm) WHERE worst IS NOT NULL GROUP BY 1, 2""", "share")
def i16(t):
    rounds = t.events.select((F.col("event_id") % 3).alias("arm"), F.col("user_id").alias("code"), (F.col("event_id") % 4).alias("round"), F.col("event_type").alias("violation"))
    return V.guard_breaks(rounds, {"error": 0, "purchase": 1, "click": 2})


@query("i17_cost_rollup", """SELECT coalesce(event_type, 'all') AS arm, CASE WHEN grouping(r) = 1 THEN 'all' ELSE CAST(r AS VARCHAR) END AS round, sum(value) AS usd, sum(value) * 2 AS seconds, count(*) AS n FROM (SELECT *, event_id % 4 AS r FROM events) GROUP BY ROLLUP (event_type, r)""", "usd seconds")
def i17(t):
    log = t.events.select(F.col("event_type").alias("arm"), (F.col("event_id") % 4).alias("round"), F.col("value").alias("usd"), (F.col("value") * 2).alias("seconds"))
    return V.cost_rollup(log)


@query("i18_specimen_audit", """WITH l AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), n AS (SELECT doc_id, ord, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS n FROM l), a AS (SELECT * FROM n WHERE length(n) > 0),
  r AS (SELECT DISTINCT doc_id, n FROM n WHERE ord % 3 = 0)
  SELECT doc_id, count(*) AS n_lines, count(r.n) AS n_found, count(r.n) / count(*)::DOUBLE AS share, count(r.n) / count(*)::DOUBLE >= 0.5 AS quoted FROM a LEFT JOIN r USING (doc_id, n) GROUP BY 1""", "share")
def i18(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return V.specimen_audit(lines, lines.where("ord % 3 = 0").select("doc_id", F.upper("line").alias("line")).withColumn("line", F.lower("line")))


@query("i19_repair_targets", """WITH l AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), w AS (SELECT DISTINCT doc_id, ord, unnest(regexp_extract_all(lower(line), '[a-z]{5,}')) AS w FROM l),
  h AS (SELECT o.doc_id, 'first' AS object, 'f' || (s.ord % 3) AS file, s.ord, count(*) AS shared FROM w o JOIN w s ON o.doc_id = s.doc_id AND o.w = s.w WHERE o.ord = 0 AND s.ord % 3 <> 0 GROUP BY ALL HAVING count(*) >= 3)
  SELECT doc_id, object, file, CAST(ord AS INT) AS ord, shared, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, object ORDER BY shared DESC, file, ord) AS position FROM h) WHERE position <= 2""")
def i19(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).withColumn("words", F.regexp_extract_all(F.lower("line"), F.lit("[a-z]{5,}"), F.lit(0)))
    objects = lines.where("ord = 0").select("doc_id", F.lit("first").alias("object"), F.lit("f0").alias("home"), "words")
    return V.repair_targets(objects, lines.select("doc_id", F.concat(F.lit("f"), (F.col("ord") % 3).cast("string")).alias("file"), "ord", "words"))


RV = f"""{SC}, o AS (SELECT arm, round, item, code AS pair_id, 1 AS label, score AS s FROM sc JOIN hu USING (code, item) UNION ALL SELECT arm, round, item, code, 0, human FROM sc JOIN hu USING (code, item))"""
PER = "arm, round, item"


@query("i20_reevaluation", f"""WITH {RV}, th AS ({threshold_sql('o', PER, K_B)}), tp AS (SELECT {PER}, count(*) FILTER (label = 1 AND s > threshold) / count(*) FILTER (label = 1)::DOUBLE AS tpr FROM o JOIN th USING ({PER}) GROUP BY ALL)
  SELECT {PER}, n_pairs, pair_acc, auroc, tpr FROM ({pair_acc_sql('o', PER)}) p JOIN ({auroc_sql('o', PER)}) a USING ({PER}) JOIN tp USING ({PER})""", "pair_acc auroc tpr")
def i20(t):
    revised = scores(t).select("arm", "round", "item", F.col("code").alias("pair_id"), F.col("score").alias("value"))
    fixed = human(t).select("item", F.col("code").alias("pair_id"), F.col("human").alias("value"))
    return V.reevaluate(revised, fixed, ["arm", "round", "item"], ["pair_id", "item"])


@query("i21_single_vs_joint", f"""WITH {SC}, j AS (SELECT a.item, a.score AS a, b.score AS b FROM sc a JOIN sc b USING (code, item) WHERE a.arm = 'click' AND a.round = 1 AND b.arm = 'view' AND b.round = 1)
  SELECT item, count(*) AS n, count(*) FILTER (a < b) AS single_lower, count(*) FILTER (a = b) AS equal, count(*) FILTER (a > b) AS joint_lower FROM j GROUP BY 1""")
def i21(t):
    s = scores(t)
    return V.single_vs_joint(s.where("arm = 'click' AND round = 1"), s.where("arm = 'view' AND round = 1"))


@query("i22_rounds_table", f"""WITH {SC}, w AS (SELECT code, item, max(score) FILTER (round = 0) AS r0, max(score) FILTER (round = 1) AS r1, max(score) FILTER (round = 2) AS r2, arm FROM sc GROUP BY arm, code, item), j AS (SELECT w.*, human FROM w LEFT JOIN hu USING (code, item))
  SELECT arm, CAST(code AS VARCHAR) AS code, item, r0, r1, r2, human FROM j UNION ALL SELECT arm, 'mean', item, avg(r0), avg(r1), avg(r2), avg(human) FROM j GROUP BY arm, item""", "r0 r1 r2 human")
def i22(t):
    return V.rounds_table(scores(t), human(t), [0, 1, 2], ["arm"])


@query("i23_asset_retention", """WITH a AS (SELECT event_type AS arm, user_id AS code, event_id % 4 AS round, event_id % 5 AS asset FROM events), z AS (SELECT DISTINCT arm, code, asset FROM a WHERE round = 0), v AS (SELECT DISTINCT arm, code, round FROM a), h AS (SELECT DISTINCT arm, code, round, asset, 1 AS held FROM a),
  k AS (SELECT z.arm, v.round, held FROM z JOIN v USING (arm, code) LEFT JOIN h ON h.arm = z.arm AND h.code = z.code AND h.round = v.round AND h.asset = z.asset)
  SELECT arm, round, count(*) AS n, count(*) FILTER (held IS NULL) AS n_dropped, avg(coalesce(held, 0)) AS retention FROM k GROUP BY 1, 2""", "retention")
def i23(t):
    return V.asset_retention(t.events.select(F.col("event_type").alias("arm"), F.col("user_id").alias("code"), (F.col("event_id") % 4).alias("round"), (F.col("event_id") % 5).alias("asset")))
