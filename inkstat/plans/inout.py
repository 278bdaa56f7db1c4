"""Registered queries of sources and sinks (A) and of the streaming operators (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstat.functions import text as T
from inkstat.operators import core
from inkstat.plans.inputs import BENCH_LONG, bench_scores
from inkstat.plans.registry import query
from inkstat.sources import io
from inkstat.streaming import incremental as K


@query("a1_parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01'")
def a1(t):
    # declared schema: two columns and the filter reach the scan
    schema = "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_shipdate TIMESTAMP"
    scan = t.spark.read.schema(schema).parquet(f"{t.dir}/lineitem.parquet")
    return scan.where("l_shipdate < '1995-03-01'").select("l_orderkey", "l_linenumber", "l_quantity")


def bench_pairs(t):
    """An order with a customer on each side stands in for a released pair."""
    pairs = t.orders.select(
        F.concat(F.lit("p"), "o_orderkey").alias("pair_id"), (F.col("o_orderkey") % 4).cast("int").alias("sim_tier"), F.when(F.col("o_orderkey") % 3 == 0, "widened").otherwise("cited").alias("pool"),
        F.col("o_custkey").alias("ai_paper_id"), F.pmod(F.col("o_custkey") + 7, F.lit(100)).alias("human_paper_id"))
    papers = t.customer.select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("source"))
    return pairs, papers


ITEMS = """it AS (SELECT 'p' || o_orderkey AS pair_id, CAST(o_orderkey % 4 AS INT) AS sim_tier, CASE WHEN o_orderkey % 3 = 0 THEN 'widened' ELSE 'cited' END AS pool, label, role, paper_id, c_name AS title, c_mktsegment AS source FROM (
    SELECT *, 1 AS label, 'ai' AS role, o_custkey AS paper_id FROM orders UNION ALL SELECT *, 0, 'human', (o_custkey + 7) % 100 FROM orders) JOIN customer ON paper_id = c_custkey)"""


@query("a2_pair_items", f"WITH {ITEMS} SELECT * FROM it")
def a2(t):
    return io.pair_items(*bench_pairs(t))


@query("a3_jsonl_scan", "SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN value END AS score FROM events WHERE event_id % 5 > 0", "score")
def a3(t):
    path = io.scratch(t.spark, "jsonl")
    good = F.to_json(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 > 0, F.col("value").cast("string")).otherwise("None").alias("score")))
    # every fifth line is torn in the middle of its object
    t.events.select(F.when(F.col("event_id") % 5 > 0, good).otherwise(F.expr("substring('{\"id\": 12345', 1, 9)"))).write.text(path)
    rows = io.read_jsonl(t.spark, path, "id BIGINT, score STRING", strict=False)
    return rows.where("id IS NOT NULL").select("id", io.number(F.col("score")).alias("score"))


@query("a4_jsonl_sink", "SELECT event_id, event_type, CASE WHEN event_id % 4 > 0 THEN value END AS value FROM events", "value")
def a4(t):
    path = io.scratch(t.spark, "jsonl-out")
    io.write_jsonl(t.events.select("event_id", "event_type", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("value")), path)
    return io.read_jsonl(t.spark, path, "event_id BIGINT, event_type STRING, value DOUBLE")


@query("a5_csv_scan", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS score, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS grp FROM orders", "score")
def a5(t):
    path = io.scratch(t.spark, "csv")
    k = F.col("o_orderkey")
    raw = t.orders.select(k.cast("string").alias("id"), F.when(k % 6 == 0, "").when(k % 3 == 0, "None").otherwise(F.col("o_totalprice").cast("string")).alias("score"), F.when(k % 4 > 0, F.col("o_orderpriority")).otherwise("None").alias("grp"))
    io.write_csv(raw, path, ["id", "score", "grp"])
    return io.read_csv(t.spark, path, {"id": "bigint", "score": "double", "grp": "string"})


@query("a6_csv_sink", "SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS name FROM part")
def a6(t):
    path = io.scratch(t.spark, "csv-out")
    io.write_csv(t.part.withColumn("name", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))), path, ["p_partkey", "name"])
    return io.read_csv(t.spark, path, {"p_partkey": "bigint", "name": "string"})


@query("a7_parquet_sink", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def a7(t):
    path = io.scratch(t.spark, "parquet")
    io.write_parquet(t.orders.select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    # the status filter prunes partitions of the written table
    return t.spark.read.parquet(path).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@query("a8_pattern_dimension", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'ECON|PROMO') THEN 'cheap' WHEN regexp_matches(p_type, '^STANDARD$') THEN 'plain' ELSE 'Other' END AS kind FROM part")
def a8(t):
    path = io.scratch(t.spark, "tsv")
    # the two rule rows come from the region table, ordered by key
    rules = t.region.where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "cheap").otherwise("plain").alias("role"), F.when(F.col("r_regionkey") == 0, "ECON|PROMO").otherwise("^STANDARD$").alias("pattern"), "r_regionkey")
    rules.orderBy("r_regionkey").select("role", "pattern").coalesce(1).write.option("header", "true").option("sep", "\t").csv(path)
    return t.part.select("p_partkey", T.first_match(F.col("p_type"), io.pattern_dimension(t.spark, path), "Other").alias("kind"))


def source_files(t):
    """Every document as a main file that includes its parts; every fourth part is missing."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    n = F.size(lines)
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.format_string("parts/p%d.tex", i).alias("path"), F.concat(F.get(lines, i), F.lit(" % dropped \\input{parts/p0}")).alias("text")))
    kept = F.filter(parts, lambda p, i: (i % 4) != 3)
    main = F.concat(F.lit("\\documentclass{article}\n% \\input{draft}\n\\begin{document}\n"), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.format_string("\\input{parts/p%d}", i)), "\n"), F.lit("\n\\input{parts/p0}\\end{document}\n"))
    other = F.lit("\\documentclass{standalone}")
    docs = t.documents.where(F.size(F.filter(F.split("text", "\n"), lambda x: x != "")) > 0)
    files = F.concat(kept, F.array(F.struct(F.lit("main.tex").alias("path"), main.alias("text")), F.struct(F.lit("figs/plot.tex").alias("path"), other.alias("text"))))
    return docs.select("doc_id", F.inline(files))


FILES = """fl AS (SELECT doc_id, l, len(l) AS n FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents) WHERE len(l) > 0)"""


@query("a9_source_scan", "SELECT lang AS doc_id, count(DISTINCT doc_id // 100) AS n_files, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY lang")
def a9(t):
    path = io.scratch(t.spark, "sources")
    # one folder per language, one file per hundred document ids, so files grow in number, not in size
    folders = t.documents.select(F.col("lang").alias("d"), F.expr("doc_id div 100").alias("f"), "text")
    files = folders.repartition("d", "f")
    files.write.partitionBy("d", "f").option("lineSep", "\n").text(path)
    read = io.read_sources(t.spark, path, ".txt")
    return read.groupBy(F.regexp_replace("doc_id", "^d=", "").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("text")).alias("chars"))


@query("a10_root_file", f"WITH {FILES} SELECT doc_id, 'main.tex' AS root FROM fl")
def a10(t):
    return io.root_file(source_files(t), 1)


@query("a10_root_file_by_depth", f"WITH {FILES} SELECT doc_id, 'main.tex' AS root FROM fl")
def a10b(t):
    return io.root_file(source_files(t), 2)


@query("a11_include_expansion", f"""WITH {FILES} SELECT doc_id, array_to_string(list_transform(list_filter(range(n), lambda i: i % 4 = 3), lambda i: 'parts/p' || i), ' ') AS missing,
  '\\documentclass{{article}}' || chr(10) || chr(10) || '\\begin{{document}}' || chr(10) || array_to_string(list_transform(range(n), lambda i: CASE WHEN i % 4 = 3 THEN chr(10) || '% MISSING INPUT parts/p' || i || chr(10) ELSE chr(10) || regexp_replace(l[i + 1], '%.*$', '') || CASE WHEN contains(l[i + 1], '%') THEN '' ELSE ' ' END || chr(10) END), chr(10)) || chr(10) || chr(10) || chr(10) || '\\end{{document}}' || chr(10) AS tex FROM fl""")
def a11(t):
    files = source_files(t)
    return io.expand_includes(files, io.root_file(files)).select("doc_id", F.array_join("missing", " ").alias("missing"), "tex")


@query("a12_exclusions", "SELECT doc_id AS paper_id, CASE WHEN toxic = 1 THEN 'toxic' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def a12(t):
    papers = t.documents.select(F.col("doc_id").alias("paper_id"))
    kept, dropped = io.exclude(papers, t.labels.where("toxic = 1").select(F.col("doc_id").alias("paper_id"), F.lit("toxic").alias("reason")))
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(dropped)


@query("a13_review_scalar", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN value + 1 END AS score FROM events", "score")
def a13(t):
    e = F.col("event_id") % 3
    body = F.when(e == 0, F.struct(F.col("value").cast("string").alias("Overall"), F.lit("9").alias("Rating"))).when(e == 1, F.struct(F.lit(None).cast("string").alias("Overall"), (F.col("value") + 1).cast("string").alias("Rating"))).otherwise(
        F.struct(F.lit("Accept").alias("Overall"), F.lit("none").alias("Rating")))
    return t.events.select("event_id", io.review_scalar(F.to_json(F.struct(body.alias("final")))).alias("score"))


@query("a14_release_papers", f"WITH {ITEMS} SELECT paper_id, max(label) AS label, array_to_string(list_sort(list(DISTINCT pair_id)), ' ') AS pair_ids, array_to_string(list_sort(list(DISTINCT source)), '+') AS source FROM it GROUP BY 1")
def a14(t):
    papers = io.dedupe_papers(io.pair_items(*bench_pairs(t)))
    return papers.select("paper_id", "label", F.array_join("pair_ids", " ").alias("pair_ids"), "source")


def release(t):
    items = bench_scores(t).select(F.col("pool").alias("source"), F.col("item_id").alias("paper_id"), "label").distinct()
    return io.wide_scores(items, bench_scores(t).select(F.col("pool").alias("source"), F.col("item_id").alias("paper_id"), "system", "value").where("value > 0.01"), ["quantity", "price", "discount", "tax"])


WIDE = BENCH_LONG + """, wd AS (SELECT pool AS source, item_id AS paper_id, label, max(value) FILTER (system = 'quantity' AND value > 0.01) AS quantity, max(value) FILTER (system = 'price' AND value > 0.01) AS price,
    max(value) FILTER (system = 'discount' AND value > 0.01) AS discount, max(value) FILTER (system = 'tax' AND value > 0.01) AS tax FROM bs GROUP BY 1, 2, 3)"""


@query("a14_release_scores", f"WITH {WIDE} SELECT * FROM wd", "quantity price discount tax")
def a14b(t):
    return release(t)


@query("a15_coverage_snapshot", f"WITH {WIDE} SELECT count(*) AS n_papers, count(quantity) AS quantity, count(price) AS price, count(discount) AS discount, count(tax) AS tax, '2024-01-01' AS stamp FROM wd")
def a15(t):
    return io.coverage_snapshot(release(t), ["quantity", "price", "discount", "tax"], F.lit("2024-01-01"))


@query("a16_wide_export", f"WITH {WIDE} SELECT source, paper_id, label, (quantity + price) / 2 AS st, CASE WHEN discount IS NOT NULL THEN ((quantity + price) / 2 + discount) / 2 END AS agg, tax IS NULL AS tax_missing FROM wd", "st agg")
def a16(t):
    w = release(t)
    st = core.mean_skip(F.col("quantity"), F.col("price"))
    return w.select("source", "paper_id", "label", st.alias("st"), F.when(st.isNotNull() & F.col("discount").isNotNull(), core.mean_skip(st, F.col("discount"))).alias("agg"), F.col("tax").isNull().alias("tax_missing"))


# --- streaming ---------------------------------------------------------------------------------


@query("k1_incremental_scoring", "SELECT doc_id, length(text) AS n_chars_scored FROM documents")
def k1(t):
    base = io.scratch(t.spark, "k1")
    stream = K.table_stream(t.spark, t.dir, "documents")
    score = lambda b: b.select("doc_id", F.length("text").cast("bigint").alias("n_chars_scored"))
    K.score_unseen(stream, "doc_id", score, f"{base}/sink", f"{base}/ckpt")
    return t.spark.read.parquet(f"{base}/sink").select("doc_id", "n_chars_scored")


@query("k2_latest_upsert", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1", "value")
def k2(t):
    base = io.scratch(t.spark, "k2")
    stream = K.table_stream(t.spark, t.dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return K.upsert_latest(stream, ["user_id", "event_type"], "ts", "event_id", f"{base}/sink", f"{base}/ckpt").drop("ts")


@query("k3_coverage_windows", """WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, count(value) AS n_scored FROM events GROUP BY 1, 2)
  SELECT start, start + INTERVAL '6 hours' AS "end", event_type, n, n_scored FROM w WHERE start + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""")
def k3(t):
    base = io.scratch(t.spark, "k3")
    stream = K.table_stream(t.spark, t.dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    K.write_closed_windows(K.coverage_windows(stream, "ts", "event_type", "6 hours", "1 hour"), f"{base}/sink", f"{base}/ckpt")
    return t.spark.read.parquet(f"{base}/sink")
