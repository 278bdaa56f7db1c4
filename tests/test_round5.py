"""Queries against their SQL on odd rows: texts without lines, rows without a key; bootstraps against all pairs of every replicate."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkstat.operators import matching, postings, resample
from inkstat.plans import statistics
from inkstat.plans.registry import Tables


def both(spark, name, folder, **tables):
    """Sorted rows of a query and of its SQL over tables given as (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=str)
    return sorted((tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect()), key=str), want


def test_a_text_without_lines_has_no_transcript_score(spark, tmp_path):
    texts = [(1, "Legend one\ntwo"), (2, ""), (3, "\n\n"), (4, None), (5, "plain"), (8, "preprint")]
    got, want = both(spark, "c25_latest_transcript_score", tmp_path, documents=(texts, "doc_id long, text string"))
    assert got == want and dict(want)[1] == 0.4 and [dict(want)[k] for k in (2, 3, 4, 8)] == [None] * 4


def test_lines_without_a_key_are_findings_too(spark, tmp_path):
    lines = [(1, 5, 2, "A"), (1, 9, 1, "A"), (1, 4, 1, "A"), (1, 3, 1, "N"), (None, 8, 1, "A"), (None, 7, 3, "A"), (None, 6, 2, "A"), (2, None, 1, "A"), (2, 5, 1, "A"), (2, 1, 4, None)]
    got, want = both(spark, "i8_findings_list", tmp_path, lineitem=(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string"))
    assert got == want and sum(r[0] is None for r in got) == 2 and (2, "xsec", 0, 1, "p5", 0) in got


def brute_auroc(rows, replicates):
    """(auroc, low, high) of (key, value, label) rows from all pairs of a replicate, each row as often as it counts."""
    digests = [hashlib.md5(f"{k}:0".encode()).hexdigest() for k, _, _ in rows]
    copies = resample.draws(np.array([int(d[:8], 16) for d in digests]), np.array([int(d[8:16], 16) for d in digests]), replicates)
    value, positive = np.array([v for _, v, _ in rows]), np.array([y == 1 for _, _, y in rows])
    wins = (value[positive][:, None] > value[~positive][None, :]) + 0.5 * (value[positive][:, None] == value[~positive][None, :])
    p, n = copies[positive], copies[~positive]
    drawn = p.sum(axis=0) * n.sum(axis=0)
    found = np.sort((p * (wins @ n)).sum(axis=0)[drawn > 0] / drawn[drawn > 0])
    return wins.mean(), found[len(found) * 25 // 1000], found[max(len(found) * 975 // 1000 - 1, 0)]


def test_auroc_interval_equals_all_pairs_of_every_replicate(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, float(v), int(y)) for g, size, distinct in ((1, 900, 4), (2, 700, 10_000), (3, 3, 2), (4, 600, 1))
            for i, (v, y) in enumerate(zip(rng.integers(0, distinct, size), rng.random(size) < 0.4))] + [(3, 3, -0.0, 1), (3, 4, 0.0, 0), (5, 1, 1.0, 1)]
    df = spark.createDataFrame([*rows, (1, -1, None, 1)], "g long, id long, value double, label int")
    got = {r["g"]: (r["auroc"], r["ci_low"], r["ci_high"]) for r in resample.bootstrap_auroc(df, ["g"], "id", "value", 300).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for g, found in got.items():
        assert found == pytest.approx(brute_auroc([r[1:] for r in rows if r[0] == g], 300))


def test_registered_auroc_interval_has_all_systems_and_replicates(spark):
    folder = "/root/testdata/sf0.001"
    given = {}
    for r in statistics.labelled(Tables(spark, folder)).select("system", "year", "paper_id", "value", "label").collect():
        given.setdefault((r["system"], r["year"]), []).append((r["paper_id"], r["value"], r["label"]))
    got = {(r["system"], r["year"]): (r["auroc"], r["ci_low"], r["ci_high"]) for r in entry.queries()["f12_bootstrap_auroc"](spark, folder).collect()}
    assert {s for s, _ in got} == {"bino", "nts", "agg", "xsec"}
    for k, found in got.items():
        assert found == pytest.approx(brute_auroc(given[k], 1000), abs=2e-6)


@pytest.mark.parametrize("words, chars", [(700_000, 24_000_000), (40, 300)])
def test_packed_postings_give_the_weights_of_all_terms(spark, monkeypatch, words, chars):
    rng = random.Random(5)
    vocabulary = [*(f"w{i}" for i in range(9)), "größe", "Слово", "the", "x_1"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 30, 90]))) for _ in range(60)] + [None, "", "once only"]
    docs = spark.createDataFrame([(i % 47 if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")  # some ids have several texts, some texts none
    some = spark.createDataFrame([("w1",), ("w2 w3",), ("w2 w3",), ("größe",), ("слово w1",), ("none",), ("once",), (None,)], "term string")
    want = {(r["doc_id"], r["term"]): r["w"] for r in matching.tfidf_weights(docs).collect() if r["term"] in ("w1", "w2 w3", "größe", "слово w1")}
    monkeypatch.setattr(postings, "BUCKET_CHARS", chars)
    assert postings.pack_terms(matching.words_by_id(docs), 5, words).where("bucket < 0 or bucket > 4").isEmpty()
    got = postings.weights_of(docs, matching.words_by_id(docs).coalesce(2), some, 2, words).collect()
    assert len(got) == len(want) > 60 and {(r["doc_id"], r["term"]): r["w"] for r in got} == pytest.approx(want, rel=1e-12)


def test_packed_postings_move_fewer_bytes_than_terms(spark):
    rng = random.Random(7)
    texts = [(i, " ".join(f"word{min(int(rng.paretovariate(0.6)), 3000)}" for _ in range(300))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = postings.pack_terms(matching.words_by_id(docs), 4).select(sum(F.length(c) for c in ("terms", "sizes", "ids", "texts", "tfs")).alias("n"))
    counts = matching.term_counts(docs)
    assert rows.agg(F.sum("n")).first()[0] < 8 * counts.count()  # a term of a text was over 16 bytes
