"""Assignment, neighbours, version comparison, sources and streaming against direct models."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from inkstat.operators import matching, reviews, versions
from inkstat.sources import io
from inkstat.streaming import incremental


def ranked(spark, prefs):
    rows = [(q, c, p, t) for q, cs in prefs.items() for p, (c, t) in enumerate(cs)]
    df = spark.createDataFrame(rows, "query_id long, cand_id long, position int, tier int")
    return df.withColumn("key", F.struct((-F.col("tier")).alias("k1"), F.col("position").alias("k2"), F.col("cand_id").alias("k3")))


def rounds_model(prefs):
    order = {q: sorted(((-t, p, c) for p, (c, t) in enumerate(cs))) for q, cs in prefs.items()}
    taken, won, lost = set(), {}, 0
    while True:
        props = {}
        for q in sorted(set(order) - set(won)):
            free = [k for k in order[q] if k[2] not in taken]
            if free:
                props.setdefault(free[0][2], []).append((free[0], q))
        if not props:
            return won, lost
        for c, ps in props.items():
            ps.sort()
            won[ps[0][1]] = c
            taken.add(c)
            lost += len(ps) - 1


@pytest.mark.parametrize("seed", [1, 2])
def test_assignment_equals_round_model(spark, seed):
    rng = random.Random(seed)
    prefs = {q: [(c, rng.randint(1, 3)) for c in rng.sample(range(8), 5)] for q in range(12)}
    assigned, conflicts = matching.assign(ranked(spark, prefs))
    won, lost = rounds_model(prefs)
    got = {r["query_id"]: r["cand_id"] for r in assigned.collect()}
    assert got == won and len(set(got.values())) == len(got) and conflicts.count() == lost


def test_reserved_candidates_are_never_given(spark):
    assigned, _ = matching.assign(ranked(spark, {1: [(5, 3), (6, 2)]}), spark.createDataFrame([(5,)], "cand_id long"))
    assert [(r["query_id"], r["cand_id"]) for r in assigned.collect()] == [(1, 6)]


def test_serial_assignment_and_spread(spark):
    rng = random.Random(4)
    prefs = {q: [(c, 1) for c in rng.sample(range(6), 4)] for q in range(9)}
    df = ranked(spark, prefs)
    taken, want, picks = {}, {}, {}
    for q in sorted(prefs):
        free = [c for c, _ in prefs[q] if c not in taken]
        picks[q] = free[:3]
        if free:
            taken[free[0]] = q
            want[q] = free[0]
    assert {r["query_id"]: r["cand_id"] for r in matching.serial_assign(df).collect()} == want
    got = {}
    for r in matching.spread_shortlist(df, 3).orderBy("query_id", "pick").collect():
        got.setdefault(r["query_id"], []).append(r["cand_id"])
    assert got == {q: p for q, p in picks.items() if p}


def test_fuzzy_titles_match_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(9)]
    titles = [" ".join(rng.sample(vocab, rng.randint(1, 8))) for _ in range(120)]
    a, b = titles[:60], titles[60:]
    df = lambda ts: spark.createDataFrame([(t,) for t in ts], "title string")
    got = {(r["norm"], r["known"]) for r in matching.fuzzy_title_join(df(a), df(b)).collect()}
    want = set()
    for x in set(a):
        for y in set(b):
            p, c = set(x.split()), set(y.split())
            if len(p & c) / len(p | c) >= 0.85 or (len(p) >= 4 and len(p & c) / len(p) >= 0.92):
                want.add((x, y))
    assert got == want


def test_fuzzy_titles_of_many_words_match_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 40))] for _ in range(12)]
    near = lambda ws: [w if rng.random() > 0.05 else f"x{rng.randint(0, 9)}" for w in ws][: max(4, len(ws) - rng.choice([0, 0, 6]))]
    a, b = ([" ".join(near(rng.choice(base))) for _ in range(70)] for _ in range(2))
    df = lambda ts: spark.createDataFrame([(t,) for t in ts], "title string")
    got = {(r["norm"], r["known"]) for r in matching.fuzzy_title_join(df(a), df(b)).collect()}
    sets = lambda x, y: (set(x.split()), set(y.split()))
    ok = lambda p, c: len(p & c) / len(p | c) >= 0.85 or (len(p) >= 4 and len(p & c) / len(p) >= 0.92)
    want = {(x, y) for x in set(a) for y in set(b) if ok(*sets(x, y))}
    assert got == want and 50 < len(want) < len(set(a)) * len(set(b)) / 2


def test_titles_that_share_one_rare_word_do_not_become_pairs(spark):
    side = lambda tag: spark.createDataFrame([(i, ["rare"] + [f"{tag}{i}x{j}" for j in range(11)]) for i in range(60)], "id long, words array<string>")
    assert matching.title_candidates(side("a"), side("b"), 0.85, 0.92).count() == 0
    assert matching.title_candidates(side("a"), side("a"), 0.85, 0.92).count() == 60


def nearest(vec, queries, cands, k):
    want = set()
    for i in queries:
        sims = sorted((-round(sum(vec[i][t] * vec[j].get(t, 0) for t in vec[i]), 9), j) for j in cands if i in vec and j in vec)
        want |= {(i, j, p, -s) for p, (s, j) in enumerate(sims[:k], 1) if s < 0}
    return want


@pytest.mark.parametrize("champions, split, k", [(12, 100_000, 3), (1, 4, 3), (4, 7, 60)])
def test_top_neighbours_equal_all_cosines(spark, champions, split, k):
    rng = random.Random(2 + k)
    common = ["alpha", "beta", "gamma", "größe", "über", "слово"]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.8 else f"rare{rng.randrange(25)}" for _ in range(rng.choice([2, 12, 40]))) for _ in range(70)]
    texts[20:24] = [texts[3]] * 4  # copies tie at the top
    texts[30], texts[31], texts[5] = "", None, "unseen words only"
    w = matching.tfidf_weights(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = matching.top_neighbours(w.where("doc_id < 10"), w.where("doc_id >= 10"), k, champions=champions, split=split)
    vec = {}
    for r in w.collect():
        vec.setdefault(r["doc_id"], {})[r["term"]] = r["w"]
    assert {"größe", "слово", "über größe"} & {t for v in vec.values() for t in v} >= {"größe", "слово"}
    got = {(r["query_id"], r["cand_id"], r["position"], r["sim"]) for r in found.collect()}
    assert got == nearest(vec, range(10), range(10, 70), k)


def test_weights_of_some_terms_equal_those_of_all_and_terms_move_once(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 1, 30, 30]))) for _ in range(60)] + [None]
    docs = spark.createDataFrame([(i % 37, t) for i, t in enumerate(texts)], "doc_id long, text string")  # some ids have two texts
    some = spark.createDataFrame([("w1",), ("w2 w3",), ("w2 w3",), ("none",)], "term string")
    kept = matching.tfidf_weights(docs, only=some)
    got = {(r["doc_id"], r["term"]): r["w"] for r in kept.collect()}
    want = {(r["doc_id"], r["term"]): r["w"] for r in matching.tfidf_weights(docs).collect() if r["term"] in ("w1", "w2 w3")}
    assert got == pytest.approx(want) and len(got) > 20
    plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"[-+] Exchange hashpartitioning\(term#\d+, \d+\), REPARTITION_BY_COL", plan)) == 1


def test_top_neighbours_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, term string, w double")
    one = spark.createDataFrame([(1, "a", 1.0)], "doc_id long, term string, w double")
    assert matching.top_neighbours(none, one).count() == matching.top_neighbours(one, none).count() == 0


def test_human_filter_order(spark):
    rows = [(0.01, None, 2026, "pass", "fraction"), (0.9, None, 2020, "pass", "year<=2024"), (0.9, None, 2026, "fail", "fraction>limit"), (None, None, 2026, "fail", "2025+ unverified"), (None, 0.0, 2026, "pass", "fraction")]
    df = spark.createDataFrame(rows, "a double, b double, y int, v string, w string")
    for r in df.withColumn("x", matching.human_filter(F.col("a"), F.col("b"), F.col("y"))).collect():
        assert (r["x"]["verdict"], r["x"]["by"]) == (r["v"], r["w"])


def test_thinned_number_is_not_lost(spark):
    a = spark.createDataFrame([(1, "gain 5.3 here, 5.3 there, 5.3 again; 12\\% x7 v2.1 \\cite{k9} % 44\n and 8")], "doc_id long, tex string")
    b = spark.createDataFrame([(1, "gain 5.3 here, 5.3 there; 12\\% and 9")], "doc_id long, tex string")
    counts = {r["number"]: r["n"] for r in versions.number_counts(a).collect()}
    assert counts["5.3"] == 3 and "44" not in counts and "9" not in counts and counts["8"] == 1
    g = versions.number_guard(versions.number_counts(a), versions.number_counts(b)).first()
    assert (g["n_lost"], g["n_added"], g["n_thinned"]) == (1, 1, 1)


def test_reverting_changes_rebuilds_paragraphs(spark):
    a = "A one\n\nB two\n\nC three\n\nD four"
    b = "A one\n\nB changed\n\nC three\n\nE new\n\nD four"
    side = lambda t: spark.createDataFrame([(1, "m", t)], "doc_id long, file string, text string")
    ch = versions.paragraph_changes(side(a), side(b)).cache()
    assert sorted(r["op"] for r in ch.collect()) == ["insert", "replace"]
    none = versions.apply_verdicts(side(a), side(b), ch.withColumn("verdict", F.lit("revert"))).first()
    assert none["text"] == a and none["reverted"] == 2
    some = versions.apply_verdicts(side(a), side(b), ch.withColumn("verdict", F.when(F.col("op") == "insert", "keep").otherwise("revert"))).first()
    assert some["text"] == b.replace("B changed", "B two") and (some["kept"], some["reverted"]) == (1, 1)
    size = versions.edit_size(side(a), side(b)).first()
    diff = list(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="", n=1))[2:]
    assert (size["lines_added"], size["lines_removed"]) == (sum(x[0] == "+" for x in diff), sum(x[0] == "-" for x in diff))


def test_a_change_without_a_verdict_is_put_back(spark):
    side = lambda t: spark.createDataFrame([(1, "m", t), (2, "n", t)], "doc_id long, file string, text string")
    a, b = "A one\n\nB two\n\nC three", "A one\n\nB changed\n\nC three\n\nD new"
    ch = versions.paragraph_changes(side(a), side(b)).where("doc_id = 1 AND op = 'replace'").withColumn("verdict", F.lit("keep"))
    got = {r["doc_id"]: r for r in versions.apply_verdicts(side(a), side(b), ch).collect()}
    assert "B changed" in got[1]["text"] and "D new" not in got[1]["text"] and (got[1]["kept"], got[1]["reverted"]) == (1, 1)
    assert got[2]["text"] == a and (got[2]["kept"], got[2]["reverted"]) == (0, 2)


def test_moved_and_repeated_paragraphs_keep_the_other_changes_apart(spark):
    rng = random.Random(3)
    texts = {1: (["M", "A", "B", "C", "D", "E"], ["A", "B2", "C", "D", "E", "M"]), 2: (["A", "R", "B", "R", "C"], ["A", "R", "R", "B", "R", "C2"]), 3: (["R"] * 5, ["R"] * 3 + ["X"] + ["R"] * 2), 4: (["A"], ["B"])}
    for k in range(5, 25):
        a = [rng.choice("ABCDEFGHIJ") for _ in range(rng.randint(1, 12))]
        b = [x for x in rng.sample(a, len(a)) if rng.random() < 0.8] + ["Z"] if k % 2 else [rng.choice("ABCDEFGHIJ") for _ in range(8)]
        texts[k] = (a, b)
    a, b = (spark.createDataFrame([(k, "m", "\n\n".join(v[side])) for k, v in texts.items()], "doc_id long, file string, text string") for side in (0, 1))
    ch = versions.paragraph_changes(a, b).cache()
    rows = {k: [] for k in texts}
    for r in sorted(ch.collect(), key=lambda r: (r["doc_id"], r["i1"], r["j1"])):
        rows[r["doc_id"]].append(r)
    assert [(r["op"], r["original"], r["revised"]) for r in rows[1]] == [("delete", "M", ""), ("replace", "B", "B2"), ("insert", "", "M")]
    assert [(r["op"], r["original"], r["revised"]) for r in rows[2]] == [("insert", "", "R"), ("replace", "C", "C2")]
    assert [(r["op"], r["revised"]) for r in rows[3]] == [("insert", "X")]
    for k, (x, y) in texts.items():
        i = j = 0
        for r in rows[k]:
            assert x[i : r["i1"]] == y[j : r["j1"]] and not set(x[r["i1"] : r["i2"]]) & set(y[r["j1"] : r["j2"]])
            i, j = r["i2"], r["j2"]
        assert x[i:] == y[j:]
    back = versions.apply_verdicts(a, b, ch.limit(0).withColumn("verdict", F.lit("keep")))
    assert {r["doc_id"]: r["text"].split() for r in back.collect()} == {k: v[0] for k, v in texts.items()}


def test_carry_forward_and_complete_cases(spark):
    s = spark.createDataFrame([("a", 1, 0, "m", 0.5), ("a", 1, 2, "m", 0.1)], "arm string, code long, round int, item string, score double")
    got = [r["score"] for r in versions.carry_forward(s, [0, 1, 2, 3]).orderBy("round").collect()]
    assert got == [0.5, 0.5, 0.1, 0.1]
    p = spark.createDataFrame([(c, a, r, "ok") for c in (1, 2) for a in "xy" for r in (1, 2) if not (c == 2 and a == "y" and r == 2)], "code long, arm string, round int, exec string")
    assert [r["code"] for r in versions.complete_cases(p, 2, [1, 2]).collect()] == [1]


def test_retired_needs_scope_and_length(spark):
    u = spark.createDataFrame([(1, 'Section "Background" is used by nobody'), (1, "Figure 3 is used by nobody at all"), (2, 'Section "Background" is used by nobody')], "doc_id long, unit string")
    r = spark.createDataFrame([(1, '- section "Background" is used by nobody'.replace("section", "Section")), (1, "Figure 3 is used by nobody at all")], "doc_id long, instance string")
    assert sorted((x["doc_id"], x["unit"][:6]) for x in versions.drop_retired(u, r).collect()) == [(1, "Figure"), (2, "Sectio")]


def test_includes_expand_once_in_order(spark):
    files = [("d", "main.tex", "\\documentclass{a}\\begin{document}S \\input{x} % \\input{hidden}\n\\include{sub/y} \\input{x} \\input{gone}\\end{document}"), ("d", "x.tex", "X\\input{main}"), ("d", "sub/y.tex", "Y \\input{z}"), ("d", "z.tex", "Z"), ("d", "old.tex", "\\documentclass{a} tiny")]
    df = spark.createDataFrame(files, "doc_id string, path string, text string")
    root = io.root_file(df)
    assert root.first()["root"] == "main.tex"
    r = io.expand_includes(df, root).first()
    assert re.sub(r"\s+", " ", r["tex"]) == "\\documentclass{a}\\begin{document}S X Y Z % MISSING INPUT gone \\end{document}" and r["missing"] == ["gone"]


def test_include_paths_follow_steps_back(spark):
    body = "\\begin{document}\\input{../sec/a}\\input{./b}\\input{../../top}\\end{document}"
    files = [(7, "src/main.tex", "\\documentclass{a}" + body), (7, "sec/a.tex", "A \\input{../src/./c}"), (7, "src/b.tex", "B"), (7, "src/c.tex", "C"), (7, "a.tex", "wrong"), (7, "deep/sec/a.tex", "wrong")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    r = io.expand_includes(df, spark.createDataFrame([(7, "src/main.tex")], "doc_id long, root string")).first()
    assert re.sub(r"\s+", " ", r["tex"]) == "\\documentclass{a}\\begin{document} A C B % MISSING INPUT ../../top \\end{document}"
    assert r["doc_id"] == 7 and r["missing"] == ["../../top"]


def test_equal_root_candidates_take_the_last_path(spark):
    text = "\\documentclass{a}\\begin{document}\\end{document}"
    df = spark.createDataFrame([(1, "b.tex", text), (1, "c.tex", text), (1, "a.tex", text), (1, "z.tex", "\\documentclass{a}" + " " * 99)], "doc_id long, path string, text string")
    assert io.root_file(df).first()["root"] == "c.tex"


def test_torn_json_tail_and_null_spellings(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "score": "0.5"}\n{"id": 2, "score": "None"}\n{"id": 3, "sc')
    rows = io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id BIGINT, score STRING", strict=False).where("id IS NOT NULL")
    assert sorted((r["id"], r["s"]) for r in rows.select("id", io.number(F.col("score")).alias("s")).collect()) == [(1, 0.5), (2, None)]
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id BIGINT, score STRING").collect()


def test_top_up_reaches_target_exactly(spark):
    pool = spark.createDataFrame([(i, "h" if i % 3 else "c") for i in range(90)], "id long, cell string")
    done = pool.where("id < 9")
    got = {r["cell"]: r["n"] for r in reviews.top_up(pool, done, ["cell"], "id", 10).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"h": 4, "c": 7}


def test_incremental_scoring_skips_what_is_there(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    df = spark.createDataFrame([(i, "t" * i) for i in range(6)], "doc_id long, text string")
    score = lambda b: b.select("doc_id", F.length("text").alias("n"))
    for k, part in enumerate((df.where("doc_id < 4"), df)):
        part.coalesce(1).write.mode("append").parquet(str(src / f"part{k}"))
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(src))
        incremental.score_unseen(stream, "doc_id", score, sink, str(tmp_path / "ckpt"))
    out = spark.read.parquet(sink)
    assert sorted((r["doc_id"], r["n"]) for r in out.collect()) == [(i, i) for i in range(6)]
    assert out.select("batch_id").distinct().count() == 2


@pytest.mark.parametrize("parts", [1, 3])
def test_a_streamed_table_may_be_a_folder_of_parts(spark, tmp_path, parts):
    df = spark.createDataFrame([(i, "t" * i) for i in range(6)], "doc_id long, text string").repartition(parts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    df.write.parquet(str(tmp_path / "labels.parquet"))  # another table of the folder stays out
    if parts == 1:
        part, = (tmp_path / "documents.parquet").glob("part-*")
        (tmp_path / "one").mkdir()
        (tmp_path / "one" / "documents.parquet").write_bytes(part.read_bytes())
    stream = incremental.table_stream(spark, str(tmp_path / "one" if parts == 1 else tmp_path), "documents")
    sink = str(tmp_path / "sink")
    incremental.score_unseen(stream, "doc_id", lambda b: b.select("doc_id", F.length("text").alias("n")), sink, str(tmp_path / "ckpt"))
    assert sorted((r["doc_id"], r["n"]) for r in spark.read.parquet(sink).collect()) == [(i, i) for i in range(6)]


def test_upsert_keeps_the_latest_record_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    rows = [[(1, 10, 1, "a"), (2, 5, 1, "b")], [(1, 9, 2, "late"), (2, 5, 2, "tie"), (3, 1, 1, "new")]]
    schema = "k long, ts long, line long, v string"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(src / f"p{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        got = incremental.upsert_latest(stream, ["k"], "ts", "line", str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(1, "a"), (2, "tie"), (3, "new")]


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    """Three batches, one of them replayed; files of untouched buckets stay, a gap and another number of buckets raise."""
    schema, sink = "k long, ts long, line long, v string", str(tmp_path / "sink")
    batches = [[(k, 1, k, f"a{k}") for k in range(200)], [(7, 2, 300, "b7"), (500, 1, 301, "new"), (8, 0, 302, "late"), (None, 1, 303, "null")], [(7, 3, 400, "c7")], []]

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "sink" / "data").rglob("*.parquet")}

    def put(i, buckets=16):
        incremental.upsert_batch(spark.createDataFrame(batches[i], schema), i, ["k"], "ts", "line", sink, buckets)
        return files()

    def model(upto):
        best = {}
        for k, ts, line, v in (r for b in batches[: upto + 1] for r in b):
            best[k] = max(best.get(k, (-1, -1, "")), (ts, line, v))
        return sorted(((k, v) for k, (_, _, v) in best.items()), key=str)

    def now(i):
        return sorted(((r["k"], r["v"]) for r in incremental.latest_table(spark, sink, schema, i).collect()), key=str)

    first = put(0)
    second = put(1)
    assert all(second[f] == at for f, at in first.items())
    assert len({f.parent for f in second if "generation=1" in str(f)}) <= 4
    third = put(2)
    assert len([f for f in third if "generation=2" in str(f)]) == 1 and now(2) == model(2)
    again = put(1)  # replayed after a restart: the same rows, nothing of the first batch touched
    assert all(again[f] == at for f, at in first.items()) and now(1) == model(1)
    put(2), put(3)
    assert now(3) == now(2) == model(3) and now(0) == model(0)
    with pytest.raises(ValueError, match="missing"):
        incremental.upsert_batch(spark.createDataFrame(batches[2], schema), 9, ["k"], "ts", "line", sink, 16)
    with pytest.raises(ValueError, match="16 buckets"):
        put(2, 8)


def test_reevaluation_and_rounds_by_item_and_arm(spark):
    human = spark.createDataFrame([(p, i, h) for p in (1, 2, 3) for i, h in (("a", 2.0), ("b", 5.0))], "pair_id long, item string, value double")
    rows = [("x", 0, p, i, v) for p in (1, 2, 3) for i, v in (("a", 3.0), ("b", 4.0))] + [("y", 0, 1, "a", 1.0), ("y", 0, 2, "a", None)]
    revised = spark.createDataFrame(rows, "arm string, round int, pair_id long, item string, value double")
    got = {(r["arm"], r["item"]): (r["n_pairs"], r["pair_acc"], r["auroc"]) for r in versions.reevaluate(revised, human, ["arm", "round", "item"], ["pair_id", "item"]).collect()}
    assert got == {("x", "a"): (3, 1.0, 1.0), ("x", "b"): (3, 0.0, 0.0), ("y", "a"): (1, 0.0, 0.0)}
    scores = revised.select("arm", "round", F.col("pair_id").alias("code"), "item", F.col("value").alias("score"))
    table = versions.rounds_table(scores, human.select(F.col("pair_id").alias("code"), "item", F.col("value").alias("human")), [0], ["arm"])
    means = {(r["arm"], r["item"]): (r["r0"], r["human"]) for r in table.where("code = 'mean'").collect()}
    assert means == {("x", "a"): (3.0, 2.0), ("x", "b"): (4.0, 5.0), ("y", "a"): (1.0, 2.0)} and table.count() == 8 + 3


def test_findings_of_one_place_go_by_their_text(spark):
    rows = [(1, "xsec", 7, "c"), (1, "xsec", 7, "b"), (1, "xsec", 7, "a"), (1, "xsec", 9, "d")]
    for given in (rows, rows[::-1]):
        found = versions.findings(spark.createDataFrame(given, "doc_id long, measure string, ord long, unit string").coalesce(1), ["xsec"], 2)
        assert [(r["position"], r["unit"], r["n_more"]) for r in found.orderBy("position").collect()] == [(1, "a", 2), (2, "b", 2)]
