"""Regression cases of the document measures on synthetic text."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from inkstat.functions import patterns as P
from inkstat.functions import text as T
from inkstat.operators import argument, citation, core, crossref, evidence, figure, redundancy, structure

LONG = "we measure the effect of the new schedule on all held out tasks of the suite"


def one(df):
    return df.collect()[0]


def units(spark, docs):
    rows = [(i, [(sec, "summary" if sec < 0 else "body", s.lower().split()) for sec, s in us]) for i, us in docs.items()]
    return spark.createDataFrame(rows, "doc_id long, units array<struct<sec:int,role:string,toks:array<string>>>")


def test_repeated_sentence_in_two_later_sections(spark):
    u = units(spark, {1: [(-1, LONG), (0, "an opening that shares nothing with anything else in this text"), (1, LONG), (2, LONG)]})
    rows = {r["ord"]: r for r in redundancy.sentence_rows(u).collect()}
    assert set(rows) == {2, 3} and all(r["recycled"] and r["r"] == 1.0 and r["src_ord"] == 0 for r in rows.values())
    doc = one(redundancy.document_scores(u))
    assert (doc["n_recycled"], doc["n_eligible"], doc["score"], doc["score_agg"]) == (2, 4, 0.5, 1.0)


def test_short_shared_phrase_is_covered_but_not_recycled(spark):
    phrase = "one two three four five six seven eight"
    rest = " ".join(f"w{i}" for i in range(26))
    u = units(spark, {1: [(0, phrase + " tail"), (1, phrase + " " + rest)]})
    row = one(redundancy.sentence_rows(u))
    assert row["covered"] == 8 and row["longest_run"] == 8 and row["r"] == pytest.approx(8 / 34) and not row["recycled"]


def test_repeat_inside_one_section_is_ignored(spark):
    u = units(spark, {1: [(0, LONG), (0, LONG)]})
    assert redundancy.sentence_rows(u).count() == 0
    assert one(redundancy.document_scores(u))["score"] == 0.0


def test_sentinel_grams_never_count_and_no_units_is_null(spark):
    s = "xxmathxx is used xxcitexx for all xxrefxx of these xxmathxx terms"
    u = units(spark, {1: [(0, s), (1, s)], 2: [(0, "too short")]})
    assert redundancy.sentence_rows(u).count() == 0
    short = [r for r in redundancy.document_scores(u).collect() if r["doc_id"] == 2][0]
    assert short["score"] is None and short["weak"]


def test_recycling_matches_brute_force(spark):
    rng = random.Random(11)
    docs = {d: [(k // 3, " ".join(rng.choice("abc") + str(rng.randint(0, 1)) for _ in range(rng.randint(6, 30)))) for k in range(12)] for d in range(6)}
    got = {(r["doc_id"], r["ord"]): (r["covered"], r["longest_run"], r["src_ord"]) for r in redundancy.sentence_rows(units(spark, docs), n=4).collect()}
    want = {}
    for d, us in docs.items():
        first = {}
        for i, (_, s) in enumerate(us):
            w = s.split()
            for p in range(len(w) - 3):
                first.setdefault(tuple(w[p:p + 4]), i)
        for i, (sec, s) in enumerate(us):
            w, cov, src = s.split(), set(), {}
            for p in range(len(w) - 3):
                f = first[tuple(w[p:p + 4])]
                if f < i and us[f][0] != sec:
                    cov |= set(range(p, p + 4))
                    src[f] = src.get(f, 0) + 1
            if cov:
                run = best = 0
                for p in range(len(w)):
                    run = run + 1 if p in cov else 0
                    best = max(best, run)
                want[d, i] = (len(cov), best, max(src, key=src.get))
    assert got == want


def test_frequent_grams_are_dropped(spark):
    u = units(spark, {d: [(0, LONG), (1, LONG)] for d in range(4)})
    assert redundancy.sentence_rows(u, cliches=redundancy.frequent_grams(u, 4)).count() == 0
    assert redundancy.sentence_rows(u, cliches=redundancy.frequent_grams(u, 5)).count() == 4


def test_long_texts_cost_no_pairs_of_grams(spark):
    u = units(spark, {1: [(0, " ".join(f"w{i}" for i in range(60_000)))], 2: [(0, "a b " * 8 + "c"), (1, "a b " * 8 + "c")]})
    redundancy.frequent_grams(u.where("doc_id = 2"), 1).count()
    begun = time.monotonic()
    assert redundancy.frequent_grams(u, 1).count() == 59_993 + 3
    assert time.monotonic() - begun < 15


def test_sweep_reads_the_texts_once_for_all_lengths(spark):
    rng = random.Random(3)
    u = units(spark, {d: [(k // 2, " ".join(rng.choice("ab") + str(rng.randint(0, 2)) for _ in range(20))) for k in range(8)] for d in range(5)})
    out = redundancy.sweep(u, [2, 3, 4], [0.3, 0.6])
    got = {(r["n"], r["tau"]): r["n_recycled"] for r in out.collect()}
    assert got == {(n, tau): redundancy.sentence_rows(u, n, tau).where("eligible AND recycled").count() for n in (2, 3, 4) for tau in (0.3, 0.6)}
    # the rows of covered units come from what was written once, the total from the texts
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 3


TEX = r"""\documentclass{article}
\begin{document}
\begin{abstract}Short abstract.\end{abstract}
\section{Introduction}\label{sec:intro}
We start. Section 2 gives the method, Section 3 the tests. See the next section. Table \ref{tab:a} is here.
\begin{table}\caption{Numbers}\label{tab:a}\begin{tabular}{lc} A & 1 \\ B & 2 \\ \end{tabular}\end{table}
\section{Method}\label{sec:m}
\subsection{Detail}\label{sub:d}
\begin{equation} x \label{eq:x} \end{equation}
See \ref{sec:intro} and \ref{eq:x}.
\section{Experiments}
As in \cref{eq:x,nolabel} and in the Method section.
\appendix
\section{Proofs}\label{sec:p}
Nothing.
\end{document}
"""


@pytest.fixture(scope="module")
def tokens(spark):
    return structure.tex_tokens(spark.createDataFrame([(1, TEX)], "doc_id long, tex string")).cache()


def test_sections_and_appendix(tokens):
    rows = structure.sections(tokens).orderBy("offset").collect()
    assert [(r["title"], r["level"], r["role"], r["in_appendix"]) for r in rows] == [
        ("Introduction", 1, "Intro", False), ("Method", 1, "Method", False), ("Detail", 2, "Other", False), ("Experiments", 1, "Experiments", False), ("Proofs", 1, "Appendix", True)]
    for r in rows:
        assert TEX[r["offset"]:].startswith("\\s")
    assert rows[1]["end"] == rows[3]["offset"] and rows[4]["end"] == TEX.index("\\end{document}")


def test_labels_kind_and_owner(tokens):
    got = {r["label"]: (r["kind"], r["top"]) for r in structure.labels(tokens).collect()}
    assert got == {"sec:intro": ("section", 0), "tab:a": ("table", 0), "sec:m": ("section", 1), "sub:d": ("section", 1), "eq:x": ("equation", 1), "sec:p": ("section", 3)}


def test_objects_pointers_and_score(tokens):
    objs = {r["object"]: r["kind"] for r in crossref.objects(tokens).collect()}
    assert objs == {"S:0": "section", "S:1": "section", "S:2": "section", "L:tab:a": "table", "L:sub:d": "subsection", "L:eq:x": "equation"}
    ev = crossref.mark_roadmap(crossref.pointers(tokens), structure.body_sections(tokens)).cache()
    got = sorted((r["parser"], r["src"], r["target"] or r["why"], r["roadmap"]) for r in ev.collect())
    assert got == sorted([
        ("K1", 0, "L:tab:a", False), ("K1", 1, "S:0", False), ("K1", 1, "L:eq:x", False), ("K1", 2, "L:eq:x", False), ("K1", 2, "label never declared", False),
        ("K2", 0, "S:1", True), ("K2", 0, "S:2", True), ("K3", 0, "S:1", False), ("K3", 0, "section name not matched", False), ("K3", 2, "S:1", False)])
    r = {x["object"]: x for x in crossref.reach(crossref.objects(tokens), ev).collect()}
    assert not r["L:tab:a"]["reused"] and r["L:tab:a"]["n_local"] == 1  # only its own section points at it
    assert r["S:2"]["reach"] == 0 and r["S:2"]["reach_incl_roadmap"] == 1
    doc = one(crossref.document_scores(crossref.reach(crossref.objects(tokens), ev), ev))
    assert doc["score"] == pytest.approx(3 / 6) and doc["coverage"] == pytest.approx(8 / 10)


def test_appendix_numbers_go_on_past_z_and_past_one_byte(spark):
    tex = "\\begin{document}\\section{Intro}\\section{Method}\\appendix" + "\\section{More}" * 300 + "\\end{document}"
    got = structure.section_numbers(structure.tex_tokens(spark.createDataFrame([(1, tex)], "doc_id long, tex string"))).orderBy("top").collect()
    assert [r["number"] for r in got] == ["1", "2"] + [chr(64 + k) for k in range(1, 301)]


def test_arxiv_ids_are_not_cut(spark):
    bib = "@article{a,\n  title = {One},\n  eprint = {2301.123456},\n}\n@article{b,\n  title = {Two},\n  eprint = {0704.0001},\n}\n"
    got = structure.bibliography(spark.createDataFrame([(1, bib)], "doc_id long, bib string")).collect()
    assert [(r["key"], r["arxiv"]) for r in got] == [("a", "2301.123456"), ("b", "0704.0001")]


def test_long_braced_argument_does_not_exhaust_the_regex_stack(spark):
    tex = "\\begin{document}\\section{" + "a{b}" * 8000 + "}\\caption{" + "x{y}" * 8000 + "}\\end{document}"
    df = spark.createDataFrame([(1, tex)], "doc_id long, tex string")
    assert structure.sections(structure.tex_tokens(df)).count() == 1
    assert df.select(F.length(T.prose_view(F.col("tex")))).first()[0] > 0


@pytest.mark.parametrize("raw,kind,value,std,bold", [
    (r"12.3 \pm 0.4", "number", 12.3, 0.4, False), ("12.3 (0.4)", "number", 12.3, 0.4, False), (r"\textbf{12.3}", "number", 12.3, None, True),
    ("1,234", "number", 1234.0, None, False), ("n/a", "text", None, None, False), (r"12.3_{\pm 0.4}", "number", 12.3, 0.4, False), ("", "empty", None, None, False), (r"5.39\%", "number", 5.39, None, False)])
def test_number_cells(spark, raw, kind, value, std, bold):
    r = spark.createDataFrame([(raw,)], "c string").select(T.number_cell(F.col("c")).alias("x")).first()["x"]
    assert (r["kind"], r["value"], r["std"], r["is_bold"]) == (kind, value, std, bold)


@pytest.mark.parametrize("a,b,hit", [("5.4", "5.39", True), ("5.4", "5.46", False), ("5", "5.4", True), ("0.999", "1.0", True), ("-1.2", "-1.25", True), ("-1.2", "-1.26", False)])
def test_rounding_compatibility(spark, a, b, hit):
    side = lambda v: spark.createDataFrame([(1, 1, v)], "doc_id long, id long, printed string")
    assert structure.rounding_matches(side(a), side(b)).count() == int(hit)


def test_rounding_counts_make_no_pairs_of_equal_prints(spark):
    side = lambda vs: spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(vs)], "doc_id long, id long, printed string")
    a, b = side(["5.39", "5.46", "5.4", "7", "5.39", "5.39"] * 5), side(["5.4", "5.4", "5", "7.0"] * 6)
    want = {r["doc_id"]: r["count"] for r in structure.rounding_matches(a, b).groupBy("doc_id").count().collect()}
    assert {r["doc_id"]: r["n"] for r in structure.rounding_match_counts(a, b).collect()} == want and want
    copies = side(["5.39"] * 40_000)  # 800 million pairs
    assert {r["doc_id"]: r["n"] for r in structure.rounding_match_counts(copies, copies).collect()} == {0: 20_000**2, 1: 20_000**2}


def sents(spark, *texts):
    return spark.createDataFrame([(1, 0, i, s) for i, s in enumerate(texts)], "doc_id long, para int, ord int, text string")


@pytest.mark.parametrize("texts,tags", [
    ([r"Both ideas are known \cite{a,b}."], [{"BUNDLE", "REL"}]),
    ([r"One uses trees \cite{a}, while another uses nets \cite{b}."], [{"MULTI", "REL"}]),
    ([r"Unlike \citet{a}, the score is bounded."], [{"REL1"}]),
    ([r"Trees were studied \cite{a}.", r"Nets were studied \cite{b}."], [set(), set()])])
def test_citation_tags(spark, texts, tags):
    rows = citation.tag_sentences(sents(spark, *texts)).orderBy("ord").collect()
    assert [set(r["tags"]) for r in rows] == tags


def test_few_citing_sentences_are_weak(spark):
    r = one(citation.isolation_scores(citation.tag_sentences(sents(spark, r"A \cite{a}.", r"B \cite{b}."))))
    assert r["score"] == 1.0 and r["weak"]


def test_abbreviations_do_not_end_sentences(spark):
    r = spark.createDataFrame([("As shown by Smith et al. The bound holds, cf. Fig. 3 for it. Next one.",)], "t string").select(T.sentences(F.col("t"))).first()[0]
    assert r == ["As shown by Smith et al. The bound holds, cf. Fig. 3 for it.", "Next one."]


def test_evidence_gap_cases(spark):
    docs = spark.createDataFrame([(1, "no table"), (2, "table only"), (3, "shown")], "doc_id long, tex string")
    app = spark.createDataFrame([(2, 1), (3, 1)], "doc_id long, n_result_tables long")
    shown = spark.createDataFrame([(3, "env", 90)], "doc_id long, kind string, pos int")
    start = spark.createDataFrame([(3, 50)], "doc_id long, appendix_start int")
    got = {r["doc_id"]: (r["score"], r["appendix_only"]) for r in evidence.gap_scores(docs, app, shown, start, F.lit(10)).collect()}
    assert got == {1: (None, False), 2: (1.0, False), 3: (0.0, True)}


def test_quotes_in_related_work_are_not_exhibits(spark):
    q = "``" + "q" * 50 + "''"
    tex = f"\\section{{Intro}} {q} \\section{{Related Work}} {q} \\section{{Tests}} {q} \\begin{{quote}}x\\end{{quote}}"
    rows = evidence.exhibits(spark.createDataFrame([(1, tex)], "doc_id long, tex string")).collect()
    assert sorted((r["kind"], r["pos"]) for r in rows) == sorted([("quote", tex.index("``")), ("quote", tex.rindex("``")), ("env", tex.index("\\begin{quote"))])


def lines(spark, *texts):
    return spark.createDataFrame([(1, i, s) for i, s in enumerate(texts)], "fig_id long, ord int, line string")


def test_one_stage_label_is_no_sequence(spark):
    assert not one(figure.figure_kinds(lines(spark, "Step 1 encode", "Output")))["enumerated_stage"]
    two = one(figure.figure_kinds(lines(spark, "Step 1 encode", "Step 2 decode", "Preprint")))
    assert two["enumerated_stage"] and two["n_lines"] == 2 and two["score"] == pytest.approx(1 / 6)


def test_enumeration_gap(spark):
    rows = figure.enumeration_gaps(lines(spark, "Phase I", "Phase II", "Phase IV", "Step 1", "Step 2", "Step 3")).collect()
    assert {r["word"]: r["gap"] for r in rows} == {"phase": True, "step": False}


def graph(spark, edges):
    return spark.createDataFrame([(1, s, d, w) for s, d, w in edges], "doc_id long, src int, dst int, weight double")


def test_build_up_depth_with_two_predictors(spark):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (3, 2, 5.0), (2, 3, 1.0), (0, 3, 0.5), (1, 3, float("nan"))]
    pred = argument.top_predictors(graph(spark, edges), 2)
    assert {(r["dst"], r["depth"]) for r in argument.build_up_depth(pred).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_argued_declared_and_empty_documents(spark):
    pred = argument.top_predictors(graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (4, 3, 1.0)]), 1)
    keys = spark.createDataFrame([(1, 2, "claim"), (1, 3, "claim")], "doc_id long, ord int, kind string")
    sizes = spark.createDataFrame([(1, 5), (2, 6)], "doc_id long, n_units int")
    got = {r["doc_id"]: r for r in argument.argued_scores(pred, keys, argument.build_up_depth(pred), sizes).collect()}
    assert got[1]["score"] == 0.5 and got[1]["weak"] and got[1]["deep_rate"] == 0.5
    assert got[2]["score"] is None and got[2]["coverage"] == 0.0


def test_shuffle_null_is_bounded_and_reproducible(spark):
    pred = argument.top_predictors(graph(spark, [(i, i + 1, 1.0) for i in range(9)]), 1)
    keys = spark.createDataFrame([(1, 9, "claim")], "doc_id long, ord int, kind string")
    sizes = spark.createDataFrame([(1, 10)], "doc_id long, n_units int")
    a, b = (one(argument.shuffle_null(pred, keys, sizes, 60)) for _ in range(2))
    assert tuple(a) == pytest.approx(tuple(b)) and a["observed"] == 9.0 and a["abu"] > 0 and a["null_pct"] == 1.0


def test_shuffle_null_equals_permutations_in_turn(spark):
    rng, draw = random.Random(2), lambda d, r, i: int(hashlib.md5(f"{d}:{r}:{i}:0".encode()).hexdigest()[:8], 16)
    sizes = {d: rng.choice([1, 4, 4, 7, 90]) for d in (1, 2, 30, 400, 5000, 10**17)}
    edges = {d: {(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)} for d, n in sizes.items()}
    keys = {d: [i for i in range(n) if i % 3 == 0] for d, n in sizes.items()}

    def total(d, order):
        seen = {}
        for u in order:
            seen[u] = max([seen[s] + 1 for s, t in edges[d] if t == u and s in seen], default=0)
        return sum(seen[k] for k in keys[d]) / len(keys[d])

    rows = argument.shuffle_null(
        spark.createDataFrame([(d, s, t) for d, es in edges.items() for s, t in es], "doc_id long, src long, dst long"),
        spark.createDataFrame([(d, k) for d, ks in keys.items() for k in ks], "doc_id long, ord long"), spark.createDataFrame(list(sizes.items()), "doc_id long, n_units int"), 40)
    # what moves is a document, not its permutations
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "collect_list(" in plan
    got = {r["doc_id"]: r for r in rows.collect()}
    for d, n in sizes.items():
        null = [total(d, sorted(range(n), key=lambda i: (draw(d, r, i), i))) for r in range(1, 41)]
        seen, mean = total(d, range(n)), sum(null) / 40
        want = (seen, mean, (sum((x - mean) ** 2 for x in null) / 40) ** 0.5, sum(x < seen for x in null) / 40)
        assert tuple(got[d])[1:5] == pytest.approx(want, abs=1e-9)
    assert len(got) == len(sizes)


def test_majority_ties_go_to_the_first_label(spark):
    v = spark.createDataFrame([(1, 0, 0, "b"), (1, 0, 1, "a"), (1, 0, 2, "a"), (1, 0, 3, "b"), (1, 1, 0, "zzz")], "doc_id long, ord int, run int, label string")
    got = {r["ord"]: (r["label"], r["unanimous"]) for r in argument.majority_label(v, ["a", "b"]).collect()}
    assert got == {0: ("b", False), 1: ("none", True)}


@pytest.mark.parametrize("statuses,label", [
    (["violation", "consistent"], "positive"), (["consistent", "not_applicable"], "negative"), (["consistent", "inconclusive"], "negative_incomplete"),
    (["inconclusive"], "inconclusive"), (["not_applicable"], "NA")])
def test_document_label(spark, statuses, label):
    df = spark.createDataFrame([(1, s) for s in statuses], "doc_id long, status string")
    assert one(core.document_label(df))["label"] == label


def test_window_plan_matches_the_formula(spark):
    df = spark.createDataFrame([(n, n) for n in (10, 64, 600, 1024, 5000)], "doc_id long, t long")
    got = {}
    for r in core.window_plan(df, "t", 3, 512).collect():
        got.setdefault(r["doc_id"], []).append(r["start"])
    want = {t: [int(j * max(t - 512, 0) / max(1, n - 1)) for j in range(n)] for t in (64, 600, 1024, 5000) for n in [max(1, min(3, t // 512))]}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_role_words_resolve_in_order(spark):
    df = spark.createDataFrame([("1 Introduction",), ("Related Work on Methods",), ("Our Proposed Model",), ("Ethics Statement",), ("Zebra",)], "t string")
    assert [r[0] for r in df.select(T.role_of(F.col("t"))).collect()] == ["Intro", "Related", "Method", "Conclusion", "Other"]
    assert len(P.ROLES) == 7


def test_headings_keep_macros_and_labels_in_their_titles(spark):
    from inkstat.operators import structure as S

    tex = "\\begin{document}\\section{Introduction \\label{sec:intro}} a \\ref{sec:m}\\section[M]{Method of \\citet{k}}\\label{sec:m} b\\section*{Results} c\\end{document}"
    tokens = S.tex_tokens(spark.createDataFrame([(1, tex)], "doc_id long, tex string")).cache()
    titles = [(r["title"], r["starred"]) for r in S.sections(tokens).orderBy("offset").collect()]
    assert titles == [("Introduction", False), ("Method of k", False), ("Results", True)]
    assert sorted(r["label"] for r in S.labels(tokens).collect()) == ["sec:intro", "sec:m"]
