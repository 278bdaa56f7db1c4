"""Text steps read a text once: what moves and what a view keeps is bounded by what changes."""

from inkstat.operators import evidence as EV
from inkstat.operators import structure as S
from inkstat.operators import tables as TB
from inkstat.operators import views as V


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_single_blanks_are_no_segments(spark):
    docs = spark.createDataFrame([(1, "one two three  four\tfive six")], "doc_id long, tex string")
    row = V.prose_views(docs).first()
    assert row["prose"] == "one two three four five six"
    assert len(row["segments"]) == 5  # kept, the double blank, kept, the tab, kept
    assert V.sentence_spans(docs).select("tex_start", "tex_end").collect() == [(0, 28)]


def test_short_forms_at_any_place(spark):
    docs = spark.createDataFrame([(1, "approx. A, w.r.t. B. See et al. C xal. D al. E")], "doc_id long, tex string")
    assert [r["text"] for r in V.sentence_spans(docs).orderBy("ord").collect()] == ["approx. A, w.r.t. B.", "See et al. C xal.", "D al. E"]


def test_cells_of_a_table_move_once(spark):
    tex = r"\begin{tabular}{lc} a & \multicolumn{1}{c}{x \\ y} \\ b & {p & q} \\[2pt] c & $3.5 \pm 0.2$ \\ d~\% & 5 (0.1) \end{tabular}"
    parsed = TB.parsed_tables(TB.table_cells(spark.createDataFrame([(1, tex)], "doc_id long, tex string")))
    assert plan(parsed).count("Exchange hashpartitioning") == 1
    got = parsed.orderBy("r", "c").select("r", "c", "raw", "cell.printed", "cell.std", "is_header").collect()
    assert [tuple(r) for r in got] == [
        (0, 0, "a", None, None, True), (0, 1, "x   y", None, None, True), (1, 0, "b", None, None, True), (1, 1, "{p & q}", None, None, True),
        (2, 0, "c", None, None, False), (2, 1, r"$3.5 \pm 0.2$", "3.5", 0.2, False), (3, 0, r"d~\%", None, None, False), (3, 1, "5 (0.1)", "5", 0.1, False)]


def test_tokens_are_found_in_one_reading(spark):
    tex = "\\section*{A \\label{ s:a } b} See Sections 2 and 3 in the previous section.\\begin{figure*}\\label{f}\u0085\\end{figure*}\\href{u}{v} \\Cref{a, b} \\Citep[x]{k, m}\\appendix"
    tokens = S.tex_tokens(spark.createDataFrame([(1, tex), (2, None)], "doc_id long, tex string"))
    assert "regexp" not in plan(tokens).lower()
    got = [tuple(r) for r in tokens.orderBy("offset").select("offset", "kind", "level", "title", "starred", "name", "arg", "blank_after", "numbers", "deictic").collect()]
    assert got == [
        (0, "head", 1, "A b", True, None, None, False, ["2", "3"], ["previous"]), (tex.index("\\label"), "label", None, None, False, None, "s:a", True, [], []),
        (tex.index("\\begin"), "begin", None, None, False, "figure", None, True, [], []), (tex.index("\\label{f}"), "label", None, None, False, None, "f", False, [], []),
        (tex.index("\\end"), "end", None, None, False, "figure", None, True, [], []), (tex.index("\\Cref"), "ref", None, None, False, "Cref", "{a, b} ", True, [], []),
        (tex.index("\\Citep"), "cite", None, None, False, None, "k, m", True, [], []), (tex.index("\\appendix"), "appendix", None, None, False, None, None, True, [], [])]


def test_exhibits_are_found_in_one_reading(spark):
    said = "``" + "q" * 50 + "''"
    tex = said + "\\section{Related}" + said + "\\section{B}" + said + "\\begin{Quote}\\Caption{my an example of x}"
    shown = EV.exhibits(spark.createDataFrame([(1, tex), (2, None)], "doc_id long, tex string"))
    assert "regexp" not in plan(shown).lower()
    assert sorted(map(tuple, shown.select("kind", "pos").collect())) == [
        ("caption", tex.index("\\Caption")), ("env", tex.index("\\begin")), ("quote", 0), ("quote", tex.rindex("``"))]
