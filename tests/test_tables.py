"""The table grid on hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkstat.operators import tables as TB


def cells_of(spark, tex):
    rows = TB.table_cells(spark.createDataFrame([(7, tex)], "doc_id long, tex string")).orderBy("tbl", "r", "c").collect()
    out = {}
    for r in rows:
        out.setdefault(r.tbl, {}).setdefault(r.r, []).append(r.raw)
    return [list(t.values()) for t in out.values()]


@pytest.mark.parametrize("tex, want", [
    (r"\begin{tabular}{ll} \makecell{x\\y\\z} & 1 \\ a & 2 \end{tabular}", [[[r"\makecell{x y z}", "1"], ["a", "2"]]]),
    (r"\begin{tabular}{ll} \textbf{p & q} & 1 \\ a & 2 \\ \end{tabular}", [[[r"\textbf{p & q}", "1"], ["a", "2"]]]),
    (r"\begin{tabular}[t]{l@{}l} a & b \\[2pt] c & d \end{tabular}", [[["a", "b"], ["c", "d"]]]),
    (r"\begin{tabularx}{\textwidth}[b]{X|X} a & b \\ c & \& d \end{tabularx}", [[["a", "b"], ["c", r"\& d"]]]),
    (r"\begin{longtable}{l} a \\ \cmidrule(lr){1-1} b \\ \hline \end{longtable} \begin{tabular}{l} only \end{tabular}", [[["a"], ["b"]]]),
    (r"\begin{tabular}{lll} \multicolumn{2}{c}{\textbf{T}} & x \\ \multirow{2}{*}{A} & 1 & 2 \\ & 3 & 4 \end{tabular}", [[[r"\textbf{T}", "", "x"], ["A", "1", "2"], ["", "3", "4"]]]),
    (r"\begin{tabular}{l} \begin{tabular}{c} i & j \\ k \end{tabular} & o \\ p & q \end{tabular}", [[[r"\begin{tabular}{c} i & j   k \end{tabular}", "o"], ["p", "q"]]]),
    (r"\begin{tabular}{ll} \multirow{2}{*}{\makecell{A\\B}} & 1 \\ & \multicolumn{1}{c}{\multirow{2}{*}{9}} \end{tabular}", [[[r"\makecell{A B}", "1"], ["", "9"]]]),
    (r"\begin{tabular}{l} a & b \\ never closed", []),
    (r"\end{tabular} \begin{tabular}{ll} } a & b \\ { c & d \\ e & f \end{tabular}", [[["} a", "b"], ["{ c & d   e & f"]]]),
    ("", []), (None, []),
])
def test_cells(spark, tex, want):
    assert cells_of(spark, tex) == want


def test_captions_and_labels(spark):
    tex = r"\caption{far}" + " " * 2000 + r"\begin{table}[t]\begin{tabular}{l} a \\ b \end{tabular}\caption{one {x} loss}\label{t:1}\end{table}" + " " * 2000 + r"\begin{tabular}{l} a \\ b \end{tabular}"
    got = TB.table_cells(spark.createDataFrame([("k", tex)], "doc_id string, tex string")).select("tbl", "label", "caption", "start").distinct().orderBy("tbl").collect()
    assert [(r.label, r.caption) for r in got] == [("t:1", "one {x} loss"), (None, "")]
    assert all(tex[r.start:].startswith(r"\begin{tabular}") for r in got)


def test_names_groups_and_headers(spark):
    tex = r"""\begin{tabular}{lcc} Model & \multicolumn{2}{c}{Test} \\ & Acc & Loss $\downarrow$ \\ first & 1 & 2 \\
      \multicolumn{3}{c}{\emph{Large}} \\ second & 3 & 4 \\ \multirow{2}{*}{pair} & 5 & 6 \\ & 7 & \textbf{8} \\ 12 & 9 & 10 \end{tabular}"""
    parsed = TB.parsed_tables(TB.table_cells(spark.createDataFrame([(1, tex)], "doc_id long, tex string").withColumn("raw", F.lit("x"))))
    rows = TB.body_rows(parsed).orderBy("r").collect()
    assert [(r.r, r.name, r.own_name, r.row_group) for r in rows] == [
        (2, "first", "first", None), (4, "second", "second", "Large"), (5, "pair", "pair", None), (6, "pair", "", None), (7, "12", "12", "pair")]
    assert [r.header for r in TB.column_names(parsed).orderBy("c").collect()] == ["Model", "Test | Acc", "Test | Loss"]
    assert TB.table_cells(spark.createDataFrame([], "doc_id long, tex string")).count() == 0
