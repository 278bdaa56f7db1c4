"""Tables of LaTeX documents: a grid of cells with column names, row names and row groups.

One table is read as a stream of tokens with a nesting depth (braces, and environments inside of a
cell): only a break or an & at depth 0 ends a row or a cell, so ``\\makecell{x\\\\y}`` and ``{a & b}`` stay one cell. A cell
that spans columns occupies its further places with empty cells marked ``spanned``. What a number, a header or a group
is follows from the parsed cells by column functions and windows over one table.

A table inside of a cell of another one is content of that cell; a tabular that is never closed is none. A null text has no tables.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstat.functions import patterns as P
from inkstat.functions import text as T
from inkstat.operators.views import CAPTION, rows_within

TABLE_ENVS = ("tabular", "tabular*", "tabularx", "tabulary", "longtable")
HEADER_ROWS = 3
SIZED_ENVS = ("tabular*", "tabularx", "tabulary")  # with a width in front of the columns
BORDER = re.compile(r"\\(begin|end)\{(tabular\*?|tabularx|tabulary|longtable)\}")
FLOAT = re.compile(r"(?s)\\begin\{(table\*?|sidewaystable\*?|wraptable)\}.*?\\end\{\1\}")
LABEL = re.compile(r"\\label\{([^}]+)\}")
# fixed values: lines and colours between rows, which are no content
RULES = re.compile(r"\\(?:toprule|midrule|bottomrule|hline|cline\{[^}]*\}|cmidrule(?:\([^)]*\))?\{[^}]*\}|addlinespace(?:\[[^\]]*\])?|"
                   r"specialrule\{[^}]*\}\{[^}]*\}\{[^}]*\}|arrayrulecolor\{[^}]*\}|noalign\{[^}]*\}|rowcolor\{[^}]*\}|morecmidrules)")
TOKEN = re.compile(r"\\\\(?:\[[^\]]*\])?|\\begin\{[^}]*\}|\\end\{[^}]*\}|\\.|[{}&]", re.S)
PARTS = re.compile(f"({TOKEN.pattern})", re.S)
MULTICOLUMN = re.compile(r"\\multicolumn\s*\{(\d+)\}\s*\{")
MULTIROW = re.compile(r"\\multirow\s*(?:\[[^\]]*\])?\s*\{(?:-?\d+|\*)\}\s*(?:\[[^\]]*\])?\s*(?:\{[^{}]*\}|\*)?\s*(?:\[[^\]]*\])?\s*\{")
NEARBY_BEFORE, NEARBY_AFTER = 1500, 500
MOST_SPAN = 1000


def closing(text: str, at: int) -> int:
    """The place behind the brace that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for token in TOKEN.finditer(text, at):
        depth += {"{": 1, "}": -1}.get(token.group(), 0)
        if not depth and token.group() == "}":
            return token.end()
    return len(text)


def bodies(tex: str) -> Iterator[tuple[int, int, int]]:
    """(start, body start, body end) of every outermost table."""
    opened: list[tuple[str, int, int]] = []
    for border in BORDER.finditer(tex):
        kind, name = border.groups()
        if kind == "begin":
            opened.append((name, border.start(), border.end()))
            continue
        while opened and opened[-1][0] != name:
            opened.pop()
        if opened:
            _, start, at = opened.pop()
            if not opened:
                for _ in range(2 if name in SIZED_ENVS else 1):
                    option = re.compile(r"\s*\[[^\]]*\]").match(tex, at)
                    at = option.end() if option else at
                    brace = re.compile(r"\s*\{").match(tex, at)
                    at = closing(tex, brace.end() - 1) if brace else at
                yield start, min(at, border.start()), border.start()


def grid(body: str) -> list[list[str]]:
    """Cells of every row that has content or an &."""
    parts = PARTS.split(RULES.sub(" ", body))  # text, token, text, ..., text
    rows, cells, depth, begin = [], [], 0, 0
    for at in range(1, len(parts), 2):
        word = parts[at]
        if word == "&":
            if not depth:
                cells.append("".join(parts[begin:at]))
                begin = at + 1
        elif word.startswith("\\\\"):
            if depth:
                parts[at] = " "  # a break inside of a cell
            else:
                rows.append([*cells, "".join(parts[begin:at])])
                cells, begin = [], at + 1
        elif word == "{" or word.startswith("\\begin"):
            depth += 1
        elif word == "}" or word.startswith("\\end"):
            depth = max(0, depth - 1)
    rows.append([*cells, "".join(parts[begin:])])
    return [r for r in rows if any(c.strip() for c in r)]


def argument(cell: str, call: re.Match) -> str:
    return cell[call.end():closing(cell, call.end() - 1) - 1]


def places(row: list[str]) -> Iterator[tuple[str, int, bool, bool]]:
    """(content, columns, spanned, over rows) of every place of a row."""
    for cell in row:
        if "\\multi" not in cell:
            yield cell.strip(), 1, False, False
            continue
        wide = MULTICOLUMN.search(cell)
        span = 1
        if wide:
            span = max(1, min(int(wide.group(1)), MOST_SPAN))
            columns = closing(cell, wide.end() - 1)
            brace = re.compile(r"\s*\{").match(cell, columns)
            cell = cell[brace.end():closing(cell, brace.end() - 1) - 1] if brace else ""
        tall = MULTIROW.search(cell)
        yield (argument(cell, tall) if tall else cell).strip(), span, False, bool(tall)
        for _ in range(span - 1):
            yield "", 0, True, False


def table_cells(docs: DataFrame, tex: str = "tex") -> DataFrame:
    """(doc_id, tbl, start, label, caption, r, c, raw, span, spanned, over_rows) of every table of at least two rows; captions are raw."""

    def each(text: str | None) -> Iterator[tuple]:
        text = text or ""
        floats = [m.span() for m in FLOAT.finditer(text)]
        begins = [a for a, _ in floats]
        number = 0
        for start, inner, end in bodies(text):
            rows = grid(text[inner:end])
            if len(rows) < 2:
                continue
            last = bisect_right(begins, start) - 1
            around = floats[last] if last >= 0 and start < floats[last][1] else (max(0, start - NEARBY_BEFORE), end + NEARBY_AFTER)
            caption, label = CAPTION.search(text, *around), LABEL.search(text, *around)
            facts = (number, start, label.group(1).strip() if label else None, caption.group(1) if caption else "")
            number += 1
            for r, row in enumerate(rows):
                for c, place in enumerate(places(row)):
                    yield *facts, r, c, *place

    return rows_within(docs, [tex], "tbl int, start long, label string, caption string, r int, c int, raw string, span int, spanned boolean, over_rows boolean", each)


def leading_cells(cells: DataFrame) -> DataFrame:
    """The rows that can be a header: enough for ``column_names``."""
    return cells.where(F.col("r") < HEADER_ROWS)


def parsed_tables(cells: DataFrame) -> DataFrame:
    """Cells with their parsed value and row kind: up to three leading rows with at most a quarter
    numeric cells are the header (at least the first row is). The cells of a table move once, here."""
    parsed = cells.withColumn("cell", T.number_cell(F.col("raw")))
    of_row = Window.partitionBy("doc_id", "tbl").orderBy("r").rangeBetween(0, 0)
    full, nums = F.count_if(F.col("cell.kind") != "empty").over(of_row), F.count_if(F.col("cell.kind") == "number").over(of_row)
    parsed = parsed.withColumn("head_like", (full > 0) & (nums <= F.floor(full / 4)))
    so_far = Window.partitionBy("doc_id", "tbl").orderBy("r").rangeBetween(Window.unboundedPreceding, 0)
    return parsed.withColumn("is_header", (F.col("r") == 0) | ((F.col("r") < HEADER_ROWS) & F.every("head_like").over(so_far))).drop("head_like")


def column_names(parsed: DataFrame) -> DataFrame:
    """(doc_id, tbl, c, header, direction): the different texts of the header rows over a column, a spanning one for all its columns."""
    head = parsed.where("is_header")
    left = Window.partitionBy("doc_id", "tbl", "r").orderBy("c")
    text = F.last(F.when(~F.col("spanned"), T.clean_cell(F.col("raw"))), ignorenulls=True).over(left)
    named = head.select("doc_id", "tbl", "c", "r", "caption", text.alias("text"))
    columns = named.groupBy("doc_id", "tbl", "c").agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("r", "text")))).alias("t"), F.first("caption").alias("caption"))
    header = F.array_join(F.array_distinct(F.transform("t", lambda x: x["text"])), " | ")
    columns = columns.select("doc_id", "tbl", "c", header.alias("header"), T.clean_cell(F.col("caption")).alias("caption"))
    return columns.select("doc_id", "tbl", "c", "header", T.metric_direction(F.col("header"), F.col("caption")).alias("direction"))


def body_rows(parsed: DataFrame) -> DataFrame:
    """(doc_id, tbl, r, name, own_name, row_group, cells): rows below the header with the group they belong to.

    A first cell over several rows names its group and, in the rows below, the row itself; a row that holds nothing but a first cell
    over several columns (and at most one more text) heads a group and is no row.
    """
    body = parsed.where("NOT is_header")
    text = T.clean_cell(F.col("raw"))
    kind = F.col("cell.kind")
    rest = (F.col("c") > 0) & (kind != "empty")
    rows = body.groupBy("doc_id", "tbl", "r").agg(
        F.max(F.when(F.col("c") == 0, F.struct(kind.alias("kind"), text.alias("text"), F.col("cell.printed").alias("printed"), "span", "over_rows"))).alias("first"),
        F.count_if(rest).alias("filled"), F.count_if(rest & (kind != "text")).alias("other"), F.array_sort(F.collect_list(F.struct("c", "raw", "cell"))).alias("cells"))
    own = F.when(F.col("first.kind") == "text", F.col("first.text")).when(F.col("first.kind") == "number", F.col("first.printed")).otherwise("")
    rows = rows.withColumn("own_name", own)
    heads = (F.col("first.span") > 1) & (((F.col("filled") == 0) & (own != "")) | ((F.col("filled") == 1) & (F.col("other") == 0)))
    named = F.when(heads, F.when(F.col("filled") == 0, own).otherwise(F.col("first.text"))).when((F.col("first.kind") == "text") & F.col("first.over_rows"), F.col("first.text"))
    order = Window.partitionBy("doc_id", "tbl").orderBy("r")
    rows = rows.withColumns({"heads": heads, "held": F.last(named, ignorenulls=True).over(order)}).where("NOT heads")
    name = F.when((F.col("first.kind") == "empty") & (F.coalesce("held", F.lit("")) != ""), F.col("held")).otherwise(F.col("own_name"))
    return rows.select("doc_id", "tbl", "r", name.alias("name"), "own_name", F.when(name.eqNullSafe(F.col("held")), F.lit(None)).otherwise(F.col("held")).alias("row_group"), "cells")
