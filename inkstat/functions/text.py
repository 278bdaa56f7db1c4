"""Column functions over raw text: cleaning, views, sentences, tokens, number cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstat.functions import patterns as P

MARK = "\u0001"



def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Nested references to one long expression would otherwise be inlined into generated code at
    every use and can exceed the method size limit.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --------------------------------------------------------------------------- views
# The pattern chains below are fixed values: their order and wording decide the views.


def chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) pairs in order."""
    for pattern, replacement in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text


def strip_comments(text: Column) -> Column:
    """Drop an unescaped % and the rest of its line."""
    return F.regexp_replace(text, r"(?<!\\)%[^\n]*", "")


def strip_comments_pairs(text: Column) -> Column:
    """Variant that reads backslash pairs, so that a doubled backslash does not protect the %."""
    return F.regexp_replace(text, r"(?m)^((?:\\[^\n]|[^\\%\n])*+)%[^\n]*", "$1")


def environment_steps(envs: list[str], replacement: str) -> list[tuple[str, str]]:
    """One removal per environment; the plain and the starred form close each other only."""
    out = []
    for e in envs:
        for star in ("", r"\*"):
            out.append((rf"(?s)\\begin\{{{e}{star}\}}.*?\\end\{{{e}{star}\}}", replacement))
    return out


# Fixed values of the running prose: what is cut out, what becomes an alphabetic sentinel, which macros keep their argument.
VERBATIM_ENVS = ("tcolorbox tcblisting lstlisting verbatim Verbatim minted mdframed framed alltt promptbox listing boxedverbatim shaded "
                 "tabbing exampleblock prompt chat dialogue quote quotation verse lstinputlisting").split()
STARRED_FLOATS = "figure table algorithm sidewaystable tabular".split()
STARRED_MATH = "equation align gather multline eqnarray flalign alignat".split()
LIST_ENVS = "itemize enumerate description abstract quote center compactitem compactenum".split()


def any_of(names: list[str], starred: list[str] = ()) -> str:
    return "|".join(n + (r"\*?" if n in starred else "") for n in names)


VERBATIM_BLOCK = rf"(?s)\\begin\{{({any_of(VERBATIM_ENVS)})\*?\}}(?:\[[^\]]*\])?.*?\\end\{{\1\*?\}}"
FLOAT_BLOCK = rf"(?s)\\begin\{{({any_of(P.FLOAT_ENVS, STARRED_FLOATS)})\}}.*?\\end\{{\1\}}"
MATH_BLOCK = rf"(?s)\\begin\{{({any_of(P.MATH_ENVS, STARRED_MATH)})\}}.*?\\end\{{\1\}}"
# a reference macro whose name is not one of the look-alikes
REF_CALL = rf"\\(?![A-Za-z]*(?:(?i:{P.REF_BLACKLIST.removeprefix('(?i)').replace('name$', 'name(?![A-Za-z])')})))[A-Za-z]*[Rr]ef[A-Za-z]*\s*(?:\{{[^{{}}]*\}}\s*)+"

PROSE_STEPS: list[tuple[str, str]] = [
    (r"% MISSING INPUT[^\n]*", " "),
    (VERBATIM_BLOCK, " xxverbatimxx "),
    (FLOAT_BLOCK, " "),
    (MATH_BLOCK, " xxmathxx "),
    (r"(?s)\$\$.*?\$\$", " xxmathxx "),
    (r"(?s)\\\[.*?\\\]", " xxmathxx "),
    (r"\$[^$]*\$", " xxmathxx "),
    (P.CITE, " xxcitexx "),
    (REF_CALL, " xxrefxx "),
    (r"\\(?:SetKw[A-Za-z]*|SetAlgo[A-Za-z]*|DontPrintSemicolon|newcommand|renewcommand|providecommand|DeclareMathOperator|newtheorem|newenvironment|"
     r"definecolor|setcounter|addtocounter|newcounter|pagestyle|thispagestyle)\*?\s*(?:" + P.BRACED_NC + r"\s*){1,4}(?:\[[^\]]*\])?", " "),
    (r"\\(?:label|includegraphics|vspace|hspace|footnote|footnotemark|caption|newline|centering|noindent|graphicspath|bibliography|"
     r"bibliographystyle|maketitle|setlength|linewidth|input|include)\*?\s*(?:\[[^\]]*\])?\s*(?:" + P.BRACED_NC + ")?", " "),
    (r"\\(?:sub)*section\*?\s*(?:\[[^\]]*\])?" + P.BRACED, "\n\n$1.\n\n"),
    (r"\\paragraph\*?" + P.BRACED, "\n\n$1. "),
    (rf"\\begin\{{(?:{any_of(LIST_ENVS)})\}}(?:\s*\[[^\]]*\])?|\\end\{{(?:{any_of(LIST_ENVS)})\}}", "\n"),
    (r"\\item\b", "\n"),
    (r"\\begin\{[A-Za-z*]+\}\s*(?:\[[^\]]*\])?(?:\{[^{}]*\})?|\\end\{[A-Za-z*]+\}", "\n"),
    (r"\\(?:emph|textbf|textit|texttt|textsc|underline|text|mathrm|textrm|textnormal|small|footnotesize|url|texorpdfstring|mbox)\*?\s*" + P.BRACED, "$1"),
    (r"\\[A-Za-z]+\*?\s*(?:\[[^\]]*\])?", " "),
    (r"[{}~]", " "),
    (r"\\%", "%"),
    (r"\\&", "&"),
    (r"[ \t]{2,}|\t", " "),  # a single blank stays where it is
    (r"\n{3,}", "\n\n"),
]

# flat view for text detectors
FLAT_STEPS: list[tuple[str, str]] = [
    *environment_steps(["figure", "table", "algorithm", "algorithmic", "tikzpicture"], " "),
    (r"\\caption\s*(?:\[[^\]]*\])?\s*\{", " [CAPTION] "),
    (r"(?s)\$\$.*?\$\$", " [MATH] "),
    (r"\$[^$\n]{0,400}\$", " [MATH] "),
    (r"\\cite[a-zA-Z]*\*?\s*(?:\[[^\]]*\]\s*){0,2}\{[^}]*\}", " [CITE] "),
    (r"\\(?:auto|c|C|eq)?ref\*?\{[^}]*\}", " [REF] "),
    (r"\\(?:section|subsection|subsubsection)\*?\{([^}]*)\}", "\n\n## $1\n"),
    (r"\\(?:label|includegraphics|url|href)\s*(?:\[[^\]]*\])?\s*\{[^}]*\}", " "),
    (r"\\begin\{[^}]*\}|\\end\{[^}]*\}", " "),
    (r"\\[a-zA-Z@]+\*?", " "),
    (r"[{}~]", " "),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
]

DETEX_STEPS: list[tuple[str, str]] = [
    *environment_steps(["figure", "table", "tabular", "equation", "align", "algorithm", "lstlisting", "verbatim", "thebibliography",
                        "tikzpicture", "subfigure", "wrapfigure", "minipage"], " "),
    (r"(?s)\$\$.*?\$\$", " "),
    (r"\$[^$]{0,400}?\$", " "),
    (r"\\(?:cite[a-zA-Z]*|ref|eqref|label|autoref|citep|citet)\s*\{[^}]*\}", " "),
    (r"\\(?:section|subsection|subsubsection|paragraph|title)\*?\s*\{([^}]*)\}", " $1. "),
    (r"\\(?:textbf|textit|emph|texttt|textsc|mbox|text)\s*\{([^}]*)\}", "$1"),
    (r"\\[a-zA-Z@]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?", " "),
    (r"~", " "),
    (r"[{}\\]", " "),
    (r"[ \t]+", " "),
    (r"\n\s*\n+", "\n\n"),
]

MARKDOWN_STEPS: list[tuple[str, str]] = [
    (r"(?s)```.*?```", " "),
    (r"(?s)\$\$.*?\$\$", " "),
    (r"\$[^$]{0,400}?\$", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"(?m)^[ \t]*\|[^\n]*\|[ \t]*$", " "),
    (r"(?m)^#+[ \t]*", ""),
    (r"[*_`>]", ""),
    (r"[ \t]+", " "),
    (r"\n\s*\n+", "\n\n"),
]


def prose_view(tex: Column) -> Column:
    return chain(tex, PROSE_STEPS)


def flat_view(tex: Column) -> Column:
    return F.regexp_replace(chain(tex, FLAT_STEPS), r"^\s+|\s+$", "")


def detex(tex: Column) -> Column:
    return F.regexp_replace(chain(strip_comments(tex), DETEX_STEPS), r"^\s+|\s+$", "")


def demarkdown(text: Column) -> Column:
    return F.regexp_replace(chain(text, MARKDOWN_STEPS), r"^\s+|\s+$", "")


def accepted_text(tex: Column, markdown: Column, min_length: int = 2000) -> Column:
    """The detexed source if long enough, else the cleaned markdown, with its origin tag."""
    a, b = detex(tex), demarkdown(markdown)
    return F.when(F.length(a) > min_length, F.struct(a.alias("text"), F.lit("tex").alias("origin"))).when(
        F.length(b) > min_length, F.struct(b.alias("text"), F.lit("ocr").alias("origin")))


def abstract_of(tex: Column) -> Column:
    return F.regexp_extract(tex, r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", 1)


def body_of(tex: Column) -> Column:
    """Text between \\begin{document} and the first appendix / acknowledgement / bibliography."""
    start = F.regexp_replace(tex, r"(?s)^.*?\\begin\{document\}", "")
    return F.regexp_replace(start, "(?s)(?:" + P.BODY_END.replace("(?i)", "(?i:") + ")).*$", "")


# --------------------------------------------------------------------------- titles


def clean_title(title: Column) -> Column:
    t = F.regexp_replace(title, r"\\label\s*\{[^{}]*\}", " ")
    t = F.regexp_replace(t, r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " ")
    t = F.regexp_replace(t, r"[{}$~]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Ordered rules: the name of the first pattern found in the text."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def role_of(title: Column) -> Column:
    return first_match(F.lower(clean_title(title)), P.ROLES, "Other")


def slot_of(title: Column, role: Column) -> Column:
    return F.when((role == "Abstract") | title.rlike(P.SUMMARY_SLOT), "summary").when(title.rlike(P.STATEMENT_SLOT), "statement").otherwise("body")


def normalize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "))


def normalize_quote(text: Column) -> Column:
    """Lower case, macros and everything but letters, digits and % to single blanks."""
    t = F.regexp_replace(F.lower(text), r"\\[a-z]+\*?", " ")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9%]+", " "))


# --------------------------------------------------------------------------- sentences and tokens


def sentences(paragraph: Column) -> Column:
    """Split after . ! ? before an opening character, except after a protected abbreviation."""
    cut = rf"(?<=[.!?])(?<!(?i:\b(?:{P.ABBREVIATIONS})\.))\s+(?={P.SENTENCE_START})"
    return F.filter(F.transform(F.split(paragraph, cut), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\n+"), lambda p: ~p.rlike(r"^\s*$"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.TOKEN), F.lit(0))


def content_tokens(toks: Column) -> Column:
    """Tokens that are neither stop words, numbers nor sentinels."""
    return F.filter(toks, lambda t: ~F.lower(t).isin([*P.STOP_WORDS, *P.SENTINELS]) & ~t.rlike(r"^\d"))


def grams(toks: Column, n: int) -> Column:
    """Word n-grams joined by blanks; empty for short input."""
    return let(toks, lambda w: F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda p: F.array_join(F.slice(w, p, n), " ")),
    ).otherwise(F.array().cast("array<string>")))


def cite_keys(text: Column) -> Column:
    """Cite groups in order: an array of arrays of keys."""
    groups = F.regexp_extract_all(text, F.lit(P.CITE), F.lit(1))
    return F.transform(groups, lambda g: F.filter(F.split(g, r"[,\s]+"), lambda k: k != ""))


# --------------------------------------------------------------------------- table cells


def clean_cell(cell: Column) -> Column:
    marked = chain(cell, [
        (r"\\(?:textbf|mathbf|bm|textit|emph|underline|textsc|texttt|text|mathrm)\s*" + P.BRACED, "$1"),
        (r"\\(?:cellcolor|rowcolor|color)\s*(?:\[[^\]]*\])?\{[^}]*\}", " "),
        (r"\\(?:phantom|hphantom)\{[^}]*\}", " "),
        (r"\\%", "%"), (r"\\&", "&"), (r"~", " "),
        (r"\\[a-zA-Z]+\*?", " "),
        (r"[{}$]", " "),
    ])
    # most cells hold none of what the steps look for
    return F.trim(F.regexp_replace(F.when(cell.rlike(r"[\\{}$~]"), marked).otherwise(cell), r"\s+", " "))


NUMBER = r"([-+]?\d+(?:\.\d+)?)"
PM = NUMBER + r"\s*(?:\$?\\pm\$?|±|\\textpm|\+/-|\+-)\s*\{?\s*" + NUMBER
PM_SUB = NUMBER + r"\s*_\{\s*\\pm\s*" + NUMBER + r"\s*\}"
PAREN = NUMBER + r"\s*\(\s*" + NUMBER + r"\s*\)"
PLAIN = r"(?:^|[^\w.])([-+]?\d+(?:\.\d+)?)(?:$|[^\w.])"


def number_cell(raw: Column) -> Column:
    """struct(kind, value, printed, std, is_bold, is_percent) of one table cell."""

    def found(text: Column, pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))

    def parse(clean: Column) -> Column:
        unbracketed = F.regexp_replace(clean, r"\[[^\]]*\]", " ")

        def plain(bare: Column) -> Column:
            count = F.size(F.regexp_extract_all(F.regexp_replace(bare, r"\s", "  "), F.lit(PLAIN), F.lit(1)))
            word = F.regexp_replace(unbracketed, r"\b(?:k|M|B|ms|s|x|X|pp|std|avg)\b", "").rlike(r"[A-Za-z]{3,}")
            numeric = bare.rlike(r"^[\s\d.\-+/%()xX×↑↓*†‡]*$")
            return F.when(((count == 1) & ~word) | ((count >= 1) & numeric), found(bare, PLAIN, 1))

        # a pattern is tried only on cells with the characters it needs
        spread = raw.contains("pm") | raw.contains("±") | raw.contains("+/-") | raw.contains("+-")
        either = lambda group: F.coalesce(
            F.when(spread, F.coalesce(found(raw, PM, group), found(raw, PM_SUB, group))), F.when(clean.contains("("), found(clean, PAREN, group)))
        printed = F.when(raw.rlike(r"\d"), F.coalesce(either(1), let(F.regexp_replace(unbracketed, ",", ""), plain)))
        std = either(2)
        return let(printed, lambda p: F.struct(
            F.when(F.trim(raw) == "", "empty").when(p.isNotNull(), "number").otherwise("text").alias("kind"),
            p.cast("double").alias("value"), p.alias("printed"), F.when(p.isNotNull(), std).cast("double").alias("std"),
            (raw.contains("\\") & raw.rlike(r"\\(?:textbf|mathbf|bm)\b")).alias("is_bold"), raw.contains("%").alias("is_percent"),
        ))

    return let(clean_cell(raw), parse)


def half_unit(printed: Column) -> Column:
    """Half of the last printed digit."""
    digits = F.length(F.regexp_extract(printed, r"\.(\d*)$", 1))
    return F.lit(0.5) * F.pow(F.lit(10.0), -digits)


def metric_direction(header: Column, caption: Column) -> Column:
    """+1 / -1 / null: arrows, then the lexicon of one side only, then the caption."""

    def decide(h: Column, c: Column) -> Column:
        low, high = h.rlike(P.METRIC_LOWER), h.rlike(P.METRIC_HIGHER)
        return (
            F.when(h.contains("↓") | h.rlike(r"downarrow|\(lower|lower is better"), -1)
            .when(h.contains("↑") | h.rlike(r"uparrow|\(higher|higher is better"), 1)
            .when(low & ~high, -1).when(high & ~low, 1)
            .when(c.rlike("lower is better|downarrow") & ~c.contains("higher is better"), -1)
            .when(c.rlike("higher is better|uparrow") & ~c.contains("lower is better"), 1)
        )

    return let(F.lower(header), lambda h: let(F.lower(caption), lambda c: decide(h, c)))


def ratio_score(numerator: Column, denominator: Column, min_units: int = 3) -> list[Column]:
    """score (null on a zero denominator), its two counts, and the weak flag."""
    return [
        F.when(denominator > 0, numerator / denominator).alias("score"),
        numerator.alias("numerator"), denominator.alias("denominator"), (F.coalesce(denominator, F.lit(0)) < min_units).alias("weak"),
    ]
