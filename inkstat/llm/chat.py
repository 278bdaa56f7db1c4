"""Chat formatting by replaying an event log: partition by conversation, sort by sequence, fold, render.

Log: (conv_id, seq, kind, turn, role, text); ``turn`` is the place of the message that an event is about. Kinds:

* ``message``: a message opens with its role and, if it is already whole, its text; two of one turn are two messages
* ``delta``: text appended to the message; the first one opens it if nothing did
* ``edit``: its text replaces that of the message
* ``regenerate``: the message starts anew and empty, and all earlier events of later turns are void, because they answered what is gone

``fold_events`` gives the final messages, ``render`` the formatted conversation with its loss mask, ``parse``
reads the messages back. Only DataFrame functions are used.

Partitions: rows are dealt once by (conv_id, block of ``BLOCK_TURNS`` turns), and windows and groups lie inside
of that, so a conversation of any length is many small groups. A formatted row is one such block; only
``conversation_digests`` joins the blocks, since a digest is a value of the whole conversation.

Nulls: a null text is empty, a null role is an empty one, a null kind is ``message``; null conversations
are one conversation, null turns come first. Equal sequences are ordered by kind, role, text, and equal rows are two
messages. An event of an unknown kind changes nothing. An empty log gives an empty table. Columns besides the six are not read.

Template: ``<<SYS>>`` for system, ``[INST]`` for user, ``<s>`` for assistant, ``[ROLE] name [BODY]`` for any other role. A control
string inside a text gets a backslash behind its first character (one more if it has some), and parsing takes one
away, so every text comes back unchanged and no text can open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstat.llm.scratch import Scratch

BLOCK_TURNS = 256
# fixed values of the template: role, what opens a turn, what closes it
MARKS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s> ", " </s>"),
}
OTHER = ("[ROLE] ", " [BODY] ", " [/ROLE]")
# a control string, also one that is already escaped: its first character, backslashes, the rest
CONTROL = r"([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|BODY\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|BODY\])"
TURN = r"(?s)<<SYS>>\n.*?\n<</SYS>>\n\n|\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE\] .*? \[BODY\] .*? \[/ROLE\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def block_of(turn: str = "turn") -> Column:
    """Blocks of turns keep the order of turns; null turns are a block in front of all."""
    return F.floor(F.col(turn) / BLOCK_TURNS).cast("long")


def as_log(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of whole messages as a log."""
    return rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, block, turn, nth, role, text): the messages that stand at the end of the log, ``nth`` numbers those of one turn."""
    known = F.coalesce("kind", F.lit("message"))
    log = log.select("conv_id", block_of().alias("block"), "turn", "seq", known.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # per turn the last regeneration of an earlier one: a running maximum over the few turns that matter
    redone = log.where("kind = 'regenerate'").groupBy("conv_id", "turn").agg(F.max("seq").alias("redone"))
    hit = redone.select(F.col("conv_id").alias("c")).distinct()
    turns = log.select("conv_id", "turn").join(hit, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").distinct().join(redone.withColumnsRenamed({"conv_id": "c", "turn": "t"}), F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    void = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.max("redone").over(before).alias("void")).where("void IS NOT NULL")
    live = log.join(void, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left").where("void IS NULL OR seq > void").drop("c", "t", "void")
    place = ("conv_id", "block", "turn")
    rank = F.expr("CASE kind WHEN 'message' THEN 0 WHEN 'regenerate' THEN 1 WHEN 'edit' THEN 2 ELSE 3 END")
    order = [F.col("seq").asc_nulls_first(), rank, "role", "text"]
    so_far = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    steps = live.where("kind IN ('message', 'delta', 'edit', 'regenerate')").repartition("conv_id", "block")
    opened = F.count_if(F.col("kind") == "message").over(so_far)
    # what comes before the first message event belongs to the first message
    steps = steps.withColumns({"nth": F.greatest(opened, F.lit(1)), "version": F.count_if(F.col("kind") != "delta").over(so_far), "step": F.row_number().over(Window.partitionBy(*place).orderBy(*order))})
    parts = F.array_sort(F.collect_list(F.struct("step", "text")))
    versions = steps.groupBy(*place, "nth", "version").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.min(F.when(F.col("role") != "", F.struct("step", "role"))).alias("named"))
    last = versions.groupBy(*place, "nth").agg(F.max(F.struct("version", "text"))["text"].alias("text"), F.min("named")["role"].alias("role"))
    return last.select(*place, "nth", F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, block, n_turns, formatted, loss): a row per block; ``loss`` lists the spans (start, end) of assistant texts, in code points."""
    role, text = F.col("role"), escape(F.col("text"))
    opening, closing = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (before, after) in MARKS.items():
        opening, closing = F.when(role == name, F.lit(before)).otherwise(opening), F.when(role == name, F.lit(after)).otherwise(closing)
    pieces = messages.withColumns({"opening": opening, "body": text, "closing": closing})
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "nth").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.length("opening") + F.length("body") + F.length("closing")).over(inside)
    end = upto - F.length("closing")
    span = F.when(role == "assistant", F.struct((end - F.length("body")).alias("start"), end.alias("end")))
    pieces = pieces.select("conv_id", "block", "turn", "nth", F.concat("opening", "body", "closing").alias("piece"), span.alias("span"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("late"), "turn", "nth", "piece", "span")))
    blocks = pieces.groupBy("conv_id", "block").agg(rows.alias("rows"))
    return blocks.select("conv_id", "block", F.size("rows").cast("long").alias("n_turns"), F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), F.array_compact(F.transform("rows", lambda r: r["span"])).alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted block: array of struct(role, text)."""

    def inner(turn: Column, before: str, after: str) -> Column:
        return F.substring(turn, F.lit(len(before) + 1), F.length(turn) - (len(before) + len(after)))

    def one(turn: Column) -> Column:
        whole = inner(turn, OTHER[0], OTHER[2])
        name = F.substring_index(whole, OTHER[1], 1)
        out = F.struct(unescape(name).alias("role"), unescape(F.substring(whole, F.length(name) + (len(OTHER[1]) + 1), F.length(whole))).alias("text"))
        for name, (before, after) in MARKS.items():
            out = F.when(F.startswith(turn, F.lit(before)), F.struct(F.lit(name).alias("role"), unescape(inner(turn, before, after)).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), one)


def masked_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def format_chats(log: DataFrame) -> DataFrame:
    """The formatted blocks of all conversations of a log, written once to the shared folder and read from there."""
    return Scratch(log.sparkSession).save(render(fold_events(log)), "chats")


def conversation_digests(chats: DataFrame) -> DataFrame:
    """Per conversation what its formatted blocks say when they are parsed again: turns, text under the mask, digests, length.

    A digest is taken over the whole conversation, so its blocks, already joined turns, meet in one row.
    """
    turns = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chats.select("conv_id", "block", F.col("n_turns"), turns.alias("turns"), masked_text(F.col("formatted"), F.col("loss")).alias("loss"), F.length("formatted").cast("long").alias("chars"))
    read = read.select("conv_id", F.struct(F.col("block").isNotNull().alias("late"), "block", F.array_join("turns", "").alias("turns"), "loss").alias("part"), F.size("turns").cast("long").alias("n_turns"), "chars")
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("parts", lambda p: p["turns"]), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
