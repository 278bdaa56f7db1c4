"""Chat formatting, vector codes and tokenizer alignment against plain models on small, awkward inputs."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkstat.llm import align, chat, codes
from inkstat.llm import queries as Q

LOG = "conv_id long, seq long, kind string, turn long, role string, text string"


def turns_of(spark, events):
    chats = chat.format_chats(spark.createDataFrame(events, LOG))
    out = {}
    for r in chats.select("conv_id", "block", chat.parse(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("loss"), "n_turns").orderBy("conv_id", "block").collect():
        turns, loss = out.setdefault(r.conv_id, ([], []))
        assert r.n_turns == len(r.t)
        turns.extend((t.role, t.text) for t in r.t)
        loss.append(r.loss)
    return {c: (t, "".join(x)) for c, (t, x) in out.items()}


def replay(events):
    """A serial model of the log."""
    state = {}
    kinds = {"message": 0, "regenerate": 1, "edit": 2, "delta": 3}
    for conv, _, kind, turn, role, text in sorted(events, key=lambda e: (e[1], kinds[e[2]], e[4] or "", e[5] or "")):
        talk = state.setdefault(conv, {})
        if kind == "message":
            talk.setdefault(turn, []).append([role or "", text or ""])
            continue
        if turn not in talk:
            talk[turn] = [["", ""]]
        last = talk[turn][-1]
        last[0] = last[0] or role or ""
        last[1] = last[1] + (text or "") if kind == "delta" else (text or "")
        if kind == "regenerate":
            for later in [t for t in talk if t > turn]:
                del talk[later]
    return {c: ([tuple(m) for t in sorted(talk) for m in talk[t]], "".join(m[1] for t in sorted(talk) for m in talk[t] if m[0] == "assistant")) for c, talk in state.items()}


def test_log_is_replayed(spark):
    rng, words = random.Random(5), ["</s>", "[INST]", " [/INST]", "<<SYS>>\n", "\\", "<\\s>", "[\\\\BODY] ", "é", "\n", " ", "<", "[", "<s>", "ok", "[ROLE] ", "😀"]
    events = []
    for conv in range(60):
        seq, turns = 0, 0
        for _ in range(rng.randint(1, 25)):
            text = "".join(rng.choices(words, k=rng.randint(0, 6)))
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"]) if turns else "message"
            turn = turns if kind == "message" else rng.randrange(turns)
            turns = turn + 1 if kind in ("message", "regenerate") else turns
            events.append((conv, seq, kind, turn, rng.choice(["user", "assistant", "system", "tool [BODY] x"]) if kind == "message" else None, text))
            seq += 1
    rng.shuffle(events)
    assert turns_of(spark, events) == replay(events)


def test_streamed_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", ""), (1, 2, "delta", 1, None, "he"), (1, 3, "delta", 1, None, "llo"),
        (1, 4, "message", 2, "user", "more"), (1, 5, "delta", 3, "assistant", "long"), (1, 6, "edit", 0, None, "hey"),
        (1, 7, "regenerate", 1, None, None), (1, 8, "delta", 1, None, "yes"), (1, 9, "message", 2, "user", "why"), (1, 10, "noise", 2, "user", "?"),
    ]
    assert turns_of(spark, events) == {1: ([("user", "hey"), ("assistant", "yes"), ("user", "why")], "yes")}


def test_long_conversations_are_many_rows(spark):
    events = [(7, t, "message", t, ("user", "assistant")[t % 2], f"t{t}") for t in range(1000)]
    chats = chat.format_chats(spark.createDataFrame(events, LOG))
    assert chats.count() == 4 and chats.agg(F.max("n_turns")).first()[0] == 256
    got = chat.conversation_digests(chats).first()
    assert got.n_turns == 1000 and got.turns_sha256 == hashlib.sha256("".join(f"{e[4]}\n{e[5]}\n" for e in events).encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256("".join(e[5] for e in events if e[4] == "assistant").encode()).hexdigest()


def test_chat_awkward_rows(spark, tmp_path):
    rows = [(None, None, None, None), (None, 0, "user", None), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, None, "user", "</s>"), (4, 0, "", ""), (5, 0, "assistant", "z" * 200_000), (5, 1, "user", "[\\/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1)).withColumn("seq", F.lit("x"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in Q.op11_chat_format(spark, str(tmp_path)).collect()}
    want = {None: [("", ""), ("user", "")], 3: [("user", "</s>"), ("assistant", "x"), ("assistant", "x")], 4: [("", "")], 5: [("assistant", "z" * 200_000), ("user", "[\\/INST]")], -1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    assert got.keys() == want.keys()
    for key, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[key].n_turns, got[key].loss_chars) == (len(turns), len(loss))
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[key].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in Q.op11_chat_format(spark, f"{tmp_path}/none").collect()] == [-1]


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds; rows (vec_id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, j: v[j * width:(j + 1) * width]
    books = [[cut(v, j) for _, v, _ in kept[:entries]] for j in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(near(cut(v, j), books[j])[1], []).append(cut(v, j))
            books[j] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[j])]
    out = []
    for i, v, label in kept:
        best = [near(cut(v, j), books[j]) for j in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    total = Counter()
    for r in out:
        total[r[1]] += r[3]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, code, error, total[label], digest) for i, label, code, error in out), key=str)


@pytest.mark.parametrize("size", [5, 16, 300])
def test_vector_codes_against_plain_rounds(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [(rng.randrange(10 ** 6), [rng.choice((0.0, 0.25, -0.125, rng.gauss(0, 1))) for _ in range(16)], rng.choice((None, 1, 2))) for _ in range(size)]
    rows += [rows[0], (None, rows[1][1], None), (-5, None, 1), (-4, [float("nan")] * 16, 1), (-3, [None] + [0.5] * 15, 2), (-2, [float("inf")] * 16, None)]
    rows += [(9, [0.5] * 16, 3)] * (size // 2)  # a common vector
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(rows, schema).repartition(4).withColumn("position", F.lit("x")).withColumn("error", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    exact = spark.createDataFrame(rows, schema).collect()  # as 32-bit numbers
    got = sorted((tuple(r) for r in Q.op12_vector_codes(spark, str(tmp_path)).collect()), key=str)
    assert got == lloyd([tuple(r) for r in exact])


def test_vector_codes_of_odd_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert Q.op12_vector_codes(spark, f"{tmp_path}/a").count() == 0
    rows = [(1, [1.0] * 8, 1), (2, [], 1), (3, [1.0] * 7, 1), (4, [2.0] * 16, 1), (5, [3e38] * 8, None), (6, [-3e38] * 8, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    got = {r.vec_id: r for r in Q.op12_vector_codes(spark, f"{tmp_path}/b").collect()}
    assert set(got) == {1, 5, 6} and all(r.error == 0 for r in got.values())


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "a\t b  c\r\n d", "<|endoftext|>", "x <|endoftext|> y", "</s> <s> <unk> <0x0A>", "▁", "a▁b c", "a ▁ b",
    "naïve façade Ünïcödé", "日本語 の テキスト", "😀 👩‍👩‍👧 é ﬁ ａ", " a  b c", "\x00 \x1c a\x1cb \x85", "it's don't  we'll 'S", "1234567 12 3.14", "a" * 5000, "ab " * 3000, "​ ﻿ x", "x\u0085 y", "\x1f y \x1f",
]


def model(texts):
    """Rows (n_a, n_b, groups, links) by whole-text tokenisation and a byte-by-byte merge."""
    p = align.pairs_of(A, B)
    out = []
    for text in texts:
        spelled = (" " + (text or "")).encode()
        a, b = p.a.encode(" " + (text or ""), add_special_tokens=False).ids, p.b.encode(text or "")
        if not text or b"".join(p.a_bytes[i] for i in a) != spelled or b"".join(p.b_bytes[i] for i in b) != spelled:
            out.append((0, 0, [], []))
            continue
        ends = lambda ids, of: {sum(len(of[i]) for i in ids[:k + 1]): k for k in range(len(ids))} if len(ids) < 400 else running(ids, of)
        ea, eb = ends(a, p.a_bytes), ends(b, p.b_bytes)
        groups, links, i0, j0 = [], [], 0, 0
        for at in sorted(ea.keys() & eb.keys()):
            i, j = ea[at], eb[at]
            groups.append(",".join(map(str, a[i0:i + 1])) + "|" + ",".join(map(str, b[j0:j + 1])))
            links.append((a[i], b[j]))
            i0, j0 = i + 1, j + 1
        out.append((len(a), len(b), groups, links))
    return out


def running(ids, of):
    at, out = 0, {}
    for k, i in enumerate(ids):
        at += len(of[i])
        out[at] = k
    return out


def test_alignment_against_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    letters = ["a", "the", " ", " ", "  ", "\n", "\t", ".", ",", "é", "ß", "日", "😀", "▁", "'s", "7", "-", "<s>", " ", " ", "\x1c", "Z", "ing"]
    texts = AWKWARD + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(400)]
    spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).withColumn("links", F.lit(1)).withColumn("groups", F.lit("g")).write.parquet(f"{tmp_path}/documents.parquet")
    want = model(texts)
    count = Counter(x for *_, links in want for x in links)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    rows = []
    for i, (n_a, n_b, groups, links) in enumerate(want):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        rows.append((i if i % 7 else None, n_a, n_b, len(groups), digest, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links)))
    got = Q.op13_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, rows))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert Q.op13_token_alignment(spark, f"{tmp_path}/none").count() == 0


def test_memories_start_anew(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(200)) for _ in range(30)]
    texts[3] += "  two"
    want = [(a, b, ";".join(groups)) for a, b, groups, _ in model(texts)]
    monkeypatch.setattr(align, "CACHE", 150)
    small = align.Aligner(align.pairs_of(A, B))
    assert [x[:3] for n in range(0, 30, 2) for x in small.documents(texts[n:n + 2])] == want
    monkeypatch.setattr(align.pairs_of(A, B), "apart", False)
    assert [x[:3] for x in align.Aligner(align.pairs_of(A, B)).documents(texts)] == want
    assert len(align.pairs_of(A, B).keys) < 1_000_000
