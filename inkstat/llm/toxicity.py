"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters in two ways: a bidirectional recurrent pass over its characters (bytes), and a
learned vector of its hash. A second bidirectional pass runs over the words of a window,
attention weighs its states, and one unit gives the window's probability. Windows of ``WINDOW``
words overlap by ``WINDOW - STEP`` and cover the whole text; the text's score is the largest.
Words of more than ``WORD_BYTES`` bytes enter as several.

Learned on about ``TOXIC`` and ``CLEAN`` labelled texts of at most ``LEARN_BYTES`` bytes (the
driver holds at most their product), clean ones weighing ``CLEAN_WEIGHT``. Only texts are labelled, so each round learns from the window
that the network finds most toxic in every text, besides random ones of clean texts.

Nulls: a null or empty text is scored as a window without a word; rows without doc_id are scored,
not learned from, and not held out. With one label the score is that label, with none 0.5.
Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstat.llm import text as X
from inkstat.llm.learning import Adam, learning_rows, scored_schema, sigmoid
from inkstat.llm.scratch import small_batches

WORD_BYTES = 16
WINDOW, STEP = 32, 26
CHAR_EMBED, CHAR_STATE, WORD_EMBED, BUCKETS, STATE, ATTEND = 8, 10, 6, 4096, 8, 6
LEARN_BYTES = 16384
TOXIC, CLEAN, CLEAN_WEIGHT = 1200, 3000, 3.0
KNOWN = 200_000


class Words:
    """Words of several texts: distinct ones with their bytes, and for every word the distinct one's number."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        starts, sizes, hashes, first = X.words(buf, offs, X.ALNUM)
        long = sizes > WORD_BYTES
        if long.any():  # cut long words; the hash of a part is that of the word and its number
            parts = -(-sizes // WORD_BYTES)
            row = np.repeat(np.arange(len(sizes)), parts)
            k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            hashes = np.where(long[row], X.mix(hashes[row] + k.astype(np.uint64)), hashes[row])
            starts, sizes = starts[row] + k * WORD_BYTES, np.minimum(WORD_BYTES, sizes[row] - k * WORD_BYTES)
            first = np.concatenate([[0], np.cumsum(parts)])[first]
        self.first = first
        self.hashes, at, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.sizes = sizes[at]
        spot = starts[at][:, None] + np.arange(WORD_BYTES)
        inside = np.arange(WORD_BYTES) < self.sizes[:, None]
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        self.bytes = np.where(inside, low[buf[np.where(inside, spot, 0)]], 0).astype(np.uint8) if len(buf) else np.zeros((0, WORD_BYTES), np.uint8)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and size of every window, and the first window of every row; a row without words has one of size 0."""
        n = np.diff(self.first)
        per_row = np.maximum(1, -(-np.maximum(n - (WINDOW - STEP), 0) // STEP))
        first = np.concatenate([[0], np.cumsum(per_row)])
        row = np.repeat(np.arange(len(n)), per_row)
        at = self.first[:-1][row] + (np.arange(first[-1]) - first[:-1][row]) * STEP
        return at, np.minimum(WINDOW, self.first[1:][row] - at), first


def forward(x: np.ndarray, u: np.ndarray, n: np.ndarray, keep: bool):
    """States (time x rows x state) of a gated recurrent unit; rows end after ``n`` steps and hold their state.

    ``x`` (time x rows x 3 states) has the projected inputs of the reset and update gates and of
    the candidate. With ``keep`` the gates are returned for the backward pass.
    """
    steps, rows, width = x.shape
    k = width // 3
    h = np.zeros((rows, k), np.float32)
    states, kept, full = np.empty((steps, rows, k), np.float32), [], int(n.min(initial=steps))
    for t in range(steps):
        hu = h @ u
        gates = sigmoid(x[t, :, : 2 * k] + hu[:, : 2 * k])
        new = gates[:, :k] * hu[:, 2 * k :]
        new += x[t, :, 2 * k :]
        np.tanh(new, out=new)
        z = gates[:, k:] * (t < n)[:, None] if keep or t >= full else gates[:, k:]
        if keep:
            kept.append((h, hu[:, 2 * k :], gates, new, z))
        h = h + z * (new - h)
        states[t] = h
    return states, kept


def backward(grad: np.ndarray, last: np.ndarray, u: np.ndarray, n: np.ndarray, kept) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u`` from those of all states, and of the last one."""
    k = u.shape[0]
    dx = np.zeros((len(kept), grad.shape[1] if grad is not None else len(last), 3 * k), np.float32)
    du, dh = np.zeros_like(u), last.copy()
    for t in range(len(kept) - 1, -1, -1):
        h, hn, gates, new, z = kept[t]
        if grad is not None:
            dh += grad[t]
        r, live = gates[:, :k], (t < n)[:, None]
        dz = dh * (new - h) * live * gates[:, k:] * (1 - gates[:, k:])
        da = dh * z * (1 - new * new)
        dr = da * hn * r * (1 - r)
        dx[t] = np.concatenate([dr, dz, da], 1)
        side = np.concatenate([dr, dz, da * r], 1)
        du += h.T @ side
        dh = dh * (1 - z) + side @ u.T
    return dx, du


class Network:
    """Parameters, scoring and gradients."""

    def __init__(self, seed: int = 23):
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)

        joint = 2 * CHAR_STATE + WORD_EMBED
        self.p = {"chars": normal(256, CHAR_EMBED) * 16, "words": np.zeros((BUCKETS, WORD_EMBED), np.float32), "att": normal(2 * STATE, ATTEND), "att_b": np.zeros(ATTEND, np.float32), "att_v": normal(ATTEND, 1), "out": normal(2 * STATE, 1), "out_b": np.full(1, -1.0, np.float32)}
        for d in "fb":
            self.p |= {f"cw{d}": normal(CHAR_EMBED, 3 * CHAR_STATE), f"cb{d}": np.zeros(3 * CHAR_STATE, np.float32), f"cu{d}": normal(CHAR_STATE, 3 * CHAR_STATE), f"ww{d}": normal(joint, 3 * STATE), f"wb{d}": np.zeros(3 * STATE, np.float32), f"wu{d}": normal(STATE, 3 * STATE)}
        self.known = (np.empty(0, np.uint64), np.empty((0, 6 * STATE), np.float32))

    def turned(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Row-wise reversal of the first n entries."""
        at = np.arange(x.shape[1])
        spot = np.where(at < n[:, None], n[:, None] - 1 - at, at)
        return np.take_along_axis(x, spot, 1)

    def word_vectors(self, data: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, keep: bool = False):
        """(words x joint) inputs of the second pass from the bytes of words; shorter words leave the pass early."""
        ends, kept = [], []
        if keep:
            for d, chars in (("f", data), ("b", self.turned(data, sizes))):
                table = self.p["chars"] @ self.p[f"cw{d}"] + self.p[f"cb{d}"]
                states, gates = forward(table[chars.T], self.p[f"cu{d}"], sizes, True)
                ends.append(states[-1])
                kept.append((chars, gates))
        else:
            order = np.argsort(-sizes, kind="stable")
            live = np.searchsorted(-sizes[order], -np.arange(WORD_BYTES), "left")
            for d, chars in (("f", data), ("b", self.turned(data, sizes))):
                table, u = self.p["chars"] @ self.p[f"cw{d}"] + self.p[f"cb{d}"], self.p[f"cu{d}"]
                h, sorted_chars, k = np.zeros((len(data), CHAR_STATE), np.float32), chars[order], CHAR_STATE
                for t in range(WORD_BYTES):
                    m = int(live[t])
                    if not m:
                        break
                    hu, x = h[:m] @ u, table[sorted_chars[:m, t]]
                    gates = sigmoid(x[:, : 2 * k] + hu[:, : 2 * k])
                    h[:m] += gates[:, k:] * (np.tanh(x[:, 2 * k :] + gates[:, :k] * hu[:, 2 * k :]) - h[:m])
                end = np.empty_like(h)
                end[order] = h
                ends.append(end)
        bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        return np.concatenate([*ends, self.p["words"][bucket]], 1), bucket, kept

    def projected(self, words: Words) -> np.ndarray:
        """Inputs of both second passes for the distinct words; those met before come from a table of bounded size."""
        known, table = self.known
        at = np.minimum(np.searchsorted(known, words.hashes), max(0, len(known) - 1))
        found = known[at] == words.hashes if len(known) else np.zeros(len(words.hashes), bool)
        out = np.empty((len(words.hashes), 6 * STATE), np.float32)
        out[found] = table[at[found]]
        new = np.flatnonzero(~found)
        for a in range(0, len(new), 8192):
            pick = new[a : a + 8192]
            joint, _, _ = self.word_vectors(words.bytes[pick], words.sizes[pick], words.hashes[pick])
            out[pick] = np.concatenate([joint @ self.p["wwf"] + self.p["wbf"], joint @ self.p["wwb"] + self.p["wbb"]], 1)
        if len(known) < KNOWN and len(new):
            hashes = np.concatenate([known, words.hashes[new]])
            order = np.argsort(hashes)
            self.known = (hashes[order], np.concatenate([table, out[new]])[order])
        return out

    def attention(self, states: np.ndarray, n: np.ndarray):
        """Logits of windows from their states (time x rows x 2 STATE)."""
        key = np.tanh(states @ self.p["att"] + self.p["att_b"])
        weight = (key @ self.p["att_v"])[:, :, 0]
        weight = np.where(np.arange(len(states))[:, None] < np.maximum(n, 1), weight, -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = (states * weight[:, :, None]).sum(0)
        return (pooled @ self.p["out"] + self.p["out_b"])[:, 0], pooled, weight, key

    def both(self, xf: np.ndarray, xb: np.ndarray, n: np.ndarray, keep: bool = False):
        """States of both directions, each at its word's place; ``xb`` is already turned."""
        f, kf = forward(xf, self.p["wuf"], n, keep)
        b, kb = forward(xb, self.p["wub"], n, keep)
        b = np.take_along_axis(b, self.places(n)[:, :, None], 0)
        return np.concatenate([f, b], 2), kf, kb

    def places(self, n: np.ndarray) -> np.ndarray:
        """(time x rows) the turned place of every place."""
        at = np.arange(WINDOW)[:, None]
        return np.where(at < n, n - 1 - at, at)

    def window_logits(self, words: Words, at: np.ndarray, n: np.ndarray, group: int = 2048) -> np.ndarray:
        if not len(words.number):
            return np.full(len(at), self.attention(np.zeros((WINDOW, 1, 2 * STATE), np.float32), np.zeros(1, int))[0][0])
        both, out = self.projected(words), []
        tf, tb = np.ascontiguousarray(both[:, : 3 * STATE]), np.ascontiguousarray(both[:, 3 * STATE :])
        for a in range(0, len(at), group):
            m = n[a : a + group]
            time = np.arange(WINDOW)[:, None]
            f = words.number[np.minimum(at[a : a + group] + np.minimum(time, np.maximum(m - 1, 0)), len(words.number) - 1)]
            b = np.take_along_axis(f, self.places(m), 0)
            out.append(self.attention(self.both(tf.take(f, 0), tb.take(b, 0), m)[0], m)[0])
        return np.concatenate(out)

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        words = Words(buf, offs)
        at, n, first = words.windows()
        return sigmoid(np.maximum.reduceat(self.window_logits(words, at, n), first[:-1]).astype(np.float64))

    def gradients(self, words: Words, at: np.ndarray, n: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted loss of the given windows (each of at least one word)."""
        spot = at + np.minimum(np.arange(WINDOW)[:, None], n - 1)
        used, f = np.unique(words.number[spot], return_inverse=True)
        f = f.reshape(spot.shape)
        turn = self.places(n)
        b = np.take_along_axis(f, turn, 0)
        joint, bucket, kept = self.word_vectors(words.bytes[used], words.sizes[used], words.hashes[used], True)
        xf, xb = (joint @ self.p["wwf"] + self.p["wbf"])[f], (joint @ self.p["wwb"] + self.p["wbb"])[b]
        states, kf, kb = self.both(xf, xb, n, True)
        logit, pooled, share, key = self.attention(states, n)
        g = ((sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)[:, None]
        out = {"out": pooled.T @ g, "out_b": g.sum(0)}
        dp = g @ self.p["out"].T
        ds = share[:, :, None] * dp
        dw = (states * dp).sum(2)
        dw = share * (dw - (share * dw).sum(0))
        dk = dw[:, :, None] * self.p["att_v"][:, 0] * (1 - key * key)
        out |= {"att_v": np.einsum("tra,tr->a", key, dw)[:, None], "att": np.einsum("trs,tra->sa", states, dk), "att_b": dk.sum((0, 1))}
        ds = (ds + dk @ self.p["att"].T).astype(np.float32)
        zero, dj = np.zeros((len(n), STATE), np.float32), np.zeros_like(joint)
        for d, index, kept_d, grad in (("f", f, kf, ds[:, :, :STATE]), ("b", b, kb, np.take_along_axis(ds[:, :, STATE:], turn[:, :, None], 0))):
            dx, out[f"wu{d}"] = backward(grad, zero, self.p[f"wu{d}"], n, kept_d)
            flat = dx.reshape(-1, 3 * STATE)
            total = np.stack([np.bincount(index.reshape(-1), flat[:, j], len(used)) for j in range(3 * STATE)], 1).astype(np.float32)
            out |= {f"ww{d}": joint.T @ total, f"wb{d}": total.sum(0)}
            dj += total @ self.p[f"ww{d}"].T
        out["chars"] = np.zeros_like(self.p["chars"])
        sizes = words.sizes[used]
        for i, (d, (chars, gates)) in enumerate(zip("fb", kept)):
            dx, out[f"cu{d}"] = backward(None, dj[:, i * CHAR_STATE : (i + 1) * CHAR_STATE], self.p[f"cu{d}"], sizes, gates)
            flat, at_byte = dx.reshape(-1, 3 * CHAR_STATE), chars.T.reshape(-1)
            total = np.stack([np.bincount(at_byte, flat[:, j], 256) for j in range(3 * CHAR_STATE)], 1).astype(np.float32)
            out |= {f"cw{d}": self.p["chars"].T @ total, f"cb{d}": total.sum(0)}
            out["chars"] += total @ self.p[f"cw{d}"].T
        own = dj[:, 2 * CHAR_STATE :]
        out["words"] = np.stack([np.bincount(bucket, own[:, j], BUCKETS) for j in range(WORD_EMBED)], 1).astype(np.float32)
        return out


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 9, batch: int = 160, seed: int = 8) -> Network:
    """Rounds of: score all windows, take the highest of each text (in the first rounds random ones), learn from these."""
    net, rng = Network(), np.random.default_rng(seed)
    epochs = min(3 * epochs, max(epochs, epochs * (TOXIC + CLEAN) // max(1, len(texts))))  # few texts take more rounds
    words = Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    at, n, first = words.windows()
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    opt = Adam(net.p, 0.01)
    for epoch in range(epochs):
        opt.rate = 0.01 * 0.5 ** max(0, epoch - epochs // 2)
        if epoch < 2:
            key = rng.random(len(at))
        else:
            net.known = Network().known
            key = net.window_logits(words, at, n)
        best = np.lexsort((-key, row))[first[:-1]]
        extra = first[:-1] + rng.integers(0, np.diff(first))
        pick = np.concatenate([best, best if epoch < 2 else extra[labels == 0], extra[labels == 0]])
        pick = rng.permutation(pick[n[pick] > 0])
        for a in range(0, len(pick), batch):
            p = pick[a : a + batch]
            opt.step(net.gradients(words, at[p], n[p], labels[row[p]], weights[row[p]]))
    net.known = Network().known
    return net


def score_toxicity(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("doc_id",), toxic: int = TOXIC, clean: int = CLEAN, seed: int = 12) -> DataFrame:
    """The given columns of every row of ``docs(doc_id, text)`` and its score; learned from ``labels(doc_id, label)``, labels 0 and 1.

    A column of ``docs`` that is called score can't be handed through.
    """
    small_batches(docs.sparkSession)
    seen, _ = learning_rows(docs, labels, {0: clean, 1: toxic}, LEARN_BYTES, seed)
    only = float(seen[0][1]) if seen and len({r[1] for r in seen}) == 1 else None if seen else 0.5
    net = None if only is not None else fit([r[2].encode() for r in seen], np.array([r[1] for r in seen], np.float32), np.array([1.0 if r[1] else CLEAN_WEIGHT for r in seen], np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches):
        net = shared.value
        for batch in batches:
            for piece in X.pieces(batch):
                buf, offs = X.buffers(piece.column("text"))
                score = np.full(piece.num_rows, only) if net is None else net.score(buf, offs)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), pa.array(score)], names=[*columns, "score"])

    return docs.select("text", *(c for c in columns if c != "text")).mapInArrow(scored, scored_schema(docs, columns))
