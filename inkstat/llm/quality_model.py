"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - STEP``; the last one is
padded. Filters over embedded bytes, a rectifier and a maximum over the chunk give a vector per
chunk; mean and maximum over all chunks of the text, through one hidden layer, give the
probability of label 1. Every byte of every text is scored, next to the scan.

Learned on about ``per_label`` labelled texts of each label, those of at most ``LEARN_BYTES``
bytes (the driver holds at most their product); rows are weighted back to the labels' shares.

Nulls: a null text is empty and scored as one chunk of padding; rows without doc_id are scored,
not learned from, and not held out. Labels of several rows per id are all learned. With no or one
label the score is that label's share, or 0.5 with none. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstat.llm import text as X
from inkstat.llm.learning import Adam, learning_rows, scored_schema, sigmoid
from inkstat.llm.scratch import small_batches

CHUNK, STEP = 256, 192
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 6, 24, 16
LEARN_BYTES = 16384


def plan(offs: np.ndarray) -> np.ndarray:
    """The first chunk of every row, one entry more than rows."""
    sizes = np.diff(offs)
    return np.concatenate([[0], np.cumsum(np.maximum(1, -(-np.maximum(sizes - (CHUNK - STEP), 0) // STEP)))])


def chunks(buf: np.ndarray, offs: np.ndarray, first: np.ndarray, a: int, b: int) -> np.ndarray:
    """Bytes of the chunks a to b, zero-padded: (chunks x CHUNK)."""
    number = np.arange(a, b)
    row = np.searchsorted(first, number, "right") - 1
    spot = (offs[:-1][row] + (number - first[row]) * STEP)[:, None] + np.arange(CHUNK)
    inside = spot < offs[1:][row][:, None]
    return np.where(inside, buf[np.where(inside, spot, 0)], 0).astype(np.uint8) if len(buf) else np.zeros((b - a, CHUNK), np.uint8)


class ByteNet:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "embed": normal(256, EMBED, scale=1.0), "filters": normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), "shift": np.zeros(FILTERS, np.float32),
            "w1": normal(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5), "b1": np.zeros(HIDDEN, np.float32), "w2": normal(HIDDEN, 1, scale=HIDDEN**-0.5), "b2": np.zeros(1, np.float32),
        }

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Bytes under the filters at every place: (chunks x places x WIDTH)."""
        return np.lib.stride_tricks.sliding_window_view(data, WIDTH, 1)[:, ::STRIDE]

    def pooled(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of every filter over a chunk after the rectifier, and the place it came from."""
        wide = self.p["embed"][data].reshape(len(data), CHUNK * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(wide, WIDTH * EMBED, 1)[:, :: STRIDE * EMBED]
        out = (view.reshape(-1, WIDTH * EMBED) @ self.p["filters"]).reshape(len(data), view.shape[1], FILTERS)
        top = out.argmax(1)
        return np.maximum(np.take_along_axis(out, top[:, None], 1)[:, 0] + self.p["shift"], 0), top

    def combined(self, chunk: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Logits of the rows, with what the backward pass needs."""
        mean = np.add.reduceat(chunk, first[:-1]) / np.diff(first)[:, None]
        most = np.maximum.reduceat(chunk, first[:-1])
        joint = np.concatenate([mean, most], 1).astype(np.float32)
        hidden = np.maximum(joint @ self.p["w1"] + self.p["b1"], 0)
        return (hidden @ self.p["w2"] + self.p["b2"])[:, 0], hidden, joint, most

    def score(self, buf: np.ndarray, offs: np.ndarray, group: int = 512) -> np.ndarray:
        first = plan(offs)
        total = int(first[-1])
        chunk = np.concatenate([self.pooled(chunks(buf, offs, first, a, min(a + group, total)))[0] for a in range(0, total, group)])
        return sigmoid(self.combined(chunk, first)[0].astype(np.float64))

    def gradients(self, data: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        chunk, top = self.pooled(data)
        logit, hidden, joint, most = self.combined(chunk, first)
        g = ((sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)[:, None]
        out = {"w2": hidden.T @ g, "b2": g.sum(0)}
        g = (g @ self.p["w2"].T) * (hidden > 0)
        out |= {"w1": joint.T @ g, "b1": g.sum(0)}
        g = g @ self.p["w1"].T
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        peak = chunk == most[row]
        peak = peak / np.add.reduceat(peak, first[:-1]).astype(np.float32)[row]
        g = (g[:, :FILTERS] / np.diff(first)[:, None].astype(np.float32))[row] + g[:, FILTERS:][row] * peak
        g *= chunk > 0
        # a maximum has one place, so a filter sees one window per chunk
        seen = self.windows(data)[np.arange(len(data))[:, None], top]
        patch = self.p["embed"][seen].reshape(len(data), FILTERS, WIDTH * EMBED)
        out |= {"shift": g.sum(0), "filters": np.einsum("cfk,cf->kf", patch, g)}
        to_embed = (g[:, :, None] * self.p["filters"].T[None]).reshape(-1, EMBED)
        out["embed"] = np.stack([np.bincount(seen.reshape(-1), to_embed[:, e], 256) for e in range(EMBED)], 1).astype(np.float32)
        return out


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 8, batch: int = 32, seed: int = 4) -> ByteNet:
    net, rng = ByteNet(), np.random.default_rng(seed)
    opt = Adam(net.p, 0.003)
    for epoch in range(epochs):
        opt.rate = 0.003 * 0.5 ** max(0, epoch - epochs // 2)
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            buf = np.frombuffer(b"".join(texts[i] for i in pick), np.uint8)
            offs = np.cumsum([0, *(len(texts[i]) for i in pick)])
            first = plan(offs)
            opt.step(net.gradients(chunks(buf, offs, first, 0, int(first[-1])), first, labels[pick], weights[pick]))
    return net


def score_quality(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("doc_id",), per_label: int = 1500, seed: int = 9) -> DataFrame:
    """The given columns of every row of ``docs(doc_id, text)`` and its score; learned from ``labels(doc_id, label)``, labels 0 and 1.

    A column of ``docs`` that is called score can't be handed through.
    """
    small_batches(docs.sparkSession)
    seen, behind = learning_rows(docs, labels, per_label, LEARN_BYTES, seed)
    only = float(seen[0][1]) if seen and len({r[1] for r in seen}) == 1 else None if seen else 0.5
    net = None if only is not None else fit([r[2].encode() for r in seen], np.array([r[1] for r in seen], np.float32), np.array([behind[r[1]] for r in seen], np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches):
        net = shared.value
        for batch in batches:
            for piece in X.pieces(batch):
                buf, offs = X.buffers(piece.column("text"))
                score = np.full(piece.num_rows, only) if net is None else net.score(buf, offs)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), pa.array(score)], names=[*columns, "score"])

    return docs.select("text", *(c for c in columns if c != "text")).mapInArrow(scored, scored_schema(docs, columns))
