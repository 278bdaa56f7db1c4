"""Language identification with error-correcting output codes.

Every language has a codeword of bits; each bit is a logistic regression over hashed byte
n-grams (2 and 3 bytes, letters only). Decoding takes the codeword of the smallest loss, bits
weighted by how well they were learned; a small lead over the second one is flagged.

Learned on a sample of about ``per_language`` texts of each language (their n-gram counts, ``DIMS``
numbers a text, are what the driver sees); every text is predicted whole, next to its scan.

Nulls and texts without a letter are ``und`` with score 0; rows without doc_id are predicted, not
learned from, and not held out. With no labelled row all is ``und``, with one language that one.
Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstat.llm import text as X
from inkstat.llm.learning import Adam, bounded_sample, sigmoid
from inkstat.llm.scratch import small_batches

DIMS = 4096


def letters_only() -> np.ndarray:
    """Bytes with A-Z in lower case and what is no letter as a space."""
    out = np.full(256, 32, np.uint32)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


TABLE = letters_only()


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per row the square roots of its hashed n-gram counts, of length 1."""
    rows = len(offs) - 1
    counts = np.zeros(rows * DIMS, np.float32)
    b = TABLE[buf]
    row = np.repeat(np.arange(rows, dtype=np.int64) * DIMS, np.diff(offs))
    for k in (2, 3):
        n = len(b) - k + 1
        if n <= 0:
            continue
        h = b[:n] * np.uint32(0x9E3779B1)
        for j in range(1, k):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + b[j : n + j] * np.uint32(0xC2B2AE3D)
        at = (h >> np.uint32(20)).astype(np.int64) + row[:n]
        counts += np.bincount(at[row[:n] == row[k - 1 :]], minlength=rows * DIMS)
    counts = np.sqrt(counts.reshape(rows, DIMS))
    return counts / np.maximum(np.sqrt((counts * counts).sum(1, keepdims=True)), 1e-6)


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of +-1: every split of up to 5 languages, else the most distant of random ones."""
    if k <= 5:
        splits = [[1] + [1 if (s >> i) & 1 else -1 for i in range(k - 1)] for s in range((1 << (k - 1)) - 1)]
        return np.array(splits, np.float32).reshape(-1, k).T.copy()
    rng, bits = np.random.default_rng(seed), 8 * int(np.ceil(np.log2(k)))
    tries = [rng.choice(np.array([-1, 1], np.float32), (k, bits)) for _ in range(200)]
    apart = [min(int((t != r).sum(1)[np.arange(k) != i].min()) for i, r in enumerate(t)) for t in tries]
    best = tries[int(np.argmax(apart))]
    return best[:, np.abs(best.sum(0)) < k]


class Model:
    """Codewords and the classifiers of their bits."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200):
        self.languages, self.code = languages, codewords(len(languages))
        bits = self.code.shape[1]
        rng = np.random.default_rng(1)
        self.w = {"w": (rng.standard_normal((DIMS, bits)) * 0.01).astype(np.float32), "b": np.zeros(bits, np.float32)}
        self.trust = np.ones(bits, np.float32)
        if bits:
            goal, opt = self.code[y], Adam(self.w, 0.05, 1e-4)
            weight = (weight / weight.sum())[:, None].astype(np.float32)
            for _ in range(steps):
                margin = x @ self.w["w"] + self.w["b"]
                g = -goal * sigmoid(-goal * margin) * weight
                opt.step({"w": x.T @ g, "b": g.sum(0)})
            wrong = np.clip(((x @ self.w["w"] + self.w["b"]) * goal <= 0).mean(0), 0.002, 0.45)
            self.trust = np.log((1 - wrong) / wrong).astype(np.float32)
            self.trust /= self.trust.mean()

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its share of the decoding and whether the second one is close."""
        if len(self.languages) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x)), np.zeros(len(x), bool)
        margin = x @ self.w["w"] + self.w["b"]
        loss = (np.logaddexp(0, -self.code[None] * margin[:, None]) * self.trust).sum(2)
        near = np.sort(loss, 1)
        share = np.exp(near[:, :1] - loss).sum(1)
        return loss.argmin(1), 1 / share, near[:, 1] - near[:, 0] < 0.05 * self.trust.sum()


def predict_language(docs: DataFrame, learn: Column, per_language: int = 1000, seed: int = 3) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous), one row per row of ``docs(doc_id, text, lang)``.

    Learned from the rows with ``learn`` true and a language; nothing but the text is an input.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sample, behind = bounded_sample(rows, "lang", per_language, seed)

    def vectors(batches):
        for batch in batches:
            for piece in X.pieces(batch):
                x = features(*X.buffers(piece.column("text"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([piece.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    seen = sample.mapInArrow(vectors, "lang string, x binary").collect() if behind else []
    languages = sorted({r["lang"] for r in seen})
    model = None
    if languages:
        x = np.stack([np.frombuffer(r["x"], np.float16) for r in seen]).astype(np.float32)
        y = np.array([languages.index(r["lang"]) for r in seen])
        model = Model(languages, x, y, np.array([min(behind[r["lang"]], 10.0) for r in seen], np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches):
        model = shared.value
        for batch in batches:
            for piece in X.pieces(batch):
                has = np.array([any(map(str.isalpha, t or "")) for t in piece.column("text").to_pylist()], bool)
                if model is None:
                    best, share, close = np.zeros(len(has), np.int64), np.zeros(len(has)), np.zeros(len(has), bool)
                    names = ["und"] * len(has)
                else:
                    best, share, close = model.predict(features(*X.buffers(piece.column("text"))))
                    names = [model.languages[i] if ok else "und" for i, ok in zip(best, has)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names), pa.array(np.where(has, share, 0.0).astype(np.float64)), pa.array(close & has)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(predicted, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")
