"""Bounded samples of labelled rows, and the optimiser of the small numpy models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def bounded_sample(rows: DataFrame, label: str, per_label: int | dict, seed: int) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each label (or as many as it says for the label), drawn by a hash of doc_id, and by label how many rows stand behind one.

    Labels are few: one row per label comes back. A label that has fewer rows gives all of them.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0), {}
    wanted = per_label if isinstance(per_label, dict) else dict.fromkeys(counts, per_label)
    share = {k: min(1.0, wanted[k] / n) for k, n in counts.items()}
    limit = F.create_map(*(F.lit(x) for k, s in share.items() for x in (k, int(s * (1 << 20)))))
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < F.element_at(limit, F.col(label))), {k: 1 / s for k, s in share.items()}


def learning_rows(docs: DataFrame, labels: DataFrame, per_label: int | dict, most_bytes: int, seed: int) -> tuple[list[tuple[int, int, str]], dict]:
    """(doc_id, label, text) of a sample of the 0/1 labels ``labels(doc_id, label)``, and by label how many rows stand behind one.

    The sample is drawn from the labels alone and has a bounded size, so its ids are sent to the
    scan; texts of over ``most_bytes`` bytes are not learned from.
    """
    rows = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    sample, behind = bounded_sample(rows, "label", per_label, seed)
    if not behind:
        return [], behind
    texts = docs.where(F.octet_length("text") <= most_bytes).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return sorted((r["doc_id"], r["label"], r["text"]) for r in texts.collect()), behind


def scored_schema(docs: DataFrame, columns: tuple[str, ...]) -> str:
    return ", ".join([*(f"`{c}` {dict(docs.dtypes)[c]}" for c in columns), "score double"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.multiply(x, 0.5)
    out = np.tanh(out, out=out) if isinstance(out, np.ndarray) else np.tanh(out)
    out *= 0.5
    out += 0.5
    return out


class Adam:
    """Steps on a dictionary of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.turn = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.turn += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-7) + self.rate * self.decay * self.params[k]
