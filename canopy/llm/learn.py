"""Labelled samples of bounded size, and the optimiser of the numpy models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class that a model learns from, and the longest text among them.
PER_CLASS, LONGEST = 700, 65_536


def fold(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int, per_class: int = PER_CLASS, longest: int = LONGEST) -> tuple[list[str], np.ndarray, float]:
    """About ``per_class`` texts of either label (all, if there are fewer) from the rows not held out,
    their labels, and the share of label 1 among all such rows.

    Rows are taken by a hash of their id, so that the same rows are taken each
    time; texts over ``longest`` bytes aren't learned from, equal texts once.  Only this bounded
    sample comes to the driver.  Null labels, ids and texts are left out.
    """
    known = labels.select("doc_id", F.col(target).alias("label")).where("doc_id is not null and label is not null").where(fold("doc_id", modulus) != held)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_class / n))).otherwise(share)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    picked = known.where(chance < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked) if sum(counts.values()) else picked, "doc_id").where(F.octet_length("text") <= longest)
    got = sorted((r["doc_id"], r["text"], r["label"]) for r in rows.select("doc_id", "text", "label").collect())
    got = list({text: (i, text, y) for i, text, y in got}.values())  # equal texts count once
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return [t for _, t, _ in got], np.array([y for _, _, y in got], np.float32), prior


class Adam:
    """One step at a time for a dictionary of arrays.

    Arrays named in ``plain`` take plain gradient steps: there rare features
    move as little as their gradients say, and aren't learned by heart.
    """

    def __init__(self, weights: dict[str, np.ndarray], rate: float, plain: dict[str, float] | None = None):
        self.weights, self.rate, self.step, self.plain = weights, rate, 0, plain or {}
        self.m = {k: np.zeros_like(w) for k, w in weights.items()}
        self.v = {k: np.zeros_like(w) for k, w in weights.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
        for k, g in grads.items():
            if k in self.plain:
                self.weights[k] -= np.float32(self.plain[k]) * g.astype(np.float32)
                continue
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.weights[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))
