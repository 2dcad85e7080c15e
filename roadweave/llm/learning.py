"""What the learned operators share: the bounded sample of labelled rows that a model is fitted on, and optimisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import fold, stage


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` documents of each class, chosen by a hash of their ids; written, one row an id.

    Only rows whose fold isn't the held-out one are seen. Rows without an id or a label of 0 or 1 are not used; of labels
    that repeat an id the greatest counts, and of texts that repeat an id the one with the least hash. Texts of any length are learned
    from in whole; they stay on the executors. Only the chosen ids, a bounded number, are broadcast.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 1))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.struct(F.xxhash64("text"), F.length("text"))).alias("x"))
    return stage(one.select("doc_id", "x.text", F.col("x.y").cast("int").alias("y")), "labelled")


def share_of_ones(sample: DataFrame) -> tuple[int, int]:
    """(rows, rows of label 1)."""
    found = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones")).first()
    return found["n"], found["ones"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adaptive steps over a dict of arrays."""

    def __init__(self, values: dict[str, np.ndarray], rate: float):
        self.values, self.rate, self.step = values, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in values.items()}
        self.v = {k: np.zeros_like(v) for k, v in values.items()}

    def move(self, slopes: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in slopes.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.values[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)
