"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are its distinct n-grams of lower-cased code points, hashed into ``2**BITS`` buckets. The log-count
ratio of a bucket is that of its smoothed document frequencies in toxic and other texts; the buckets whose ratios are
furthest from 0 in standard errors stay, are scaled by it, and a logistic regression is fitted on them. Fitting and scoring
read whole texts in blocks; a text's distinct n-grams count once, however long it is, and no other row changes its score.

Defined results: a null or empty text has the score of the bias alone; without labels of both classes every score is the share
of toxic labels, one half if there are none. Rows that repeat an id are scored each for itself; further columns are kept, and
those named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import fold, lean
from roadweave.llm.learning import Adam, labelled_sample, share_of_ones, sigmoid

BITS, ORDERS = 22, (3, 4, 5)
BLOCK = 500_000


def grams(texts: list[str], whole: list[bool] | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the buckets of the n-grams of the texts and their places in the texts joined, and where each text starts.

    A NUL ends each text. n-grams that reach beyond it are left out, as are those that hold it where ``whole`` says that the
    string is a block of a text that goes on; so a text's n-grams are the same whatever stands beside it.
    """
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    reach = starts[1:] - (0 if whole is None else 1 - np.array(whole, np.int64))
    h = codes * np.uint32(0x9E3779B1)
    buckets, places, n = [], [], 1
    for order in ORDERS:
        while n < order:
            h = h[:-1] * np.uint32(0x01000193) ^ codes[n:] * np.uint32(0x85EBCA6B)
            n += 1
        inside = np.ones(len(h), bool)
        for k in range(order):
            over = reach - order + 1 + k
            inside[over[(over >= 0) & (over < len(h)) & (over < starts[1:])]] = False
        at = np.flatnonzero(inside)
        buckets.append((h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS))
        places.append(at)
    return buckets, places, starts


def lowered(text: str | None) -> str:
    return (text or "").lower().replace("\0", " ")


def pieces(texts: list[str | None], block: int):
    """Groups of (text number, lowered string, whether it ends its text) of about ``block`` code points; long texts are cut with an overlap.

    Cuts are at places of the text alone, and no n-gram is lost or made at one.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        text = lowered(text)
        for at in range(0, max(1, len(text)), block):
            part = text[at : at + block + ORDERS[-1] - 1]
            held.append((i, part, at + len(part) >= len(text)))
            size += len(part)
            if size >= block:
                yield held
                held, size = [], 0
    if held:
        yield held


class Distinct:
    """The distinct kept buckets of each text, as (text number, place among the kept buckets), sorted; memory is bounded by the kept buckets."""

    def __init__(self, buckets: np.ndarray):
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets), dtype=np.int32)
        self.size = max(1, len(buckets))

    def of(self, texts: list[str | None], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros(0, np.int64)]
        for group in pieces(texts, block):
            number = np.array([i for i, _, _ in group])
            buckets, places, starts = grams([t for _, t, _ in group], [w for _, _, w in group])
            own = []
            for f, at in zip(buckets, places, strict=True):
                kept = self.place[f]
                hit = np.flatnonzero(kept >= 0)
                own.append(number[np.searchsorted(starts, at[hit], "right") - 1] * self.size + kept[hit])
            found.append(np.unique(np.concatenate(own)))
        pairs = np.unique(np.concatenate(found))
        return pairs // self.size, pairs % self.size


def frequencies(sample: DataFrame) -> DataFrame:
    """(bucket, zeros, ones): in how many texts of either label a bucket occurs; a task sums its own texts first."""

    def run(batches):
        count = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = np.zeros(1 << BITS, bool) if len(text) > BLOCK else None
                some = []
                for group in pieces([text], BLOCK):
                    for f in grams([t for _, t, _ in group], [w for _, _, w in group])[0]:
                        if seen is None:
                            some.append(f)
                        else:
                            seen[f] = True
                count[y, np.flatnonzero(seen) if seen is not None else np.unique(np.concatenate(some))] += 1
        filled = np.flatnonzero(count.any(axis=0))
        for at in range(0, len(filled), 100_000):
            part = filled[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(count[0, part].astype(np.int64)), pa.array(count[1, part].astype(np.int64))], ["bucket", "zeros", "ones"])

    parts = sample.select("text", "y").coalesce(8).mapInArrow(lean(run), "bucket long, zeros long, ones long")
    return parts.groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def fit(sample: DataFrame, keep: int = 2048, smoothing: float = 1.0, ridge: float = 1e-3, rounds: int = 120) -> dict:
    """{"bias", "buckets", "weights"}: what a text's logit adds up from; NB ratios and weights are already multiplied.

    Texts stay on the executors: the driver gets ``keep`` buckets, and of each labelled text which of those it holds.
    """
    n, ones = share_of_ones(sample)
    if not 0 < ones < n:
        share = (ones + 1) / (n + 2)
        return {"bias": float(np.log(share / (1 - share))), "buckets": np.zeros(0, np.uint32), "weights": np.zeros(0, np.float32)}
    of = {k: F.col(k) + F.lit(smoothing) for k in ("zeros", "ones")}
    ratio = F.log(of["ones"] / (ones + 2 * smoothing)) - F.log(of["zeros"] / (n - ones + 2 * smoothing))
    sure = F.abs(F.col("ratio")) / F.sqrt(1 / of["ones"] + 1 / of["zeros"])
    strong = frequencies(sample).withColumn("ratio", ratio).orderBy(F.round(sure, 9).desc(), "bucket").limit(keep).select("bucket", "ratio").collect()
    strong.sort(key=lambda r: r["bucket"])
    buckets, scale = np.array([r["bucket"] for r in strong], np.uint32), np.array([r["ratio"] for r in strong])
    shared = sample.sparkSession.sparkContext.broadcast(buckets)

    def held(batches):
        kept = Distinct(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            owner, col = kept.of(texts)
            rows = [c.astype("<u2").tobytes() for c in np.split(col, np.searchsorted(owner, np.arange(1, len(texts))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["doc_id", "y", "cols"])

    rows = sample.select("doc_id", "text", "y").coalesce(8).mapInArrow(lean(held), "doc_id long, y int, cols binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y, cols = np.array([r["y"] for r in rows], float), [np.frombuffer(r["cols"], "<u2").astype(np.int32) for r in rows]
    owner, col = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in cols]), np.concatenate(cols)
    at = {"w": np.zeros(len(buckets)), "b": np.zeros(1)}
    weight = np.where(y == 1, 0.5 / ones, 0.5 / (n - ones))
    step = Adam(at, 0.02)
    for _ in range(rounds):
        logit = np.bincount(owner, (scale * at["w"])[col], n) + at["b"]
        error = (sigmoid(logit) - y) * weight
        step.move({"w": np.bincount(col, error[owner], len(buckets)) * scale + ridge * at["w"], "b": np.array([error.sum()])})
    return {"bias": float(at["b"][0]), "buckets": buckets, "weights": (at["w"] * scale).astype(np.float32)}


class Scorer:
    def __init__(self, model: dict):
        self.bias, self.weights, self.kept = model["bias"], model["weights"].astype(float), Distinct(model["buckets"])

    def logits(self, texts: list[str | None], block: int = BLOCK) -> np.ndarray:
        owner, col = self.kept.of(texts, block)
        return self.bias + np.bincount(owner, self.weights[col] if len(col) else None, len(texts))


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """``docs`` with held_out, score and predicted; without a shuffle. The model's size is bounded by ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    clean = docs.drop("held_out", "score", "predicted")
    schema = clean.withColumn("score", F.lit(0.0)).schema
    text = clean.columns.index("text")
    known: list[Scorer] = []

    def run(batches):
        if not known:
            known.append(Scorer(shared.value))
        for batch in batches:
            column = pa.array(sigmoid(known[0].logits(batch.column(text).to_pylist())), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "score"])

    found = clean.mapInArrow(lean(run), schema)
    return found.withColumns({"held_out": F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})


def classify(docs: DataFrame, labels: DataFrame, bound: int = 2000, threshold: float = 0.7) -> DataFrame:
    """Fits on at most ``bound`` labelled texts of each class and scores every whole text."""
    return score(docs, fit(labelled_sample(docs, labels, "toxic", bound)), threshold)
