"""Quality: attention-based multiple-instance learning over a text's passages.

A text is cut into passages of ``PASSAGE`` code points. A passage is described, by itself, by the shares of character classes, of
hashed pairs of neighbouring characters and of words that repeat the one before; a layer encodes it, gated attention
(tanh and sigmoid branches multiplied) weighs the passages of a document, and the weighted encoding is scored. Everything
is learned together from document labels. For scoring, a passage needs two numbers only, its attention and its part of the
logit, so texts of any length are read in blocks.

Defined results: a null or empty text is one passage without characters; without labels of both classes every score is the
share of label 1, one half if there are none. Rows that repeat an id are scored each for itself; further columns are kept, and those
named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import fold, lean
from roadweave.llm.learning import Adam, labelled_sample, share_of_ones, sigmoid

PASSAGE, PAIRS, HIDDEN, GATE = 400, 64, 24, 12
BLOCK = 1000 * PASSAGE
SINGLE = "!#$%&*|.,;:?-_/"
CLASSES = 8 + len(SINGLE)
WIDTH = CLASSES + PAIRS + 3


def _classes() -> np.ndarray:
    """Class of each code point under 2**16; letters beyond ASCII are told by str methods below U+0250."""
    kind = np.full(1 << 16, 7, np.uint8)
    for c in range(0x250):
        ch = chr(c)
        kind[c] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 4 if ch in "\r\n" else 3 if ch.isspace() else 5 if c < 128 else 6
    for i, ch in enumerate(SINGLE):
        kind[ord(ch)] = 8 + i
    return kind


KIND = _classes()


def describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and the text of each; an empty text has one row of zeros.

    A passage is described by its own characters alone: pairs, words and repeats don't reach over its ends. So its row is the same
    whatever stands beside it, and texts may be described in any batches, or in blocks of whole passages.
    """
    sizes = np.array([len(t) for t in texts])
    count = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), count)
    first = count.cumsum() - count
    length = np.full(len(owner), PASSAGE)
    length[first + count - 1] = sizes - (count - 1) * PASSAGE
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, total = len(owner), len(codes)
    passage = np.repeat(np.arange(n, dtype=np.int32), length)
    kind = KIND[np.minimum(codes, 0xFFFF)]
    per = np.maximum(length, 1)[:, None]
    classes = np.bincount(passage * np.int64(CLASSES) + kind, minlength=n * CLASSES).reshape(n, CLASSES) / per
    begins = np.ones(total + 1, bool)
    begins[1:-1] = passage[1:] != passage[:-1]
    inner = np.flatnonzero(~begins[1:-1])
    pair = ((codes[inner] * np.uint32(0x9E3779B1) ^ codes[inner + 1] * np.uint32(0x85EBCA6B)) * np.uint32(0x2C1B3C6D)) >> np.uint32(26)
    pairs = np.bincount(passage[inner] * np.int64(PAIRS) + pair, minlength=n * PAIRS).reshape(n, PAIRS) / per
    solid = np.zeros(total + 2, bool)
    solid[1:-1] = (kind != 3) & (kind != 4)
    begin = np.flatnonzero(solid[1:-1] & (~solid[:-2] | begins[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | begins[1:])) + 1
    running = np.zeros(total + 1, np.uint64)
    np.cumsum(codes * np.uint64(0x9E3779B97F4A7C15) ^ (codes.astype(np.uint64) << np.uint64(29)), dtype=np.uint64, out=running[1:])
    word = (running[end] - running[begin]) * np.uint64(31) + (end - begin).astype(np.uint64)
    at = passage[begin]
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
    words = np.bincount(at, minlength=n)
    extra = np.stack((np.bincount(at, again, n) / np.maximum(words, 1), words * 5 / per[:, 0], np.minimum(length, PASSAGE) / PASSAGE), axis=1)
    return np.concatenate((classes, pairs, extra), axis=1).astype(np.float32), owner


def encode(x: np.ndarray, m: dict) -> tuple[np.ndarray, ...]:
    e = np.tanh(((x - m["mean"]) / m["spread"]) @ m["W"] + m["b"])
    a, g = np.tanh(e @ m["V"]), sigmoid(e @ m["U"])
    return e, a, g, (a * g) @ m["w"]


def pool(owner: np.ndarray, attention: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Softmax of the attention within each document, and the sum of values so weighted."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, attention)
    weight = np.exp(attention - top[owner])
    return np.bincount(owner, weight * value, n) / np.bincount(owner, weight, n)


def bags(sample: DataFrame, most: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of features, the bag of each, label of each bag) of a written sample, in the order of ids.

    The rows are made on the executors. Of a text of more than ``most`` passages that many come, spread evenly over the whole
    text, so the driver gets at most ``most`` rows of 90 floats for each labelled text, whatever the texts' lengths.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                passages = max(1, -(-len(text) // PASSAGE))
                taken = np.unique(np.linspace(0, passages - 1, min(most, passages)).round().astype(int)).tolist()
                rows, _ = describe([text[k * PASSAGE : (k + 1) * PASSAGE] for k in taken])
                out.append((doc, y, rows.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "y", "rows"])

    found = sorted(sample.select("doc_id", "text", "y").mapInArrow(lean(run), "doc_id long, y int, rows binary").toLocalIterator(), key=lambda r: r["doc_id"])
    parts = [np.frombuffer(r["rows"], np.float32).reshape(-1, WIDTH) for r in found]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.array([r["y"] for r in found], float)


def fit(sample: DataFrame, rounds: int = 220, rate: float = 0.01, ridge: float = 1e-4, seed: int = 7) -> dict:
    n, ones = share_of_ones(sample)
    if not 0 < ones < n:
        return {"share": (ones + 1) / (n + 2)}
    x, owner, y = bags(sample)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / spread).astype(float)
    rng = np.random.default_rng(seed)
    m = {
        "W": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
        "b": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": rng.normal(0, GATE**-0.5, GATE),
        "c": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "d": np.zeros(1),
    }
    step = Adam(m, rate)
    weight = np.where(y == 1, 0.5 / ones, 0.5 / (n - ones))
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    for _ in range(rounds):
        e = np.tanh(x @ m["W"] + m["b"])
        a, g = np.tanh(e @ m["V"]), sigmoid(e @ m["U"])
        s = (a * g) @ m["w"]
        top = np.maximum.reduceat(s, starts)
        p = np.exp(s - top[owner])
        p /= np.add.reduceat(p, starts)[owner]
        z = np.add.reduceat(p[:, None] * e, starts, axis=0)
        error = (sigmoid(z @ m["c"] + m["d"]) - y) * weight
        back = error[owner][:, None] * m["c"]
        part = (back * e).sum(axis=1)
        ds = p * (part - np.add.reduceat(p * part, starts)[owner])
        da, dg = ds[:, None] * m["w"] * g * (1 - a * a), ds[:, None] * m["w"] * a * g * (1 - g)
        de = (p[:, None] * back + da @ m["V"].T + dg @ m["U"].T) * (1 - e * e)
        slopes = {"W": x.T @ de, "b": de.sum(axis=0), "V": e.T @ da, "U": e.T @ dg, "w": (a * g).T @ ds, "c": z.T @ error, "d": np.array([error.sum()])}
        step.move({k: v + (ridge * m[k] if m[k].ndim > 1 else 0) for k, v in slopes.items()})
    return m | {"mean": mean, "spread": spread}


def logits(texts: list[str | None], m: dict) -> np.ndarray:
    """The logit of each whole text, to eight decimals, so that the shape of a matrix product, which may move the last bits, doesn't show."""
    attention, value, owner, block, held = [], [], [], [], 0

    def flush() -> None:
        found, of = describe([t for _, t in block])
        e, _, _, s = encode(found, m)
        attention.append(s)
        value.append(e @ m["c"])
        owner.append(np.array([i for i, _ in block])[of])
        block.clear()

    for i, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(1, len(text)), BLOCK):
            block.append((i, text[at : at + BLOCK]))
            held += len(block[-1][1])
            if held >= BLOCK:
                flush()
                held = 0
    if block:
        flush()
    if not texts:
        return np.zeros(0)
    return np.round(pool(np.concatenate(owner), np.concatenate(attention), np.concatenate(value), len(texts)) + m["d"], 8)


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """``docs`` with held_out, score and predicted; without a shuffle. The model's size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    clean = docs.drop("held_out", "score", "predicted")
    schema = clean.withColumn("score", F.lit(0.0)).schema
    text = clean.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = np.full(len(texts), m["share"]) if "share" in m else sigmoid(logits(texts, m))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    found = clean.mapInArrow(lean(run), schema)
    return found.withColumns({"held_out": F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})


def classify(docs: DataFrame, labels: DataFrame, bound: int = 2000, threshold: float = 0.5) -> DataFrame:
    """Fits on at most ``bound`` labelled texts of each class and scores every whole text."""
    return score(docs, fit(labelled_sample(docs, labels, "quality", bound)), threshold)
