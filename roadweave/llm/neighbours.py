"""Nearest neighbours by multi-index hashing of learned rotated binary codes, with an exact rerank.

Unit vectors are centred and rotated onto ``bits`` axes whose signs are the code; the rotation is learned by alternating
least squares on a bounded sample. A code is split into substrings, each indexed by value. Codes within a radius r of a
query's differ in some substring in at most r / substrings bits, so probing all values that near retrieves every one of them; the
radius is the least one that finds ``recall`` of the sample's true neighbours among the sample, and one bit more. What is
retrieved is ranked by the cosine of the original vectors in double precision.

The stated queries are held against all rows in blocks: a task has one block of the index and one of the queries, both of
bounded size, and returns each query's nearest few. Equal vectors are one entry that keeps its smallest ids.

Defined results: vectors that are null, empty or zero, hold a null or non-finite component, or are not as long as most
others take no part; equal (id, vector) rows count once; a null id takes no part; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import stage

SUBSTRING = 8


def learn(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(centre, axes): the rotation of the principal axes whose signs lose least (alternating least squares)."""
    centre = x.mean(axis=0)
    x = x - centre
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[:bits].T
    if axes.shape[1] < bits:
        axes = np.concatenate((axes, np.random.default_rng(seed).normal(size=(axes.shape[0], bits - axes.shape[1]))), axis=1)
    low = x @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
        turn = (u @ v).T
    return centre, axes @ turn


def codes(x: np.ndarray, centre: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return np.packbits((x - centre) @ axes >= 0, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def calibrate(x: np.ndarray, centre: np.ndarray, axes: np.ndarray, k: int, recall: float) -> int:
    """The least radius within which lie ``recall`` of the sample's true neighbours, and one bit more."""
    some = x[:512]
    like = some @ x.T
    like[np.arange(len(some)), np.arange(len(some))] = -2
    near = np.argsort(-like, axis=1)[:, :k]
    own = codes(x, centre, axes)
    apart = np.bitwise_count(own[: len(some), None] ^ own[near]).sum(axis=2, dtype=np.int64)
    return int(np.quantile(apart, recall, method="higher")) + 1 if apart.size else axes.shape[1]


def masks(radius: int) -> np.ndarray:
    """All 8-bit differences of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for r in range(min(radius, SUBSTRING) + 1) for bits in itertools.combinations(range(SUBSTRING), r)], np.uint8)


class MultiIndex:
    """Substring tables of a block of codes."""

    def __init__(self, own: np.ndarray):
        self.own = own
        self.order = np.argsort(own, axis=0, kind="stable")
        self.bounds = np.stack([np.searchsorted(own[self.order[:, j], j], np.arange((1 << SUBSTRING) + 1)) for j in range(own.shape[1])])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every code of the block within the radius: the first substrings are probed to r // parts, those that the rest allows to one less."""
        parts = self.own.shape[1]
        each, rest = divmod(radius, parts)
        hit = np.zeros(len(self.own), bool)
        for j in range(parts):
            reach = each if j <= rest else each - 1
            if reach < 0:
                continue
            if reach >= SUBSTRING:
                hit[:] = True
                break
            for value in (code[j] ^ masks(reach)).tolist():
                hit[self.order[self.bounds[j, value] : self.bounds[j, value + 1], j]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.own[found] ^ code).sum(axis=1, dtype=np.int64) <= radius]


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, sample: int = 4096, recall: float = 0.98, block: int = 8192, queries: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda c: c != 0)).distinct()
    sizes = v.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sizes["d"]
    v = v.where(F.size("x") == d)
    first = v.withColumn("rn", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    asked = v.where(F.col("vec_id") % every == 0)
    entries = first.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = entries.join(asked.select("x").distinct().withColumn("query", F.lit(True)), "x", "left")
    entries = stage(entries.select("x", "ids", F.coalesce("query", F.lit(False)).alias("query")).withColumn("cid", F.monotonically_increasing_id()), "vectors")
    chosen = entries.orderBy(F.xxhash64(F.col("ids")[0]), "cid").limit(sample).select("x").toPandas()
    x = unit(np.stack(chosen["x"].to_list()).astype(float))
    bits = max(SUBSTRING, min(64, d // SUBSTRING * SUBSTRING))
    centre, axes = learn(x, bits)
    radius = calibrate(x, centre, axes, k, recall)
    model = spark.sparkContext.broadcast((centre, axes, radius))
    total = entries.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    blocks, parts = max(1, -(-total["n"] // block)), max(1, -(-total["q"] // queries))

    def search(key, pdf: pd.DataFrame) -> pd.DataFrame:
        centre, axes, radius = model.value
        pdf = pdf.sort_values("cid", kind="stable")
        index, query = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        out: list[tuple[int, int, float]] = []
        if len(index) and len(query):
            raw, asks = (np.stack(p["x"].to_list()).astype(float) for p in (index, query))
            norm = np.linalg.norm(raw, axis=1)
            table = MultiIndex(codes(unit(raw), centre, axes))
            ids = index["ids"].to_list()
            for cid, ask, code in zip(query["cid"].tolist(), asks, codes(unit(asks), centre, axes), strict=True):
                reach, least = radius, min(k + 1, len(raw))
                found = table.within(code, reach)
                while len(found) < least:  # a block with too few codes so near: the radius grows until it has enough
                    reach += SUBSTRING
                    found = table.within(code, reach)
                score = (raw[found] * ask).sum(axis=1) / (norm[found] * np.linalg.norm(ask))
                best = np.flatnonzero(score >= np.sort(score)[-least])
                near = sorted((-float(score[i]), int(v)) for i in best for v in ids[found[i]])[: k + 1]
                out += [(cid, v, -s) for s, v in near]
        return pd.DataFrame(out, columns=["cid", "vec_id", "score"])

    index = entries.select(F.lit(False).alias("asks"), F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("j"), "cid", "x", "ids")
    asks = entries.where("query").select(F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(parts)).alias("j"), "cid", "x", F.array().cast("array<bigint>").alias("ids"))
    found = index.unionByName(asks).groupBy("i", "j").applyInPandas(search, "cid long, vec_id long, score double")
    best = Window.partitionBy("cid").orderBy(F.col("score").desc(), "vec_id")
    found = stage(found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn"), "found")
    owners = asked.select(F.col("vec_id").alias("query_id"), "x").join(entries.where("query").select("x", "cid"), "x").select("query_id", "cid")
    pairs = owners.join(found, "cid").where("query_id != vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
