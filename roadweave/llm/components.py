"""Connected components of a link table by alternating large-star and small-star steps; no vertex's links are gathered.

Before the steps the links, counted, are read by a task for each ``CHUNK`` of them, and contracted ``CHUNK`` at a time to
forests of stars that connect the same vertices. Where one task reads all, the first round of steps finds nothing to change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import lean, stage

CHUNK = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (vertex, least vertex of its component) of all vertices but the least ones."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    member = np.flatnonzero(root != np.arange(len(ids)))
    return ids[member], ids[root[member]]


def contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """Fewer links (u, v), u > v, that connect the same vertices; a task holds at most ``chunk`` and a batch."""

    def run(batches):
        u = v = np.zeros(0, np.int64)
        for batch in batches:
            u, v = (np.concatenate((x, c.to_numpy())) for x, c in zip((u, v), batch.columns, strict=True))
            if len(u) >= chunk:
                u, v = forest(u, v)
                if len(u) >= chunk // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    u = v = np.zeros(0, np.int64)
        if len(u):
            u, v = forest(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(lean(run), "u long, v long")


def components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """links (u, v), longs in any order and number -> (u, root): the least vertex that each linked vertex reaches.

    Vertices without links are not returned. An empty table gives an empty one.
    """
    links = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tasks = max(1, -(-links.count() // chunk))
    edges = stage(contracted(links.coalesce(tasks), chunk), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u != v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u != v").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
