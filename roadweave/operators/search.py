"""Batched searches over edge tables: every origin at once, until no label improves, lineage cut in the shared folder."""

from __future__ import annotations

import functools
import heapq
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder of spark.checkpoint.dir and read again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def converge(seeds: DataFrame, edges: DataFrame, tile: int = 200_000, block: int = 64, limit: int | None = None) -> DataFrame:
    """seeds (src, node), edges (u, v, w >= 0) -> (src, node, cost, dist): least cost without a bound on edges, ties to fewer edges.

    Nodes are cut into tiles of ``tile`` neighbouring ids and origins into blocks of at most ``block``, as many as cores at least. In a round
    each tile and block that got better labels is settled by Dijkstra's algorithm and sends labels over its border; the last
    round sends none. A task holds one tile's edges and one block's labels there, so a round crosses a tile, not an edge. A round reads and
    writes only what it settles: the labels of a tile and block are those of the last round that settled it.

    With a ``limit`` the labels are all those of this cost at most; since w >= 0 they are the same as without.
    """
    spark = seeds.sparkSession
    at = lambda node: F.floor(F.col(node) / tile).cast("long")
    sources = seeds.select("src").distinct()
    origins = max(1, sources.count())
    blocks = max(math.ceil(origins / block), min(origins, spark.sparkContext.defaultParallelism))
    dealt = sources.select("src", ((F.row_number().over(Window.orderBy("src")) - 1) % blocks).cast("long").alias("block"))
    labels = seeds.select("src", "node").distinct().join(dealt, "src")
    zero = F.lit(0).cast("long")
    names = "tile long, block long, src long, node long, cost long, dist long, hot boolean"
    labels = labels.select(at("node").alias("tile"), "block", "src", "node", zero.alias("cost"), zero.alias("dist"), F.lit(True).alias("hot"))
    steps = cut(edges.select(at("u").alias("tile"), "u", "v", F.col("w").cast("long").alias("w")).sort("tile"), "edges")
    bits, inner, beyond = tile.bit_length(), (1 << tile.bit_length()) - 1, None if limit is None else (limit + 1) << 32

    def settle(key, held: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        # a label is cost << 32 | dist, an entry of the heap label << bits | place in the tile
        base = key[0] * tile
        onward: list[list[tuple[int, int]]] = [[] for _ in range(tile)]
        for u, v, w in zip((out["u"] - base).tolist(), (out["v"] - base).tolist(), out["w"].tolist(), strict=True):
            onward[u].append((v, (w << 32) + 1))
        rows = []
        for src, own in held.sort_values("hot", kind="stable").groupby("src"):  # what is settled comes first and isn't sent twice
            best: list[int | None] = [None] * tile
            heap, sent = [], {}
            marks = [(c << 32) | d for c, d in zip(own["cost"].tolist(), own["dist"].tolist(), strict=True)]
            for u, label, hot in zip((own["node"] - base).tolist(), marks, own["hot"].tolist(), strict=True):
                if best[u] is None or label < best[u]:
                    best[u] = label
                    if hot:
                        heap.append((label << bits) | u)
            heapq.heapify(heap)
            while heap:
                entry = heapq.heappop(heap)
                u, label = entry & inner, entry >> bits
                if label != best[u]:
                    continue
                for v, w in onward[u]:
                    reached = label + w
                    if beyond is not None and reached >= beyond:
                        continue
                    if 0 <= v < tile:
                        if best[v] is None or reached < best[v]:
                            best[v] = reached
                            heapq.heappush(heap, (reached << bits) | v)
                    elif v not in sent or reached < sent[v]:
                        sent[v] = reached
            kept = [u for u in range(tile) if best[u] is not None]
            for nodes, found, hot in ((kept, [best[u] for u in kept], False), (list(sent), list(sent.values()), True)):
                node = np.array(nodes, dtype=np.int64) + base
                if max(found, default=0) < 1 << 63:
                    marks = np.array(found, dtype=np.int64)
                    cost, dist = marks >> 32, marks & 0xFFFFFFFF
                else:
                    cost, dist = [x >> 32 for x in found], [x & 0xFFFFFFFF for x in found]
                rows.append(pd.DataFrame({"tile": node // tile, "block": key[1], "src": src, "node": node, "cost": cost, "dist": dist, "hot": hot}))
        return pd.concat(rows)

    def settled(groups: list[tuple[int, int]]) -> DataFrame | None:
        """What the last rounds wrote for these tiles and blocks."""
        rounds = sorted({latest[g] for g in groups if g in latest})
        frames = [version(r, [g for g in groups if latest.get(g) == r]) for r in rounds]
        return functools.reduce(DataFrame.unionByName, frames) if frames else None

    def version(number: int, groups: list[tuple[int, int]]) -> DataFrame:
        return written[number].where("NOT hot").join(F.broadcast(spark.createDataFrame(groups, "tile long, block long")), ["tile", "block"], "left_semi")

    hot, written, latest = cut(labels, "labels"), {}, {}
    tiles_of = lambda df: [tuple(g) for g in df.select("tile", "block").distinct().collect()]
    while groups := tiles_of(hot):
        if (known := settled(groups)) is not None:  # a label that is no better than the one there needs no round
            old = known.select("src", "node", F.struct("cost", "dist").alias("old"))
            hot = hot.groupBy("tile", "block", "src", "node").agg(F.min(F.struct("cost", "dist")).alias("new"))
            stale = old.join(hot.select("src", "node", "new"), ["src", "node"]).where("old <= new").select("src", "node")
            hot = hot.join(stale, ["src", "node"], "left_anti").select("tile", "block", "src", "node", "new.cost", "new.dist", F.lit(True).alias("hot"))
            hot = cut(hot, "hot")
            groups = tiles_of(hot)
            if not groups:
                break
        given = hot if (known := settled(groups)) is None else hot.unionByName(known)
        near = steps.where(F.col("tile").isin(sorted({g[0] for g in groups}))).join(F.broadcast(spark.createDataFrame(groups, "tile long, block long")), ["tile"])
        n = 8 * min(len(groups), spark.sparkContext.defaultParallelism)
        dealt = given.repartition(n, "tile", "block").groupBy("tile", "block").cogroup(near.repartition(n, "tile", "block").groupBy("tile", "block"))
        number = len(written) + 1
        written[number] = cut(dealt.applyInPandas(settle, names), "labels")
        latest |= dict.fromkeys(groups, number)
        hot = written[number].where("hot")
    result = settled(list(latest))
    return (hot if result is None else result).select("src", "node", "cost", "dist")


def widening(search, whole, limits: tuple[int, ...] = (1_000_000, 8_000_000)) -> DataFrame:
    """The first of ``search(limit)`` of which ``whole(found, limit)`` says that nothing beyond the limit matters, else ``search(None)``."""
    for limit in limits:
        found = search(limit)
        if whole(found, limit):
            return found
    return search(None)
