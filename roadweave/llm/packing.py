"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt into shards of about ``shard`` pieces; several islands evolve each shard from best-fit-decreasing packings
of differently perturbed orders. Crossover injects whole well-filled bins of one parent into the other, takes out
the bins that then hold a piece twice, and best-fits the displaced pieces. Between epochs an island's elite migrates to
the next island of its shard. Poorly filled bins of all shards go on to further levels, whose shards are of the same bounded
size, until one shard holds them or a level saves no bins. Only ids and lengths move; texts and ids stay in the written pieces.

Defined results: a null or empty text is the one piece [end id]; repeated rows and rows with equal or null doc_ids are
packed each for itself; an empty table gives an empty frame. ``cut_documents`` returns its own columns alone; ``pack`` keeps
further columns of its pieces, and its results replace those named like them.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import discard, lean, let_go, stage
from roadweave.llm.token_files import encoder
from roadweave.llm.tokens import by_text

PIECE = "doc_id long, piece int, start long, length long, ids binary"
KNOWN = 200_000  # cached chunks of a worker: about 190 MB with the tokenizer


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", kind: str = "<u4") -> DataFrame:
    """The ids of each text and then ``end_id``, cut into pieces of ``capacity``; written, so a text is encoded once.

    ``ids`` holds little-endian unsigned integers, of 32 bits or, with ``kind`` ``<u2`` and a vocabulary that allows it, of 16. ``uid`` is a number of the piece that stays as it was written.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    shared = spark.sparkContext.broadcast(source)
    end = np.array([end_id], "<u4")
    if np.dtype(kind).itemsize < 4 and max(end_id, encoder(source).tokenizer.get_vocab_size() - 1) >= 1 << 16:
        raise ValueError("the vocabulary needs ids of 32 bits")

    def cut(batches):
        known = encoder(shared.value, KNOWN)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in by_text(texts):
                flat, counts = known.encode(texts[s])
                out: list[tuple] = []
                for doc, last, n in zip(ids[s], counts.cumsum().tolist(), counts.tolist(), strict=True):
                    own = np.append(flat[last - n : last], end).astype(kind)
                    out += [(doc, k // capacity, k, len(p := own[k : k + capacity]), p.tobytes()) for k in range(0, len(own), capacity)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(lean(cut, cached=True), PIECE).withColumn("uid", F.monotonically_increasing_id()), "pieces")


class Bins:
    """Bins under construction: each one's room is kept in order, so the fullest bin that still fits is found at once."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.room = capacity, [], []

    def put(self, piece: int, size: int) -> None:
        at = bisect.bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, b = self.room.pop(at)
            self.items[b].append(piece)
        else:
            room, b = self.capacity, len(self.items)
            self.items.append([piece])
        if room > size:
            bisect.insort(self.room, (room - size, b))

    def add(self, pieces: list[int], filled: int) -> None:
        """A whole bin."""
        if filled < self.capacity:
            bisect.insort(self.room, (self.capacity - filled, len(self.items)))
        self.items.append(pieces)


def best_fit(sizes: list[int], order, capacity: int, bins: Bins | None = None) -> list[list[int]]:
    bins = bins or Bins(capacity)
    for i in order:
        bins.put(i, sizes[i])
    return bins.items


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more uneven filling, which leaves room where a later piece can use it."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def cross(giver: list[list[int]], taker: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Well-filled bins of ``giver`` go whole into ``taker``; its bins that share a piece with them are taken apart."""
    filled = np.array([sum(sizes[i] for i in b) for b in giver])
    good = np.argsort(-filled, kind="stable")[: max(1, len(giver) // 2)]
    given = [giver[k] for k in good[rng.random(len(good)) < 0.5]] or [giver[good[0]]]
    held = {i for b in given for i in b}
    child, displaced = Bins(capacity), []
    for b in given:
        child.add(list(b), sum(sizes[i] for i in b))
    for b in taker:
        if held.isdisjoint(b):
            child.add(list(b), sum(sizes[i] for i in b))
        else:
            displaced += [i for i in b if i not in held]
    return best_fit(sizes, sorted(displaced, key=lambda i: (-sizes[i], i)), capacity, child)


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The emptiest bin and a few others are taken apart and best-fitted again."""
    fill = np.array([sum(sizes[i] for i in b) for b in bins])
    out = {int(fill.argmin()), *rng.integers(0, len(bins), 3).tolist()}
    kept = Bins(capacity)
    for k, b in enumerate(bins):
        if k not in out:
            kept.add(list(b), int(fill[k]))
    return best_fit(sizes, sorted((i for k in out for i in bins[k]), key=lambda i: (-sizes[i], i)), capacity, kept)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], generations: int, population: int) -> list[list[int]]:
    """The best packing found. It ends as soon as no packing could have fewer bins."""
    rng, least = np.random.default_rng(seed), -(-sum(sizes) // capacity)
    everyone = list(elites)
    span = np.array(sizes, float)
    while len(everyone) < population:
        if any(len(b) <= least for b in everyone):
            break
        noise = 0.0 if not everyone else 0.08 * len(everyone)
        everyone.append(best_fit(sizes, np.argsort(-(span * (1 + noise * rng.random(len(span)))), kind="stable").tolist(), capacity))
    rank = lambda b: fitness(b, sizes, capacity)
    everyone.sort(key=rank, reverse=True)
    for _ in range(generations):
        if len(everyone[0]) <= least or len(everyone) < 2:
            break
        a, b = rng.permutation(len(everyone))[:2]
        child = cross(everyone[min(a, b)], everyone[max(a, b)], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        if rank(child) > rank(everyone[-1]):
            everyone[-1] = child
            everyone.sort(key=rank, reverse=True)
    return everyone[0]


def epoch(rows: DataFrame, capacity: int, generations: int, population: int, number: int) -> DataFrame:
    """Each island of each shard evolves; ``bin`` of an elite that arrives is its packing, -1 stands for none."""

    def island(key, pdf: pd.DataFrame) -> pd.DataFrame:
        let_go()
        pdf = pdf.sort_values("uid", kind="stable")
        arrived = {tag: own for tag, own in pdf.groupby("tag", sort=True)}
        first = next(iter(arrived.values()))
        uids, sizes = first["uid"].to_numpy(), first["length"].tolist()
        elites = []
        for own in arrived.values():
            if (own["bin"] >= 0).all():
                packing: dict[int, list[int]] = {}
                for i, b in enumerate(own["bin"].tolist()):
                    packing.setdefault(b, []).append(i)
                elites.append(list(packing.values()))
        best = evolve(sizes, capacity, zlib.crc32(f"{key}/{number}".encode()), elites, generations, population)
        of = np.empty(len(uids), np.int64)
        for b, items in enumerate(best):
            of[items] = b
        return pd.DataFrame({"shard": first["shard"].to_numpy(), "island": np.int32(key[1]), "uid": uids, "length": sizes, "bin": of})

    return rows.groupBy("shard", "island").applyInPandas(island, "shard long, island int, uid long, length long, bin long")


def level(pieces: DataFrame, shards: int, capacity: int, islands: int, epochs: int, generations: int, population: int, number: int) -> DataFrame:
    """(uid, length, sequence_id, filled) of one level: islands evolve, elites migrate, and the best island of each shard wins."""
    rows = pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(shards)).alias("shard"))
    rows = rows.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumns({"bin": F.lit(-1).cast("long"), "tag": F.lit(0)})
    for k in range(epochs):
        last, out = (out if k else None), stage(epoch(rows, capacity, generations, population, k), f"packing-{number}-{k}")
        if last is not None:
            discard(last)
        visits = F.array(F.struct(F.col("island").alias("to"), F.lit(0).alias("tag")), F.struct(((F.col("island") + 1) % islands).cast("int").alias("to"), F.lit(1).alias("tag")))
        rows = out.withColumn("v", F.explode(visits if islands > 1 else F.slice(visits, 1, 1))).select("shard", "uid", "length", "bin", F.col("v.to").alias("island"), F.col("v.tag").alias("tag"))
    bins = out.groupBy("shard", "island", "bin").agg(F.sum("length").alias("filled"))
    scores = bins.groupBy("shard", "island").agg(F.count("*").alias("n"))
    won = scores.groupBy("shard").agg(F.min_by("island", F.struct("n", "island")).alias("island"))
    best = out.join(won, ["shard", "island"]).join(bins, ["shard", "island", "bin"])
    sequence = F.lit(number << 56) + F.shiftleft(F.col("shard"), 24) + F.col("bin")
    best = stage(best.select("uid", "length", sequence.alias("sequence_id"), "filled"), f"packed-{number}")
    discard(out)
    return best


def pack(pieces: DataFrame, capacity: int, shard: int = 2000, islands: int = 2, epochs: int = 2, generations: int = 12, population: int = 4, again: float = 0.97, least: float = 0.001) -> DataFrame:
    """``pieces`` (uid and length, and whatever else) with sequence_id and offset: gapless in each sequence, by uid.

    Full pieces are sequences already. Bins filled to less than ``again`` are packed anew on the next level, whose shards again
    have about ``shard`` pieces of what is left, dealt out differently, so no task gets more than that however poorly lengths fit.
    The last level is the one that has a single shard, or that saves less than ``least`` of the bins it took apart; if
    it saves none, the bins stay as they were.
    """
    left = pieces.select("uid", "length")
    done = [left.where(F.col("length") >= capacity).select("uid", "length", F.lit(127 << 56).cast("long").bitwiseOR(F.col("uid")).alias("sequence_id"))]
    left = left.where(F.col("length") < capacity)
    number, count, before, poor = 0, left.count(), None, None
    while count:
        shards = -(-count // shard)
        out = level(left, shards, capacity, islands, epochs, generations, population, number)
        if before is not None and (after := out.select("sequence_id").distinct().count()) >= before - least * before:
            out, shards = (out, 1) if after < before else (poor, 1)
        if shards == 1:
            done.append(out.select("uid", "length", "sequence_id"))
            break
        poor = out.where(F.col("filled") < capacity * again)
        done.append(out.where(F.col("filled") >= capacity * again).select("uid", "length", "sequence_id"))
        left = poor.select("uid", "length")
        size = poor.agg(F.count("*").alias("n"), F.count_distinct("sequence_id").alias("bins")).first()
        number, count, before = number + 1, size["n"], size["bins"]
    plan = done[0]
    for more in done[1:]:
        plan = plan.unionByName(more)

    place = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.select("uid", "sequence_id", F.coalesce(F.sum("length").over(place), F.lit(0)).alias("offset"))
    return pieces.drop("sequence_id", "offset").join(plan, "uid")
