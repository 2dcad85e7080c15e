"""Mixing of sources by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power ``alpha``, normalised. ``alpha`` is bisected until the weights have
the target entropy, or until no source is repeated more than ``repeat`` times as often as the least repeated one. The budget of
a source is its weight times the total, which by default is the least at which every source is read once in whole. A
source's documents are dealt into blocks; each epoch reads the blocks in an order of its own and the documents of a block
likewise; of the last epoch comes the part that the budget still allows, which ends within one block.

Defined results: a null source is a source by itself; null and empty texts have no tokens and come in whole epochs only; rows
that repeat an id stand each for itself; an empty table gives an empty one. Further columns are kept; those named like a
result of ``mix`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import stage

SMALL = 100_000
MANY, FEW = 4096, 64


def words(text: Column) -> Column:
    """The tokens that shares and budgets count: runs other than of ASCII white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bisect(fits: Callable[[float], bool], steps: int = 40) -> float:
    """The largest exponent of 0..1 that fits, where all below a fitting one fit."""
    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def exponent(sources: DataFrame, repeat: float | None, entropy: float | None) -> float:
    """``sources`` has the tokens of each; sums run on the cluster, so the number of sources is free."""
    ends = sources.where("tokens > 0").agg(F.min("tokens").alias("lo"), F.max("tokens").alias("hi"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return 1.0
    limit = 1.0
    if repeat is not None:
        # an exponent a repeats the least source (hi / lo) ** (1 - a) times as often as the largest
        need = lambda a: (1 - a) * math.log(ends["hi"] / ends["lo"]) <= math.log(repeat)
        limit = 1 - bisect(lambda u: need(1 - u))
    if entropy is None:
        return limit
    few = [r["tokens"] for r in sources.where("tokens > 0").select("tokens").collect()] if ends["n"] <= SMALL else None

    def measure(a: float) -> float:
        if few is not None:
            p = [(t / ends["hi"]) ** a for t in few]
            s, plogp = sum(p), sum(x * math.log(x) for x in p)
        else:
            p = F.pow(F.col("tokens") / ends["hi"], F.lit(a))
            s, plogp = sources.where("tokens > 0").agg(F.sum(p), F.sum(p * F.log(p))).first()
        return math.log(s) - plogp / s

    wanted = min(entropy, math.log(ends["n"]))
    found = bisect(lambda a: measure(a) >= wanted - 1e-12)
    return max(found, limit) if repeat is not None else found


def plan(docs: DataFrame, repeat: float | None, entropy: float | None, budget: int | None, seed: int, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks): of each source its tokens, weight, budget, whole epochs and cut; of each block its order and place."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\0null"))
    rows = stage(docs.select(source.alias("source"), F.col("doc_id"), words(F.col(text_col)).alias("tokens")), "mix-rows")
    sources = stage(rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens")), "sources")
    alpha = exponent(sources, repeat, entropy)
    share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))).otherwise(0.0)
    total = sources.agg(F.sum(share).alias("s"), F.max(F.try_divide(F.col("tokens"), share)).alias("whole")).first()
    size = float(budget) if budget is not None else (total["whole"] or 0.0) * (total["s"] or 0.0)
    weight = F.when(F.col("tokens") > 0, share / F.lit(total["s"] or 1.0)).otherwise(0.0)
    blocks_of = F.least(F.lit(MANY), F.ceil(F.col("documents") / FEW)).cast("int")
    sources = sources.withColumns({"alpha": F.lit(alpha), "weight": weight, "n_blocks": blocks_of})
    budgeted = F.floor(weight * size + F.lit(1e-6)).cast("long")
    if budget is None:  # products of doubles may fall below the one whole epoch that the size is chosen for
        budgeted = F.greatest(F.col("tokens"), budgeted)
    sources = sources.withColumn("budget", budgeted)
    sources = sources.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).cast("int"))
    sources = stage(sources.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0)), "sources")
    return sources, rows


def block_of(n_blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), n_blocks).cast("int")


def block_key(source: Column, block: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(source, block, epoch.cast("int"), F.lit(seed + 1))


def row_key(epoch: Column, seed: int) -> Column:
    return F.xxhash64("doc_id", epoch.cast("int"), F.lit(seed + 2))


def attach(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The plan of its source beside each row: broadcast if its number of rows, which is counted, is small; else joined with salt."""
    if sources.count() <= SMALL:
        return rows.join(F.broadcast(sources), "source")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(salted, ["source", "salt"]).drop("salt")


def cuts(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Of each source where its last, partial epoch ends: the key of the block it ends in and the last key of that block's rows.

    Windows run over blocks, at most ``MANY`` a source, and over the rows of one block of each source.
    """
    dealt = attach(rows, sources.select("source", "n_blocks", "epochs", "rest").where("rest > 0"))
    dealt = dealt.withColumn("block", block_of(F.col("n_blocks"), seed))
    blocks = dealt.groupBy("source", "block", "epochs", "rest").agg(F.sum("tokens").alias("tokens"))
    blocks = blocks.withColumn("key", block_key(F.col("source"), F.col("block"), F.col("epochs"), seed))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0))).where("before <= rest")
    last = stage(blocks.groupBy("source").agg(F.max_by(F.struct("block", "key", "before"), F.struct("before", "key", "block")).alias("x")).select("source", "x.*"), "cut-blocks")
    inside = attach(dealt.drop("n_blocks"), last.withColumnRenamed("block", "cut_block")).where("block = cut_block").withColumn("row_key", row_key(F.col("epochs"), seed))
    inside = inside.groupBy("source", "block", "rest", "before", "key", "row_key").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("row_key"))
    inside = inside.withColumn("upto", F.col("before") + upto).where("upto <= rest")
    ends = inside.groupBy("source").agg(F.max("row_key").alias("cut_row"))
    return last.join(ends, "source", "left").select("source", F.col("block").alias("cut_block"), F.col("key").alias("cut_key"), "cut_row")


def mix(docs: DataFrame, repeat: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 17, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs``, a row for each time that a document is read, with mix_source, mix_tokens, epoch, block, block_key, row_key and weight.

    In order of (epoch, block_key, row_key) the rows of a source are its block permutations. Texts aren't shuffled.
    """
    sources, rows = plan(docs, repeat, entropy, budget, seed, source_col, text_col)
    ends = cuts(rows, sources, seed)
    sources = stage(sources.join(ends, "source", "left"), "mix-plan")
    clean = docs.drop("mix_source", "mix_tokens", "epoch", "block", "block_key", "row_key", "weight")
    clean = clean.withColumns({"mix_source": F.coalesce(F.col(source_col).cast("string"), F.lit("\0null")), "mix_tokens": words(F.col(text_col))})
    # everything planned stands in one struct beside the caller's columns, under a name that none of them has
    own = unused("planned", clean.columns)
    planned = sources.select(F.struct("source", "weight", "n_blocks", "epochs", "rest", "cut_block", "cut_key", "cut_row").alias(own))
    got = lambda name: F.col(f"{own}.{name}")
    if sources.count() <= SMALL:
        out = clean.join(F.broadcast(planned), F.col("mix_source") == got("source"))
    else:
        salt = unused("salt", [own, *clean.columns])
        out = clean.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
        salted = planned.withColumn(salt + "_of", F.explode(F.sequence(F.lit(0), F.lit(15))))
        out = out.join(salted, (F.col("mix_source") == got("source")) & (F.col(salt) == F.col(salt + "_of"))).drop(salt, salt + "_of")
    out = out.withColumn("block", block_of(got("n_blocks"), seed))
    last = got("epochs")
    key = block_key(F.col("mix_source"), F.col("block"), last, seed)
    partial = (got("rest") > 0) & (F.col("mix_tokens") > 0) & ((key < got("cut_key")) | ((F.col("block") == got("cut_block")) & (row_key(last, seed) <= got("cut_row"))))
    reads = last + F.coalesce(partial, F.lit(False)).cast("int")
    out = out.withColumn("epoch", F.explode(F.when(reads > 0, F.sequence(F.lit(0), reads - 1)).otherwise(F.array().cast("array<int>"))))
    out = out.withColumns({"block_key": block_key(F.col("mix_source"), F.col("block"), F.col("epoch"), seed), "row_key": row_key(F.col("epoch"), seed), "weight": got("weight")})
    return out.drop(own)


def unused(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it or starts with it."""
    while any(t.lower().startswith(name) for t in taken):
        name += "_"
    return name
