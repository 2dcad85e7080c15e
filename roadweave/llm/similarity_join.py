"""Exact Jaccard join of shingle sets by partitions of the universe, as components of linked documents.

Two sets with 100 * intersection >= percent * union differ in at most (100 - percent) * (sizes added) / (100 + percent)
elements. Sizes are cut into bands whose edges grow by 100 / percent, so partners are in the same or a neighbouring band;
a set's keys are those of its own band and of the one below. A band hashes the universe into segments. With H the most
differences that a set of the band can have with a larger partner, segments looked at for equality count 1 and those
looked at for at most one difference, by one-deletion neighbourhoods, count 2; they add up to H + 1, so some
segment must agree. ``allocate`` chooses how many of either by the number of keys and the chance of subsets too small to tell texts
apart; one-deletion segments win for small sets. In bands of equality segments alone a set emits only its first H + 1 segments that
aren't empty; a set without as many also emits its empty ones (if two sets agree in empty segments alone, neither has as many).

Equal sets are one class from the start. The first ``turns`` link each class with one class of each of its key groups; what the
links leave in different components is then compared within the groups, in blocks, after an exact bound from parity
bitmaps. Every link is verified on the whole sets. So components come out exactly, without making all pairs of a group.

Defined results: a null text, or one without words, has no shingles and is linked with nothing; its component is its own
id. Rows with equal ids are documents of their own that share the id; a null id never becomes a component's id unless all its
documents have none. An empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import discard, lean, partitions, stage
from roadweave.llm.components import components
from roadweave.llm.shingles import PLACE, Words, mix, shingle_sets

CLASS = ["h1", "h2", "n"]


def differences(a: int, b: int, percent: int) -> int:
    """The most elements in which sets of these sizes may differ."""
    return (100 - percent) * (a + b) // (100 + percent)


@functools.lru_cache(100_000)
def band(size: int, percent: int) -> tuple[int, int]:
    """Number and largest size of the band of a size."""
    k, top = 0, 1
    while top < size:
        k, top = k + 1, max(top + 1, 100 * (top + 1) // percent)
    return k, top


@functools.lru_cache(10_000)
def top_of(number: int, percent: int) -> int:
    top = 1
    for _ in range(number):
        top = max(top + 1, 100 * (top + 1) // percent)
    return top


@functools.lru_cache(10_000)
def allocate(number: int, percent: int) -> tuple[int, int, int]:
    """(segments looked at for equality, segments with one-deletion neighbourhoods, spare equality segments) of a band."""
    top = top_of(number, percent)
    need = differences(top, 100 * top // percent, percent) + 1

    def cost(near: int) -> float:
        exact = need - 2 * near
        each = top / (exact + near)
        tiny = math.exp(-each) * (1 + each)
        return exact + near * (1 + each) + 40 * tiny * (exact + near)

    near = min(range(need // 2 + 1), key=cost)
    return need - 2 * near, near, 0 if near else 2 + need // 20


def keys_of(found: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set and whether each is of a deletion."""
    size = len(found)
    own, _ = band(size, percent)
    keys, deleted = [], []
    for number in (own, own - 1) if own else (own,):
        exact, near, spare = allocate(number, percent)
        top = top_of(number, percent)
        if number < own and size > 100 * top // percent:
            continue
        m = exact + near + spare
        most = differences(size, 100 * size // percent, percent) if number == own else min(differences(size, size, percent), differences(top, 100 * top // percent, percent))
        of = (((found >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        scrambled = mix(found[order] + PLACE[40])
        filled, begin = np.unique(of[order], return_index=True)
        sums = np.add.reduceat(scrambled, begin) if size else np.zeros(0, np.uint64)
        salt = mix(np.arange(m, dtype=np.uint64) * PLACE[41] + np.full(1, number, np.uint64) * PLACE[42])
        if near or len(filled) <= most:
            every = np.zeros(m, np.uint64)
            every[filled] = sums
            keys.append(mix(every + salt))
            deleted.append(np.zeros(m, bool))
            if near:
                part = of[order] < near
                keys.append(mix(every[of[order][part]] - scrambled[part] + salt[of[order][part]]))
                deleted.append(np.ones(int(part.sum()), bool))
        else:
            keys.append(mix(sums + salt[filled])[: most + 1])
            deleted.append(np.zeros(most + 1, bool))
    return np.concatenate(keys), np.concatenate(deleted)


def set_hash(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    return int(mix(found + PLACE[50]).sum().astype(np.int64)), int(mix(found ^ PLACE[51]).sum().astype(np.int64))


def parity(found: np.ndarray) -> bytes:
    """Parities of the hashes by place. Bits number a power of two, the size at least, from 64 to 8192."""
    bits = 1 << min(13, max(6, (len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def measured(docs: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, n, h1, h2, parity) of every row, written."""

    def run(batches):
        words = Words()
        for batch in batches:
            out = [(len(x), *set_hash(x), parity(x)) for x in shingle_sets(batch.column(1), n_words, words)]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 3 + (pa.binary(),), strict=True))], ["doc_id", "n", "h1", "h2", "parity"])

    return stage(docs.mapInArrow(lean(run), "doc_id long, n long, h1 long, h2 long, parity binary"), "measured")


def key_groups(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """(gid, ref): the classes, by their first hash, that share a key; groups of the same classes once for each task.

    The keys are shuffled and sorted; a group is then read as a stream, so none is held, however large. A negative ref
    stands for a deletion; a group without a whole subset, or with one class only, is dropped.
    """

    def emit(batches):
        words, seen = Words(), set()
        for batch in batches:
            keys, refs = [], []
            for found in shingle_sets(batch.column(1), n_words, words):
                if not len(found):
                    continue
                own = set_hash(found)
                if own in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(own)
                k, gone = keys_of(found, percent)
                ref = own[0] & (1 << 62) - 1
                keys.append(k)
                refs.append(np.where(gone, -ref - 1, ref))
                if sum(map(len, keys[-200:])) > 200_000 or len(keys) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(refs))], ["key", "ref"])
                    keys, refs = [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(refs))], ["key", "ref"])

    def group(batches):
        held_k, held_r, lists = np.zeros(0, np.int64), np.zeros(0, np.int64), set()
        big: list | None = None  # of a key longer than a batch: key, number of whole classes, first ref, whether others came

        def finish(k, r):
            """Whole groups in sorted order -> the rows worth keeping."""
            who = np.where(r < 0, -r - 1, r)
            order = np.lexsort((who, k))
            k, who, whole = k[order], who[order], (r >= 0)[order]
            first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (who[1:] != who[:-1]))))
            whole = np.logical_or.reduceat(whole, first)
            k, who = k[first], who[first]
            start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.concatenate((start, [len(k)])))
            ok = (size > 1) & np.logical_or.reduceat(whole, start)
            name = np.add.reduceat(mix(who.astype(np.uint64) + PLACE[45]), start).astype(np.int64)
            keep = np.zeros(len(start), bool)
            for g in np.flatnonzero(ok).tolist():
                if (x := int(name[g])) not in lists:
                    if len(lists) > 500_000:
                        lists.clear()
                    lists.add(x)
                    keep[g] = True
            rows = np.repeat(keep, size)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[rows]), pa.array(who[rows])], ["gid", "ref"])

        for batch in batches:
            k = np.concatenate((held_k, batch.column(0).to_numpy()))
            r = np.concatenate((held_r, batch.column(1).to_numpy()))
            if not len(k):
                continue
            end = int(np.searchsorted(k, k[-1]))
            if big is not None:
                stop = int(np.searchsorted(k, big[0], "right"))
                if stop:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(stop, big[0])), pa.array(np.where(r[:stop] < 0, -r[:stop] - 1, r[:stop]))], ["gid", "ref"])
                if stop == len(k):
                    held_k, held_r = k[:0], r[:0]
                    continue
                k, r, end, big = k[stop:], r[stop:], max(0, end - stop), None
            if end:
                yield finish(k[:end], r[:end])
            held_k, held_r = k[end:], r[end:]
            if len(held_k) > 200_000:  # a huge group: passed on row by row under its own key
                big = [held_k[0]]
                yield pa.RecordBatch.from_arrays([pa.array(held_k), pa.array(np.where(held_r < 0, -held_r - 1, held_r))], ["gid", "ref"])
                held_k, held_r = k[:0], r[:0]
        if len(held_k):
            yield finish(held_k, held_r)

    keys = docs.mapInArrow(lean(emit), "key long, ref long")
    keys = keys.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key")
    every = stage(keys.mapInArrow(lean(group), "gid long, ref long"), "groups")
    groups = stage(every.distinct(), "groups")
    discard(every)
    return groups


def sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n_words: int, few: int = 500_000) -> DataFrame:
    """(cid, items) of the classes in pairs, from the text of one document each. Up to ``few`` ids, which are counted, are broadcast; more are joined."""
    cids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = stage(classes.join(cids, "cid").select(F.col("rep").alias("doc_id"), *CLASS, "cid"), "wanted")
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    rows = docs.join(F.broadcast(ids) if wanted.count() <= few else ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi")

    def run(batches):
        words = Words()
        for batch in batches:
            out = [(len(x), *set_hash(x), x.tobytes()) for x in shingle_sets(batch.column(1), n_words, words)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 3 + (pa.binary(),), strict=True)], ["n", "h1", "h2", "items"])

    sets = rows.mapInArrow(lean(run), "n long, h1 long, h2 long, items binary")
    sets = sets.join(F.broadcast(wanted.select(*CLASS, "cid")) if wanted.count() <= few else wanted.select(*CLASS, "cid"), CLASS)
    sets = stage(sets.select("cid", "items").dropDuplicates(["cid"]), "sets")
    discard(wanted)
    return sets


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those whose whole sets are similar enough: (u, v), written."""
    pairs = stage(pairs, "pairs")
    sets = sets_of(docs, classes, pairs, n_words)
    left = sets.select(F.col("cid").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("items").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    links = stage(rows.mapInArrow(lean(run), "u long, v long"), "links")
    discard(pairs, sets)
    return links


def folded(rows: list[bytes], size: int) -> np.ndarray:
    """Parities of equal length, folded to ``size`` bytes: a smaller table of places holds the parities of those that meet in it."""
    whole = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    while whole.shape[1] > size:
        half = whole.shape[1] // 2
        whole = whole[:, :half] ^ whole[:, half:]
    return whole


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which of the pairs of places (a, b) their parities leave possible: places that differ are at most the elements that do."""
    length = np.array([len(x) for x in bits])
    la, lb = length[a], length[b]
    out = np.zeros(len(a), bool)
    for x, y in {*zip(la.tolist(), lb.tolist(), strict=True)}:
        here = np.flatnonzero((la == x) & (lb == y))
        for at in range(0, len(here), max(1, 8_000_000 // max(x, y))):
            part = here[at : at + max(1, 8_000_000 // max(x, y))]
            size = min(x, y)
            apart = np.bitwise_count(folded([bits[i] for i in a[part]], size) ^ folded([bits[i] for i in b[part]], size)).sum(axis=1, dtype=np.int64)
            out[part] = apart * (100 + percent) <= (100 - percent) * (n[a[part]] + n[b[part]])
    return out


def owned(x: frozenset | None, y: frozenset | None, gid: int) -> bool:
    """Whether a pair of classes with these first groups is made in this group."""
    return x is None or y is None or min(x & y, default=gid) == gid


def compared(rows: DataFrame, sketches: DataFrame, percent: int, star: bool) -> DataFrame:
    """Pairs (a, b) of rows (gid, i, j, side, own, cid, n, root, first) of a group: of all in different components, or of each with the first.

    ``sketches`` has the parity of every cid, which joins the rows here, so it moves once.

    A group and its blocks are rows that stand together, 2 * ``block`` at most. Rows of side 0 are paired with all, those of side 1
    with side 0 only. Where j is -1, the rows of side 0 stand in every block, and two of them meet in the block that the one
    with the smaller cid owns. Sizes and parities are held against the bound at once,
    so pairs that can't be links aren't made as rows. ``first`` holds the smallest groups of a class, or null. The least that the
    lists of two classes share is the least group that they share at all; a pair is made there alone, or wherever the lists share none.
    """

    def emit(cols, seen):
        gid, i, j, side, own, cid, n, root, bits, first_of = cols
        start = np.flatnonzero(np.concatenate(([True], (gid[1:] != gid[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        size = np.diff(np.concatenate((start, [len(gid)])))
        left, right, held = [], [], 0

        def settle():
            a, b = np.concatenate(left), np.concatenate(right)
            meet = np.where(j[a] < 0, (side[b] == 1) | (np.where(cid[a] < cid[b], own[a], own[b]) == i[a]), (i[a] == j[a]) | (own[a] != own[b]))
            ok = (root[a] != root[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & meet
            a, b = a[ok], b[ok]
            _, first = np.unique(np.stack((np.minimum(cid[a], cid[b]), np.maximum(cid[a], cid[b]))), axis=1, return_index=True)
            a, b = a[first], b[first]
            ok = possible(a, b, n, bits, percent)
            a, b = a[ok], b[ok]
            here = np.array([owned(first_of[x], first_of[y], g) for x, y, g in zip(a.tolist(), b.tolist(), gid[a].tolist(), strict=True)], bool)
            a, b = cid[a[here]], cid[b[here]]
            out = [p for p in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True) if p not in seen]
            if len(seen) < 500_000:
                seen.update(out)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], []))], ["a", "b"])

        for s, k in zip(start.tolist(), size.tolist(), strict=True):
            for x in range(s, s + 1 if star else s + min(k - 1, int((side[s : s + k] == 0).sum()))):
                right.append(np.arange(x + 1, s + k))
                left.append(np.full(s + k - x - 1, x))
                held += s + k - x - 1
                if held > 500_000:
                    yield settle()
                    left, right, held = [], [], 0
        if held:
            yield settle()

    def run(batches):
        seen: set[tuple[int, int]] = set()
        held = None
        for batch in batches:
            now = [*(c.to_numpy() for c in batch.columns[:8]), batch.column(8).to_pylist(), [x and frozenset(x) for x in batch.column(9).to_pylist()]]
            if not len(now[0]):
                continue
            held = now if held is None else [*(np.concatenate((x, y)) for x, y in zip(held[:8], now[:8], strict=True)), held[8] + now[8], held[9] + now[9]]
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if end:
                yield from emit([c[:end] for c in held], seen)
                held = [c[end:] for c in held]
        if held is not None:
            yield from emit(held, seen)

    rows = rows.join(sketches, "cid").select("gid", "i", "j", "side", "own", "cid", "n", "root", "parity", "first").repartition(partitions(rows.sparkSession), "gid", "i", "j").sortWithinPartitions("gid", "i", "j", "side", "own", "cid")
    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def open_members(members: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """Members with their root, of the groups that have two roots or more, and how many blocks such a group makes."""
    members = members.join(roots.withColumnRenamed("u", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    several = members.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo != hi")
    return members.join(several.select("gid", F.ceil(F.col("k") / block).cast("int").alias("blocks")), "gid")


def stars(members: DataFrame, sketches: DataFrame, roots: DataFrame, percent: int, turn: int, block: int = 1000) -> DataFrame:
    """Each class of a group with one that a hash of the turn chooses; the members of a large group are dealt out, that one goes to all.

    A class that has the same one in several groups meets it in the least of them.
    """
    rows = open_members(members, roots, block)
    heads = rows.groupBy("gid", "blocks").agg(F.min_by(F.struct("cid", "n", "root"), F.struct(F.xxhash64("cid", F.lit(turn)), "cid")).alias("h"))
    rest = rows.join(heads.select("gid", F.col("h.cid").alias("head")), "gid").where("cid != head")
    rest = rest.groupBy("cid", "head").agg(F.min("gid").alias("gid"), F.min_by(F.struct("blocks", "n", "root"), "gid").alias("x")).select("cid", "gid", "x.*")
    rest = rest.select("gid", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("i"), F.lit(1).alias("own"), "cid", "n", "root")
    heads = heads.select("gid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("own"), "h.*")
    return compared(rest.unionByName(heads).withColumns({"j": F.col("i"), "side": F.lit(0), "first": F.lit(None).cast("array<long>")}), sketches, percent, star=True)


def unsettled(members: DataFrame, sketches: DataFrame, roots: DataFrame, percent: int, block: int = 1000, listed: int = 32) -> DataFrame:
    """All pairs of a group that are in different components and that sizes and parities leave possible.

    Mostly one component holds nearly all of a large group. Where at most ``block`` classes are outside its largest component,
    they alone go to all of its blocks, so work grows with them and not with the square of the group; other groups are
    compared in pairs of blocks.
    """
    rows = stage(open_members(members, roots, block), "open")
    lists = rows.groupBy("cid").agg(F.slice(F.array_sort(F.collect_set("gid")), 1, listed).alias("first"))
    sizes = rows.groupBy("gid", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("gid").agg(F.max_by("root", F.struct("size", "root")).alias("main"), (F.sum("size") - F.max("size")).alias("outside"))
    rows = rows.join(lists, "cid").join(main, "gid").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    inside = (F.col("outside") <= block) & (F.col("root") == F.col("main"))
    rows = rows.withColumn("other", F.explode(F.when(inside, F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    few = F.col("outside") <= block
    at = {"i": F.when(few, F.col("other")).otherwise(F.least("own", "other")), "j": F.when(few, F.lit(-1)).otherwise(F.greatest("own", "other")), "side": inside.cast("int")}
    return compared(rows.withColumns(at), sketches, percent, star=False)


def release(spark: SparkSession) -> None:
    """Shuffle files of frames that are gone can be deleted now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, turns: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; ``reads`` are the written frames that it reads."""
    spark = docs.sparkSession
    rows = rows_of(docs, id_col, text_col)
    seen = measured(rows, n_words)
    classes = seen.where("n > 0").groupBy(*CLASS).agg(F.min("doc_id").alias("rep"), F.max("parity").alias("parity"))
    classes = stage(classes.withColumns({"cid": F.monotonically_increasing_id(), "ref": F.col("h1").bitwiseAND(F.lit((1 << 62) - 1))}), "classes")
    groups = key_groups(rows, n_words, percent)
    release(spark)
    members = stage(groups.join(classes.select("ref", "cid", "n"), "ref").drop("ref"), "members")
    discard(groups)
    sketches = classes.select("cid", "parity")
    links = spark.createDataFrame([], "u long, v long")
    roots = spark.createDataFrame([], "u long, root long")
    for turn in range(turns):
        links = links.unionByName(verified(stars(members, sketches, roots, percent, turn), rows, classes, n_words, percent))
        roots = stage(components(links), "roots")
        release(spark)
    more = verified(unsettled(members, sketches, roots, percent), rows, classes, n_words, percent)
    release(spark)
    roots = components(links.unionByName(more))
    named = classes.join(roots.withColumnRenamed("u", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(named.join(least, "root").select(*CLASS, "component_id"), "named")
    discard(members, classes)
    linked = seen.join(named, CLASS, "left")
    found = linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    found.reads = (seen, named)
    return found
