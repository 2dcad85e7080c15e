"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut at every white-space character into units; a run of more than ``LONG`` code points without any gives, from each
of its positions, the ``GRAM`` code points there as a unit, so its units don't depend on where a passage starts. Rolling hashes
of ``k`` neighbouring units are taken, and from each window of ``w`` of them the least, the rightmost of equals, with its position. So any
run of w + k - 1 units that two texts share gives both an equal hash, and no match is shorter than k units. A selected
hash is kept as one long: 40 bits of hash above 24 bits that fall with the position (taken modulo 2**24).

Defined results: a null or empty text has the empty fingerprint; a text of fewer than k units has one hash of all
of them, one of fewer than w hashes the least of them. Two empty fingerprints are alike to degree 1, an empty and another one 0.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import partitions

LOW = (1 << 24) - 1
LONG, GRAM = 32, 8
#: Unicode White_Space, as the inside of a character class.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Holds all of it beyond ASCII. A text without any of these is cut at the ASCII part, whose single characters the engine looks up in a table.
BEYOND, ASCII_SPACE = r"\x85\xA0\u1680-\u3000", r"\t\n\x0B\f\r "


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def units(text: Column) -> Column:
    """The hashes of the units, in order."""
    runs = F.when(F.rlike(text, F.lit(f"[{BEYOND}]")), F.split(text, f"[{SPACE}]", -1)).otherwise(F.split(text, f"[{ASCII_SPACE}]", -1))

    def grams(run: Column) -> Column:
        return let(F.split(run, "", -1), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.xxhash64(*(F.get(c, i + j) for j in range(GRAM)))))

    def hashed(runs: Column) -> Column:
        long = F.flatten(F.transform(runs, lambda run: F.when(F.length(run) > LONG, grams(run)).otherwise(F.array(F.xxhash64(run)))))
        return F.when(F.exists(runs, lambda run: F.length(run) > LONG), long).otherwise(F.transform(runs, lambda run: F.xxhash64(run)))

    return let(runs, hashed)


def winnow(text: Column, k: int = 4, w: int = 8) -> Column:
    """The selected hashes of a text with their positions, in order of position: array<bigint>."""

    def grams(h: Column) -> Column:
        whole = F.slice(h, 1, F.greatest(F.size(h) - k + 1, F.lit(1)))
        return F.transform(whole, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))).bitwiseAND(F.lit(~LOW)).bitwiseOR(F.lit(LOW) - i.bitwiseAND(F.lit(LOW))))

    def least(g: Column) -> Column:
        """Of each window, from those of windows half as wide; what a window lacks beyond the end is null, which ``least`` skips."""
        m, span = g, 1
        while span < w:
            step = min(span, w - span)
            m, span = let(m, partial(lambda step, a: F.transform(a, lambda x, i: F.least(x, F.get(a, i + step))), step)), span + step
        return F.slice(m, 1, F.greatest(F.size(g) - w + 1, F.lit(1)))

    def changes(m: Column) -> Column:
        """A hash with its position is selected by neighbouring windows only, unless positions repeat."""
        apart = F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1)))
        return F.when(F.size(m) > LOW - w, apart).otherwise(F.array_distinct(m))

    found = let(units(text), lambda h: let(grams(h), lambda g: let(least(g), changes)))
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(found)


def shown(selected: Column) -> Column:
    """``hash@position`` of each selected hash."""
    one = lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, 24))), F.lit("@"), (F.lit(LOW) - x.bitwiseAND(F.lit(LOW))).cast("string"))
    return F.array_join(F.transform(selected, one), " ")


def hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda x: F.shiftrightunsigned(x, 24)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, object]:
    """Rows (key, doc_id, text, ghost, bucket) and the window in which the row before is the next one by descending id.

    Ids are cut into ranges by approximate quantiles, each range is a window group, and the last document of a range
    also stands, as a ghost, at the start of the following one (that of the last range at the start of the first). So the texts
    are shuffled once, and no task sees more than its ranges. What reaches the driver is a row for each range.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    n = 4 * partitions(spark)
    keys = docs.select(key.alias("key"))
    cuts = keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or [0]
    bucket = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < F.col("key")))
    last = [(r["bucket"], r["key"]) for r in keys.withColumn("bucket", bucket).groupBy("bucket").agg(F.max("key").alias("key")).orderBy("bucket").collect()]
    rows = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = rows.withColumns({"ghost": F.lit(0), "bucket": bucket})
    to = {k: last[(i + 1) % len(last)][0] for i, (_, k) in enumerate(last)}
    ghosts = rows.where(F.col("key").isin(list(to))).withColumns({"ghost": F.lit(1), "bucket": F.element_at(F.create_map(*(F.lit(x) for kv in to.items() for x in kv)), F.col("key"))}) if to else None
    return own.unionByName(ghosts) if to else own, Window.partitionBy("bucket").orderBy(F.col("ghost").desc(), "key", F.xxhash64("text"), "text")


def fingerprints(docs: DataFrame, k: int = 4, w: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, selected): the fingerprint of every text, without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), winnow(text, k, w).alias("selected"))


def edited_fingerprints(docs: DataFrame, k: int = 4, w: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and that of the next document by descending id."""
    rows, order = with_next(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("following", F.lag("text").over(order))
    edited = F.concat(F.substring("text", 1, F.length("text") - half), F.substring("following", 1, half))
    rows = rows.select("*", F.coalesce(edited, F.lit("")).alias("edited"))
    rows = rows.select("bucket", "ghost", "key", "doc_id", "text", "edited", winnow(F.col("text"), k, w).alias("selected"), winnow(F.col("edited"), k, w).alias("edited_selected"))
    rows = rows.withColumn("next_selected", F.lag("selected").over(order)).where("ghost = 0")
    own = hashes(F.col("selected"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        shown(F.col("selected")).alias("fingerprint"),
        shown(F.col("edited_selected")).alias("edited_fingerprint"),
        let(own, lambda a: likeness(a, hashes(F.col("edited_selected")))).alias("near_edited"),
        let(own, lambda a: likeness(a, hashes(F.col("next_selected")))).alias("near_next"),
    )
