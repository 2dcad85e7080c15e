"""URL filter: rules by host and path, and a ratio of character language models for what no rule decides.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are learned from all URLs that a rule
decides, but for a fold kept for calibration. A model's counts are of whole n-grams, contexts up to ``ORDER`` characters and
the one after, in distributed tables that grow with the distinct n-grams and are joined with those of the URLs scored; a
longer context is backed by the next shorter one in the proportion of its distinct continuations (Witten-Bell). A URL is allowed if the difference of its log-likelihoods a character reaches the threshold that has the
best balanced accuracy on the kept fold.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is scored as the empty text,
whose difference is 0; without decided URLs every difference and the threshold are 0, so the verdict is allow. Rows that repeat
an id are judged each for itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import stage

ORDER = 5
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWERED), F.regexp_extract(url, parts, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, given as (verdict, host and path); nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def windows(rows: DataFrame) -> DataFrame:
    """(key, gram) for every character of every row (key, url): the character after its whole context of ``ORDER`` characters.

    Each text is preceded by as many NULs as a context holds. All shorter n-grams that end at the place are suffixes of it.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            padded = ["\0" * ORDER + t for t in texts]
            grams = [p[i : i + ORDER + 1] for p in padded for i in range(len(p) - ORDER)]
            keys = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(t) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.string())], ["key", "gram"])

    return rows.select("key", "url").mapInArrow(run, "key long, gram string")


def counts(rows: DataFrame) -> DataFrame:
    """(gram, accepted, rejected) of every window of rows (key, url, verdict, learned), written: counts of the learned rows, 0 for the others'."""
    learned = windows(rows.where("learned and verdict = 'allow'")).select("gram", F.lit(1).alias("accepted"), F.lit(0).alias("rejected"))
    learned = learned.unionByName(windows(rows.where("learned and verdict <> 'allow'")).select("gram", F.lit(0).alias("accepted"), F.lit(1).alias("rejected")))
    others = windows(rows.where("not learned")).select("gram", F.lit(0).alias("accepted"), F.lit(0).alias("rejected"))
    return stage(learned.unionByName(others).groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-counts")


def ratios(table: DataFrame) -> DataFrame:
    """(gram, ratio) of every row of ``counts``: log of the character's chance as accepted less that as rejected, in units of 2**-32.

    A level's table has a row for each distinct n-gram of its order, keyed by the n-gram itself, and joins the level below by
    the n-gram's suffix; the counts of a context are summed over its own n-grams. Nothing is gathered on the driver.
    """
    levels = [table]
    for order in range(ORDER, 0, -1):
        shorter = levels[0].groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
        levels.insert(0, shorter)
    below = None
    for order, level in enumerate(levels):
        own = Window.partitionBy(F.substring("gram", 1, order))
        level = level.withColumns({f"{k}_{what}": e.over(own) for k in ("accepted", "rejected") for what, e in (("n", F.sum(k)), ("kinds", F.count_if(F.col(k) > 0)))})
        if below is None:
            level = level.withColumns({"accepted_p": F.lit(1 / 256), "rejected_p": F.lit(1 / 256)})
        else:
            level = level.withColumn("suffix", F.substring("gram", 2, order)).join(below, "suffix")
        p = [F.when(F.col(f"{k}_n") > 0, (F.col(k) + F.col(f"{k}_kinds") * F.col(f"{k}_p")) / (F.col(f"{k}_n") + F.col(f"{k}_kinds"))).otherwise(F.col(f"{k}_p")).alias(f"{k}_p") for k in ("accepted", "rejected")]
        below = level.select(F.col("gram").alias("suffix"), *p)
    return below.select(F.col("suffix").alias("gram"), F.round((F.log("accepted_p") - F.log("rejected_p")) * 2**32).cast("long").alias("ratio"))


def scored(rows: DataFrame) -> DataFrame:
    """rows (key, url, verdict, learned, ...) with llr: log-likelihood as accepted less that as rejected, a character; written."""
    found = windows(rows).join(stage(ratios(counts(rows)), "url-ratios"), "gram").groupBy("key").agg((F.sum("ratio") / F.count("*") / 2**32).alias("llr"))
    return stage(rows.join(found, "key", "left").withColumn("llr", F.coalesce("llr", F.lit(0.0))), "urls-scored")


def threshold(decided: DataFrame) -> float:
    """The cut with the best balanced accuracy over all rows of the kept fold, from a histogram of fixed size."""
    cell = F.least(F.greatest(F.round(F.col("llr") * 100).cast("int"), F.lit(-1000)), F.lit(1000))
    found = decided.groupBy(cell.alias("cell")).agg(F.count_if(F.col("verdict") == "allow").alias("yes"), F.count_if(F.col("verdict") != "allow").alias("no")).orderBy("cell").collect()
    yes, no = sum(r["yes"] for r in found), sum(r["no"] for r in found)
    if not yes or not no:
        return 0.0
    best, cut, above, below = -1.0, 0.0, yes, 0
    for r in found:
        if (value := above / yes + below / no) > best:
            best, cut = value, (r["cell"] - 0.5) / 100
        above, below = above - r["yes"], below + r["no"]
    return cut if math.isfinite(cut) else 0.0


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", folds: int = 5) -> DataFrame:
    """(page_id, host, path, rule, verdict, llr) of every row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.col("verdict").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(folds)) != 0)
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "key": F.monotonically_increasing_id()})
    rows = scored(stage(rows.withColumn("learned", learned), "urls"))
    cut = threshold(rows.where("verdict is not null and not learned"))
    decision = F.coalesce("verdict", F.when(F.col("llr") >= cut, "allow").otherwise("block"))
    return rows.select("page_id", "host", "path", "rule", decision.alias("verdict"), "llr")
