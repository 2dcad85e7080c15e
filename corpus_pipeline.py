"""From documents to packed training sequences: five of the training-data operators, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import mixing, packing, quality, similarity_join, toxicity
from roadweave.llm.catalog import vocabulary
from roadweave.llm.common import discard, stage, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and a similarity of 0.8 the one with the smallest id stays.

    Rows go by a key written once, so rows with a null or a repeated id are documents of their own; a null id comes last.
    """
    keyed = stage(docs.withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    joined = similarity_join.near_duplicates(keyed, n_words=5, percent=80, id_col="row_key")
    found = joined.select(F.col("doc_id").alias("row_key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    kept = found.join(keyed.select("row_key", "doc_id"), "row_key").groupBy("component_id").agg(first.alias("first"))
    kept = stage(kept.select(F.col("first.row_key").alias("row_key")), "kept")
    discard(*joined.reads)
    return keyed.join(kept, "row_key", "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at a temperature at which none is read more than twice as often as the largest, and none less than once."""
    return mixing.mix(docs, repeat=2.0).select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: for each piece its document, ids (little-endian, 16 bits: the vocabulary has 49k), sequence and place there."""
    pieces = packing.cut_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096, kind="<u2")
    plan = packing.pack(pieces.drop("ids"), capacity=4096)
    return plan.join(pieces.select("uid", "ids"), "uid").select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stage(docs, f"stage-{number}")
    return docs
