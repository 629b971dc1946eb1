"""A corpus prepared for training: five stages over ``documents``, each written before the next reads it.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return
the columns of documents.  Null texts, ids and labels, and empty tables, are treated as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.session import staged
from tripleloom.llm import mixing, packing, simhash, suffix_dedup, toxicity
from tripleloom.llm.common import small_batches, table

PASSAGE = 256        # bytes of a repeated string that goes


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    trained = toxicity.trained_on(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")     # names may clash with the score's
    return toxicity.score(rows, trained).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; a null id comes after all others."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes or more that occur again are taken out of the texts; every document stays.

    A passage of 50 words has about 320 bytes, and the words of some are shorter."""
    return suffix_dedup.without_repeats(docs, length=PASSAGE).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated at rates that bring the domains to their target weights."""
    labels = table(spark, sf_dir, "labels")
    return mixing.mixed(docs, mixing.fit(docs, mixing.labelled_domains(docs, labels)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


def batched(stage):
    def with_small_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)
    return with_small_batches


STAGES = [(name, batched(stage)) for name, stage in (
    ("toxicity", drop_toxic), ("simhash", drop_near_copies), ("suffix_dedup", cut_repeats), ("mixing", mix), ("packing", pack))]

# No stage but the packing of known lengths can be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs)
    return docs
