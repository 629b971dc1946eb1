"""Expansion of a graph in rounds, each a version of its own on disk, until little that is new comes out.

A version is a folder that counts once its mark is written, so a run that is stopped goes on after the last
whole version; a version is written once and read by the next round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.skew import first_seen
from tripleloom.operators.clean import conf_filter
from tripleloom.sources.keyed import numbered, write_marked

COLUMNS = ["sentence", "head", "relation", "tail", "confidence", "is_new", "round"]
SCORED = "sentence string, head string, relation string, tail string, confidence double"


def with_known_pairs(sentences: DataFrame, known: DataFrame) -> DataFrame:
    """Each sentence once, with the unordered pairs already related in it as ``known_pairs`` (array of ``a``, ``b``).

    The pairs of a sentence are of names inside it, so the array is bounded by the sentence."""
    pair = F.struct(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b"))
    pairs = known.groupBy("sentence").agg(F.collect_set(pair).alias("known_pairs"))
    none = F.array().cast("array<struct<a: string, b: string>>")
    once = sentences.where(F.col("sentence").isNotNull()).dropDuplicates(["sentence"])
    return once.join(pairs, "sentence", "left").withColumn("known_pairs", F.coalesce("known_pairs", none))


def one_round(known: DataFrame, sentences: DataFrame, scorer: Callable, number: int, threshold: float = 0.5, none: str = "none") -> DataFrame:
    """``known`` and what a scorer finds for pairs not yet related, surest first (``rank`` within a sentence).

    ``scorer`` maps batches of the sentences, with their known pairs, to (sentence, head, relation, tail, confidence).  Sure ones
    (``threshold`` or more, another relation than ``none``) of pairs that neither direction of is known are added, the surest of
    each (head, tail); a name is not related to itself.
    """
    scored = with_known_pairs(sentences, known).mapInPandas(scorer, SCORED)
    sure = conf_filter(scored, threshold, ">=", skip_label=none).where(F.col("head") != F.col("tail"))
    best = first_seen(sure.select("sentence", "head", "tail", "relation", "confidence", (-F.col("confidence")).alias("_c")), ["sentence", "head", "tail"], ["_c", "relation"])
    pair = [F.least("head", "tail").alias("_a"), F.greatest("head", "tail").alias("_b")]
    linked = known.select("sentence", *pair).distinct()
    fresh = best.select("*", *pair).join(linked, ["sentence", "_a", "_b"], "left_anti")
    fresh = fresh.withColumn("is_new", F.lit(True)).withColumn("round", F.lit(number))
    both = known.withColumn("is_new", F.lit(False)).select(*COLUMNS).unionByName(fresh.select(*COLUMNS))
    order = [F.desc("confidence"), F.col("is_new"), "head", "relation", "tail"]
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("sentence").orderBy(*order)))


def path_of(folder: str, number: int) -> str:
    return f"{folder}/version={number}"


def version(spark, folder: str, number: int) -> DataFrame:
    return spark.read.parquet(path_of(folder, number))


def ratio(spark, folder: str, number: int) -> float:
    """New relations of a version against those of the version before; 1.0 where that one was empty."""
    new, every = version(spark, folder, number).agg(F.count_if("is_new"), F.count(F.lit(1))).first()
    return new / (every - new) if every > new else 1.0


def expand_rounds(seed: DataFrame, sentences: DataFrame, scorer: Callable, folder: str, threshold: float = 0.5, none: str = "none",
                  max_rounds: int = 5, least_ratio: float = 0.01) -> DataFrame:
    """The last version of a graph expanded in rounds: version 0 is ``seed`` (sentence, head, relation, tail, confidence).

    Ends after ``max_rounds``, or with a round whose new relations are less than ``least_ratio`` of those before.  Versions that are there
    already are taken as they are, so a stopped run goes on, and a finished one returns its last version at once.
    """
    spark = seed.sparkSession
    done = numbered(spark, folder, "version")
    if not done:
        start = seed.withColumn("is_new", F.lit(False)).withColumn("round", F.lit(0)).select(*COLUMNS)
        order = [F.desc("confidence"), F.col("head"), F.col("relation"), F.col("tail")]
        write_marked(start.withColumn("rank", F.row_number().over(Window.partitionBy("sentence").orderBy(*order))), path_of(folder, 0))
    last = done[-1] if done else 0
    while last < max_rounds and not (last and ratio(spark, folder, last) < least_ratio):
        known = version(spark, folder, last).drop("rank")
        write_marked(one_round(known, sentences, scorer, last + 1, threshold, none), path_of(folder, last + 1))
        last += 1
    return version(spark, folder, last)
