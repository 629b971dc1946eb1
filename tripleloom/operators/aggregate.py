"""Counts, histograms and statistics.  All combine on the map side; totals are scalar subqueries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions import constants as K
from tripleloom.functions.session import staged
from tripleloom.functions.skew import group_ranked, ranked

def rows() -> Column:
    return F.count(F.lit(1))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(rows().alias("nodes"), edges.agg(rows()).scalar().alias("edges"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(rows().alias("n"))


def weight_hist(df: DataFrame, weight: str) -> DataFrame:
    """Rows per non-null weight."""
    return value_counts(df.where(F.col(weight).isNotNull()), weight)


def context_coverage(edges: DataFrame) -> DataFrame:
    """Edges per relation, edges with a context sentence, and the share of all edges that have one."""
    has = F.count_if(F.col("sentence").isNotNull())
    per = edges.groupBy("relation").agg(rows().alias("edges"), has.alias("with_context"))
    total = per.agg(F.round(F.coalesce(F.try_divide(F.sum("with_context"), F.sum("edges")), F.lit(0.0)), 6)).scalar()
    return per.withColumn("graph_ratio", total)


def attribute_fill(nodes: DataFrame, attributes: Sequence[str]) -> DataFrame:
    return nodes.agg(rows().alias("nodes"), *[F.count(a).alias(f"with_{a}") for a in attributes])


def endpoints(edges: DataFrame) -> DataFrame:
    """One row per edge end, from one scan; a self-loop touches its node once."""
    ends = F.when(F.col("head") == F.col("tail"), F.array("head")).otherwise(F.array("head", "tail"))
    return edges.select("relation", F.explode(ends).alias("name"))


def degree(edges: DataFrame, over: int | None = None) -> DataFrame:
    """Undirected degree per node; with ``over`` only the hubs."""
    out = value_counts(endpoints(edges), "name").withColumnRenamed("n", "degree")
    return out if over is None else out.where(F.col("degree") > over)


def hub_skew(edges: DataFrame) -> DataFrame:
    """Per hub the share of each relation; ``flagged`` when one relation dominates.

    The window runs over counts: one row per node and relation.
    """
    counts = value_counts(endpoints(edges), "name", "relation")
    total = F.sum("n").over(Window.partitionBy("name"))
    shares = counts.withColumn("degree", total).where(F.col("degree") > K.HUB_DEGREE).withColumn("share", F.col("n") / F.col("degree"))
    return shares.withColumn("flagged", (F.col("share") > K.HUB_SHARE) & (F.col("n") > K.HUB_RELATION_COUNT))


def extract_stats(triples: DataFrame) -> DataFrame:
    names = triples.select(F.explode(F.array("head", "tail")).alias("e"))
    return triples.agg(rows().alias("records"), F.count_distinct("relation").alias("relations"),
                       F.avg(F.length("sentence")).alias("mean_length"),
                       names.agg(F.count_distinct("e")).scalar().alias("entities"))


def class_dist(df: DataFrame, label: str) -> DataFrame:
    counts = value_counts(df, label)
    return counts.withColumn("ratio", F.col("n") / counts.agg(F.sum("n")).scalar())


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * n_c) and inverse weight n / n_c."""
    counts = value_counts(df, label)
    total, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count(label)).scalar()
    return counts.select(label, "n", (total / (classes * F.col("n"))).alias("balanced"),
                                          (total / F.col("n")).alias("inverse"))


def group_sentence(triples: DataFrame, order: Sequence[str]) -> DataFrame:
    """Mentions with the running id of their sentence (sorted, from 0) and their place in it.

    One row per mention instead of one nested record per sentence, so a sentence may have
    any number of mentions.  Null sentences are dropped.
    """
    kept = staged(triples.where(F.col("sentence").isNotNull()))
    return group_ranked(kept, "sentence", order, "id", "mention_no").withColumn("id", F.col("id") - 1)


def extend_stats(mentions: DataFrame) -> DataFrame:
    """Per sentence: mentions, mean confidence (0 when there is none), number of new ones."""
    return mentions.groupBy("sentence").agg(rows().alias("mentions"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
                                            F.count_if("is_new").alias("new_relations"))


def extend_ratio(previous: DataFrame, current: DataFrame, version: int) -> DataFrame:
    """New relations against the relations of the version before; 1.0 for the first or after an empty one."""
    before = previous.agg(rows()).scalar()
    new = current.agg(F.count_if("is_new").alias("new_relations"), before.alias("previous"))
    first = F.lit(version < 2) | (F.col("previous") == 0)
    return new.withColumn("ratio", F.when(first, 1.0).otherwise(F.greatest(F.lit(0.0), F.try_divide("new_relations", "previous"))))


def schema_infer(records: DataFrame, type_: str, role: str) -> DataFrame:
    """Distinct (type, role) pairs: the type list, role list and type-to-role map in long form."""
    return records.select(type_, role).where(F.col(type_).isNotNull()).distinct()


# Tokens that come first in every vocabulary.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[MASK]", "[CLS]", "[SEP]", "[BOS]", "[EOS]", "HEAD", "TAIL"]


def vocab(tokens: DataFrame, order: Sequence[str], min_freq: int = 1, special: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """Token ids: special tokens first, then by first appearance; rare tokens dropped.

    ``tokens`` has a ``token`` column.  Ranking works on distinct tokens, in ranges.
    """
    special = list(special)
    seen = (tokens.where(~F.col("token").isin(special)).groupBy("token")
            .agg(rows().alias("n"), F.min(F.struct(*order)).alias("_at")).where(F.col("n") >= min_freq))
    ids = ranked(seen, [], ["_at", "token"], "id", stage=True).select("token", "n", (F.col("id") + len(special) - 1).alias("id"))
    first = tokens.sparkSession.createDataFrame([(w, 0, i) for i, w in enumerate(special)], "token string, n bigint, id bigint")
    return first.unionByName(ids)


def top_entity(triples: DataFrame, order: Sequence[str]) -> DataFrame:
    """Most frequent name over both sides; ties go to the one seen first (head before tail)."""
    sides = F.array(F.struct(F.col("head").alias("name"), F.lit(0).alias("side")), F.struct(F.col("tail").alias("name"), F.lit(1).alias("side")))
    names = triples.select(*order, F.explode(sides).alias("e")).groupBy("e.name").agg(rows().alias("n"), F.min(F.struct(*order, "e.side")).alias("_at"))
    return names.orderBy(F.desc("n"), "_at").limit(1).drop("_at")


def longest(df: DataFrame, key: str, text: str) -> DataFrame:
    """Longest text, its length, and a length bound rounded up to 64 and capped at 512."""
    return (df.agg(F.min_by(F.struct(F.col(key), F.length(text).alias("length")), F.struct((-F.length(text)).alias("l"), F.col(key))).alias("r"))
            .select("r.*").withColumn("bound", F.least(F.lit(512), F.ceil(F.col("length") / 64) * 64)))


def conf_stats(df: DataFrame, threshold: float, column: str = "confidence") -> DataFrame:
    v = F.col(column)
    return df.agg(F.min(v).alias("lowest"), F.max(v).alias("highest"), F.avg(v).alias("mean"),
                  F.count_if(v >= threshold).alias("kept"), F.count_if(v < threshold).alias("dropped"))


def metric_means(df: DataFrame, metrics: Sequence[str], numerator: str, denominator: str) -> DataFrame:
    """Mean of each metric, and mean ratio where an empty denominator counts as 0."""
    ratio = F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator)).otherwise(0.0)
    return df.agg(*[F.avg(m).alias(m) for m in metrics], F.avg(ratio).alias("recall_rate"))


def rollup_score(counts: DataFrame, category: str, sums: Sequence[str]) -> DataFrame:
    """Sums per category and in total in one pass; the total row has the category ``total``."""
    rolled = counts.rollup(category).agg(F.grouping(category).alias("_g"), *[F.sum(s).alias(s) for s in sums])
    return rolled.withColumn(category, F.when(F.col("_g") == 1, "total").otherwise(F.col(category).cast("string"))).drop("_g")
