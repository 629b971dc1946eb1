"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.session import staged


BATCH_ROWS = 2000    # whole texts handed to Python at once


def small_batches(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MOST_BITS = 28       # log2 of the largest bit array (32 MB)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` under a key that Spark does not take for the one it is grouped by: a join on it deals both
    sides anew, and adaptive execution may split a hub's partition, which it may not after a grouping."""
    return df.withColumn("u", F.coalesce("u", F.lit(0).cast("long")))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable over undirected edges (a, b): rows (node, component).

    Alternating large and small stars.  Only minima are gathered per node, so a hub of any size
    meets its label in an aggregate with map-side combine and in a join that adaptive execution can
    split.  Every round is written to the shared folder; the loop ends when a round changes nothing.
    Nodes without an edge, and each component's smallest node, have no row: the caller coalesces.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars, seen = staged(edges.where(F.col("a") != F.col("b")).select(u, v).distinct()), None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = dealt(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(low), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = staged(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        mark = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark


def forest(n: int, chunks: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row number reachable from each of ``n`` rows, given linked pairs in chunks: roots are
    hooked to smaller roots and paths halved until nothing changes."""
    root = np.arange(n)
    for a, b in chunks:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            ra, rb = ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root != root[root]).any():
                root = root[root]
    return root


def bits_of(values: DataFrame, name: str):
    """Broadcast bit array of a column of 64-bit hashes: 64 bits a value, at most 2^MOST_BITS bits in all.

    A filter without false negatives; when the array is full it merely passes more."""
    spark, n = values.sparkSession, values.count()
    size = min(MOST_BITS, max(16, (64 * n).bit_length()))
    slot = F.shiftrightunsigned(F.col(name), 64 - size)
    words = (values.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned({name}, {64 - size}) & 63 as int)))").alias("bits"))
             .toArrow())
    out = np.zeros(1 << (size - 6), np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(out)


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def marked_rows(name: str, shared) -> Column:
    @F.pandas_udf("boolean")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(marked(shared.value, values.to_numpy(np.int64).view(np.uint64)))
    return of(F.col(name))
