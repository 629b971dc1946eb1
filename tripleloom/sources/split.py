"""Records of large single files, cut by many tasks: CSV with quoted line breaks, and elements of JSON arrays.

A file is read in pieces that end at a character every record holds (a line end, a closing brace), which Spark
splits anywhere.  Whether a piece begins inside quotes, and how deep, depends on all before it, so one pass
sums up each split for either answer (quotes it holds, depth it adds when it begins outside or inside a string), the
sums of all splits of a file are combined in order, and a second pass cuts records with the state
each split begins in.  Only the records that cross splits are put together afterwards.

The state is one row per split (128 MB by default): 100 TB have under a million.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUMMARY = "file string, block long, quotes int, outside long, inside long, opener string"
RECORDS = "file string, block long, kind string, first boolean, value string"
WHOLE, HEAD, MIDDLE, TAIL = "whole", "head", "middle", "tail"
STRUCTURE = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
CHANGED = "the splits of the input changed between two reads; keep spark.sql.files.minPartitionNum and maxPartitionBytes fixed"


def pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Text between two ends, in the order of the file within a task, with the file and split it comes from."""
    return (spark.read.option("lineSep", end).text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        yield from zip(zip(batch["file"], batch["block"]), batch["value"])


class Csv:
    """Pieces are lines; a quote opens or closes a field, a doubled one does both."""
    end = "\n"

    @staticmethod
    def add(sums: list, value: str) -> None:
        sums[0] ^= value.count('"') & 1

    def __init__(self, quotes: int, depth: int, level: int):
        self.open = bool(quotes)

    def inside(self) -> bool:
        return self.open

    def feed(self, value: str) -> Iterator[tuple[str, bool]]:
        """Parts of records in a piece, each with whether the record ends there."""
        if value.count('"') & 1:
            self.open = not self.open
        yield (value + "\n", False) if self.open else (value.removesuffix("\r"), True)


class Json:
    """Pieces end before a closing brace; records are what opens at depth ``level``."""
    end = "}"

    @staticmethod
    def add(sums: list, value: str) -> None:
        if sums[3] is None and value.strip():
            sums[3] = value.strip()[0]
        quotes, deep = sums[0], [sums[1], sums[2]]
        for m in STRUCTURE.finditer(value):
            c = m.group()
            if c == '"':
                quotes ^= 1
            elif c in "{[":
                deep[quotes] += 1
            elif c in "}]":
                deep[quotes] -= 1
        deep[quotes] -= 1
        sums[0], sums[1], sums[2] = quotes, *deep

    def __init__(self, quotes: int, depth: int, level: int):
        self.quoted, self.depth, self.level = bool(quotes), depth, level

    def inside(self) -> bool:
        return self.depth > self.level

    def feed(self, value: str) -> Iterator[tuple[str, bool]]:
        value += "}"
        start = 0 if self.inside() else None
        for m in STRUCTURE.finditer(value):
            c = m.group()
            if c == '"':
                self.quoted = not self.quoted
            elif not self.quoted and c in "{[":
                if self.depth == self.level:
                    start = m.start()
                self.depth += 1
            elif not self.quoted and c in "}]":
                self.depth -= 1
                if self.depth == self.level and start is not None:
                    yield value[start:m.end()], True
                    start = None
        if start is not None:
            yield value[start:], False


def summaries(given: DataFrame, kind) -> DataFrame:
    """One row per split: whether its quotes are odd, what it adds to the depth either way, and its first character."""
    def of(batches):
        sums: dict = {}
        for at, value in runs(batches):
            kind.add(sums.setdefault(at, [0, 0, 0, None]), value)
        yield pd.DataFrame([[*at, *s] for at, s in sums.items()], columns=["file", "block", "quotes", "outside", "inside", "opener"])
    return given.mapInPandas(of, SUMMARY)


def start_states(given: DataFrame, kind) -> dict[tuple[str, int], tuple[int, int, str]]:
    """For each split: odd quotes before it, depth it begins at, and the first character of its file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quoted = summaries(given, kind).withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    deep = quoted.withColumn("adds", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
    first = F.first("opener", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = deep.select("file", "block", "odd", F.coalesce(F.sum("adds").over(before), F.lit(0)).alias("depth"), first.alias("opener")).collect()
    return {(r["file"], r["block"]): (r["odd"], r["depth"], r["opener"]) for r in rows}


def records(spark: SparkSession, path: str, kind, level: int = 0, object_level: int | None = None) -> DataFrame:
    """(file, block, first, value): the text of every record, with the split it begins in and whether it is the file's first one.

    ``level`` is the depth that records open at, ``object_level`` the one for files that begin with a brace.
    """
    given = pieces(spark, path, kind.end)
    states = start_states(given, kind)
    shared = spark.sparkContext.broadcast(states)            # one row per split

    def cut(batches):
        out: list[tuple] = []
        at = reader = None
        held: list[str] = []
        seen = 0                                              # records begun in this split
        crossing = False                                      # the record held began before this split

        def leave():
            if at is not None and reader.inside() and held:
                out.append((*at, MIDDLE if crossing else TAIL, not crossing and at[1] == 0 and seen == 0, "".join(held)))
        for batch in batches:
            for where, value in runs([batch]):
                if where != at:
                    leave()
                    if where not in shared.value:
                        raise RuntimeError(CHANGED)
                    odd, depth, opener = shared.value[where]
                    reader = kind(odd, depth, object_level if object_level is not None and opener == "{" else level)
                    at, held, seen, crossing = where, [], 0, reader.inside()
                for part, ends in reader.feed(value):
                    held.append(part)
                    if ends:
                        out.append((*at, HEAD if crossing else WHOLE, not crossing and at[1] == 0 and seen == 0, "".join(held)))
                        seen += not crossing
                        held, crossing = [], False
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=["file", "block", "kind", "first", "value"])
                out.clear()
        leave()
        yield pd.DataFrame(out, columns=["file", "block", "kind", "first", "value"])

    found = given.mapInPandas(cut, RECORDS)
    whole = found.where(F.col("kind") == WHOLE).select("file", "block", "first", "value")
    # a record that crosses splits: the end of one, whole ones, the beginning of another; it is named after the split it begins in
    parts = found.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == TAIL)
    owned = parts.withColumn("begin", F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = owned.groupBy("file", F.col("begin").alias("block")).agg(
        F.max("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == TAIL).alias("late"), "value"))), lambda p: p["value"]), "").alias("value"))
    return whole.unionByName(joined.where("block is not null"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files whose quotes all belong to quoted fields; a record that a file leaves open is kept as it is."""
    return records(spark, path, Csv)


def json_elements(spark: SparkSession, path: str, level: int = 1, object_level: int = 0) -> DataFrame:
    """Elements of JSON arrays; with the defaults also objects one after another, such as JSON lines.

    A file that ends inside an element loses that element.
    """
    return records(spark, path, Json, level, object_level)
