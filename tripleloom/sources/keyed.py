"""Tables of one row per key that numbered batches are merged into.

A batch is reduced to one row per key and written to a folder of its number, so its cost follows the batch and
not the table, and a batch that runs again replaces itself.  A reader merges the newest base with the batches
after it; now and then ``compact`` writes what it reads as a new base.  A folder counts once its mark is
written, which is the last step, so whoever is stopped in between leaves nothing half done.

``reduce`` makes one row of each key.  It has to be the same however often and in whatever order rows
are reduced together (first by an order, last filled by an order, sums of distinct batches do not qualify):
then late, repeated and re-run batches give what one batch of all rows gives.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripleloom.functions.session import swept
from tripleloom.functions.skew import first_seen
from tripleloom.operators.joins import attribute_records, merge_records

MARK = "_done"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def finished(spark: SparkSession, path: str) -> bool:
    store, at = _fs(spark, f"{path}/{MARK}")
    return store.exists(at)


def mark(spark: SparkSession, path: str) -> None:
    store, at = _fs(spark, f"{path}/{MARK}")
    store.create(at, True).close()


def drop(spark: SparkSession, path: str) -> None:
    store, at = _fs(spark, path)
    store.delete(at, True)


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the finished folders ``name=<number>`` of a path, ascending."""
    store, at = _fs(spark, path)
    if not store.exists(at):
        return []
    names = [s.getPath().getName() for s in store.listStatus(at)]
    found = sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{name}="))
    return [n for n in found if finished(spark, f"{path}/{name}={n}")]


def write_marked(df: DataFrame, path: str) -> None:
    with swept(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    mark(df.sparkSession, path)


class KeyedTable:
    """``every``: batches after which a new base is written."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, reduce: Callable[[DataFrame], DataFrame], every: int = 16):
        self.spark, self.path, self.reduce, self.every = spark, path, reduce, every
        self.schema = spark.createDataFrame([], schema).schema

    def _state(self) -> tuple[int, list[int]]:
        bases = numbered(self.spark, self.path, "base")
        base = bases[-1] if bases else -1
        return base, [n for n in numbered(self.spark, self.path, "batch") if n > base]

    def merge(self, rows: DataFrame, number: int) -> None:
        """Rows of batch ``number`` (0 or more); a batch that is part of the base already changes nothing."""
        base, _ = self._state()
        if number <= base:
            return
        write_marked(self.reduce(rows).select(*self.schema.names), f"{self.path}/batch={number}")
        if len(self._state()[1]) >= self.every:
            self.compact()

    def replace(self, rows: DataFrame, number: int) -> None:
        """The table becomes these rows, as of batch ``number``."""
        write_marked(self.reduce(rows).select(*self.schema.names), f"{self.path}/base={number}")

    def read(self) -> DataFrame:
        """One row per key; an empty table where nothing is stored."""
        base, batches = self._state()
        paths = ([f"{self.path}/base={base}"] if base >= 0 else []) + [f"{self.path}/batch={n}" for n in batches]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows if len(paths) == 1 else self.reduce(rows).select(*self.schema.names)

    def compact(self) -> None:
        """Write a new base; folders that the base before it replaced go, so readers of that one are not disturbed."""
        base, batches = self._state()
        if not batches:
            return
        write_marked(self.read(), f"{self.path}/base={batches[-1]}")
        for name in ("base", "batch"):
            for n in numbered(self.spark, self.path, name):
                if n < base or (name == "batch" and n <= base):
                    drop(self.spark, f"{self.path}/{name}={n}")


def first_of(keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Keeps the first row of a key by ``order``."""
    return lambda df: first_seen(df, keys, order)


def last_of(keys: Sequence[str], order: Sequence[str | Column]) -> Callable[[DataFrame], DataFrame]:
    """Keeps the last row of a key by ``order``, columns or what is worked out of them."""
    def reduce(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")
    return reduce


KEY = ["head", "relation", "tail"]


class GraphTables:
    """Edges, first arrival per triple, and node records of a graph that typed triples arrive for.

    ``schema`` is that of the typed triples: head, relation, tail, head_type, tail_type and any other columns, among them those of
    ``order``, which must tell rows apart.  ``attributes`` maps an attribute of a node to the columns (or None) that hold it for head and tail.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, order: Sequence[str],
                 attributes: Mapping[str, tuple[str | None, str | None]] | None = None, every: int = 16):
        self.order, self.attributes = [*order], dict(attributes or {})
        self.edge_table = KeyedTable(spark, f"{path}/edges", schema, first_of(KEY, self.order), every)
        empty = self.records(spark.createDataFrame([], schema))
        self.node_table = KeyedTable(spark, f"{path}/nodes", empty.schema, self._merged, every)

    def _merged(self, records: DataFrame) -> DataFrame:
        return records.groupBy("name", "type").agg(F.min("_at").alias("_at"), *[F.max(a).alias(a) for a in self.attributes])

    def records(self, triples: DataFrame) -> DataFrame:
        """Node records of typed triples: (name, type), when first seen, and each attribute's last filled value with its time."""
        def side(end: str, at: int) -> DataFrame:
            given = [(F.col(cols[at]) if cols[at] else F.lit(None).cast("string")).alias(a) for a, cols in self.attributes.items()]
            return triples.select(F.col(end).alias("name"), F.col(f"{end}_type").alias("type"), *given, F.struct(*self.order, F.lit(at).alias("side")).alias("_order"))
        return attribute_records(side("head", 0).unionByName(side("tail", 1)), [*self.attributes], "_order")

    def merge(self, triples: DataFrame, number: int) -> None:
        self.edge_table.merge(triples, number)
        # records are partial results already: reducing them again changes nothing
        self.node_table.merge(self.records(triples), number)

    def edges(self) -> DataFrame:
        return self.edge_table.read()

    def nodes(self, known: DataFrame | None = None) -> DataFrame:
        """Nodes after all batches: ``known`` ones (name, type, attributes) updated, others inserted, with the ``action`` taken."""
        if known is None:
            known = self.node_table.spark.createDataFrame([], "name string, type string" + "".join(f", {a} string" for a in self.attributes))
        return merge_records(known, self.node_table.read(), [*self.attributes])
