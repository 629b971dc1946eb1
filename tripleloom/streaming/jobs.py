"""Streaming jobs: tagging arriving texts, and ingesting arriving triples into a typed graph."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tripleloom.functions.session import shared_dir
from tripleloom.operators import clean as C
from tripleloom.operators.graph import understand
from tripleloom.sources.keyed import GraphTables, drop, write_marked

DEFAULT_TYPE = "ENTITY"


def annotate_stream(texts: DataFrame, text: str, entities, relations, families, target: str, checkpoint: str) -> StreamingQuery:
    """Intent, entities and relations of arriving texts.  Stateless; the sink commits whole batches."""
    out = understand(texts, text, entities, relations, families)
    return (out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def clean_triples(triples: DataFrame) -> DataFrame:
    named = triples.withColumn("head", C.norm_entity(F.col("head"))).withColumn("tail", C.norm_entity(F.col("tail")))
    return named.where(C.valid_triple(F.col("head"), F.col("relation"), F.col("tail")))


def fault(head: Column, relation: Column, tail: Column) -> Column:
    """Why a cleaned triple is no triple; null if it is one."""
    empty = [F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"empty {n}")) for c, n in ((head, "head"), (relation, "relation"), (tail, "tail"))]
    return F.coalesce(*empty, F.when(head == tail, F.lit("head equals tail")))


def typed_schema(schema: StructType) -> StructType:
    """Schema of the typed triples that arriving ones of ``schema`` become."""
    out = StructType([f for f in schema.fields if f.name not in ("head_type", "tail_type")])
    return out.add("head_type", "string").add("tail_type", "string")


def typed(triples: DataFrame, types: DataFrame | None) -> DataFrame:
    """Types of both ends: the given one, else that of the dictionary (entity, type; one row per entity), else the default."""
    out = triples
    for end in ("head", "tail"):
        given = F.col(f"{end}_type") if f"{end}_type" in triples.columns else F.lit(None).cast("string")
        out = out.withColumn(f"{end}_type", F.when(F.coalesce(given, F.lit("")) != "", given))
        if types is not None:
            kinds = types.select(F.col("entity").alias(end), F.col("type").alias("_type"))     # left to the optimiser's size check
            out = out.join(kinds, end, "left").withColumn(f"{end}_type", F.coalesce(f"{end}_type", "_type")).drop("_type")
        out = out.withColumn(f"{end}_type", F.coalesce(f"{end}_type", F.lit(DEFAULT_TYPE)))
    return out


def tables(spark: SparkSession, target: str, schema: StructType, arrival: str = "arrival",
           attributes: Mapping[str, tuple[str | None, str | None]] | None = None, every: int = 16) -> GraphTables:
    """The graph an ingesting stream keeps at ``target``; ``schema`` is that of the arriving triples."""
    order = [c for c in (arrival, "row_no") if c in schema.names]
    return GraphTables(spark, target, typed_schema(schema), [*order, *[c for c in ("confidence", "sentence") if c in schema.names]], attributes, every)


def data_error(err: BaseException | None) -> bool:
    """Whether an error lies in the data (class 22 of the SQL states, or a ``ValueError`` of the caller's own code).

    Lost executors, missing files, full disks and programming errors are none: the stream must stop and run the batch again.
    """
    while err is not None:
        state = getattr(err, "getSqlState", lambda: None)()
        if isinstance(err, ValueError) or (state or "").startswith("22"):
            return True
        err = getattr(err, "_cause", None) or err.__cause__
    return False


def ingest_stream(triples: DataFrame, arrival: str, target: str, failed: str, checkpoint: str,
                  store: Callable[[DataFrame, int], None] | None = None, types: DataFrame | None = None,
                  attributes: Mapping[str, tuple[str | None, str | None]] | None = None, every: int = 16) -> StreamingQuery:
    """Clean and type arriving triples and merge them, batch by batch, into the graph at ``target`` (see ``tables``).

    Edges keep the first arrival per triple over all batches, nodes their first type and last filled attributes; nothing is dropped
    for being late.  A batch that runs again replaces itself.  Rows that are no triples go to ``failed`` with a reason, the
    rest of their batch is stored; a batch that cannot be stored for its data goes there whole.  Any other error stops the stream,
    which repeats the batch when started again.  ``store`` takes (typed triples, batch number) in place of the graph.
    """
    keep = tables(triples.sparkSession, target, triples.schema, arrival, attributes, every)
    store = store or keep.merge

    def save(batch: DataFrame, number: int) -> None:
        named = batch.withColumn("head", C.norm_entity(F.col("head"))).withColumn("tail", C.norm_entity(F.col("tail")))
        held = shared_dir(batch.sparkSession)       # read three times: written small, where a cache would lie on the disks as it is
        try:
            write_marked(named.withColumn("reason", fault(F.col("head"), F.col("relation"), F.col("tail"))), held)
            judged = batch.sparkSession.read.parquet(held)
            bad = judged.where("reason is not null")
            if not bad.isEmpty():
                write_marked(bad, f"{failed}/batch={number}")
            good = typed(judged.where("reason is null").drop("reason"), types)
            store(good.select(*keep.edge_table.schema.names), number)
        except Exception as err:
            if not data_error(err):
                raise
            write_marked(batch.withColumn("reason", F.lit(str(err))), f"{failed}/batch={number}")
        finally:
            drop(batch.sparkSession, held)

    return (triples.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def stored(spark: SparkSession, target: str, schema: StructType, arrival: str = "arrival") -> DataFrame:
    """The ingested triples: first arrival per triple over all batches."""
    return tables(spark, target, schema, arrival).edges()
