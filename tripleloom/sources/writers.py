"""Writers of graphs, predictions and tagged text.  Every output is a folder written by all tasks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions import constants as K
from tripleloom.functions.answers import json_object, pair, quoted
from tripleloom.functions.session import swept
from tripleloom.operators.aggregate import value_counts
from tripleloom.operators.clean import translate


def export_nodes(nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """``name, labels, properties`` ordered by name, labels translated, empty properties left out."""
    filled = F.filter(F.array(*[F.struct(F.lit(a).alias("k"), F.col(a).alias("v")) for a in attributes]), lambda p: p["v"].isNotNull())
    props = F.map_from_entries(filled)
    return nodes.select("name", F.array(translate(F.col("type"), K.EXPORT_TYPE_NAMES)).alias("labels"), props.alias("properties")).orderBy("name", F.col("labels")[0])


def export_edges(edges: DataFrame) -> DataFrame:
    """``source, target, relation`` and properties ordered by source and target, relation translated."""
    return edges.select(F.col("head").alias("source"), F.col("tail").alias("target"), translate(F.col("relation"), K.RELATION_NAMES).alias("relation"),
                        "confidence", F.col("sentence").alias("source_sentence")).orderBy("source", "target", "relation")


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    with swept(df.sparkSession):
        df.write.mode("overwrite").option("ignoreNullFields", "true").option("compression", compression).json(path)


def write_full_graph(nodes: DataFrame, edges: DataFrame, attributes: list[str], path: str, compression: str = "none") -> None:
    """Nodes, edges, statistics and a manifest as four datasets under one folder."""
    write_json(export_nodes(nodes, attributes), f"{path}/nodes", compression)
    write_json(export_edges(edges), f"{path}/edges", compression)
    spark = nodes.sparkSession
    n, e = spark.read.json(f"{path}/nodes", schema="name string, labels array<string>"), spark.read.json(f"{path}/edges", schema="relation string")
    stats = (value_counts(n.select(F.col("labels")[0].alias("value")), "value").withColumn("kind", F.lit("label"))
             .unionByName(value_counts(e.select(F.col("relation").alias("value")), "value").withColumn("kind", F.lit("relation"))))
    write_json(stats, f"{path}/statistics")
    write_json(spark.range(1).select(F.current_timestamp().alias("exported_at"), F.array(F.lit("nodes"), F.lit("edges"), F.lit("statistics")).alias("parts")), f"{path}/manifest")


def display_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct display nodes and links; null or empty parts dropped."""
    full = edges.where((F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != ""))
    links = full.select(F.col("head").alias("source"), F.col("tail").alias("target"), "relation").distinct()
    nodes = full.select(F.explode(F.array("head", "tail")).alias("id")).distinct().withColumn("name", F.col("id"))
    return nodes, links


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction CSV with header; an empty result still writes the header."""
    cols = ["sentence", "head", "tail", "relation", "confidence"]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def tagged_block(tokens: Column, tags: Column) -> Column:
    """``token tag`` lines of one sentence."""
    return F.array_join(F.zip_with(tokens, tags, lambda w, t: F.concat(w, F.lit(" "), t)), "\n")


def write_tagged(df: DataFrame, tokens: str, tags: str, path: str) -> None:
    """``token tag`` lines with a blank line after each sentence."""
    df.select(tagged_block(F.col(tokens), F.col(tags)).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def json_to_csv(spark, src: str, dst: str, schema: str) -> None:
    spark.read.json(src, schema=schema).write.mode("overwrite").csv(dst, header=True, quoteAll=True, escape='"')


def csv_to_json(spark, src: str, dst: str, schema: str) -> None:
    spark.read.csv(src, schema=schema, header=True, escape='"').write.mode("overwrite").json(dst)


def jsonld(head: Column, relation: Column, tail: Column, urls: Mapping[str, str]) -> Column:
    """Linked-data JSON of one triple: its id is the head, the relation leads to its address and value."""
    table = F.create_map(*[F.lit(x) for kv in urls.items() for x in kv])
    url = F.coalesce(F.try_element_at(table, relation), F.lit(""))
    context = json_object(F.array(pair(relation, quoted(url))))
    return json_object(F.array(pair(F.lit("@context"), context), pair(F.lit("@id"), quoted(head)), pair(relation, quoted(tail))))
