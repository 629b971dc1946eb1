"""Import of exported graphs into tables kept by key.

Nodes are kept by name and first label, edges by source, relation and target.  An import has a number: it
overwrites the rows of its keys and leaves all others, or takes the place of everything when it is told
to clean.  An import that runs again replaces itself, and one that is stopped leaves the tables as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.sources.keyed import KeyedTable, last_of
from tripleloom.sources.split import json_elements

# Fixed value: the label of a node that comes without one.
DEFAULT_LABEL = "实体"
NODES = "name string, label string, labels array<string>, properties map<string,string>, number bigint"
EDGES = "source string, relation string, target string, properties map<string,string>, number bigint"


class ImportedGraph:
    """The tables of imported nodes and edges under ``path``."""

    def __init__(self, spark: SparkSession, path: str, every: int = 16):
        # what tells rows apart is worked out where they are compared: it is as large as the properties and not stored beside them
        self.spark = spark
        self.node_table = KeyedTable(spark, f"{path}/nodes", NODES, last_of(["name", "label"], ["number", content("labels")]), every)
        self.edge_table = KeyedTable(spark, f"{path}/edges", EDGES, last_of(["source", "relation", "target"], ["number", content("relation")]), every)

    def nodes(self) -> DataFrame:
        return self.node_table.read().select("name", "labels", "properties")

    def edges(self) -> DataFrame:
        """Edges whose two ends are nodes."""
        names = self.node_table.read().select("name").distinct()
        edges = self.edge_table.read().select("source", "target", "relation", "properties")
        for end in ("source", "target"):
            edges = edges.join(names.withColumnRenamed("name", end), end, "left_semi")
        return edges.select("source", "target", "relation", "properties")

    def put_nodes(self, nodes: DataFrame, number: int, clean: bool = False) -> None:
        """Nodes (name, labels, properties); those without a name are left out, those without labels have the default one."""
        labels = F.filter(F.coalesce("labels", F.array()), lambda x: F.coalesce(x, F.lit("")) != "")
        rows = nodes.where(F.coalesce("name", F.lit("")) != "").select(
            "name", F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(DEFAULT_LABEL))).alias("labels"), F.coalesce("properties", no_properties()).alias("properties"))
        rows = rows.select("name", F.col("labels")[0].alias("label"), "labels", "properties", F.lit(number).cast("bigint").alias("number"))
        (self.node_table.replace if clean else self.node_table.merge)(rows, number)

    def put_edges(self, edges: DataFrame, number: int, clean: bool = False) -> None:
        """Edges (source, target, relation, properties); those without one of the three are left out."""
        filled = [F.coalesce(c, F.lit("")) != "" for c in ("source", "relation", "target")]
        rows = edges.where(filled[0] & filled[1] & filled[2]).select(
            "source", "relation", "target", F.coalesce("properties", no_properties()).alias("properties"), F.lit(number).cast("bigint").alias("number"))
        (self.edge_table.replace if clean else self.edge_table.merge)(rows, number)


def no_properties() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def content(other: str) -> Column:
    """A text that tells rows of one key and import apart, so that always the same one of them stays."""
    return F.to_json(F.struct(F.sort_array(F.map_entries("properties")).alias("p"), F.col(other).alias("o")))


def export_rows(spark: SparkSession, path: str, names: list[str], arrays: list[str] = (), lines: bool = True, level: int = 1) -> DataFrame:
    """Objects of an export: the named fields, and as properties all fields of ``properties`` and all others that are not null.

    ``lines`` reads one object a line, otherwise arrays (``level`` 1) or graph objects (``level`` 2) are cut by many tasks.
    """
    text = spark.read.text(path).select("value") if lines else json_elements(spark, path, 1, 2 if level == 2 else 0).select("value")
    # filters of callers stop at a generator, so an object is parsed once and not once more for each of them
    fields = text.select(F.explode(F.array(F.from_json("value", "map<string,string>"))).alias("all")).where("all is not null")
    given = F.from_json(F.try_element_at("all", F.lit("properties")), "map<string,string>")
    own = F.map_filter(F.coalesce(given, no_properties()), lambda k, v: v.isNotNull())
    rest = F.map_filter("all", lambda k, v: ~k.isin([*names, "properties"]) & v.isNotNull() & ~F.map_contains_key(F.col("own"), k))
    field = lambda n: (F.from_json(F.try_element_at("all", F.lit(n)), "array<string>") if n in arrays else F.try_element_at("all", F.lit(n))).alias(n)
    return fields.select(*[field(n) for n in names], "all", own.alias("own")).select(*names, F.map_concat(rest, "own").alias("properties"))


def import_nodes(spark: SparkSession, path: str, graph: ImportedGraph, number: int, clean: bool = False, lines: bool = True) -> None:
    graph.put_nodes(export_rows(spark, path, ["name", "labels"], ["labels"], lines), number, clean)


def import_edges(spark: SparkSession, path: str, graph: ImportedGraph, number: int, clean: bool = False, lines: bool = True) -> None:
    graph.put_edges(export_rows(spark, path, ["source", "target", "relation"], (), lines), number, clean)


def import_graph(spark: SparkSession, path: str, graph: ImportedGraph, number: int, clean: bool = True) -> None:
    """Both parts of an export folder (``nodes`` and ``edges``, one object a line)."""
    import_nodes(spark, f"{path}/nodes", graph, number, clean)
    import_edges(spark, f"{path}/edges", graph, number, clean)


def import_graph_file(spark: SparkSession, path: str, graph: ImportedGraph, number: int, clean: bool = True) -> None:
    """A graph object in one file: ``{"nodes": [...], "relationships": [...]}``."""
    graph.put_nodes(export_rows(spark, path, ["name", "labels"], ["labels"], False, 2), number, clean)
    graph.put_edges(export_rows(spark, path, ["source", "target", "relation"], (), False, 2), number, clean)
