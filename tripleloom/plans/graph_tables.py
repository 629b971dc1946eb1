"""The knowledge graph derived from the driver tables.

``raw_triples`` / ``edges`` / ``nodes`` build it with DataFrames, ``KG`` states the same
tables as SQL text for the oracle.  Types and relations use the teaching-course vocabulary
so that the schema, curation and template tables all apply to part of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.skew import first_seen
from tripleloom.plans.registry import Tables

ORDER = ["row_no", "head", "relation", "tail"]


def _row(no: Column, head: Column, head_type: str, relation: Column, tail: Column, tail_type: str,
         confidence: Column, sentence: Column) -> list[Column]:
    return [no.cast("long").alias("row_no"), head.alias("head"), F.lit(head_type).alias("head_type"),
            relation.alias("relation"), tail.alias("tail"), F.lit(tail_type).alias("tail_type"),
            confidence.cast("double").alias("confidence"), sentence.cast("string").alias("sentence")]


def raw_triples(t: Tables) -> DataFrame:
    c = F.col
    none = F.lit(None)
    order_name = F.concat(F.lit("Order#"), c("o_orderkey").cast("string"))
    line_order = F.concat(F.lit("Order#"), c("l_orderkey").cast("string"))
    part_name = F.concat(F.lit("Part#"), c("l_partkey").cast("string"))
    line_no = c("l_orderkey") * 10 + c("l_linenumber")
    customer = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).select(*_row(
        F.lit(1000000000000) + c("c_custkey"), c("c_name"), "ApplicationScenario", F.lit("locatedIn"),
        c("n_name"), "Complexity", (c("c_custkey") % 101) / 100.0,
        F.when(c("c_custkey") % 3 == 0, none).otherwise(F.concat("c_name", F.lit(" is in "), "n_name"))))
    nation = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select(*_row(
        F.lit(3000000000000) + c("n_nationkey"), c("n_name"), "Complexity", F.lit("partOf"),
        c("r_name"), "PrincipleOrProperty", F.lit(1.0), F.concat("n_name", F.lit(" is part of "), "r_name")))
    placed = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select(*_row(
        F.lit(4000000000000) + c("o_orderkey"), order_name, "Operation",
        F.when(c("o_orderstatus") == "F", "appliesTo").otherwise("usedIn"), c("c_name"), "ApplicationScenario",
        F.when(c("o_orderkey") % 10 == 0, none).otherwise((c("o_orderkey") % 97) / 100.0), none))
    def line(no: int, *parts) -> Column:
        return F.struct(*_row(F.lit(no) + line_no, *parts))
    supplied = line(5000000000000, c("s_name"), "Algorithm",
                    F.when(c("l_returnflag") == "A", "uses").when(c("l_returnflag") == "R", "implementedAs")
                     .otherwise("appliesTo"),
                    part_name, "DataStructure", F.lit(1.0) - c("l_discount"),
                    F.when(c("l_linenumber") == 1, none).otherwise(F.concat("s_name", F.lit(" supplies "), part_name)))
    uses = line(6000000000000, part_name, "DataStructure", F.lit("uses"), line_order, "Operation", none, none)
    applied = line(7000000000000, line_order, "Operation", F.lit("appliesTo"), c("s_name"), "Algorithm", none, none)
    # all triples of a line come from one scan of the largest table; lines are dealt out before they multiply
    both = F.filter(F.array(supplied, F.when(c("l_linestatus") == "O", uses), F.when(c("l_linestatus") == "F", applied)),
                    lambda x: x.isNotNull())
    fields = ["l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_returnflag", "l_linestatus", "s_name"]
    lines = (t.lineitem.join(t.supplier, c("l_suppkey") == c("s_suppkey")).select(*fields).repartition("l_orderkey", "l_linenumber")
             .select(F.explode(both).alias("x")).select("x.*"))
    return customer.unionByName(nation).unionByName(placed).unionByName(lines)


def edges(t: Tables, *columns: str) -> DataFrame:
    """The first triple of each head, relation and tail; ``columns`` names those wanted beside row number and confidence, where not all are."""
    raw = raw_triples(t).select(*ORDER, "confidence", *columns) if columns else raw_triples(t)
    return first_seen(raw, ["head", "relation", "tail"], ["row_no", "confidence"])


def nodes(t: Tables) -> DataFrame:
    """Every name and type, with the attributes of customers, suppliers and parts.

    Names carry their table in them, so the five kinds do not overlap and the node
    table needs no pass over the edges."""
    c = F.col
    none = F.lit(None).cast("string")

    def kind(df, name, type_, description=none, properties=none, complexity=none, space=none, operations=none):
        return df.select(name.alias("name"), F.lit(type_).alias("type"), description.alias("description"), properties.alias("properties"),
                         complexity.alias("time_complexity"), space.alias("space_complexity"), operations.alias("common_operations"))

    return (kind(t.customer, c("c_name"), "ApplicationScenario", c("c_mktsegment"),
                 F.when(c("c_custkey") % 4 != 0, F.concat(F.lit("balance "), c("c_nationkey").cast("string"))))
            .unionByName(kind(t.nation, c("n_name"), "Complexity"))
            .unionByName(kind(t.region, c("r_name"), "PrincipleOrProperty"))
            .unionByName(kind(t.orders, F.concat(F.lit("Order#"), c("o_orderkey").cast("string")), "Operation"))
            .unionByName(kind(t.supplier, c("s_name"), "Algorithm", operations=F.concat(F.lit("ships from "), c("s_nationkey").cast("string"))))
            .unionByName(kind(t.part, F.concat(F.lit("Part#"), c("p_partkey").cast("string")), "DataStructure",
                              c("p_name"), none, c("p_type"), c("p_brand"))))


KG = """WITH kg_raw AS (
SELECT CAST(1000000000000 + c_custkey AS BIGINT) AS row_no, c_name AS head, 'ApplicationScenario' AS head_type,
       'locatedIn' AS relation, n_name AS tail, 'Complexity' AS tail_type,
       CAST(c_custkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat(c_name, ' is in ', n_name) END AS sentence
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT CAST(3000000000000 + n_nationkey AS BIGINT), n_name, 'Complexity', 'partOf', r_name, 'PrincipleOrProperty',
       CAST(1 AS DOUBLE), concat(n_name, ' is part of ', r_name)
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT CAST(4000000000000 + o_orderkey AS BIGINT), concat('Order#', CAST(o_orderkey AS VARCHAR)), 'Operation',
       CASE WHEN o_orderstatus = 'F' THEN 'appliesTo' ELSE 'usedIn' END, c_name, 'ApplicationScenario',
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 97 AS DOUBLE) / CAST(100 AS DOUBLE) END, NULL
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT CAST(5000000000000 + l_orderkey * 10 + l_linenumber AS BIGINT), s_name, 'Algorithm',
       CASE l_returnflag WHEN 'A' THEN 'uses' WHEN 'R' THEN 'implementedAs' ELSE 'appliesTo' END,
       concat('Part#', CAST(l_partkey AS VARCHAR)), 'DataStructure', CAST(1 AS DOUBLE) - l_discount,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE concat(s_name, ' supplies Part#', CAST(l_partkey AS VARCHAR)) END
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
UNION ALL
SELECT CAST(6000000000000 + l_orderkey * 10 + l_linenumber AS BIGINT), concat('Part#', CAST(l_partkey AS VARCHAR)),
       'DataStructure', 'uses', concat('Order#', CAST(l_orderkey AS VARCHAR)), 'Operation', NULL, NULL
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'O'
UNION ALL
SELECT CAST(7000000000000 + l_orderkey * 10 + l_linenumber AS BIGINT), concat('Order#', CAST(l_orderkey AS VARCHAR)),
       'Operation', 'appliesTo', s_name, 'Algorithm', NULL, NULL
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'F'
), kg_edges AS (
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY head, relation, tail ORDER BY row_no, confidence) AS rn
                            FROM kg_raw) WHERE rn = 1
), kg_nodes AS (
SELECT c_name AS name, 'ApplicationScenario' AS type, c_mktsegment AS description,
       CASE WHEN c_custkey % 4 <> 0 THEN concat('balance ', CAST(c_nationkey AS VARCHAR)) END AS properties,
       CAST(NULL AS VARCHAR) AS time_complexity, CAST(NULL AS VARCHAR) AS space_complexity, CAST(NULL AS VARCHAR) AS common_operations FROM customer
UNION ALL SELECT n_name, 'Complexity', NULL, NULL, NULL, NULL, NULL FROM nation
UNION ALL SELECT r_name, 'PrincipleOrProperty', NULL, NULL, NULL, NULL, NULL FROM region
UNION ALL SELECT concat('Order#', CAST(o_orderkey AS VARCHAR)), 'Operation', NULL, NULL, NULL, NULL, NULL FROM orders
UNION ALL SELECT s_name, 'Algorithm', NULL, NULL, NULL, NULL, concat('ships from ', CAST(s_nationkey AS VARCHAR)) FROM supplier
UNION ALL SELECT concat('Part#', CAST(p_partkey AS VARCHAR)), 'DataStructure', p_name, NULL, p_type, p_brand, NULL FROM part
)"""


def kg(body: str) -> str:
    """SQL over the derived graph; ``body`` may start with more CTEs (``, name AS (...)``)."""
    return f"{KG}\n{body}"
