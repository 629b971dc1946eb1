"""Sources, sinks and streams: files are written from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.functions import constants as K
from tripleloom.functions import tags as G
from tripleloom.functions.session import shared_dir, swept
from tripleloom.plans.graph_tables import edges, kg, nodes, raw_triples
from tripleloom.plans.queries_clean import FAMILIES, sql_case, sql_ladder
from tripleloom.plans.queries_stats import word_tag
from tripleloom.plans.registry import query
from tripleloom.sources import importer as I
from tripleloom.sources import readers as R
from tripleloom.sources import writers as W
from tripleloom.streaming import jobs

c = F.col
TRIPLES = "SELECT c_name AS head, 'locatedIn' AS relation, n_name AS tail, concat(c_name, ', \"in\" ', n_name) AS sentence FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'"


def _triples(t):
    """Triples of customers; those of one segment have an empty relation, which readers drop."""
    rel = F.when(c("c_mktsegment") == "BUILDING", "").otherwise("locatedIn")
    return t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).select(
        c("c_name").alias("subject"), rel.alias("predicate"), c("n_name").alias("object"), F.concat("c_name", F.lit(', "in" '), "n_name").alias("text"))


@query("src_triples_csv", TRIPLES)
def _(t):
    path = shared_dir(t.spark)
    _triples(t).write.csv(path, header=True, escape='"', quoteAll=True)
    return R.triples_csv(t.spark, path)


@query("src_triples_json", f"{TRIPLES} UNION ALL SELECT s_name, 'locatedIn', n_name, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    listed, graphs = shared_dir(t.spark), shared_dir(t.spark)
    _triples(t).select(F.to_json(F.array(F.struct("*"))).alias("value")).write.text(listed)
    rel = F.struct(c("s_name").alias("source"), c("n_name").alias("target"), F.lit("locatedIn").alias("relation"))
    t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select(F.array(rel).alias("relationships")).write.json(graphs)
    return R.triples_json(t.spark, listed, multiline=False).unionByName(R.triples_json(t.spark, graphs, multiline=False, exported=True))


@query("src_offsets_json", kg("""SELECT row_no, head, tail, CAST(0 AS INTEGER) AS head_offset, CAST(strpos(sentence, tail) - 1 AS INTEGER) AS tail_offset, head_type FROM kg_raw WHERE sentence IS NOT NULL""").replace("SELECT row_no, head, tail, CAST(0", "SELECT head, tail, CAST(0"))
def _(t):
    path = shared_dir(t.spark)
    e = raw_triples(t).where("sentence is not null")
    at = lambda col: G.find_first(c("sentence"), c(col)).cast("string")
    e.select("sentence", "head", "tail", at("head").alias("head_offset"), G.find_first(c("sentence"), c("tail")).alias("tail_offset"), "head_type", "tail_type", "relation").write.json(path)
    return R.offsets_json(t.spark, path, multiline=False).select("head", "tail", "head_offset", "tail_offset", "head_type")


@query("src_type_dict", "SELECT p_name AS entity, arg_max(p_type, p_partkey) AS type FROM part GROUP BY 1")
def _(t):
    path = shared_dir(t.spark)
    one = F.concat(F.lit(" "), "p_name", F.lit(","), "p_type", F.lit(" "))
    # every 2nd line is short and skipped; rows are written in key order, so the last one is the highest key
    t.part.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select(F.explode(F.array(c("p_name"), one)).alias("value")).write.text(path)
    return R.type_dict(t.spark, path)


@query("src_type_dict_numbered", "SELECT DISTINCT concat(p_name, ' ', p_partkey) AS entity, concat(p_type, ',x') AS type FROM part")
def _(t):
    path = shared_dir(t.spark)
    line = F.concat(c("p_partkey").cast("string"), F.lit(" "), "p_name", F.lit(" "), c("p_partkey").cast("string"), F.lit(","), "p_type", F.lit(",x"))
    t.part.select(F.explode(F.array(F.lit("vocabulary"), line)).alias("value")).write.text(path)
    return R.type_dict_numbered(t.spark, path)


@query("src_relation_schema", """SELECT CAST(min(p_partkey) AS INTEGER) AS id, p_brand AS relation, p_type AS head_type, p_name AS tail_type FROM part GROUP BY 2, 3, 4""")
def _(t):
    path = shared_dir(t.spark)
    t.part.groupBy("p_type", "p_name", "p_brand").agg(F.min("p_partkey").alias("index")).select(
        c("p_type").alias("head_type"), c("p_name").alias("tail_type"), c("p_brand").alias("relation"), "index").write.csv(path, header=True)
    return R.relation_schema(t.spark, path)


@query("src_lines", r"""SELECT line, count(*) AS n FROM (SELECT trim(unnest(string_split(text, E'\n')), E' \n\t\r') AS line FROM documents) WHERE line <> '' GROUP BY 1""")
def _(t):
    path = shared_dir(t.spark)
    t.documents.select("text").write.text(path)
    return R.lines(t.spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("src_jsonl", """SELECT p_name AS text, p_brand AS entity, p_type AS entity_type, 0 AS bad FROM part UNION ALL SELECT NULL, NULL, NULL, 1 FROM part WHERE p_size = 9""")
def _(t):
    path = shared_dir(t.spark)
    good = F.to_json(F.struct(c("p_name").alias("text"), F.array(F.struct(c("p_brand").alias("entity"), c("p_type").alias("entity_type"))).alias("entity")))
    lines = t.part.select(F.explode(F.when(c("p_size") == 9, F.array(good, F.lit('{"text": '))).otherwise(F.array(good))).alias("value"))
    lines.write.text(path)
    rec = R.ie_jsonl(t.spark, path)
    out = rec.select("text", F.get("entity", F.lit(0)).alias("e"), c("_corrupt_record").isNotNull().cast("int").alias("bad"))
    return out.select("text", "e.entity", "e.entity_type", "bad")


def _tagged(t):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return t.documents.select("doc_id", words.alias("tokens")).withColumn("tags", F.transform("tokens", word_tag))


TAGGED = r"""SELECT md5(array_to_string(tk, ' ')) AS tokens, md5(array_to_string(list_transform(tk, lambda w: CASE WHEN regexp_matches(w, '^[A-ZÉ]') THEN 'B-CAP' WHEN length(w) >= 9 THEN 'I-LONG' WHEN length(w) >= 7 THEN 'I-MID' ELSE 'O' END), ' ')) AS tags
 FROM (SELECT list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS tk FROM documents)"""


def _hashed(df):
    return df.select(F.md5(F.array_join("tokens", " ")).alias("tokens"), F.md5(F.array_join("tags", " ")).alias("tags"))


@query("src_conll", TAGGED)
def _(t):
    path = shared_dir(t.spark)
    block = F.concat(F.lit("-DOCSTART- O\n"), F.array_join(F.zip_with("tokens", "tags", lambda w, g: F.concat(w, F.lit("\tx\t"), g)), "\n"))
    _tagged(t).select(block.alias("value")).write.option("lineSep", "\n\n").text(path)
    return _hashed(R.conll(t.spark, path))


@query("src_tsv_tagged", r"""SELECT doc_id AS "index", CAST(len(tk) AS BIGINT) AS n, md5(array_to_string(tk, ' ')) AS tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS tk FROM documents)""")
def _(t):
    path = shared_dir(t.spark)
    joined = lambda col: F.array_join(col, "\x02")
    _tagged(t).select(joined("tokens").alias("text_a"), joined("tags").alias("label"), c("doc_id").alias("index")).write.csv(path, header=True, sep="\t", quote="")
    out = R.tsv_tagged(t.spark, path)
    return out.select("index", F.size("label").cast("long").alias("n"), F.md5(F.array_join("text_a", " ")).alias("tokens"))


@query("src_ie_schema", """SELECT DISTINCT p_type AS type, p_brand AS role FROM part""")
def _(t):
    path = shared_dir(t.spark)
    brand = t.part.select("p_type", "p_brand").distinct()
    # one small schema file per (type, role); the reader merges them
    text = F.concat_ws("\n", F.to_json(F.array("p_type")), F.to_json(F.array("p_brand")), F.to_json(F.create_map("p_type", F.array("p_brand"))))
    brand.select(text.alias("value"), F.concat_ws("_", "p_type", "p_brand").alias("part")).write.partitionBy("part").option("lineSep", "\n").text(path)
    return R.ie_schema(t.spark, path)


ATTR = ["description", "properties", "time_complexity"]


@query("snk_nodes", kg(f"SELECT name, {sql_case(K.EXPORT_TYPE_NAMES, 'type', 'type')} AS label, description, properties, time_complexity FROM kg_nodes"))
def _(t):
    path = shared_dir(t.spark)
    W.write_json(W.export_nodes(nodes(t), ATTR), path)
    back = t.spark.read.json(path, schema="name string, labels array<string>, properties map<string,string>")
    return back.select("name", c("labels")[0].alias("label"), *[F.try_element_at("properties", F.lit(a)).alias(a) for a in ATTR])


EXPORT = f"SELECT head AS source, tail AS target, {sql_case(K.RELATION_NAMES, 'relation', 'relation')} AS relation, confidence, sentence AS source_sentence FROM kg_edges"
EDGE = "source string, target string, relation string, confidence double, source_sentence string"


@query("snk_edges", kg(EXPORT))
def _(t):
    path = shared_dir(t.spark)
    W.write_json(W.export_edges(edges(t, "sentence")), path, "gzip")
    return t.spark.read.json(path, schema=EDGE)


@query("snk_full_graph", kg(f"""SELECT 'label' AS kind, {sql_case(K.EXPORT_TYPE_NAMES, 'type', 'type')} AS value, count(*) AS n FROM kg_nodes GROUP BY 2
 UNION ALL SELECT 'relation', {sql_case(K.RELATION_NAMES, 'relation', 'relation')}, count(*) FROM kg_edges GROUP BY 2"""))
def _(t):
    path = shared_dir(t.spark)
    W.write_full_graph(nodes(t), edges(t, "sentence"), ATTR, path, "gzip")
    return t.spark.read.json(f"{path}/statistics", schema="kind string, value string, n bigint")


@query("snk_display_graph", kg("""SELECT 'node' AS kind, id AS a, NULL AS relation, NULL AS b FROM (SELECT head AS id FROM kg_raw UNION SELECT tail FROM kg_raw)
 UNION ALL SELECT DISTINCT 'link', head, relation, tail FROM kg_raw"""))
def _(t):
    none = F.lit(None).cast("string")
    n, links = W.display_graph(raw_triples(t))
    return n.select(F.lit("node").alias("kind"), c("id").alias("a"), none.alias("relation"), none.alias("b")).unionByName(
        links.select(F.lit("link").alias("kind"), c("source").alias("a"), "relation", c("target").alias("b")))


@query("snk_csv_predictions", kg("SELECT sentence, head, tail, relation, confidence FROM kg_raw WHERE confidence >= 0.8 AND sentence IS NOT NULL"))
def _(t):
    path = shared_dir(t.spark)
    W.write_predictions(raw_triples(t).where("confidence >= 0.8 and sentence is not null"), path)
    return t.spark.read.csv(path, header=True, escape='"', schema="sentence string, head string, tail string, relation string, confidence double")


@query("snk_tagged_txt", TAGGED)
def _(t):
    path = shared_dir(t.spark)
    W.write_tagged(_tagged(t), "tokens", "tags", path)
    return _hashed(R.conll(t.spark, path))


@query("snk_json_csv", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def _(t):
    a, b, d = shared_dir(t.spark), shared_dir(t.spark), shared_dir(t.spark)
    schema = "p_partkey bigint, p_name string, p_brand string, p_retailprice double"
    t.part.select("p_partkey", "p_name", "p_brand", "p_retailprice").write.json(a)
    W.json_to_csv(t.spark, a, b, schema)
    W.csv_to_json(t.spark, b, d, schema)
    return t.spark.read.json(d, schema=schema)


@query("snk_jsonld", kg("""SELECT row_no, head, concat('{"@context":{"', relation, '":"', CASE relation WHEN 'uses' THEN 'https://schema.example/uses' ELSE '' END, '"},"@id":"', head, '","', relation, '":"', tail, '"}') AS doc FROM kg_edges"""))
def _(t):
    return edges(t).select("row_no", "head", W.jsonld(c("head"), c("relation"), c("tail"), {"uses": "https://schema.example/uses"}).alias("doc"))


@query("g_import", kg(f"""SELECT source, target, relation, confidence, source_sentence FROM ({EXPORT} WHERE head_type <> 'Algorithm' AND tail_type <> 'Algorithm')"""))
def _(t):
    path = shared_dir(t.spark)
    W.write_json(W.export_nodes(nodes(t).where("type <> 'Algorithm'"), ATTR), f"{path}/nodes", "gzip")
    W.write_json(W.export_edges(edges(t, "sentence")), f"{path}/edges", "gzip")
    graph = I.ImportedGraph(t.spark, shared_dir(t.spark))
    I.import_graph(t.spark, path, graph, 0)
    own = lambda name: F.try_element_at("properties", F.lit(name))
    return graph.edges().select("source", "target", "relation", own("confidence").cast("double").alias("confidence"), own("source_sentence").alias("source_sentence"))


@query("g_import_overwrite", kg(f"""SELECT name, {sql_case(K.EXPORT_TYPE_NAMES, 'type', 'type')} AS label, CASE WHEN type = 'DataStructure' THEN concat(description, ' v2') ELSE description END AS description,
 properties, CASE WHEN type = 'DataStructure' THEN NULL ELSE time_complexity END AS time_complexity FROM kg_nodes
UNION ALL SELECT concat('New#', n_name), '{I.DEFAULT_LABEL}', NULL, NULL, NULL FROM nation"""))
def _(t):
    """Export, import, change a part and add nodes without labels, import that, export again, import the export."""
    first, change, more, last = (shared_dir(t.spark) for _ in range(4))
    W.write_json(W.export_nodes(nodes(t), ATTR), first)
    graph = I.ImportedGraph(t.spark, shared_dir(t.spark))
    I.import_nodes(t.spark, first, graph, 0, clean=True)
    changed = nodes(t).where("type = 'DataStructure'").withColumn("description", F.concat("description", F.lit(" v2")))
    W.write_json(W.export_nodes(changed, ["description"]), change)
    I.import_nodes(t.spark, change, graph, 1)
    t.nation.select(F.concat(F.lit("New#"), "n_name").alias("name"), F.array().cast("array<string>").alias("labels")).write.json(more)
    I.import_nodes(t.spark, more, graph, 2)
    W.write_json(graph.nodes(), last)
    again = I.ImportedGraph(t.spark, shared_dir(t.spark))
    I.import_nodes(t.spark, last, again, 0, clean=True)
    return again.nodes().select("name", c("labels")[0].alias("label"), *[F.try_element_at("properties", F.lit(a)).alias(a) for a in ATTR])


# ---- streams ---------------------------------------------------------------------------------

ENT = [("eau", ["eau", "eux"]), ("sch", ["sch"])]
REL = [("of", [" de ", " of "])]


@query("st_annotate", f"""SELECT conv_id, turn, {sql_ladder('lower(text)', FAMILIES, 'other')} AS intent, concat_ws('|', CASE WHEN contains(text, 'eau') OR contains(text, 'eux') THEN 'eau' END, CASE WHEN contains(text, 'sch') THEN 'sch' END) AS entities,
 CASE WHEN contains(text, ' de ') OR contains(text, ' of ') THEN 'of' ELSE '' END AS relations FROM conversations""")
def _(t):
    schema = t.conversations.schema
    arriving = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/conversations*.parquet")
    target, check = shared_dir(t.spark), shared_dir(t.spark)
    jobs.annotate_stream(arriving, "text", ENT, REL, FAMILIES, target, check).awaitTermination()
    out = t.spark.read.parquet(target)
    return out.select("conv_id", "turn", "intent", F.array_join("entities", "|").alias("entities"), F.array_join("relations", "|").alias("relations"))


def _arrived(t, inbox, batches):
    """Schema of an inbox, and how many of its files make a batch; files are as many as the tasks that wrote them."""
    inside = t.spark.read.parquet(inbox)
    return inside.schema, max(1, -(-len(inside.inputFiles()) // batches))


@query("st_ingest", kg("SELECT head, relation, tail, count(*) AS n FROM kg_edges GROUP BY 1, 2, 3"))
def _(t):
    inbox, target, failed, check = (shared_dir(t.spark) for _ in range(4))
    at = F.timestamp_seconds(F.lit(1704067200) + (c("row_no") * 7919) % 1000000)      # far more than any delay
    with swept(t.spark):
        raw_triples(t).withColumn("arrival", at).write.option("compression", "zstd").parquet(inbox)
    schema, files = _arrived(t, inbox, 2)
    arriving = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(inbox)
    jobs.ingest_stream(arriving, "arrival", target, failed, check).awaitTermination()
    return jobs.stored(t.spark, target, schema).groupBy("head", "relation", "tail").agg(F.count("*").alias("n"))


AT = "1704067200 + (row_no * 7919) % 1000000"


@query("st_upsert", kg(f""", sides AS (SELECT head AS name, {AT} AS came, row_no, 0 AS side, sentence FROM kg_raw UNION ALL SELECT tail, {AT}, row_no, 1, NULL FROM kg_raw),
 known AS (SELECT s_name AS name, 'Maker' AS type, 'known' AS description FROM supplier),
 kinds AS (SELECT s_name AS entity, 'Maker' AS type FROM supplier UNION ALL SELECT n_name, 'Place' FROM nation),
 found AS (SELECT name, arg_max(sentence, CAST(came AS HUGEINT) * 100000000000000 + row_no) FILTER (WHERE sentence <> '') AS description FROM sides GROUP BY 1)
SELECT name, coalesce(kinds.type, 'ENTITY') AS type, coalesce(found.description, known.description) AS description,
 CASE WHEN known.name IS NULL THEN 'inserted' WHEN found.name IS NULL THEN 'kept' WHEN found.description IS NOT NULL THEN 'updated' ELSE 'skipped' END AS action
FROM found FULL JOIN known USING (name) LEFT JOIN kinds ON kinds.entity = name"""))
def _(t):
    """Nodes of a graph that triples without types arrive for, in four batches, on top of known ones."""
    inbox, target, failed, check = (shared_dir(t.spark) for _ in range(4))
    at = F.timestamp_seconds(F.lit(1704067200) + (c("row_no") * 7919) % 1000000)
    raw_triples(t).select("row_no", "head", "relation", "tail", "sentence", at.alias("arrival")).write.parquet(inbox)
    schema, files = _arrived(t, inbox, 4)
    arriving = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(inbox)
    kinds = t.supplier.select(c("s_name").alias("entity"), F.lit("Maker").alias("type")).unionByName(t.nation.select(c("n_name").alias("entity"), F.lit("Place").alias("type")))
    wanted = {"description": ("sentence", None)}
    jobs.ingest_stream(arriving, "arrival", target, failed, check, types=kinds, attributes=wanted, every=3).awaitTermination()
    known = t.supplier.select(c("s_name").alias("name"), F.lit("Maker").alias("type"), F.lit("known").alias("description"))
    return jobs.tables(t.spark, target, schema, attributes=wanted).nodes(known)
