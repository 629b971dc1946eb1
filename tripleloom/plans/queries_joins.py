"""Joins over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.operators import joins as J
from tripleloom.operators.dictionary import hits
from tripleloom.plans.graph_tables import edges, kg, nodes, raw_triples
from tripleloom.plans.registry import query

c = F.col


@query("j_edge_endpoints", kg("""SELECT e.head, relation, e.tail, row_no, s.type AS head_node_type, s.description AS head_description,
 d.type AS tail_node_type, d.description AS tail_description
 FROM kg_edges e JOIN kg_nodes s ON s.name = e.head JOIN kg_nodes d ON d.name = e.tail"""))
def _(t):
    n = nodes(t).withColumnRenamed("type", "node_type")
    return J.edge_endpoints(edges(t).select("head", "relation", "tail", "row_no"), n, ["node_type", "description"])


@query("j_edge_undirected", kg("""SELECT row_no, relation, head AS near, tail AS far, 1 AS forward FROM kg_edges
 UNION ALL SELECT row_no, relation, tail, head, 0 FROM kg_edges WHERE head <> tail"""))
def _(t):
    return J.undirected(edges(t)).select("row_no", "relation", "near", "far", c("forward").cast("int").alias("forward"))


@query("j_type_lookup", """WITH dict AS (SELECT p_name AS entity, min(p_type) AS type FROM part GROUP BY 1)
SELECT p_partkey, p_name AS name, coalesce(type, 'ENTITY') AS type, CAST(type IS NOT NULL AS INTEGER) AS matched FROM part LEFT JOIN dict ON p_name = entity""")
def _(t):
    d = t.part.groupBy(c("p_name").alias("entity")).agg(F.min("p_type").alias("type"))
    return J.type_lookup(t.part.select("p_partkey", c("p_name").alias("name")), "name", d).withColumn("matched", c("matched").cast("int"))


@query("j_exists", kg("""SELECT asked.name, CAST(n.name IS NOT NULL AS INTEGER) AS found FROM
 (SELECT concat('Order#', CAST(l_partkey * 11 AS VARCHAR)) AS name FROM lineitem GROUP BY 1) asked LEFT JOIN (SELECT DISTINCT name FROM kg_nodes) n ON n.name = asked.name"""))
def _(t):
    asked = t.lineitem.select(F.concat(F.lit("Order#"), (c("l_partkey") * 11).cast("string")).alias("name")).distinct()
    return J.names_exist(asked, nodes(t)).select("name", c("exists").cast("int").alias("found"))


@query("j_dangling_drop", kg("""SELECT row_no, head, tail FROM kg_edges WHERE head IN (SELECT name FROM kg_nodes WHERE description IS NOT NULL OR type <> 'ApplicationScenario')
 AND tail IN (SELECT name FROM kg_nodes WHERE type <> 'Algorithm')"""))
def _(t):
    # the node file lacks suppliers, so edges that touch one dangle
    kept = nodes(t).where("type <> 'Algorithm'")
    heads = nodes(t).where("description is not null or type <> 'ApplicationScenario'")
    e = edges(t)
    by_tail = e.join(kept.select(c("name").alias("tail")).distinct(), ["tail"], "left_semi")
    return J.drop_dangling(by_tail, heads.unionByName(kept)).select("row_no", "head", "tail")


@query("j_upsert_attributes", kg(""", inc AS (
 SELECT c_custkey AS no, c_name AS name, 'ApplicationScenario' AS type, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('acct ', c_mktsegment) END AS description,
   CAST(NULL AS VARCHAR) AS properties FROM customer
 UNION ALL SELECT 10000000 + p_partkey, concat('Part#', CAST(p_partkey AS VARCHAR)), 'Other', NULL, p_brand FROM part
 UNION ALL SELECT 20000000 + s_suppkey, concat('New ', n_name), 'Algorithm', s_name, CASE WHEN s_suppkey % 2 = 0 THEN n_name END FROM supplier JOIN nation ON s_nationkey = n_nationkey
), aim AS (SELECT i.*, x.type AS ex, (SELECT min(type) FROM kg_nodes k WHERE k.name = i.name) AS anyt,
   first_value(i.type) OVER (PARTITION BY i.name ORDER BY no) AS newt FROM inc i LEFT JOIN kg_nodes x ON x.name = i.name AND x.type = i.type),
 m AS (SELECT name, coalesce(ex, anyt, newt) AS type, bool_or(coalesce(ex, anyt) IS NOT NULL) AS there,
   arg_max(description, no) FILTER (WHERE description <> '') AS d, arg_max(properties, no) FILTER (WHERE properties <> '') AS p
   FROM aim GROUP BY 1, 2)
SELECT coalesce(k.name, m.name) AS name, coalesce(k.type, m.type) AS type, coalesce(d, description) AS description, coalesce(p, properties) AS properties,
 CASE WHEN there IS NULL THEN 'kept' WHEN NOT there THEN 'inserted' WHEN d IS NOT NULL OR p IS NOT NULL THEN 'updated' ELSE 'skipped' END AS action
FROM kg_nodes k FULL JOIN m ON k.name = m.name AND k.type = m.type"""))
def _(t):
    none = F.lit(None).cast("string")
    inc = (t.customer.select(c("c_custkey").alias("no"), c("c_name").alias("name"), F.lit("ApplicationScenario").alias("type"),
                             F.when(c("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("acct "), "c_mktsegment")).alias("description"), none.alias("properties"))
           .unionByName(t.part.select((c("p_partkey") + 10000000).alias("no"), F.concat(F.lit("Part#"), c("p_partkey").cast("string")).alias("name"),
                        F.lit("Other").alias("type"), none.alias("description"), c("p_brand").alias("properties")))
           .unionByName(t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select((c("s_suppkey") + 20000000).alias("no"),
                        F.concat(F.lit("New "), "n_name").alias("name"), F.lit("Algorithm").alias("type"), c("s_name").alias("description"),
                        F.when(c("s_suppkey") % 2 == 0, c("n_name")).alias("properties"))))
    return J.upsert_attributes(nodes(t), inc, ["description", "properties"], "no")


@query("j_doc_split", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("j_distant_label", kg(""", known AS (SELECT lower(upper(head)) AS h, lower(tail) AS tl, first(relation ORDER BY row_no, relation) AS relation FROM kg_raw GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, concat('supplier#', lpad(CAST(l_suppkey AS VARCHAR), 9, '0')) AS head,
 concat('PART#', CAST((l_partkey * 7) % 2500 AS VARCHAR)) AS tail, coalesce(relation, 'None') AS relation
FROM lineitem LEFT JOIN known ON h = concat('supplier#', lpad(CAST(l_suppkey AS VARCHAR), 9, '0')) AND tl = concat('part#', CAST((l_partkey * 7) % 2500 AS VARCHAR))"""))
def _(t):
    samples = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("supplier#"), F.lpad(c("l_suppkey").cast("string"), 9, "0")).alias("head"),
                                F.concat(F.lit("PART#"), (c("l_partkey") * 7 % 2500).cast("string")).alias("tail"))
    known = raw_triples(t).withColumn("head", F.upper("head"))
    return J.distant_label(samples, known, ["row_no", "relation"])


WORDS = r"""words AS (SELECT DISTINCT w AS synonym, lower(w) AS canonical FROM (SELECT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS w FROM benchmark) WHERE length(w) >= 4),
 dict AS (SELECT canonical, synonym, min(synonym) OVER (PARTITION BY canonical) AS dict_no FROM words)"""


def _dictionary(t):
    words = t.benchmark.select(F.explode(F.split("text", r"[^\p{L}]+")).alias("synonym")).where(F.length("synonym") >= 4).distinct()
    return words.select(F.lower("synonym").alias("canonical"), "synonym", F.lit(0).alias("dict_no"))


@query("j_synonym_contains", f"""WITH {WORDS} SELECT doc_id, canonical FROM documents JOIN dict ON contains(text, synonym) GROUP BY 1, 2""")
def _(t):
    return hits(t.documents, "doc_id", "text", _dictionary(t)).select("doc_id", "canonical")


@query("j_gold_pred", """WITH g AS (SELECT l_orderkey, l_suppkey, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) AS gold FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
 p AS (SELECT l_orderkey, l_suppkey, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) AS pred FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, gold, pred, 1 AS found FROM g JOIN p USING (l_orderkey, l_suppkey)
UNION ALL SELECT l_orderkey, l_suppkey, gold, NULL, 0 FROM g ANTI JOIN p USING (l_orderkey, l_suppkey)""")
def _(t):
    line = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", (c("l_linenumber") * 1000000 + c("l_partkey")).alias("no"), "l_returnflag", "l_linestatus")
    keys = ["l_orderkey", "l_suppkey"]
    both, missing = J.gold_pred(line.where("l_returnflag = 'A'").select(*keys, "l_partkey", "no"),
                                line.where("l_linestatus = 'F'").select(*keys, "l_partkey", "no"), keys, "no")
    return both.select(*keys, c("gold.l_partkey").alias("gold"), c("predicted.l_partkey").alias("pred"), F.lit(1).alias("found")).unionByName(
        missing.select(*keys, c("gold.l_partkey").alias("gold"), F.lit(None).cast("long").alias("pred"), F.lit(0).alias("found")))


@query("j_mention_lookup", """WITH m AS (SELECT l_orderkey AS doc, l_suppkey AS entity_id, min(l_linenumber) AS s FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2)
SELECT l_orderkey AS doc, l_suppkey AS entity_id, l_returnflag AS role, l_partkey, CAST(s AS INTEGER) AS span_start, CAST(s + 2 AS INTEGER) AS span_end
FROM lineitem JOIN m ON doc = l_orderkey AND entity_id = l_suppkey""")
def _(t):
    base = t.lineitem.select(c("l_orderkey").alias("doc"), c("l_suppkey").alias("entity_id"), "l_returnflag", "l_partkey", "l_linenumber", "l_quantity")
    mentions = base.where("l_quantity > 10").select("doc", "entity_id", c("l_linenumber").alias("start"), (c("l_linenumber") + 2).alias("end"))
    out = J.mention_lookup(base.select("doc", "entity_id", c("l_returnflag").alias("role"), "l_partkey"), mentions)
    return out.select("doc", "entity_id", "role", "l_partkey", c("start").cast("int").alias("span_start"), c("end").cast("int").alias("span_end"))


ENT = "ent AS (SELECT DISTINCT l_orderkey AS sid, l_partkey AS e FROM lineitem)"


def _entities(t):
    return t.lineitem.select(c("l_orderkey").alias("sid"), c("l_partkey").alias("e")).distinct()


@query("j_pairs_unordered", f"""WITH {ENT}, r AS (SELECT sid, e, row_number() OVER (PARTITION BY sid ORDER BY e) AS rank, count(*) OVER (PARTITION BY sid) AS last FROM ent)
SELECT sid, e, rank, rank + 1 AS first, last, last - rank AS pairs FROM r WHERE rank < last""")
def _(t):
    return J.pair_ranges(_entities(t), "sid", ["e"]).select("sid", "e", c("rank").cast("long"), c("first").cast("long"), "last", c("pairs").cast("long"))


GOLD = """gold AS (SELECT DISTINCT a.l_orderkey AS sid, a.l_partkey AS h, b.l_partkey AS t, a.l_returnflag AS label FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""


def _gold(t):
    """Relations from each line's entity to the first entity of the next line of its order."""
    a = t.lineitem.select(c("l_orderkey").alias("sid"), c("l_linenumber").alias("n"), c("l_partkey").alias("head"), c("l_returnflag").alias("label"))
    b = t.lineitem.select(c("l_orderkey").alias("sid"), (c("l_linenumber") - 1).alias("n"), c("l_partkey").alias("tail"))
    b = b.groupBy("sid", "n").agg(F.min("tail").alias("tail"))
    return a.join(b, ["sid", "n"]).where("head <> tail").select("sid", "head", "tail", "label").distinct()


@query("j_pairs_ordered", f"""WITH {ENT}, {GOLD}, k AS (SELECT sid, count(DISTINCT (h, t)) AS k FROM gold GROUP BY 1), n AS (SELECT sid, count(*) AS n FROM ent GROUP BY 1)
SELECT sid, CAST(h AS VARCHAR) AS head, CAST(t AS VARCHAR) AS tail, label, CAST(1 AS BIGINT) AS pairs FROM gold
UNION ALL SELECT sid, NULL, NULL, 'no_relation', CAST(n * (n - 1) - coalesce(k, 0) AS BIGINT) FROM n LEFT JOIN k USING (sid) WHERE n * (n - 1) - coalesce(k, 0) > 0""")
def _(t):
    return J.labelled_pairs(_entities(t), _gold(t), "sid", "e")


@query("j_pairs_new", f"""WITH {ENT}, {GOLD}, k AS (SELECT sid, count(DISTINCT (least(h, t), greatest(h, t))) AS k FROM gold GROUP BY 1),
 n AS (SELECT sid, count(*) AS n FROM ent GROUP BY 1)
SELECT sid, n AS entities, CAST(n * (n - 1) - 2 * coalesce(k, 0) AS BIGINT) AS new_pairs FROM n LEFT JOIN k USING (sid)""")
def _(t):
    return J.new_pair_counts(_entities(t), _gold(t), "sid", "e")


@query("j_doc_pairs", f"""WITH {ENT}, {GOLD}, n AS (SELECT sid, count(*) AS n FROM ent GROUP BY 1),
 v AS (SELECT sid, h, t, max(CAST(label = 'A' AS INTEGER)) AS a, max(CAST(label = 'N' AS INTEGER)) AS n_, max(CAST(label = 'R' AS INTEGER)) AS r FROM gold GROUP BY 1, 2, 3)
SELECT sid, CAST(sum(a) AS BIGINT) AS rel_a, CAST(sum(n_) AS BIGINT) AS rel_n, CAST(sum(r) AS BIGINT) AS rel_r, CAST(max(n) * (max(n) - 1) - count(v.h) AS BIGINT) AS na_pairs,
 CAST(max(n) * (max(n) - 1) AS BIGINT) AS all_pairs FROM n LEFT JOIN v USING (sid) GROUP BY sid""")
def _(t):
    listed = J.labelled_pairs(_entities(t), _gold(t), "sid", "e", "NA")
    pairs = listed.groupBy("sid", "head", "tail").agg(
        *[F.max((c("label") == r).cast("int")).alias(r) for r in "ANR"],
        F.max(F.when(c("label") == "NA", c("pairs"))).alias("na"))
    sizes = _entities(t).groupBy("sid").agg(F.count("*").alias("n"))
    sums = pairs.groupBy("sid").agg(*[F.sum(F.when(c("na").isNull(), c(r))).alias(f"rel_{r.lower()}") for r in "ANR"], F.sum("na").alias("na"))
    return sizes.join(sums, "sid", "left").select("sid", "rel_a", "rel_n", "rel_r", F.coalesce("na", F.lit(0)).cast("long").alias("na_pairs"),
                                                  (c("n") * (c("n") - 1)).alias("all_pairs"))


@query("j_mention_facts", """WITH m AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS e, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
 f AS (SELECT DISTINCT a.l_orderkey AS doc, a.l_partkey AS h, b.l_partkey AS t, a.l_returnflag AS relation FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)
SELECT DISTINCT x.name AS head_name, y.name AS tail_name, relation FROM f JOIN m x ON x.doc = f.doc AND x.e = h JOIN m y ON y.doc = f.doc AND y.e = t""")
def _(t):
    mentions = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(c("l_orderkey").alias("doc"), c("l_partkey").alias("entity"), c("p_name").alias("name"))
    facts = _gold(t).select(c("sid").alias("doc"), c("head").alias("h"), c("tail").alias("t"), c("label").alias("relation"))
    return J.mention_facts(facts, mentions)


@query("j_span_overlap", """WITH s AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS s, l_linenumber + CAST(l_quantity AS INTEGER) % 3 + 1 AS e FROM lineitem WHERE l_linestatus = 'F'),
 r AS (SELECT a.l_orderkey AS doc, a.l_linenumber AS s1, a.l_linenumber + CAST(a.l_quantity AS INTEGER) % 3 + 1 AS e1, b.l_linenumber AS s2, b.l_linenumber + CAST(b.l_quantity AS INTEGER) % 3 + 1 AS e2
  FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
SELECT count(*) AS relations, count(*) FILTER (WHERE NOT (e1 <= s2 OR s1 >= e2)) AS overlapping,
 count(*) FILTER (WHERE EXISTS (SELECT 1 FROM s WHERE s.doc = r.doc AND s = s1 AND e = e1) AND EXISTS (SELECT 1 FROM s WHERE s.doc = r.doc AND s = s2 AND e = e2)) AS covered,
 (SELECT CAST(sum(n * (n - 1)) AS BIGINT) FROM (SELECT count(*) AS n FROM s GROUP BY doc)) AS candidates FROM r""")
def _(t):
    end = c("l_linenumber") + c("l_quantity").cast("int") % 3 + 1
    first = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    after = first.select(c("l_orderkey").alias("doc"), (c("l_linenumber") - 1).alias("n"), c("l_linenumber").alias("s2"), end.alias("e2"))
    line = t.lineitem.select(c("l_orderkey").alias("doc"), c("l_linenumber").alias("start"), end.alias("end"), "l_linestatus")
    rel = (line.select("doc", c("start").alias("n"), c("start").alias("s1"), c("end").alias("e1"))
           .join(after, ["doc", "n"]).drop("n"))
    return J.relation_coverage(rel, line.where("l_linestatus = 'F'"))


@query("j_closest_mention", r"""WITH w AS (SELECT doc_id, regexp_split_to_array(text, '\s+') AS toks FROM documents),
 p AS (SELECT doc_id, pos, tok FROM (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM w) WHERE tok IN ('de', 'la', 'the', 'und', 'que')),
 pairs AS (SELECT a.doc_id, a.pos AS apos, b.pos AS bpos, abs(a.pos - b.pos) AS gap FROM p a JOIN p b ON a.doc_id = b.doc_id WHERE a.tok IN ('de', 'the') AND b.tok IN ('la', 'und', 'que')),
 mid AS (SELECT doc_id, len(toks) // 2 AS amid FROM w)
SELECT doc_id, CAST(min(gap) AS BIGINT) AS gap,
 (SELECT CAST(arg_min(pos, abs(pos - amid) * 100000 + pos) AS BIGINT) FROM p JOIN mid USING (doc_id) WHERE p.doc_id = pairs.doc_id AND tok IN ('de', 'the')) AS near_middle
FROM pairs GROUP BY doc_id""")
def _(t):
    def places(words):
        return F.filter(F.transform(c("toks"), lambda w, i: F.when(w.isin(words), i)), lambda i: i.isNotNull())
    docs = t.documents.select("doc_id", F.split("text", r"\s+").alias("toks"))
    docs = docs.select("doc_id", F.floor(F.size("toks") / 2).cast("int").alias("at"), places(["de", "the"]).alias("a"), places(["la", "und", "que"]).alias("b"))
    docs = docs.select("doc_id", J.closest_pair(c("a"), c("b"))["gap"].cast("long").alias("gap"), J.closest(c("a"), c("at")).cast("long").alias("near_middle"))
    return docs.where("gap is not null")


@query("j_kg_membership", kg(""", names AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer UNION SELECT p_brand FROM part UNION SELECT concat('Part#', CAST(p_partkey % 97 AS VARCHAR)) FROM part),
 f AS (SELECT name, EXISTS (SELECT 1 FROM kg_nodes k WHERE contains(k.name, names.name)) AS ing FROM names)
SELECT name, CAST(ing AS INTEGER) AS in_graph, row_number() OVER (ORDER BY CASE WHEN ing THEN 0 ELSE 1 END, -length(name), name) AS rank FROM f"""))
def _(t):
    names = (t.nation.select(c("n_name").alias("name")).union(t.region.select("r_name")).union(t.customer.select("c_mktsegment"))
             .union(t.part.select("p_brand")).union(t.part.select(F.concat(F.lit("Part#"), (c("p_partkey") % 97).cast("string")))).distinct())
    return J.kg_membership(names, nodes(t)).select("name", c("in_graph").cast("int").alias("in_graph"), c("rank").cast("long"))
