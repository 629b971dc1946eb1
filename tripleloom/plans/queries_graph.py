"""The graph query surface over the derived graph."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tripleloom.functions import constants as K
from tripleloom.functions.session import shared_dir, staged
from tripleloom.functions.skew import top_k
from tripleloom.operators import aggregate as A
from tripleloom.operators import clean as C
from tripleloom.operators import graph as G
from tripleloom.operators import hooks as H
from tripleloom.operators import joins as J
from tripleloom.operators import prep as P
from tripleloom.operators import select as S
from tripleloom.operators.rounds import expand_rounds
from tripleloom.plans.graph_tables import ORDER, edges, kg, nodes, raw_triples
from tripleloom.plans.queries_clean import FAMILIES, SCHEMA_SQL, sql_case, sql_ladder
from tripleloom.plans.queries_clean import DELETE_SQL, FILL, EXACT_SQL, RENAME_SQL
from tripleloom.plans.registry import query

c = F.col
ATTR = ", ".join(f"{a}.{x} AS entity{i}_{x}" for i, a in ((1, "a"), (2, "b")) for x in G.ATTRIBUTES)
SEEN = ", seen AS (SELECT *, head AS near, tail AS far FROM kg_edges UNION ALL SELECT *, tail, head FROM kg_edges WHERE head <> tail)"


@query("g_entity_relations", kg(f"""{SEEN}, hit AS (SELECT row_no, near, relation, far FROM seen WHERE contains(near, 'Supplier#00000000'))
SELECT row_no, near, relation, far, {ATTR} FROM hit JOIN kg_nodes a ON a.name = near JOIN kg_nodes b ON b.name = far"""))
def _(t):
    return G.entity_relations(edges(t), nodes(t), "Supplier#00000000")


@query("g_entities_by_relation", kg(f""", hit AS (SELECT row_no, head, relation, tail FROM kg_edges WHERE (contains(head, 'Supplier#00000001') OR contains(head, 'Order#11')) AND contains(relation, 'pp')) SELECT row_no, head, relation, tail, {ATTR} FROM hit JOIN kg_nodes a ON a.name = head JOIN kg_nodes b ON b.name = tail"""))
def _(t):
    return G.entities_by_relation(edges(t), nodes(t), ["Supplier#00000001", "Order#11"], "pp")


@query("g_relations_between", kg(f"""{SEEN}, hit AS (SELECT row_no, near, relation, far FROM seen WHERE (contains(near, 'Supplier') AND contains(far, 'Part#12')) OR (contains(near, 'Part#12') AND contains(far, 'Supplier'))) SELECT row_no, near, relation, far, {ATTR} FROM hit JOIN kg_nodes a ON a.name = near JOIN kg_nodes b ON b.name = far"""))
def _(t):
    return G.relations_between(edges(t), nodes(t), "Supplier", "Part#12")


EXACT = "SELECT row_no, head, relation, tail, confidence FROM kg_edges WHERE {0} AND confidence >= 0.8 - 1e-10"
KEEP = ["row_no", "head", "relation", "tail", "confidence"]
NAMES = ["Supplier#000000001", "Supplier#000000002", "NATION_3"]
IN = ", ".join(f"'{n}'" for n in NAMES)


@query("g_entity_relations_exact", kg(EXACT.format(f"(head IN ({IN}) OR tail IN ({IN}))")))
def _(t):
    return G.entity_relations_exact(edges(t).select(*KEEP), NAMES)


@query("g_entities_by_relation_exact", kg(EXACT.format(f"(head IN ({IN}) OR tail IN ({IN})) AND relation = 'uses'")))
def _(t):
    return G.entities_by_relation_exact(edges(t).select(*KEEP), NAMES, "uses")


@query("g_relations_between_exact", kg("""SELECT row_no, head, relation, tail, CASE WHEN head = 'AFRICA' THEN 'forward' ELSE 'reverse' END AS direction FROM kg_edges
 WHERE ((head = 'AFRICA' AND tail = 'NATION_0') OR (head = 'NATION_0' AND tail = 'AFRICA')) AND confidence >= 0.8"""))
def _(t):
    return G.relations_between_exact(edges(t).select(*KEEP), "AFRICA", "NATION_0").drop("confidence")


@query("g_query_graph", kg(f"""{SEEN}, q AS (SELECT concat('q', s_suppkey) AS question, [s_name, concat('Part#', s_suppkey * 3)] AS names, CASE WHEN s_nationkey < 8 THEN 'uses' WHEN s_nationkey < 12 THEN 'none' END AS asked FROM supplier),
 n AS (SELECT question, asked, unnest(names) AS near FROM q),
 hit AS (SELECT DISTINCT question, row_no, head, relation, tail, confidence FROM n JOIN seen USING (near) WHERE confidence >= 0.8 - 1e-10 AND (asked IS NULL OR asked = relation)),
 r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY confidence DESC, row_no, head, relation, tail) AS rank FROM hit)
SELECT question, coalesce(rank, 1) AS rank, coalesce(concat_ws(' → ', head, relation, tail), '{G.NO_ANSWER}') AS path, confidence FROM (SELECT question FROM q) LEFT JOIN (SELECT question, rank, concat_ws(' → ', head) AS x, head, relation, tail, confidence FROM r) USING (question)""".replace("coalesce(concat_ws(' → ', head, relation, tail),", "coalesce(CASE WHEN head IS NOT NULL THEN concat_ws(' → ', head, relation, tail) END,")))
def _(t):
    q = t.supplier.select(F.concat(F.lit("q"), "s_suppkey").alias("question"), F.array("s_name", F.concat(F.lit("Part#"), (c("s_suppkey") * 3).cast("string"))).alias("names"),
                          F.when(c("s_nationkey") < 8, "uses").when(c("s_nationkey") < 12, "none").alias("relation"))
    return G.answer_questions(edges(t), q).withColumn("rank", c("rank").cast("long"))


@query("g_statistics", kg("""SELECT 'nodes' AS measure, count(*) AS n FROM kg_nodes UNION ALL SELECT 'edges', count(*) FROM kg_edges
 UNION ALL SELECT concat('relation:', relation), count(*) FROM kg_edges GROUP BY 1"""))
def _(t):
    return G.statistics(nodes(t), edges(t))


@query("g_exists", kg("""SELECT DISTINCT asked.name, CAST(n.name IS NOT NULL AS INTEGER) AS found FROM (SELECT concat('Customer#', lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0')) AS name FROM orders) asked
 LEFT JOIN (SELECT DISTINCT name FROM kg_nodes) n ON n.name = asked.name"""))
def _(t):
    asked = t.orders.select(F.concat(F.lit("Customer#"), F.lpad((c("o_custkey") * 2).cast("string"), 9, "0")).alias("name")).distinct()
    return J.names_exist(asked, nodes(t)).select("name", c("exists").cast("int").alias("found"))


@query("g_contains", kg("SELECT DISTINCT name FROM kg_nodes WHERE contains(name, 'er#00') ORDER BY name LIMIT 20"))
def _(t):
    return S.names_containing(nodes(t), "er#00")


SCORE = """CASE WHEN head = near THEN 3 WHEN contains(head, near) THEN 2 ELSE 0 END + CASE WHEN tail = near THEN 2 WHEN contains(tail, near) THEN 1 ELSE 0 END + CAST(contains(relation, 'appl') OR contains(relation, 'impl') AS INTEGER)"""
WORDS = ["appl", "impl"]


def _batch(t):
    return G.context_batch(staged(edges(t).select(*ORDER), "zstd"), nodes(t), nodes(t), words=WORDS)


CONTEXT = f"""{SEEN}, r AS (SELECT near, head, relation, tail, CAST({SCORE} AS INTEGER) AS score, row_number() OVER (PARTITION BY near ORDER BY {SCORE} DESC, row_no, head, relation, tail) AS rank FROM seen
 WHERE near IN (SELECT name FROM kg_nodes))"""


@query("g_context_batch", kg(f"""{CONTEXT} SELECT near AS topic, rank, score, head, relation, tail, {', '.join(G.ATTRIBUTES)} FROM r JOIN kg_nodes ON name = near WHERE rank <= 8"""))
def _(t):
    return _batch(t).withColumn("rank", c("rank").cast("long"))


@query("g_context", kg(f"""{CONTEXT}, e AS (SELECT near, rank, {', '.join(f'trim({a}) AS {a}' for a in G.ATTRIBUTES)},
  concat('{{"entity1":', to_json(head), ',"relation":', to_json(relation), ',"entity2":', to_json(tail), '}}') AS rel FROM r JOIN kg_nodes ON name = near WHERE rank <= 8)
SELECT near AS topic, concat('{{"topic":', to_json(near), ',"attributes":{{', concat_ws(',', {', '.join(f"""'"{a}":' || to_json({a})""" for a in G.ATTRIBUTES)}), '}},"relations":[', string_agg(rel, ',' ORDER BY rank), ']}}') AS context
FROM e GROUP BY near, {', '.join(G.ATTRIBUTES)}"""))
def _(t):
    return G.context_json(_batch(t))


@query("g_evidence", kg(f"""{CONTEXT}, e AS (SELECT * FROM r JOIN kg_nodes ON name = near WHERE rank <= 8)
SELECT near AS topic, concat('关系', rank, '：', head, ' ', relation, ' ', tail) AS text FROM e
{' '.join(f"UNION ALL SELECT near, concat('属性-{x}：', {x}) FROM e WHERE rank = 1 AND {x} <> ''" for x in G.ATTRIBUTES)}"""))
def _(t):
    return G.evidence_lines(_batch(t)).select("topic", "text")


def _details(side: str) -> str:
    """All filled attributes of one end as SQL."""
    return "concat_ws('，', " + ", ".join(f"'{x}: ' || {side}.{x}" for x in G.ATTRIBUTES) + ")"


@query("g_relation_lines", kg(f"""SELECT no, CASE WHEN no <= 5 THEN concat(line, chr(10), detail_a, '；', detail_b) ELSE line END AS text FROM (
 SELECT row_number() OVER (ORDER BY row_no, head, tail) AS no, concat(row_number() OVER (ORDER BY row_no, head, tail), '. ', head, ' ', relation, ' ', tail) AS line, {_details('a')} AS detail_a, {_details('b')} AS detail_b
 FROM (SELECT * FROM kg_edges WHERE contains(head, 'Supplier#00000001') AND contains(relation, 'uses')) JOIN kg_nodes a ON a.name = head JOIN kg_nodes b ON b.name = tail)"""))
def _(t):
    found = G.entities_by_relation(edges(t), nodes(t), ["Supplier#00000001"], "uses")
    return G.relation_lines(found, ["row_no", "head", "tail"]).select(c("no").cast("long").alias("no"), "text")


@query("f_pick_attrs", kg(f"""{SEEN} SELECT near AS topic, {', '.join(f"any_value(nullif(trim({x}), '')) AS {x}" for x in G.ATTRIBUTES)}
 FROM seen JOIN kg_nodes ON name = near GROUP BY 1"""))
def _(t):
    seen = J.undirected(edges(t).select(*ORDER)).join(nodes(t).withColumnRenamed("name", "near"), "near")
    return G.pick_attributes(seen, "near", ORDER, G.ATTRIBUTES).withColumnRenamed("near", "topic")


@query("f_type_group", kg(f"""SELECT name, CAST(CASE {sql_case(K.TYPE_NAMES, 'type', 'type')} WHEN '算法' THEN 1 WHEN '数据结构' THEN 2 WHEN '策略' THEN 3 WHEN '模式' THEN 4 WHEN '概念' THEN 5 ELSE 6 END AS INTEGER) AS grp FROM kg_nodes"""))
def _(t):
    return nodes(t).select("name", G.type_group(C.translate(c("type"), K.TYPE_NAMES)).alias("grp"))


@query("f_path_text", kg("SELECT row_no, head, concat_ws(' → ', head, relation, tail) AS path FROM kg_edges"))
def _(t):
    return edges(t).select("row_no", "head", G.path_text(c("head"), c("relation"), c("tail")).alias("path"))


@query("g_subgraph", kg(""", s AS (SELECT head AS name, row_no * 2 AS first_at FROM kg_edges UNION ALL SELECT tail, row_no * 2 + 1 FROM kg_edges), n AS (SELECT name FROM s GROUP BY name ORDER BY min(first_at) LIMIT 20),
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(head, tail), greatest(head, tail), relation ORDER BY row_no) AS rn FROM kg_edges) WHERE rn = 1)
SELECT 'node' AS kind, n.name AS a, CAST(CASE type WHEN 'Algorithm' THEN 1 WHEN 'DataStructure' THEN 2 ELSE 6 END AS INTEGER) AS grp, NULL AS relation, NULL AS b FROM n JOIN kg_nodes k ON k.name = n.name
UNION ALL SELECT 'link', head, NULL, relation, tail FROM (SELECT * FROM u ORDER BY row_no, head, relation, tail LIMIT 30)"""))
def _(t):
    n, l = G.subgraph(edges(t).select(*ORDER), nodes(t))
    none = F.lit(None).cast("string")
    return n.select(F.lit("node").alias("kind"), c("name").alias("a"), c("group").alias("grp"), none.alias("relation"), none.alias("b")).unionByName(
        l.select(F.lit("link").alias("kind"), c("head").alias("a"), F.lit(None).cast("int").alias("grp"), "relation", c("tail").alias("b")))


def _reach(n: int) -> str:
    """A round of the sample as SQL: neighbours of the chosen, earlier rounds first, then by draw."""
    return f"""c{n} AS (SELECT name, min(round) AS round FROM (SELECT * FROM c{n - 1} UNION ALL SELECT far, {n} FROM ends JOIN c{n - 1} ON near = name) GROUP BY 1
  ORDER BY 2, md5(concat('7|', name)), name LIMIT 100)"""


@query("g_sample_subgraph", kg(f""", ends AS (SELECT DISTINCT head AS near, tail AS far FROM kg_edges UNION SELECT tail, head FROM kg_edges), every AS (SELECT DISTINCT name FROM kg_nodes),
 c0 AS (SELECT name, 0 AS round FROM every ORDER BY md5(concat('7|', name)), name LIMIT 70), {_reach(1)}, {_reach(2)}, {_reach(3)},
 chosen AS (SELECT name, min(round) AS round FROM (SELECT * FROM c3 UNION ALL SELECT name, 4 FROM every) GROUP BY 1 ORDER BY 2, md5(concat('7|', name)), name LIMIT 100),
 sides AS (SELECT head AS name FROM kg_edges UNION ALL SELECT tail FROM kg_edges), d AS (SELECT name, count(*) AS degree FROM sides GROUP BY 1)
SELECT row_no, head, relation, tail, a.degree + b.degree AS score FROM kg_edges JOIN d a ON a.name = head JOIN d b ON b.name = tail
WHERE head IN (SELECT name FROM chosen) AND tail IN (SELECT name FROM chosen) ORDER BY score DESC, row_no, head, relation, tail LIMIT 150"""))
def _(t):
    e = staged(edges(t).select(*ORDER), "zstd")
    chosen = staged(G.sample_nodes(e, nodes(t), 100, seed=7, drawn=F.md5(F.concat(F.lit("7|"), "name"))))
    return S.links_by_degree(e, chosen, ORDER, 150, few=True)


ASK = """ask AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN concat('difference between Order#', o_orderkey, ' and Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0'))
  WHEN '2-HIGH' THEN concat('which usedIn Order#', o_orderkey) WHEN '5-LOW' THEN concat('which Order#', o_orderkey) WHEN '3-MEDIUM' THEN concat('the Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) ELSE 'hello' END AS text FROM orders)"""


def _asked(t):
    order, cust = F.concat(F.lit("Order#"), "o_orderkey"), F.concat(F.lit("Customer#"), F.lpad(c("o_custkey").cast("string"), 9, "0"))
    p = c("o_orderpriority")
    text = (F.when(p == "1-URGENT", F.concat(F.lit("difference between "), order, F.lit(" and "), cust)).when(p == "2-HIGH", F.concat(F.lit("which usedIn "), order))
            .when(p == "5-LOW", F.concat(F.lit("which "), order)).when(p == "3-MEDIUM", F.concat(F.lit("the "), cust)).otherwise("hello"))
    return t.orders.select(c("o_orderkey").alias("id"), text.alias("text"))


@query("g_route", kg(f""", {ASK}, u AS (SELECT id, {sql_ladder('lower(text)', FAMILIES, 'other')} AS intent, regexp_extract(text, '([A-Z][a-z]+#[0-9]+)', 1) AS e1, regexp_extract(text, ' and ([A-Z][a-z]+#[0-9]+)', 1) AS e2,
  CASE WHEN contains(text, 'usedIn') THEN 'usedIn' END AS rel FROM ask)
SELECT id, intent AS route, head AS source, relation, tail AS target FROM u JOIN kg_edges ON (head = e1 AND tail = e2) OR (head = e2 AND tail = e1) WHERE intent = 'find_relation_by_two_entities'
UNION ALL SELECT id, intent, head, relation, tail FROM u JOIN kg_edges ON head = e1 AND relation = rel WHERE intent = 'find_entity_by_relation_and_entity'
UNION ALL SELECT id, intent, name, type, description FROM u JOIN kg_nodes ON name = e1 WHERE intent = 'find_entity_definition'
UNION ALL SELECT id, 'general', NULL, NULL, NULL FROM u WHERE intent = 'other' OR (intent = 'find_entity_by_relation_and_entity' AND rel IS NULL)"""))
def _(t):
    u = _asked(t).select("id", C.intent_rules(c("text"), FAMILIES).alias("intent"), F.regexp_extract("text", "([A-Z][a-z]+#[0-9]+)", 1).alias("e1"),
                         F.regexp_extract("text", " and ([A-Z][a-z]+#[0-9]+)", 1).alias("e2"), F.when(c("text").contains("usedIn"), "usedIn").alias("relation"))
    return G.route(u, edges(t), nodes(t))


@query("g_understand", f"""SELECT conv_id, turn, {sql_ladder('lower(text)', FAMILIES, 'other')} AS intent,
 concat_ws('|', CASE WHEN contains(text, 'eau') OR contains(text, 'eux') THEN 'eau' END, CASE WHEN contains(text, 'sch') THEN 'sch' END, CASE WHEN contains(text, 'ción') OR contains(text, 'tion') THEN 'tion' END) AS entities,
 concat_ws('|', CASE WHEN contains(text, ' de ') OR contains(text, ' of ') THEN 'of' END, CASE WHEN contains(text, ' dans ') OR contains(text, ' in ') THEN 'in' END) AS relations FROM conversations""")
def _(t):
    out = G.understand(t.conversations, "text", [("eau", ["eau", "eux"]), ("sch", ["sch"]), ("tion", ["ción", "tion"])], [("of", [" de ", " of "]), ("in", [" dans ", " in "])], FAMILIES)
    return out.select("conv_id", "turn", "intent", F.array_join("entities", "|").alias("entities"), F.array_join("relations", "|").alias("relations"))


@query("g_build", kg(f""", legal AS (SELECT e.* FROM kg_edges e LEFT JOIN (VALUES {SCHEMA_SQL}) s(h, tl, rel) ON e.relation = s.rel WHERE s.rel IS NULL OR (head_type = h AND tail_type = tl)),
 n AS (SELECT head AS name, head_type AS type FROM kg_raw UNION SELECT tail, tail_type FROM kg_raw)
SELECT 'node' AS kind, {sql_case(K.EXPORT_TYPE_NAMES, 'type', 'type')} AS label, count(*) AS n FROM n GROUP BY 2
UNION ALL SELECT 'edge', {sql_case(K.RELATION_NAMES, 'relation', 'relation')}, count(*) FROM legal GROUP BY 2"""))
def _(t):
    n, e = G.build(raw_triples(t).drop("confidence", "sentence"), C.default_schema(t.spark))
    return (A.value_counts(n, "type").select(F.lit("node").alias("kind"), c("type").alias("label"), "n")
            .unionByName(A.value_counts(e, "relation").select(F.lit("edge").alias("kind"), c("relation").alias("label"), "n")))


CUR = f""", kept AS (SELECT * FROM kg_edges WHERE (head_type, relation, tail_type) NOT IN (VALUES {DELETE_SQL})),
 fixed AS (SELECT row_no, head, head_type, coalesce(new_rel, e.relation) AS relation, tail, tail_type, sentence, new_rel IS NOT NULL AS renamed FROM kept e LEFT JOIN (VALUES {RENAME_SQL}) r(h, rel, tl, new_rel) ON h = head_type AND rel = e.relation AND tl = tail_type)"""


@query("g_curate", kg(f"""{CUR} SELECT row_no, head, e.relation, tail, {FILL} AS sentence FROM fixed e LEFT JOIN (VALUES {EXACT_SQL}) x(rel, h, tl, tpl) ON rel = e.relation AND h = head_type AND tl = tail_type"""))
def _(t):
    return G.curate(edges(t)).select("row_no", "head", "relation", "tail", "sentence")


@query("g_curate_report", kg(f"""{CUR}, ends AS (SELECT relation, head AS name FROM fixed UNION ALL SELECT relation, tail FROM fixed WHERE head <> tail),
 d AS (SELECT name, relation, count(*) AS n, sum(count(*)) OVER (PARTITION BY name) AS d FROM ends GROUP BY 1, 2)
SELECT (SELECT count(*) FROM kg_edges) - count(*) AS deleted, count(*) FILTER (WHERE renamed) AS renamed, count(*) FILTER (WHERE sentence IS NULL) AS filled, count(*) AS edges,
 (SELECT count(DISTINCT name) FROM d WHERE d > 15) AS hubs, (SELECT count(*) FROM d WHERE d > 15 AND n > 10 AND CAST(n AS DOUBLE) / d > 0.7) AS flagged FROM fixed"""))
def _(t):
    return G.curate_report(staged(edges(t)))


# ---- hooks with small stand-in models -------------------------------------------------------

def capital_words(sentences):
    return [[{"text": m.group(), "label": "NAME", "start": m.start(), "end": m.end(), "confidence": 1.0} for m in re.finditer(r"\b[A-ZÉÈ]\w{3,}", s)] for s in sentences]


def neighbours(sentences, entities):
    return [[(i, i + 1, "near", 1.0 / (1 + (b["start"] - a["end"]) / 40)) for i, (a, b) in enumerate(zip(ents, ents[1:]))] for ents in entities]


def _lines(t):
    return t.conversations.select((c("conv_id") * 100 + c("turn")).alias("sentence_id"), c("text").alias("sentence"))


BLANKS = r"[\t\n\f\r ]+"


def hashed_words():
    """A stand-in model: a text is the number of its words for each first letter of their MD5."""
    import hashlib
    places = {c: i for i, c in enumerate("0123456789abcdef")}

    def vectors(texts):
        out = [[0.0] * len(places) for _ in texts]
        for v, text in zip(out, texts):
            for w in filter(None, re.split(BLANKS, text)):
                v[places[hashlib.md5(w.encode()).hexdigest()[0]]] += 1
        return out
    return vectors


def lower_words():
    return lambda texts: [[w for w in re.split(BLANKS, t.lower()) if w] for t in texts]


def _vector(text: str) -> str:
    """The vector of ``hashed_words`` as SQL; texts split at blanks, tabs and line ends."""
    letters = ", ".join(f"'{x}'" for x in "0123456789abcdef")
    words = f"list_transform(list_filter(regexp_split_to_array({text}, '{BLANKS}'), lambda w: w <> ''), lambda w: substr(md5(w), 1, 1))"
    return f"list_transform([{letters}], lambda x: CAST(len(list_filter({words}, lambda y: y = x)) AS DOUBLE))"


@query("f_embed_hook", f"""WITH v AS (SELECT conv_id, turn, {_vector('text')} AS e FROM conversations)
SELECT a.conv_id, a.turn, round(coalesce(list_cosine_similarity(a.e, b.e), 0), 6) AS cosine FROM v a JOIN v b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _(t):
    """Likeness of each turn to the next one."""
    v = H.embed(t.conversations.select("conv_id", "turn", "text"), "text", H.Model(hashed_words), 16).drop("text")
    after = v.select("conv_id", (c("turn") - 1).alias("turn"), c("embedding").alias("next"))
    return v.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.cosine(c("embedding"), c("next")), 6).alias("cosine"))


@query("f_tokenize_hook", f"""SELECT conv_id, turn, w AS token, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '{BLANKS}'), lambda w: w <> '')) AS w FROM conversations) GROUP BY 1, 2, 3""")
def _(t):
    tokens = H.tokenize(t.conversations.select("conv_id", "turn", "text"), "text", H.Model(lower_words))
    return tokens.select("conv_id", "turn", F.explode("tokens").alias("token")).groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"))


@query("p_retrieval_hook", f"""WITH v AS (SELECT item_id, {_vector('text')} AS e FROM benchmark), d AS (SELECT doc_id, lang, md5(text) AS text, {_vector('text')} AS e FROM documents WHERE lang IS NOT NULL),
 w AS (SELECT doc_id, lang, text, round(list_cosine_similarity(v.e, d.e), 9) AS likeness FROM d JOIN v ON doc_id % 40 = item_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY likeness DESC, doc_id) AS rank FROM w WHERE likeness > 0)
SELECT DISTINCT CASE lang WHEN 'en' THEN 'english' ELSE lang END AS event_type, text AS sentence FROM r WHERE rank <= 5""")
def _(t):
    """The five documents of each language that are most like the benchmark item they are compared with."""
    model = H.Model(hashed_words)
    items = H.embed(t.benchmark, "text", model, 16, "wanted").select(c("item_id").alias("item"), "wanted")
    docs = H.embed(t.documents.where("lang is not null").select("doc_id", "lang", "text"), "text", model, 16).withColumn("text", F.md5("text"))
    likeness = F.round(S.cosine(c("embedding"), c("wanted")), 9)
    scored = docs.withColumn("item", c("doc_id") % 40).join(items, "item").withColumn("likeness", likeness).where("likeness > 0")
    best = top_k(scored, ["lang"], [F.desc("likeness"), c("doc_id")], 5)
    found = best.groupBy("lang").agg(F.collect_list("text").alias("s"))          # five of each
    return P.retrieval_map(found, "s", "lang", {"en": "english"})


# A word is a run of word characters; names are those that begin with a capital and have four characters or more.
NEAR = r"""WITH p AS (SELECT sid, sentence, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT conv_id * 100 + turn AS sid, text AS sentence, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS a FROM conversations)),
 o AS (SELECT *, sum(length(w)) OVER (PARTITION BY sid ORDER BY i) AS e FROM p), n AS (SELECT sid, sentence, i, w, e, e - length(w) AS st FROM o WHERE regexp_matches(w, '^[A-ZÉÈ][\p{L}\p{N}_]{3,}')),
 t AS (SELECT sid, sentence, w AS head, lead(w) OVER s AS tail, CAST(1 AS DOUBLE) / (1 + CAST(lead(st) OVER s - e AS DOUBLE) / 40) AS conf FROM n WINDOW s AS (PARTITION BY sid ORDER BY i)),
 near AS (SELECT * FROM t WHERE tail IS NOT NULL AND conf > 0.5)"""


@query("g_extract_batch", f"{NEAR} SELECT sid AS sentence_id, sentence, head, 'NAME' AS head_type, 'near' AS relation, tail, 'NAME' AS tail_type, round(conf, 6) AS confidence FROM near")
def _(t):
    return H.extract(_lines(t), capital_words, neighbours).withColumn("confidence", F.round("confidence", 6))


@query("g_iterate", f"""{NEAR}, known AS (SELECT * FROM near WHERE conf > 0.9)
SELECT md5(sentence) AS sentence_id, head, 'near' AS relation, tail, round(conf, 6) AS confidence, 0 AS is_new FROM known
UNION ALL SELECT md5(sentence), head, 'near', tail, round(conf, 6), 1 FROM near a WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.sentence = a.sentence AND least(k.head, k.tail) = least(a.head, a.tail) AND greatest(k.head, k.tail) = greatest(a.head, a.tail))""")
def _(t):
    def score(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            found = capital_words(pdf["sentence"])
            for s, ents, related in zip(pdf["sentence"], found, neighbours(pdf["sentence"], found)):
                out += [(s, ents[i]["text"], r, ents[j]["text"], conf) for i, j, r, conf in related]
            yield pd.DataFrame(out, columns=["sentence", "head", "relation", "tail", "confidence"])
    lines = _lines(t)
    known = H.extract(lines, capital_words, neighbours, threshold=0.9).select("sentence", "head", "relation", "tail", "confidence")
    out = G.expand(known, lines.select("sentence"), score)
    return out.select(F.md5("sentence").alias("sentence_id"), "head", "relation", "tail", F.round("confidence", 6).alias("confidence"), c("is_new").cast("int").alias("is_new"))


def linked_through(batches):
    """Names that share a related name are related, too."""
    import pandas as pd
    for pdf in batches:
        out = []
        for sentence, known in zip(pdf["sentence"], pdf["known_pairs"]):
            near: dict = {}
            pairs = {(p["a"], p["b"]) for p in known if p["a"] != p["b"]}
            for a, b in pairs:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
            found = {(x, y) for names in near.values() for x in names for y in names if x < y} - pairs
            out += [(sentence, x, "via", y, 0.75) for x, y in found]
        yield pd.DataFrame(out, columns=["sentence", "head", "relation", "tail", "confidence"])


def _round_sql(n: int) -> str:
    return f""" u{n} AS (SELECT sentence, a, b FROM p{n} WHERE a <> b UNION SELECT sentence, b, a FROM p{n} WHERE a <> b),
 n{n + 1} AS (SELECT DISTINCT x.sentence, x.b AS head, y.b AS tail FROM u{n} x JOIN u{n} y ON x.sentence = y.sentence AND x.a = y.a AND x.b < y.b
  WHERE NOT EXISTS (SELECT 1 FROM p{n} p WHERE p.sentence = x.sentence AND p.a = x.b AND p.b = y.b)),
 p{n + 1} AS (SELECT * FROM p{n} UNION SELECT sentence, head, tail FROM n{n + 1})"""


@query("g_iterate_rounds", f"""{NEAR}, k0 AS (SELECT sentence, head, tail, conf FROM near WHERE conf > 0.9), p0 AS (SELECT DISTINCT sentence, least(head, tail) AS a, greatest(head, tail) AS b FROM k0),
{_round_sql(0)}, {_round_sql(1)},
 every AS (SELECT sentence, head, 'near' AS relation, tail, conf, 0 AS is_new, 0 AS round FROM k0 UNION ALL SELECT sentence, head, 'via', tail, 0.75, 0, 1 FROM n1
  UNION ALL SELECT sentence, head, 'via', tail, 0.75, 1, 2 FROM n2)
SELECT md5(sentence) AS sentence_id, head, relation, tail, round(conf, 6) AS confidence, is_new, round, row_number() OVER (PARTITION BY sentence ORDER BY conf DESC, is_new, head, relation, tail) AS rank FROM every""")
def _(t):
    """Two rounds; the run is stopped after the first one and taken up again."""
    lines, folder = _lines(t), shared_dir(t.spark)
    known = H.extract(lines, capital_words, neighbours, threshold=0.9).select("sentence", "head", "relation", "tail", "confidence")
    rounds = lambda most: expand_rounds(known, lines.select("sentence"), linked_through, folder, max_rounds=most, least_ratio=0.0)
    rounds(1)
    out = rounds(2)
    return out.select(F.md5("sentence").alias("sentence_id"), "head", "relation", "tail", F.round("confidence", 6).alias("confidence"),
                      c("is_new").cast("int").alias("is_new"), "round", c("rank").cast("long").alias("rank"))
