"""Aggregations, windows, ordering and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.functions import text as X
from tripleloom.operators import aggregate as A
from tripleloom.operators import select as S
from tripleloom.plans.graph_tables import ORDER, edges, kg, nodes, raw_triples
from tripleloom.plans.registry import dealt, query

c = F.col


def r6(col, name=None):
    out = F.round(c(col) if isinstance(col, str) else col, 6)
    return out.alias(name or col)


@query("a_graph_counts", kg("SELECT (SELECT count(*) FROM kg_nodes) AS nodes, (SELECT count(*) FROM kg_edges) AS edges"))
def _(t):
    return A.graph_counts(nodes(t), edges(t))


@query("a_label_counts", kg("SELECT type, count(*) AS n FROM kg_nodes GROUP BY 1"))
def _(t):
    return A.value_counts(nodes(t), "type").orderBy(F.desc("n"), "type")


@query("a_relation_counts", kg("SELECT relation, count(*) AS n FROM kg_edges GROUP BY 1"))
def _(t):
    return A.value_counts(edges(t), "relation").orderBy(F.desc("n"), "relation")


@query("a_weight_hist", kg("SELECT confidence, count(*) AS n FROM kg_edges WHERE confidence IS NOT NULL GROUP BY 1"))
def _(t):
    return A.weight_hist(edges(t), "confidence").orderBy(F.desc("confidence"))


@query("a_context_coverage", kg("""SELECT relation, count(*) AS edges, count(sentence) AS with_context,
 round((SELECT CAST(count(sentence) AS DOUBLE) / count(*) FROM kg_edges), 6) AS graph_ratio FROM kg_edges GROUP BY 1"""))
def _(t):
    return A.context_coverage(edges(t))


@query("a_attribute_fill", kg("""SELECT count(*) AS nodes, count(description) AS with_description, count(properties) AS with_properties,
 count(time_complexity) AS with_time_complexity FROM kg_nodes"""))
def _(t):
    return A.attribute_fill(nodes(t), ["description", "properties", "time_complexity"])


DEG = ", ends AS (SELECT relation, head AS name FROM kg_edges UNION ALL SELECT relation, tail FROM kg_edges WHERE head <> tail)"


@query("a_degree", kg(f"{DEG} SELECT name, count(*) AS degree, CAST(count(*) > 15 AS INTEGER) AS hub FROM ends GROUP BY 1"))
def _(t):
    return A.degree(edges(t)).withColumn("hub", (c("degree") > 15).cast("int"))


@query("a_hub_skew", kg(f"""{DEG}, x AS (SELECT name, relation, count(*) AS n, sum(count(*)) OVER (PARTITION BY name) AS d FROM ends GROUP BY 1, 2)
SELECT name, relation, n, CAST(d AS BIGINT) AS degree, round(CAST(n AS DOUBLE) / d, 6) AS share, CAST(CAST(n AS DOUBLE) / d > 0.7 AND n > 10 AS INTEGER) AS flagged FROM x WHERE d > 15"""))
def _(t):
    return A.hub_skew(edges(t)).select("name", "relation", "n", "degree", r6("share"), c("flagged").cast("int").alias("flagged"))


@query("a_extract_stats", kg("""SELECT count(*) AS records, count(DISTINCT relation) AS relations, round(avg(length(sentence)), 6) AS mean_length,
 (SELECT count(*) FROM (SELECT head FROM kg_raw UNION SELECT tail FROM kg_raw)) AS entities FROM kg_raw"""))
def _(t):
    return A.extract_stats(raw_triples(t)).withColumn("mean_length", F.round("mean_length", 6))


@query("a_class_dist", "SELECT event_type, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events), 6) AS ratio FROM events GROUP BY 1")
def _(t):
    return A.class_dist(t.events, "event_type").withColumn("ratio", F.round("ratio", 6))


@query("a_class_weights", """SELECT p_type, count(*) AS n, round(CAST((SELECT count(*) FROM part) AS DOUBLE) / ((SELECT count(DISTINCT p_type) FROM part) * count(*)), 6) AS balanced,
 round(CAST((SELECT count(*) FROM part) AS DOUBLE) / count(*), 6) AS inverse FROM part GROUP BY 1""")
def _(t):
    return A.class_weights(t.part, "p_type").select("p_type", "n", r6("balanced"), r6("inverse"))


@query("a_group_sentence", kg("""SELECT dense_rank() OVER (ORDER BY sentence) - 1 AS id, sentence, head, relation, tail, confidence,
 row_number() OVER (PARTITION BY sentence ORDER BY row_no, head, relation, tail) AS mention_no FROM kg_edges WHERE sentence IS NOT NULL"""))
def _(t):
    return A.group_sentence(edges(t, "sentence"), ORDER).select("id", "sentence", "head", "relation", "tail", "confidence", c("mention_no").cast("long"))


@query("a_extend_stats", kg("""SELECT sentence, count(*) AS mentions, round(coalesce(avg(confidence), 0), 6) AS avg_confidence, count(*) FILTER (WHERE confidence > 0.95) AS new_relations
 FROM kg_raw WHERE sentence IS NOT NULL GROUP BY 1"""))
def _(t):
    m = raw_triples(t).where("sentence is not null").withColumn("is_new", c("confidence") > 0.95)
    return A.extend_stats(m).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("a_extend_ratio", kg("""SELECT (SELECT count(*) FROM kg_edges WHERE relation = 'uses') AS previous, count(*) FILTER (WHERE relation <> 'uses') AS new_relations,
 round(CAST(count(*) FILTER (WHERE relation <> 'uses') AS DOUBLE) / (SELECT count(*) FROM kg_edges WHERE relation = 'uses'), 6) AS ratio FROM kg_edges"""))
def _(t):
    e = edges(t)
    return A.extend_ratio(e.where("relation = 'uses'"), e.withColumn("is_new", c("relation") != "uses"), 2).withColumn("ratio", F.round("ratio", 6))


@query("a_schema_infer", "SELECT DISTINCT p_type, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(t):
    return A.schema_infer(t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")), "p_type", "l_returnflag")


TOK = r"""tok AS (SELECT doc_id, pos, w AS token FROM (SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) - 1 AS pos
 FROM (SELECT doc_id, regexp_split_to_array(text, '[^\p{L}]+') AS toks FROM documents)) WHERE w <> '')"""


def _tokens(t):
    toks = dealt(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", r"[^\p{L}]+")).alias("pos", "token"))
    return toks.where("token <> ''")


@query("a_vocab", f"""WITH {TOK}, x AS (SELECT token, count(*) AS n, min(doc_id * 1000000 + pos) AS first_at FROM tok GROUP BY 1 HAVING count(*) >= 2)
SELECT token, n, row_number() OVER (ORDER BY first_at, token) + 8 AS id FROM x UNION ALL
SELECT w, 0, i FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[MASK]', 2), ('[CLS]', 3), ('[SEP]', 4), ('[BOS]', 5), ('[EOS]', 6), ('HEAD', 7), ('TAIL', 8)) s(w, i)""")
def _(t):
    return A.vocab(_tokens(t), ["doc_id", "pos"], min_freq=2).select("token", "n", c("id").cast("long").alias("id"))


@query("a_top_entity", kg(""", x AS (SELECT head AS name, row_no * 2 AS first_at, head, relation, tail FROM kg_raw UNION ALL SELECT tail, row_no * 2 + 1, head, relation, tail FROM kg_raw)
SELECT name, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, min(first_at) LIMIT 1"""))
def _(t):
    return A.top_entity(raw_triples(t), ["row_no"])


@query("a_longest", """SELECT doc_id, CAST(length(text) AS BIGINT) AS length, CAST(least(512, ceil(length(text) / 64.0) * 64) AS BIGINT) AS bound FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1""")
def _(t):
    return A.longest(t.documents, "doc_id", "text").select("doc_id", c("length").cast("long").alias("length"), c("bound").cast("long").alias("bound"))


@query("a_conf_stats", kg("""SELECT min(confidence) AS lowest, max(confidence) AS highest, round(avg(confidence), 6) AS mean, count(*) FILTER (WHERE confidence >= 0.8) AS kept,
 count(*) FILTER (WHERE confidence < 0.8) AS dropped FROM kg_raw"""))
def _(t):
    return A.conf_stats(raw_triples(t), 0.8).withColumn("mean", F.round("mean", 6))


@query("a_metric_means", """SELECT round(avg(n_chars), 6) AS n_chars, round(avg(length(lang)), 6) AS words, round(avg(CASE WHEN d > 0 THEN CAST(length(source) AS DOUBLE) / d ELSE 0 END), 6) AS recall_rate
 FROM (SELECT *, CAST(n_chars AS INTEGER) % 7 AS d FROM documents)""")
def _(t):
    df = t.documents.select("n_chars", F.length("lang").alias("words"), F.length("source").alias("hit"), (c("n_chars") % 7).alias("d"))
    return A.metric_means(df, ["n_chars", "words"], "hit", "d").select(r6("n_chars"), r6("words"), r6("recall_rate"))


@query("a_rollup_score", """SELECT coalesce(l_returnflag, 'total') AS category, CAST(sum(CAST(l_linestatus = 'F' AS INTEGER)) AS BIGINT) AS tp, count(*) AS gold, CAST(sum(l_linenumber) AS BIGINT) AS pred
 FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def _(t):
    counts = t.lineitem.select(c("l_returnflag").alias("category"), (c("l_linestatus") == "F").cast("long").alias("tp"), F.lit(1).cast("long").alias("gold"), c("l_linenumber").cast("long").alias("pred"))
    return A.rollup_score(counts, "category", ["tp", "gold", "pred"])


# ---- sets ---------------------------------------------------------------------------------

@query("s_dedup_triples", kg("SELECT row_no, head, relation, tail, sentence FROM kg_edges"))
def _(t):
    return S.dedup_triples(raw_triples(t), ["row_no", "confidence"]).select("row_no", "head", "relation", "tail", "sentence")


@query("w_first_seen", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def _(t):
    return S.first_seen(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("s_dedup_offsets", """SELECT l_suppkey AS head, l_partkey AS tail, l_linenumber AS head_offset, l_quantity AS tail_offset, l_orderkey FROM (SELECT *, row_number() OVER
 (PARTITION BY l_suppkey, l_partkey, l_linenumber, l_quantity ORDER BY l_orderkey) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    rows = t.lineitem.select(c("l_suppkey").alias("head"), c("l_partkey").alias("tail"), c("l_linenumber").alias("head_offset"), c("l_quantity").alias("tail_offset"), "l_orderkey")
    return S.first_seen(rows, ["head", "tail", "head_offset", "tail_offset"], ["l_orderkey"])


@query("s_dedup_labels", r"""SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(regexp_extract_all(text, '[A-ZÉÈÜÄÖ]\p{L}+'))), lambda w: concat(w, '/NAME')), '|') AS labels FROM documents""")
def _(t):
    found = F.transform(F.regexp_extract_all("text", F.lit(r"[A-ZÉÈÜÄÖ]\p{L}+"), F.lit(0)), lambda w: F.struct(w.alias("entity"), F.lit("NAME").alias("type")))
    labels = F.transform(F.array_sort(F.array_distinct(found)), lambda s: F.concat(s["entity"], F.lit("/"), s["type"]))
    return t.documents.select("doc_id", F.array_join(labels, "|").alias("labels"))


@query("s_merge_datasets", """WITH u AS (SELECT 0 AS part, doc_id, text, lang FROM documents WHERE lang = 'en' UNION ALL SELECT 1, doc_id, text, lang FROM documents)
SELECT min(doc_id) AS doc_id, CAST(min(part) AS INTEGER) AS is_rest, md5(text) AS text_id, lang FROM u GROUP BY text, lang""")
def _(t):
    docs = t.documents.select("doc_id", "text", "lang")
    parts = [docs.where("lang = 'en'").withColumn("is_rest", F.lit(0)), docs.withColumn("is_rest", F.lit(1))]
    return S.merge_datasets(parts, ["text", "lang"], ["doc_id"]).select("doc_id", "is_rest", F.md5("text").alias("text_id"), "lang")


BOTH = """, both_ways AS (SELECT row_no, head, relation, tail FROM kg_edges UNION ALL SELECT row_no + 500000000000, tail, relation, head FROM kg_edges WHERE relation = 'uses')"""


@query("s_undirected_links", kg(f"""{BOTH} SELECT row_no, head, relation, tail FROM (SELECT *, row_number() OVER (PARTITION BY least(head, tail), greatest(head, tail), relation ORDER BY row_no) AS rn FROM both_ways) WHERE rn = 1"""))
def _(t):
    e = edges(t).select("row_no", "head", "relation", "tail")
    back = e.where("relation = 'uses'").select((c("row_no") + 500000000000).alias("row_no"), c("tail").alias("head"), "relation", c("head").alias("tail"))
    return S.undirected_links(e.unionByName(back), ["row_no"])


@query("s_node_union", kg("SELECT head AS name, head_type AS type FROM kg_raw UNION SELECT tail, tail_type FROM kg_raw"))
def _(t):
    return S.node_union(raw_triples(t))


@query("s_difference", """SELECT p_brand, p_size, array_to_string(list_sort(list_filter((SELECT list(DISTINCT p_type) FROM part), lambda x: NOT list_contains(have, x))), '|') AS missing
 FROM (SELECT p_brand, p_size, list(DISTINCT p_type) AS have FROM part GROUP BY 1, 2)""")
def _(t):
    brands = t.part.select("p_brand", "p_size").distinct()
    missing = S.missing_values(t.part, ["p_brand", "p_size"], "p_type").groupBy("p_brand", "p_size").agg(F.array_join(F.array_sort(F.collect_list("p_type")), "|").alias("missing"))
    return brands.join(missing, ["p_brand", "p_size"], "left").select("p_brand", "p_size", F.coalesce("missing", F.lit("")).alias("missing"))


GP = """g AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F')"""


@query("s_symmetric", f"""WITH {GP} SELECT CAST((SELECT count(*) FROM (FROM g INTERSECT FROM p)) AS BIGINT) AS tp, CAST((SELECT count(*) FROM (FROM g EXCEPT FROM p)) AS BIGINT) AS fn,
 CAST((SELECT count(*) FROM (FROM p EXCEPT FROM g)) AS BIGINT) AS fp""")
def _(t):
    keys = ["l_suppkey", "l_partkey"]
    return S.tp_fp_fn(t.lineitem.where("l_returnflag = 'A'"), t.lineitem.where("l_linestatus = 'F'"), keys)


# ---- windows ------------------------------------------------------------------------------

@query("w_k_shot", """SELECT seed, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY seed, p_type ORDER BY md5(concat(seed, '|', p_partkey)), p_partkey) AS rn
 FROM part, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS seed)) WHERE rn <= 8""")
def _(t):
    return S.k_shot(t.part.select("p_partkey", "p_type"), "p_type", "p_partkey", 8, [1, 2, 3, 4, 5]).drop("rank")


def _sentences(t):
    """Documents as arrays of sentences with their tokens and token starts."""
    s = F.filter(F.transform(X.split_dropping(c("text")), lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")), lambda a: F.size(a) > 0)
    return dealt(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", s.alias("sents"))


@query("w_context_tokens", r"""WITH s AS (SELECT doc_id, unnest(a) AS tk, generate_subscripts(a, 1) - 1 AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。？！；.;!?]'),
  lambda x: list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')), lambda t: len(t) > 0) AS a FROM documents)),
 d AS (SELECT doc_id, flatten(list(tk ORDER BY i)) AS every FROM s GROUP BY 1), p AS (SELECT doc_id, i, len(tk) AS n, coalesce(sum(len(tk)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM s),
 b AS (SELECT doc_id, i, n, st, every, greatest(0, least(CAST(floor((60 - n) / 2.0) AS BIGINT), CAST(st AS BIGINT))) AS l, greatest(0, least(60 - n - CAST(floor((60 - n) / 2.0) AS BIGINT), len(every) - CAST(st AS BIGINT) - n)) AS r FROM p JOIN d USING (doc_id))
SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(l + n + r AS INTEGER) AS n_tokens, CAST(l AS INTEGER) AS start, CAST(l + n AS INTEGER) AS "end", md5(array_to_string(list_slice(every, CAST(st AS BIGINT) - l + 1, CAST(st AS BIGINT) + n + r), ' ')) AS tokens_id FROM b""")
def _(t):
    docs = _sentences(t)
    long = docs.select("doc_id", F.posexplode("sents").alias("i", "tokens")).withColumn("n", F.size("tokens"))
    starts = S.running_offset(long.select("doc_id", "i", "n"), ["doc_id"], ["i"], "n")
    placed = F.array_sort(F.collect_list(F.struct("i", c("start").cast("int").alias("start"))))
    per_doc = starts.groupBy("doc_id").agg(placed.alias("at")).join(docs, "doc_id")
    sents = F.zip_with("sents", "at", lambda s, a: F.struct(s.alias("tokens"), a["start"].alias("start")))
    out = per_doc.select("doc_id", F.posexplode(S.context_tokens(sents, 60)).alias("i", "w"))
    return out.select("doc_id", "i", F.size("w.tokens").alias("n_tokens"), "w.start", "w.end", F.md5(F.array_join("w.tokens", " ")).alias("tokens_id"))


SENT = r"""sent AS (SELECT doc_id, i, s, len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) AS n FROM
 (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) - 1 AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[。？！；.;!?]'),
  lambda x: regexp_matches(x, '\S')) AS a FROM documents)))"""


@query("w_sentence_window", f"""WITH {SENT}, w AS (SELECT doc_id, i AS first, sum(n) OVER x AS n_tokens, count(*) OVER x AS width, count(*) OVER (PARTITION BY doc_id) AS total FROM sent
 WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT doc_id, CAST(first AS BIGINT) AS first, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(width AS BIGINT) AS width FROM w WHERE width = least(3, total)""")
def _(t):
    w = _sentences(t).select("doc_id", F.explode(S.sentence_windows(c("sents"), 3)).alias("w"))
    return w.select("doc_id", c("w.first").cast("long").alias("first"), F.size(F.flatten("w.sentences")).cast("long").alias("n_tokens"), F.size("w.sentences").cast("long").alias("width"))


@query("w_running_offset", f"""WITH {SENT} SELECT doc_id, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sent""")
def _(t):
    long = _sentences(t).select("doc_id", F.posexplode("sents").alias("i", "tokens")).select("doc_id", c("i").cast("long").alias("i"), F.size("tokens").cast("long").alias("n"))
    return S.running_offset(long, ["doc_id"], ["i"], "n")


@query("w_share_total", kg("""SELECT head, relation, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY head), 6) AS share FROM (SELECT head, relation, count(*) AS n FROM kg_edges GROUP BY 1, 2)"""))
def _(t):
    from pyspark.sql import Window
    counts = A.value_counts(edges(t), "head", "relation")
    return counts.withColumn("share", F.round(c("n") / F.sum("n").over(Window.partitionBy("head")), 6))


TAGS = r"""tags AS (SELECT doc_id, pos, CASE WHEN regexp_matches(w, '^[A-ZÉ]') THEN 'B-CAP' WHEN length(w) >= 9 THEN 'I-LONG' WHEN length(w) >= 7 THEN 'I-MID' ELSE 'O' END AS tag FROM
 (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, ' ') AS a FROM documents)))"""


def word_tag(w):
    return F.when(w.rlike("^[A-ZÉ]"), "B-CAP").when(F.length(w) >= 9, "I-LONG").when(F.length(w) >= 7, "I-MID").otherwise("O")


@query("w_bio_islands", f"""WITH {TAGS}, a AS (SELECT *, lag(tag, 1, 'O') OVER (PARTITION BY doc_id ORDER BY pos) AS pt FROM tags),
 b AS (SELECT *, sum(CAST(starts_with(tag, 'B') OR pt = 'O' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM a WHERE tag <> 'O')
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 1 AS BIGINT) AS "end", arg_min(substr(tag, 3), pos) AS type FROM b GROUP BY doc_id, g""")
def _(t):
    toks = dealt(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w")).select("doc_id", c("pos").cast("long").alias("pos"), word_tag(c("w")).alias("tag"))
    return S.tag_islands(toks, "doc_id", "pos", "tag")


@query("w_kfold", """SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) * 10 - 1) / CAST(count(*) OVER () AS DOUBLE)) AS INTEGER) AS fold FROM orders""")
def _(t):
    return S.kfold(t.orders.select("o_orderkey"), ["o_orderkey"])


# ---- ordering -----------------------------------------------------------------------------

@query("t_conf_desc_limit", kg("SELECT row_no, head, relation, tail, confidence FROM kg_edges WHERE confidence >= 0.8 - 1e-10"))
def _(t):
    return S.by_confidence(edges(t).select("row_no", "head", "relation", "tail", "confidence"), ORDER, threshold=0.8)


@query("t_name_limit20", kg("SELECT DISTINCT name FROM kg_nodes WHERE contains(name, '77') ORDER BY name LIMIT 20"))
def _(t):
    return S.names_containing(nodes(t), "77")


SCORE = """CASE WHEN head = {0} THEN 3 WHEN contains(head, {0}) THEN 2 ELSE 0 END + CASE WHEN tail = {0} THEN 2 WHEN contains(tail, {0}) THEN 1 ELSE 0 END + CAST(contains(relation, 'appl') OR contains(relation, 'impl') AS INTEGER)"""


@query("t_relation_score", kg(f"""SELECT row_no, head, relation, tail, CAST({SCORE.format("'Supplier#000000001'")} AS INTEGER) AS score FROM kg_edges ORDER BY score DESC, row_no, head, relation, tail LIMIT 8"""))
def _(t):
    score = S.relation_score(F.lit("Supplier#000000001"), c("head"), c("relation"), c("tail"), ["appl", "impl"])
    return edges(t).select("row_no", "head", "relation", "tail", score.alias("score")).orderBy(F.desc("score"), *ORDER).limit(8)


COS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
COSQ = f"({COS.format('e.embedding', 'q.embedding')} / (sqrt({COS.format('e.embedding', 'e.embedding')}) * sqrt({COS.format('q.embedding', 'q.embedding')})))"


@query("t_candidate_score", f"""WITH q AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1)
SELECT vec_id, round({COSQ} * greatest(1, sqrt(label)) * CASE WHEN vec_id % 2 = 0 THEN 1.2 ELSE 1 END * CASE WHEN label = 3 THEN 1.5 ELSE 1 END, 5) AS score FROM embeddings e JOIN q USING (label)""")
def _(t):
    q = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    scored = t.embeddings.join(q, "label")
    score = S.candidate_score(S.cosine(c("embedding"), c("q")), c("label"), c("vec_id") % 2 == 0, c("label") == 3)
    return scored.select("vec_id", F.round(score, 5).alias("score"))


@query("t_link_by_degree", kg(f"""{DEG}, d AS (SELECT name, count(*) AS degree FROM ends GROUP BY 1), ch AS (SELECT name FROM kg_nodes WHERE type IN ('Algorithm', 'DataStructure'))
SELECT row_no, e.head, relation, e.tail, CAST(a.degree + b.degree AS BIGINT) AS score FROM kg_edges e JOIN d a ON a.name = e.head JOIN d b ON b.name = e.tail
WHERE e.head IN (FROM ch) AND e.tail IN (FROM ch) ORDER BY score DESC, row_no, e.head, relation, e.tail LIMIT 200"""))
def _(t):
    chosen = nodes(t).where("type in ('Algorithm', 'DataStructure')").select("name").distinct()
    return S.links_by_degree(edges(t).select("row_no", "head", "relation", "tail"), chosen, ORDER, 200)


@query("t_graph_caps", kg(""", s AS (SELECT head AS name, row_no * 2 AS first_at FROM kg_edges UNION ALL SELECT tail, row_no * 2 + 1 FROM kg_edges),
 n AS (SELECT name FROM s GROUP BY name ORDER BY min(first_at) LIMIT 20),
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(head, tail), greatest(head, tail), relation ORDER BY row_no) AS rn FROM kg_edges) WHERE rn = 1),
 l AS (SELECT head, relation, tail FROM u ORDER BY row_no, head, relation, tail LIMIT 30)
SELECT 'node' AS kind, name AS a, NULL AS relation, NULL AS b FROM n UNION ALL SELECT 'link', head, relation, tail FROM l"""))
def _(t):
    n, l = S.graph_caps(edges(t).select(*ORDER), ORDER)
    none = F.lit(None).cast("string")
    return n.select(F.lit("node").alias("kind"), c("name").alias("a"), none.alias("relation"), none.alias("b")).unionByName(
        l.select(F.lit("link").alias("kind"), c("head").alias("a"), "relation", c("tail").alias("b")))


@query("t_length_sorted", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents")
def _(t):
    return S.length_sorted(t.documents.select("doc_id", "text"), "text").select("doc_id", F.length("text").alias("n"))


@query("t_topic_pick", """WITH p AS (SELECT p_partkey AS no, concat(p_name, ' ', p_partkey) AS name, p_type AS type FROM part),
 a AS (SELECT name FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY no) AS rn FROM p WHERE type IN ('ECONOMY', 'PROMO')) WHERE rn <= 20)
SELECT no, name, type FROM p ORDER BY CASE WHEN name IN (FROM a) THEN 0 ELSE 1 END, no LIMIT 50""")
def _(t):
    p = t.part.select(c("p_partkey").alias("no"), F.concat("p_name", F.lit(" "), c("p_partkey").cast("string")).alias("name"), c("p_type").alias("type"))
    return S.topic_pick(p, ["ECONOMY", "PROMO"], "no", each=20)
