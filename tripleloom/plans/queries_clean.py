"""Cleaning, filters and predicates over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.functions import constants as K
from tripleloom.functions import text as X
from tripleloom.operators import clean as C
from tripleloom.plans.graph_tables import edges, kg, raw_triples
from tripleloom.plans.registry import query


def sql_case(table: dict, col: str, default: str) -> str:
    """CASE text of a fixed table."""
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {col} {whens} ELSE {default} END"


def sql_ladder(col: str, families, default: str) -> str:
    def hit(words):
        return " OR ".join(f"contains({col}, '{w}')" for w in words)
    whens = " ".join(f"WHEN {hit(words)} THEN '{label}'" for label, words in families)
    return f"CASE {whens} ELSE '{default}' END"


def _messy(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") == 7, F.lit(None)).otherwise(
        F.concat(F.lit("  "), "p_name", F.lit("   ("), "p_brand", F.lit(") \""), "p_type", F.lit("\" "))).alias("raw"))


MESSY = """messy AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL
 ELSE concat('  ', p_name, '   (', p_brand, ') "', p_type, '" ') END AS raw FROM part)"""
NORM = "coalesce(trim(replace(replace(regexp_replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '\\([^)]*\\)', '', 'g'), '\"', ''), '''', '')), '')"


@query("norm_entity", f"WITH {MESSY} SELECT p_partkey, {NORM.format('raw')} AS entity FROM messy")
def _(t):
    return _messy(t).select("p_partkey", C.norm_entity(F.col("raw")).alias("entity"))


@query("drop_invalid", f"""WITH {MESSY}, pairs AS (SELECT p_partkey, {NORM.format('raw')} AS head, 'uses' AS relation,
  {NORM.format("CASE WHEN p_partkey % 3 = 0 THEN raw ELSE concat('x', raw) END")} AS tail FROM messy)
SELECT * FROM pairs WHERE head <> '' AND tail <> '' AND head <> tail""")
def _(t):
    tail = F.when(F.col("p_partkey") % 3 == 0, F.col("raw")).otherwise(F.concat(F.lit("x"), "raw"))
    pairs = _messy(t).select("p_partkey", C.norm_entity(F.col("raw")).alias("head"), F.lit("uses").alias("relation"),
                             C.norm_entity(tail).alias("tail"))
    return pairs.where(C.valid_triple(F.col("head"), F.col("relation"), F.col("tail")))


TYPE_SQL = f"""WITH named AS (
  SELECT p_partkey, concat(p_name, CASE p_size % 8 WHEN 0 THEN ' Sort' WHEN 1 THEN ' heap' WHEN 2 THEN ' scenario' WHEN 3 THEN '插入'
    WHEN 4 THEN ' O(n)' WHEN 5 THEN ' FIFO' ELSE '' END) AS name,
    CASE p_type WHEN 'ECONOMY' THEN 'Algorithm' WHEN 'SMALL' THEN 'other' END AS given FROM part),
 dict AS (SELECT DISTINCT p_name AS entity, '部件' AS type FROM part WHERE p_type = 'PROMO')
SELECT p_partkey, name, coalesce({sql_case(K.TYPE_NAMES, 'given', 'NULL')}, type,
  {sql_ladder('lower(name)', K.TYPE_KEYWORDS, K.DEFAULT_TYPE)}) AS entity_type
FROM named LEFT JOIN dict ON name = entity"""


@query("type_entity", TYPE_SQL)
def _(t):
    size = F.col("p_size") % 8
    suffix = (F.when(size == 0, " Sort").when(size == 1, " heap").when(size == 2, " scenario").when(size == 3, "插入")
              .when(size == 4, " O(n)").when(size == 5, " FIFO").otherwise(""))
    named = t.part.select("p_partkey", F.concat("p_name", suffix).alias("name"),
                          F.when(F.col("p_type") == "ECONOMY", "Algorithm").when(F.col("p_type") == "SMALL", "other").alias("given"))
    dictionary = t.part.where(F.col("p_type") == "PROMO").select(F.col("p_name").alias("entity"), F.lit("部件").alias("type")).distinct()
    return C.type_entity(named, "name", "given", dictionary, "entity_type").drop("given")


@query("translate_label", kg(f"""SELECT row_no, head, tail, {sql_case(K.RELATION_NAMES, 'relation', 'relation')} AS built,
  {sql_case(K.DISPLAY_RELATION_NAMES, 'relation', 'relation')} AS shown,
  {sql_case(K.EXPORT_TYPE_NAMES, 'head_type', 'head_type')} AS head_label FROM kg_edges"""))
def _(t):
    return edges(t).select("row_no", "head", "tail", C.translate(F.col("relation"), K.RELATION_NAMES).alias("built"),
                           C.translate(F.col("relation"), K.DISPLAY_RELATION_NAMES).alias("shown"),
                           C.translate(F.col("head_type"), K.EXPORT_TYPE_NAMES).alias("head_label"))


SCHEMA_SQL = ", ".join(f"('{h}', '{tl}', '{r}')" for h, tl, r, _ in K.RELATION_SCHEMA)


@query("enforce_schema", kg(f"""SELECT row_no, head, head_type, e.relation, tail, tail_type FROM kg_edges e
 LEFT JOIN (VALUES {SCHEMA_SQL}) s(h, tl, rel) ON e.relation = s.rel
 WHERE s.rel IS NULL OR (head_type = h AND tail_type = tl)"""))
def _(t):
    return C.enforce_schema(edges(t), C.default_schema(t.spark)).select("row_no", "head", "head_type", "relation", "tail", "tail_type")


@query("conf_filter", kg("""SELECT 'drop_below_0.7' AS rule, row_no, head, tail FROM kg_raw WHERE confidence >= 0.7
 UNION ALL SELECT 'over_0.8', row_no, head, tail FROM kg_raw WHERE confidence > 0.8
 UNION ALL SELECT 'near_0.8', row_no, head, tail FROM kg_raw WHERE confidence >= CAST(0.8 AS DOUBLE) - CAST(1e-10 AS DOUBLE)
 UNION ALL SELECT 'labelled', row_no, head, tail FROM kg_raw WHERE confidence > 0.5 AND relation <> 'uses'
 UNION ALL SELECT 'keep_null', row_no, head, tail FROM kg_raw WHERE confidence IS NULL OR confidence >= 0.8"""))
def _(t):
    raw = raw_triples(t)
    parts = [("drop_below_0.7", C.conf_filter(raw, 0.7)), ("over_0.8", C.conf_filter(raw, 0.8, ">")),
             ("near_0.8", C.conf_filter(raw, 0.8, "~>=")),
             ("labelled", C.conf_filter(raw, 0.5, ">", skip_label="uses")),
             ("keep_null", C.conf_filter(raw, 0.8, nulls="keep"))]
    out = None
    for rule, df in parts:
        df = df.select(F.lit(rule).alias("rule"), "row_no", "head", "tail")
        out = df if out is None else out.unionByName(df)
    return out


@query("drop_none_label", """SELECT event_id, label FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'none'
 WHEN 'click' THEN NULL ELSE event_type END AS label FROM events) WHERE label IS DISTINCT FROM 'none'""")
def _(t):
    label = F.when(F.col("event_type") == "error", "none").when(F.col("event_type") != "click", F.col("event_type"))
    return C.drop_none_label(t.events.select("event_id", label.alias("label")), "label")


@query("both_mentions_present", kg("""SELECT row_no, head, tail, sentence FROM kg_raw
 WHERE contains(sentence, head) AND contains(sentence, tail)"""))
def _(t):
    return C.both_mentions_present(raw_triples(t), "sentence", "head", "tail").select("row_no", "head", "tail", "sentence")


@query("align_tokens", r"""WITH d AS (SELECT doc_id, regexp_split_to_array(text, '\s+') AS toks FROM documents),
 m AS (SELECT doc_id, toks, toks[2:3] AS head, [toks[len(toks) - 1]] AS tail FROM d WHERE len(toks) >= 2),
 x AS (SELECT doc_id, toks, head, tail,
   list_filter(range(1, len(toks) + 1), lambda i: toks[i] = head[1] AND (len(head) = 1 OR toks[i + 1] = head[2])) AS h,
   list_position(toks, tail[1]) AS tp FROM m)
SELECT doc_id, array_to_string(head, ' ') AS head, array_to_string(tail, ' ') AS tail, CAST(h[1] - 1 AS BIGINT) AS head_start,
  CAST(h[1] + len(head) - 2 AS BIGINT) AS head_end, CAST(tp - 1 AS BIGINT) AS tail_start, CAST(tp - 1 AS BIGINT) AS tail_end FROM x""")
def _(t):
    toks = t.documents.select("doc_id", F.split("text", r"\s+").alias("toks"))
    mentions = toks.select("doc_id", "toks", F.slice("toks", 2, 2).alias("h"),
                           F.array(F.get("toks", F.size("toks") - 2)).alias("tl"))
    out = X.align_tokens(mentions, "toks", "h", "tl")
    return out.select("doc_id", F.array_join("h", " ").alias("head"), F.array_join("tl", " ").alias("tail"),
                      *[F.col(c).cast("long") for c in ("head_start", "head_end", "tail_start", "tail_end")])


@query("sanitize_name", r"""SELECT page_id, trim(regexp_replace(url, '[^\p{L}\p{N}_\s\-]', '', 'g')) AS url_name,
 trim(regexp_replace(html, '[^\p{L}\p{N}_\s\-]', '', 'g')) AS html_name FROM pages""")
def _(t):
    return t.pages.select("page_id", C.sanitize_name(F.col("url")).alias("url_name"), C.sanitize_name(F.col("html")).alias("html_name"))


@query("validate_entities", r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ' '),
 lambda w: trim(regexp_replace(w, '[^\p{L}\p{N}_\s\-]', '', 'g'))), lambda w: w <> ''), '|') AS names FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.array_join(C.validate_entities(F.split("text", " ")), "|").alias("names"))


@query("suspicious_input", r"""SELECT page_id, CAST(regexp_matches(html, '['';]') OR regexp_matches(html, '(?i)\b(DROP|DELETE|CREATE|ALTER|MERGE)\b')
 OR contains(html, '//') OR regexp_matches(html, '/\*.*\*/') AS INTEGER) AS html_flag,
 CAST(regexp_matches(url, '['';]') OR contains(url, '//') AS INTEGER) AS url_flag FROM pages""")
def _(t):
    return t.pages.select("page_id", C.suspicious(F.col("html")).cast("int").alias("html_flag"),
                          C.suspicious(F.col("url")).cast("int").alias("url_flag"))


@query("clean_text", r"""SELECT doc_id, translate(regexp_replace(text, '[^\x{4e00}-\x{9fa5}a-zA-Z0-9\s，。？！、‘’；《》【】（）：\-/“”]', '', 'g'), 'QW', 'qw') AS cleaned
 FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.clean_text(F.col("text"), "QW", "qw").alias("cleaned"))


@query("split_sentences", r"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[。？！；.;!?]')) AS s,
  generate_subscripts(regexp_split_to_array(text, '[。？！；.;!?]'), 1) - 1 AS pos FROM documents)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, trim(s, E' \n\t\r') AS sentence FROM s WHERE trim(s, E' \n\t\r') <> ''""")
def _(t):
    out = t.documents.select("doc_id", F.posexplode(X.split_dropping(F.col("text"))).alias("pos", "s"))
    out = out.select("doc_id", F.col("pos").cast("long"), X.strip(F.col("s")).alias("sentence"))
    return out.where(F.col("sentence") != "")


@query("split_sentences_keep", r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.]+|[.]') AS parts FROM documents)
SELECT doc_id, CAST(len(list_filter(parts, lambda p: p = '.')) AS BIGINT) AS marks,
  CAST(len(list_filter(parts, lambda p: p <> '.')) AS BIGINT) AS sentences FROM s""")
def _(t):
    parts = X.split_keeping(F.col("text"), ".")
    marks = F.size(F.filter(parts, lambda p: p == "."))
    return t.documents.select("doc_id", marks.cast("long").alias("marks"), (F.size(parts) - marks).cast("long").alias("sentences"))


@query("split_sentences_lines", r"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([。！？；.])\s*', E'\\1\n', 'g'), '\n+')) AS s FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(max(length(trim(s, E' \n\t\r'))) AS BIGINT) AS longest FROM s
WHERE trim(s, E' \n\t\r') <> '' GROUP BY doc_id""")
def _(t):
    out = t.documents.select("doc_id", F.explode(X.split_after(F.col("text"), "。！？；.")).alias("s"))
    out = out.where(X.strip(F.col("s")) != "")
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length(X.strip(F.col("s")))).cast("long").alias("longest"))


@query("pack_sentences", rf"""WITH RECURSIVE s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, s FROM (
  SELECT doc_id, i, trim(p, E' \n\t\r') AS s FROM (SELECT doc_id, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '[{X.SENTENCE_MARKS}]') AS a FROM documents))) WHERE s <> ''),
 f AS (SELECT doc_id, CAST(0 AS BIGINT) AS r, '' AS cur, CAST(NULL AS VARCHAR) AS done FROM s WHERE r = 1
  UNION ALL SELECT f.doc_id, s.r, CASE WHEN length(cur) + length(s) + 1 > 480 THEN concat(s, ' ') ELSE concat(cur, s, ' ') END, CASE WHEN length(cur) + length(s) + 1 > 480 THEN trim(cur) END FROM f JOIN s ON s.doc_id = f.doc_id AND s.r = f.r + 1),
 x AS (SELECT doc_id, r, done AS chunk FROM f UNION ALL SELECT doc_id, max(r) + 1, trim(arg_max(cur, r)) FROM f GROUP BY 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS INTEGER) AS chunk_no, chunk, CAST(length(chunk) AS INTEGER) AS n_chars FROM x WHERE chunk <> ''""")
def _(t):
    docs = t.documents.select("doc_id", F.filter(F.transform(X.split_dropping(F.col("text")), X.strip), lambda s: s != "").alias("s"))
    out = docs.select("doc_id", F.posexplode(X.pack_sentences(F.col("s"), 480)).alias("chunk_no", "chunk"))
    return out.select("doc_id", "chunk_no", "chunk", F.length("chunk").alias("n_chars"))


@query("length_gate", """SELECT doc_id, md5(text) AS whole, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_tokens
 FROM documents WHERE len(string_split(text, ' ')) <= 512""")
def _(t):
    toks = t.documents.withColumn("toks", F.split("text", " "))
    return X.length_gate(toks, "toks", 512).select("doc_id", F.md5("text").alias("whole"), F.size("toks").cast("long").alias("n_tokens"))


DELETE_SQL = ", ".join(str(r) for r in K.DELETE_RULES)
RENAME_SQL = ", ".join(str(r) for r in K.RENAME_RULES)


@query("curate_delete", kg(f"""SELECT row_no, head, relation, tail FROM kg_edges
 WHERE (head_type, relation, tail_type) NOT IN (VALUES {DELETE_SQL})"""))
def _(t):
    return C.curate_delete(edges(t)).select("row_no", "head", "relation", "tail")


@query("curate_rename", kg(f"""SELECT row_no, head, coalesce(new_rel, e.relation) AS relation, tail FROM kg_edges e
 LEFT JOIN (VALUES {RENAME_SQL}) r(h, rel, tl, new_rel) ON h = head_type AND rel = e.relation AND tl = tail_type"""))
def _(t):
    return C.curate_rename(edges(t)).select("row_no", "head", "relation", "tail")


EXACT_SQL = ", ".join(str(r) for r in K.CONTEXT_TEMPLATES)
FILL = f"""coalesce(sentence, replace(replace(replace(coalesce(tpl, {sql_case(K.GENERIC_TEMPLATES, 'e.relation', f"'{K.ANY_TEMPLATE}'")}),
  '{{source}}', head), '{{target}}', tail), '{{relation}}', e.relation))"""


@query("fill_context", kg(f"""SELECT row_no, head, e.relation, tail, {FILL} AS sentence FROM kg_edges e
 LEFT JOIN (VALUES {EXACT_SQL}) x(rel, h, tl, tpl) ON rel = e.relation AND h = head_type AND tl = tail_type"""))
def _(t):
    return C.fill_context(edges(t)).select("row_no", "head", "relation", "tail", "sentence")


RELS = ["click through", "clean up", "error seen", "view page"]


@query("valid_llm_relation", """SELECT event_id, CASE WHEN a IN ('click through', 'clean up', 'error seen', 'view page') THEN a
 WHEN contains(a, 'click through') THEN 'click through' WHEN contains(a, 'error seen') THEN 'error seen' WHEN contains(a, 'view page') THEN 'view page' WHEN contains(a, 'clean up') THEN 'clean up'
 ELSE '无关系' END AS relation FROM (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'clean up' WHEN user_id % 5 = 1 THEN concat('it is click through ', event_type) ELSE trim(concat(' ', event_type)) END AS a FROM events)""")
def _(t):
    answer = F.when(F.col("user_id") % 5 == 0, "clean up").when(F.col("user_id") % 5 == 1, F.concat(F.lit("it is click through "), "event_type")).otherwise(F.concat(F.lit(" "), "event_type"))
    return t.events.select("event_id", C.valid_relation(answer, RELS).alias("relation"))


# Keyword families for the languages of the driver texts.
FAMILIES = [("find_relation_by_two_entities", ["zwischen", "entre", "between", "sich"]),
            ("find_entity_by_relation_and_entity", ["quelque", "which", "welche", "eux"]),
            ("find_entity_definition", ["the ", "das ", "des ", "los "])]


@query("intent_rules", f"SELECT conv_id, turn, {sql_ladder('lower(text)', FAMILIES, 'other')} AS intent FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", C.intent_rules(F.col("text"), FAMILIES).alias("intent"))


@query("intent_merge", f"""SELECT conv_id, turn, CASE WHEN m IS NULL OR m = 'unknown' OR (m = 'other' AND r <> 'other') THEN r ELSE m END AS intent
 FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'other' WHEN 'assistant' THEN 'unknown' ELSE 'find_entity_definition' END AS m,
 {sql_ladder('lower(text)', FAMILIES, 'other')} AS r FROM conversations)""")
def _(t):
    model = (F.when(F.col("role") == "user", "other").when(F.col("role") == "assistant", "unknown")
             .otherwise("find_entity_definition"))
    return t.conversations.select("conv_id", "turn", C.intent_merge(model, C.intent_rules(F.col("text"), FAMILIES)).alias("intent"))


@query("default_relation", """SELECT conv_id, turn, CASE WHEN contains(text, ' sur ') THEN 'sur' WHEN length(text) > 200
 AND (contains(text, 'eux') OR contains(text, 'que')) THEN '包含' END AS relation FROM conversations""")
def _(t):
    found = F.when(F.col("text").contains(" sur "), "sur")
    return t.conversations.select("conv_id", "turn", C.default_relation(
        F.col("text"), found, F.length("text") > 200, ["eux", "que"]).alias("relation"))


@query("history_roles", """SELECT conv_id, turn, role, text AS content FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''""")
def _(t):
    return C.history_roles(t.conversations)
