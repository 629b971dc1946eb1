"""Scalar, tag and parsing functions over texts and names of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.functions import parse as P
from tripleloom.functions import tags as G
from tripleloom.functions import text as X
from tripleloom.operators import aggregate as A
from tripleloom.operators import select as S
from tripleloom.plans.graph_tables import kg, raw_triples
from tripleloom.plans.queries_stats import TAGS, word_tag
from tripleloom.plans.registry import dealt, query

c = F.col
L = lambda x: x.cast("long")


@query("f_find_all", """WITH d AS (SELECT doc_id, text, string_split(text, '') AS ch FROM documents), p AS (SELECT doc_id, text, list_filter(range(1, len(ch) + 1), lambda i: ch[i] = 'e' AND ch[i + 1] = 'n' AND ch[i + 2] = 'e' AND ch[i + 3] = 'n') AS at_ FROM d)
SELECT doc_id, CAST(strpos(text, 'enen') - 1 AS BIGINT) AS first, CAST(len(at_) AS BIGINT) AS n, coalesce(CAST(list_sum(at_) AS BIGINT) - len(at_), 0) AS total FROM p""")
def _(t):
    docs = t.documents.select("doc_id", G.find_first(c("text"), F.lit("enen")).cast("long").alias("first"), G.find_all(c("text"), "enen").alias("p"))
    return docs.select("doc_id", "first", L(F.size("p")).alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("f_find_first", "SELECT conv_id, turn, CAST(strpos(text, 'und') - 1 AS INTEGER) AS first FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", G.find_first(c("text"), F.lit("und")).alias("first"))


SENT = "SELECT row_no, sentence, tail AS e1, head AS e2, head_type, tail_type FROM kg_raw WHERE sentence IS NOT NULL"


def _sents(t):
    return raw_triples(t).where("sentence is not null").select("row_no", "sentence", c("tail").alias("e1"), c("head").alias("e2"), "head_type", "tail_type")


@query("f_order_by_offset", kg(f"""SELECT row_no, CASE WHEN a <= b THEN e1 ELSE e2 END AS head, CAST(least(a, b) - 1 AS INTEGER) AS head_offset, CAST(CASE WHEN a <= b THEN a + length(e1) ELSE b + length(e2) END - 1 AS INTEGER) AS head_end,
 CASE WHEN a <= b THEN e2 ELSE e1 END AS tail, CAST(greatest(a, b) - 1 AS INTEGER) AS tail_offset, CAST(CASE WHEN a <= b THEN b + length(e2) ELSE a + length(e1) END - 1 AS INTEGER) AS tail_end
 FROM (SELECT *, strpos(sentence, e1) AS a, strpos(sentence, e2) AS b FROM ({SENT})) WHERE a > 0 AND b > 0"""))
def _(t):
    return _sents(t).select("row_no", G.order_by_offset(c("sentence"), c("e1"), c("e2")).alias("o")).where("o is not null").select("row_no", "o.*")


@query("f_match_sublist", """WITH d AS (SELECT doc_id, string_split(text, ' ') AS tk FROM documents), m AS (SELECT doc_id, list_filter(range(1, len(tk)), lambda i: tk[i] = 'de' AND tk[i + 1] = 'la') AS at_ FROM d)
SELECT doc_id, CAST(len(at_) AS BIGINT) AS n, CAST(at_[1] - 1 AS BIGINT) AS first_start, CAST(at_[1] AS BIGINT) AS first_end FROM m""")
def _(t):
    m = t.documents.select("doc_id", X.match_sublist(F.split("text", " "), F.array(F.lit("de"), F.lit("la"))).alias("m"))
    return m.select("doc_id", L(F.size("m")).alias("n"), L(F.get("m", F.lit(0))["start"]).alias("first_start"), L(F.get("m", F.lit(0))["end"]).alias("first_end"))


def _tags(t):
    return dealt(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.transform(F.split("text", " "), word_tag).alias("tags"))


def _spans(t, fn):
    return _tags(t).select("doc_id", F.explode(fn(c("tags"))).alias("s")).select("doc_id", L(c("s.start")).alias("start"), L(c("s.end")).alias("end"), "s.type")


ISLE = f"""WITH {TAGS}, a AS (SELECT *, lag(tag, 1, 'O') OVER (PARTITION BY doc_id ORDER BY pos) AS pt FROM tags),
 b AS (SELECT *, sum(CAST({{0}} AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM a WHERE tag <> 'O')
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 1 AS BIGINT) AS "end", arg_min(substr(tag, 3), pos) AS type FROM b GROUP BY doc_id, g {{1}}"""


@query("f_bio_to_spans", ISLE.format("starts_with(tag, 'B') OR pt = 'O'", ""))
def _(t):
    return _spans(t, G.bio_to_spans)


@query("f_chunks_typed", ISLE.format("starts_with(tag, 'B') OR pt = 'O' OR substr(tag, 3) <> substr(pt, 3)", ""))
def _(t):
    return _spans(t, G.chunks_typed)


@query("f_bio_strict", ISLE.format("starts_with(tag, 'B') OR pt = 'O'", "HAVING arg_min(tag, pos) LIKE 'B%'"))
def _(t):
    return _spans(t, G.bio_strict)


@query("f_tagged_chars_merge", r"""WITH w AS (SELECT conv_id, turn, unnest(a) AS w, generate_subscripts(a, 1) AS pos FROM (SELECT conv_id, turn, string_split(text, ' ') AS a FROM conversations)),
 g AS (SELECT conv_id, turn, pos, w, CASE WHEN regexp_matches(w, '^[A-ZÉ]') THEN 'B-CAP' WHEN length(w) >= 9 THEN 'I-CAP' WHEN length(w) >= 7 THEN 'I-MID' ELSE 'O' END AS tag FROM w),
 k AS (SELECT *, sum(CAST(tag = 'B-CAP' AS INTEGER)) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS g FROM g WHERE tag <> 'O')
SELECT conv_id, turn, CAST(g AS BIGINT) AS nth, string_agg(w, '' ORDER BY pos) AS entity, 'CAP' AS type FROM k WHERE g > 0 AND tag <> 'I-MID' GROUP BY 1, 2, 3""")
def _(t):
    def tag(w):
        return F.when(w.rlike("^[A-ZÉ]"), "B-CAP").when(F.length(w) >= 9, "I-CAP").when(F.length(w) >= 7, "I-MID").otherwise("O")
    items = F.filter(F.transform(F.split("text", " "), lambda w: F.struct(w.alias("token"), tag(w).alias("tag"))), lambda x: x["tag"] != "O")
    merged = t.conversations.select("conv_id", "turn", items.alias("i")).select("conv_id", "turn", F.size(F.filter("i", lambda x: x["tag"] == "B-CAP")).alias("n"), G.tagged_merge(c("i")).alias("m"))
    out = merged.select("conv_id", "turn", (F.size("m") - c("n")).alias("lead"), F.posexplode("m").alias("p", "e"))
    return out.where("p >= lead").select("conv_id", "turn", (c("p") - c("lead") + 1).cast("long").alias("nth"), c("e.text").alias("entity"), "e.type")


@query("f_spans_to_bio", f"""WITH {TAGS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN tag = 'I-LONG' THEN 'B-S'
 WHEN 'I-LONG' IN (lag(tag, 1, 'O') OVER (PARTITION BY doc_id ORDER BY pos), lag(tag, 2, 'O') OVER (PARTITION BY doc_id ORDER BY pos)) THEN 'I-S' ELSE 'O' END AS tag FROM tags""")
def _(t):
    toks = _tags(t).select("doc_id", F.posexplode("tags").alias("pos", "t"))
    spans = toks.where("t = 'I-LONG'").select("doc_id", c("pos").alias("no"), c("pos").alias("start"), (c("pos") + 3).alias("end"), F.lit("S").alias("type"))
    return G.spans_to_tags(toks.drop("t"), spans, "doc_id", "pos").withColumn("pos", L(c("pos")))


@query("f_word_to_bio", """WITH d AS (SELECT conv_id, turn, string_split(text, '') AS ch FROM conversations),
 p AS (SELECT conv_id, turn, 'que' AS w, 1 AS no, unnest(list_filter(range(1, len(ch) + 1), lambda i: ch[i] = 'q' AND ch[i + 1] = 'u' AND ch[i + 2] = 'e')) - 1 AS st FROM d
  UNION ALL SELECT conv_id, turn, 'eux', 2, unnest(list_filter(range(1, len(ch) + 1), lambda i: ch[i] = 'e' AND ch[i + 1] = 'u' AND ch[i + 2] = 'x')) - 1 FROM d),
 x AS (SELECT conv_id, turn, unnest(range(st, st + 3)) AS pos, st, no, w FROM p)
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, arg_max(concat(CASE WHEN pos = st THEN 'B-' ELSE 'I-' END, w), no * 1000000 + st) AS tag FROM x GROUP BY 1, 2, 3""")
def _(t):
    key = (c("conv_id") * 1000 + c("turn")).alias("key")
    def hits(word, no):
        return t.conversations.select(key, F.explode(G.find_all(c("text"), word)).alias("start"), F.lit(word).alias("type")).withColumn("no", c("start") + no * 1000000)
    spans = hits("que", 1).unionByName(hits("eux", 2)).withColumn("end", c("start") + 3)
    chars = t.conversations.select(key, F.posexplode(F.split("text", "")).alias("pos", "ch"))
    out = G.spans_to_tags(chars, spans, "key", "pos").where("tag <> 'O'")
    return out.select(F.floor(c("key") / 1000).alias("conv_id"), (c("key") % 1000).alias("turn"), L(c("pos")).alias("pos"), "tag")


def sql_first(text, old, new):
    return f"CASE WHEN strpos({text}, {old}) > 0 THEN concat(substr({text}, 1, strpos({text}, {old}) - 1), {new}, substr({text}, strpos({text}, {old}) + length({old}))) ELSE {text} END"


@query("f_entity_marks", kg(f"""SELECT row_no, CASE WHEN contains(e1, e2) THEN tf ELSE {sql_first('h1', 'e1', "' TAIL '")} END AS marked, {sql_first('x1', 'e1', "concat(' TAIL_', tail_type, ' ')")} AS typed FROM (
 SELECT *, {sql_first('sentence', 'e2', "' HEAD '")} AS h1, {sql_first('sentence', 'e2', "concat(' HEAD_', head_type, ' ')")} AS x1, NULL AS tf FROM ({SENT}))"""))
def _(t):
    s = _sents(t)
    marked = G.entity_marks(c("sentence"), c("e2"), c("e1"), F.lit("HEAD"), F.lit("TAIL"))
    typed = G.entity_marks(c("sentence"), c("e2"), c("e1"), F.concat(F.lit("HEAD_"), "head_type"), F.concat(F.lit("TAIL_"), "tail_type"))
    return s.select("row_no", marked.alias("marked"), typed.alias("typed"))


@query("f_lm_text", kg(f"""SELECT row_no, concat({sql_first('h1', 'e1', 'tail_type')}, '[SEP]', e2, '[SEP]', e1) AS lm FROM (SELECT *, {sql_first('sentence', 'e2', 'head_type')} AS h1 FROM ({SENT}))"""))
def _(t):
    return _sents(t).select("row_no", G.lm_text(c("sentence"), c("e2"), c("e1"), c("head_type"), c("tail_type")).alias("lm"))


@query("f_marker_tokens", """WITH d AS (SELECT doc_id, lang, string_split(text, ' ') AS tk FROM documents)
SELECT doc_id, md5(array_to_string(m, ' ')) AS marked, CAST(len(m) AS BIGINT) AS n FROM (SELECT doc_id, flatten(list_transform(range(0, len(tk)), lambda i: list_filter([CASE WHEN i = 1 THEN '[SUBJ_START=' || lang || ']' END,
 CASE WHEN i = len(tk) - 2 THEN '[OBJ_START=END]' END, tk[i + 1], CASE WHEN i = 2 THEN '[SUBJ_END=' || lang || ']' END, CASE WHEN i = len(tk) - 2 THEN '[OBJ_END=END]' END], lambda x: x IS NOT NULL))) AS m FROM d)""")
def _(t):
    d = t.documents.select("doc_id", "lang", F.split("text", " ").alias("tk"))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    m = G.marker_tokens(c("tk"), span(F.lit(1), F.lit(2)), span(F.size("tk") - 2, F.size("tk") - 2), c("lang"), F.lit("END"))
    return d.select("doc_id", m.alias("m")).select("doc_id", F.md5(F.array_join("m", " ")).alias("marked"), L(F.size("m")).alias("n"))


@query("f_rel_positions", """SELECT doc_id, CAST(len(tk) AS BIGINT) AS n, md5(array_to_string(list_transform(range(0, len(tk)), lambda i: greatest(-30, least(30, i - 3)) + 31), ',')) AS pos_id FROM (SELECT doc_id, string_split(text, ' ') AS tk FROM documents)""")
def _(t):
    d = t.documents.select("doc_id", F.size(F.split("text", " ")).alias("n"))
    return d.select("doc_id", L(c("n")).alias("n"), F.md5(F.array_join(G.rel_positions(c("n"), F.lit(3), 30).cast("array<string>"), ",")).alias("pos_id"))


@query("f_segments3", """SELECT doc_id, md5(array_to_string(list_transform(range(0, n), lambda i: CASE WHEN i <= 1 THEN 1 WHEN i < n // 2 THEN 2 ELSE 3 END), '')) AS mask FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)""")
def _(t):
    d = t.documents.select("doc_id", F.size(F.split("text", " ")).alias("n"))
    return d.select("doc_id", F.md5(F.array_join(G.segments3(c("n"), F.lit(1), F.floor(c("n") / 2).cast("int")).cast("array<string>"), "")).alias("mask"))


@query("f_tokens_to_ids", r"""WITH b AS (SELECT w, min(item_id * 100000 + pos) AS p FROM (SELECT item_id, unnest(a) AS w, generate_subscripts(a, 1) AS pos FROM (SELECT item_id, string_split(text, ' ') AS a FROM benchmark)) GROUP BY 1),
 v AS (SELECT w, row_number() OVER (ORDER BY p, w) + 8 AS id FROM b), d AS (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, ' ') AS a FROM documents))
SELECT doc_id, CAST(pos AS BIGINT) AS pos, coalesce(id, 1) AS id FROM d LEFT JOIN v USING (w)""")
def _(t):
    words = t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    tokens = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    return P.tokens_to_ids(tokens, A.vocab(words, ["item_id", "pos"])).select("doc_id", L(c("pos")).alias("pos"), L(c("id")).alias("id"))


@query("f_tokenize_basic", r"""WITH w AS (SELECT doc_id, strip_accents(lower(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\p{Cf}]|\x{FFFD}', '', 'g'), '([\p{Han}\p{P}$+<=>^`|~])', ' \1 ', 'g'))) AS s FROM documents),
 t AS (SELECT doc_id, list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') AS t FROM w)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_n, md5(coalesce(array_to_string(t, ' '), '')) AS tokens_md5 FROM t""")
def _(t):
    toks = t.documents.select("doc_id", P.tokenize_basic(c("text")).alias("t"))
    return toks.select("doc_id", F.size("t").alias("n"), F.array_distinct("t").alias("u"), F.md5(F.array_join("t", " ")).alias("tokens_md5")).select("doc_id", "n", F.size("u").alias("distinct_n"), "tokens_md5")


@query("f_word_pairs", f"""WITH {TAGS}, s AS (SELECT doc_id, pos FROM tags WHERE tag = 'I-LONG')
SELECT doc_id, CAST(pos + k AS BIGINT) AS i, CAST(pos + k + 1 AS BIGINT) AS j, 'NNW' AS label FROM s, (VALUES (0), (1)) v(k) UNION ALL SELECT doc_id, CAST(pos + 2 AS BIGINT), CAST(pos AS BIGINT), 'THW-LONG' FROM s""")
def _(t):
    at = F.filter(F.transform("tags", lambda x, i: F.when(x == "I-LONG", i)), lambda i: i.isNotNull())
    spans = F.transform(at, lambda i: F.struct(F.array(i, i + 1, i + 2).alias("index"), F.lit("LONG").alias("type")))
    return _tags(t).select("doc_id", F.explode(G.word_pairs(spans)).alias("p")).select("doc_id", L(c("p.i")).alias("i"), L(c("p.j")).alias("j"), "p.label")


@query("f_distance_bucket", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN d = 0 THEN 19 WHEN d < 0 THEN least(floor(log2(-d)) + 1, 9) + 9 ELSE least(floor(log2(d)) + 1, 9) END AS INTEGER) AS bucket FROM
 (SELECT *, CAST(l_quantity AS INTEGER) * 8 - 150 AS d FROM lineitem)""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", G.distance_bucket(c("l_quantity").cast("int") * 8 - 150).alias("bucket"))


@query("f_enumerate_spans", """WITH d AS (SELECT conv_id, turn, string_split(text, ' ') AS tk FROM conversations), s AS (SELECT conv_id, turn, st, st + k AS en FROM (SELECT conv_id, turn, len(tk) AS n, unnest(range(0, len(tk))) AS st FROM d), (VALUES (0), (1), (2)) v(k) WHERE st + k < n)
SELECT conv_id, turn, CAST(st AS BIGINT) AS start, CAST(en AS BIGINT) AS "end", CASE WHEN length(tk[st + 1]) > 8 AND en = st + 1 THEN 'LONG' ELSE '0' END AS label FROM s JOIN d USING (conv_id, turn)""")
def _(t):
    d = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("tk"))
    spans = d.select("conv_id", "turn", F.explode(G.spans_up_to(F.size("tk"), 3)).alias("s")).select("conv_id", "turn", L(c("s.start")).alias("start"), L(c("s.end")).alias("end"))
    gold = d.select("conv_id", "turn", F.size("tk").alias("n"), F.posexplode("tk").alias("p", "w")).where("length(w) > 8 and p + 1 < n").select(
        "conv_id", "turn", L(c("p")).alias("start"), L(c("p") + 1).alias("end"), F.lit("LONG").alias("label"))
    return spans.join(gold, ["conv_id", "turn", "start", "end"], "left").withColumn("label", F.coalesce("label", F.lit("0")))


@query("f_format_attr", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat(p_name, '; ', p_brand) WHEN 1 THEN concat('best: ', p_type, '; worst (n: ', p_brand, ')') WHEN 2 THEN p_name ELSE '' END AS value,
 concat(p_name, ': ', p_type, ' (用途: ', p_brand, ')') AS ops FROM part""")
def _(t):
    q = lambda col: F.concat(F.lit('"'), col, F.lit('"'))
    listed = F.concat(F.lit("["), q(c("p_name")), F.lit(", "), q(c("p_brand")), F.lit("]"))
    mapped = F.concat(F.lit('{"best": '), q(c("p_type")), F.lit(', "worst": {"n": '), q(c("p_brand")), F.lit("}}"))
    value = F.when(c("p_size") % 4 == 0, listed).when(c("p_size") % 4 == 1, mapped).when(c("p_size") % 4 == 2, q(c("p_name"))).otherwise("[]")
    ops = F.concat(F.lit('[{"name": '), q(c("p_name")), F.lit(', "description": '), q(c("p_type")), F.lit(', "typical_usage": '), q(c("p_brand")), F.lit("}]"))
    return t.part.select("p_partkey", P.format_attr(value).alias("value"), P.format_attr(ops, True).alias("ops"))


@query("f_truncate", "SELECT doc_id, substr(text, 1, 300) AS head FROM documents")
def _(t):
    return t.documents.select("doc_id", F.substring("text", 1, 300).alias("head"))


def _ans(t):
    return F.concat(F.lit("("), "s_name", F.lit(", uses ,part"), c("s_suppkey").cast("string"), F.lit(")x(a,b)(open,"), "s_name", F.lit(",end"))


@query("f_parse_triples", """SELECT s_suppkey, s_name AS head, 'uses' AS relation, concat('part', s_suppkey) AS tail FROM supplier UNION ALL SELECT s_suppkey, 'open', s_name, 'end' FROM supplier""")
def _(t):
    return t.supplier.select("s_suppkey", F.explode(P.parse_triples(_ans(t))).alias("x")).select("s_suppkey", "x.*")


@query("f_parse_templates", """SELECT s_suppkey, 'zh' AS lang, s_name AS head, '使用' AS relation, concat('a,b', s_suppkey) AS tail FROM supplier UNION ALL SELECT s_suppkey, 'en', s_name, 'uses', concat('p', s_suppkey) FROM supplier""")
def _(t):
    key = c("s_suppkey").cast("string")
    zh = F.concat(F.lit("头实体是"), "s_name", F.lit(",关系是使用,尾实体是a,b"), key, F.lit("\n头实体是x,关系是NAN\nNAN"))
    en = F.concat(F.lit("head entity is "), "s_name", F.lit(", relation is uses, tail entity is p"), key, F.lit("\nnothing"))
    both = [(zh, "zh", ("头实体是", "关系是", "尾实体是")), (en, "en", ("head entity is", "relation is", "tail entity is"))]
    out = None
    for text, lang, marks in both:
        one = t.supplier.select("s_suppkey", F.lit(lang).alias("lang"), F.explode(P.parse_listed(text, *marks)).alias("x")).select("s_suppkey", "lang", "x.*")
        out = one if out is None else out.unionByName(one)
    return out


@query("f_parse_entity_json", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat(p_name, '|', p_brand) WHEN 1 THEN p_name WHEN 2 THEN concat(p_type, '|', p_name) ELSE '' END AS names FROM part""")
def _(t):
    q = lambda col: F.concat(F.lit('"'), col, F.lit('"'))
    s = c("p_size") % 4
    text = (F.when(s == 0, F.concat(F.lit('{"named_entities": ['), q(c("p_name")), F.lit(", "), q(F.concat(c("p_brand"), F.lit(" "))), F.lit("]}")))
            .when(s == 1, F.concat(F.lit("["), q(c("p_name")), F.lit("]"))).when(s == 2, F.concat(F.lit("I found ["), q(c("p_type")), F.lit(", "), q(c("p_name")), F.lit("] there"))).otherwise('{"x": 1}'))
    return t.part.select("p_partkey", F.array_join(P.parse_entity_json(text), "|").alias("names"))


@query("f_parse_malformed", """SELECT p_partkey, CAST(p_size % 5 IN (0, 1) AS INTEGER) AS malformed FROM part""")
def _(t):
    s, fine = c("p_size") % 5, F.concat(F.lit('{"names": ["'), c("p_name"), F.lit('"]}'))
    answer = F.when(s == 0, F.lit('{"broken": [')).when(s == 1, F.concat(F.lit('["'), c("p_name"), F.lit('"]'))).when(s == 2, F.lit("{}")).otherwise(fine)
    return t.part.select("p_partkey", P.malformed(answer).cast("int").alias("malformed"))


@query("f_parse_ie_json", """SELECT p_partkey, 'NER' AS task, p_type AS a, p_name AS b, NULL AS c, NULL AS d FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, 'NER', p_type, p_brand, NULL, NULL FROM part WHERE p_size % 5 <> 0
 UNION ALL SELECT p_partkey, 'RE', 'uses', p_name, p_brand, NULL FROM part WHERE p_size % 5 <> 0
 UNION ALL SELECT p_partkey, 'EE', p_type, p_name, 'buyer', p_brand FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, 'EE', p_type, p_name, 'place', 'here' FROM part WHERE p_size % 5 <> 0
 UNION ALL SELECT p_partkey, 'EET', p_type, p_name, NULL, NULL FROM part WHERE p_size % 5 <> 0
 UNION ALL SELECT p_partkey, 'KG', p_type, p_name, 'maker', p_brand FROM part WHERE p_size % 5 <> 0""")
def _(t):
    q = lambda col: F.concat(F.lit('"'), col, F.lit('"'))
    def doc(*parts):
        whole = F.concat(*[F.lit(p) if isinstance(p, str) else q(p) for p in parts])
        return t.part.select("p_partkey", F.when(c("p_size") % 5 == 0, F.lit('{"broken": [')).otherwise(whole).alias("answer"))
    ty, nm, br = c("p_type"), c("p_name"), c("p_brand")
    ner = P.parse_ie_json(doc("{", ty, ": [", nm, ", 5, ", br, '], "bad": 3}'), "answer", "NER", ["p_partkey"])
    rel = P.parse_ie_json(doc('{"uses": [{"subject": ', nm, ', "object": ', br, '}, "x", {"subject": ', nm, "}]}"), "answer", "RE", ["p_partkey"])
    event = ("{", ty, ': [{"trigger": ', nm, ', "arguments": {"buyer": ', br, ', "place": ["here", "NAN"], "time": "NAN"}}]}')
    ee = P.parse_ie_json(doc(*event), "answer", "EE", ["p_partkey"])
    eet = P.parse_ie_json(doc(*event), "answer", "EET", ["p_partkey"])
    kg_ = P.parse_ie_json(doc("{", ty, ": {", nm, ': {"maker": ', br, ', "none": "nan", "n": ["无"]}}}'), "answer", "KG", ["p_partkey"])
    none = F.lit(None).cast("string")
    row = lambda df, task, *cols: df.select("p_partkey", F.lit(task).alias("task"), *[(c(x) if x else none).alias(n) for x, n in zip(cols, "abcd")])
    return (row(ner, "NER", "type", "entity", None, None).unionByName(row(rel, "RE", "relation", "head", "tail", None)).unionByName(row(ee, "EE", "type", "trigger", "role", "argument"))
            .unionByName(row(eet, "EET", "type", "trigger", None, None)).unionByName(row(kg_, "KG", "type", "entity", "attribute", "value")))


@query("f_parse_generated", """SELECT p_partkey, 'made_by' AS relation, concat('The ', p_name, ' of ', p_brand, ' is ', p_type) AS text, p_name AS subj, CAST(4 AS INTEGER) AS subj_start, CAST(4 + length(p_name) AS INTEGER) AS subj_end, 'PRODUCT' AS subj_type,
 p_brand AS obj, CAST(8 + length(p_name) AS INTEGER) AS obj_start, CAST(8 + length(p_name) + length(p_brand) AS INTEGER) AS obj_end, 'ORGANIZATION' AS obj_type FROM part WHERE p_type <> 'PROMO'""")
def _(t):
    line = F.concat(F.lit("1. Relation: made_by. Context: The "), "p_name", F.lit(" of "), "p_brand", F.lit(" is "), "p_type", F.lit(" Head Entity: "), F.upper("p_name"),
                    F.lit(". Head Type: "), F.when(c("p_type") == "PROMO", "ALIEN").otherwise("PRODUCT"), F.lit(". Tail Entity: "), "p_brand", F.lit(". Tail Type: ORGANIZATION."))
    return t.part.select("p_partkey", P.parse_generated(line, ["PRODUCT", "ORGANIZATION"]).alias("g")).where("g is not null").select("p_partkey", "g.*")


@query("f_fix_unk", r"""WITH d AS (SELECT doc_id, text, split_part(regexp_extract(text, ' ([a-zà-ÿ]{5,}) ', 0), ' ', 2) AS w FROM documents)
SELECT doc_id, CASE WHEN m = '' THEN concat(left(w, 2), '<unk>', right(w, 2)) ELSE m END AS fixed FROM (SELECT doc_id, w, regexp_extract(text, concat(left(w, 2), '\s*\S+\s*', right(w, 2)), 0) AS m FROM d WHERE w <> '')""")
def _(t):
    # a word of each text loses its middle and is found again in the whole text
    word = F.split_part(F.regexp_extract("text", r" ([a-zà-ÿ]{5,}) ", 0), F.lit(" "), F.lit(2))
    d = t.documents.select("doc_id", "text", word.alias("w")).where("w <> ''")
    hole = F.concat(F.left("w", F.lit(2)), F.lit("<unk>"), F.right("w", F.lit(2)))
    return d.select("doc_id", P.fix_unk(hole, c("text")).alias("fixed"))


WORD_EDGE = r"[^\p{L}\p{M}\p{N}_]"


def sql_word(text: str, words: str, new: str) -> str:
    """Whole words replaced; twice, because neighbours share the character between them."""
    one = f"regexp_replace({text}, '(^|{WORD_EDGE})({words})($|{WORD_EDGE})', '\\1{new}\\3', 'g')"
    return f"regexp_replace({one}, '(^|{WORD_EDGE})({words})($|{WORD_EDGE})', '\\1{new}\\3', 'g')"


BARE = r"""regexp_replace(lower(text), '[!"#$%&()*+,\-./:;<=>?@\[\]\\^`{|}~_'']', ' ', 'g')"""


@query("f_norm_answer", f"""SELECT doc_id, md5(trim(regexp_replace({sql_word(BARE, 'a|an|the', ' ')}, '\\s+', ' ', 'g'))) AS answer FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(P.norm_answer(c("text"))).alias("answer"))


@query("f_label_words", """SELECT p_partkey, replace(replace(translate(split_part(lower(concat('per:', p_type, '_of_org(', p_brand, ')')), '(', 1), ':_', '  '), 'per', 'person'), 'org', 'organization') AS words FROM part""")
def _(t):
    return t.part.select("p_partkey", P.label_words(F.concat(F.lit("per:"), "p_type", F.lit("_of_org("), "p_brand", F.lit(")"))).alias("words"))


@query("f_ptb_tokens", """SELECT p_partkey, concat('( ', p_name, ' ) [ ', p_brand, ' ]') AS text FROM part""")
def _(t):
    toks = F.split(F.concat(F.lit("-LRB- "), "p_name", F.lit(" -RRB- -lsb- "), "p_brand", F.lit(" -rsb-")), " ")
    return t.part.select("p_partkey", F.array_join(P.ptb_tokens(toks), " ").alias("text"))


@query("f_wordpiece_join", "SELECT p_partkey, concat(replace(p_name, ' ', ''), ' ', p_brand) AS text FROM part")
def _(t):
    pieces = F.concat(F.split(F.replace("p_name", F.lit(" "), F.lit(" ##")), " "), F.array("p_brand"))
    return t.part.select("p_partkey", P.wordpiece_join(pieces).alias("text"))


@query("f_stable_id", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@query("f_schema_key", """SELECT p_partkey, concat(p_brand, '_made_by_', p_type) AS key, p_brand AS head_type, 'made_by' AS relation, p_type AS tail_type FROM part""")
def _(t):
    key = P.schema_key(c("p_brand"), F.lit("made_by"), c("p_type"))
    return t.part.select("p_partkey", key.alias("key"), P.schema_parts(key).alias("p")).select("p_partkey", "key", "p.*")


@query("f_cosine", """WITH q AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS cosine FROM embeddings JOIN q USING (label)""")
def _(t):
    q = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return t.embeddings.join(q, "label").select("vec_id", F.round(S.cosine(c("embedding"), c("q")), 6).alias("cosine"))


@query("f_dialog_rename", f"""SELECT conv_id, turn, concat('[unused1] : ', replace({sql_word('lower(text)', 'im', 'i')}, '...', '.'), ' [unused2] : yes') AS text, '[unused1]' AS x, '[unused2]' AS y FROM conversations""")
def _(t):
    d = F.concat(F.lit("speaker 1: "), F.lower("text"), F.lit(" speaker 2: yes"))
    return t.conversations.select("conv_id", "turn", P.dialog_rename(d, F.lit("speaker 1"), F.lit("speaker 2")).alias("r")).select("conv_id", "turn", "r.*")
