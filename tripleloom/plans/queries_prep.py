"""Training-set preparation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.functions import answers as N
from tripleloom.operators import joins as J
from tripleloom.operators import prep as P
from tripleloom.plans.registry import dealt, query

c = F.col
L = lambda x: x.cast("long")
D = "substr(md5(concat('{0}|', {1})), 1, 8)"


def sql_split(order: str, table: str, key: str, a: str, sa: float, b: str, sb: float, rest: str) -> str:
    return f"""SELECT {key}, CASE WHEN r <= floor(n * {sa} + 1e-9) THEN '{a}' WHEN r <= floor(n * {sa} + 1e-9) + floor(n * {sb} + 1e-9) THEN '{b}' ELSE '{rest}' END AS part
 FROM (SELECT {key}, row_number() OVER (ORDER BY {order}, {key}) AS r, CAST(count(*) OVER () AS DOUBLE) AS n FROM {table})"""


@query("p_split_random", sql_split(D.format(42, "o_orderkey"), "orders", "o_orderkey", "train", 0.7, "test", 0.2, "valid"))
def _(t):
    return P.split_random(t.orders.select("o_orderkey"), "o_orderkey")


@query("p_split_ordered", sql_split("doc_id", "documents", "doc_id", "train", 0.8, "valid", 0.1, "test"))
def _(t):
    return P.split_ordered(t.documents.select("doc_id"), ["doc_id"])


@query("p_shuffle", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    return P.shuffle(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 7)


@query("p_balance", f"""WITH x AS (SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY {D.format(42, 'event_id')}, event_id) AS r FROM events),
 k AS (SELECT *, CASE WHEN n >= 2010 THEN CAST(r <= 2010 AS INTEGER) ELSE 2010 // n + CAST(r <= 2010 % n AS INTEGER) END AS copies FROM x)
SELECT event_type, event_id, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM k WHERE copies > 0""")
def _(t):
    return P.balance(t.events.select("event_type", "event_id"), "event_type", "event_id", 2010).select("event_type", "event_id", "copy")


SCHEMA = ["T0", "T1", "T2", "T3", "T4", "T5"]
ALL = "['T0', 'T1', 'T2', 'T3', 'T4', 'T5']"
REC = r"""rec AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '[A-Z]\p{L}{3,}')) AS ws FROM documents),
 r AS (SELECT doc_id, text, list_filter(list_transform(ws, lambda w: concat('T', length(w) % 4)), lambda x: true) AS ty, list_sort(list_distinct(list_transform(ws, lambda w: concat('T', length(w) % 4)))) AS pos FROM rec),
 a AS (SELECT doc_id, text, pos, list_filter(['T0', 'T1', 'T2', 'T3', 'T4', 'T5'], lambda x: NOT list_contains(pos, x)) AS neg FROM r)"""


def _words(t):
    ws = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z]\p{L}{3,}"), F.lit(0)))
    return dealt(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "text", ws.alias("ws"))


def _type(w):
    return F.concat(F.lit("T"), (F.length(w) % 4).cast("string"))


def _positive(t):
    return _words(t).select("doc_id", "text", F.array_sort(F.array_distinct(F.transform("ws", _type))).alias("pos"))


def _joined(df, col, name="types"):
    return df.select("doc_id", F.array_join(col, "|").alias(name))


@query("p_neg_all", f"WITH {REC} SELECT doc_id, array_to_string(neg, '|') AS types FROM a")
def _(t):
    return _joined(_positive(t), P.neg_all(c("pos"), SCHEMA))


DRAWN = D.format(5, "doc_id, '|', x")


@query("p_neg_sample", f"""WITH {REC}, s AS (SELECT doc_id, pos, list_filter(neg, lambda x: {DRAWN} < '40000000') AS picked, list_transform(list_sort(list_transform(neg, lambda x: concat({DRAWN}, x))), lambda y: substr(y, 9)) AS ord FROM a)
SELECT doc_id, array_to_string(list_sort(list_concat(CASE WHEN len(pos) = 0 AND len(picked) = 0 THEN ord[1:1] ELSE picked END, pos)), '|') AS types FROM s""")
def _(t):
    return _joined(_positive(t), P.neg_sample(c("pos"), SCHEMA, 0.25, 5, "doc_id"))


@query("p_neg_hard", f"""WITH {REC}, h AS (SELECT doc_id, list_distinct(list_concat(pos, CASE WHEN list_contains(pos, 'T0') THEN ['T4'] ELSE [] END, CASE WHEN list_contains(pos, 'T1') THEN ['T0', 'T5'] ELSE [] END)) AS ch FROM a),
 o AS (SELECT doc_id, ch, list_transform(list_sort(list_transform(list_filter({ALL}, lambda x: NOT list_contains(ch, x)), lambda x: concat({DRAWN}, x))), lambda y: substr(y, 9)) AS ord FROM h)
SELECT doc_id, array_to_string(list_sort(list_concat(ch, ord[1:2])), '|') AS types FROM o""")
def _(t):
    return _joined(_positive(t), P.neg_hard(c("pos"), SCHEMA, {"T0": ["T4"], "T1": ["T0", "T5"]}, 2, 5, "doc_id"))


@query("p_neg_prompt", f"""WITH {REC}, o AS (SELECT doc_id, list_filter(pos, lambda x: {D.format(5, "doc_id, '|', x")} < '80000000') AS kept, list_transform(list_sort(list_transform(neg, lambda x: concat({D.format(6, "doc_id, '|', x")}, x))), lambda y: substr(y, 9)) AS ord FROM a)
SELECT doc_id, array_to_string(list_sort(list_concat(kept, ord[1:2])), '|') AS types FROM o""")
def _(t):
    return _joined(_positive(t), P.neg_prompt(c("pos"), SCHEMA, 0.5, 2, 5, "doc_id"))


@query("p_neg_cap", f"""SELECT user_id, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {D.format(9, 'event_id')}, event_id) AS rn
 FROM events WHERE event_type <> 'error') WHERE rn <= 5""")
def _(t):
    return P.neg_cap(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", c("event_type") != "error", 5, 9).drop("event_type")


@query("p_neg_relation_rows", f"""WITH {REC}, o AS (SELECT doc_id, pos, list_transform(list_sort(list_transform(neg, lambda x: concat({DRAWN}, x))), lambda y: substr(y, 9)) AS ord FROM a)
SELECT doc_id, unnest(pos) AS relation, 1 AS is_positive FROM o UNION ALL SELECT doc_id, unnest(ord[1:2]), 0 FROM o""")
def _(t):
    return P.neg_relation_rows(_positive(t).drop("text"), "pos", SCHEMA, 2, 5, "doc_id")


@query("p_schema_chunks", f"""WITH {REC}, w AS (SELECT doc_id, ws, len(ws) AS n FROM rec WHERE len(ws) > 0), z AS (SELECT doc_id, n, greatest(n // 4, 1) AS whole, n - greatest(n // 4, 1) * 4 AS rest FROM w),
 y AS (SELECT *, CASE WHEN n < 4 THEN 1 WHEN rest >= 2 THEN whole + 1 ELSE whole END AS k FROM z), u AS (SELECT *, unnest(range(0, k)) AS i FROM y)
SELECT doc_id, CAST(i AS BIGINT) AS i, CAST(CASE WHEN n < 4 THEN n WHEN i < whole - 1 THEN 4 WHEN i = whole - 1 AND rest < 2 THEN 4 + rest WHEN i = whole - 1 THEN 4 ELSE rest END AS BIGINT) AS n FROM u""")
def _(t):
    w = _words(t).where(F.size("ws") > 0).select("doc_id", F.posexplode(N.schema_chunks(c("ws"), 4)).alias("i", "x"))
    return w.select("doc_id", L(c("i")).alias("i"), L(F.size("x")).alias("n"))


def _ents(t):
    return _words(t).select("doc_id", "text", F.transform("ws", lambda w: F.struct(w.alias("entity"), _type(w).alias("entity_type"))).alias("labels"))


@query("p_instructions", """WITH k AS (SELECT doc_id, text, unnest([['T0', 'T1', 'T2', 'T3'], ['T4', 'T5']]) AS s FROM documents)
SELECT doc_id, sha256(text) AS id, md5(concat('{"instruction":"Extract the entities of the schema.","schema":', to_json(s), ',"input":', to_json(text), '}')) AS instruction FROM k""")
def _(t):
    chunks = t.documents.select("doc_id", "text", F.explode(N.schema_chunks(F.array(*[F.lit(s) for s in SCHEMA]), 4)).alias("s"))
    return chunks.select("doc_id", F.sha2("text", 256).alias("id"), F.md5(N.instruction("Extract the entities of the schema.", c("s"), c("text"))).alias("instruction"))


@query("p_answers", r"""WITH w AS (SELECT doc_id, text, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, text, list_distinct_order AS ws FROM (SELECT doc_id, text, list_filter(regexp_extract_all(text, '[A-Z]\p{L}{3,}'), lambda x, j: list_position(regexp_extract_all(text, '[A-Z]\p{L}{3,}'), x) = j) AS list_distinct_order FROM documents))),
 g AS (SELECT doc_id, concat('T', length(w) % 4) AS ty, concat('[', string_agg(to_json(w)::VARCHAR, ',' ORDER BY strpos(text, w), i), ']') AS v FROM w GROUP BY 1, 2)
SELECT d.doc_id, md5(concat('{', string_agg(concat('"', ty_.ty, '":', coalesce(v, '[]')), ',' ORDER BY ty_.ty), '}')) AS answer FROM documents d CROSS JOIN (SELECT unnest(['T0', 'T1', 'T2', 'T3', 'T4', 'T5']) AS ty) ty_ LEFT JOIN g ON g.doc_id = d.doc_id AND g.ty = ty_.ty GROUP BY 1""")
def _(t):
    return _ents(t).select("doc_id", F.md5(N.ner_answer(c("text"), c("labels"), SCHEMA)).alias("answer"))


def _relations(t):
    """Relations between neighbouring names of a text."""
    rel = F.transform(F.slice("ws", F.lit(2), F.size("ws")), lambda w, i: F.struct(F.get(c("ws"), i).alias("head"), F.concat(F.lit("R"), (F.length(w) % 3).cast("string")).alias("relation"), w.alias("tail"),
                      _type(F.get(c("ws"), i)).alias("head_type"), _type(w).alias("tail_type")))
    ws = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z]\p{L}{3,}"), F.lit(0)))
    conv = t.conversations.select((c("conv_id") * 100 + c("turn")).alias("doc_id"), "text", ws.alias("ws"))
    return conv.select("doc_id", "text", "ws", rel.alias("rels"))


def _listed(name: str, item: str, where: str = "true") -> str:
    """A JSON field whose list holds ``item`` of every relation that fits, as SQL."""
    return f"""'"{name}":[', coalesce(string_agg({item}, ',' ORDER BY place, i) FILTER (WHERE i IS NOT NULL AND {where}), ''), ']'"""


def _object(*fields: str) -> str:
    return "concat('{', " + ", ',', ".join(fields) + ", '}')"


_ARGS = """CASE relation WHEN 'R0' THEN concat('{"tail":', to_json(tail), ',"place":"NAN"}') WHEN 'R1' THEN concat('{"tail":', to_json(tail), '}') ELSE '{}' END"""
_PAIR = """concat('{"head":', to_json(head), ',"tail":', to_json(tail), '}')"""
_EVENT = f"""concat('{{"trigger":', to_json(head), ',"arguments":', {_ARGS}, '}}')"""
_UNNAMED = f"""concat('{{"arguments":', {_ARGS}, '}}')"""
_THREE = [(r, f"relation = '{r}'") for r in ("R0", "R1", "R2")]


def _known(name: str, relations: list[str]) -> str:
    """A JSON field with an object for every head: its tail by relation, as SQL."""
    cases = " ".join(f"""WHEN '{r}' THEN concat('{{"{r}":', to_json(tail), '}}')""" for r in relations)
    return f"""'"{name}":{{', coalesce(string_agg(concat(to_json(head), ':', CASE relation {cases} ELSE '{{}}' END), ',' ORDER BY place, i) FILTER (WHERE i IS NOT NULL), ''), '}}'"""


@query("p_answers_tasks", rf"""WITH a AS (SELECT conv_id * 100 + turn AS doc_id, text, regexp_extract_all(text, '[A-Z]\p{{L}}{{3,}}') AS a FROM conversations),
 w AS (SELECT doc_id, text, list_filter(a, lambda x, j: list_position(a, x) = j) AS ws FROM a),
 rel AS (SELECT doc_id AS id, i, ws[i] AS head, ws[i + 1] AS tail, strpos(text, ws[i]) AS place, concat('R', length(ws[i + 1]) % 3) AS relation, concat('T', length(ws[i]) % 4) AS ht, concat('T', length(ws[i + 1]) % 4) AS tt
  FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM w))
SELECT doc_id, {_object(*[_listed(r, _PAIR, cond) for r, cond in _THREE])} AS re,
 {_object(_listed('T0_R0_T1', _PAIR, "relation = 'R0' AND ht = 'T0' AND tt = 'T1'"), _listed('T1_R1_T2', _PAIR, "relation = 'R1' AND ht = 'T1' AND tt = 'T2'"))} AS spo,
 {_object(*[_listed(r, _EVENT, cond) for r, cond in _THREE])} AS ee,
 {_object(*[_listed(r, _UNNAMED, f"{cond} AND relation <> 'R2'") for r, cond in _THREE])} AS ee_no_trigger,
 {_object(*[_listed(r, _EVENT, cond) for r, cond in _THREE])} AS eea, {_object(*[_listed(r, 'to_json(head)', cond) for r, cond in _THREE])} AS eet,
 {_object(_known('X', ['R0', 'R1']), _known('Y', ['R2']))} AS kg FROM w LEFT JOIN rel ON id = doc_id GROUP BY doc_id""")
def _(t):
    df = _relations(t)
    ev = F.transform("rels", lambda r: F.struct(r["relation"].alias("event_type"), r["head"].alias("trigger"), F.array(F.struct(F.lit("tail").alias("role"), r["tail"].alias("argument"))).alias("arguments")))
    roles = [("R0", ["tail", "place"]), ("R1", ["tail"]), ("R2", ["place"])]
    out = df.select("doc_id", N.re_answer(c("text"), c("rels"), ["R0", "R1", "R2"]).alias("re"), N.spo_answer(c("text"), c("rels"), [("T0", "R0", "T1"), ("T1", "R1", "T2")]).alias("spo"),
                    N.ee_answer(c("text"), ev, roles).alias("ee"), N.ee_answer(c("text"), ev, roles, trigger=False).alias("ee_no_trigger"), N.eea_answer(c("text"), ev, roles).alias("eea"),
                    N.eet_answer(c("text"), ev, ["R0", "R1", "R2"]).alias("eet"), N.kg_answer(c("text"), c("rels"), [("X", ["R0", "R1"]), ("Y", ["R2"])]).alias("kg"))
    return out


@query("p_record_text", """SELECT p_partkey, concat('<extra_id_0> <extra_id_0> ', p_type, ' <extra_id_5> ', p_name, ' <extra_id_0> brand <extra_id_5> ', p_brand, ' <extra_id_1> <extra_id_1> <extra_id_1>') AS label_first,
 concat('<extra_id_0> <extra_id_0> ', p_name, ' <extra_id_5> ', p_type, ' <extra_id_0> ', p_brand, ' <extra_id_5> brand <extra_id_1> <extra_id_1> <extra_id_1>') AS span_first FROM part""")
def _(t):
    rec = F.array(F.struct(c("p_type").alias("label"), c("p_name").alias("span"), F.array(F.struct(F.lit("brand").alias("label"), c("p_brand").alias("span"))).alias("asocs")))
    return t.part.select("p_partkey", N.record_text(rec).alias("label_first"), N.record_text(rec, True).alias("span_first"))


@query("p_schema_prefix", """SELECT p_brand, concat((SELECT string_agg(concat('<spot> ', x), ' ' ORDER BY x) FROM (SELECT DISTINCT p_type AS x FROM part b WHERE b.p_brand = a.p_brand)), ' ', (SELECT string_agg(concat('<asoc> ', x), ' ' ORDER BY x) FROM
 (SELECT DISTINCT p_name AS x FROM part b WHERE b.p_brand = a.p_brand)), ' <extra_id_2> ') AS prefix FROM (SELECT DISTINCT p_brand FROM part) a""")
def _(t):
    schema = t.part.groupBy("p_brand").agg(F.collect_set("p_type").alias("types"), F.collect_set("p_name").alias("roles"))
    return schema.select("p_brand", N.schema_prefix(c("types"), c("roles")).alias("prefix"))


@query("p_type_sort", rf"""WITH w AS (SELECT conv_id * 100 + turn AS doc_id, text, regexp_extract_all(text, '[A-Z]\p{{L}}{{3,}}') AS a FROM conversations),
 u AS (SELECT doc_id, text, list_filter(a, lambda x, j: list_position(a, x) = j) AS ws FROM w),
 r AS (SELECT doc_id, text, ws[k] AS head, ws[k + 1] AS tail, concat('R', length(ws[k + 1]) % 3) AS relation FROM (SELECT doc_id, text, ws, unnest(range(1, len(ws))) AS k FROM u WHERE len(ws) >= 2))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {D.format(3, "relation")}, strpos(text, head), strpos(text, tail), head, relation, tail) - 1 AS INTEGER) AS i, head, relation, tail FROM r""")
def _(t):
    df = _relations(t).select("doc_id", P.type_sort(c("rels"), c("text"), 3).alias("s"))
    return df.select("doc_id", F.posexplode("s").alias("i", "x")).select("doc_id", "i", "x.head", "x.relation", "x.tail")


@query("p_weak_bio", """SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: CASE w WHEN 'de' THEN 'B-PREP' WHEN 'la' THEN 'B-ART' WHEN 'the' THEN 'B-ART' ELSE 'O' END), ' ')) AS tags FROM documents""")
def _(t):
    tags = P.weak_tags(F.split("text", " "), {"de": "PREP", "la": "ART", "the": "ART"})
    return t.documents.select("doc_id", F.md5(F.array_join(tags, " ")).alias("tags"))


EV = """w AS (SELECT conv_id, turn, string_split(text, ' ') AS tk FROM conversations), e AS (SELECT conv_id, turn, len(tk) AS n, unnest(CASE WHEN len(list_filter(range(0, len(tk)), lambda i: length(tk[i + 1]) >= 12)) = 0 THEN [NULL] ELSE list_filter(range(0, len(tk)), lambda i: length(tk[i + 1]) >= 12) END) AS i FROM w)"""


def _events(t):
    d = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("tk"))
    at = F.filter(F.transform("tk", lambda w, i: F.when(F.length(w) >= 12, i)), lambda i: i.isNotNull())
    d = d.select("conv_id", "turn", F.size("tk").alias("n"), at.alias("at"))
    event = lambda i: F.struct(F.lit("LONG").alias("type"), i.alias("start"), (i + 1).alias("end"), F.array(F.struct((i + 1).alias("start"), (i + 2).alias("end"), F.lit("next").alias("role"))).alias("arguments"))
    return d.select("conv_id", "turn", "n", F.transform("at", event).alias("events"))


@query("p_event_tsv", f"""WITH {EV} SELECT conv_id, turn, array_to_string(list_transform(range(0, n), lambda j: CASE WHEN j = i THEN 'B-LONG' ELSE 'O' END), ' ') AS trigger_tags,
 array_to_string(list_transform(range(0, n), lambda j: CASE WHEN j = i + 1 THEN 'B-next' ELSE 'O' END), ' ') AS role_tags FROM e""")
def _(t):
    out = P.event_rows(_events(t), "n", "events")
    return out.select("conv_id", "turn", F.array_join("trigger_tags", " ").alias("trigger_tags"), F.array_join("role_tags", " ").alias("role_tags"))


@query("p_pred_trigger", f"""WITH {EV}, x AS (SELECT conv_id, turn, len(tk) AS n, unnest(list_filter(range(0, len(tk)), lambda i: length(tk[i + 1]) = 11)) AS i FROM w)
SELECT conv_id * 100 + turn AS line, 0 AS extra, array_to_string(list_transform(range(0, n), lambda j: CASE WHEN j = i THEN 'B-LONG' ELSE 'O' END), ' ') AS tags FROM e
UNION ALL SELECT conv_id * 100 + turn, 1, array_to_string(list_transform(range(0, n), lambda j: CASE WHEN j = i THEN 'B-LONG' ELSE 'O' END), ' ') FROM x""")
def _(t):
    key = (c("conv_id") * 100 + c("turn")).alias("line")
    gold = P.event_rows(_events(t), "n", "events").select(key, c("trigger_tags").alias("tags"))
    pred = t.conversations.select(key, F.transform(F.split("text", " "), lambda w: F.when(F.length(w) >= 11, "B-LONG").otherwise("O")).alias("tags"))
    out = P.pred_triggers(gold, pred, "line")
    return out.select("line", "extra", F.array_join("tags", " ").alias("tags"))


@query("p_overlap_entities", """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS tk FROM conversations), p AS (SELECT conv_id, turn, i, i - row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM
  (SELECT conv_id, turn, unnest(list_filter(range(0, len(tk)), lambda i: length(tk[i + 1]) >= 8)) AS i FROM w)),
 r AS (SELECT conv_id, turn, i, (row_number() OVER (PARTITION BY conv_id, turn, g ORDER BY i) - 1) % 2 AS odd FROM p)
SELECT w.conv_id, w.turn, CAST(count(i) FILTER (WHERE odd = 0) AS INTEGER) AS kept, coalesce(string_agg(concat(i, '>', i - 1), ',' ORDER BY i) FILTER (WHERE odd = 1), '') AS moved FROM w LEFT JOIN r ON r.conv_id = w.conv_id AND r.turn = w.turn GROUP BY 1, 2""")
def _(t):
    at = F.transform(F.filter(F.transform(F.split("text", " "), lambda w, i: F.when(F.length(w) >= 8, i)), lambda i: i.isNotNull()), lambda i: F.struct(i.cast("string").alias("id"), i.alias("start"), (i + 2).alias("end")))
    out = t.conversations.select("conv_id", "turn", P.overlap_entities(at).alias("o"))
    return out.select("conv_id", "turn", F.size("o.kept").alias("kept"), F.array_join(F.transform("o.moved", lambda m: F.concat(m["id"], F.lit(">"), m["to"])), ",").alias("moved"))


@query("p_role_list", """SELECT l_orderkey, l_suppkey, l_returnflag, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_partkey")
    return P.role_list(rows, ["l_orderkey"], "l_suppkey", ["l_linenumber", "l_partkey", "l_returnflag"])


@query("p_head_tail", r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '[A-ZÉ]\p{L}+') AS ws FROM documents)
SELECT doc_id, 1 AS found, ws[1] AS head, ws[2] AS tail FROM e WHERE len(ws) >= 2 AND ws[1] <> ws[2] UNION ALL SELECT doc_id, 0, NULL, NULL FROM e WHERE len(ws) < 2 OR ws[1] = ws[2]""")
def _(t):
    ents = F.transform(F.regexp_extract_all("text", F.lit(r"[A-ZÉ]\p{L}+"), F.lit(0)), lambda w, i: F.struct(i.alias("start"), w.alias("text"), F.lit("NAME").alias("type")))
    pairs, rest = P.head_tail(t.documents.select("doc_id", ents.alias("e")), "doc_id", "e")
    none = F.lit(None).cast("string")
    return pairs.select("doc_id", F.lit(1).alias("found"), c("head_text").alias("head"), c("tail_text").alias("tail")).unionByName(
        rest.select("doc_id", F.lit(0).alias("found"), none.alias("head"), none.alias("tail")))


@query("p_resolve_longest", r"""WITH RECURSIVE a AS (SELECT conv_id, turn, text, regexp_extract_all(text, '\p{L}+') AS w FROM conversations),
 b AS (SELECT conv_id, turn, text, list_concat(w, list_transform(w, lambda x: substr(x, 1, 3))) AS v FROM (SELECT * REPLACE (list_filter(w, lambda x, j: list_position(w, x) = j) AS w) FROM a)),
 e AS (SELECT conv_id, turn, x, min(i) AS i, any_value(strpos(text, x) - 1) AS st FROM (SELECT conv_id, turn, text, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM b) GROUP BY 1, 2, 3),
 s AS MATERIALIZED (SELECT conv_id, turn, x, st, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(x) DESC, i) AS r FROM e WHERE length(x) > 1 AND x NOT IN ('dans', 'nicht')),
 f AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(x VARCHAR, st BIGINT)[]) AS k FROM conversations
  UNION ALL SELECT f.conv_id, f.turn, s.r, CASE WHEN s.st >= 0 AND len(list_filter(k, lambda q: q.st >= 0 AND s.st + length(s.x) > q.st AND s.st < q.st + length(q.x))) > 0 THEN k
   ELSE list_append(k, {'x': s.x, 'st': s.st}) END FROM f JOIN s ON s.conv_id = f.conv_id AND s.turn = f.turn AND s.r = f.r + 1)
SELECT conv_id, turn, CAST(len(k) AS INTEGER) AS n, coalesce(array_to_string(list_transform(k, lambda q: q.x), '|'), '') AS longest FROM (SELECT conv_id, turn, arg_max(k, r) AS k FROM f GROUP BY 1, 2)""")
def _(t):
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    cands = F.transform(F.array_union(F.array_distinct(words), F.transform(F.array_distinct(words), lambda w: F.substring(w, 1, 3))), lambda w: F.struct(w.alias("text"), (F.call_function("instr", c("text"), w) - 1).alias("start")))
    out = t.conversations.select("conv_id", "turn", P.resolve_longest(cands, ["dans", "nicht"]).alias("k"))
    return out.select("conv_id", "turn", F.size("k").alias("n"), F.array_join("k.text", "|").alias("longest"))


@query("p_candidates", r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_concat(CASE WHEN contains(text, 'sch') THEN ['sch'] ELSE [] END, regexp_extract_all(text, '(\p{L}+) (?:und|et|and|y) (\p{L}+)', 1), regexp_extract_all(text, '(\p{L}+) (?:und|et|and|y) (\p{L}+)', 2)), lambda x: x <> ''))), '|') AS names FROM conversations""")
def _(t):
    hits = J.synonyms_inside(c("text"), [("sch", ["sch"])])
    out = P.candidates(c("text"), F.array().cast("array<string>"), hits, r"(\p{L}+) (?:und|et|and|y) (\p{L}+)")
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(out)), "|").alias("names"))


@query("p_graph_records", """WITH r AS (SELECT l_orderkey AS id, l_returnflag AS type, CAST(l_suppkey AS VARCHAR) AS spot, l_linestatus AS role, CAST(l_partkey % 100 AS VARCHAR) AS arg FROM lineitem),
 ent AS (SELECT DISTINCT id, spot AS text, type FROM r WHERE type IN ('A', 'N')), known AS (SELECT id, text, max(type) AS t FROM ent GROUP BY 1, 2)
SELECT id, 'entity' AS kind, type, text AS a, NULL AS a_type, NULL AS b, NULL AS b_type FROM ent
UNION ALL SELECT r.id, 'relation', role, spot, type, arg, coalesce(t, type) FROM r LEFT JOIN known k ON k.id = r.id AND k.text = arg WHERE type IN ('A', 'N')
UNION ALL SELECT r.id, 'event', type, spot, NULL, arg, role FROM r LEFT JOIN known k ON k.id = r.id AND k.text = arg WHERE type = 'R' AND (t IS NOT NULL OR r.id NOT IN (SELECT id FROM known))""")
def _(t):
    r = t.lineitem.select(c("l_orderkey").alias("id"), c("l_returnflag").alias("type"), c("l_suppkey").cast("string").alias("spot"), c("l_linestatus").alias("role"), (c("l_partkey") % 100).cast("string").alias("argument"))
    return P.graph_records(r, "id", ["A", "N"], ["R"])


def _records(t):
    """Token records that a generator might name for a text: its words of a few kinds, some twice."""
    tk = F.split("text", " ")
    rec = lambda kind, *ws: F.struct(F.lit(kind).alias("type"), F.array(*[F.lit(w) for w in ws]).alias("tokens"))
    return t.conversations.select("conv_id", "turn", tk.alias("tk"), F.array(rec("P", "de"), rec("P", "de"), rec("A", "de", "la"), rec("A", "la"), rec("B", "und")).alias("r"))


def _offsets(df, col):
    return df.select("conv_id", "turn", F.explode(col).alias("o")).select("conv_id", "turn", "o.type", L(c("o.span.start")).alias("start"), L(c("o.span.end")).alias("end"))


@query("p_offsets_first", """WITH d AS (SELECT conv_id, turn, string_split(text, ' ') AS tk FROM conversations), m AS (SELECT conv_id, turn, list_filter(range(0, len(tk)), lambda i: tk[i + 1] = 'de') AS de, list_filter(range(0, len(tk)), lambda i: tk[i + 1] = 'la') AS la,
 list_filter(range(0, len(tk)), lambda i: tk[i + 1] = 'und') AS und, list_filter(range(0, len(tk)), lambda i: tk[i + 1] = 'de' AND tk[i + 2] = 'la') AS dela FROM d)
SELECT conv_id, turn, 'P' AS type, de[1] AS start, de[1] AS "end" FROM m WHERE len(de) >= 1 UNION ALL SELECT conv_id, turn, 'P', de[2], de[2] FROM m WHERE len(de) >= 2
UNION ALL SELECT conv_id, turn, 'A', dela[1], dela[1] + 1 FROM m WHERE len(dela) >= 1 UNION ALL SELECT conv_id, turn, 'A', la[1], la[1] FROM m WHERE len(la) >= 1 UNION ALL SELECT conv_id, turn, 'B', und[1], und[1] FROM m WHERE len(und) >= 1""")
def _(t):
    return _offsets(_records(t), P.offsets_first(c("tk"), c("r")))


@query("p_offsets_longest", """WITH d AS (SELECT conv_id, turn, string_split(text, ' ') AS tk FROM conversations), l AS (SELECT *, list_filter(range(0, len(tk)), lambda i: tk[i + 1] = 'de' AND tk[i + 2] = 'la')[1] AS two FROM d),
 m AS (SELECT conv_id, turn, two, list_filter(range(0, len(tk)), lambda i: tk[i + 1] = 'de' AND i IS DISTINCT FROM two) AS de, list_filter(range(0, len(tk)), lambda i: tk[i + 1] = 'la' AND i IS DISTINCT FROM two + 1) AS la,
  list_filter(range(0, len(tk)), lambda i: tk[i + 1] = 'und') AS und FROM l)
SELECT conv_id, turn, 'A' AS type, two AS start, two + 1 AS "end" FROM m WHERE two IS NOT NULL UNION ALL SELECT conv_id, turn, 'P', de[1], de[1] FROM m WHERE len(de) >= 1 UNION ALL SELECT conv_id, turn, 'P', de[2], de[2] FROM m WHERE len(de) >= 2
UNION ALL SELECT conv_id, turn, 'A', la[1], la[1] FROM m WHERE len(la) >= 1 UNION ALL SELECT conv_id, turn, 'B', und[1], und[1] FROM m WHERE len(und) >= 1""")
def _(t):
    return _offsets(_records(t), P.offsets_longest(c("tk"), c("r")))


@query("p_offsets_closest", """WITH d AS (SELECT conv_id, turn, string_split(text, ' ') AS tk FROM conversations), p AS (SELECT conv_id, turn, tk, unnest(range(0, len(tk))) AS i FROM d),
 q AS (SELECT conv_id, turn, CASE WHEN tk[i + 1] = 'de' THEN 'P' WHEN tk[i + 1] = 'la' THEN 'A' WHEN tk[i + 1] = 'und' THEN 'B' END AS type, i, abs(i - len(tk) // 2) AS gap FROM p WHERE tk[i + 1] IN ('de', 'la', 'und'))
SELECT conv_id, turn, type, i AS start, i AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, type ORDER BY gap, i) AS rn FROM q) WHERE rn = 1""")
def _(t):
    df = _records(t).withColumn("r", F.filter("r", lambda r: F.size(r["tokens"]) == 1)).withColumn("r", F.array_distinct("r"))
    return _offsets(df, P.offsets_closest(c("tk"), F.floor(F.size("tk") / 2).cast("int"), c("r")))


@query("p_noise", f"""SELECT doc_id, CAST(len(ws) AS INTEGER) AS before, CAST(len(ws) + len(hit) AS INTEGER) AS after, CAST(len(hit) AS INTEGER) AS added FROM (SELECT doc_id, ws,
 list_filter(range(0, len(ws)), lambda i: {D.format(11, "doc_id, '|', i")} < '{P.share(0.3)}') AS hit FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z]\\p{{L}}{{3,}}')) AS ws FROM documents))""")
def _(t):
    rec = _ents(t).select("doc_id", F.transform("labels", lambda x: F.struct(x["entity_type"].alias("label"), x["entity"].alias("span"))).alias("r"))
    out = rec.select("doc_id", F.size("r").alias("before"), P.noise(c("r"), SCHEMA, 0.3, 11, "doc_id").alias("n"))
    return out.select("doc_id", "before", F.size("n").alias("after"), F.size(F.filter("n", lambda x: x["span"] == "<null>")).alias("added"))


@query("p_augment_merge", """WITH x AS (SELECT p_partkey, p_name, p_brand, h, m FROM part, (VALUES ('item'), ('good')) a(h), (VALUES ('made by'), ('from'), ('of')) b(m))
SELECT p_partkey, concat('The ', h, ' ', m, ' ', p_brand, '.') AS sentence, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE h END AS head, CASE WHEN p_partkey % 2 = 0 THEN 6 + length(h) + length(m) ELSE 4 END AS head_offset,
 CASE WHEN p_partkey % 2 = 0 THEN h ELSE p_brand END AS tail, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 6 + length(h) + length(m) END AS tail_offset FROM x""")
def _(t):
    lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
    df = t.part.select("p_partkey", (c("p_partkey") % 2 == 0).alias("tail_first"), lits("The ").alias("a"), lits("item", "good").alias("b"), lits(" made by ", " from ", " of ").alias("m"), F.array("p_brand").alias("d"), lits(".").alias("e"))
    out = P.augment_merge(df, ["a", "b", "m", "d", "e"])
    return out.withColumn("head_offset", L(c("head_offset"))).withColumn("tail_offset", L(c("tail_offset")))


@query("p_dialog_flat", """SELECT conv_id, turn, concat('what is the relation between ', role, ' and ', y, ' ? ', y, ' is the [MASK] ', role, ' .', text) AS text, role AS head, y AS tail, array_to_string(list_transform(range(1, 37), lambda i: CASE WHEN i = conv_id % 36 + 1 OR i = turn + 1 THEN 1 ELSE 0 END), '') AS label
FROM conversations, (VALUES ('me'), ('you')) v(y)""")
def _(t):
    p = lambda y: F.struct(c("role").alias("x"), F.lit(y).alias("y"), F.array((c("conv_id") % 36 + 1).cast("int"), (c("turn") + 1).cast("int")).alias("rid"))
    df = t.conversations.select("conv_id", "turn", "text", F.array(p("me"), p("you")).alias("pairs"))
    return P.dialog_flat(df, "text", "pairs").withColumn("label", F.array_join(c("label").cast("array<string>"), ""))


@query("p_demo_prompt", f"""SELECT p_type, string_agg(line, chr(10) ORDER BY rn) AS prompt FROM (SELECT p_type, concat(p_name, ' by ', p_brand) AS line, row_number() OVER (PARTITION BY p_type ORDER BY {D.format(3, 'p_partkey')}, p_partkey) AS rn FROM part) WHERE rn <= 4 GROUP BY 1""")
def _(t):
    return P.demo_prompt(t.part, "p_type", "p_partkey", F.concat_ws(" by ", "p_name", "p_brand"), 4, 3)


@query("p_retrieval_map", """SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'PROMO' THEN 'offer' ELSE p_type END AS event_type, s AS sentence FROM (SELECT p_type, unnest([p_name, p_brand]) AS s FROM part)""")
def _(t):
    return P.retrieval_map(t.part.select("p_type", F.array("p_name", "p_brand").alias("s")), "s", "p_type", {"ECONOMY": "cheap", "PROMO": "offer"})


@query("p_blank_rows", """SELECT doc_id, text AS sentence, '' AS head, '' AS tail, '' AS head_offset, '' AS tail_offset, '' AS head_type, '' AS tail_type, '' AS relation, array_to_string(list_transform(string_split(text, ' '), lambda w: 'O'), ' ') AS tags FROM documents""")
def _(t):
    tags = F.array_join(F.transform(F.split("text", " "), lambda w: F.lit("O")), " ")
    return P.blank_rows(t.documents.select("doc_id", c("text").alias("sentence"), tags.alias("tags")), "sentence")
