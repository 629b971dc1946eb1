"""Scores over gold and predicted sets derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.operators import score as M
from tripleloom.plans.graph_tables import kg, nodes
from tripleloom.plans.registry import query

c = F.col


def r6(df, *cols):
    for name in cols:
        df = df.withColumn(name, F.round(c(name), 6))
    return df


def sql_ratio(a, b):
    return f"(CASE WHEN {b} = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / {b} END)"


def sql_prf(cols: str, source: str, scale: int = 100) -> str:
    """P, R, F1 of a source with tp, gold, pred."""
    p, r = f"{sql_ratio('tp', 'pred')} * {scale}", f"{sql_ratio('tp', 'gold')} * {scale}"
    return f"""SELECT {cols} tp, gold, pred, round(P, 6) AS "P", round(R, 6) AS "R", round({sql_ratio('2 * P * R', '(P + R)')}, 6) AS "F1"
 FROM (SELECT {cols} CAST(tp AS BIGINT) AS tp, CAST(gold AS BIGINT) AS gold, CAST(pred AS BIGINT) AS pred, {p} AS P, {r} AS R FROM ({source}))"""


MODES = {"normal": ("least(g, p)", "g", "p"), "multimatch": ("CASE WHEN g > 0 THEN p ELSE 0 END", "g", "p"),
         "set": ("CAST(g > 0 AND p > 0 AS INTEGER)", "CAST(g > 0 AS INTEGER)", "CAST(p > 0 AS INTEGER)")}


def sql_counts(kind: str, key: str, gold: str, pred: str, mode: str) -> str:
    """tp, gold, pred of one kind of key; gold and pred are filters over lineitem."""
    tp, g, p = MODES[mode]
    return f"""SELECT '{kind}' AS kind, sum({tp}) AS tp, sum({g}) AS gold, sum({p}) AS pred FROM (
 SELECT {key}, count(*) FILTER (WHERE {gold}) AS g, count(*) FILTER (WHERE {pred}) AS p FROM lineitem GROUP BY {key})"""


GOLD, PRED = "l_returnflag = 'A'", "l_linestatus = 'F'"


def sides(t):
    return t.lineitem.where(GOLD), t.lineitem.where(PRED)


def prf6(df):
    return r6(df, "P", "R", "F1")


@query("m_tuple_f1", sql_prf("kind,", " UNION ALL ".join(sql_counts(m, "l_suppkey, l_quantity, l_linenumber", GOLD, PRED, m) for m in MODES)))
def _(t):
    g, p = sides(t)
    counts = M.key_counts(g, p, ["l_suppkey"], {"tuple": ["l_quantity", "l_linenumber"]})
    out = None
    for mode in ("normal", "multimatch", "set"):
        one = M.totals(counts, mode).withColumn("kind", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return prf6(M.prf(out))


@query("m_record_f1", sql_prf("kind,", """SELECT 'unordered' AS kind, sum(least(g, p)) AS tp, sum(g) AS gold, sum(p) AS pred FROM (
  SELECT l_suppkey, l_returnflag, l_linenumber, least(l_tax, l_discount) AS lo, greatest(l_tax, l_discount) AS hi, count(*) AS g, count(*) FILTER (WHERE l_linestatus = 'F') AS p FROM lineitem GROUP BY ALL)
 UNION ALL SELECT 'ordered', sum(least(g, p)), sum(g), sum(p) FROM (SELECT l_suppkey, l_returnflag, l_linenumber, a, b, sum(g) AS g, sum(p) AS p FROM (
  SELECT l_suppkey, l_returnflag, l_linenumber, l_tax AS a, l_discount AS b, 1 AS g, 0 AS p FROM lineitem
  UNION ALL SELECT l_suppkey, l_returnflag, l_linenumber, l_discount, l_tax, 0, 1 FROM lineitem WHERE l_linestatus = 'F') GROUP BY ALL)"""))
def _(t):
    def rec(df, first, second):
        arg = lambda x: F.struct(F.lit("arg").alias("role"), c(x).alias("value"))
        return df.withColumn("args", F.array(arg(first), arg(second)))
    out = M.record_f1(rec(t.lineitem, "l_tax", "l_discount"), rec(t.lineitem.where(PRED), "l_discount", "l_tax"), ["l_suppkey"], "l_returnflag", "l_linenumber", "args")
    return prf6(out)


PRED2 = "l_quantity > 10"


@query("m_entity_f1", sql_prf("kind,", sql_counts("string", "l_orderkey, l_returnflag, l_suppkey", PRED, PRED2, "normal") + " UNION ALL " +
                              sql_counts("offset", "l_orderkey, l_returnflag, l_linenumber", PRED, PRED2, "normal")))
def _(t):
    kinds = {"string": ["l_returnflag", "l_suppkey"], "offset": ["l_returnflag", "l_linenumber"]}
    return prf6(M.tuple_f1(t.lineitem.where(PRED), t.lineitem.where(PRED2), ["l_orderkey"], kinds))


REL_KINDS = {"string_strict": ["l_returnflag", "l_linestatus", "l_suppkey", "l_partkey"], "string_boundary": ["l_returnflag", "l_suppkey", "l_partkey"],
             "offset_strict": ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"], "offset_boundary": ["l_returnflag", "l_linenumber", "l_quantity"]}


@query("m_relation_f1", sql_prf("kind,", " UNION ALL ".join(sql_counts(k, "l_suppkey, " + ", ".join(v), "l_tax < 0.05", PRED2, "set") for k, v in REL_KINDS.items())))
def _(t):
    return prf6(M.tuple_f1(t.lineitem.where("l_tax < 0.05"), t.lineitem.where(PRED2), ["l_suppkey"], REL_KINDS, "set"))


EV_KINDS = {"trigger_string": ["l_returnflag", "l_partkey"], "trigger_offset": ["l_returnflag", "l_linenumber"],
            "role_string": ["l_returnflag", "l_partkey", "l_linestatus"], "role_offset": ["l_returnflag", "l_linenumber", "l_linestatus"]}


@query("m_event_f1", sql_prf("kind,", " UNION ALL ".join(sql_counts(k, "l_orderkey, " + ", ".join(v), "l_tax < 0.05", PRED2, "normal") for k, v in EV_KINDS.items())))
def _(t):
    return prf6(M.tuple_f1(t.lineitem.where("l_tax < 0.05"), t.lineitem.where(PRED2), ["l_orderkey"], EV_KINDS))


WAY = {"trigger_id": ["l_linenumber"], "trigger_class": ["l_linenumber", "l_returnflag"], "argument_id": ["l_linenumber", "l_quantity"],
       "argument_class": ["l_linenumber", "l_quantity", "l_linestatus"]}


@query("m_event_4way", sql_prf("kind,", " UNION ALL ".join(sql_counts(k, "l_suppkey, " + ", ".join(v), "l_discount < 0.03", "l_tax < 0.03", "set") for k, v in WAY.items())))
def _(t):
    return prf6(M.tuple_f1(t.lineitem.where("l_discount < 0.03"), t.lineitem.where("l_tax < 0.03"), ["l_suppkey"], WAY, "set"))


@query("m_ie_percent", f"""SELECT kind, tp, gold, pred, "P", "R", round({sql_ratio('2 * P * R', '(P + R)')}, 2) AS "F1" FROM (SELECT kind, CAST(tp AS BIGINT) AS tp, CAST(gold AS BIGINT) AS gold,
 CAST(pred AS BIGINT) AS pred, round({sql_ratio('tp', 'pred')} * 100, 2) AS "P", round({sql_ratio('tp', 'gold')} * 100, 2) AS "R" FROM (
 {sql_counts('NER', 'l_orderkey, l_suppkey', GOLD, PRED, 'set')} UNION ALL {sql_counts('RE', 'l_orderkey, l_suppkey, l_partkey', GOLD, PRED, 'set')}))""")
def _(t):
    g, p = sides(t)
    counts = M.key_counts(g, p, ["l_orderkey"], {"NER": ["l_suppkey"], "RE": ["l_suppkey", "l_partkey"]})
    return M.percent_f1(M.totals(counts, "set"))


@query("m_ie_event", sql_prf("kind,", sql_counts("event", "l_suppkey, l_returnflag, l_linenumber", "l_tax < 0.05", PRED2, "set") + " UNION ALL " +
                             sql_counts("argument", "l_suppkey, l_returnflag, l_quantity, l_linestatus", "l_tax < 0.05", PRED2, "set")))
def _(t):
    kinds = {"event": ["l_returnflag", "l_linenumber"], "argument": ["l_returnflag", "l_quantity", "l_linestatus"]}
    return prf6(M.tuple_f1(t.lineitem.where("l_tax < 0.05"), t.lineitem.where(PRED2), ["l_suppkey"], kinds, "set"))


NEST = """SELECT l_suppkey AS inst, l_orderkey AS event_no, l_returnflag AS type, l_linenumber AS trigger, l_quantity AS argument, l_linestatus AS role FROM lineitem WHERE {0}"""


@query("m_nested_event", f"""WITH g AS ({NEST.format('l_tax < 0.05')}), p AS ({NEST.format('l_quantity > 10')}),
 lg AS (SELECT DISTINCT inst, type, trigger, argument, role FROM g WHERE (inst, type, trigger, event_no) IN (SELECT inst, type, trigger, max(event_no) FROM g GROUP BY 1, 2, 3)),
 lp AS (SELECT DISTINCT inst, type, trigger, argument, role FROM p WHERE (inst, type, trigger, event_no) IN (SELECT inst, type, trigger, max(event_no) FROM p GROUP BY 1, 2, 3))
SELECT (SELECT count(*) FROM (SELECT DISTINCT inst, event_no FROM g)) AS event_gold, (SELECT count(*) FROM g) AS argument_gold,
 (SELECT count(*) FROM (SELECT inst, type, trigger FROM lg INTERSECT SELECT inst, type, trigger FROM lp)) AS event_tp, (SELECT count(*) FROM (FROM lg INTERSECT FROM lp)) AS argument_tp,
 (SELECT count(*) FROM (SELECT DISTINCT inst, event_no FROM p)) AS event_pred, (SELECT count(*) FROM p) AS argument_pred""")
def _(t):
    def ev(cond):
        return t.lineitem.where(cond).select(c("l_suppkey").alias("inst"), c("l_orderkey").alias("event_no"), c("l_returnflag").alias("type"), c("l_linenumber").alias("trigger"),
                                             c("l_quantity").alias("argument"), c("l_linestatus").alias("role"))
    return M.nested_event(ev("l_tax < 0.05"), ev("l_quantity > 10"), "inst")


def sql_smooth(source: str, eps: str) -> str:
    tp = f"(tp + {eps})"
    p, r = f"({tp} / (pred - tp + {eps} + {tp}))", f"({tp} / (gold - tp + {eps} + {tp}))"
    return f"""SELECT kind, CAST(tp AS BIGINT) AS tp, CAST(gold AS BIGINT) AS gold, CAST(pred AS BIGINT) AS pred, round(P, 6) AS "P", round(R, 6) AS "R", round(2 * P * R / (P + R), 6) AS "F1"
 FROM (SELECT kind, tp, gold, pred, {p} AS P, {r} AS R FROM ({source}))"""


ERE = {"entity": ["l_linenumber", "l_returnflag"], "relation": ["l_suppkey", "l_linenumber", "l_quantity"], "relation_types": ["l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"]}


@query("m_ere", sql_smooth(" UNION ALL ".join(sql_counts(k, "l_partkey, " + ", ".join(v), "l_tax < 0.05", PRED2, "set") for k, v in ERE.items()), "1e-6"))
def _(t):
    counts = M.key_counts(t.lineitem.where("l_tax < 0.05"), t.lineitem.where(PRED2), ["l_partkey"], ERE)
    return prf6(M.smoothed(M.totals(counts, "set"), 1e-6))


SR = """ge AS (SELECT DISTINCT l_orderkey AS inst, l_linenumber AS span, l_returnflag AS type FROM lineitem WHERE l_tax < 0.06), pe AS (SELECT DISTINCT l_orderkey AS inst, l_linenumber AS span, l_returnflag AS type FROM lineitem WHERE l_quantity > 10),
 gr AS (SELECT DISTINCT a.l_orderkey AS inst, a.l_linenumber AS head, b.l_linenumber AS tail, a.l_linestatus AS label FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_discount < 0.08),
 pr AS (SELECT DISTINCT a.l_orderkey AS inst, a.l_linenumber AS head, b.l_linenumber AS tail, a.l_linestatus AS label FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity > 5),
 ok AS (SELECT DISTINCT inst, span FROM (FROM ge INTERSECT FROM pe)), hit AS (FROM gr INTERSECT FROM pr)"""


@query("m_strict_relation", f"WITH {SR} " + sql_prf("kind,", """SELECT 'entity' AS kind, (SELECT count(*) FROM (FROM ge INTERSECT FROM pe)) AS tp, (SELECT count(*) FROM ge) AS gold, (SELECT count(*) FROM pe) AS pred
 UNION ALL SELECT 'relation', (SELECT count(*) FROM hit), (SELECT count(*) FROM gr), (SELECT count(*) FROM pr)
 UNION ALL SELECT 'strict', (SELECT count(*) FROM hit WHERE (inst, head) IN (SELECT inst, span FROM ok) AND (inst, tail) IN (SELECT inst, span FROM ok)), (SELECT count(*) FROM gr), (SELECT count(*) FROM pr)"""))
def _(t):
    def ents(cond):
        return t.lineitem.where(cond).select(c("l_orderkey").alias("inst"), c("l_linenumber").alias("span"), c("l_returnflag").alias("type")).distinct()
    def rels(cond):
        a = t.lineitem.where(cond).select(c("l_orderkey").alias("inst"), c("l_linenumber").alias("head"), c("l_linestatus").alias("label"), (c("l_linenumber") + 1).alias("tail"))
        b = t.lineitem.select(c("l_orderkey").alias("inst"), c("l_linenumber").alias("tail")).distinct()
        return a.join(b, ["inst", "tail"]).select("inst", "head", "tail", "label").distinct()
    return prf6(M.strict_relation(ents("l_tax < 0.06"), ents("l_quantity > 10"), rels("l_discount < 0.08"), rels("l_quantity > 5"), "inst"))


@query("m_ner_prf", sql_smooth(" UNION ALL ".join(sql_counts(k, "l_orderkey, l_suppkey" + extra, GOLD, PRED, "set") for k, extra in (("span", ""), ("typed", ", l_linenumber"))), "1e-6"))
def _(t):
    g, p = sides(t)
    counts = M.key_counts(g, p, ["l_orderkey"], {"span": ["l_suppkey"], "typed": ["l_suppkey", "l_linenumber"]})
    return prf6(M.smoothed(M.totals(counts, "set"), 1e-6))


GAP = """SELECT doc_id, coalesce(CASE WHEN length(text) > 300 THEN split_part(text, ' ', 2) END, 'PRED_NONE') AS p, coalesce(CASE WHEN lang <> 'es' THEN split_part(text, ' ', 3) END, 'GOLD_NONE') AS g,
 split_part(text, ' ', 2) AS a, split_part(text, ' ', 5) AS b FROM documents"""


@query("m_gap_coref", f"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN contains(g, p) OR contains(p, g) THEN 'tp' WHEN contains(a, p) OR contains(p, a) OR contains(b, p) OR contains(p, b) THEN 'fp'
 WHEN g <> 'GOLD_NONE' THEN 'fn' ELSE 'none' END AS verdict FROM ({GAP})) GROUP BY 1""")
def _(t):
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    case = M.gap_case(F.when(F.length("text") > 300, word(2)), F.when(c("lang") != "es", word(3)), word(2), word(5))
    return t.documents.select(case.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("m_triple_set", sql_prf("", "SELECT tp, gold, pred FROM (" + sql_counts("triple", "l_suppkey, l_returnflag, l_partkey", "l_tax < 0.05", PRED2, "set") + ")", 1))
def _(t):
    counts = M.key_counts(t.lineitem.where("l_tax < 0.05"), t.lineitem.where(PRED2), [], {"triple": ["l_suppkey", "l_returnflag", "l_partkey"]})
    return prf6(M.prf(M.totals(counts, "set").drop("kind"), 1.0))


@query("m_span_count", f"""WITH k AS (SELECT l_orderkey, l_suppkey, count(*) FILTER (WHERE {GOLD}) AS g, count(*) FILTER (WHERE {PRED}) AS p FROM lineitem GROUP BY 1, 2),
 s AS (SELECT CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(p) AS BIGINT) AS pred FROM k),
 e AS (SELECT avg(CAST(same AS DOUBLE)) AS exact FROM (SELECT min(CAST(g = p AS INTEGER)) AS same FROM k WHERE g + p > 0 GROUP BY l_orderkey))
SELECT tp, gold, pred, round(CAST(tp AS DOUBLE) / pred, 6) AS "P", round(CAST(tp AS DOUBLE) / gold, 6) AS "R", round(2.0 * tp / (gold + pred), 6) AS "F1", round(exact, 6) AS exact FROM s, e""")
def _(t):
    g, p = sides(t)
    return r6(M.span_count(g, p, ["l_orderkey"], ["l_suppkey"]), "P", "R", "F1", "exact")


CL = """p AS (SELECT p_size AS doc, p_partkey AS m, p_type AS gc, p_brand AS pc FROM part), cell AS (SELECT doc, gc, pc, count(*) AS n FROM p GROUP BY 1, 2, 3),
 gs AS (SELECT doc, gc, count(*) AS s FROM p GROUP BY 1, 2), ps AS (SELECT doc, pc, count(*) AS s FROM p GROUP BY 1, 2)"""


def _clusters(t):
    side = lambda col: t.part.select(c("p_size").alias("doc"), c("p_partkey").alias("m"), c(col).alias("cluster"))
    return side("p_type"), side("p_brand")


def sql_cluster(expr_p: str, expr_r: str, name: str) -> str:
    return f"""SELECT '{name}' AS measure, ({expr_p}) AS p, ({expr_r}) AS r"""


def sql_side(size: str, own: str, num: str, den: str) -> str:
    return f"SELECT CAST(sum({num}) AS DOUBLE) / sum({den}) FROM (SELECT z.s AS s, count(*) AS linked, sum(n * n) AS sq, sum(n * (n - 1) / 2) AS pairs FROM {size} z JOIN cell USING (doc, {own}) GROUP BY doc, {own}, z.s)"


CLUSTER = "WITH " + CL + ", x AS (" + " UNION ALL ".join(
    sql_cluster(sql_side("ps", "pc", n, d), sql_side("gs", "gc", n, d), m) for m, n, d in (
        ("muc", "s - linked", "s - 1"), ("b3", "CASE WHEN s > 1 THEN CAST(sq AS DOUBLE) / s END", "CASE WHEN s > 1 THEN s END"),
        ("lea", "CASE WHEN s > 1 THEN s * CAST(pairs AS DOUBLE) / (s * (s - 1) / 2) END", "CASE WHEN s > 1 THEN s END"))) + ")"

for _name in ("muc", "b3", "lea"):
    def _one(t, name=_name):
        return prf6(M.cluster_scores(*_clusters(t), "doc", "m").where(c("measure") == name))
    query(f"m_{_name}", f"""{CLUSTER} SELECT measure, round(p, 6) AS "P", round(r, 6) AS "R", round(2 * p * r / (p + r), 6) AS "F1" FROM x WHERE measure = '{_name}'""")(_one)


@query("m_blanc", f"""WITH {CL}, h AS (SELECT doc, count(*) AS m FROM p GROUP BY 1), a AS (SELECT doc, sum(n * (n - 1) // 2) AS b FROM cell GROUP BY 1),
 k AS (SELECT doc, sum(s * (s - 1) // 2) AS k FROM gs GROUP BY 1), r AS (SELECT doc, sum(s * (s - 1) // 2) AS r FROM ps GROUP BY 1),
 y AS (SELECT doc, b AS tp_c, k AS c_k, r AS c_r, m * (m - 1) // 2 - k - r + b AS tp_n, m * (m - 1) // 2 - k AS n_k, m * (m - 1) // 2 - r AS n_r FROM h JOIN a USING (doc) JOIN k USING (doc) JOIN r USING (doc)),
 f AS (SELECT *, CASE WHEN c_k = 0 AND c_r = 0 THEN 1.0 WHEN c_k = 0 OR c_r = 0 THEN 0.0 ELSE 2.0 * CAST(tp_c AS DOUBLE) / CAST(c_k + c_r AS DOUBLE) END AS fc,
  CASE WHEN n_k = 0 AND n_r = 0 THEN 1.0 WHEN n_k = 0 OR n_r = 0 THEN 0.0 ELSE 2.0 * CAST(tp_n AS DOUBLE) / CAST(n_k + n_r AS DOUBLE) END AS fn FROM y)
SELECT doc, CAST(tp_c AS BIGINT) AS tp_c, CAST(c_k AS BIGINT) AS c_k, CAST(c_r AS BIGINT) AS c_r, CAST(tp_n AS BIGINT) AS tp_n, CAST(n_k AS BIGINT) AS n_k, CAST(n_r AS BIGINT) AS n_r,
 round(CASE WHEN c_k = 0 THEN fn WHEN n_k = 0 THEN fc ELSE (fc + fn) / 2 END, 6) AS blanc FROM f""")
def _(t):
    return r6(M.blanc(*_clusters(t), "doc", "m").drop("F_c", "F_n"), "blanc")


DOCREL = """g AS (SELECT DISTINCT l_suppkey AS doc, l_returnflag AS r, l_partkey AS h, l_linenumber AS t FROM lineitem WHERE l_tax < 0.05), p AS (SELECT DISTINCT l_suppkey AS doc, l_returnflag AS r, l_partkey AS h, l_linenumber AS t FROM lineitem WHERE l_quantity > 10),
 hit AS (FROM g INTERSECT FROM p), tr AS (SELECT DISTINCT p_brand AS hn, concat('line', l_linenumber) AS tn, l_returnflag AS r FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount < 0.01)"""


@query("m_doc_relation", f"""WITH {DOCREL} SELECT (SELECT count(*) FROM hit) AS tp, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM p) AS pred,
 (SELECT CAST(sum(CASE WHEN h % 7 IN (t, t + 1) THEN CASE WHEN h % 7 = t THEN 2 ELSE 1 END ELSE CASE WHEN h % 7 + 1 = t THEN 1 ELSE 0 END END) AS BIGINT) FROM hit) AS evidence_tp,
 (SELECT 2 * count(*) FROM g) AS evidence_gold, (SELECT 2 * count(*) FROM p) AS evidence_pred,
 (SELECT count(*) FROM hit JOIN part ON h = p_partkey WHERE (p_brand, concat('line', t), r) IN (SELECT hn, tn, r FROM tr)) AS seen""")
def _(t):
    def facts(cond, ev):
        f = t.lineitem.where(cond).select(c("l_suppkey").alias("doc"), c("l_returnflag").alias("r"), c("l_partkey").alias("h"), c("l_linenumber").cast("long").alias("t")).distinct()
        return f.withColumn("evidence", ev)
    brand = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"))
    # parts are named by their brand, lines by their number; both are entities of every supplier's document
    heads = brand.select(c("l_suppkey").alias("doc"), c("l_partkey").cast("string").alias("entity"), c("p_brand").alias("name"))
    tails = t.lineitem.select(c("l_suppkey").alias("doc"), F.concat(F.lit("L"), "l_linenumber").alias("entity"), F.concat(F.lit("line"), "l_linenumber").alias("name"))
    train = brand.where("l_discount < 0.01").select(c("p_brand").alias("head_name"), F.concat(F.lit("line"), "l_linenumber").alias("tail_name"), c("l_returnflag").alias("relation"))
    def keyed(df):
        return df.withColumn("h", c("h").cast("string")).withColumn("t", F.concat(F.lit("L"), c("t").cast("string")))
    g = facts("l_tax < 0.05", F.array(c("t"), c("t") + 1))
    p = facts("l_quantity > 10", F.array(c("h") % 7, c("h") % 7 + 1))
    return M.doc_relation(keyed(g), keyed(p), heads.unionByName(tails), train)


CLS = """SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'Other' END AS g, CASE WHEN n_chars > 500 THEN 'good' WHEN n_chars > 100 THEN 'Other' ELSE 'short' END AS p FROM documents JOIN labels USING (doc_id)"""


def _classes(t):
    return t.documents.join(t.labels, "doc_id").select(F.when(c("quality") == 1, "good").otherwise("Other").alias("g"),
                                                       F.when(c("n_chars") > 500, "good").when(c("n_chars") > 100, "Other").otherwise("short").alias("p"))


@query("m_micro_no_neg", f"""WITH x AS ({CLS}), s AS (SELECT count(*) FILTER (WHERE g = p) AS hits, count(*) AS total, count(*) FILTER (WHERE g = p AND g <> 'Other') AS tp, count(*) FILTER (WHERE g <> 'Other') AS gold,
 count(*) FILTER (WHERE p <> 'Other') AS pred FROM x) SELECT hits AS "right", total AS "all", q.*, round(CAST(hits AS DOUBLE) / total, 6) AS accuracy FROM s, ({sql_prf('', 'SELECT tp, gold, pred FROM s', 1)}) q""")
def _(t):
    return r6(M.micro_no_neg(_classes(t), "g", "p"), "accuracy", "P", "R", "F1")


REPORT = f"""WITH x AS ({CLS}), l AS (SELECT g AS label FROM x UNION SELECT p FROM x),
 s AS (SELECT label, (SELECT count(*) FROM x WHERE g = label AND p = label) AS tp, (SELECT count(*) FROM x WHERE g = label) AS gold, (SELECT count(*) FROM x WHERE p = label) AS pred FROM l),
 rep AS ({sql_prf('label,', 'SELECT * FROM s', 1)})"""


@query("m_class_report", f"{REPORT} SELECT * FROM rep")
def _(t):
    return prf6(M.class_report(_classes(t), "g", "p"))


@query("m_confusion", f"SELECT g AS gold, p AS pred, count(*) AS n FROM ({CLS}) GROUP BY 1, 2")
def _(t):
    return M.class_counts(_classes(t), "g", "p")


@query("m_macro_micro", f"""{REPORT} SELECT round(avg("P"), 5) AS "macro_P", round(avg("R"), 5) AS "macro_R", round(avg("F1"), 5) AS "macro_F1", round(CAST(sum(tp) AS DOUBLE) / sum(gold), 5) AS "micro_F1" FROM rep""")
def _(t):
    out = M.macro_micro(_classes(t), "g", "p")
    return out.select(*[F.round(x, 5).alias(x) for x in out.columns])


@query("m_threshold_sweep", """WITH e AS (SELECT list_transform(embedding, lambda x: 1 / (1 + exp(-(CAST(x AS DOUBLE) * 10 - 4)))) AS pr, label FROM embeddings),
 o AS (SELECT label, list_max(pr) AS top, list_position(pr, list_max(pr)) - 1 AS best, list_filter(range(0, len(pr)), lambda i: pr[i + 1] > 0.5) AS high FROM e),
 w AS (SELECT step, label, CASE WHEN len(high) > 0 THEN high WHEN top > step / 100.0 THEN [best] ELSE [] END AS picks FROM o, (SELECT unnest(range(0, 51)) AS step)),
 s AS (SELECT step, count(*) FILTER (WHERE list_contains(picks, label)) AS tp, count(*) AS gold, CAST(sum(len(picks)) AS BIGINT) AS pred FROM w GROUP BY 1)
SELECT CAST(step AS INTEGER) AS step, tp, gold, pred, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS "F1" FROM (SELECT *, CASE WHEN pred = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / pred END AS p, CAST(tp AS DOUBLE) / gold AS r FROM s)""")
def _(t):
    df = t.embeddings.select(F.transform("embedding", lambda x: x.cast("double") * 10 - 4).alias("logits"), F.array("label").alias("gold"))
    return r6(M.threshold_sweep(df, "logits", "gold"), "F1")


@query("m_e2e_relation", f"""WITH x AS ({CLS}), s AS (SELECT count(*) FILTER (WHERE g <> 'Other') AS n_gold, count(*) FILTER (WHERE p <> 'Other') AS n_pred, count(*) FILTER (WHERE g <> 'Other' AND g = p) AS n_correct,
 (SELECT count(*) FROM documents) AS n_all FROM x), y AS (SELECT *, CAST(n_correct AS DOUBLE) / n_pred AS precision_, CAST(n_correct AS DOUBLE) / n_gold AS task_recall, CAST(n_correct AS DOUBLE) / n_all AS recall FROM s)
SELECT n_gold, n_pred, n_correct, n_all, round(precision_, 6) AS "precision", round(task_recall, 6) AS task_recall, round(recall, 6) AS recall, round(2 * precision_ * recall / (precision_ + recall), 6) AS f1 FROM y""")
def _(t):
    all_gold = t.documents.agg(F.count(F.lit(1))).scalar()
    return r6(M.e2e_relation(_classes(t), "g", "p", "Other", all_gold), "precision", "task_recall", "recall", "f1")


@query("m_argmax_softmax", """WITH e AS (SELECT vec_id, embedding, list_max(embedding) AS top, list_position(embedding, list_max(embedding)) AS i FROM embeddings)
SELECT vec_id, CASE WHEN i <= 60 THEN concat('rel', i) ELSE '' END AS label, CASE WHEN i <= 60 THEN round(1 / list_sum(list_transform(embedding, lambda x: exp(CAST(x - top AS DOUBLE)))), 6) ELSE 0 END AS probability FROM e""")
def _(t):
    best = M.argmax_softmax(c("embedding"), [f"rel{i}" for i in range(1, 61)])
    return t.embeddings.select("vec_id", best.alias("b")).select("vec_id", "b.label", F.round("b.probability", 6).alias("probability"))


@query("m_answer_match", """WITH lab AS (SELECT * FROM (VALUES ('click cities', 'rel:click'), ('error', 'rel:error'), ('view countries', 'rel:view'), ('signup', 'rel:signup')) s(w, r)),
 a AS (SELECT event_id, lower(split_part(trim(concat(CASE event_type WHEN 'click' THEN 'Click city' WHEN 'view' THEN 'View Country' ELSE upper(event_type) END, '. rest')), '.', 1)) AS said FROM events)
SELECT event_id, coalesce((SELECT r FROM lab WHERE w = said), (SELECT r FROM lab WHERE contains(said, 'city') AND w = replace(said, 'city', 'cities')), (SELECT r FROM lab WHERE contains(said, 'country') AND w = replace(said, 'country', 'countries'))) AS relation FROM a""")
def _(t):
    labels = t.spark.createDataFrame([("click cities", "rel:click"), ("error", "rel:error"), ("view countries", "rel:view"), ("signup", "rel:signup")], "word string, relation string")
    said = F.concat(F.when(c("event_type") == "click", "Click city").when(c("event_type") == "view", "View Country").otherwise(F.upper("event_type")), F.lit(". rest"))
    return M.answer_match(t.events.select("event_id", said.alias("answer")), "answer", labels).drop("answer")


@query("m_piece_best", """WITH d AS (SELECT doc_id, string_split(text, ' ') AS toks FROM documents), p AS (SELECT doc_id, i, list_slice(toks, i * 512 + 1, i * 512 + 512) AS piece FROM (SELECT doc_id, toks, unnest(range(0, (len(toks) - 1) // 512 + 1)) AS i FROM d)),
 s AS (SELECT doc_id, i, CAST(len(list_filter(piece, lambda w: length(w) > 6)) AS DOUBLE) / len(piece) AS score FROM p)
SELECT doc_id, CAST(i AS BIGINT) AS piece, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rn FROM s) WHERE rn = 1""")
def _(t):
    best = M.piece_best(F.split("text", " "), 512, lambda p: F.size(F.filter(p, lambda w: F.length(w) > 6)) / F.size(p))
    return t.documents.select("doc_id", best.alias("b")).select("doc_id", (-c("b.neg")).cast("long").alias("piece"), F.round("b.score", 6).alias("score"))


@query("m_entity_recall", r"""WITH r AS (SELECT DISTINCT conv_id, e FROM (SELECT conv_id, unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS e FROM conversations WHERE role = 'user') WHERE length(e) >= 5)
SELECT c.conv_id, turn, count(e) AS related, count(*) FILTER (WHERE contains(text, e)) AS found FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id WHERE role <> 'user' GROUP BY 1, 2, text""")
def _(t):
    words = t.conversations.where("role = 'user'").select("conv_id", F.explode(F.split("text", r"[^\p{L}]+")).alias("e")).where("length(e) >= 5")
    texts = t.conversations.where("role <> 'user'").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return M.entity_recall(texts, words, "conv_id", "id", "text", "e").drop("id")


def _answers(t):
    """Each assistant turn with the user turn before it, as token arrays."""
    a = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.split("text", " ").alias("ans"), c("text").alias("ans_text"))
    u = t.conversations.where("role = 'user'").select("conv_id", (c("turn") + 1).alias("turn"), F.split("text", " ").alias("ask"), c("text").alias("ask_text"))
    return a.join(u, ["conv_id", "turn"]).withColumn("id", F.concat_ws("-", "conv_id", "turn"))


TURNS = """pr AS (SELECT concat_ws('-', a.conv_id, a.turn) AS id, string_split(u.text, ' ') AS ask, string_split(a.text, ' ') AS ans FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
  WHERE a.role = 'assistant' AND u.role = 'user')"""
PAIRS = TURNS + """,
 gr AS (SELECT id, n, unnest(list_transform(range(1, len(ask) - n + 2), lambda i: array_to_string(ask[i:i + n - 1], ' '))) AS g, 1 AS a, 0 AS b FROM pr, (SELECT unnest([1, 2, 3, 4]) AS n)
  UNION ALL SELECT id, n, unnest(list_transform(range(1, len(ans) - n + 2), lambda i: array_to_string(ans[i:i + n - 1], ' '))), 0, 1 FROM pr, (SELECT unnest([1, 2, 3, 4]) AS n)),
 ov AS (SELECT id, n, sum(least(a, b)) AS common, sum(a) AS n_a, sum(b) AS n_b FROM (SELECT id, n, g, sum(a) AS a, sum(b) AS b FROM gr GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("m_bleu", f"""WITH {PAIRS}, w AS (SELECT id, {', '.join(f"coalesce(max(common) FILTER (WHERE n = {n}), 0) AS c{n}, greatest(coalesce(max(n_b) FILTER (WHERE n = {n}), 0), 1) AS t{n}" for n in (1, 2, 3, 4))} FROM ov GROUP BY 1)
SELECT id, round(CASE WHEN c1 = 0 THEN 0 ELSE CASE WHEN len(ans) > len(ask) THEN 1 ELSE exp(1 - CAST(len(ask) AS DOUBLE) / len(ans)) END * exp(({' + '.join(f"ln(CASE WHEN c{n} > 0 THEN CAST(c{n} AS DOUBLE) ELSE 0.1 END / t{n})" for n in (1, 2, 3, 4))}) / 4) END, 6) AS bleu
FROM pr JOIN w USING (id)""")
def _(t):
    return r6(M.bleu(_answers(t), "id", "ask", "ans"), "bleu")


@query("m_rouge", f"""WITH {PAIRS} SELECT id, {', '.join(f"round(coalesce(max(CASE WHEN n_a + n_b = 0 THEN 1.0 WHEN n_a = 0 OR n_b = 0 THEN 0 ELSE 2 * CAST(common AS DOUBLE) / (n_a + n_b) END) FILTER (WHERE n = {n}), 1.0), 6) AS rouge{n}" for n in (1, 2))} FROM ov GROUP BY 1""")
def _(t):
    return r6(M.rouge_n(_answers(t), "id", "ask", "ans"), "rouge1", "rouge2")


@query("m_rouge_l", f"""WITH RECURSIVE {TURNS}, x AS (SELECT id, unnest(ask) AS w, generate_subscripts(ask, 1) AS i FROM pr), y AS (SELECT id, unnest(ans) AS w, generate_subscripts(ans, 1) AS j FROM pr),
 lcs AS (SELECT id, 0 AS i, j, 0 AS v FROM y UNION ALL
  SELECT id, i, j, max(c) OVER (PARTITION BY id ORDER BY j) FROM (
   SELECT l.id, l.i + 1 AS i, l.j, CASE WHEN x.w = y.w THEN coalesce(lag(l.v) OVER (PARTITION BY l.id ORDER BY l.j), 0) + 1 ELSE l.v END AS c
   FROM lcs l JOIN x ON x.id = l.id AND x.i = l.i + 1 JOIN y ON y.id = l.id AND y.j = l.j)),
 best AS (SELECT id, max(v) AS lcs FROM lcs GROUP BY 1), f AS (SELECT pr.id, coalesce(best.lcs, 0) AS lcs, len(ask) AS a, len(ans) AS b FROM pr LEFT JOIN best USING (id))
SELECT id, CAST(lcs AS INTEGER) AS lcs, round(CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN a = 0 OR b = 0 THEN 0 ELSE 2 * CAST(lcs AS DOUBLE) / (a + b) END, 6) AS rouge_l FROM f""")
def _(t):
    p = _answers(t)
    n, a, b = M.lcs_length(c("ask"), c("ans")), F.size("ask"), F.size("ans")
    return p.select("id", n.alias("lcs"), a.alias("a"), b.alias("b")).select("id", "lcs", F.round(M.rouge_f(c("lcs"), c("a"), c("b")), 6).alias("rouge_l"))


@query("m_tfidf_cosine", """WITH pr AS (SELECT concat_ws('-', a.conv_id, a.turn) AS id, lower(u.text) AS x, lower(a.text) AS y FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE a.role = 'assistant' AND u.role = 'user'),
 gr AS (SELECT id, n, unnest(list_transform(range(1, length(x) - n + 2), lambda i: substr(x, i, n))) AS g, 1 AS a, 0 AS b FROM pr, (SELECT unnest([1, 2]) AS n)
  UNION ALL SELECT id, n, unnest(list_transform(range(1, length(y) - n + 2), lambda i: substr(y, i, n))), 0, 1 FROM pr, (SELECT unnest([1, 2]) AS n)),
 tf AS (SELECT id, g, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b FROM gr GROUP BY 1, 2), w AS (SELECT id, a * idf AS a, b * idf AS b FROM (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE ln(1.5) + 1 END AS idf FROM tf))
SELECT id, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS similarity FROM w GROUP BY 1""")
def _(t):
    return r6(M.tfidf_cosine(_answers(t), "id", "ask_text", "ans_text"), "similarity")


@query("m_ground_truth", kg("SELECT name, type, concat_ws(chr(10), nullif(description, ''), nullif(properties, ''), nullif(time_complexity, '')) AS truth FROM kg_nodes"))
def _(t):
    return nodes(t).select("name", "type", M.ground_truth(c("description"), c("properties"), c("time_complexity")).alias("truth"))
