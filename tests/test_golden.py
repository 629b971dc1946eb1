"""Small cases with known answers."""

from pyspark.sql import functions as F

from tripleloom.functions import answers as N
from tripleloom.functions import parse as P
from tripleloom.functions import tags as G
from tripleloom.functions import text as X
from tripleloom.operators import clean as C
from tripleloom.operators import graph as Q
from tripleloom.operators import prep as R
from tripleloom.operators import score as M
from tripleloom.operators import select as S


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def lit(x):
    return F.array(*[F.lit(v) for v in x]) if isinstance(x, list) else F.lit(x)


def rows(value):
    return [tuple(r) for r in value]


def test_norm_entity(spark):
    assert one(spark, C.norm_entity(lit("  快速排序(QuickSort) "))) == "快速排序"
    assert one(spark, C.norm_entity(lit('a  "b" (x)(y)'))) == "a b"
    assert one(spark, C.norm_entity(F.lit(None).cast("string"))) == ""


def test_offsets(spark):
    got = one(spark, G.order_by_offset(lit("数组属于线性结构"), lit("线性结构"), lit("数组")))
    assert tuple(got) == ("数组", 0, 2, "线性结构", 4, 8)
    assert one(spark, G.find_all(lit("aaa"), "aa")) == [0, 1]


def test_tags(spark):
    tags = lit(["O", "I-A", "I-B", "B-A", "I-A"])
    assert rows(one(spark, G.bio_to_spans(tags))) == [(1, 3, "A"), (3, 5, "A")]
    assert rows(one(spark, G.chunks_typed(tags))) == [(1, 2, "A"), (2, 3, "B"), (3, 5, "A")]
    assert rows(one(spark, G.bio_strict(lit(["O", "I-A", "B-B", "I-B", "O"])))) == [(2, 4, "B")]
    spans = F.array(F.struct(lit(1).alias("start"), lit(3).alias("end"), lit("A").alias("type")), F.struct(lit(4).alias("start"), lit(5).alias("end"), lit("B").alias("type")))
    round_trip = R.span_tags(lit(6), spans)
    assert one(spark, round_trip) == ["O", "B-A", "I-A", "O", "B-B", "O"]
    assert rows(one(spark, G.bio_to_spans(round_trip))) == [(1, 3, "A"), (4, 5, "B")]


def test_positions_and_chunks(spark):
    assert one(spark, G.rel_positions(lit(5), lit(1), 2)) == [2, 3, 4, 5, 5]
    sizes = lambda n: [len(x) for x in one(spark, N.schema_chunks(lit([str(i) for i in range(n)]), 4))]
    assert sizes(10) == [4, 4, 2] and sizes(9) == [4, 5] and sizes(3) == [3]


def test_parse_triples(spark):
    assert rows(one(spark, P.parse_triples(lit("(a,b,c)(d,e,f")))) == [("a", "b", "c"), ("d", "e", "f")]
    assert one(spark, P.parse_triples(lit("(a,b)"))) == []


def test_fix_unk(spark):
    text = "The main ingredients of Arròs negre , which is from Spain"
    assert one(spark, P.fix_unk(lit("Arr<unk> s negre"), lit(text))) == "Arròs negre"
    assert one(spark, P.fix_unk(lit("Tarō As<unk>"), lit("The leader of Japan is Tarō Asō ."))) == "Tarō Asō"
    assert one(spark, P.fix_unk(lit("no hole"), lit(text))) == "no hole"
    assert one(spark, P.fix_unk(lit("x(<unk>"), lit(text))) == "x(<unk>"


def test_intents(spark):
    got = [one(spark, C.intent_rules(lit(s))) for s in ("栈和队列的区别", "有哪些排序", "什么是栈", "hello")]
    assert got == ["find_relation_by_two_entities", "find_entity_by_relation_and_entity", "find_entity_definition", "other"]


def test_relation_score(spark):
    assert one(spark, S.relation_score(lit("树"), lit("树"), lit("包含"), lit("二叉树"))) == 5


def test_undirected_links(spark):
    df = spark.createDataFrame([(1, "a", "r", "b"), (2, "b", "r", "a"), (3, "a", "q", "b")], "row_no int, head string, relation string, tail string")
    got = sorted(tuple(r) for r in S.undirected_links(df, ["row_no"]).collect())
    assert got == [(1, "a", "r", "b"), (3, "a", "q", "b")]


EDGE = "row_no int, head string, head_type string, relation string, tail string, tail_type string, sentence string"


def test_curation(spark):
    df = spark.createDataFrame([(1, "栈", "Algorithm", "uses", "队列", "DataStructure", None), (2, "a", "Unknown", "foo", "b", "Unknown", None),
                                (3, "o", "Operation", "appliesTo", "x", "Algorithm", None), (4, "d", "DataStructure", "uses", "p", "Operation", "said")], EDGE)
    got = {r["row_no"]: (r["relation"], r["sentence"]) for r in Q.curate(df).collect()}
    assert got == {1: ("uses", "栈算法使用队列数据结构"), 2: ("foo", "a与b存在foo关系"), 4: ("appliesTo", "said")}


def test_conf_filter_edges(spark):
    df = spark.createDataFrame([(0.7,), (0.8,), (0.8 - 5e-11,), (None,)], "confidence double")
    assert sorted(r[0] for r in C.conf_filter(df, 0.8, "~>=").collect()) == [0.8 - 5e-11, 0.8]
    assert C.conf_filter(df.withColumnRenamed("confidence", "c"), 0.8).count() == 4


def test_null_confidence_order(spark):
    df = spark.createDataFrame([(1, "a", "r", "b", None), (2, "a", "r", "c", 0.9)], "row_no int, head string, relation string, tail string, confidence double")
    order = ["row_no"]
    assert [r["row_no"] for r in S.by_confidence(df, order, limit=1).collect()] == [2]
    assert S.by_confidence(df, order, limit=1, compat=True, threshold=0.8).count() == 0


def test_tuple_modes(spark):
    side = lambda xs: spark.createDataFrame([("i", x) for x in xs], "inst string, k string")
    counts = M.key_counts(side("aab"), side("abbc"), ["inst"], {"t": ["k"]})
    got = {m: tuple(M.totals(counts, m).select("tp", "gold", "pred").first()) for m in ("normal", "set", "multimatch")}
    assert got == {"normal": (2, 3, 4), "set": (2, 2, 3), "multimatch": (3, 3, 4)}


def test_cluster_scores(spark):
    side = lambda cs: spark.createDataFrame([(0, m, i) for i, c in enumerate(cs) for m in c], "doc int, m int, cluster int")
    got = {r["measure"]: (round(r["P"], 6), round(r["R"], 6)) for r in M.cluster_scores(side([[1, 2, 3], [4]]), side([[1, 2], [3, 4]]), "doc", "m").collect()}
    assert got["muc"] == (0.5, 0.5) and got["b3"] == (0.75, round(5 / 9, 6))


def test_blanc_against_pairs(spark):
    from itertools import combinations
    key, resp = [[1, 2, 3], [4, 5], [6]], [[1, 2], [3, 4, 5], [7]]
    side = lambda cs: spark.createDataFrame([(0, m, i) for i, c in enumerate(cs) for m in c], "doc int, m int, cluster int")
    got = M.blanc(side(key), side(resp), "doc", "m").first()
    def links(cs):
        where = {m: i for i, c in enumerate(cs) for m in c}
        pairs = set(combinations(sorted(where), 2))
        return {p for p in pairs if where[p[0]] == where[p[1]]}, {p for p in pairs if where[p[0]] != where[p[1]]}
    (ck, nk), (cr, nr) = links(key), links(resp)
    assert (got["tp_c"], got["c_k"], got["c_r"]) == (len(ck & cr), len(ck), len(cr))
    assert (got["tp_n"], got["n_k"], got["n_r"]) == (len(nk & nr), len(nk), len(nr))


def test_answers(spark):
    import json
    label = lambda e, t: F.struct(lit(e).alias("entity"), lit(t).alias("entity_type"))
    out = one(spark, N.ner_answer(lit("b then a"), F.array(label("a", "X"), label("b", "X")), ["X", "Y"]))
    assert json.loads(out) == {"X": ["b", "a"], "Y": []}
    arg = lambda r, a: F.struct(lit(r).alias("role"), lit(a).alias("argument"))
    ev = F.array(F.struct(lit("E").alias("event_type"), lit("go").alias("trigger"), F.array(arg("who", "p"), arg("who", "q"), arg("at", "here")).alias("arguments")))
    out = one(spark, N.ee_answer(lit("p and q go here"), ev, [("E", ["who", "at", "why"]), ("F", ["who"])]))
    assert json.loads(out) == {"E": [{"trigger": "go", "arguments": {"who": ["p", "q"], "at": "here", "why": "NAN"}}], "F": []}
    rel = lambda h, r, t: F.struct(lit(h).alias("head"), lit(r).alias("relation"), lit(t).alias("tail"))
    out = one(spark, N.kg_answer(lit("a b c"), F.array(rel("a", "r", "c"), rel("a", "r", "b"), rel("b", "q", "c")), [("T", ["r", "q"])]))
    assert json.loads(out) == {"T": {"a": {"r": ["b", "c"]}, "b": {"q": "c"}}}


def test_pack_sentences(spark):
    s = ["x" * 5, "y" * 4, "z" * 3]
    assert one(spark, X.pack_sentences(lit(s), 12)) == ["xxxxx yyyy", "zzz"]
    assert one(spark, X.pack_sentences(lit(["x" * 20, "y"]), 12)) == ["x" * 20, "y"]


def test_overlap_and_longest(spark):
    ent = lambda i, a, b: F.struct(lit(i).alias("id"), lit(a).alias("start"), lit(b).alias("end"))
    got = one(spark, R.overlap_entities(F.array(ent("a", 0, 3), ent("b", 2, 4), ent("c", 4, 6))))
    assert [k["id"] for k in got["kept"]] == ["a", "c"] and rows(got["moved"]) == [("b", "a")]
    cand = lambda t, s: F.struct(lit(t).alias("text"), lit(s).alias("start"))
    got = one(spark, R.resolve_longest(F.array(cand("二叉", 0), cand("二叉搜索树", 0), cand("树", 9), cand("遍历", 6)), ["算法"]))
    assert [k["text"] for k in got] == ["二叉搜索树", "遍历"]


def test_offset_strategies(spark):
    toks = lit("a b a b c".split())
    rec = lambda t, *ws: F.struct(lit(t).alias("type"), lit(list(ws)).alias("tokens"))
    first = one(spark, R.offsets_first(toks, F.array(rec("T", "a"), rec("T", "a"), rec("T", "a"))))
    assert [(x["type"], tuple(x["span"])) for x in first] == [("T", (0, 0)), ("T", (2, 2))]
    longest = one(spark, R.offsets_longest(toks, F.array(rec("S", "b"), rec("L", "a", "b"))))
    assert [(x["type"], tuple(x["span"])) for x in longest] == [("L", (0, 1)), ("S", (3, 3))]
    near = one(spark, R.offsets_closest(toks, lit(3), F.array(rec("R", "a"), rec("R", "z"))))
    assert [tuple(x["span"]) for x in near] == [(2, 2)]


def test_lcs(spark):
    df = spark.createDataFrame([("a b c b d a b".split(), "b d c a b a".split()), ([], ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(M.lcs_length(F.col("a"), F.col("b"))).collect()] == [4, 0]


def test_class_weights(spark):
    from tripleloom.operators.aggregate import class_weights
    got = {r["l"]: round(r["balanced"], 6) for r in class_weights(spark.createDataFrame([("A",)] * 3 + [("B",)], "l string"), "l").collect()}
    assert got == {"A": 0.666667, "B": 2.0}


def test_dialog_whole_word(spark):
    got = one(spark, P.dialog_rename(lit("speaker 1: im in time"), lit("speaker 1"), lit("bob")))
    assert tuple(got) == ("[unused1] : i in time", "[unused1]", "bob")


def test_format_attr(spark):
    cases = {'"x"': "x", '["a", 1]': "a; 1", '{"a": "b", "c": {"d": 2}}': "a: b; c (d: 2)", '[{"k": "v"}]': "(k: v)", "[]": "", "null": "", "plain text": "plain text"}
    assert {k: one(spark, P.format_attr(lit(k))) for k in cases} == cases
    assert one(spark, P.format_attr(lit('[{"operation_name": "push", "typical_usage": "add"}]'), True)) == "push (用途: add)"


def test_pred_triggers(spark):
    gold = spark.createDataFrame([(0, ["B-X", "O", "O", "O"])], "line int, tags array<string>")
    pred = spark.createDataFrame([(0, ["B-Y", "O", "B-Z", "I-Z"])], "line int, tags array<string>")
    got = sorted((r["extra"], r["tags"]) for r in R.pred_triggers(gold, pred, "line").collect())
    assert got == [(0, ["B-Y", "O", "O", "O"]), (1, ["O", "O", "B-Z", "I-Z"])]


def test_context_window(spark):
    sent = lambda s, at: F.struct(lit(s).alias("tokens"), lit(at).alias("start"))
    got = one(spark, S.context_tokens(F.array(sent(["a", "b"], 0), sent(["c"], 2), sent(["d", "e"], 3)), 3))
    assert [(x["tokens"], x["start"], x["end"]) for x in got] == [(["a", "b", "c"], 0, 2), (["b", "c", "d"], 1, 2), (["d", "e"], 0, 2)]


def test_tokenize_basic(spark):
    assert one(spark, P.tokenize_basic(lit("Él va, 树x\u0000!"))) == ["el", "va", ",", "树", "x", "!"]
