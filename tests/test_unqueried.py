"""Operators whose rows SQL does not state, held against plain Python."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from tripleloom.functions import parse, tags
from tripleloom.operators import graph, hooks, score
from tripleloom.plans.queries_prep import _relations
from tripleloom.plans.registry import QUERIES, Tables

SF = "/root/testdata/sf0.001"


def test_answers_of_all_tasks(spark):
    import __spark_entry__  # noqa: F401  (registers the queries)
    t = Tables(spark, SF)
    got = {r["doc_id"]: {k: json.loads(v) for k, v in r.asDict().items() if k != "doc_id"} for r in QUERIES["p_answers_tasks"](t).collect()}
    rows = _relations(t).collect()
    assert len(got) == len(rows) == t.conversations.count() and any(len(r["rels"]) == 0 for r in rows)
    for r in rows:
        place = lambda side: sorted(r["rels"], key=lambda x: r["text"].find(x[side]))
        pairs = lambda ok: [{"head": x["head"], "tail": x["tail"]} for x in place("head") if ok(x)]
        key = lambda x: f"{x['head_type']}_{x['relation']}_{x['tail_type']}"
        of = lambda rel: [x for x in place("head") if x["relation"] == rel]
        arguments = {"R0": lambda x: {"tail": x["tail"], "place": "NAN"}, "R1": lambda x: {"tail": x["tail"]}, "R2": lambda x: {}}
        out = got[r["doc_id"]]
        assert out["re"] == {k: pairs(lambda x: x["relation"] == k) for k in ("R0", "R1", "R2")}
        assert out["spo"] == {k: pairs(lambda x: key(x) == k) for k in ("T0_R0_T1", "T1_R1_T2")}
        assert out["ee"] == out["eea"] == {k: [{"trigger": x["head"], "arguments": a(x)} for x in of(k)] for k, a in arguments.items()}
        assert out["ee_no_trigger"] == {k: [{"arguments": a(x)} for x in of(k) if a(x)] for k, a in arguments.items()}
        assert out["eet"] == {k: [x["head"] for x in of(k)] for k in arguments}
        heads = [x["head"] for x in place("head")]
        def attributes(h, names):
            said = {n: [x["tail"] for x in place("tail") if x["head"] == h and x["relation"] == n] for n in names}
            return {n: v[0] if len(v) == 1 else v for n, v in said.items() if v}
        assert out["kg"] == {"X": {h: attributes(h, ["R0", "R1"]) for h in heads}, "Y": {h: attributes(h, ["R2"]) for h in heads}}


def test_common_subsequences(spark):
    rnd = random.Random(5)
    pairs = [([], []), (["a"], []), ([], ["a"])] + [([rnd.choice("abcd") for _ in range(rnd.randint(1, 90))] for _ in range(2)) for _ in range(40)]
    pairs = [tuple(p) for p in pairs]
    def longest(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            row, old = [0], row
            for j, b in enumerate(y):
                row.append(old[j] + 1 if a == b else max(old[j + 1], row[j]))
        return row[-1]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, a array<string>, b array<string>")
    got = {r["id"]: r["n"] for r in df.select("id", score.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: longest(*p) for i, p in enumerate(pairs)}


def test_sampled_subgraph(spark):
    edges = spark.range(60).selectExpr("id AS row_no", "concat('n', id) AS head", "'r' AS relation", "concat('n', id + 1) AS tail")
    nodes = spark.range(61).selectExpr("concat('n', id) AS name", "'x' AS type")
    draw = lambda seed: [r["name"] for r in graph.sample_nodes(edges, nodes, 20, seed).collect()]
    names = draw(7)
    assert len(set(names)) == len(names) == 20 and names == draw(7) and set(names) != set(draw(8))
    at = {int(n[1:]) for n in names}
    first = {int(r["name"][1:]) for r in nodes.orderBy(F.xxhash64("name", F.lit(7)), "name").limit(14).collect()}
    assert first <= at and all({i - 1, i + 1} & at for i in at - first)
    assert len(graph.sample_nodes(edges, nodes, 500, 7).collect()) == 61


def test_models_are_given_whole_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    lines = spark.range(200, numPartitions=2).selectExpr("id AS sentence_id", "concat('a', id, ' b') AS sentence")
    def names(batch):
        assert isinstance(batch, pd.Series) and len(batch) == 50
        return [[{"text": w, "label": "W", "start": 0, "end": 1, "confidence": 1.0} for w in s.split()] for s in batch]
    def related(sentences, entities):
        assert len(sentences) == len(entities) > 1
        return [[(0, 1, "r", 0.9), (1, 0, "NA", 0.9), (1, 0, "r", 0.1)] for _ in entities]
    try:
        out = hooks.extract(lines, names, related).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["sentence_id"], r["head"], r["relation"], r["tail"]) for r in out} == {(i, f"a{i}", "r", "b") for i in range(200)} and len(out) == 200


def test_malformed_answers(spark):
    rows = [(None, True), ("", True), ("{", True), ("[1]", True), ("null", True), ('"x"', True), ("{}", False), ('{"a": [1]}', False)]
    df = spark.createDataFrame(rows, "answer string, bad boolean")
    assert df.where(parse.malformed(F.col("answer")) != F.col("bad")).count() == 0


def test_positions_of_short_texts(spark):
    df = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 1), (3, 1, 1), (6, 1, 4), (4, 3, 1)], "n int, a int, b int")
    for r in df.select("*", tags.segments3(F.col("n"), F.col("a"), F.col("b")).alias("s"), tags.rel_positions(F.col("n"), F.col("a"), 2).alias("p")).collect():
        assert r["s"] == [1 if i <= r["a"] else 2 if i < r["b"] else 3 for i in range(r["n"])]
        assert r["p"] == [max(-2, min(2, i - r["a"])) + 3 for i in range(r["n"])]
