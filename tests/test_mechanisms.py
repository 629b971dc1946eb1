"""Mechanisms that keep operators linear: known facts, threshold sums, blocks of subsequences, hot keys by sketch, ranges of answers, models."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripleloom.functions import session, skew
from tripleloom.operators import graph, hooks, joins, score


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_facts_equal_the_product_of_names(spark):
    rnd = random.Random(2)
    facts = [(d, f"e{rnd.randint(0, 4)}", f"e{rnd.randint(0, 4)}", rnd.choice("rs")) for d in range(12) for _ in range(6)]
    names = [(d, f"e{e}", f"n{rnd.randint(0, 9)}") for d in range(12) for e in range(5) for _ in range(rnd.randint(0, 3))]
    triples = {(f"n{rnd.randint(0, 9)}", f"n{rnd.randint(0, 9)}", rnd.choice("rs")) for _ in range(25)}
    want = {f for f in facts if any((a, b, f[3]) in triples for d, e, a in names if (d, e) == f[:2] for d2, e2, b in names if (d2, e2) == (f[0], f[2]))}
    got = joins.known_facts(spark.createDataFrame(facts + facts[:5], "doc int, h string, t string, relation string"),
                            spark.createDataFrame(names + names[:5], "doc int, entity string, name string"),
                            spark.createDataFrame(sorted(triples), "head_name string, tail_name string, relation string"))
    assert sorted(tuple(r) for r in got.select("doc", "h", "t", "relation").collect()) == sorted(want)


def test_ten_thousand_names_an_entity(spark):
    """Rows between the joins follow the number of names, not its square."""
    names = spark.range(20_000).selectExpr("1 AS doc", "IF(id < 10000, 'h', 't') AS entity", "concat('n', id) AS name")
    facts = spark.createDataFrame([(1, "h", "t", "r"), (1, "t", "h", "r")], "doc int, h string, t string, relation string")
    triples = spark.range(10_000).selectExpr("concat('n', id) AS head_name", "concat('n', 19999 - id) AS tail_name", "'r' AS relation")
    assert [r["h"] for r in joins.known_facts(facts, names, triples).collect()] == ["h"]
    assert joins.known_facts(facts, names, triples.where("head_name = 'n0'").withColumn("tail_name", F.lit("n1"))).count() == 0


def test_each_row_counts_once_in_a_sweep(spark):
    rnd = random.Random(3)
    rows = [([rnd.uniform(-4, 1) for _ in range(4)], sorted(rnd.sample(range(4), rnd.randint(0, 2)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "logits array<double>, gold array<int>")
    import math
    got = {r["step"]: (r["tp"], r["gold"], r["pred"]) for r in score.threshold_sweep(df, "logits", "gold").collect()}
    for step in range(51):
        tp = pred = 0
        for logits, gold in rows:
            pr = [1 / (1 + math.exp(-x)) for x in logits]
            high = [i for i, p in enumerate(pr) if p > 0.5]
            picks = high or ([pr.index(max(pr))] if max(pr) > step / 100 else [])
            tp, pred = tp + len(set(picks) & set(gold)), pred + len(picks)
        assert got[step] == (tp, sum(len(g) for _, g in rows), pred)
    plan = executed(score.threshold_sweep(df, "logits", "gold"))
    assert plan.index("Generate") < plan.rindex("HashAggregate")      # rows are summed before steps are listed


def test_empty_sweep(spark):
    df = spark.createDataFrame([], "logits array<double>, gold array<int>")
    assert score.threshold_sweep(df, "logits", "gold").count() == 0


@pytest.mark.parametrize("block", [1, 2, 5, 64, 4096])
def test_subsequences_in_blocks(block):
    rnd = random.Random(4)

    def longest(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            row, old = [0], row
            for j, b in enumerate(y):
                row.append(old[j] + 1 if a == b else max(old[j + 1], row[j]))
        return row[-1]
    for _ in range(60):
        x, y = ([rnd.choice("abc") for _ in range(rnd.randint(0, 40))] for _ in range(2))
        assert score.common_subsequence(x, y, block) == longest(x, y)


def test_long_subsequences(spark):
    df = spark.createDataFrame([(["a", "b"] * 10_000, ["b", "a"] * 9000), (None, ["a"])], "x array<string>, y array<string>")
    assert [r["n"] for r in df.select(score.lcs_length(F.col("x"), F.col("y")).alias("n")).collect()] == [18_000, 0]


def test_hot_keys_come_from_a_sketch(spark):
    left = spark.range(60_000).selectExpr("IF(id % 3 = 0, 'hot', IF(id % 7 = 0, NULL, concat('k', id))) AS k", "id AS v")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, w int")
    hot = set(left.select(skew.hot_hashes(left, ["k"]).alias("h")).first()["h"])
    assert hot == {r["h"] for r in spark.createDataFrame([("hot",), (None,)], "k string").select(F.xxhash64("k").alias("h")).collect()}
    for how in ("inner", "left", "left_semi", "left_anti"):
        out = skew.salted_join(left, right, ["k"], how)
        assert out.count() == left.join(right, "k", how).count()
        assert "HashAggregate(keys=[k" not in executed(out)           # no count of all keys
    spread = left.withColumn("_hot", F.array_contains(skew.hot_hashes(left, ["k"]), F.xxhash64("k"))).where("_hot").select(F.pmod(F.xxhash64("k", "v"), F.lit(64)).alias("s")).distinct()
    assert spread.count() == 64
    assert skew.salted_join(left.limit(0), right, ["k"], "left").count() == 0


def test_a_hot_question_is_ranked_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "RANGE_ROWS", 500)
    edges = spark.range(4000).selectExpr("id AS row_no", "'hub' AS head", "'r' AS relation", "concat('t', id) AS tail", "0.8 + (id % 7) / 100 AS confidence")
    questions = spark.createDataFrame([("q1", ["hub"], None), ("q2", ["t5", "hub"], "r"), ("q3", ["none"], None)], "question string, names array<string>, relation string")
    got = graph.answer_questions(edges, questions)
    rows = got.where("question = 'q1'").orderBy("rank").collect()
    want = sorted(((-(0.8 + (i % 7) / 100), i) for i in range(4000)))
    assert [r["path"] for r in rows] == [f"hub → r → t{i}" for _, i in want] and [r["rank"] for r in rows] == list(range(1, 4001))
    assert got.where("question = 'q2'").count() == 4000 and got.where("question = 'q3'").first()["path"] == graph.NO_ANSWER
    few = graph.answer_questions(edges, questions, limit=3)
    assert sorted((r["question"], r["rank"]) for r in few.collect()) == [("q1", 1), ("q1", 2), ("q1", 3), ("q2", 1), ("q2", 2), ("q2", 3), ("q3", 1)]


def test_models_are_loaded_once_a_worker_and_given_batches(spark, tmp_path):
    log = str(tmp_path)

    def load():
        import os
        import uuid
        open(f"{log}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        def run(texts):
            assert 0 < len(texts) <= 10 and all(t is not None for t in texts)
            return [[float(len(t)), 1.0] for t in texts]
        return run
    model = hooks.Model(load)
    df = spark.range(300, numPartitions=16).selectExpr("id", "IF(id % 5 = 0, NULL, repeat('x', id)) AS text")
    got = {r["id"]: r["embedding"] for r in hooks.embed(df, "text", model, 2, batch=10).collect()}
    assert got == {i: None if i % 5 == 0 else [float(i), 1.0] for i in range(300)}
    import os
    pids = [f.split("-")[0] for f in os.listdir(log)]
    assert pids and len(pids) == len(set(pids))
    words = hooks.tokenize(df.limit(3), "text", hooks.Model(lambda: lambda texts: [[t[:1], "|"] for t in texts]))
    assert {r["id"]: r["tokens"] for r in words.collect()} == {0: None, 1: ["x", "|"], 2: ["x", "|"]}


@pytest.mark.parametrize("bad", ["size", "number"])
def test_wrong_results_of_a_model_are_errors(spark, bad):
    model = hooks.Model(lambda: (lambda texts: [[1.0] for _ in texts]) if bad == "size" else (lambda texts: [[1.0, 2.0]]))
    df = spark.range(4, numPartitions=1).selectExpr("cast(id AS string) AS text")
    with pytest.raises(Exception, match="the model gave"):
        hooks.embed(df, "text", model, 2).collect()


def test_batches_without_texts(spark):
    df = pd.DataFrame({"text": [None, None]})
    out = hooks.embed(spark.createDataFrame(df, "text string"), "text", hooks.Model(lambda: None), 2).collect()
    assert [r["embedding"] for r in out] == [None, None]


def test_what_a_staged_table_shuffled_is_deleted(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}
    before, switch = shuffled(), spark.conf.get(session.CLEANUP)
    out = session.staged(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 100).alias("k")).count())
    end = time.time() + 10
    while shuffled() - before and time.time() < end:        # they go in the background
        time.sleep(0.2)
    assert not shuffled() - before
    assert out.count() == 100 and spark.conf.get(session.CLEANUP) == switch
