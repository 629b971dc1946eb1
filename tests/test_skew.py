"""Hot keys, exact ranks and plans."""

import random

import pytest
from pyspark.sql import functions as F

from tripleloom.functions.skew import first_seen, prefix_sum, ranked, salted_join, top_k
from tripleloom.operators import joins as J
from tripleloom.operators import prep as R


def hot_frame(spark, n=3000):
    """Half of the rows share one key."""
    rnd = random.Random(5)
    rows = [("hot" if i % 2 else f"k{rnd.randrange(300)}", i * 7919 % 100003, rnd.randrange(10)) for i in range(n)]
    rows += [(None, 200000 + i, 1) for i in range(20)]
    return rows, spark.createDataFrame(rows, "k string, o long, v int")


def test_ranked_matches_sorting(spark):
    rows, df = hot_frame(spark)
    for buckets in (1, 4, 32):
        got = {r["o"]: r["rank"] for r in ranked(df, ["k"], ["o"], buckets=buckets).collect()}
        want = {}
        for key in {r[0] for r in rows}:
            for i, o in enumerate(sorted(r[1] for r in rows if r[0] == key), 1):
                want[o] = i
        assert got == want


def test_ranked_splits_a_hot_key(spark):
    _, df = hot_frame(spark)
    from tripleloom.functions.skew import _bucketed
    sizes = [r["n"] for r in _bucketed(df.where("k = 'hot'"), ["k", "o"], 16).groupBy("_ps_bucket").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 1500 / 3


def test_global_rank_and_prefix(spark):
    rows, df = hot_frame(spark)
    order = sorted(r[1] for r in rows)
    got = {r["o"]: r["rank"] for r in ranked(df, [], ["o"], buckets=8).collect()}
    assert got == {o: i for i, o in enumerate(order, 1)}
    by_o = {r[1]: r[2] for r in rows}
    total, want = 0, {}
    for o in order:
        total += by_o[o]
        want[o] = total
    assert {r["o"]: r["s"] for r in prefix_sum(df, [], ["o"], F.col("v").cast("long"), "s", buckets=8).collect()} == want


def test_ranked_string_order_and_empty(spark):
    df = spark.createDataFrame([(f"s{i:04d}",) for i in range(500)], "s string")
    assert [r["s"] for r in ranked(df, [], ["s"], buckets=8).orderBy("rank").collect()] == [f"s{i:04d}" for i in range(500)]
    assert ranked(df.where("s = 'x'"), [], ["s"]).count() == 0


def test_salted_join_equals_join(spark):
    _, df = hot_frame(spark)
    right = spark.createDataFrame([("hot", "h"), ("k1", "x"), ("k2", "y"), ("nobody", "z")], "k string, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, salted_join(df, right, ["k"], how).select(*df.join(right, "k", how).columns).collect()))
        assert a == sorted(map(str, df.join(right, "k", how).collect())), how


def test_first_seen_and_top_k(spark):
    rows, df = hot_frame(spark)
    got = {r["k"]: r["o"] for r in first_seen(df, ["k"], ["o"]).collect()}
    assert got == {k: min(r[1] for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    top = top_k(df, ["k"], [F.col("o")], 3)
    assert top.where("k = 'hot'").count() == 3
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_first_seen_is_idempotent(spark):
    _, df = hot_frame(spark)
    once = first_seen(df, ["k"], ["o"])
    assert sorted(map(str, once.collect())) == sorted(map(str, first_seen(once, ["k"], ["o"]).collect()))


def test_pair_ranges_state_every_pair(spark):
    df = spark.createDataFrame([("s", i) for i in range(6)] + [("t", 1), ("u", 1), ("u", 2)], "sid string, e int")
    got = J.pair_ranges(df, "sid", ["e"]).groupBy("sid").agg(F.sum("pairs").alias("n")).collect()
    assert {r["sid"]: r["n"] for r in got} == {"s": 15, "u": 1}


def test_split_parts_are_exact(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    sizes = {r["part"]: r["n"] for r in R.split_random(df, "k").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 70, "test": 20, "valid": 11}
    few = {r["part"]: r["n"] for r in R.split_ordered(spark.range(7).withColumnRenamed("id", "k"), ["k"]).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert few == {"train": 5, "test": 2}


def test_synonyms_match_brute_force(spark):
    texts = ["abcab", "xxabxx", "", "ab", "数据结构与树", "b"]
    words = [("A", "ab"), ("A", "abcab"), ("B", "b"), ("C", "数据结构"), ("D", "树"), ("E", "zz"), ("F", "cabx")]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    d = spark.createDataFrame([(c, s, i) for i, (c, s) in enumerate(words)], "canonical string, synonym string, dict_no int")
    got = {(r["id"], r["canonical"]) for r in J.synonym_hits(t, "id", "text", d).collect()}
    assert got == {(i, c) for i, x in enumerate(texts) for c, s in words if s in x}


def test_no_cross_join_and_pushdown(spark):
    from tripleloom.plans import catalog  # noqa: F401
    from tripleloom.plans.registry import QUERIES, Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    for name in ("j_synonym_contains", "j_pairs_ordered", "g_query_graph", "g_context_batch", "m_b3", "a_vocab", "p_split_random", "m_threshold_sweep"):
        plan = QUERIES[name](t)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
    plan = QUERIES["m_entity_f1"](t)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)]" in plan and "l_shipdate" not in plan


def test_staged_tables_need_a_shared_folder():
    from tripleloom.functions.session import staging_base
    assert staging_base("viewfs://c/x", "file:/tmp/w", "spark://h:7077") == "viewfs://c/x"
    assert staging_base(None, "file:/tmp/w/", "local[8]") == "file:/tmp/w/_staged"
    assert staging_base(None, "hdfs://n/w", "yarn") == "hdfs://n/w/_staged"
    for warehouse in ("file:/tmp/w", "/tmp/w"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            staging_base(None, warehouse, "k8s://h")
