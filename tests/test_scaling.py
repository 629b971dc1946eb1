"""Steps whose cost or memory a larger table must not raise beyond its own growth."""

import random

from pyspark.sql import functions as F

from tripleloom.functions import session, skew
from tripleloom.operators import clean as C
from tripleloom.operators import joins as J
from tripleloom.sources import importer as I


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_objects_are_parsed_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", "r", "x"), ("", "b", "r", "x"), ("a", "c", "r", None)], "source string, target string, relation string, note string")
    rows.write.json(f"{tmp_path}/edges")
    found = I.export_rows(spark, f"{tmp_path}/edges", ["source", "target", "relation"]).where("source <> '' and target <> ''")
    assert plan(found).count("from_json(MapType(StringType,StringType,true), value") == 1
    assert sorted((r["target"], r["properties"]) for r in found.collect()) == [("b", {"note": "x"}), ("c", {})]


def test_imported_rows_are_stored_without_their_texts(spark, tmp_path):
    graph = I.ImportedGraph(spark, str(tmp_path))
    edges = lambda *notes: spark.createDataFrame([("a", "r", "b", {"note": n}) for n in notes], "source string, relation string, target string, properties map<string,string>")
    graph.put_nodes(spark.createDataFrame([("a", None, None), ("b", None, None)], "name string, labels array<string>, properties map<string,string>"), 0)
    graph.put_edges(edges("x", "z", "y"), 0)
    assert "content" not in graph.edge_table.read().columns
    assert [r["properties"] for r in graph.edges().collect()] == [{"note": "z"}]     # of rows of one import always the same one
    graph.put_edges(edges("b", "a"), 1)
    assert [r["properties"] for r in graph.edges().collect()] == [{"note": "b"}]     # and that of the later import


def test_tidy_names_are_only_looked_through(spark):
    names = ["", " ", "a", "a b", " a", "a ", "a  b", "a\tb", "a\n", "a (x)", "(x)a(y)", "a)", "(a", "'a'", 'a"b', "a\u00a0b", "快速排序", "a b(c) d ", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    one_space = F.regexp_replace(F.trim(F.regexp_replace("n", r"\s+", " ")), r"\([^)]*\)", "")
    whole = F.coalesce(F.trim(F.regexp_replace(one_space, "[\"']", "")), F.lit(""))
    assert df.where(~C.norm_entity(F.col("n")).eqNullSafe(whole)).collect() == []
    assert "CASE WHEN RLIKE(n" in plan(df.select(C.norm_entity(F.col("n"))))


def test_group_ranked_over_many_ranges(spark):
    draw = random.Random(5)
    rows = [("hot" if draw.random() < 0.5 else f"s{draw.randrange(300)}", i) for i in range(3000)]
    found = skew.group_ranked(spark.createDataFrame(rows, "s string, no int"), "s", ["no"], "id", "at", buckets=40).collect()
    ids, seen, want = {s: i for i, s in enumerate(sorted({s for s, _ in rows}), 1)}, {}, []
    for s, no in rows:
        seen[s] = seen.get(s, 0) + 1
        want.append((s, no, ids[s], seen[s]))
    assert sorted(map(tuple, found)) == sorted(want)


def test_known_facts_hold_no_names_of_triples(spark):
    """What a head's name begins is joined and looked up, not gathered for a distinct."""
    facts = spark.createDataFrame([(1, "h", "t", "r"), (1, "h", "u", "r")], "doc int, h string, t string, relation string")
    names = spark.createDataFrame([(1, "h", "H"), (1, "h", "G"), (1, "t", "T"), (1, "u", "U")], "doc int, entity string, name string")
    triples = spark.createDataFrame([("H", "T", "r"), ("G", "T", "r"), ("H", "V", "r")], "head_name string, tail_name string, relation string")
    known = J.known_facts(facts, names, triples)
    assert [tuple(r) for r in known.collect()] == [(1, "h", "t", "r")]
    groups = [line for line in plan(known).splitlines() if "Aggregate [" in line]
    assert not [line for line in groups if all(f"{c}#" in line for c in ("doc", "h", "t", "relation", "tail_name"))]


def test_tasks_do_not_grow_with_the_tables(spark):
    names = {"files": "spark.sql.files.maxPartitionBytes", "shuffled": "spark.sql.adaptive.advisoryPartitionSizeInBytes",
             "parts": "spark.sql.adaptive.coalescePartitions.initialPartitionNum"}
    kept = {n: spark.conf.get(n, None) for n in names.values()}
    try:
        spark.conf.set(names["files"], "128m")
        spark.conf.set(names["shuffled"], "1m")
        spark.conf.unset(names["parts"])
        session.configure(spark)
        assert spark.conf.get(names["files"]) == f"{session.SPLIT_MB}m" and spark.conf.get(names["shuffled"]) == "1m"
        assert int(spark.conf.get(names["parts"])) == session.PARTITIONS
    finally:
        for n, v in kept.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
