"""Tables kept by key, the ingesting stream, imports and rounds: late, repeated and re-run batches, faults and restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tripleloom.functions.skew import first_seen
from tripleloom.operators import rounds
from tripleloom.operators.joins import upsert_attributes
from tripleloom.sources import importer, keyed
from tripleloom.streaming import jobs

TRIPLE = "row_no long, head string, relation string, tail string, note string, arrival long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def arriving(seed, n):
    rnd = random.Random(seed)
    return [(i, f"h{rnd.randint(0, 9)}", "r", f"t{rnd.randint(0, 5)}", rnd.choice([None, "", f"n{i}"]), rnd.randint(0, 30)) for i in range(n)]


def test_batches_in_any_order_equal_one_batch(spark, tmp_path):
    data = arriving(1, 120)
    df = spark.createDataFrame(data, TRIPLE)
    types = spark.createDataFrame([(f"h{i}", "H") for i in range(5)], "entity string, type string")
    known = spark.createDataFrame([("h1", "H", "old"), ("h7", "Z", "old"), ("other", "Z", "old")], "name string, type string, description string")
    good = jobs.typed(df, types)
    want_edges = rows_of(first_seen(good, keyed.KEY, ["arrival", "row_no"]).select("head", "relation", "tail", "row_no", "head_type", "tail_type"))
    side = lambda end, at, note: good.select(F.col(end).alias("name"), F.col(f"{end}_type").alias("type"), note.alias("description"), F.struct("arrival", "row_no", F.lit(at).alias("s")).alias("o"))
    records = side("head", 0, F.col("note")).unionByName(side("tail", 1, F.lit(None).cast("string")))
    want_nodes = rows_of(upsert_attributes(known, records, ["description"], "o"))
    for every, order in ((2, [0, 1, 2, 3]), (100, [3, 0, 2, 1])):
        store = jobs.tables(spark, str(tmp_path / f"g{every}"), df.schema, "arrival", {"description": ("note", None)}, every)
        batches = [good.where(F.col("row_no") % 4 == k).select(*store.edge_table.schema.names) for k in order]
        for number, batch in enumerate(batches):
            store.merge(batch, number)
            store.merge(batch, number)                       # runs again
        store.merge(batches[0], 9)                           # the same rows once more
        assert rows_of(store.edges().select("head", "relation", "tail", "row_no", "head_type", "tail_type")) == want_edges
        assert rows_of(store.nodes(known)) == want_nodes


def test_unfinished_folders_do_not_count(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path), "k int, v int", keyed.last_of(["k"], ["v"]), every=3)
    make = lambda *rows: spark.createDataFrame(rows, "k int, v int")
    assert table.read().count() == 0
    table.merge(make((1, 1), (2, 1)), 0)
    make((1, 99)).write.parquet(str(tmp_path / "batch=1"))   # stopped before its mark
    assert rows_of(table.read()) == [(1, 1), (2, 1)]
    table.merge(make((1, 2)), 1)
    make((1, 99)).write.parquet(str(tmp_path / "base=7"))
    table.merge(make((3, 3)), 2)                             # the third one makes a base
    assert keyed.numbered(spark, str(tmp_path), "base") == [2] and rows_of(table.read()) == [(1, 2), (2, 1), (3, 3)]
    table.merge(make((1, 50)), 1)                            # part of the base already
    assert rows_of(table.read()) == [(1, 2), (2, 1), (3, 3)]
    for n in (3, 4, 5, 6, 7, 8):
        table.merge(make((n, n)), n)
    assert table.read().count() == 8 and keyed.numbered(spark, str(tmp_path), "batch") == [6, 7, 8]      # those of the base before are gone
    table.replace(make((1, 1)), 9)
    assert rows_of(table.read()) == [(1, 1)]


def stream_of(spark, path, rows, files=1):
    df = spark.createDataFrame(rows, "head string, relation string, tail string, arrival long")
    df.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), df.schema


def test_rows_that_are_no_triples_are_set_aside_and_the_rest_is_stored(spark, tmp_path):
    src, out, bad, check = (str(tmp_path / x) for x in ("in", "out", "bad", "check"))
    stream, schema = stream_of(spark, src, [("a", "r", "b", 1), ("", "r", "b", 2), ("a", None, "b", 3), ("a", "r", None, 4), ("a", "r", ' "a" ', 5), (None, "r", "b", 6)], 3)
    jobs.ingest_stream(stream, "arrival", out, bad, check).awaitTermination()
    assert rows_of(jobs.stored(spark, out, schema).select("head", "tail", "head_type")) == [("a", "b", "ENTITY")]
    assert sorted(r["reason"] for r in spark.read.parquet(bad).collect()) == ["empty head", "empty head", "empty relation", "empty tail", "head equals tail"]


def test_a_batch_of_bad_data_is_set_aside_whole(spark, tmp_path):
    src, out, bad, check = (str(tmp_path / x) for x in ("in", "out", "bad", "check"))
    stream, _ = stream_of(spark, src, [("a", "r", "b", 1), ("c", "r", "d", 2)])
    def strict(batch, number):
        batch.select(F.col("head").cast("int")).collect()
    spark.conf.set("spark.sql.ansi.enabled", "true")
    jobs.ingest_stream(stream, "arrival", out, bad, check, store=strict).awaitTermination()
    back = spark.read.parquet(bad)
    assert back.count() == 2 and "CAST_INVALID_INPUT" in back.first()["reason"]


def test_other_errors_stop_the_stream_and_the_batch_runs_again(spark, tmp_path):
    src, out, bad, check = (str(tmp_path / x) for x in ("in", "out", "bad", "check"))
    stream, schema = stream_of(spark, src, [("a", "r", "b", 1), ("c", "r", "d", 2)])
    keep = jobs.tables(spark, out, schema)
    def full(batch, number):
        keep.edge_table.merge(batch, number)                 # half of the batch's work
        raise IOError("no space")
    with pytest.raises(Exception, match="no space"):
        jobs.ingest_stream(stream, "arrival", out, bad, check, store=full).awaitTermination()
    assert not (tmp_path / "bad").exists() and keep.nodes().count() == 0
    jobs.ingest_stream(stream, "arrival", out, bad, check).awaitTermination()
    assert keep.edges().count() == 2 and keep.nodes().count() == 4


# imports --------------------------------------------------------------------------------------------

def test_imports_overwrite_their_keys_or_everything(spark, tmp_path):
    graph = importer.ImportedGraph(spark, str(tmp_path / "g"), every=3)
    nodes = [{"name": "a", "labels": ["X", "Y"], "properties": {"p": 1, "q": None}}, {"name": "b", "properties": {"p": "x"}, "size": 3}, {"name": "c", "labels": []}, {"labels": ["X"]}, {"name": ""}]
    edges = [{"source": "a", "target": "b", "relation": "r", "properties": {"confidence": 0.5, "seen": True}}, {"source": "a", "target": "gone", "relation": "r"},
             {"source": "a", "target": None, "relation": "r"}, {"source": "b", "target": "c", "relation": "s", "confidence": 0.25, "list": [1, {"x": 2}]}]
    (tmp_path / "full.json").write_text(json.dumps({"nodes": nodes, "relationships": edges, "statistics": {"nodes": {"n": 3}}}))
    for _ in range(2):                                       # an import that runs again changes nothing
        importer.import_graph_file(spark, str(tmp_path / "full.json"), graph, 0)
        assert rows_of(graph.nodes()) == [("a", ["X", "Y"], {"p": "1"}), ("b", ["实体"], {"p": "x", "size": "3"}), ("c", ["实体"], {})]
        assert rows_of(graph.edges()) == [("a", "b", "r", {"confidence": "0.5", "seen": "true"}), ("b", "c", "s", {"confidence": "0.25", "list": '[1,{"x":2}]'})]
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "n.json").write_text("\n".join(json.dumps(x) for x in [{"name": "a", "labels": ["X"], "properties": {"p": 2}}, {"name": "gone"}]))
    importer.import_nodes(spark, str(tmp_path / "more"), graph, 1)
    assert {r["name"]: r["properties"] for r in graph.nodes().collect()} == {"a": {"p": "2"}, "b": {"p": "x", "size": "3"}, "c": {}, "gone": {}}
    assert graph.edges().count() == 3                        # the end that was missing is there now
    importer.import_nodes(spark, str(tmp_path / "more"), graph, 2, clean=True)
    assert sorted(r["name"] for r in graph.nodes().collect()) == ["a", "gone"]


# rounds ---------------------------------------------------------------------------------------------

def chain_of():
    def chain(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for s, known in zip(pdf["sentence"], pdf["known_pairs"]):
                last = max((p["b"] for p in known), default="a")
                out += [(s, last, "next", chr(ord(last) + 1), 0.9), (s, last, "next", chr(ord(last) + 1), 0.8), (s, last, "none", "z", 0.99), (s, last, "weak", "y", 0.2), (s, "b", "back", "a", 0.9)]
            yield pd.DataFrame(out, columns=["sentence", "head", "relation", "tail", "confidence"])
    return chain


def seed_of(spark):
    known = spark.createDataFrame([("s1", "a", "r", "b", 0.6), ("s2", "a", "r", "b", 0.95), (None, "a", "r", "b", 0.5)], "sentence string, head string, relation string, tail string, confidence double")
    return known, spark.createDataFrame([("s1",), ("s1",), ("s2",), (None,)], "sentence string")


def test_rounds_go_on_after_the_last_whole_version(spark, tmp_path):
    known, sentences = seed_of(spark)
    whole = rounds.expand_rounds(known, sentences, chain_of(), str(tmp_path / "a"), max_rounds=3, least_ratio=0.0)
    broken = str(tmp_path / "b")
    rounds.expand_rounds(known, sentences, chain_of(), broken, max_rounds=1, least_ratio=0.0)
    known.write.parquet(rounds.path_of(broken, 2))           # stopped while it was written
    assert rows_of(rounds.expand_rounds(known, sentences, chain_of(), broken, max_rounds=3, least_ratio=0.0)) == rows_of(whole)
    got = [(r["head"], r["tail"], r["round"], r["is_new"], r["rank"]) for r in whole.where("sentence = 's1'").orderBy("rank").collect()]
    assert got == [("b", "c", 1, False, 1), ("c", "d", 2, False, 2), ("d", "e", 3, True, 3), ("a", "b", 0, False, 4)]
    assert whole.where("sentence is null").count() == 1


def test_rounds_end_when_little_is_new(spark, tmp_path):
    known, sentences = seed_of(spark)
    out = rounds.expand_rounds(known, sentences, chain_of(), str(tmp_path), max_rounds=50, least_ratio=0.5)
    # 2 of 3, then 2 of 5: the second round falls below one half and is the last
    assert keyed.numbered(spark, str(tmp_path), "version") == [0, 1, 2] and out.agg(F.max("round")).first()[0] == 2
    assert rounds.expand_rounds(known, sentences, chain_of(), str(tmp_path), max_rounds=50, least_ratio=0.5).count() == out.count()
