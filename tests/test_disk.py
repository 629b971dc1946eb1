"""What queries leave on the disks: less is shuffled or kept, and the rows are those of plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tripleloom.operators import dictionary as D
from tripleloom.operators import graph as G
from tripleloom.operators import select as S
from tripleloom.sources import writers as W

ORDER = ["row_no", "head", "relation", "tail"]
EDGE = "row_no long, head string, relation string, tail string"


def shuffled(spark) -> int:
    """Files of shuffles on this machine."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_written_export_leaves_no_shuffle(spark, tmp_path):
    rows = [(i, f"n{i % 7}", "uses", f"m{i}", 0.5, None if i % 2 else f"s{i}") for i in range(200)]
    edges = spark.createDataFrame(rows, "row_no long, head string, relation string, tail string, confidence double, sentence string")
    before = shuffled(spark)
    W.write_json(W.export_edges(edges), f"{tmp_path}/edges", "gzip")
    for _ in range(50):
        if shuffled(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffled(spark) <= before
    assert list((tmp_path / "edges").glob("*.json.gz"))
    back = spark.read.json(f"{tmp_path}/edges", schema="source string, target string, confidence double, source_sentence string")
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(str((h, t, x, s)) for _, h, _, t, x, s in rows)
    W.write_json(W.export_edges(edges), f"{tmp_path}/plain")
    assert list((tmp_path / "plain").glob("*.json"))


def capped(rows, nodes, links):
    key = lambda r: tuple((x is not None, x) for x in r)
    names, pairs = {}, {}
    for r in sorted(rows, key=key):
        for name in (r[1], r[3]):
            names.setdefault(name, r)
        ends = [x for x in (r[1], r[3]) if x is not None]
        pairs.setdefault((min(ends, default=None), max(ends, default=None), r[2]), r)
    return list(names)[:nodes], list(pairs.values())[:links]


@pytest.mark.parametrize("few", [False, True])
def test_caps_of_a_graph_shuffle_first_rows_only(spark, few):
    rnd = random.Random(3)
    rows = [(i, f"h{rnd.randrange(30)}", rnd.choice("ab"), f"h{rnd.randrange(400)}") for i in range(3000)]
    if few:         # the first rows show too few names and links: all rows count
        rows = [(i, "x", "a", "y") if i < 2000 else r for i, r in enumerate(rows)] + [(2001, None, "a", "z"), (None, "u", "b", "v"), (2002, "q", None, "q")]
    names, links = S.graph_caps(spark.createDataFrame(rows, EDGE).repartition(5), ORDER)
    want_names, want_links = capped(rows, 20, 30)
    assert sorted(str(r["name"]) for r in names.collect()) == sorted(map(str, want_names))
    assert sorted(map(str, (tuple(r) for r in links.select(*ORDER).collect()))) == sorted(map(str, want_links))
    assert all("scalar-subquery" in plan(x) for x in (names, links))


@pytest.mark.parametrize("few", [False, True])
def test_edges_are_derived_once_for_links_by_degree(spark, monkeypatch, few):
    kept, real = [], S.staged
    monkeypatch.setattr(S, "staged", lambda df, *a: kept.append(df) or real(df, *a))
    rnd = random.Random(4)
    rows = [(i, f"n{rnd.randrange(20)}", "r", f"n{rnd.randrange(20)}") for i in range(300)] + [(300, None, "r", "n1"), (301, "n2", "r", None), (302, "n3", "r", "n3")]
    degree = {}
    for _, h, _, t in rows:
        for name in ([h] if h == t else [h, t]):
            degree[name] = degree.get(name, 0) + 1
    inside = {f"n{i}" for i in range(0, 20, 2)} | {"n3"}
    want = sorted(((-(degree[h] + degree[t]), no, h, r, t) for no, h, r, t in rows if h in inside and t in inside))[:40]
    chosen = spark.createDataFrame([(n,) for n in inside], "name string")
    got = S.links_by_degree(spark.createDataFrame(rows, EDGE), chosen, ORDER, 40, few=few)
    assert [(-r["score"], r["row_no"], r["head"], r["relation"], r["tail"]) for r in got.collect()] == want and len(kept) == 1


def test_a_sample_meets_links_where_they_lie(spark, monkeypatch):
    kept, real = [], G.staged
    monkeypatch.setattr(G, "staged", lambda df, *a: kept.append(df) or real(df, *a))
    edges = spark.createDataFrame([(i, f"n{i}", "r", f"n{(i * 7) % 50}") for i in range(50)] * 2, EDGE)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(50)], "name string")
    assert len(G.sample_nodes(edges, nodes, 10, 7).collect()) == 10
    assert len(kept) == 4                                   # each round reads the one before it, not all before it
    assert all("Aggregate [near" not in plan(x) for x in kept)


def test_evidence_reads_its_batch_once(spark):
    rows = [("t", r, 1, "h", "uses", f"x{r}", "Algorithm", None if r == 1 else "d", "", "p", None, None) for r in (1, 2)]
    batch = spark.createDataFrame(rows, "topic string, rank int, score int, head string, relation string, tail string, " + ", ".join(f"{a} string" for a in G.ATTRIBUTES))
    lines = G.evidence_lines(batch)
    assert sorted(tuple(r) for r in lines.collect()) == [
        ("t", -100, "属性-type：Algorithm"), ("t", -99, "属性-time_complexity：p"), ("t", 1, "关系1：h uses x1"), ("t", 2, "关系2：h uses x2")]
    assert plan(lines).count("LogicalRDD") + plan(lines).count("LocalRelation") == 1


def test_an_edge_seen_from_a_name_moves_its_other_end_only(spark):
    edges = spark.createDataFrame([(1, "a", "r", "b")], EDGE)
    seen = G.seen_from(edges, spark.createDataFrame([("a",), ("b",)], "near string"))
    assert sorted(tuple(r) for r in seen.collect()) == [(1, "a", "r", "b", "a"), (1, "a", "r", "b", "b")]
    join = seen._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().head()
    moved = join.children().head().output()
    assert {moved.apply(i).name() for i in range(moved.size())} == {"row_no", "relation", "near", "far", "forward"}


def test_words_of_a_scope_meet_its_texts_only(spark, monkeypatch):
    """However large the dictionary of all scopes is, it is not read part by part against all texts."""
    monkeypatch.setattr(D, "parts", lambda *a, **k: pytest.fail("the whole dictionary is taken to the driver"))
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abc数") for _ in range(n))
    topics = [*range(30), *[0] * 60, None]
    texts = [(i, rnd.choice(topics), word(20)) for i in range(400)] + [(5, 0, "abcabc"), (None, 0, "abc"), (401, 0, None), (402, 0, "")]
    words = [(rnd.choice(topics), rnd.choice([None, 1, 2, 3]), word(rnd.randint(0, 3)), i) for i in range(500)] + [(0, 1, None, 1)]
    want: dict = {}
    for k, topic, t in texts:
        for own, name, w, no in words:
            if topic is not None and own == topic and t is not None and w and w in t:
                want[k, name] = min(no, want.get((k, name), no))
    t = spark.createDataFrame(texts, "id long, topic long, text string")
    d = spark.createDataFrame(words, "topic long, canonical int, synonym string, dict_no int")
    for size in (None, 60):         # one list a scope, and many lists of the hot one
        assert {(r["id"], r["canonical"]): r["dict_no"] for r in D.hits(t, "id", "text", d, ["topic"], part_chars=size).collect()} == want
    assert D.hits(t, "id", "text", d.limit(0), ["topic"]).count() == 0


def test_a_batch_of_triples_is_held_small_and_goes(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from tripleloom.streaming import jobs

    def held(*_):
        raise RuntimeError("cached on the disks as it is")
    monkeypatch.setattr(DataFrame, "persist", held)
    monkeypatch.setattr(jobs, "shared_dir", lambda spark: f"{tmp_path}/held", raising=False)
    rows = [(1, "a", "x", "r", "b", "y"), (2, "a", "x", "r", "b", "y"), (3, "", "x", "r", "b", "y")]
    at = F.timestamp_seconds(F.col("row_no"))
    df = spark.createDataFrame(rows, "row_no long, head string, head_type string, relation string, tail string, tail_type string").withColumn("arrival", at)
    df.write.parquet(f"{tmp_path}/inbox")
    arriving = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/inbox")
    out, bad = f"{tmp_path}/out", f"{tmp_path}/bad"
    jobs.ingest_stream(arriving, "arrival", out, bad, f"{tmp_path}/check").awaitTermination()
    assert [r["row_no"] for r in jobs.stored(spark, out, df.schema).collect()] == [1]
    assert [r["reason"] for r in spark.read.parquet(f"{bad}/batch=0").collect()] == ["empty head"]
    assert not (tmp_path / "held").exists()
