"""No hidden caps, readers on files as they occur, ranks beyond 2^23 rows, late arrivals."""

from pyspark.sql import functions as F

from tripleloom.functions.skew import ranked
from tripleloom.operators import clean as C
from tripleloom.operators import graph as G
from tripleloom.sources import readers as R
from tripleloom.streaming import jobs


def hub(spark, n=1500):
    edges = spark.range(n).select(F.col("id").alias("row_no"), F.lit("hub").alias("head"), F.lit("r").alias("relation"),
                                  F.concat(F.lit("t"), F.col("id").cast("string")).alias("tail"), F.lit(0.9).alias("confidence"))
    names = edges.select(F.col("tail").alias("name")).unionByName(spark.createDataFrame([("hub",)], "name string"))
    nodes = names.select("name", *[F.lit("x" * 400).alias(a) for a in G.ATTRIBUTES])
    return edges, nodes


def test_a_hub_is_returned_whole(spark):
    edges, nodes = hub(spark)
    asked = spark.createDataFrame([(1, "find_entity_by_relation_and_entity", "hub", None, "r")], "id int, intent string, e1 string, e2 string, relation string")
    intent = [n for n, _ in __import__("tripleloom.functions.constants", fromlist=["x"]).INTENT_KEYWORDS][1]
    assert G.route(asked.withColumn("intent", F.lit(intent)), edges, nodes).count() == 1500
    questions = spark.createDataFrame([("q", ["hub"], None)], "question string, names array<string>, relation string")
    assert G.answer_questions(edges, questions).count() == 1500
    assert G.answer_questions(edges, questions, limit=7).count() == 7
    assert G.entity_relations(edges, nodes, "hub").count() == 1500
    assert G.entities_by_relation(edges, nodes, ["none"] * 60 + ["hub"], "r").count() == 1500
    assert G.relations_between(edges, nodes, "hub", "t").count() == 3000 // 2 + 1500
    assert G.entity_relations_exact(edges, ["hub"]).count() == 1500
    assert G.relation_lines(G.entities_by_relation(edges, nodes, ["hub"], "r"), ["row_no"]).agg(F.max("no")).first()[0] == 1500
    batch = G.context_batch(edges, nodes, spark.createDataFrame([("hub",)], "name string"), words=["r"])
    assert batch.select(F.max(F.length("description"))).first()[0] == 400


def test_names_are_whole(spark):
    df = spark.createDataFrame([(["n" * 150] + [f"w{i}" for i in range(80)],)], "names array<string>")
    got = df.select(C.validate_entities(F.col("names"))).first()[0]
    assert len(got) == 81 and len(got[0]) == 150
    assert len(df.select(C.validate_entities(F.col("names"), most=5)).first()[0]) == 5


def test_relation_by_full_name(spark):
    df = spark.createDataFrame([("uses",), ("I think it is part of",), ("us",), ("x",)], "a string")
    out = [r[0] for r in df.select(C.valid_relation(F.col("a"), ["uses", "user of", "part of"], "none")).collect()]
    assert out == ["uses", "part of", "none", "none"]


def test_ranks_beyond_eight_million(spark):
    n = 9_000_000
    df = spark.range(n).select(((F.col("id") * 7_368_787) % n).alias("o"))
    assert ranked(df, [], ["o"], buckets=8).where(F.col("rank") != F.col("o") + 1).count() == 0


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'head,relation,tail,sentence\r\na,r,b,"one\r\ntwo, ""three"""\r\nc,r,d,\r\n')
    rows = {r["head"]: r["sentence"] for r in R.triples_csv(spark, str(tmp_path)).collect()}
    assert rows["a"].replace("\r\n", "\n") == 'one\ntwo, "three"' and rows["c"] is None


def test_token_tags_as_they_occur(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"-DOCSTART- O\n\na B-X\nb I-X\n-DOCSTART- O\nc O\n\n\nd O\n")
    (tmp_path / "b.txt").write_bytes(b"e x O\r\nf x B-Y\r\n\r\ng x O")
    got = sorted((r["tokens"], r["tags"]) for r in R.conll(spark, str(tmp_path)).collect())
    assert got == [(["a", "b"], ["B-X", "I-X"]), (["c"], ["O"]), (["d"], ["O"]), (["e", "f"], ["O", "B-Y"]), (["g"], ["O"])]


def test_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"head": "a", "relation": "r", "tail": "b"},\n {"head": "c", "relation": "r", "tail": "d"}\n]')
    assert sorted(r["head"] for r in R.triples_json(spark, str(tmp_path)).collect()) == ["a", "c"]


def test_late_triples_stay(spark, tmp_path):
    src, out, bad, check = (str(tmp_path / x) for x in ("in", "out", "bad", "check"))
    rows = spark.createDataFrame([(i, f"h{i % 50}", "r", "t", i * 10_000) for i in range(100)], "row_no long, head string, relation string, tail string, at long")
    rows = rows.selectExpr("row_no", "head", "relation", "tail", "timestamp_seconds(at) AS arrival")
    rows.orderBy(F.desc("row_no")).coalesce(1).limit(60).write.parquet(src)
    rows.where("row_no < 50").write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.ingest_stream(stream, "arrival", out, bad, check).awaitTermination()
    assert jobs.stored(spark, out, rows.schema).count() == 50


def test_exploded_tokens_are_not_broadcast(spark, tmp_path):
    """Their size is that of a few texts to the optimiser, whatever they are multiplied to."""
    from pyspark.sql import functions as F

    from tripleloom.functions.tags import find_all, spans_to_tags
    texts = spark.createDataFrame([(1, "the que of eux"), (2, "que"), (3, None)], "k long, text string")
    texts.write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")           # files, whose size the optimiser knows
    chars = texts.select("k", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    spans = texts.select("k", F.explode(find_all(F.col("text"), "que")).alias("start")).select("k", "start", (F.col("start") + 3).alias("end"), F.lit("q").alias("type"), F.lit(1).alias("no"))
    out = spans_to_tags(chars, spans, "k", "pos").where("tag <> 'O'")
    assert sorted((r["k"], r["pos"], r["tag"]) for r in out.collect()) == [(1, 4, "B-q"), (1, 5, "I-q"), (1, 6, "I-q"), (2, 0, "B-q"), (2, 1, "I-q"), (2, 2, "I-q")]
    assert "Broadcast" not in out._jdf.queryExecution().toString()


def test_tagged_files_are_read_in_splits(spark, tmp_path):
    """Sentences cut by splits come back whole, with edges anywhere and either line end, and no line is shuffled."""
    import random
    rng = random.Random(5)
    want = []
    for n, end in enumerate(("\n", "\r\n", "\n")):
        lines, sentence = [], []
        for i in range(400):
            if rng.random() < (0.3, 0.02, 0.0)[n]:
                lines.append(rng.choice(["", "  ", "-DOCSTART- O"]))
                want += [sentence] if sentence else []
                sentence = []
            else:
                lines.append(f"w{n}_{i} x  T{i % 7}")
                sentence = [*sentence, (f"w{n}_{i}", f"T{i % 7}")]
        want += [sentence] if sentence else []
        (tmp_path / f"f{n}.txt").write_bytes((end.join(lines) + end).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "300")
        out = R.conll(spark, str(tmp_path))
        got = [list(zip(r["tokens"], r["tags"])) for r in out.collect()]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(got) == sorted(want)
    assert "MapInPandas" in plan and "_ps_bucket" not in plan


def test_first_rows_move_only_what_is_selected(spark):
    from tripleloom.functions.skew import first_seen
    rows = [("a", 2, 0.1, "x"), ("a", 1, 0.2, "y"), ("a", 1, None, "z"), ("b", None, 0.5, "n"), ("b", 0, 0.4, "m"), (None, 7, 0.3, "k")]
    df = spark.createDataFrame(rows, "k string, no long, conf double, s string")
    got = first_seen(df, ["k"], ["no", "conf"])
    assert {tuple(r) for r in got.collect()} == {("a", 1, None, "z"), ("b", None, 0.5, "n"), (None, 7, 0.3, "k")}
    plan = got.select("k", "no")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_edges_are_derived_once_for_both_ends(spark):
    rows = [("a", "b"), ("b", "a"), ("c", "c"), (None, "a"), ("a", None), ("d", "e")]
    edges = spark.createDataFrame(rows, "head string, tail string").distinct()
    names = spark.createDataFrame([("a",), ("c",)], "near string")
    seen = G.seen_from(edges, names)
    assert sorted(map(str, (tuple(r) for r in seen.collect()))) == sorted(map(str, [("a", "b", "a"), ("b", "a", "a"), ("c", "c", "c"), ("a", None, "a")]))
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_islands_do_not_broadcast_tokens(spark, tmp_path, monkeypatch):
    from tripleloom.functions import skew
    from tripleloom.operators.select import tag_islands
    plans, real = [], skew.staged
    monkeypatch.setattr(skew, "staged", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    spark.createDataFrame([(1, "B-x I-x O I-y"), (2, "O")], "doc long, text string").write.parquet(f"{tmp_path}/texts")
    tokens = spark.read.parquet(f"{tmp_path}/texts").select("doc", F.posexplode(F.split("text", " ")).alias("pos", "tag"))
    assert sorted(tuple(r) for r in tag_islands(tokens, "doc", "pos", "tag").collect()) == [(1, 0, 2, "x"), (1, 3, 4, "y")]
    assert plans and "BroadcastHashJoin" not in plans[0]


def test_an_inbox_is_read_in_batches_of_its_files(spark, tmp_path):
    from types import SimpleNamespace

    from tripleloom.plans.queries_io import _arrived
    spark.range(100).repartition(10).write.parquet(f"{tmp_path}/inbox")
    schema, files = _arrived(SimpleNamespace(spark=spark), f"{tmp_path}/inbox", 4)
    assert files == 3 and schema.names == ["id"]
