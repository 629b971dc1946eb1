"""Dictionary matching against plain substring search."""

import random

import pytest
from pyspark.sql import functions as F

from tripleloom.operators import dictionary as D
from tripleloom.operators.joins import kg_membership
from tripleloom.operators.score import entity_recall


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_hits_equal_substring_search_in_any_number_of_parts(spark):
    rnd = random.Random(4)
    texts = [(i, "".join(rnd.choice("ab c数é") for _ in range(rnd.randint(0, 40)))) for i in range(300)] + [(7, "abab"), (None, "ab"), (301, None), (302, "")]
    words = [(f"C{i % 40}", "".join(rnd.choice("ab c数é") for _ in range(rnd.randint(0, 5))), i) for i in range(120)] + [("C1", None, 1), (None, "ab", 3)]
    want: dict = {}
    for k, t in texts:
        for name, word, no in words:
            if t is not None and word and word in t:
                want[k, name] = min(no, want.get((k, name), no))
    t, d = frame(spark, texts, "id long, text string"), frame(spark, words, "canonical string, synonym string, dict_no int")
    for size in (None, 800):
        got = {(r["id"], r["canonical"]): r["dict_no"] for r in D.hits(t, "id", "text", d, part_chars=size).collect()}
        assert got == want
    assert D.hits(t, "id", "text", d.limit(0)).count() == 0 and D.hits(t.limit(0), "id", "text", d).count() == 0


def test_scopes_own_their_words(spark):
    rnd = random.Random(5)
    texts = [(i, rnd.choice(["x", "y", None]), "".join(rnd.choice("abc") for _ in range(12))) for i in range(80)]
    words = [(rnd.choice(["x", "y", None]), f"N{i % 9}", "".join(rnd.choice("abc") for _ in range(3)), i) for i in range(60)]
    want: dict = {}
    for k, topic, t in texts:
        for own, name, word, no in words:
            if topic is not None and own == topic and word in t:
                want[k, name] = min(no, want.get((k, name), no))
    t, d = frame(spark, texts, "id long, topic string, text string"), frame(spark, words, "topic string, canonical string, synonym string, dict_no long")
    for size in (None, 100):
        assert {(r["id"], r["canonical"]): r["dict_no"] for r in D.hits(t, "id", "text", d, ["topic"], part_chars=size).collect()} == want


def test_ten_thousand_names_of_one_start(spark):
    """Only hits leave the tasks that read the texts: no start of a word is a candidate."""
    d = spark.range(10_000).selectExpr("concat('N', id) AS canonical", "concat('structure ', id, ';') AS synonym", "cast(id AS int) AS dict_no")
    t = spark.range(2000).selectExpr("id", "concat('a structure and structure ', id, '; or structure ', id + 5000, ' ends') AS text").cache()
    found = D.hits(t, "id", "text", d)
    assert found.count() == 2000 and found.where(F.col("canonical") != F.concat(F.lit("N"), "id")).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_hot_words_and_long_texts(spark):
    t = frame(spark, [(i, "the " * 50_000) for i in range(20)], "id long, text string")
    d = frame(spark, [("T", "the", 1), ("T", "he", 0), ("U", "the the", 2), ("V", "they", 3)], "canonical string, synonym string, dict_no int")
    got = sorted((r["id"], r["canonical"], r["dict_no"]) for r in D.hits(t, "id", "text", d).collect())
    assert got == sorted(x for i in range(20) for x in ((i, "T", 0), (i, "U", 2)))


@pytest.mark.parametrize("size", [None, 40])
def test_words_inside(spark, size):
    t = frame(spark, [("abc",), ("xyz",), (None,), ("abc",)], "name string")
    w = frame(spark, [("b",), ("b",), ("yz",), ("q",), ("",), (None,), ("abcd",)], "word string")
    assert sorted(r["word"] for r in D.words_inside(t, "name", w, "word", part_chars=size).collect()) == ["b", "yz"]
    assert D.words_inside(t, "name", w.limit(0), "word").count() == 0


def test_membership_and_recall_use_it(spark):
    names = frame(spark, [("tree",), ("graph",), ("heap",)], "name string")
    nodes = frame(spark, [("binary tree", "x"), ("a heap", "x")], "name string, type string")
    assert [(r["name"], r["rank"]) for r in kg_membership(names, nodes).orderBy("rank").collect()] == [("heap", 1), ("tree", 2), ("graph", 3)]
    got = {r["name"]: r["in_graph"] for r in kg_membership(names, nodes).collect()}
    assert got == {"tree": True, "heap": True, "graph": False}
    texts = frame(spark, [(1, "t", "tree and heap"), (2, "t", "none"), (3, "u", "tree")], "id int, topic string, text string")
    related = frame(spark, [("t", "tree"), ("t", "heap"), ("t", "heap"), ("u", "graph")], "topic string, name string")
    got = {r["id"]: (r["related"], r["found"]) for r in entity_recall(texts, related, "topic", "id", "text", "name").collect()}
    assert got == {1: (2, 2), 2: (2, 0), 3: (1, 0)}


def test_entries_of_a_word_are_kept_by_scope(spark):
    """A text looks at the names of its own scope, however many scopes share a word."""
    from tripleloom.operators.dictionary import hits, parts
    words = spark.createDataFrame([(s, "c", "word", 0) for s in range(50)] + [(None, "c", "word", 0)], "topic long, canonical string, synonym string, dict_no int")
    (part,) = parts(words, ["topic"])
    assert all(isinstance(e, dict) and len(e[(7,)]) == 1 for e in part.entries)
    texts = spark.createDataFrame([(1, "a word", 7), (2, "a word", None), (3, "a word", 99)], "id long, text string, topic long")
    assert [tuple(r) for r in hits(texts, "id", "text", words, ["topic"]).collect()] == [(1, "c", 0)]
