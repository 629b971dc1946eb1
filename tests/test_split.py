"""Readers of single large files against the standard library, with splits of a few bytes."""

import csv
import io
import json
import random

import pytest

from tripleloom.sources import readers as R
from tripleloom.sources import split as S


@pytest.fixture(params=[40, 1 << 20])
def tiny(spark, request):
    """Splits of so many bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, f"{request.param}b")
    yield spark
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def texts(rnd, marks):
    return ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 9))) for _ in range(4)]


def test_csv_equals_the_standard_reader(tiny, tmp_path):
    rnd, want = random.Random(3), []
    for f in range(3):
        out = io.StringIO()
        w = csv.writer(out, lineterminator=["\n", "\r\n"][f % 2], quoting=csv.QUOTE_MINIMAL)
        w.writerow(["subject", "relation", "tail", "text"])
        for i in range(40):
            head, relation, tail, text = texts(rnd, 'ab,"\n é数')
            row = [f"h{i}{head}", f"r{relation}", f"t{tail}", f"s{text}"]
            w.writerow(row)
            want.append(tuple(row))
        (tmp_path / f"{f}.csv").write_bytes(out.getvalue().encode())
    got = [tuple(r) for r in R.triples_csv(tiny, str(tmp_path)).select("head", "relation", "tail", "sentence").collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_equal_the_standard_reader(tiny, tmp_path, indent):
    rnd, want = random.Random(4), []
    for f in range(2):
        rows = []
        for i in range(25):
            head, relation, tail, text = texts(rnd, 'ab,"\\\n{}[] é数')
            rows.append({"head": f"h{i}{head}", "predicate": f"r{relation}", "tail": f"t{tail}", "sentence": f"s{text}", "more": [{"x": [1, {"y": text}]}, "]}"]})
            want.append((f"h{i}{head}", f"r{relation}", f"t{tail}", f"s{text}"))
        (tmp_path / f"{f}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(f)))
    got = [tuple(r) for r in R.triples_json(tiny, str(tmp_path)).select("head", "relation", "tail", "sentence").collect()]
    assert sorted(got) == sorted(want)


def test_exported_graphs_and_offsets(tiny, tmp_path):
    rnd = random.Random(5)
    rel = [{"source": f"a{i}" + "".join(rnd.choice('{}"[]\\x') for _ in range(4)), "target": f"b{i}", "relation": "r", "properties": {"k": "}"}} for i in range(20)]
    graph = {"meta": {"n": {"x": 1}, "list": [[1], [2, [3]]]}, "nodes": [{"name": "}{", "labels": ["x"]}] * 5, "relationships": rel}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "g.json").write_text(json.dumps(graph))
    got = R.triples_json(tiny, str(tmp_path / "g"), exported=True).collect()
    assert sorted((r["head"], r["tail"]) for r in got) == sorted((x["source"], x["target"]) for x in rel)
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "o.json").write_text(json.dumps([{"sentence": "s}", "head": f"h{i}", "tail": "t", "relation": "r", "head_offset": i, "tail_offset": str(i)} for i in range(9)]))
    rows = R.offsets_json(tiny, str(tmp_path / "o")).collect()
    assert sorted((r["head"], r["head_offset"], r["tail_offset"]) for r in rows) == [(f"h{i}", i, i) for i in range(9)]


def test_lines_single_objects_and_empty_files(tiny, tmp_path):
    (tmp_path / "a.json").write_text('{"head": "a", "relation": "r", "tail": "b"}\n{"head": "c",\n "relation": "r", "tail": "d"}\n')
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text(' {"head": "e", "relation": "r", "tail": "f"}')
    assert sorted(r["head"] for r in R.triples_json(tiny, str(tmp_path)).collect()) == ["a", "c", "e"]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    row = '"a\nb","r","t","' + "x" * 200 + '"\n'
    (tmp_path / "a.csv").write_text("head,relation,tail,sentence\n" + row * 4000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000b")
    try:
        assert S.pieces(spark, str(tmp_path), "\n").rdd.getNumPartitions() >= 8
        assert R.triples_csv(spark, str(tmp_path)).where("head = 'a\nb'").count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
