"""Personal data: base spans against plain patterns, message passing against enumeration, consistency over a document."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tripleloom.llm import personal

# The patterns as stated, read from left to right without overlaps.
STATED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
          "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits),
                    "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), list(STATED).index(kind), m.end()))
    return sorted(out)


def line(spans):
    return ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_equal_the_stated_patterns():
    rnd = random.Random(2)
    texts = ["", " ", "a@b.c_d@e.f", "@@a@b.c", "x@y", "a@b..c", "a@b.c@d.e", "é.a@b.co", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.1.1.0000", "4716 1234-5678  9010", "+1 (017) 555-7713",
             "+1 2+3 4567890123", "++49 30 123456", "+1((((((((", "0" * 12, "0" * 19, "0" * 20, "4539 1488 0343 6467", "１２３.4.5.6 1.2.3.4", "٣.1.1.1.1"]
    texts += ["".join(rnd.choice("01 9.+-()@ab_%\n") for _ in range(rnd.randint(1, 80))) for _ in range(4000)]
    texts += ["".join(rnd.choice("0123456789 -") for _ in range(60)) for _ in range(500)]
    for t in texts:
        assert personal.base_spans(t) == plain(t), t


def test_query_equals_the_stated_patterns_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = personal.query(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in STATED] == [sum(s[1] == i for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert not base or set(line(base).split(",")) <= set(spans)
        starts = [(int(s.split(":")[1]), personal.KINDS.index(s.split(":")[0])) for s in spans]
        assert starts == sorted(starts)


def exact(words, field):
    """Marginals by adding up all kinds of all words."""
    n, total = len(words.kind), 0.0
    out, local = np.zeros((n, personal.LABELS)), field.local(words.shapes)
    for kinds in itertools.product(*[[k] if k else range(personal.LABELS) for k in words.kind.tolist()]):
        score = sum(local[i, k] for i, k in enumerate(kinds)) + sum(field.chain[kinds[i], kinds[j]] for i, j in words.chain) + sum(field.skip[kinds[i], kinds[j]] for i, j in words.skip)
        weight = np.exp(score)
        total += weight
        for i, k in enumerate(kinds):
            out[i, k] += weight
    return out / total


def some_field(scale=1.0):
    rng = np.random.default_rng(4)
    skip = rng.standard_normal((5, 5)) * scale
    return personal.Field(rng.standard_normal((personal.SHAPE_FEATURES, 5)) * scale, rng.standard_normal((5, 5)) * scale, (skip + skip.T) / 2)


@pytest.mark.parametrize("text", ["12 34 56", "12345 x 12345 y 12345", "+1 (017) 555-7713 and 555-7713 later", "a 1.2.3.4 b 12345 6789 c 12345"])
def test_message_passing_is_exact_without_loops(text):
    words = personal.Words([text])
    assert np.abs(personal.marginals(words, some_field()) - exact(words, some_field())).max() < 1e-4


def test_message_passing_is_near_with_loops():
    words = personal.Words(["12345 67890 x 12345 67890 y"])
    assert len(words.chain) + len(words.skip) == len(words.kind)
    assert np.abs(personal.marginals(words, some_field(0.4)) - exact(words, some_field(0.4))).max() < 0.02


def test_the_fit_is_at_the_top_of_the_penalised_pseudo_likelihood():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["call +1 (017) 555-7713 ", "at 1.2.3.4 or ", "1234 ", "x@y.zz ", "99999 555-7713 ", "word "]) for _ in range(30)) for _ in range(20)]
    counted = personal.Words(texts).patterns()
    patterns = [(*k, n) for k, n in sorted(counted.items())]
    field = personal.fit_field(patterns)

    def loss(f):
        out = personal.RIDGE / 2 * ((f.shape ** 2).sum() + (f.chain ** 2).sum() + (f.skip ** 2).sum())
        for shape, b, a, one, two, kind, n in patterns:
            score = f.shape[list(shape)].sum(axis=0)
            score = score + (f.chain[b] if b < 5 else 0) + (f.chain[:, a] if a < 5 else 0) + (f.skip[one] if one < 5 else 0) + (f.skip[two] if two < 5 else 0)
            out -= n * (score[kind] - np.log(np.exp(score).sum()))
        return out
    best, rng = loss(field), np.random.default_rng(1)
    for _ in range(60):
        skip = rng.standard_normal((5, 5))
        for size in (1e-2, 1e-1):
            other = personal.Field(field.shape + size * rng.standard_normal(field.shape.shape), field.chain + size * rng.standard_normal((5, 5)), field.skip + size * (skip + skip.T) / 2)
            assert loss(other) > best - 1e-3


def corpus():
    """Phones in full and their last eight digits again; other eight-digit numbers, which repeat too, stay ordinary."""
    rnd, rows = random.Random(8), []
    for i in range(400):
        number, other = (f"{rnd.randint(10 ** 7, 10 ** 8 - 1)}" for _ in range(2))
        rows.append((i, f"call +49 30 {number} or write. order {other} was sent, order {other} again and +49 30 {number} now"))
    return rows


def test_repeats_of_an_entity_are_found_and_equal_looking_numbers_are_not(spark):
    rows = corpus()
    full = rows[0][1]
    number, other = re.search(r"\+49 30 (\d+)", full).group(1), re.search(r"order (\d+)", full).group(1)
    asked = f"reach +49 30 {number} . note {number} here, note {number} there; order {other} stays {other}"
    docs = spark.createDataFrame([*rows, (1000, asked), (1001, f"order {number} alone")], "doc_id long, text string")
    got = {r["id"]: r["added"] for r in personal.find(docs).collect()}
    found = [(s["kind"], asked[s["start"]:s["end"]]) for s in got[1000]]
    assert found == [("phone", number), ("phone", number)]
    assert got[1001] == [] and all(not got[i] for i in range(400))
    masked = {r["id"]: r["text"] for r in personal.mask(docs).collect()}
    assert masked[1000] == f"reach <phone> . note <phone> here, note <phone> there; order {other} stays {other}"


def test_edges(spark):
    rows = [(None, "mail a@b.cc", "x"), (1, None, None), (1, "", "y"), (2, " \n", "y"), (2, "mail a@b.cc", "y"), (2, "mail a@b.cc", "y"), (3, "9" * 300_000, "z"), (4, "a" * 300_000 + "@", "z"),
            (5, "1 " * 100_000, "z"), (6, "(@" * 50_000, "z"), (7, "+1" * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = personal.query(docs).collect()
    assert len(got) == len(rows) and sum(r["n_email"] for r in got) == 3
    assert {r["spans"] for r in got if r["doc_id"] in (1,)} == {""}
    assert [r["spans"] for r in got if r["doc_id"] is None] == ["email:5:11"]
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert personal.query(docs.limit(0)).count() == 0
    assert personal.mask(docs.where("doc_id = 1")).collect()[0]["text"] in (None, "")
