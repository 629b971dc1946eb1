"""Against every window compared with every other."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np

from tripleloom.llm import suffix_dedup as S

L = 400


def brute(texts, length=L):
    seen, out = Counter(), []
    whole = [(t or "").encode() for t in texts]
    for b in whole:
        seen.update(b[p:p + length] for p in range(len(b) - length + 1))
    for b in whole:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(words):
    rnd = random.Random(11)
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [text(90) for _ in range(4)]
    out = [None, "", "short", "a" * 399, "a" * 400, "a" * 401, "a" * 1000, "ab" * 600, "ü" * 500, "x" * 50 + "ü" * 450]
    for i in range(60):
        p = rnd.choice(passages)
        a, b = sorted((rnd.randrange(len(p)), rnd.randrange(len(p))))
        out.append(text(rnd.randrange(40)) + p[:a // 4] + p[b // 3:] + text(rnd.randrange(40)))
    for i in range(12):                                      # periodic runs of different words and lengths
        out.append("".join((rnd.choice(words) + " ") * rnd.randint(5, 90) for _ in range(4)))
    for i in range(20):                                      # copies with one byte changed
        b = list(out[10 + i])
        if b:
            b[rnd.randrange(len(b))] = "#"
        out.append("".join(b))
    one = text(400)
    out += [one, one, one[200:900], one[201:620], one[:399], one[:400], one[:401], one + one]
    return out


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return [tuple(r)[1:] for r in S.query(df).orderBy("doc_id").collect()]


def test_equals_brute_force(spark, words):
    texts = corpus(words)
    got, want = run(spark, texts), brute(texts)
    assert [i for i, (a, b) in enumerate(zip(got, want)) if a != b] == []
    assert sum(w[1] for w in want) > 20_000


def test_refined_intervals_give_common_prefixes():
    rnd = random.Random(5)
    rows = list({tuple(rnd.randrange(3) for _ in range(rnd.randint(1, 9))) for _ in range(300)})
    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = [max(common(a, b) for j, b in enumerate(rows) if i != j) for i, a in enumerate(rows)]
    assert S.refine([np.array(r, np.int64) for r in rows]).tolist() == want


def test_large_intervals_are_refined_in_rounds(spark, words, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    texts = corpus(words)[10:60]
    assert run(spark, texts) == brute(texts)


def test_clashing_columns_nulls_and_repeated_rows(spark, words):
    text = " ".join(words[:200])
    df = spark.createDataFrame([(None, text, 1, "x"), (3, text, 2, None), (3, text, 2, None), (4, None, 3, "y")],
                               "doc_id long, text string, h int, spans string")
    rows = S.without_repeats(df).collect()
    assert len(rows) == 4 and {r["text"] for r in rows} == {"", None} and S.without_repeats(df).columns == df.columns
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in S.query(df).collect()) == [(False, 0), (False, len(text)), (False, len(text)), (True, len(text))]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.query(df).count() == 0 and S.without_repeats(df).count() == 0


def test_cut_keeps_whole_characters():
    assert S.cut_text("aüaüaü", [{"start": 2, "end": 6}]) == "aüaü"
    assert S.cut_text("üü", [{"start": 1, "end": 3}]) == "üü" and S.cut_text(None, []) is None


def test_runs_equal_windows_one_by_one():
    rnd = random.Random(4)
    for n in (0, 100, 399, 400, 401, 700, 3000):
        for letters in ("a", "ab", "abcdefghij "):
            b = "".join(rnd.choice(letters) for _ in range(n)).encode()
            c = S.cuts(b)
            at, first, last = S.inner(c, len(b), L)
            want = [(max(1, sum(x - S.RADIUS + 1 <= p for x in c)), min(len(c) - 2, sum(x <= p + L - S.RADIUS - S.GRAM for x in c) - 1))
                    for p in range(max(0, n - L + 1))]
            runs = [p for p in range(len(want)) if p == 0 or want[p] != want[p - 1]]
            assert at.tolist() == runs and list(zip(first.tolist(), last.tolist())) == [want[p] for p in runs]


def test_ranges():
    assert S.spread(np.array([3, 9]), np.array([5, 10])).tolist() == [3, 4, 9] and not len(S.spread(np.zeros(0, int), np.zeros(0, int)))
    x, y = S.joined(np.array([0, 1, 5, 7, 9]), np.array([4, 2, 6, 9, 12]))
    assert x.tolist() == [0, 5, 7] and y.tolist() == [4, 6, 12]


def test_work_on_runs_does_not_grow_with_bytes():
    """A text without a cut is one run, however long."""
    b = b"a" * 2_000_000
    c = S.cuts(b)
    tracemalloc.start()
    try:
        w = S.Windows(b, c, [0], L)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(c) == 2 and w.at.tolist() == [0, len(b) - L + 1] and peak < 100_000
