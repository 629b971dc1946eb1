"""Whitening against exact sums and a standard eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tripleloom.llm import whitening

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def whole(v):
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return tuple(math.floor(256 * float(c)) for c in v)


def brute(rows, components=4):
    """Exact figures by plain Python, components by a standard solver; rows (id, vector) of one length."""
    usable = [(i, whole(v)) for i, v in rows if whole(v)]
    fit = sorted({x for _, x in usable})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = {x: np.array([float(Fraction(n * x[k] - sums[k], n)) for k in range(d)]) for x in fit}
    y = np.array([centred[x] for x in fit])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in usable:
        for k in range(len(values)):
            out.setdefault((i, k + 1), []).append((n, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), float(centred[x] @ vectors[:, k] / math.sqrt(values[k])),
                                                   values[k] / np.trace(v)))
    return out


def check(got, want, tolerance=1e-8):
    seen, signs = {}, {}
    for r in got:
        seen.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert seen.keys() == want.keys()
    for key, rows in seen.items():
        assert len(rows) == len(want[key])
        for r, (n, deviation, white, explained) in zip(rows, want[key]):
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert abs(r["explained"] - explained) <= 1e-9 * explained and r["identity_error"] <= 1e-8
            if abs(white) > 0.1:
                signs.setdefault(key[1], set()).add(r["whitened"] * white > 0)
            assert abs(abs(r["whitened"]) - abs(white)) < tolerance
    assert all(len(s) == 1 for s in signs.values())


def test_query_equals_exact_sums_and_a_standard_solver(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = whitening.query(table)
    assert got.columns == NAMES
    check(got.collect(), brute([(r["vec_id"], r["embedding"]) for r in table.collect()]))


def test_large_offsets_lose_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(1e9 + a), float(b), float(-2e7 + 100 * c)]) for i, (a, b, c) in enumerate(rng.standard_normal((60, 3)))]
    check(whitening.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), brute(rows), 1e-6)


def test_edges(spark):
    rows = [(1, [0.5, 1.0], 1, "a"), (1, [0.5, 1.0], 1, "a"), (2, [0.25, -1.0], 2, None), (None, [3.0, 2.0], 3, "b"), (3, None, 4, "c"), (4, [1.0, None], 5, "c"),
            (5, [float("nan"), 1.0], 6, "d"), (6, [float("inf"), 1.0], 7, "d"), (7, [], 8, "e")]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, component string")
    got = whitening.query(given).collect()
    check(got, brute([r[:2] for r in rows if r[1]]), 1e-9)
    assert len(got) == 8 and {r["vec_id"] for r in got} == {1, 2, None}
    assert whitening.query(given.limit(0)).count() == 0
    assert whitening.query(given.where("vec_id = 3")).count() == 0


def test_no_variance_and_lengths_apart(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, [1.0]), (4, [2.0]), (5, [0.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 4 * 2 + 3
    assert all(r["whitened"] == 0 and r["explained"] == 0 and r["n"] == 1 for k, r in got.items() if k[0] in (1, 2))
    assert got[5, 1]["n"] == 3 and abs(abs(got[4, 1]["whitened"]) - math.sqrt(1.5)) < 1e-12 and got[3, 1]["explained"] == 1.0


def test_sums_beyond_a_long(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e15, 2.0])]
    got = whitening.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] != 3) and all(math.isfinite(r["whitened"]) for r in got)


@pytest.mark.parametrize("size", [1, 2, 5, 40])
@pytest.mark.parametrize("kind", ["random", "equal", "steep", "pairs", "zero", "tie"])
def test_divide_and_conquer_equals_a_standard_solver(size, kind):
    rng = np.random.default_rng(size)
    values = {"random": rng.random(size), "equal": np.ones(size), "steep": 10.0 ** -np.arange(size), "pairs": np.repeat(rng.random(size), 2)[:size], "zero": np.zeros(size),
              "tie": 1 + 1e-13 * np.arange(size)}[kind]
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, vectors = whitening.eigen(v)
    assert np.abs(got - np.linalg.eigvalsh(v)[::-1]).max() < 1e-13 and (np.diff(got) <= 0).all()
    assert np.abs(v @ vectors - vectors * got).max() < 1e-13 and np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13


def test_polar_factor_is_a_sign():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - (vectors * np.sign(values)) @ vectors.T).max() < 1e-11
