"""Whitening of vectors through QDWH spectral divide and conquer.

Two passes over the distinct vectors give their exact sums and their covariance, centred before it is
multiplied; only matrices of the vectors' length leave a task.  The covariance V is split without a
standard eigensolver: the unitary polar factor U of V - s, found by dynamically weighted Halley steps
that need only QR factorisations, has eigenvalue 1 where V's exceeds s and -1 elsewhere, so (U + 1) / 2
projects on an invariant subspace and its complement.  Either part of V is split again until single
directions, or blocks that are a multiple of the identity to rounding, are left.  The components are
then broadcast (vector length times components) and applied to every row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.session import staged

COMPONENTS = 4
STEPS = 12               # of a polar decomposition; about 6 suffice for any condition number
EPS = float(np.finfo(float).eps)
SCALE = 256
RANK = 1e-12             # a component whose eigenvalue is a smaller share of the largest carries rounding only
SHARES = 64              # parts of a matrix row's sum, so that no group holds a row of every task's matrix


def polar(x: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix by QR-based dynamically weighted Halley iteration."""
    d = len(x)
    x = x / max(np.linalg.norm(x, 2) * (1 + 1e-12), np.finfo(float).tiny)
    low = EPS                                            # lower bound of the singular values; smaller ones are undecided anyway
    for _ in range(STEPS):
        t = np.cbrt(4 * (1 - low * low) / low ** 4)
        a = np.sqrt(1 + t) + 0.5 * np.sqrt(max(0.0, 8 - 4 * t + 8 * (2 - low * low) / (low * low * np.sqrt(1 + t))))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(d)]))[0]
        new = (b / c) * x + ((a - b / c) / np.sqrt(c)) * (q[:d] @ q[d:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (a + b * low * low) / (1 + c * low * low))
        if 1 - low < 10 * EPS and moved < 10 * EPS * d:
            break
    return x


def split(v: np.ndarray, at: float, noise: float) -> tuple[np.ndarray, int] | None:
    """Orthonormal basis whose first k columns span the subspace of eigenvalues above ``at``; None if ``at`` is too near one."""
    d = len(v)
    project = (polar(v - at * np.eye(d)) + np.eye(d)) / 2
    k = int(round(float(np.trace(project))))
    if k in (0, d):
        return np.eye(d), k
    basis = np.linalg.qr(project @ np.random.default_rng(d).standard_normal((d, k)))[0]
    basis = np.linalg.qr(project @ basis)[0]
    basis = np.linalg.qr(project @ basis, mode="complete")[0]           # the other columns span the complement
    coupled = np.linalg.norm(basis[:, k:].T @ v @ basis[:, :k])
    return (basis, k) if coupled <= noise else None


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    d = len(v)
    noise = 8 * EPS * max(1, d) * float(np.linalg.norm(v, 2)) if d else 0.0
    values, vectors, todo = [], [], [(np.eye(d), (v + v.T) / 2)]
    while todo:
        frame, block = todo.pop()
        m = len(block)
        centre = float(np.trace(block)) / m if m else 0.0
        if m <= 1 or np.linalg.norm(block - centre * np.eye(m)) <= noise:
            values += [float(x) for x in np.diag(block)]
            vectors += [*frame.T]
            continue
        reach = np.abs(block).sum(axis=1) - np.abs(np.diag(block))
        low, high = float((np.diag(block) - reach).min()), float((np.diag(block) + reach).max())
        at, found = float(np.median(np.diag(block))), None
        for attempt in range(200):
            found = split(block, at, noise)
            if found and 0 < found[1] < m:
                break
            if found:                                    # all on one side: the bracket of the eigenvalues shrinks
                low, high = (at, high) if found[1] == m else (low, at)
                at = (low + high) / 2
            else:                                        # too near an eigenvalue: another place of the bracket
                at = low + (high - low) * ((attempt + 1) * 0.6180339887498949 % 1.0)
            found = None
        if found is None:                                # eigenvalues closer than any shift can part: equal to rounding
            values += [float(x) for x in np.diag(block)]
            vectors += [*frame.T]
            continue
        basis, k = found
        turned = basis.T @ block @ basis
        turned = (turned + turned.T) / 2
        todo += [(frame @ basis[:, :k], turned[:k, :k]), (frame @ basis[:, k:], turned[k:, k:])]
    columns = np.array(vectors).T if vectors else np.zeros((d, 0))
    order = np.argsort(-np.array(values), kind="stable")
    columns = columns[:, order]
    sign = np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(columns.shape[1])]) if d else np.ones(0)
    return np.array(values)[order], columns * np.where(sign == 0, 1, sign)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of every component, null if the vector is null or any component is null or not finite.

    Components beyond the range of a long count as its ends."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = float(2 ** 63)
    kept = F.transform(x, lambda c: F.when(c * scale >= most, F.lit(2 ** 63 - 1)).when(c * scale < -most, F.lit(-2 ** 63)).otherwise(F.floor(c * scale).cast("long")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), kept)


class Model:
    """What whitening needs, for vectors of one length: row count, exact sums, and components."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums, self.size = n, sums, len(sums)
        self.near = [(2 * s + n) // (2 * n) for s in sums]                         # the integer next to each mean, and what is left
        self.rest = np.array([float((s - n * m)) / n for s, m in zip(sums, self.near)])
        self.error = 0.0
        self.values, vectors = eigen(covariance)
        k = min(components, self.size)
        self.total = float(np.trace(covariance))
        self.values, self.vectors = self.values[:k], vectors[:, :k]
        self.real = self.values > RANK * max(float(self.values[0]), 0.0) if k else np.zeros(0, bool)
        root = np.sqrt(np.where(self.real, self.values, 1.0))
        self.turn = np.where(self.real, self.vectors / root, 0.0)
        self.explained = self.values / self.total if self.total > 0 else np.zeros(k)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.near, self.rest)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over components of (n x - S)^2, exact; null where a long cannot hold it."""
        if not len(x):
            return []
        most = max(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max((abs(s) for s in self.sums), default=0), 1)
        if most * most * max(1, self.size) < 2 ** 63:
            off = x * self.n - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        off = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) if v < 2 ** 63 else None for v in (off * off).sum(axis=1)]


def centred(x: np.ndarray, near: list[int], rest: np.ndarray) -> np.ndarray:
    """x - S / n without cancellation: whole numbers are subtracted as such."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), max((abs(m) for m in near), default=0))
    whole = x - np.array(near, np.int64) if most < 2 ** 61 else (x.astype(object) - np.array(near, object)).astype(float)
    return whole.astype(float) - rest


def matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in rows]) if len(rows) else np.zeros((0, 0), np.int64)


def by_size(batch: pd.DataFrame):
    for size, rows in batch.groupby("size"):
        yield int(size), rows


def sums_of(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Of each length of vectors: how many there are, and the exact sum of every component."""
    each = fit.select("size", F.posexplode("x").alias("i", "v")).groupBy("size", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.orderBy("size", "i").collect():                     # as many rows as a vector has components
        out.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    return out


def products(fit: DataFrame, centre: dict[int, tuple], turn: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Sum of y y' over centred vectors y, turned first where ``turn`` says so."""
    def of(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, rows in by_size(batch):
                y = centred(matrix(rows["x"]), *centre[size])
                y = y @ turn[size] if size in turn else y
                held[size] = held.get(size, 0) + y.T @ y
        for size, m in held.items():
            yield pd.DataFrame({"size": size, "i": np.arange(len(m), dtype=np.int32), "row": [*m]})
    parts = fit.mapInPandas(of, "size int, i int, row array<double>")
    parts = parts.withColumn("part", F.floor(F.rand(1) * SHARES).cast("int")).select("size", "i", "part", F.posexplode("row").alias("j", "v"))
    total = parts.groupBy("size", "i", "j", "part").agg(F.sum("v").alias("v")).groupBy("size", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for size, rows in total.groupby("size"):                          # vector length squared
        m = np.zeros((rows["i"].max() + 1, rows["j"].max() + 1))
        m[rows["i"], rows["j"]] = rows["v"]
        out[int(size)] = m
    return out


def fit_models(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """Models of the distinct vectors ``fit`` (size, x), one for each length, with the error of their whitening measured."""
    sums = sums_of(fit)
    centre = {}
    for size, (n, s) in sums.items():
        near = [(2 * v + n) // (2 * n) for v in s]
        centre[size] = near, np.array([float(v - n * m) / n for v, m in zip(s, near)])
    squares = products(fit, centre, {})
    models = {size: Model(n, s, squares[size] / n, components) for size, (n, s) in sums.items()}
    white = products(fit, centre, {size: m.turn for size, m in models.items()})
    for size, m in models.items():
        off = white[size] / m.n - np.eye(len(m.values))
        m.error = float(np.abs(off[np.ix_(m.real, m.real)]).max()) if m.real.any() else 0.0
    return models


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): up to ``components`` rows for each usable vector.

    Vectors that are null or hold null or non-finite components give no rows, nor do vectors without components; vectors of another
    length are fitted apart.  Every distinct vector of whole numbers counts once in the fit, however often it occurs; rows that
    repeat an id or vector, null ids included, each have their own results.  A component without variance (fewer distinct vectors than
    components) is 0 for every row and left out of ``identity_error``.  ``deviation`` is exact, and null beyond the range of a long.
    Only the two columns named are read.  A task holds one matrix of a vector's length squared, as does the driver.
    """
    rows = vectors.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col), scale).alias("x")).where("size(x) > 0")
    rows = staged(rows.withColumn("size", F.size("x")))
    models = fit_models(staged(rows.select("size", "x").distinct()), components)
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def of(batches):
        for batch in batches:
            for size, part in by_size(batch):
                m, x = shared.value[size], matrix(part["x"])
                k = len(m.values)
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)), "n": m.n,
                                    "deviation": pd.array(np.repeat(np.array(m.deviation(x), object), k), dtype="Int64"),
                                    "whitened": (m.centred(x) @ m.turn).ravel(), "explained": np.tile(m.explained, len(part)), "identity_error": m.error})
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(of, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(embeddings: DataFrame) -> DataFrame:
    """Four whitened components of every usable vector of the table."""
    return whiten(embeddings).withColumnRenamed("id", "vec_id")
