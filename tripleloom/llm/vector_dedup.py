"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors of a label are one class.  Unit vectors are turned to principal axes, which keeps all
products, and dealt to cells by their first coordinates: two unit vectors with cosine >= t are at most
sqrt(2 - 2 t) apart, so a pair lies in one cell or in adjacent ones.  Cells are cut into tiles of
bounded size.  A pair of tiles is compared by leading dimensions first; the rest of a product is at
most the product of the norms of the two suffixes, and a pair is dropped, and a tile left, once its
cosine cannot reach t.  What survives is checked on the given vectors in double precision.

A pair of tiles gives a count for each vector and a spanning forest, not its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.session import staged
from tripleloom.llm.common import components, forest

LEADING = 2          # coordinates that make a cell
TILE = 1024
SAMPLE = 8192        # vectors the axes are fitted on, those with the smallest hash of their id
SLACK = 1e-9         # rounding that pruning allows for
STEP = 8             # dimensions accumulated before the first bound; doubled every time
SPARSE = 0.02        # share of pairs left below which they are followed one by one


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    x = vector.cast("array<double>")
    return (vector.isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
            & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False)))


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, strongest first) of each length, from at most SAMPLE vectors."""
    drawn = vectors.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("e").toPandas()["e"]
    out = {}
    for d in {len(v) for v in drawn}:
        x = unit([v for v in drawn if len(v) == d])
        out[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return out


def turned(vectors, turn: dict[int, np.ndarray]) -> np.ndarray:
    x = unit(vectors)
    return x @ turn[x.shape[1]] if x.shape[1] in turn else x


def linked(left: np.ndarray, right: np.ndarray, t: float):
    """Places (i, j) of row pairs whose product may reach ``t``; rows are unit vectors, strongest axes first."""
    d = left.shape[1]
    rest = [np.sqrt(np.maximum(0.0, np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1])) for x in (left, right)]
    rest = [np.hstack([r, np.zeros((len(r), 1))]) for r in rest]
    done, step, total = 0, STEP, np.zeros((len(left), len(right)))
    while done < d:
        to = min(d, done + step)
        total += left[:, done:to] @ right[:, done:to].T
        done, step = to, 2 * step
        alive = total + rest[0][:, done, None] * rest[1][None, :, done] >= t - SLACK
        n = np.count_nonzero(alive)
        if not n:
            return np.zeros(0, int), np.zeros(0, int)
        if n < SPARSE * alive.size:
            break
    i, j = np.nonzero(alive)
    total = total[i, j]
    while done < d and len(i):
        to = min(d, done + step)
        total = total + np.einsum("ij,ij->i", left[i, done:to], right[j, done:to])
        done, step = to, 2 * step
        keep = total + rest[0][i, done] * rest[1][j, done] >= t - SLACK
        i, j, total = i[keep], j[keep], total[keep]
    return i, j


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision, scaled so that neither very large nor very small vectors overflow."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def compare(rows: pd.DataFrame, turn: dict, t: float) -> pd.DataFrame:
    """One pair of tiles: (a, b) links of a spanning forest, and (a, n) linked vectors of class a."""
    left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
    out = {"a": [], "b": [], "n": []}
    if len(left) and len(right):
        i, j = linked(turned(left["e"], turn), turned(right["e"], turn), t)
        li, ri = left["cid"].to_numpy(), right["cid"].to_numpy()
        new = ~right["home"].to_numpy()[j] | (li[i] < ri[j])      # pairs inside a cell come both ways round
        i, j = i[new], j[new]
        le, re = (np.array([np.asarray(v, float) for v in x["e"]]) for x in (left, right))
        for lo in range(0, len(i), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            keep = cosine(le[i[part]], re[j[part]]) >= t
            i[part], j[part] = np.where(keep, i[part], -1), np.where(keep, j[part], -1)
        i, j = i[i >= 0], j[j >= 0]
        if len(i):
            ids, at = np.unique(np.concatenate([li, ri]), return_inverse=True)
            a, b = at[:len(li)][i], at[len(li):][j]
            sums = (np.bincount(a, right["n"].to_numpy()[j], len(ids)) + np.bincount(b, left["n"].to_numpy()[i], len(ids))).astype(np.int64)
            root = forest(len(ids), [(a, b)])
            child, some = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(sums)
            out = {"a": [*ids[child], *ids[some]], "b": [*ids[root[child]], *[None] * len(some)], "n": [*[None] * len(child), *sums[some]]}
    return pd.DataFrame(out).astype({"a": "int64", "b": "Int64", "n": "Int64"})


def tile_pairs(classes: DataFrame, turn: dict, t: float) -> DataFrame:
    """Rows of every pair of tiles that has to be compared: side 0 of a cell, side 1 of it or an adjacent one."""
    wide = math.sqrt(2 - 2 * t) + 1e-6

    @F.pandas_udf("array<long>")
    def cell(vectors: pd.Series) -> pd.Series:
        at: list = [None] * len(vectors)
        for d in {len(v) for v in vectors}:
            who = [i for i, v in enumerate(vectors) if len(v) == d]
            for i, c in zip(who, np.floor(turned([vectors.iloc[i] for i in who], turn)[:, :LEADING] / wide).astype(np.int64)):
                at[i] = np.pad(c, (0, LEADING - len(c)))
        return pd.Series(at)
    homes = staged(classes.withColumn("cell", cell(F.col("e"))))
    around = [[]]
    for _ in range(LEADING):
        around = [[*a, o] for a in around for o in (-1, 0, 1)]
    ahead = [a for a in around if a > [0] * LEADING]             # half of the neighbours: each pair of cells once
    offsets = F.array(*[F.array(*[F.lit(o).cast("long") for o in a]) for a in ahead])
    visits = homes.withColumn("o", F.explode(offsets)).withColumn("cell", F.zip_with("cell", "o", lambda c, o: c + o)).drop("o")
    others = homes.withColumn("home", F.lit(True)).unionByName(visits.withColumn("home", F.lit(False)))
    key = ["label", "dims", "cell"]
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(name))
    sizes = blocks(homes, "left_tiles").join(blocks(others, "right_tiles"), key)
    mine = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*key, "i", "j", "side", "home", "cid", "n", "e"]
    left = homes.join(sizes, key).withColumns({"i": mine("left_tiles"), "side": F.lit(0), "home": F.lit(True)}).withColumn("j", every("right_tiles"))
    right = others.join(sizes, key).withColumns({"j": mine("right_tiles"), "side": F.lit(1)}).withColumn("i", every("left_tiles"))
    return left.select(*columns).unionByName(right.select(*columns))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Only vectors of equal length and equal, non-null label are compared.  Null and zero vectors and
    those with null or non-finite components link with nothing.  Rows that repeat a vector link with
    one another like any equal vectors, and rows that share a vec_id share a component.  A row with a null
    vec_id links with nothing.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"), "label")
    good = rows.where(usable(F.col("e")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = staged(good.groupBy("label", "e").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n")).withColumn("dims", F.size("e")))
    turn = axes(classes)
    found = staged(tile_pairs(classes, turn, threshold).groupBy("label", "dims", "cell", "i", "j")
                   .applyInPandas(lambda pdf: compare(pdf, turn, threshold), "a long, b long, n long"))
    joined = components(found.where("b is not null").select("a", "b"))
    sums = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("more"))
    facts = (classes.join(joined, classes["cid"] == joined["node"], "left").join(sums, classes["cid"] == sums["a"], "left")
             .select("label", "e", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id")))
    alone = rows.where(~F.coalesce(usable(F.col("e")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    out = (good.join(facts, ["label", "e"]).select("vec_id", "n_links", "component_id")
           .unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(embeddings: DataFrame) -> DataFrame:
    """Links and components of every vector within its label."""
    return near_duplicates(embeddings)



ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.good AND b.good AND a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, low) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT links.b, reach.low FROM reach JOIN links ON reach.node = links.a),
low AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, low.low AS component_id, v.vec_id = low.low AS kept
FROM v JOIN low ON low.node = v.vec_id
"""
