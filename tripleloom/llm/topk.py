"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are turned into integers and cut into blocks.  In a block every dimension is a sorted list of
the candidates; a query reads all lists in step, from the top where its component is positive and from
the bottom where it is negative.  What has been read of a candidate, with the smallest and the largest
value the rest can have, bounds its score from below and above.  Reading stops when the number of
candidates whose upper bound reaches the k-th lower bound is small (or the lists end); only those are
resolved to final scores.  All queries of a block are read in step, as matrix products over what has
been seen, which is exact in doubles while scores stay below 2^53; beyond that, integers are used.

Candidates are shuffled once, to their blocks, and stay there.  Queries come to them, as many at a time as
may be broadcast, and a task carries each query's k-th best score from block to block, so that in later
blocks reading stops sooner, or right away, for outsiders of the whole so far.  A task gives at most k rows a query,
which are ranked at the end.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.session import staged
from tripleloom.functions.skew import top_k

CANDIDATES = 4096        # rows of a block of sorted lists, on average,
BLOCK_BYTES = 16 << 20   # or fewer, if their components are more than so many bytes
QUERIES = 8192           # queries that are broadcast at a time, on average, or fewer by the same bound
DEPTHS = (64, 256, 1024, 4096)      # entries of each list read before the bounds are looked at again; then the lists to their end
FEW = 4                  # times k candidates left: resolve
CELLS = 1 << 22          # of a table of bounds, queries times candidates


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component; null when the vector is null or holds null or non-finite components."""
    whole = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale))
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, whole)


def nearest(lists: "Lists", queries: np.ndarray, own: np.ndarray, k: int, known: np.ndarray):
    """For each query (rows of ``queries``) the candidates that can be among its k best, with scores.

    ``known``: a score that a query's k best are known to reach."""
    n, plus, minus = len(lists.x), np.maximum(queries, 0), np.minimum(queries, 0)
    left = np.arange(len(queries))
    for depth in (*(d for d in DEPTHS if d < n), n):
        end = depth == n
        top, bottom = lists.seen(depth)
        lower = plus[left] @ np.where(top, lists.x, 0).T + minus[left] @ np.where(bottom, lists.x, 0).T
        if end:
            upper, floor = lower, lower
        else:
            best, worst = lists.heads(depth)
            high = plus[left] * best[0] + minus[left] * best[1]       # the most an unread entry adds, by list
            low = plus[left] * worst[0] + minus[left] * worst[1]
            unread = [(plus[left] > 0).astype(float), (minus[left] < 0).astype(float)]
            upper = lower + (high * unread[0]) @ (~top).T + (high * unread[1]) @ (~bottom).T
            floor = lower + (low * unread[0]) @ (~top).T + (low * unread[1]) @ (~bottom).T
        mine = own[left][:, None] == lists.ids[None, :]
        floor = np.where(mine, -np.inf, floor)
        bar = np.partition(floor, n - k, axis=1)[:, n - k] if n > k else np.full(len(left), -np.inf)
        bar = np.maximum(bar, known[left])
        alive = (upper >= bar[:, None]) & ~mine
        done = (alive.sum(axis=1) <= max(FEW * k, 16)) | end
        for at in np.flatnonzero(done):
            who = np.flatnonzero(alive[at])
            yield left[at], who, lists.x[who] @ queries[left[at]]
        left = left[~done]
        if not len(left):
            return


class Lists:
    """A block of candidates and its sorted lists."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        n = len(x)
        self.sorted = np.sort(x, axis=0)
        self.rank = np.empty(x.shape, np.int32)
        np.put_along_axis(self.rank, np.argsort(x, axis=0, kind="stable"), np.arange(n, dtype=np.int32)[:, None], axis=0)

    def seen(self, depth: int):
        return self.rank >= len(self.x) - depth, self.rank < depth

    def heads(self, depth: int):
        """Per list: the values next to be read from the top and from the bottom, and the last ones."""
        s = self.sorted
        return (s[len(s) - depth - 1], s[depth]), (s[0], s[-1])


class Asked:
    """Queries of one length with the best candidates they have met."""

    def __init__(self, q: np.ndarray, own: np.ndarray, k: int):
        self.q, self.own, self.k = q, own, k
        self.ids: list = [np.zeros(0, np.int64)] * len(q)
        self.scores: list = [np.zeros(0, np.int64)] * len(q)
        self.known = np.full(len(q), -np.inf)
        self.most = float(np.abs(q).max(initial=0))

    def meet(self, x: np.ndarray, ids: np.ndarray) -> None:
        """The candidates of a block (``x``: whole numbers)."""
        if not len(x) or not len(self.q):
            return
        if float(np.abs(x).max(initial=0)) * self.most * max(1, x.shape[1]) >= 2.0 ** 53:       # too large for doubles: plain integers
            found = ((i, np.flatnonzero(ids != self.own[i])) for i in range(len(self.q)))
            found = ((i, who, x[who] @ self.q[i]) for i, who in found)
            self.known[:] = -np.inf
        else:
            step = max(1, CELLS // len(x))
            found = (f for at in range(0, len(self.q), step) for f in self.part(x, ids, at, at + step))
        for i, who, score in found:
            score = np.concatenate([self.scores[i], score.astype(np.int64)])
            named = np.concatenate([self.ids[i], ids[who]])
            keep = np.lexsort((named, -score))[:self.k]
            self.ids[i], self.scores[i] = named[keep], score[keep]
            if len(keep) == self.k and abs(int(score[keep[-1]])) < 2 ** 53:
                self.known[i] = score[keep[-1]]

    def part(self, x: np.ndarray, ids: np.ndarray, lo: int, hi: int):
        """Queries lo to hi, so many that a table of bounds stays small."""
        lists = self.lists(x, ids)
        for i, who, score in nearest(lists, self.q[lo:hi].astype(float), self.own[lo:hi], self.k, self.known[lo:hi]):
            yield lo + i, who, score

    def lists(self, x: np.ndarray, ids: np.ndarray) -> Lists:
        if getattr(self, "read", (None, None))[0] is not x:
            self.read = x, Lists(x.astype(float), ids)
        return self.read[1]

    def rows(self) -> pd.DataFrame:
        n = [len(i) for i in self.ids]
        whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return pd.DataFrame({"query_id": np.repeat(self.own, n), "vec_id": whole(self.ids), "score": whole(self.scores)})


def best_pairs(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query in one pair of blocks: (query_id, vec_id, score)."""
    x, q = (np.array(f["v"].tolist(), np.int64).reshape(len(f), -1) for f in (candidates, queries))
    asked = Asked(q, queries["vec_id"].to_numpy(np.int64), k)
    asked.meet(x, candidates["vec_id"].to_numpy(np.int64))
    return asked.rows()


def block_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block as one row."""
    return pd.DataFrame({"dims": pdf["dims"].iloc[:1].to_numpy(), "ids": [pdf["vec_id"].to_numpy(np.int64)], "flat": [np.concatenate([np.asarray(v, np.int64) for v in pdf["v"]])]})


def met(blocks: DataFrame, chunk: pd.DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each query of a chunk the k best candidates that each task holds."""
    shared = blocks.sparkSession.sparkContext.broadcast(
        {int(d): (np.array(f["v"].tolist(), np.int64).reshape(len(f), -1), f["vec_id"].to_numpy(np.int64)) for d, f in chunk.groupby("dims")})

    def of(batches):
        asked = {d: Asked(q, own, k) for d, (q, own) in shared.value.items()}
        for batch in batches:
            for d, ids, flat in zip(batch["dims"], batch["ids"], batch["flat"]):
                if d in asked:
                    asked[d].meet(np.asarray(flat, np.int64).reshape(len(ids), -1), np.asarray(ids, np.int64))
        for a in asked.values():
            yield a.rows()
    return blocks.mapInPandas(of, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k candidates with the highest scores, ties to
    the smaller vec_id, fewer where there are fewer.

    ``vectors`` and ``queries``: vec_id, embedding.  A query is not its own candidate.  Vectors that are
    null or hold null or non-finite components, and rows with a null id, take no part; vectors of
    different length are not compared.  Rows that repeat a vec_id count once (the smallest vector).
    Components and scores must fit a long.
    """
    def ready(df: DataFrame) -> DataFrame:
        rows = (df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v")).where("v is not null and vec_id is not null")
                .groupBy("vec_id").agg(F.min("v").alias("v")))
        return rows.withColumn("dims", F.size("v"))

    def cut(df: DataFrame, size: int) -> int:
        rows, cells = df.agg(F.count(F.lit(1)), F.coalesce(F.sum("dims"), F.lit(0))).first()
        return max(1, -(-rows // size), -(-8 * cells // BLOCK_BYTES))
    right, left = staged(ready(vectors)), staged(ready(queries))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    blocks = staged(right.groupBy("dims", block(cut(right, CANDIDATES)).alias("cb")).applyInPandas(lambda key, pdf: block_of(pdf), "dims int, ids array<long>, flat array<long>"))
    chunks = cut(left, QUERIES)
    found = [staged(met(blocks, left.where(block(chunks) == i).toPandas(), k)) for i in range(chunks)]        # a chunk is bounded, each is a job
    pairs = reduce(DataFrame.unionByName, found)
    return top_k(pairs, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """The five best of all other vectors for each vector whose id is divisible by ``every``."""
    return search(embeddings, embeddings.where(F.col("vec_id") % every == 0))



ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 5
"""
