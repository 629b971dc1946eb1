"""Length buckets with least padding, and token-budget batches inside them.

The boundaries come from dynamic programming over the histogram of all lengths: a document is padded
to the boundary of its bucket, and the boundaries chosen minimise the padding of the whole corpus.
Every length that occurs is its own bin, so a boundary is always the length of some document, and the
histogram has at most as many bins as the longest document has tokens.

Inside a bucket documents are numbered in the order of a hash of id and text, and cut into batches of
as many rows as the token budget allows.  Numbers come from counts of bounded parts of each bucket, so
a bucket with any share of the rows is numbered by many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.session import staged
from tripleloom.llm.common import word_count

PART_ROWS = 100_000   # rows of a bucket that one task numbers, on average
SEED = 7


def boundaries(edges: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` of the ascending ``edges``, the last among them, with the least padding
    (edge of the bucket minus edge of the bin, summed over documents).  Fewer edges than buckets: all.

    With i the first bin of the last bucket, its padding is the value of a line at the bucket's edge, and the lines' slopes fall
    with i; so a layer is the lower hull of the lines, walked once along the ascending edges.
    """
    m = len(edges)
    if m <= buckets:
        return [int(e) for e in edges]
    at, n = [int(e) for e in edges], [int(c) for c in counts]
    rows, mass = [0], [0]
    for e, c in zip(at, n):
        rows.append(rows[-1] + c)
        mass.append(mass[-1] + c * e)
    best = [at[j] * rows[j + 1] - mass[j + 1] for j in range(m)]
    cuts = []
    for _ in range(buckets - 1):
        now, cut, hull, head = [0] * m, [0] * m, [], 0
        for j in range(m):
            slope, height = -rows[j], (best[j - 1] if j else 0) + mass[j]                 # the last bucket begins with bin j
            while len(hull) - head > 1 and (height - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, height, j))
            while len(hull) - head > 1 and hull[head + 1][0] * at[j] + hull[head + 1][1] <= hull[head][0] * at[j] + hull[head][1]:
                head += 1
            slope, height, i = hull[head]
            now[j], cut[j] = slope * at[j] + height + at[j] * rows[j + 1] - mass[j + 1], i
        best = now
        cuts.append(cut)
    out, j = [], m - 1
    for cut in reversed(cuts):
        out.append(at[j])
        j = cut[j] - 1
        if j < 0:
            break
    else:
        out.append(at[j])
    return sorted(out)


def pack(docs: DataFrame, id_col: str = "doc_id", tokens: Column | None = None, buckets: int = 16, budget: int = 16_384) -> DataFrame:
    """(id, n_tokens, bucket, padded_tokens, batch_id, slot): one row per input row.

    ``tokens`` defaults to the words of ``text``; null counts as 0.  A batch has floor(budget / padded)
    rows of one bucket, at least one: a document over the budget is a batch of its own, whole.  Rows
    that repeat an id are packed each; an empty table gives no rows.  Which rows share a batch follows from hashes
    of id, text and length, so the same rows in other files are packed alike.
    """
    n = F.coalesce(tokens if tokens is not None else word_count(F.col("text")), F.lit(0)).cast("long")
    said = [F.col("text")] if "text" in docs.columns else []
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(id_col), n, *said), 11).cast("double") / float(1 << 53)
    lengths = staged(docs.select(F.col(id_col).alias("id"), n.alias("n_tokens"), draw.alias("_at")))
    histogram = (lengths.groupBy(F.col("n_tokens").alias("edge")).agg(F.count(F.lit(1)).alias("n"))
                 .orderBy("edge").toPandas())       # a row for each length that occurs
    edges, counts = histogram["edge"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    ends = boundaries(edges, counts, buckets)
    in_bucket = np.bincount(np.searchsorted(ends, edges), counts, max(1, len(ends))).astype(np.int64)
    rows = [max(1, budget // max(1, e)) for e in ends]
    first = np.concatenate([[0], np.cumsum(-(-in_bucket[:len(ends)] // np.array(rows or [1])[:len(ends)]))]).astype(np.int64)

    def by_bucket(values: list) -> Column:
        out = F.lit(None).cast("long")
        for k in reversed(range(len(ends))):
            out = F.when(F.col("n_tokens") <= ends[k], F.lit(int(values[k]))).otherwise(out)
        return out
    parts = max(1, int(in_bucket.max()) // PART_ROWS)
    cut = (lengths.withColumn("bucket", by_bucket(list(range(len(ends)))).cast("int"))
           .withColumn("_part", F.floor(F.col("_at") * parts).cast("int")))
    sizes = cut.groupBy("bucket", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("bucket", "_part").orderBy("_at", "id")
    at = F.row_number().over(inside) - 1 + F.col("_before")
    many = by_bucket(rows)
    return (cut.join(offsets, ["bucket", "_part"]).withColumn("_k", at)
            .select("id", "n_tokens", "bucket", by_bucket(ends).alias("padded_tokens"),
                    (by_bucket(list(first)) + F.floor(F.col("_k") / many)).cast("long").alias("batch_id"),
                    (F.col("_k") % many).cast("int").alias("slot")))


def query(docs: DataFrame) -> DataFrame:
    """Buckets and batches of every document by its number of words."""
    return pack(docs).withColumnRenamed("id", "doc_id")
