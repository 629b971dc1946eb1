"""SimHash near-duplicates through covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles.  Two
fingerprints within ``radius`` bits are found with certainty: every bit position i carries a non-zero
vector m(i) of radius + 1 bits, and table v (each non-zero vector) keeps the positions whose m(i) has
an odd product with v.  The at most ``radius`` positions in which a pair differs span too little to
leave no v orthogonal to them all, so in that table the pair has equal keys.

Buckets hold distinct fingerprints.  One that is too large is dealt again by further families of masks
on top of the first; the same argument holds in every family.  The last leaves so few free bits that a
bucket is small whatever the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tripleloom.functions.session import staged
from tripleloom.functions.skew import top_k
from tripleloom.llm.common import components, forest

SEED = 42
BUCKET = 256         # distinct fingerprints that are compared with one another in one place
LEVELS = 4
TILE = 1024
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    ones, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        if len(words) < width:
            h = [xxh64_intdigest(line, SEED)]
        else:
            h = [xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[lo:hi], ends[lo + width - 1:hi + width - 1])]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): one row per document; null text and text without words have fingerprint 0."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")
    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


def masks(level: int, radius: int = 3) -> list[int]:
    """The covering masks of one family as signed 64-bit numbers."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + xxh64_intdigest(f"{level}/{i // n}/{i % n}".encode(), level) % n if level else 1 + i % n for i in range(64)]
    out = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fp``: everything linked within ``radius``
    bits is connected, and each bucket gives fewer links than it has members."""
    rows, found = prints.select("fp", F.lit("").alias("path"), F.lit(0).cast("long").alias("mask")), []
    for level in range(LEVELS):
        table = F.explode(F.array(*[F.struct(F.lit(f"{v}.").alias("v"), F.lit(m).alias("m")) for v, m in enumerate(masks(level, radius))]))
        keyed = rows.withColumn("t", table).select(
            "fp", F.concat("path", "t.v").alias("path"), F.col("mask").bitwiseOR(F.col("t.m")).alias("mask"))
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        last = level == LEVELS - 1
        few = sizes if last else sizes.where(F.col("n") <= BUCKET)
        members = (keyed.join(few.drop("n"), ["path", "key"]).groupBy("path", "key")
                   .agg(F.collect_list("fp").alias("fps")).select("fps"))
        found.append(members.mapInPandas(lambda it: _within(it, radius), "a long, b long"))
        if not last:
            many = sizes.where(F.col("n") > BUCKET).drop("n")
            rows = staged(keyed.join(many, ["path", "key"]).select("fp", "path", "mask"))
            if rows.isEmpty():
                break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _within(batches, radius: int):
    for batch in batches:
        a, b = [], []
        for fps in batch["fps"]:
            x = np.sort(np.asarray(fps, np.int64))
            root = forest(len(x), _close(x.view(np.uint64), radius))
            a += [int(x[i]) for i in range(len(x)) if root[i] != i]
            b += [int(x[root[i]]) for i in range(len(x)) if root[i] != i]
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _close(x: np.ndarray, radius: int):
    """Pairs of places within the radius, a tile of the triangle at a time."""
    for lo in range(0, len(x), TILE):
        for at in range(lo, len(x), TILE):
            near = np.bitwise_count(x[lo:lo + TILE, None] ^ x[None, at:at + TILE]) <= radius
            i, j = np.nonzero(np.triu(near, 1) if at == lo else near)
            yield lo + i, at + j


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component): documents whose fingerprints are linked, directly or through others.

    ``component`` is the smallest id of the component.  A null id takes part but is never that
    smallest id unless all are null; repeated rows give repeated rows; an empty table gives none.
    Only ``id_col`` and ``text_col`` are read, so other columns never clash.
    """
    each = staged(fingerprints(docs, id_col, text_col, width))
    return each.join(rooted(each, radius), "fp").select("id", "fp", "component")


def rooted(each: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component): of every fingerprint in ``each`` (id, fp) the smallest id of its component."""
    distinct = staged(each.groupBy("fp").agg(F.min("id").alias("first")))
    linked = components(links(distinct, radius))
    root = (distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", "first", F.coalesce("component", "fp").alias("root")))
    least = root.groupBy("root").agg(F.min("first").alias("component"))
    return root.select("fp", "root").join(least, "root").drop("root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, all columns as given: the one with the smallest id, null after all others.

    Rows that repeat an id, null included, are rows of their own: each counts in the component of its
    text.  Among rows of one id in one component hashes of text and content choose.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),       # equal keys: equal texts, one component
                   F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(SEED), text_col).alias("g"))
    columns = [F.col(f"`{c}`") for c in docs.columns]            # whatever their names
    rows = docs.select(F.struct(*columns).alias("row"), key.alias("key"), F.col(text_col).alias("text"), F.xxhash64(*columns).alias("at"))
    each = staged(fingerprints(rows, "key", "text", width))
    stays = rooted(each, radius).select(F.col("component").alias("key")).distinct()
    return top_k(rows, ["key"], [F.col("at")], 1).join(stays, "key", "left_semi").select("row.*")


def query(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component").alias("component_id"))
