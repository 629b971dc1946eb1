"""Readers of triples, dictionaries, schemas and tagged text.  All split large files by line or block."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleloom.functions.skew import first_seen
from tripleloom.functions.text import strip
from tripleloom.sources import schemas
from tripleloom.sources.split import csv_records, json_elements

# Alternate names of the triple fields.
ALIASES = {"head": "subject", "relation": "predicate", "tail": "object", "sentence": "text"}
FILE_ORDER = ["_file", "_block", "_row"]


def _aliased(df: DataFrame) -> list[Column]:
    def field(name: str, other: str) -> Column:
        present = [F.col(c) for c in (name, other) if c in df.columns]
        return (F.coalesce(*present) if present else F.lit(None).cast("string")).alias(name)
    return [field(a, b) for a, b in ALIASES.items()]


def _filled(df: DataFrame) -> DataFrame:
    for c in ("head", "relation", "tail"):
        df = df.where(F.coalesce(F.trim(c), F.lit("")) != "")
    return df.where(F.col("head") != F.col("tail"))


def with_file_order(df: DataFrame) -> DataFrame:
    """Columns that give the order of rows in the files; add before any shuffle."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_row"))


def triples_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Triples with a header; quoted fields may hold line breaks, and a single file is read by many tasks all the same.

    Quotes stand around fields only, doubled inside them.  Files known to hold no line breaks in fields are read in one pass
    with ``multiline=False``.  All files have the columns of the first one's header.
    """
    options = {"header": "true", "quote": '"', "escape": '"'}
    if not multiline:
        raw = spark.read.options(**options).csv(path)
        return _filled(raw.select(*_aliased(raw)))
    names = spark.read.options(**options).csv(path, multiLine=True).columns
    found = csv_records(spark, path).where(~F.col("first") & (F.col("value") != ""))
    schema = ", ".join(f"`{n}` string" for n in names)
    raw = found.select(F.from_csv("value", schema, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    return _filled(raw.select(*_aliased(raw)))


def _objects(spark: SparkSession, path: str, schema: str, multiline: bool, level: int, object_level: int) -> DataFrame:
    """JSON objects of a schema, from lines or cut out of arrays by many tasks."""
    if not multiline:
        return spark.read.json(path, schema=schema)
    found = json_elements(spark, path, level, object_level)
    return found.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def triples_json(spark: SparkSession, path: str, multiline: bool = True, exported: bool = False) -> DataFrame:
    """Triples of JSON arrays or lines; ``exported`` reads graph objects with ``relationships``.

    Arrays in one file are read by many tasks.  Among the elements of an exported graph those with source, relation and target are its triples.
    """
    if exported and multiline:
        rel = _objects(spark, path, schemas.EDGE, True, 3, 2)
    elif exported:
        rel = spark.read.json(path, schema=schemas.EXPORTED).select(F.explode("relationships").alias("r")).select("r.*")
    else:
        raw = _objects(spark, path, schemas.TRIPLE, multiline, 1, 0)
        return _filled(raw.select(*_aliased(raw)))
    return _filled(rel.select(F.col("source").alias("head"), "relation", F.col("target").alias("tail"), F.lit(None).cast("string").alias("sentence")))


def offsets_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Offset records of JSON arrays, read by many tasks, or of lines; offsets may be numbers or text."""
    raw = _objects(spark, path, schemas.OFFSETS, multiline, 1, 0)
    ints = [c for c in raw.columns if c.endswith("_offset")]
    return _filled(raw).select(*[F.col(c).cast("int").alias(c) if c in ints else F.col(c) for c in raw.columns])


def type_dict(spark: SparkSession, path: str) -> DataFrame:
    """``entity,type`` without header; the last row of an entity wins, short rows are skipped."""
    raw = with_file_order(spark.read.csv(path, schema="entity string, type string"))
    rows = raw.where(F.col("type").isNotNull()).select(F.trim("entity").alias("entity"), F.trim("type").alias("type"), *FILE_ORDER)
    return rows.groupBy("entity").agg(F.max_by("type", F.struct(*FILE_ORDER)).alias("type"))


def type_dict_numbered(spark: SparkSession, path: str) -> DataFrame:
    """Numbered variant: a ``vocabulary`` title is skipped, ``n `` is stripped, the first comma separates."""
    raw = with_file_order(spark.read.text(path))
    line = strip(F.regexp_replace(F.col("value"), r"^\s*\d+\s+", ""))
    rows = raw.select(line.alias("l"), *FILE_ORDER).where((F.col("l") != "") & (F.lower("l") != "vocabulary") & F.col("l").contains(","))
    parts = F.split("l", ",", 2)
    named = rows.select(F.trim(parts[0]).alias("entity"), F.trim(parts[1]).alias("type"), *FILE_ORDER)
    return named.groupBy("entity").agg(F.max_by("type", F.struct(*FILE_ORDER)).alias("type"))


def relation_schema(spark: SparkSession, path: str) -> DataFrame:
    """Relations with id and types, by index; relation names are a rule table of fixed size."""
    raw = spark.read.csv(path, header=True, schema="head_type string, tail_type string, relation string, index int")
    return raw.select(F.col("index").alias("id"), *[F.trim(c).alias(c) for c in ("relation", "head_type", "tail_type")]).orderBy("id")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty stripped lines of many files."""
    return spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> ''")


def ie_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records; lines that are no record keep their text in ``_corrupt_record``."""
    return spark.read.json(path, schema=schemas.IE_RECORD + ", _corrupt_record string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def conll(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of ``token ... tag`` lines, in files with either kind of line end.

    Blank and ``-DOCSTART`` lines end a sentence; first and last columns are kept.  Large files split: a task gathers the lines
    of its splits in the order it reads them, and only sentences that a split cuts are put together afterwards.  Lines are not shuffled.
    """
    line = strip(F.col("value"))
    parts = F.split(line, r"\s+")
    edge = (line == "") | line.startswith("-DOCSTART")
    # a split is named by a number of its file and its beginning, so that paths do not travel with every line
    rows = spark.read.text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                        F.when(~edge, parts[0]).alias("token"), F.when(~edge, F.element_at(parts, -1)).alias("tag"))
    pieces = rows.mapInPandas(_sentences, "file long, block long, last boolean, cut boolean, tokens array<string>, tags array<string>")
    whole = pieces.where(~F.col("cut")).select("tokens", "tags")
    # at most two pieces a split: the lines before its first edge, which go on from the split before, and those after its last one
    order = Window.partitionBy("file").orderBy("block", "last")
    begun = pieces.where("cut").withColumn("begin", F.last(F.when(F.col("last"), F.col("block")), ignorenulls=True).over(order))
    listed = F.array_sort(F.collect_list(F.struct("block", "last", "tokens", "tags")))
    joined = begun.groupBy("file", "begin").agg(listed.alias("p")).select(F.flatten("p.tokens").alias("tokens"), F.flatten("p.tags").alias("tags"))
    return whole.unionByName(joined.where(F.size("tokens") > 0))


def _sentences(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sentences of the lines of splits, read in order; an edge has no token.

    The lines before the first edge of a split and those after its last one are cut: pieces of sentences.  The latter is
    there, if empty, whenever the split has an edge, for it ends what came before.
    """
    at, seen, held = None, False, ([], [])
    out: list[tuple] = []

    def put(last: bool, cut: bool) -> None:
        out.append((*at, last, cut, np.concatenate(held[0]) if held[0] else [], np.concatenate(held[1]) if held[1] else []))
        held[0].clear()
        held[1].clear()

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["file", "block", "last", "cut", "tokens", "tags"])
        out.clear()
        return made

    for batch in batches:
        token, tag = batch["token"].to_numpy(dtype=object), batch["tag"].to_numpy(dtype=object)
        file, block = batch["file"].to_numpy(), batch["block"].to_numpy()
        turns = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        bounds = [0, *turns.tolist(), len(batch)] if len(batch) else []
        for a, b in zip(bounds, bounds[1:]):
            here = (int(file[a]), int(block[a]))
            if here != at:
                if at is not None:
                    put(seen, True)
                at, seen = here, False
            start = a
            for e in (np.flatnonzero(batch["token"].isna().to_numpy()[a:b]) + a).tolist():
                if e > start:
                    held[0].append(token[start:e])
                    held[1].append(tag[start:e])
                if not seen:
                    put(False, True)
                elif held[0]:
                    put(False, False)
                seen, start = True, e + 1
            if b > start:
                held[0].append(token[start:b])
                held[1].append(tag[start:b])
        yield frame()
    if at is not None:
        put(seen, True)
    yield frame()


def tsv_tagged(spark: SparkSession, path: str, sep: str = "\x02") -> DataFrame:
    """Tab-separated rows with header whose text and tag columns hold ``\\x02``-joined lists."""
    raw = spark.read.csv(path, header=True, sep="\t", quote="")
    return raw.select(*[F.split(c, sep).alias(c) if c != "index" else F.col(c).cast("long").alias(c) for c in raw.columns])


def ie_schema(spark: SparkSession, path: str) -> DataFrame:
    """Types, roles and type-to-roles of three-line schema files, merged over all files.

    One row per (type, role); a type without roles has a null role.  Schema files have three lines each.
    """
    raw = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("l"))
    table = F.from_json(F.col("l")[2], "map<string,array<string>>")
    types = raw.select(F.explode(F.from_json(F.col("l")[0], "array<string>")).alias("type"), table.alias("m"))
    return types.select("type", F.explode_outer(F.try_element_at("m", "type")).alias("role")).distinct()


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row per key in file order."""
    return first_seen(df, keys, FILE_ORDER).drop(*FILE_ORDER)
