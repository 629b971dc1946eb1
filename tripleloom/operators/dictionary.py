"""Dictionary matching by automata: which words of a table occur inside which texts.

The words are dealt by hash into parts of bounded size, and each part is compiled, once per worker, to an
automaton that finds all its words in one pass over a text, however many words begin alike.  A
text is read once per part where it lies: only hits leave a task, and neither texts nor parts of texts
are joined with words.  A part is what is broadcast, so that stays bounded however large the
dictionary is; most dictionaries are one part.

Where words have scopes, such as topics, a text meets those of its own scope only: texts and words of a scope are gathered
to lists of bounded size and joined, so the work follows the texts and not the texts times the parts of the whole dictionary.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.session import staged

PART_CHARS = 1 << 21     # characters of the words of a part, their names and a fixed share for each
WORD_CHARS = 16          # that share
LIST_CHARS = 1 << 18     # characters of a list of texts, or of words, of one scope


class Part:
    """Words with, for each, the scope it belongs to, its canonical name and number."""

    def __init__(self, words: list[str], entries: list[list[tuple]]):
        self.mark, self.words, self.entries = uuid.uuid4().hex, words, entries

    def automaton(self):
        """Compiled once per worker; a worker keeps the automaton of the part it read last."""
        if self.mark not in _COMPILED:
            import ahocorasick
            built = ahocorasick.Automaton()
            for number, word in enumerate(self.words):
                built.add_word(word, number)
            built.make_automaton()
            _COMPILED.clear()
            _COMPILED[self.mark] = built
        return _COMPILED[self.mark]

    def found(self, text: str) -> set[int]:
        return {number for _, number in self.automaton().iter(text)}


_COMPILED: dict = {}


def parts(dictionary: DataFrame, scope: Sequence[str], part_chars: int | None = None) -> Iterator[Part]:
    """The dictionary in parts of about ``part_chars`` characters; rows that repeat a word, name and scope are one."""
    limit, keys = part_chars or PART_CHARS, [*scope, "canonical", "synonym"]
    words = dictionary.where(F.length("synonym") > 0).groupBy(*keys).agg(F.min("dict_no").alias("dict_no"))
    weight = F.length("synonym") + F.coalesce(F.length(F.col("canonical").cast("string")), F.lit(0)) + WORD_CHARS
    words = staged(words.withColumn("_w", weight))
    total = words.agg(F.sum("_w")).first()[0] or 0
    number = -(-total // limit)
    if number > 1:
        words = staged(words.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(number))).repartitionByRange("_part").sortWithinPartitions("_part"))
    for k in range(number):
        rows = (words if number == 1 else words.where(F.col("_part") == k)).select(*scope, "canonical", "synonym", "dict_no").toPandas()
        # by word, then by scope: a text looks at the names of its own scope, however many scopes share the word
        entries: dict[str, dict[tuple, list[tuple]]] = {}
        for *where, canonical, synonym, no in rows.itertuples(index=False, name=None):
            if all(w is not None and w == w for w in where):  # nulls are equal to nothing
                entries.setdefault(synonym, {}).setdefault(tuple(where), []).append((canonical, no))
        yield Part(list(entries), list(entries.values()))


def _scan(texts: DataFrame, dictionary: DataFrame, scope: Sequence[str], schema: str, read: Callable, part_chars: int | None) -> DataFrame | None:
    """``read`` over batches of the texts, for each part of the dictionary."""
    context = texts.sparkSession.sparkContext

    def over(part: Part) -> DataFrame:
        shared = context.broadcast(part)                 # at most a part's characters
        return texts.mapInPandas(lambda batches: read(batches, shared.value), schema)
    found = [over(p) for p in parts(dictionary, scope, part_chars)]
    return reduce(DataFrame.unionByName, found) if found else None


def _lists(rows: DataFrame, scope: Sequence[str], columns: Sequence[str], chars: str, limit: int) -> DataFrame:
    """``columns`` of the rows of each scope as lists of about ``limit`` characters: one list a scope, or as many as a large scope asks for."""
    sizes = rows.groupBy(*scope).agg(F.sum(chars).alias("_chars")).where(F.col("_chars") > limit)
    many = sizes.select(*scope, F.ceil(F.col("_chars") / limit).cast("int").alias("_many"))     # broadcast: one row for each ``limit`` characters at most
    dealt = rows.join(F.broadcast(many), [*scope], "left").withColumn("_list", F.pmod(F.xxhash64(*columns), F.coalesce("_many", F.lit(1))))
    listed = dealt.groupBy(*scope, "_list").agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    return listed.select(*scope, *[F.col(f"_rows.{c}").alias(c) for c in columns])


def _scoped(texts: DataFrame, dictionary: DataFrame, scope: Sequence[str], schema: str, limit: int) -> DataFrame:
    """Hits of texts (``_key``, ``_text``) among the words of their own scope; nulls are equal to nothing."""
    words = dictionary.where(F.length("synonym") > 0).dropna(subset=[*scope]).groupBy(*scope, "canonical", "synonym").agg(F.min("dict_no").alias("dict_no"))
    words = staged(words.withColumn("_w", F.length("synonym") + F.coalesce(F.length(F.col("canonical").cast("string")), F.lit(0)) + WORD_CHARS))
    texts = texts.dropna(subset=[*scope]).withColumn("_w", F.length("_text") + WORD_CHARS)
    both = _lists(texts, scope, ["_key", "_text"], "_w", limit).join(_lists(words, scope, ["canonical", "synonym", "dict_no"], "_w", limit), [*scope])

    def read(batches):
        import ahocorasick
        import pyarrow as pa
        last = built = None
        for batch in batches:
            out: tuple = ([], [], [])
            for i in range(batch.num_rows):     # one row at a time: a batch may be many lists
                keys, lines, *entries = (column[i].as_py() for column in batch.columns)
                if entries != last:
                    by_word: dict = {}
                    for canonical, synonym, no in zip(*entries):
                        by_word.setdefault(synonym, []).append((canonical, no))
                    built, last = ahocorasick.Automaton(), entries
                    for word, names in by_word.items():
                        built.add_word(word, (word, names))
                    built.make_automaton()
                for key, line in zip(keys, lines):
                    best: dict = {}
                    for names in {word: names for _, (word, names) in built.iter(line)}.values():
                        for canonical, no in names:
                            if canonical not in best or no < best[canonical]:
                                best[canonical] = no
                    for canonical, no in best.items():
                        for column, value in zip(out, (key, canonical, no)):
                            column.append(value)
            kinds = [batch.schema.field(n).type.value_type for n in ("_key", "canonical", "dict_no")]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names=["_key", "canonical", "dict_no"])
    return both.select("_key", "_text", "canonical", "synonym", "dict_no").mapInArrow(read, schema)


def hits(texts: DataFrame, key: str, text: str, dictionary: DataFrame, scope: Sequence[str] = (), part_chars: int | None = None) -> DataFrame:
    """``(key, canonical, dict_no)``: every canonical name with a synonym inside the text, and the smallest number of such a synonym.

    ``dictionary`` is ``(canonical, synonym, dict_no)`` of any size, with the columns of ``scope`` if there are any: these must be equal on
    both sides, e.g. a topic that owns its words (nulls are equal to nothing).  Null texts and empty synonyms hit nothing; texts that
    share a key, null included, are taken together.
    """
    scope = list(scope)
    given = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *scope).where(F.col("_text").isNotNull())
    kinds = dictionary.select("canonical", "dict_no").schema
    schema = f"_key {given.schema['_key'].dataType.simpleString()}, canonical {kinds['canonical'].dataType.simpleString()}, dict_no {kinds['dict_no'].dataType.simpleString()}"

    def read(batches, part: Part):
        for batch in batches:
            out = []
            for k, t in batch.itertuples(index=False, name=None):
                best: dict = {}
                for number in part.found(t):
                    for canonical, no in part.entries[number][()]:
                        if canonical not in best or no < best[canonical]:
                            best[canonical] = no
                out += [(k, canonical, no) for canonical, no in best.items()]
            yield pd.DataFrame(out, columns=["_key", "canonical", "dict_no"])
    found = _scoped(given, dictionary, scope, schema, part_chars or LIST_CHARS) if scope else _scan(given, dictionary, scope, schema, read, part_chars)
    if found is None:
        found = texts.sparkSession.createDataFrame([], schema)
    return found.groupBy(F.col("_key").alias(key), "canonical").agg(F.min("dict_no").alias("dict_no"))


def words_inside(texts: DataFrame, text: str, words: DataFrame, word: str, part_chars: int | None = None) -> DataFrame:
    """Those of ``words`` that occur inside some text, each once; a task passes a word on once."""
    dictionary = words.select(F.col(word).alias("synonym"), F.lit(0).alias("canonical"), F.lit(0).alias("dict_no"))

    def read(batches, part: Part):
        seen: set[int] = set()
        for batch in batches:
            for t in batch["_text"]:
                seen |= part.found(t)
        yield pd.DataFrame({word: [part.words[n] for n in sorted(seen)]}, dtype=object)
    given = texts.select(F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    found = _scan(given, dictionary, [], f"{word} string", read, part_chars)
    return found.distinct() if found is not None else words.select(word).limit(0)
