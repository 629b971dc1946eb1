"""Tag sequences, spans and marked sentences as column expressions over one row's arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.text import let


def _places(items: Column, test) -> Column:
    """0-based positions where ``test(item, i)`` holds."""
    return F.filter(F.transform(items, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def _islands(tags: Column, opens) -> Column:
    """Chunks [start, end, type) from the places where a chunk opens.

    Ends are the places followed by ``O``, an opening or nothing; starts and ends come in
    equal number and order, so one zip pairs them without a fold.
    """
    def run(t: Column) -> Column:
        inside = lambda x: F.coalesce(x != "O", F.lit(False))
        starts = _places(t, lambda x, i: inside(x) & opens(t, x, i))
        ends = _places(t, lambda x, i: inside(x) & (~inside(F.get(t, i + 1)) | opens(t, F.get(t, i + 1), i + 1)))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end"), F.substring(F.get(t, s), F.lit(3), F.length(F.get(t, s))).alias("type")))
    return let(tags, run)


def bio_to_spans(tags: Column) -> Column:
    """Spans of a BIO sequence; an ``I`` without ``B`` opens one, and ``I`` continues whatever its type."""
    return _islands(tags, lambda t, x, i: x.startswith("B") | (i == 0) | (F.get(t, i - 1) == "O"))


def chunks_typed(tags: Column) -> Column:
    """Chunks that also break where the type changes."""
    kind = lambda x: F.substring(x, F.lit(3), F.length(x))
    return _islands(tags, lambda t, x, i: x.startswith("B") | (i == 0) | (F.get(t, i - 1) == "O") | (kind(x) != kind(F.get(t, i - 1))))


def bio_strict(tags: Column) -> Column:
    """Only ``B`` opens a span; tags outside such spans are ignored."""
    return let(tags, lambda t: F.filter(bio_to_spans(t), lambda s: F.get(t, s["start"]).startswith("B")))


def tagged_merge(items: Column) -> Column:
    """(text, type) of tagged pieces ``{token, tag}`` without ``O``: ``B`` opens, ``I`` of the same type joins."""
    none = F.lit(None).cast("string")
    entry = "array<struct<text:string,type:string>>"
    start = F.struct(F.array().cast(entry).alias("done"), none.alias("text"), none.alias("type"))

    def close(acc: Column) -> Column:
        return F.when(acc["text"].isNotNull(), F.array_append(acc["done"], F.struct(acc["text"].alias("text"), acc["type"].alias("type")))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        kind = F.substring(x["tag"], F.lit(3), F.length(x["tag"]))
        opens, joins = x["tag"].startswith("B"), acc["type"].isNull() | (acc["type"] == kind)
        text = F.when(opens, x["token"]).when(joins, F.concat(F.coalesce(acc["text"], F.lit("")), x["token"])).otherwise(acc["text"])
        return F.struct(F.when(opens, close(acc)).otherwise(acc["done"]).alias("done"), text.alias("text"),
                        F.when(opens | joins, kind).otherwise(acc["type"]).alias("type"))

    return F.aggregate(items, start, step, close)


def spans_to_tags(tokens: DataFrame, spans: DataFrame, by: str, pos: str) -> DataFrame:
    """BIO tags of a long token table from spans ``(by, no, start, end, type)``; the last span wins.

    Each span is written out to its positions, so the work is linear in covered tokens.  Both sides come of rows that are
    multiplied, which the optimiser takes for as small as the texts: it is told to sort and merge, lest one be broadcast.
    """
    at = spans.select(by, "no", "start", "type", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias(pos))
    tag = F.concat(F.when(F.col(pos) == F.col("start"), "B-").otherwise("I-"), F.col("type"))
    last = at.withColumn("tag", tag).groupBy(by, pos).agg(F.max_by("tag", "no").alias("tag"))
    return tokens.join(last.hint("merge"), [by, pos], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def find_all(text: Column, word: str) -> Column:
    """All 0-based, also overlapping, places of a word; the whole text up to its last character."""
    n = len(word)
    return let(F.split(text, ""), lambda ch: _places(ch, lambda x, i: (x == word[0]) & (F.array_join(F.slice(ch, i + 1, n), "") == word)))


def find_first(text: Column, word: Column) -> Column:
    """0-based first place, -1 when absent."""
    return F.call_function("instr", text, word) - 1


def order_by_offset(sentence: Column, e1: Column, e2: Column) -> Column:
    """Head is the mention that comes first; null when either is missing."""
    p1, p2 = find_first(sentence, e1), find_first(sentence, e2)
    def pack(a, pa, b, pb):
        return F.struct(a.alias("head"), pa.alias("head_offset"), (pa + F.length(a)).alias("head_end"),
                        b.alias("tail"), pb.alias("tail_offset"), (pb + F.length(b)).alias("tail_end"))
    found = (p1 >= 0) & (p2 >= 0) & (e1 != "") & (e2 != "")
    return F.when(found & (p1 <= p2), pack(e1, p1, e2, p2)).when(found, pack(e2, p2, e1, p1))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.call_function("instr", text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def entity_marks(sentence: Column, head: Column, tail: Column, head_mark: Column, tail_mark: Column) -> Column:
    """First head and tail replaced by marks; the longer tail goes first when it holds the head."""
    pad = lambda m: F.concat(F.lit(" "), m, F.lit(" "))
    s = F.trim(sentence)
    tail_first = replace_first(replace_first(s, tail, pad(tail_mark)), head, pad(head_mark))
    head_first = replace_first(replace_first(s, head, pad(head_mark)), tail, pad(tail_mark))
    return F.when(F.contains(tail, head), tail_first).otherwise(head_first)


def lm_text(sentence: Column, head: Column, tail: Column, head_type: Column, tail_type: Column) -> Column:
    typed = replace_first(replace_first(F.trim(sentence), head, head_type), tail, tail_type)
    return F.concat(typed, F.lit("[SEP]"), head, F.lit("[SEP]"), tail)


def marker_tokens(tokens: Column, subj: Column, obj: Column, subj_type: Column, obj_type: Column) -> Column:
    """Token array with start and end markers around subject and object spans ``{start, end}`` (end inclusive)."""
    def mark(side: str, type_: Column) -> Column:
        return F.concat(F.lit(f"[{side}="), type_, F.lit("]"))
    v = F.struct(tokens.alias("t"), subj.alias("s"), obj.alias("o"), mark("SUBJ_START", subj_type).alias("ss"), mark("SUBJ_END", subj_type).alias("se"),
                 mark("OBJ_START", obj_type).alias("os"), mark("OBJ_END", obj_type).alias("oe"))
    def widen(v: Column) -> Column:
        return F.flatten(F.transform(v["t"], lambda w, i: F.array_compact(F.array(
            F.when(i == v["s"]["start"], v["ss"]), F.when(i == v["o"]["start"], v["os"]), w,
            F.when(i == v["s"]["end"], v["se"]), F.when(i == v["o"]["end"], v["oe"])))))
    return let(v, widen)


def places(length: Column) -> Column:
    """0 to length - 1; empty for 0."""
    return F.slice(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), F.lit(1), length)


def rel_positions(length: Column, at: Column, limit: int) -> Column:
    """Clipped relative positions of 0..length-1 to ``at``, shifted to 1..2*limit+1."""
    return let(F.struct(length.alias("n"), at.alias("p")), lambda v: F.transform(
        places(v["n"]), lambda i: F.greatest(F.lit(-limit), F.least(F.lit(limit), i - v["p"])) + limit + 1))


def segments3(length: Column, first: Column, second: Column) -> Column:
    """1 up to the first entity, 2 between, 3 from the second on; a text may end before either, and the
    second may come first."""
    return let(F.struct(length.alias("n"), first.alias("a"), second.alias("b")), lambda v: F.transform(
        places(v["n"]), lambda i: F.when(i <= v["a"], 1).when(i < v["b"], 2).otherwise(3)))


def word_pairs(spans: Column) -> Column:
    """Sparse word-pair grid of token index lists ``{index, type}``: neighbours, and tail to head with the type."""
    def one(s: Column) -> Column:
        idx = s["index"]
        near = F.transform(F.slice(idx, F.lit(2), F.size(idx)), lambda j, k: F.struct(F.get(idx, k).alias("i"), j.alias("j"), F.lit("NNW").alias("label")))
        back = F.array(F.struct(F.element_at(idx, -1).alias("i"), F.get(idx, F.lit(0)).alias("j"), F.concat(F.lit("THW-"), s["type"]).alias("label")))
        return F.concat(near, back)
    return F.flatten(F.transform(spans, one))


def distance_bucket(d: Column) -> Column:
    """Bucket of a token distance at 1, 2, 4, ... 256; negative distances 9 higher, zero is 19."""
    size = F.floor(F.log2(F.abs(d))).cast("int") + 1
    return F.when(d == 0, 19).when(d < 0, F.least(size, F.lit(9)) + 9).otherwise(F.least(size, F.lit(9)))


def spans_up_to(n: Column, longest: int) -> Column:
    """All (start, end) spans of at most ``longest`` tokens, end inclusive: linear in the sentence."""
    def run(n: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.transform(
            F.sequence(s, F.least(s + longest - 1, n - 1)), lambda e: F.struct(s.alias("start"), e.alias("end")))))
    return F.when(n > 0, let(n, run))
