"""Text and token-array expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: characters kept when raw text is cleaned.
KEPT_CHARACTERS = r"\x{4e00}-\x{9fa5}a-zA-Z0-9\s，。？！、‘’；《》【】（）：\-/“”"
# Fixed value: marks that end a sentence.
SENTENCE_MARKS = "。？！；.;!?"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once.

    Lambdas see outer columns as expressions, and the optimiser may put the whole
    computation of such a column inside the lambda, once per element; a lambda
    variable is bound to its value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(s: Column) -> Column:
    """Trim spaces, tabs and line ends."""
    return F.btrim(s, F.lit(" \n\t\r"))


def clean_text(text: Column, old: str = "", new: str = "") -> Column:
    """Keep CJK, Latin, digits and listed marks; map characters ``old`` to ``new`` (e.g. to simplified)."""
    kept = F.regexp_replace(text, f"[^{KEPT_CHARACTERS}]", "")
    return F.translate(kept, old, new) if old else kept


def split_dropping(text: Column, marks: str = SENTENCE_MARKS) -> Column:
    """Sentences without their end marks."""
    return F.split(text, f"[{marks}]")


def split_keeping(text: Column, marks: str = "。？！") -> Column:
    """Sentences and end marks as separate items, in order."""
    return F.regexp_extract_all(text, F.lit(f"[^{marks}]+|[{marks}]"), F.lit(0))


def split_after(text: Column, marks: str = "。！？；") -> Column:
    """Cut after an end mark or at line ends."""
    return F.split(text, rf"(?<=[{marks}])\s*|\n+")


def pack_sentences(sentences: Column, limit: int = 480) -> Column:
    """Join sentences into chunks shorter than ``limit``; the text before the first cut may be empty and is dropped.

    The fold runs inside one document row.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        full = F.length(acc["cur"]) + F.length(s) + 1 > limit
        done = F.when(full, F.array_append(acc["done"], F.trim(acc["cur"]))).otherwise(acc["done"])
        cur = F.when(full, F.concat(s, F.lit(" "))).otherwise(F.concat(acc["cur"], s, F.lit(" ")))
        return F.struct(done.alias("done"), cur.alias("cur"))

    def finish(acc: Column) -> Column:
        return F.filter(F.array_append(acc["done"], F.trim(acc["cur"])), lambda c: c != "")

    return F.aggregate(sentences, empty, step, finish)


def length_gate(df: DataFrame, tokens: str, limit: int) -> DataFrame:
    return df.where(F.size(tokens) <= limit)


def starts_of(tokens: Column, part: Column) -> Column:
    """0-based starts of ``part`` in ``tokens`` (both arrays); a null or empty part has none.

    Candidates are only the places of the part's first token, so long texts cost one pass.
    """
    def search(v: Column) -> Column:
        toks, sub = v["t"], v["p"]
        first = F.get(sub, F.lit(0))
        places = F.filter(F.transform(toks, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
        return F.filter(places, lambda i: F.slice(toks, i + 1, F.size(sub)) == sub)

    return let(F.struct(tokens.alias("t"), part.alias("p")), search)


def match_sublist(tokens: Column, part: Column) -> Column:
    """All (start, end) of ``part`` in ``tokens``, end inclusive."""
    return F.transform(starts_of(tokens, part), lambda i: F.struct(i.alias("start"), (i + F.size(part) - 1).alias("end")))


def align_tokens(df: DataFrame, tokens: str, head: str, tail: str, longest: int = 15) -> DataFrame:
    """Keep mentions of 1 to 15 tokens found in the sentence; add first start and inclusive end."""
    out = df
    for mention, name in ((head, "head"), (tail, "tail")):
        fits = F.size(mention).between(1, longest)
        first = F.get(starts_of(F.col(tokens), F.col(mention)), F.lit(0))
        out = (out.where(fits).withColumn(f"{name}_start", first).where(F.col(f"{name}_start").isNotNull())
               .withColumn(f"{name}_end", F.col(f"{name}_start") + F.size(mention) - 1))
    return out
