"""Cleaning, typing and filtering of triples, names and utterances.

All functions are row-level expressions or joins with rule tables written in the
code, whose size is fixed; nothing here shuffles the triples.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions import constants as K


# Whatever of a name ``norm_entity`` may change: white space other than one space between words, brackets, quotes.
UNTIDY = r"^ |  | \z|[\t\n\x0B\f\r(\"']"


# ---- names -------------------------------------------------------------------------------

def norm_entity(name: Column) -> Column:
    """Trim, one space between words, no ``(...)`` groups, no quotes; null gives ''.  Names that are so already are only looked through."""
    one_space = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"\([^)]*\)", "")
    whole = F.trim(F.regexp_replace(one_space, "[\"']", ""))
    return F.coalesce(F.when(name.rlike(UNTIDY), whole).otherwise(name), F.lit(""))


def valid_triple(head: Column, relation: Column, tail: Column) -> Column:
    """Three non-empty parts and no self-loop (names already normalised)."""
    filled = [F.coalesce(c, F.lit("")) != "" for c in (head, relation, tail)]
    return filled[0] & filled[1] & filled[2] & (head != tail)


def sanitize_name(name: Column, longest: int | None = None) -> Column:
    """Letters, digits, ``_``, space and ``-`` only, trimmed; null gives ''.  ``longest`` cuts names when stated."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N}_\s\-]", "")
    return F.coalesce(F.trim(kept if longest is None else F.substring(kept, 1, longest)), F.lit(""))


def validate_entities(names: Column, most: int | None = None) -> Column:
    """The names of an array, sanitised, without the empty ones; the first ``most`` when stated."""
    first = names if most is None else F.slice(names, 1, most)
    return F.filter(F.transform(first, lambda n: sanitize_name(n)), lambda n: n != "")


def suspicious(text: Column) -> Column:
    """True when the text holds quoting, comment or data-changing words."""
    return reduce(or_, [text.rlike(f"(?i){p}") for p in K.UNSAFE_PATTERNS])


# ---- types and labels -------------------------------------------------------------------

def any_word(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def ladder(text: Column, families: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first family with a keyword inside the text."""
    out = F
    for label, words in families:
        out = out.when(any_word(text, words), F.lit(label))
    return out.otherwise(F.lit(default))


def translate(name: Column, table: dict[str, str]) -> Column:
    """Map a name; unknown names pass through."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), name)


def type_entity(df: DataFrame, name: str, given: str | None, dictionary: DataFrame, out: str) -> DataFrame:
    """Type cascade: translated given type, dictionary (``entity``, ``type``), keywords, default.

    The dictionary join is left to the optimiser: it is broadcast while it is below the
    session threshold and shuffled beyond it.
    """
    from_name = ladder(F.lower(F.col(name)), K.TYPE_KEYWORDS, K.DEFAULT_TYPE)
    names = F.create_map(*[F.lit(x) for kv in K.TYPE_NAMES.items() for x in kv])
    from_data = F.try_element_at(names, F.col(given)) if given else F.lit(None).cast("string")
    lookup = dictionary.select(F.col("entity").alias("_entity"), F.col("type").alias("_type"))
    joined = df.join(lookup, F.col(name) == F.col("_entity"), "left")
    return joined.withColumn(out, F.coalesce(from_data, F.col("_type"), from_name)).drop("_entity", "_type")


def enforce_schema(df: DataFrame, schema: DataFrame) -> DataFrame:
    """Triples of a scheduled relation must have its types; other relations pass.

    ``schema`` has one row per relation with ``head_types`` and ``tail_types`` arrays; an
    empty array allows any type.  It is a rule table, one row per relation name.
    """
    rules = schema.select(F.col("relation").alias("_relation"), "head_types", "tail_types")
    def allowed(types: str, value: str) -> Column:
        return (F.size(types) == 0) | F.array_contains(F.col(types), F.col(value))
    ok = F.col("_relation").isNull() | (allowed("head_types", "head_type") & allowed("tail_types", "tail_type"))
    return df.join(rules, F.col("relation") == F.col("_relation"), "left").where(ok).select(*df.columns)


def default_schema(spark) -> DataFrame:
    """The built-in relation schema as a rule table."""
    rows = [(rel, [head], [tail]) for head, tail, rel, _ in K.RELATION_SCHEMA]
    return spark.createDataFrame(rows, "relation string, head_types array<string>, tail_types array<string>")


# ---- row filters -------------------------------------------------------------------------

def conf_filter(df: DataFrame, threshold: float, op: str = ">=", column: str = "confidence",
                nulls: str = "drop", skip_label: str | None = None, label: str = "relation") -> DataFrame:
    """Keep rows by confidence.

    ``op``: ``>`` strict, ``>=`` exact edge, ``~>=`` edge with a 1e-10 tolerance.  ``nulls``
    keeps or drops rows without a confidence.  A frame without the column passes whole.
    """
    if column not in df.columns:
        return df
    value, edge = F.col(column), F.lit(float(threshold))
    passes = {">": value > edge, ">=": value >= edge, "~>=": value >= edge - F.lit(1e-10)}[op]
    keep = F.coalesce(passes, F.lit(nulls == "keep"))
    if skip_label is not None:
        keep = keep & ~F.col(label).eqNullSafe(F.lit(skip_label))
    return df.where(keep)


def drop_none_label(df: DataFrame, label: str = "relation") -> DataFrame:
    """Remove the label ``none``; a null label stays."""
    return df.where(~F.col(label).eqNullSafe(F.lit("none")))


def both_mentions_present(df: DataFrame, sentence: str, head: str, tail: str) -> DataFrame:
    return df.where(F.col(sentence).contains(F.col(head)) & F.col(sentence).contains(F.col(tail)))


# ---- curation ----------------------------------------------------------------------------

def curate_delete(edges: DataFrame) -> DataFrame:
    """Drop edges whose (head type, relation, tail type) is a delete rule (five fixed rules)."""
    rules = edges.sparkSession.createDataFrame(K.DELETE_RULES, "head_type string, relation string, tail_type string")
    return edges.join(F.broadcast(rules), ["head_type", "relation", "tail_type"], "left_anti")


def curate_rename(edges: DataFrame) -> DataFrame:
    """Rename relations by (head type, relation, tail type); run after the deletion."""
    rules = edges.sparkSession.createDataFrame(
        K.RENAME_RULES, "head_type string, relation string, tail_type string, _new string")
    joined = edges.join(F.broadcast(rules), ["head_type", "relation", "tail_type"], "left")
    return (joined.withColumn("relation", F.coalesce("_new", "relation")).drop("_new")
            .select(*edges.columns))


def fill_context(edges: DataFrame, out: str = "sentence") -> DataFrame:
    """Give edges without a sentence one from the template of their relation and types."""
    spark = edges.sparkSession
    exact = spark.createDataFrame(K.CONTEXT_TEMPLATES,
                                  "relation string, head_type string, tail_type string, _exact string")
    generic = translate(F.col("relation"), K.GENERIC_TEMPLATES)
    known = F.col("relation").isin(list(K.GENERIC_TEMPLATES))
    template = F.coalesce("_exact", F.when(known, generic), F.lit(K.ANY_TEMPLATE))
    filled = template
    for mark, col in (("{source}", "head"), ("{target}", "tail"), ("{relation}", "relation")):
        filled = F.replace(filled, F.lit(mark), F.col(col))
    joined = edges.join(F.broadcast(exact), ["relation", "head_type", "tail_type"], "left")
    return joined.withColumn(out, F.coalesce(out, filled)).drop("_exact").select(*edges.columns)


# ---- utterances --------------------------------------------------------------------------

def intent_rules(text: Column, families=None, default: str = K.OTHER_INTENT) -> Column:
    return ladder(F.lower(text), families or K.INTENT_KEYWORDS, default)


def intent_merge(model: Column, rule: Column) -> Column:
    """The model's label, unless absent or ``unknown``, or ``other`` against a better rule."""
    use_rule = model.isNull() | (model == "unknown") | ((model == K.OTHER_INTENT) & (rule != K.OTHER_INTENT))
    return F.when(use_rule, rule).otherwise(model)


def default_relation(text: Column, relation: Column, has_entities: Column, listing=None,
                     value: str = K.LISTING_RELATION) -> Column:
    """Relation to ask for: the found one, a listing default, or null for the general route."""
    lists = any_word(text, listing or K.LISTING_KEYWORDS)
    return F.when(relation.isNotNull(), relation).when(has_entities & lists, F.lit(value))


def valid_relation(answer: Column, relations: Sequence[str], default: str = K.NO_RELATION, compat: bool = False) -> Column:
    """Free answer to a closed list: exact, else the longest relation that the answer names in full.

    ``compat`` takes the first relation whose two-letter start the answer has instead, which confuses
    relations with a common start."""
    text = F.trim(answer)
    out = F.when(text.isin(list(relations)), text)
    for rel in relations if compat else sorted(relations, key=lambda r: (-len(r), r)):
        out = out.when(text.startswith(rel[:2]) if compat else F.contains(text, F.lit(rel)), F.lit(rel))
    return out.otherwise(F.lit(default))


def history_roles(messages: DataFrame, sender: str = "role", text: str = "text") -> DataFrame:
    """Chat rows as role and content; other senders and empty texts are dropped."""
    return (messages.where(F.col(sender).isin("user", "assistant") & (F.trim(text) != ""))
            .withColumnRenamed(sender, "role").withColumnRenamed(text, "content"))
