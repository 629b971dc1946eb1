"""Parsing of generated answers, attribute values and names as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.tags import find_first
from tripleloom.functions.text import strip

NAN = "NAN"


def _triple(h: Column, r: Column, t: Column) -> Column:
    return F.struct(h.alias("head"), r.alias("relation"), t.alias("tail"))


def _filled(triples: Column) -> Column:
    return F.filter(triples, lambda x: (x["head"] != "") & (x["relation"] != "") & (x["tail"] != "") & (x["head"] != NAN) & (x["tail"] != NAN))


def parse_triples(answer: Column) -> Column:
    """``(h,r,t)`` groups, the last bracket may be missing; incomplete groups are dropped."""
    groups = F.regexp_extract_all(answer, F.lit(r"\(([^()]*)\)?"), F.lit(1))
    def one(g: Column) -> Column:
        parts = F.split(g, ",")
        part = lambda i: F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
        return _triple(part(0), part(1), part(2))
    return _filled(F.transform(groups, one))


def parse_listed(answer: Column, head: str, relation: str, tail: str) -> Column:
    """One triple per line, each part after its own marker word, e.g. ``头实体是``, ``关系是``, ``尾实体是``.

    Markers are found inside the line, so commas inside names do not matter.
    """
    def one(line: Column) -> Column:
        def between(a: str, b: str | None) -> Column:
            after = F.substring_index(line, a, -1)
            return F.trim(F.regexp_replace(F.substring_index(after, b, 1), r"[,，]\s*$", "") if b else after)
        complete = F.contains(line, F.lit(head)) & F.contains(line, F.lit(relation)) & F.contains(line, F.lit(tail))
        return F.when(complete, _triple(between(head, relation), between(relation, tail), between(tail, None)))
    return _filled(F.filter(F.transform(F.split(answer, "\n"), one), lambda x: x.isNotNull()))


def parse_entity_json(answer: Column) -> Column:
    """Names of ``{"named_entities": [...]}`` or of a JSON list, else the quoted strings in the first brackets."""
    v = F.try_parse_json(answer)
    names = F.coalesce(F.try_variant_get(v, "$.named_entities", "array<string>"), F.try_variant_get(v, "$", "array<string>"))
    loose = F.regexp_extract_all(F.regexp_extract(answer, r"(?s)\[(.*?)\]", 1), F.lit('"(.*?)"'), F.lit(1))
    picked = F.when(v.isNotNull(), F.coalesce(names, F.array().cast("array<string>"))).otherwise(loose)
    return F.filter(F.transform(picked, lambda x: F.trim(x)), lambda x: x != "")


def _members(df: DataFrame, variant: str, prefix: str) -> DataFrame:
    """Members of a JSON object or list, one row each; other values give none."""
    rows = df.sparkSession.tvf.variant_explode(F.col(variant).outer())
    return df.lateralJoin(rows.select(F.col("key").alias(f"{prefix}_key"), F.col("value").alias(f"{prefix}_value")))


def _kind(v: str) -> Column:
    return F.schema_of_variant(v)


def malformed(answer: Column) -> Column:
    """True for an answer that is null or no JSON object, which ``parse_ie_json`` gives no tuples for."""
    return ~F.coalesce(F.schema_of_variant(F.try_parse_json(answer)).startswith("OBJECT"), F.lit(False))


def parse_ie_json(df: DataFrame, answer: str, task: str, keep: Sequence[str]) -> DataFrame:
    """Tuples of a model's JSON answer, one row each; members of a wrong type are skipped
    (``malformed`` tells answers that are no object at all).

    NER: type, entity.  RE: relation, head, tail.  EE: type, trigger, argument, role (no
    argument: nulls).  EET: type, trigger.  KG: type, entity, attribute, value.
    """
    keep = list(keep)
    top = _members(df.select(*keep, F.try_parse_json(answer).alias("_v")).where(_kind("_v").startswith("OBJECT")), "_v", "t").drop("_v")
    if task == "KG":
        ents = _members(top.where(_kind("t_value").startswith("OBJECT")), "t_value", "e")
        attrs = _members(ents.where(_kind("e_value").startswith("OBJECT")), "e_value", "a")
        many = F.when(_kind("a_value").startswith("ARRAY"), F.try_variant_get("a_value", "$", "array<string>")).when(
            _kind("a_value") == "STRING", F.array(F.try_variant_get("a_value", "$", "string")))
        out = attrs.select(*keep, F.col("t_key").alias("type"), F.col("e_key").alias("entity"), F.col("a_key").alias("attribute"), F.explode(many).alias("value"))
        return out.where((F.lower("value") != "nan") & (F.col("value") != "无"))
    items = _members(top.where(_kind("t_value").startswith("ARRAY")), "t_value", "i").drop("t_value")
    text = lambda path: F.try_variant_get("i_value", path, "string")
    if task == "NER":
        return items.where(_kind("i_value") == "STRING").select(*keep, F.col("t_key").alias("type"), text("$").alias("entity"))
    objects = items.where(_kind("i_value").startswith("OBJECT"))
    if task == "RE":
        both = objects.select(*keep, F.col("t_key").alias("relation"), F.coalesce(text("$.subject"), text("$.head")).alias("head"), F.coalesce(text("$.object"), text("$.tail")).alias("tail"))
        return both.where(F.col("head").isNotNull() & F.col("tail").isNotNull())
    events = objects.select(*keep, F.col("t_key").alias("type"), F.coalesce(text("$.trigger"), F.lit("")).alias("trigger"), F.try_variant_get("i_value", "$.arguments", "variant").alias("_args"))
    if task == "EET":
        return events.drop("_args")
    rows = df.sparkSession.tvf.variant_explode_outer(F.col("_args").outer())
    args = events.lateralJoin(rows.select(F.col("key").alias("role"), F.col("value").alias("_val")))
    many = F.when(_kind("_val").startswith("ARRAY"), F.try_variant_get("_val", "$", "array<string>")).otherwise(F.array(F.try_variant_get("_val", "$", "string")))
    out = args.select(*keep, "type", "trigger", "role", F.explode_outer(many).alias("argument"))
    return out.where(F.col("argument").isNull() | (F.col("argument") != NAN))


# Fixed value: pattern of a generated sample line.
GENERATED = r"(?is)^.*Relation:\s*([^.]*)\..*?Context:\s*(.*?)\s*Head Entity:\s*(.*?)\. Head Type:\s*(.*?)\. Tail Entity:\s*(.*?)\. Tail Type:\s*(.*?)\.?\s*$"


def parse_generated(line: Column, entity_types: Sequence[str]) -> Column:
    """Record of a generated line with offsets found case-insensitively; null when a part is missing or a type is unknown."""
    part = lambda i: F.regexp_extract(line, GENERATED, i)
    rel, text, head, htype, tail, ttype = [part(i) for i in range(1, 7)]
    known = lambda x: x.isin(list(entity_types)) | F.replace(x, F.lit("_"), F.lit(" ")).isin(list(entity_types))
    def at(name):
        return find_first(F.lower(text), F.lower(name))
    ok = (rel != "") & (at(head) >= 0) & (at(tail) >= 0) & (head != "") & (tail != "") & known(htype) & known(ttype)
    def said(name):
        return F.substring(text, at(name) + 1, F.length(name))
    return F.when(ok, F.struct(rel.alias("relation"), text.alias("text"), said(head).alias("subj"), at(head).alias("subj_start"), (at(head) + F.length(head)).alias("subj_end"),
                               htype.alias("subj_type"), said(tail).alias("obj"), at(tail).alias("obj_start"), (at(tail) + F.length(tail)).alias("obj_end"), ttype.alias("obj_type")))


def fix_unk(span: Column, text: Column, unk: str = "<unk>") -> Column:
    """Replace unknown pieces of a span by what stands there in the text; unchanged without a match."""
    literal = F.transform(F.split(span, unk), lambda p: F.concat(F.lit("\\Q"), F.trim(p), F.lit("\\E")))
    pattern = F.array_join(literal, r"\s*\S+\s*")
    found = strip(F.call_function("regexp_extract", text, pattern, F.lit(0)))
    return F.when(F.contains(span, F.lit(unk)) & (found != ""), found).otherwise(span)


# Characters and articles dropped when answers are compared.
ANSWER_PUNCTUATION = r"[!\"#$%&()*+,\-./:;<=>?@\[\]\\^`{|}~_']"
ARTICLES = r"(?U)\b(a|an|the)\b"


def norm_answer(s: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(s), ANSWER_PUNCTUATION, " "), ARTICLES, " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def label_words(label: Column) -> Column:
    """Relation name as words; ``no_relation`` is ``None``."""
    words = F.translate(F.substring_index(F.lower(label), "(", 1), ":_", "  ")
    full = F.replace(F.replace(words, F.lit("per"), F.lit("person")), F.lit("org"), F.lit("organization"))
    return F.when(label == "no_relation", "None").otherwise(full)


# Bracket tokens of treebank text.
PTB = {"-lrb-": "(", "-rrb-": ")", "-lsb-": "[", "-rsb-": "]", "-lcb-": "{", "-rcb-": "}"}


def ptb_tokens(tokens: Column) -> Column:
    def one(w: Column) -> Column:
        out = F
        for name, mark in PTB.items():
            out = out.when(F.lower(w) == name, F.lit(mark))
        return out.otherwise(w)
    return F.transform(tokens, one)


def wordpiece_join(pieces: Column) -> Column:
    return F.regexp_replace(F.array_join(pieces, " "), " ##", "")


def schema_key(head_type: Column, relation: Column, tail_type: Column) -> Column:
    return F.concat_ws("_", head_type, relation, tail_type)


def schema_parts(key: Column) -> Column:
    """Parts of ``head_relation_tail``; the relation may hold ``_``."""
    part = lambda i: F.regexp_extract(key, "^([^_]*)_(.*)_([^_]*)$", i)
    return F.struct(part(1).alias("head_type"), part(2).alias("relation"), part(3).alias("tail_type"))


def dialog_rename(text: Column, x: Column, y: Column) -> Column:
    """(text, x, y) with the two speakers asked about replaced by placeholders."""
    clean = F.replace(F.regexp_replace(F.replace(text, F.lit("’"), F.lit("'")), r"(?U)\bim\b", "i"), F.lit("..."), F.lit("."))
    speaker = lambda s: s.rlike("^speaker [0-9]+$")
    one, two = F.lit("[unused1]"), F.lit("[unused2]")
    first, second = speaker(x), speaker(y) & (x != y)
    def swap(s, ok, name, mark):
        return F.when(ok, F.replace(s, F.concat(name, F.lit(":")), F.concat(mark, F.lit(" :")))).otherwise(s)
    new_y = F.when(first & (x == y), one).when(second, two).otherwise(y)
    return F.struct(swap(swap(clean, first, x, one), second, y, two).alias("text"), F.when(first, one).otherwise(x).alias("x"), new_y.alias("y"))


# ---- attribute values ------------------------------------------------------------------------

def format_attr(value: Column, operations: bool = False) -> Column:
    """Attribute JSON as text: strings as they are, lists joined by ``; ``, objects ``k: v``.

    Objects inside objects give ``k (a: b, ...)``, objects inside lists ``(a: b, ...)``, and
    operations ``name: description (用途: usage)``.  Empty values give ''.
    """
    v = F.try_parse_json(value)
    raw = lambda x, path="$", kind="string": F.try_variant_get(x, path, kind)
    def pairs(x: Column) -> Column:
        return F.transform(F.map_entries(x), lambda e: F.concat(e["key"], F.lit(": "), raw(e["value"])))
    def item(x: Column) -> Column:
        inner = raw(x, "$", "map<string,variant>")
        return F.when(inner.isNotNull(), F.concat(F.lit("("), F.array_join(pairs(inner), ", "), F.lit(")"))).otherwise(raw(x))
    def operation(x: Column) -> Column:
        name = F.coalesce(raw(x, "$.name"), raw(x, "$.operation_name"), F.lit(""))
        desc, use = raw(x, "$.description"), raw(x, "$.typical_usage")
        text = F.concat(name, F.when(desc != "", F.concat(F.lit(": "), desc)).otherwise(""), F.when(use != "", F.concat(F.lit(" (用途: "), use, F.lit(")"))).otherwise(""))
        return F.when(raw(x, "$", "map<string,variant>").isNotNull(), text).otherwise(raw(x))
    def member(e: Column) -> Column:
        inner = raw(e["value"], "$", "map<string,variant>")
        return F.when(inner.isNotNull(), F.concat(e["key"], F.lit(" ("), F.array_join(pairs(inner), ", "), F.lit(")"))).otherwise(F.concat(e["key"], F.lit(": "), raw(e["value"])))
    as_list, as_map = raw(v, "$", "array<variant>"), raw(v, "$", "map<string,variant>")
    listed = F.array_join(F.transform(as_list, operation if operations else item), "; ")
    mapped = F.array_join(F.transform(F.map_entries(as_map), member), "; ")
    return F.coalesce(F.when(v.isNull(), value), listed, mapped, raw(v), F.lit(""))


# ---- tokens ----------------------------------------------------------------------------------

def tokenize_basic(text: Column, lower: bool = True) -> Column:
    """Words: control characters dropped, CJK characters and punctuation isolated, accents stripped."""
    clean = F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\t\n\r]]|�", "")
    spaced = F.regexp_replace(clean, r"(\p{IsHan}|\p{P}|[$+<=>^`|~])", " $1 ")
    folded = F.regexp_replace(F.call_function("translate", F.lower(spaced) if lower else spaced, F.lit(_ACCENTED), F.lit(_PLAIN)), r"\p{Mn}", "")
    return F.filter(F.split(folded, r"\s+"), lambda w: w != "")


def _accent_table() -> tuple[str, str]:
    """Latin letters with marks and their base letters, by Unicode decomposition."""
    import unicodedata
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accent_table()


def tokens_to_ids(tokens: DataFrame, vocab: DataFrame, token: str = "token", unknown: int = 1) -> DataFrame:
    """Ids of a long token table; words outside the vocabulary get the unknown id."""
    ids = vocab.select(F.col("token").alias(token), F.col("id").alias("_id"))
    return tokens.join(ids, token, "left").withColumn("id", F.coalesce("_id", F.lit(unknown))).drop("_id")
