"""Answer and instruction texts of extraction tasks, built from one record's labels.

Schemas are lists the caller holds; labels are arrays of one record.  JSON is put together
from quoted parts, because one answer mixes lists, single values and nested objects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom.functions.text import let

NAN = "NAN"


def quoted(s: Column) -> Column:
    """JSON text of a string."""
    j = F.to_json(F.array(s))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(pairs: Column) -> Column:
    """Object of ``{k, v}`` pairs whose values are JSON already."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["k"]), F.lit(":"), p["v"])), ","), F.lit("}"))


def pair(k: Column, v: Column) -> Column:
    return F.struct(k.alias("k"), v.alias("v"))


def by_place(labels: Column, text: Column, value) -> Column:
    """Labels in the order their value occurs in the text; ties keep the given order."""
    def run(v: Column) -> Column:
        placed = F.transform(v["l"], lambda x, i: F.struct(F.call_function("instr", v["t"], value(x)).alias("p"), i.alias("i"), x.alias("x")))
        return F.transform(F.array_sort(placed), lambda p: p["x"])
    return let(F.struct(labels.alias("l"), text.alias("t")), run)


def scalar_or_list(values: Column) -> Column:
    """One value as a string, several as a list."""
    q = F.transform(values, quoted)
    return F.when(F.size(values) == 1, F.get(q, F.lit(0))).otherwise(json_list(q))


def _per_type(schema: Sequence[str], make) -> Column:
    return json_object(F.array(*[pair(F.lit(t), make(t)) for t in schema]))


def ner_answer(text: Column, labels: Column, schema: Sequence[str]) -> Column:
    """``{type: [entity, ...]}`` for labels ``{entity, entity_type}``; an absent type has an empty list."""
    return let(by_place(labels, text, lambda x: x["entity"]), lambda ls: _per_type(schema, lambda t: json_list(
        F.transform(F.filter(ls, lambda x: x["entity_type"] == t), lambda x: quoted(x["entity"])))))


def _head_tail(x: Column) -> Column:
    return json_object(F.array(pair(F.lit("head"), quoted(x["head"])), pair(F.lit("tail"), quoted(x["tail"]))))


def re_answer(text: Column, labels: Column, schema: Sequence[str]) -> Column:
    """``{relation: [{head, tail}, ...]}`` for labels ``{head, relation, tail}``."""
    return let(by_place(labels, text, lambda x: x["head"]), lambda ls: _per_type(schema, lambda t: json_list(
        F.transform(F.filter(ls, lambda x: x["relation"] == t), _head_tail))))


def spo_answer(text: Column, labels: Column, schema: Sequence[tuple[str, str, str]]) -> Column:
    """Like ``re_answer`` with the key ``head type_relation_tail type``."""
    def key(x: Column) -> Column:
        return F.concat_ws("_", x["head_type"], x["relation"], x["tail_type"])
    return let(by_place(labels, text, lambda x: x["head"]), lambda ls: _per_type(["_".join(s) for s in schema], lambda t: json_list(
        F.transform(F.filter(ls, lambda x: key(x) == t), _head_tail))))


def _arguments(event: Column, roles: Sequence[str]) -> Column:
    """``{role: value}``, ``NAN`` for an absent role; ``{}`` when every role is absent."""
    def values(role: str) -> Column:
        return F.array_distinct(F.transform(F.filter(event["arguments"], lambda a: (a["role"] == role) & (a["argument"] != "")), lambda a: a["argument"]))
    pairs = F.array(*[pair(F.lit(r), F.when(F.size(values(r)) == 0, F.lit(f'"{NAN}"')).otherwise(scalar_or_list(values(r)))) for r in roles])
    any_role = F.exists(event["arguments"], lambda a: a["role"].isin(list(roles)) & (a["argument"] != ""))
    return F.when(any_role, json_object(pairs)).otherwise(F.lit("{}"))


def ee_answer(text: Column, events: Column, schema: Sequence[tuple[str, Sequence[str]]], trigger: bool = True) -> Column:
    """``{event type: [{trigger, arguments}, ...]}``; without triggers only events with an argument."""
    def one(roles):
        def build(e: Column) -> Column:
            args = _arguments(e, roles)
            said = F.when(e["trigger"] == "", F.lit(NAN)).otherwise(e["trigger"])
            both = F.array(pair(F.lit("trigger"), quoted(said)), pair(F.lit("arguments"), args))
            return json_object(both) if trigger else F.when(args != "{}", json_object(F.array(pair(F.lit("arguments"), args))))
        return build
    def listed(ls: Column) -> Column:
        def make(t, roles):
            mine = F.filter(ls, lambda e: (e["event_type"] == t) & ((e["trigger"] != "") | (F.size(e["arguments"]) > 0)))
            return json_list(F.array_compact(F.transform(mine, one(roles))))
        return json_object(F.array(*[pair(F.lit(t), make(t, roles)) for t, roles in schema]))
    return let(by_place(events, text, lambda e: e["trigger"]), listed)


def eet_answer(text: Column, events: Column, schema: Sequence[str]) -> Column:
    """``{event type: [trigger, ...]}``."""
    return let(by_place(events, text, lambda e: e["trigger"]), lambda ls: _per_type(schema, lambda t: json_list(
        F.transform(F.filter(ls, lambda e: (e["event_type"] == t) & (e["trigger"] != "")), lambda e: quoted(e["trigger"])))))


def eea_answer(text: Column, events: Column, schema: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Arguments per event type, triggers given: the same shape as ``ee_answer``."""
    return ee_answer(text, events, schema, trigger=True)


def kg_answer(text: Column, labels: Column, schema: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """``{entity type: {head: {attribute: value}}}``; heads and values in text order."""
    def run(v: Column) -> Column:
        heads = F.array_distinct(F.transform(by_place(v["l"], v["t"], lambda x: x["head"]), lambda x: x["head"]))
        tails = by_place(v["l"], v["t"], lambda x: x["tail"])
        def attrs(h: Column, names: Sequence[str]) -> Column:
            def values(a: str) -> Column:
                return F.transform(F.filter(tails, lambda x: (x["head"] == h) & (x["relation"] == a)), lambda x: x["tail"])
            return json_object(F.array_compact(F.array(*[F.when(F.size(values(a)) > 0, pair(F.lit(a), scalar_or_list(values(a)))) for a in names])))
        return json_object(F.array(*[pair(F.lit(t), json_object(F.transform(heads, lambda h: pair(h, attrs(h, names))))) for t, names in schema]))
    return let(F.struct(labels.alias("l"), text.alias("t")), run)


# Marks of the bracketed target text.
MARKS = {"sent_start": "<extra_id_0>", "sent_end": "<extra_id_1>", "record_start": "<extra_id_0>", "record_end": "<extra_id_1>",
         "span_start": "<extra_id_0>", "span_end": "<extra_id_1>", "target_start": "<extra_id_5>"}
SPOT_PROMPT, ASOC_PROMPT, TEXT_START = "<spot>", "<asoc>", "<extra_id_2>"


def record_text(records: Column, name_first: bool = False, marks: dict = MARKS) -> Column:
    """Bracketed text of records ``{label, span, asocs: [{label, span}]}``, label or span first."""
    def sides(x: Column) -> list[Column]:
        a, b = (x["span"], x["label"]) if name_first else (x["label"], x["span"])
        return [a, F.lit(marks["target_start"]), b]
    def asoc(x: Column) -> Column:
        return F.concat_ws(" ", F.lit(marks["span_start"]), *sides(x), F.lit(marks["span_end"]))
    def one(r: Column) -> Column:
        return F.concat_ws(" ", F.lit(marks["record_start"]), *sides(r), F.transform(r["asocs"], asoc), F.lit(marks["record_end"]))
    return F.concat_ws(" ", F.lit(marks["sent_start"]), F.array_join(F.transform(records, one), " "), F.lit(marks["sent_end"]))


def schema_prefix(types: Column, roles: Column) -> Column:
    """Prompt of a schema: sorted types, then sorted roles, each after its mark."""
    said = lambda xs, mark: F.transform(F.array_sort(xs), lambda x: F.concat(F.lit(mark + " "), x))
    return F.concat(F.array_join(F.concat(said(types, SPOT_PROMPT), said(roles, ASOC_PROMPT)), " "), F.lit(f" {TEXT_START} "))


def schema_chunks(schema: Column, n: int) -> Column:
    """Schema list in pieces of ``n``; a rest shorter than max(1, n/2) joins the last piece; -1 is one piece."""
    if n == -1:
        return F.array(schema)
    def run(s: Column) -> Column:
        size = F.size(s)
        whole = F.greatest(F.floor(size / n).cast("int"), F.lit(1))
        rest = size - whole * n
        own = rest >= max(1, n // 2)
        pieces = F.when(own, whole + 1).otherwise(whole)
        return F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.slice(s, i * n + 1, F.when((i == whole - 1) & ~own, F.lit(2 * n)).otherwise(F.lit(n))))
    return F.when(F.size(schema) < n, F.array(schema)).otherwise(let(schema, run))


def instruction(prompt: str, schema: Column, text: Column) -> Column:
    return F.to_json(F.struct(F.lit(prompt).alias("instruction"), schema.alias("schema"), text.alias("input")))
