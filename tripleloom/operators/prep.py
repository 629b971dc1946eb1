"""Training-set preparation: splits, samples, negatives, spans and rows.

Random choices are seeded hashes of the row's key, so a task that runs again makes the
same choice and exact sizes come from exact ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.skew import first_seen, ranked, top_k
from tripleloom.functions.text import let, match_sublist
from tripleloom.operators.aggregate import rows


def draw(seed: int, *key: Column | str) -> Column:
    """Seeded random text of a key: eight hex digits order and compare like a uniform number."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])), 1, 8)


def share(rate: float) -> str:
    """Hex bound below which a share ``rate`` of the draws lies."""
    return f"{min(int(rate * 2**32), 2**32 - 1):08x}"


# ---- splits ----------------------------------------------------------------------------------

def _cut(df: DataFrame, order: Sequence[str], parts: Sequence[tuple[str, float]], rest: str) -> DataFrame:
    """Name the part of each row by exact cut points ``int(n * share)`` in an order; the rest is last."""
    n = df.agg(rows()).scalar()
    at = ranked(df, [], order, "_r").withColumn("_n", n)
    part, bound = F, F.lit(0)
    for name, size in parts:
        bound = bound + F.floor(F.col("_n") * F.lit(size) + F.lit(1e-9))
        part = part.when(F.col("_r") <= bound, F.lit(name))
    return at.withColumn("part", part.otherwise(F.lit(rest))).drop("_r", "_n")


def split_random(df: DataFrame, key: str, seed: int = 42, train: float = 0.7, test: float = 0.2) -> DataFrame:
    drawn = df.withColumn("_d", draw(seed, key))
    return _cut(drawn, ["_d", key], [("train", train), ("test", test)], "valid").drop("_d")


def split_ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """80/10/10 in order; the parts are disjoint and the test part takes the rest."""
    return _cut(df, order, [("train", 0.8), ("valid", 0.1)], "test")


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Whole-set shuffle: a range sort by the draw, spilling as needed."""
    return df.withColumn("_d", draw(seed, key)).orderBy("_d", key).drop("_d")


def balance(df: DataFrame, label: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """Every class to exactly ``target`` rows: sampled down, or repeated whole with a sampled remainder.

    The place in the class comes from ``ranked``, so one big class is not sorted in one task.
    """
    sizes = df.groupBy(label).agg(rows().alias("_n"))
    at = ranked(df.withColumn("_d", draw(seed, key)), [label], ["_d", key], "_r").join(sizes, label)
    extra = F.when(F.col("_r") <= F.lit(target) % F.col("_n"), 1).otherwise(0)
    copies = F.when(F.col("_n") >= target, F.when(F.col("_r") <= target, 1).otherwise(0)).otherwise(F.floor(F.lit(target) / F.col("_n")) + extra)
    out = at.withColumn("_c", copies.cast("int")).where("_c > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c"))))
    return out.drop("_d", "_r", "_n", "_c")


# ---- negatives (schema lists are held by the caller, labels are one record's array) ------------

def by_draw(items: Column, seed: int, key: str) -> Column:
    """Items of an array in drawn order."""
    def run(v: Column) -> Column:
        return F.transform(F.array_sort(F.transform(v["x"], lambda x: F.struct(draw(seed, v["k"], x).alias("d"), x.alias("x")))), lambda s: s["x"])
    return let(F.struct(items.alias("x"), F.col(key).cast("string").alias("k")), run)


def _all(schema: Sequence[str]) -> Column:
    return F.array(*[F.lit(s) for s in schema])


def neg_all(positive: Column, schema: Sequence[str]) -> Column:
    """Every type of the schema absent from the record."""
    return F.array_except(_all(schema), positive)


def neg_sample(positive: Column, schema: Sequence[str], rate: float, seed: int, key: str) -> Column:
    """Positive types and a ``rate`` share of the absent ones; at least one when there is no positive.

    Rate 0 keeps positives only, a negative rate takes all absent types.
    """
    absent = neg_all(positive, schema)
    if rate == 0:
        return F.array_sort(positive)
    if rate < 0:
        return F.array_sort(F.concat(absent, positive))
    def run(v: Column) -> Column:
        picked = F.filter(v["x"], lambda x: draw(seed, v["k"], x) < share(rate))
        forced = (F.size(v["p"]) == 0) & (F.size(picked) == 0)
        return F.array_sort(F.concat(F.when(forced, F.slice(by_draw_of(v, seed), 1, 1)).otherwise(picked), v["p"]))
    return let(F.struct(absent.alias("x"), positive.alias("p"), F.col(key).cast("string").alias("k")), run)


def by_draw_of(v: Column, seed: int) -> Column:
    return F.transform(F.array_sort(F.transform(v["x"], lambda x: F.struct(draw(seed, v["k"], x).alias("d"), x.alias("x")))), lambda s: s["x"])


def neg_hard(positive: Column, schema: Sequence[str], hard: Mapping[str, Sequence[str]], others: int, seed: int, key: str) -> Column:
    """Positives, their hard negatives, and up to ``others`` more types by draw."""
    table = F.create_map(*[x for k, v in hard.items() for x in (F.lit(k), _all(v))])
    near = F.flatten(F.transform(positive, lambda p: F.coalesce(F.try_element_at(table, p), F.array().cast("array<string>"))))
    chosen = F.array_union(near, positive)
    return F.array_sort(F.array_union(chosen, F.slice(by_draw(F.array_except(_all(schema), chosen), seed, key), 1, others)))


def neg_prompt(positive: Column, schema: Sequence[str], keep: float, k: int, seed: int, key: str) -> Column:
    """Prompt candidates: a drawn share of the positives and ``k`` absent types (all when negative)."""
    kept = let(F.struct(positive.alias("p"), F.col(key).cast("string").alias("k")), lambda v: F.filter(v["p"], lambda x: draw(seed, v["k"], x) < share(keep)))
    absent = by_draw(neg_all(positive, schema), seed + 1, key)
    return F.array_sort(F.array_union(kept, absent if k < 0 else F.slice(absent, 1, k)))


def neg_cap(df: DataFrame, doc: str, key: str, negative: Column, n: int, seed: int) -> DataFrame:
    """All positive rows and the first ``n`` drawn negative rows of each document."""
    drawn = df.withColumn("_neg", negative).withColumn("_d", draw(seed, key))
    few = top_k(drawn.where("_neg"), [doc], [F.col("_d"), F.col(key)], n).drop("rank")
    return drawn.where("NOT _neg").unionByName(few).drop("_neg", "_d")


def neg_relation_rows(df: DataFrame, positive: str, schema: Sequence[str], k: int, seed: int, key: str) -> DataFrame:
    """One row per positive relation and per ``k`` drawn absent ones of each sentence."""
    absent = F.slice(by_draw(neg_all(F.col(positive), schema), seed, key), 1, k)
    tag = lambda xs, flag: F.transform(xs, lambda r: F.struct(r.alias("relation"), F.lit(flag).alias("is_positive")))
    return df.withColumn("_r", F.explode(F.concat(tag(F.col(positive), 1), tag(absent, 0)))).select(*[c for c in df.columns if c != positive], "_r.*")


# ---- records ---------------------------------------------------------------------------------

def type_sort(labels: Column, text: Column, seed: int) -> Column:
    """Relations by drawn type order, then first places of head and tail; an absent place is -100."""
    def place(t: Column, x: Column) -> Column:
        at = F.call_function("instr", t, x)
        return F.when(at > 0, at - 1).otherwise(-100)
    def run(v: Column) -> Column:
        keyed = F.transform(v["l"], lambda x: F.struct(draw(seed, x["relation"]).alias("d"), place(v["t"], x["head"]).alias("a"), place(v["t"], x["tail"]).alias("b"), x.alias("x")))
        return F.transform(F.array_sort(keyed), lambda s: s["x"])
    return let(F.struct(labels.alias("l"), text.alias("t")), run)


def weak_tags(tokens: Column, dictionary: Mapping[str, str]) -> Column:
    """Tags of tokens from a dictionary of one-token words the caller holds; others are ``O``."""
    table = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
    return F.transform(tokens, lambda w: F.coalesce(F.concat(F.lit("B-"), F.try_element_at(table, w)), F.lit("O")))


def span_tags(n: Column, spans: Column) -> Column:
    """BIO tags of one sentence from a few spans ``{start, end, type}``; the last span wins."""
    def run(v: Column) -> Column:
        def at(i: Column) -> Column:
            hit = F.filter(v["s"], lambda s: (s["start"] <= i) & (i < s["end"]))
            last = F.element_at(hit, -1)
            return F.when(F.size(hit) == 0, "O").otherwise(F.concat(F.when(last["start"] == i, "B-").otherwise("I-"), last["type"]))
        return F.transform(F.sequence(F.lit(0), v["n"] - 1), at)
    return let(F.struct(n.alias("n"), spans.alias("s")), run)


def event_rows(df: DataFrame, n: str, events: str) -> DataFrame:
    """Trigger tags and role tags per event; a sentence without events gives one all-O row.

    ``events``: array of {type, start, end, arguments: [{start, end, role}]}.
    """
    one = df.withColumn("e", F.explode_outer(events))
    none = F.array().cast("array<struct<start:int,end:int,type:string>>")
    trig = F.when(F.col("e").isNull(), none).otherwise(F.array(F.struct(F.col("e.start").cast("int").alias("start"), F.col("e.end").cast("int").alias("end"), F.col("e.type").alias("type"))))
    roles = F.coalesce(F.transform("e.arguments", lambda a: F.struct(a["start"].cast("int").alias("start"), a["end"].cast("int").alias("end"), a["role"].alias("type"))), none)
    return one.withColumn("trigger_tags", span_tags(F.col(n), trig)).withColumn("role_tags", span_tags(F.col(n), roles)).drop("e", events)


def pred_triggers(gold: DataFrame, predicted: DataFrame, line: str) -> DataFrame:
    """Gold rows with predicted trigger tags, and one extra row per predicted trigger no gold row covers.

    gold: line, tags (one row per event); predicted: line, tags.  Every leftover run of tags
    gives its own row, the last one included.
    """
    from tripleloom.functions.tags import bio_to_spans
    swapped = gold.join(predicted.select(line, F.col("tags").alias("_p")), line).select(
        line, F.zip_with("tags", "_p", lambda g, p: F.when(g != "O", p).otherwise("O")).alias("tags"), F.lit(0).alias("extra"))
    covered = gold.select(line, F.posexplode("tags").alias("pos", "tag")).where("tag <> 'O'").groupBy(line).agg(F.collect_set("pos").alias("_c"))
    left = predicted.join(covered, line, "left").withColumn("_c", F.coalesce("_c", F.array().cast("array<int>")))
    rest = left.select(line, let(F.struct(F.col("tags").alias("t"), F.col("_c").alias("c")), lambda v: F.transform(
        v["t"], lambda x, i: F.when(F.array_contains(v["c"], i), "O").otherwise(x))).alias("_rest"))
    runs = rest.select(line, "_rest", F.explode(bio_to_spans(F.col("_rest"))).alias("s"))
    extra = runs.select(line, let(F.struct(F.col("_rest").alias("t"), F.col("s").alias("s")), lambda v: F.transform(
        v["t"], lambda x, i: F.when((i >= v["s"]["start"]) & (i < v["s"]["end"]), x).otherwise("O"))).alias("tags"), F.lit(1).alias("extra"))
    return swapped.unionByName(extra)


def overlap_entities(entities: Column) -> Column:
    """Keep the first of overlapping entities ``{id, start, end}``; ``kept`` and the map ``{id, to}``.

    A fold over one sentence's entities in their order; the target is the kept entity at the
    last shared position.
    """
    kept_t, map_t = "array<struct<id:string,start:int,end:int>>", "array<struct<id:string,to:string>>"
    start = F.struct(F.array().cast(kept_t).alias("kept"), F.array().cast(map_t).alias("moved"))

    def step(acc: Column, e: Column) -> Column:
        def last_end(k: Column) -> Column:
            return F.struct(F.least(k["end"], e["end"]).alias("p"), k["id"].alias("id"))
        hits = F.transform(F.filter(acc["kept"], lambda k: (k["start"] < e["end"]) & (e["start"] < k["end"])), last_end)
        free = F.size(hits) == 0
        item = F.struct(e["id"].cast("string").alias("id"), e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"))
        move = F.struct(e["id"].cast("string").alias("id"), F.array_max(hits)["id"].alias("to"))
        return F.struct(F.when(free, F.array_append(acc["kept"], item)).otherwise(acc["kept"]).alias("kept"),
                        F.when(free, acc["moved"]).otherwise(F.array_append(acc["moved"], move)).alias("moved"))

    return F.aggregate(entities, start, step)


def role_list(arguments: DataFrame, event: Sequence[str], entity: str, order: Sequence[str]) -> DataFrame:
    """One role per (event, entity): the first in order."""
    return first_seen(arguments, [*event, entity], order)


def head_tail(df: DataFrame, key: str, entities: str) -> tuple[DataFrame, DataFrame]:
    """Head and tail from the first two entities by start, and the sentences that have none.

    ``entities``: array of {start, text, type}.  Equal names count as none.
    """
    ordered = df.withColumn("_e", F.array_sort(entities))
    first, second = F.get("_e", F.lit(0)), F.get("_e", F.lit(1))
    ok = F.coalesce(first["text"] != second["text"], F.lit(False))
    pairs = ordered.where(ok).select(key, *[e[c].alias(f"{n}_{c}") for n, e in (("head", first), ("tail", second)) for c in ("text", "start", "type")])
    return pairs, ordered.where(~ok).select(key).distinct()


def resolve_longest(candidates: Column, stopwords: Sequence[str]) -> Column:
    """Non-overlapping candidates ``{text, start}``, longest first, stop words and single characters out.

    A fold over one text's distinct candidates; a candidate without a place (-1) never overlaps.
    """
    usable = F.filter(F.array_distinct(candidates), lambda c: (F.length(F.trim(c["text"])) > 1) & ~c["text"].isin(list(stopwords)))
    keyed = F.array_sort(F.transform(usable, lambda c, i: F.struct((-F.length(c["text"])).alias("n"), i.alias("i"), c["text"].alias("text"), c["start"].cast("int").alias("start"))))
    empty = F.array().cast("array<struct<text:string,start:int,end:int>>")

    def step(acc: Column, c: Column) -> Column:
        end = c["start"] + F.length(c["text"])
        clash = (c["start"] >= 0) & F.exists(acc, lambda k: (k["start"] >= 0) & ~((end <= k["start"]) | (c["start"] >= k["end"])))
        return F.when(clash, acc).otherwise(F.array_append(acc, F.struct(c["text"].alias("text"), c["start"].alias("start"), end.alias("end"))))

    return F.aggregate(keyed, empty, step)


# Fixed value: two names joined by a word for "and", before a word that ends the phrase.
PAIR_PATTERN = r"([\x{4e00}-\x{9fa5}A-Za-z+]+?)(?:和|与)([\x{4e00}-\x{9fa5}A-Za-z+]+?)(?:的|之|，|,|。|关系|区别)"


def candidates(text: Column, found: Column, hits: Column, pattern: str = PAIR_PATTERN) -> Column:
    """Found names, dictionary hits and the two sides of ``X and Y`` phrases, each once."""
    side = lambda i: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), lambda x: F.trim(x))
    return F.filter(F.array_union(F.array_union(found, hits), F.array_union(side(1), side(2))), lambda x: x != "")


def graph_records(records: DataFrame, key: str, entity_types: Sequence[str], event_types: Sequence[str]) -> DataFrame:
    """Generated (type, spot, role, argument) rows to entity, relation and event rows.

    Types decide the kind; a relation's tail takes the type of the entity it names, else the
    type of its head; event roles stay only for known entities of the text, when it has any.
    """
    is_ent, is_event = F.col("type").isin(list(entity_types)), F.col("type").isin(list(event_types))
    entities = records.where(is_ent).select(key, F.col("spot").alias("text"), "type").distinct()
    known = entities.groupBy(key, "text").agg(F.max("type").alias("_t"))
    any_known = known.select(key).distinct().withColumn("_any", F.lit(True))
    none = F.lit(None).cast("string")
    look = known.withColumnRenamed("text", "argument")
    rel = records.where(is_ent & F.col("role").isNotNull()).join(look, [key, "argument"], "left")
    relations = rel.select(key, F.lit("relation").alias("kind"), F.col("role").alias("type"), F.col("spot").alias("a"), F.col("type").alias("a_type"), F.col("argument").alias("b"), F.coalesce("_t", "type").alias("b_type"))
    ev = records.where(is_event).join(look, [key, "argument"], "left").join(any_known, key, "left")
    keep = F.col("_t").isNotNull() | F.col("_any").isNull()
    events = ev.where(keep & F.col("role").isNotNull()).select(key, F.lit("event").alias("kind"), "type", F.col("spot").alias("a"), none.alias("a_type"), F.col("argument").alias("b"), F.col("role").alias("b_type"))
    ents = entities.select(key, F.lit("entity").alias("kind"), "type", F.col("text").alias("a"), none.alias("a_type"), none.alias("b"), none.alias("b_type"))
    return ents.unionByName(relations).unionByName(events)


# ---- offsets ---------------------------------------------------------------------------------

def _claim(tokens: Column, records: Column) -> Column:
    """Spans of records ``{type, tokens}`` by their first place not taken yet by the same text and type.

    Counting the earlier equal records gives the place directly.
    """
    def run(v: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            earlier = F.size(F.filter(F.slice(v["r"], F.lit(1), i), lambda q: q == r))
            return F.struct(r["type"].alias("type"), F.get(match_sublist(v["t"], r["tokens"]), earlier).alias("span"))
        return F.filter(F.transform(v["r"], one), lambda x: x["span"].isNotNull())
    return let(F.struct(tokens.alias("t"), records.alias("r")), run)


def offsets_first(tokens: Column, records: Column) -> Column:
    """Each record at its first free place, duplicates removed."""
    return F.array_distinct(_claim(tokens, records))


def offsets_longest(tokens: Column, records: Column) -> Column:
    """Longer records first, then as ``offsets_first``; a place inside a longer one's span is skipped."""
    def run(v: Column) -> Column:
        keyed = F.array_sort(F.transform(v["r"], lambda r, i: F.struct((-F.size(r["tokens"])).alias("n"), i.alias("i"), r.alias("r"))))
        empty = F.array().cast("array<struct<type:string,span:struct<start:int,end:int>>>")
        def step(acc: Column, k: Column) -> Column:
            free = F.filter(match_sublist(v["t"], k["r"]["tokens"]), lambda m: ~F.exists(acc, lambda a: (a["span"]["start"] <= m["end"]) & (m["start"] <= a["span"]["end"])))
            return F.when(F.size(free) == 0, acc).otherwise(F.array_append(acc, F.struct(k["r"]["type"].alias("type"), F.get(free, F.lit(0)).alias("span"))))
        return F.array_distinct(F.aggregate(keyed, empty, step))
    return let(F.struct(tokens.alias("t"), records.alias("r")), run)


def offsets_closest(tokens: Column, trigger: Column, roles: Column) -> Column:
    """Roles ``{type, tokens}`` at the place nearest to the trigger's start; ties to the smaller place."""
    def run(v: Column) -> Column:
        def one(r: Column) -> Column:
            near = F.array_min(F.transform(match_sublist(v["t"], r["tokens"]), lambda m: F.struct(F.abs(m["start"] - v["a"]).alias("gap"), m.alias("m"))))
            return F.struct(r["type"].alias("type"), near["m"].alias("span"))
        return F.filter(F.transform(v["r"], one), lambda x: x["span"].isNotNull())
    return let(F.struct(tokens.alias("t"), trigger.alias("a"), roles.alias("r")), run)


# ---- noise, augmentation, prompts ---------------------------------------------------------------

def noise(records: Column, labels: Sequence[str], rate: float, seed: int, key: str, null_span: str = "<null>") -> Column:
    """Insert null records ``{label, span}``: before each record with chance ``rate``, with a drawn label."""
    names = _all(labels)
    def run(v: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            pick = F.get(names, (F.conv(draw(seed + 1, v["k"], i), 16, 10).cast("long") % len(labels)).cast("int"))
            extra = F.struct(pick.alias("label"), F.lit(null_span).alias("span"))
            return F.when(draw(seed, v["k"], i) < share(rate), F.array(extra, r)).otherwise(F.array(r))
        return F.flatten(F.transform(v["r"], one))
    return let(F.struct(records.alias("r"), F.col(key).cast("string").alias("k")), run)


def augment_merge(df: DataFrame, parts: Sequence[str], limit: int | None = None) -> DataFrame:
    """New sentences from the alternatives of five parts (before, first, between, second, after).

    Every combination has a number whose digits, each to the base of a part's alternatives, choose one of each part; so a row gives
    its sentences in one step, all of them or the first ``limit`` when the caller states one.  A part without alternatives gives
    none.  Offsets are those of the new sentence; ``tail_first`` tells which entity stands first.
    """
    total = reduce(mul, [F.size(p).cast("long") for p in parts])
    many = total if limit is None else F.least(total, F.lit(limit).cast("long"))
    numbers = F.when(many > 0, F.sequence(F.lit(0).cast("long"), many - 1)).otherwise(F.array().cast("array<bigint>"))
    out = df.withColumn("_n", F.explode(numbers))
    for p in reversed(parts):
        out = (out.withColumn("_k", (F.col("_n") % F.size(p)).cast("int")).withColumn("_n", F.floor(F.col("_n") / F.size(p)).cast("long"))
               .withColumn(p, F.get(p, F.col("_k"))))
    out = out.drop("_n", "_k")
    a, b, c, d, e = parts
    start1 = F.length(a)
    start2 = start1 + F.length(b) + F.length(c)
    first, second = (F.col(b), start1), (F.col(d), start2)
    swap = F.col("tail_first")
    pick = lambda i, k: F.when(swap, (second, first)[i][k]).otherwise((first, second)[i][k])
    return out.select(*[x for x in df.columns if x not in parts and x != "tail_first"], F.concat(*parts).alias("sentence"),
                      pick(0, 0).alias("head"), pick(0, 1).alias("head_offset"), pick(1, 0).alias("tail"), pick(1, 1).alias("tail_offset"))


def dialog_flat(df: DataFrame, text: str, pairs: str, classes: int = 36) -> DataFrame:
    """One row per argument pair ``{x, y, rid}`` of a dialogue: prompt with text, and the label bits."""
    one = df.withColumn("p", F.explode(pairs))
    h, t = F.col("p.x"), F.col("p.y")
    prompt = F.concat(F.lit("what is the relation between "), h, F.lit(" and "), t, F.lit(" ? "), t, F.lit(" is the [MASK] "), h, F.lit(" ."))
    bits = F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda i: F.array_contains(F.col("p.rid"), i).cast("int"))
    return one.select(*[c for c in df.columns if c not in (text, pairs)], F.concat(prompt, F.col(text)).alias("text"), h.alias("head"), t.alias("tail"), bits.alias("label"))


def demo_prompt(df: DataFrame, relation: str, key: str, line: Column, k: int, seed: int) -> DataFrame:
    """A prompt per relation from ``k`` drawn demonstrations."""
    drawn = df.withColumn("_d", draw(seed, key)).withColumn("_line", line)
    few = top_k(drawn, [relation], [F.col("_d"), F.col(key)], k, "_rank")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_line"))), lambda x: x["_line"])  # at most k
    return few.groupBy(relation).agg(F.array_join(lines, "\n").alias("prompt"))


def retrieval_map(df: DataFrame, sentences: str, event_type: str, names: Mapping[str, str]) -> DataFrame:
    """Distinct retrieved sentences per mapped event type, one row each."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    mapped = F.coalesce(F.try_element_at(table, F.col(event_type)), F.col(event_type))
    return df.select(mapped.alias("event_type"), F.explode(sentences).alias("sentence")).distinct()


def blank_rows(df: DataFrame, sentence: str) -> DataFrame:
    """Sentences with empty head, tail, offset and type columns."""
    return df.select("*", *[F.lit("").alias(c) for c in ("head", "tail", "head_offset", "tail_offset", "head_type", "tail_type", "relation")])
