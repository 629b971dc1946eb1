"""Scores of predicted against gold extractions.

Both sides are exploded to keys, counted per key in one shuffle with map-side
combining, and summed; no pair of records is ever compared.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows() -> Column:
    return F.count(F.lit(1))


def key_text(cols: Sequence[str | Column]) -> Column:
    """One text key of several values; nulls are kept apart from empty text."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0002")) for c in cols]
    return F.concat_ws("\u0001", *parts)


def key_counts(gold: DataFrame, pred: DataFrame, instance: Sequence[str], kinds: Mapping[str, Sequence[str]],
               by: Sequence[str] = ()) -> DataFrame:
    """Gold and predicted counts per (kind, by, instance, key)."""
    def side(df: DataFrame, g: int) -> DataFrame:
        keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), key_text(cols).alias("key")) for k, cols in kinds.items()]))
        return df.select(*by, key_text(list(instance)).alias("inst"), keys.alias("_k"), F.lit(g).alias("g"), F.lit(1 - g).alias("p")).select(*by, "inst", "_k.*", "g", "p")
    both = side(gold, 1).unionByName(side(pred, 0))
    return both.groupBy("kind", *by, "inst", "key").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def matched(mode: str) -> Column:
    """True positives of one key: ``set``, ``normal`` (each gold once) or ``multimatch`` (gold reusable)."""
    g, p = F.col("g"), F.col("p")
    return {"set": F.when((g > 0) & (p > 0), 1).otherwise(0), "normal": F.least(g, p),
            "multimatch": F.when(g > 0, p).otherwise(0)}[mode]


def totals(counts: DataFrame, mode: str, by: Sequence[str] = ("kind",)) -> DataFrame:
    size = (lambda c: F.when(F.col(c) > 0, 1).otherwise(0)) if mode == "set" else F.col
    return counts.groupBy(*by).agg(F.sum(matched(mode)).cast("long").alias("tp"), F.sum(size("g")).cast("long").alias("gold"),
                                   F.sum(size("p")).cast("long").alias("pred"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(df: DataFrame, scale: float = 100.0) -> DataFrame:
    """Add precision, recall and F1 (zero where undefined) to tp, gold, pred."""
    p, r = ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("gold"))
    return (df.withColumn("P", p * scale).withColumn("R", r * scale)
            .withColumn("F1", ratio(2 * F.col("P") * F.col("R"), F.col("P") + F.col("R"))))


def tuple_f1(gold: DataFrame, pred: DataFrame, instance: Sequence[str], kinds: Mapping[str, Sequence[str]],
             mode: str = "normal") -> DataFrame:
    """P/R/F1 per kind of key."""
    return prf(totals(key_counts(gold, pred, instance, kinds), mode))


def record_key(type_: str, spot: str, args: str, ordered: bool) -> Column:
    """Canonical text of a record: arguments in order, or sorted when order does not count."""
    parts = F.transform(args, lambda a: F.concat_ws("=", a["role"].cast("string"), a["value"].cast("string")))
    return key_text([type_, spot, F.array_join(parts if ordered else F.array_sort(parts), ";")])


def record_f1(gold: DataFrame, pred: DataFrame, instance: Sequence[str], type_: str, spot: str, args: str,
              mode: str = "normal") -> DataFrame:
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_ord", record_key(type_, spot, args, True)).withColumn("_any", record_key(type_, spot, args, False))
    return tuple_f1(keyed(gold), keyed(pred), instance, {"ordered": ["_ord"], "unordered": ["_any"]}, mode)


def percent_f1(counts: DataFrame) -> DataFrame:
    """P and R in percent rounded to two decimals; F1 from the rounded values."""
    out = counts.withColumn("P", F.round(ratio(F.col("tp"), F.col("pred")) * 100, 2)).withColumn("R", F.round(ratio(F.col("tp"), F.col("gold")) * 100, 2))
    return out.withColumn("F1", F.round(ratio(2 * F.col("P") * F.col("R"), F.col("P") + F.col("R")), 2))


def nested_event(gold: DataFrame, pred: DataFrame, instance: str) -> DataFrame:
    """Event and argument counts; arguments count only under a matched (type, trigger).

    Rows are (instance, event_no, type, trigger, argument, role).  Events of one key
    collapse to the last; argument totals are taken before that.
    """
    key = [instance, "type", "trigger"]

    def last_args(df: DataFrame) -> DataFrame:
        last = df.groupBy(*key).agg(F.max("event_no").alias("event_no"))
        return df.join(last, [*key, "event_no"]).select(*key, "argument", "role").distinct()

    def numbers(df: DataFrame, side: str) -> DataFrame:
        return df.agg(F.count_distinct(instance, "event_no").alias(f"event_{side}"), rows().alias(f"argument_{side}"))

    g, p = last_args(gold), last_args(pred)
    events = g.select(*key).distinct().join(p.select(*key).distinct(), key).agg(rows()).scalar()
    args = g.join(p, [*key, "argument", "role"]).agg(rows()).scalar()
    one = numbers(gold, "gold").select("*", events.alias("event_tp"), args.alias("argument_tp"))
    p_sizes = numbers(pred, "pred")
    return one.select("*", p_sizes.select("event_pred").scalar().alias("event_pred"), p_sizes.select("argument_pred").scalar().alias("argument_pred"))


def smoothed(counts: DataFrame, eps: float) -> DataFrame:
    """P/R/F1 from tp, fn, fp that each start at ``eps``."""
    tp = F.col("tp") + eps
    p, r = tp / (F.col("pred") - F.col("tp") + eps + tp), tp / (F.col("gold") - F.col("tp") + eps + tp)
    return counts.withColumn("P", p).withColumn("R", r).withColumn("F1", 2 * F.col("P") * F.col("R") / (F.col("P") + F.col("R")))


def strict_relation(gold_ents: DataFrame, pred_ents: DataFrame, gold_rels: DataFrame, pred_rels: DataFrame, inst: str) -> DataFrame:
    """Entity, relation and strict relation counts: strict ones have two correct entities.

    Entities: inst, span, type.  Relations: inst, head, tail, label (head and tail are spans).
    """
    right = gold_ents.select(inst, "span", "type").distinct().join(pred_ents.select(inst, "span", "type").distinct(), [inst, "span", "type"])
    spans = right.select(inst, "span").distinct()
    hit = pred_rels.join(gold_rels.select(inst, "head", "tail", "label").distinct(), [inst, "head", "tail", "label"], "left_semi")
    strict = hit
    for end in ("head", "tail"):
        strict = strict.join(spans.withColumnRenamed("span", end), [inst, end], "left_semi")
    def row(kind, tp, gold, pred):
        return tp.agg(rows().alias("tp")).select(F.lit(kind).alias("kind"), "tp", gold.agg(rows()).scalar().alias("gold"), pred.agg(rows()).scalar().alias("pred"))
    ent_hit = pred_ents.join(gold_ents.select(inst, "span", "type").distinct(), [inst, "span", "type"], "left_semi")
    return prf(row("entity", ent_hit, gold_ents, pred_ents).unionByName(row("relation", hit, gold_rels, pred_rels))
               .unionByName(row("strict", strict, gold_rels, pred_rels)))


def gap_case(pred: Column, gold: Column, a: Column, b: Column) -> Column:
    """tp, fp, fn or none by containment of names in either direction; null means no name."""
    p, g = F.coalesce(pred, F.lit("PRED_NONE")), F.coalesce(gold, F.lit("GOLD_NONE"))
    def touch(x):
        return F.contains(x, p) | F.contains(p, x)
    return F.when(touch(g), "tp").when(touch(a) | touch(b), "fp").when(g != "GOLD_NONE", "fn").otherwise("none")


def span_count(gold: DataFrame, pred: DataFrame, instance: Sequence[str], key: Sequence[str], eps: float = 1e-13) -> DataFrame:
    """Multiset span counts, smoothed P/R/F1 and the share of instances predicted exactly."""
    counts = key_counts(gold, pred, instance, {"span": list(key)})
    exact = counts.groupBy("inst").agg(F.max((F.col("g") != F.col("p")).cast("int")).alias("off"))
    out = totals(counts, "normal").drop("kind").withColumn("P", F.col("tp") / (F.col("pred") + eps)).withColumn("R", F.col("tp") / (F.col("gold") + eps))
    return (out.withColumn("F1", 2 * F.col("P") * F.col("R") / (F.col("P") + F.col("R") + eps))
            .withColumn("exact", exact.agg(F.avg((F.col("off") == 0).cast("double"))).scalar()))


# ---- clusters --------------------------------------------------------------------------------

def _half(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def cluster_scores(gold: DataFrame, pred: DataFrame, doc: str, mention: str) -> DataFrame:
    """MUC, B3 and LEA from the sizes of cluster overlaps; no mention pairs.

    Both sides are (doc, mention, cluster) with each mention in one cluster per document.
    """
    g = gold.select(doc, mention, F.col("cluster").alias("gc"))
    p = pred.select(doc, mention, F.col("cluster").alias("pc"))
    cells = g.join(p, [doc, mention]).groupBy(doc, "gc", "pc").agg(rows().alias("n"))

    def one_side(df: DataFrame, own: str) -> DataFrame:
        size = df.groupBy(doc, own).agg(rows().alias("size"))
        inner = cells.groupBy(doc, own).agg(F.sum("n").alias("known"), rows().alias("linked"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(_half(F.col("n"))).alias("pairs"))
        c = size.join(inner, [doc, own], "left").na.fill(0, ["known", "linked", "sq", "pairs"])
        many = F.col("size") > 1
        links = _half(F.col("size"))
        return c.agg(F.sum(F.col("known") - F.col("linked")).alias("muc_n"), F.sum(F.col("size") - 1).alias("muc_d"),
                     F.sum(F.when(many, F.col("sq") / F.col("size"))).alias("b3_n"), F.sum(F.when(many, F.col("size"))).alias("b3_d"),
                     F.sum(F.when(many, F.col("size") * F.col("pairs") / links)).alias("lea_n"), F.sum(F.when(many, F.col("size"))).alias("lea_d"))

    measures = ["muc", "b3", "lea"]
    def unpivot(df, side):
        return df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), ratio(F.col(f"{m}_n"), F.col(f"{m}_d")).alias(side)) for m in measures])).alias("x")).select("x.*")
    both = unpivot(one_side(p, "pc"), "P").join(unpivot(one_side(g, "gc"), "R"), "measure")
    return both.withColumn("F1", ratio(2 * F.col("P") * F.col("R"), F.col("P") + F.col("R")))


def blanc(gold: DataFrame, pred: DataFrame, doc: str, mention: str) -> DataFrame:
    """Coreference and non-coreference link scores per document, from overlap sizes in closed form."""
    g = gold.select(doc, mention, F.col("cluster").alias("gc"))
    p = pred.select(doc, mention, F.col("cluster").alias("pc"))
    both = g.join(p, [doc, mention])

    def links(df, *keys):
        return df.groupBy(doc, *keys).agg(rows().alias("n")).groupBy(doc).agg(F.sum(_half(F.col("n"))).alias("l"), F.sum("n").alias("m"))

    parts = {"k": links(g, "gc"), "r": links(p, "pc"), "b": links(both, "gc", "pc"), "bk": links(both, "gc"), "br": links(both, "pc")}
    out = None
    for name, df in parts.items():
        df = df.select(doc, F.col("l").alias(f"l_{name}"), F.col("m").alias(f"m_{name}"))
        out = df if out is None else out.join(df, doc, "full")
    out = out.na.fill(0)
    col = F.col
    out = out.select(doc, col("l_b").alias("tp_c"), col("l_k").alias("c_k"), col("l_r").alias("c_r"),
                     (_half(col("m_b")) - col("l_bk") - col("l_br") + col("l_b")).alias("tp_n"),
                     (_half(col("m_k")) - col("l_k")).alias("n_k"), (_half(col("m_r")) - col("l_r")).alias("n_r"))
    def f(tp, a, b):
        return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(2 * tp / (a + b))
    f_c, f_n = f(col("tp_c"), col("c_k"), col("c_r")), f(col("tp_n"), col("n_k"), col("n_r"))
    return out.withColumn("F_c", f_c).withColumn("F_n", f_n).withColumn(
        "blanc", F.when(col("c_k") == 0, col("F_n")).when(col("n_k") == 0, col("F_c")).otherwise((col("F_c") + col("F_n")) / 2))


# ---- documents -------------------------------------------------------------------------------

def doc_relation(gold: DataFrame, pred: DataFrame, mentions: DataFrame, train: DataFrame) -> DataFrame:
    """Relation and evidence counts, and correct relations whose fact was seen in training.

    gold, pred: doc, r, h, t, evidence (array); mentions: doc, entity, name; train: head_name,
    tail_name, relation.  Evidence arrays hold sentence numbers of one document.
    """
    key = ["doc", "r", "h", "t"]
    from tripleloom.operators.joins import known_facts

    def once(df, name):
        return df.groupBy(*key).agg(F.max("evidence").alias(name))
    g, p = once(gold, "ge"), once(pred, "pe")
    hit = g.join(p, key)
    seen = known_facts(hit.select("doc", "h", "t", F.col("r").alias("relation")), mentions, train)
    shared = F.size(F.array_intersect("ge", "pe"))
    return hit.agg(rows().alias("tp"), F.coalesce(F.sum(shared), F.lit(0)).alias("evidence_tp"),
                   g.agg(rows()).scalar().alias("gold"), p.agg(rows()).scalar().alias("pred"),
                   g.agg(F.sum(F.size("ge"))).scalar().alias("evidence_gold"), p.agg(F.sum(F.size(F.array_distinct("pe")))).scalar().alias("evidence_pred"),
                   seen.agg(rows()).scalar().alias("seen"))


# ---- classes ---------------------------------------------------------------------------------

# Names of the negative class, the first one present is left out.
NEGATIVE_NAMES = ["NA", "na", "no_relation", "Other", "Others", "none", "None"]


def class_counts(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(rows().alias("n"))


def micro_no_neg(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Accuracy, and micro P/R/F1 without the negative class."""
    counts = class_counts(df, gold, pred)
    names = counts.select(F.explode(F.array("gold", "pred")).alias("c"))
    at = F.array_position(F.array(*[F.lit(n) for n in NEGATIVE_NAMES]), F.col("c"))
    neg = names.where(F.col("c").isin(NEGATIVE_NAMES)).agg(F.min_by("c", at)).scalar()
    c = counts.withColumn("neg", F.coalesce(neg, F.lit("\u0002")))
    same, n = F.col("gold") == F.col("pred"), F.col("n")
    real = lambda x: F.col(x) != F.col("neg")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    out = c.agg(total(same).alias("right"), F.sum("n").alias("all"), total(same & real("gold")).alias("tp"), total(real("gold")).alias("gold"), total(real("pred")).alias("pred"))
    return prf(out.withColumn("accuracy", ratio(F.col("right"), F.col("all"))), 1.0)


def class_report(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Per class: P, R, F1, support."""
    counts = class_counts(df, gold, pred)
    sides = F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")),
                    F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))
    sums = counts.select("n", (F.col("gold") == F.col("pred")).alias("same"), F.posexplode(sides).alias("i", "s"))
    per = sums.groupBy(F.col("s.label").alias("label")).agg(F.sum(F.when(F.col("same") & (F.col("i") == 0), F.col("n")).otherwise(0)).alias("tp"),
                                                            F.sum("s.g").alias("gold"), F.sum("s.p").alias("pred"))
    return prf(per, 1.0)


def macro_micro(df: DataFrame, gold: str, pred: str) -> DataFrame:
    report = class_report(df, gold, pred)
    return report.agg(F.avg("P").alias("macro_P"), F.avg("R").alias("macro_R"), F.avg("F1").alias("macro_F1"),
                      ratio(F.sum("tp"), F.sum("gold")).alias("micro_F1"))


def threshold_sweep(df: DataFrame, logits: str, gold: str, steps: int = 51) -> DataFrame:
    """F1 for each second threshold: classes over 0.5, else the best one if over the threshold, else none.

    ``logits`` is an array per row and ``gold`` the array of its true class numbers.  A row's picks change with the threshold only
    from its best class to none, so each row counts once, by the number of steps that its best class passes; sums over
    the steps from the last one back give every threshold.
    """
    probs = df.select(F.transform(logits, lambda x: 1 / (1 + F.exp(-x.cast("double")))).alias("pr"), F.col(gold).alias("g"))
    top = F.array_max("pr")
    one = probs.select("g", top.alias("top"), (F.array_position("pr", top) - 1).cast("int").alias("best"),
                       F.filter(F.transform("pr", lambda x, i: F.when(x > 0.5, i)), lambda i: i.isNotNull()).alias("high"))
    some = F.size("high") > 0
    passed = F.size(F.filter(F.sequence(F.lit(0), F.lit(steps - 1)), lambda s: F.col("top") > s / 100))
    right = F.when(some, F.size(F.array_intersect("high", "g"))).otherwise(F.array_contains("g", F.col("best")).cast("int"))
    picked = F.when(some, F.size("high")).otherwise(F.lit(1))
    # steps 0 .. passed - 1 count a row's picks; classes over 0.5 count at every step
    counts = one.select(F.when(some, F.lit(steps)).otherwise(passed).alias("passed"), F.size("g").alias("n_gold"), right.alias("tp"), picked.alias("pred"))
    held = counts.groupBy("passed").agg(F.sum("tp").alias("tp"), F.sum("pred").alias("pred"), F.sum("n_gold").alias("gold"))
    every = held.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))                   # at most (steps + 1) * steps rows
    reach = F.col("passed") > F.col("step")
    out = every.groupBy("step").agg(F.sum(F.when(reach, F.col("tp")).otherwise(0)).alias("tp"), F.sum("gold").alias("gold"), F.sum(F.when(reach, F.col("pred")).otherwise(0)).alias("pred"))
    p = F.when(F.col("pred") == 0, 1.0).otherwise(F.col("tp") / F.col("pred"))
    r = ratio(F.col("tp"), F.col("gold"))
    return out.withColumn("F1", ratio(2 * p * r, p + r))


def e2e_relation(df: DataFrame, gold: str, pred: str, none: str, all_gold: Column) -> DataFrame:
    """Precision, recall on the given pairs, and recall against all gold relations."""
    g, p = F.col(gold) != none, F.col(pred) != none
    out = df.agg(F.count_if(g).alias("n_gold"), F.count_if(p).alias("n_pred"), F.count_if(g & p & (F.col(gold) == F.col(pred))).alias("n_correct"), all_gold.alias("n_all"))
    return (out.withColumn("precision", ratio(F.col("n_correct"), F.col("n_pred"))).withColumn("task_recall", ratio(F.col("n_correct"), F.col("n_gold")))
            .withColumn("recall", ratio(F.col("n_correct"), F.col("n_all")))
            .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def argmax_softmax(logits: Column, labels: Sequence[str]) -> Column:
    """(label, probability) of the largest logit; ('', 0) when it has no label."""
    top = F.array_max(logits)
    at = F.array_position(logits, top)
    total = F.aggregate(F.transform(logits, lambda x: F.exp((x - F.array_max(logits)).cast("double"))), F.lit(0.0), lambda a, x: a + x)
    named = at <= len(labels)
    return F.struct(F.when(named, F.try_element_at(F.array(*[F.lit(n) for n in labels]), at.cast("int"))).otherwise("").alias("label"),
                    F.when(named, 1 / total).otherwise(0.0).alias("probability"))


# Singular and plural forms tried when an answer is no label word.
PLURALS = [("city", "cities"), ("country", "countries"), ("province", "provinces")]


def answer_match(answers: DataFrame, text: str, labels: DataFrame) -> DataFrame:
    """Relation of a free answer by label word, else by its plural forms; null where none fits.

    The answer is lower-cased and ends at the first full stop.
    """
    said = F.lower(F.substring_index(F.trim(text), ".", 1))
    tries = [said] + [F.when(F.contains(said, F.lit(a)), F.replace(said, F.lit(a), F.lit(b))) for a, b in PLURALS]
    out, found = answers, []
    for i, form in enumerate(tries):
        look = labels.select(F.col("word").alias(f"_w{i}"), F.col("relation").alias(f"_r{i}"))
        out = out.withColumn(f"_w{i}", form).join(look, f"_w{i}", "left")
        found.append(F.col(f"_r{i}"))
    return out.select(*answers.columns, F.coalesce(*found).alias("relation"))


def piece_best(tokens: Column, size: int, score) -> Column:
    """(score, piece) of the best piece of ``size`` tokens; the first one wins ties."""
    from tripleloom.functions.text import let
    def pieces(tk):
        starts = F.sequence(F.lit(0), F.floor((F.size(tk) - 1) / size).cast("int"))
        scored = F.transform(starts, lambda i: F.struct(score(F.slice(tk, i * size + 1, F.lit(size))).alias("score"), (-i).alias("neg")))
        return F.array_max(scored)
    return let(tokens, pieces)


# ---- generated text --------------------------------------------------------------------------

def entity_recall(texts: DataFrame, related: DataFrame, topic: str, key: str, text: str, entity: str) -> DataFrame:
    """Per text: related entities of its topic, and how many of them occur in it.

    Occurrences come from the dictionary match inside the topic, so a topic with many
    texts and many entities does not pair them all.
    """
    from tripleloom.operators.dictionary import hits
    names = related.select(topic, F.col(entity).alias("synonym")).distinct()
    sizes = names.groupBy(topic).agg(rows().alias("related"))
    words = names.select(topic, F.col("synonym").alias("canonical"), "synonym", F.lit(0).alias("dict_no"))
    found = hits(texts, key, text, words, scope=[topic]).groupBy(key).agg(rows().alias("found"))
    return (texts.drop(text).join(sizes, topic, "left").join(found, key, "left").na.fill(0, ["related", "found"]))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of a token array, joined by a space."""
    from tripleloom.functions.text import let
    return let(tokens, lambda t: F.filter(F.transform(t, lambda w, i: F.when(i + n <= F.size(t), F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)]))), lambda g: g.isNotNull()))


def gram_overlap(pairs: DataFrame, key: str, a: str, b: str, sizes: Sequence[int]) -> DataFrame:
    """Per pair and n: clipped common n-grams, and n-grams of both sides."""
    def side(col, flag):
        grams = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col(col), n).alias("g")) for n in sizes]))
        return (pairs.select(key, grams.alias("x")).select(key, "x.n", F.explode("x.g").alias("g"))
                .select("*", F.lit(flag).alias("a"), F.lit(1 - flag).alias("b")))
    counts = side(a, 1).unionByName(side(b, 0)).groupBy(key, "n", "g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counts.groupBy(key, "n").agg(F.sum(F.least("a", "b")).alias("common"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def bleu(pairs: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """Sentence BLEU-4 with equal weights; an order without a match counts 0.1 matches."""
    overlap = gram_overlap(pairs, key, reference, candidate, [1, 2, 3, 4])
    wide = overlap.groupBy(key).agg(*[F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}") for n in (1, 2, 3, 4) for c in ("common", "n_b")])
    sized = pairs.select(key, F.size(reference).alias("r"), F.size(candidate).alias("c")).join(wide, key, "left")
    def precision(n):
        hit, total = F.coalesce(F.col(f"common{n}"), F.lit(0)), F.greatest(F.coalesce(F.col(f"n_b{n}"), F.lit(0)), F.lit(1))
        return F.when(hit > 0, hit / total).otherwise(0.1 / total)
    mean = F.exp(sum((F.log(precision(n)) for n in (2, 3, 4)), F.log(precision(1))) / 4)
    brevity = F.when(F.col("c") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.greatest(F.col("c"), F.lit(1))))
    none = (F.coalesce(F.col("common1"), F.lit(0)) == 0) | (F.col("c") == 0)
    return sized.select(key, F.when(none, 0.0).otherwise(brevity * mean).alias("bleu"))


def rouge_f(common: Column, a: Column, b: Column) -> Column:
    """F of an overlap; 1 when both sides are empty, 0 when one is."""
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(2 * common / (a + b))


def rouge_n(pairs: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    overlap = gram_overlap(pairs, key, reference, candidate, [1, 2])
    wide = overlap.groupBy(key).agg(*[F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}") for n in (1, 2) for c in ("common", "n_a", "n_b")])
    wide = pairs.select(key).join(wide, key, "left").na.fill(0)
    return wide.select(key, *[rouge_f(F.col(f"common{n}"), F.col(f"n_a{n}"), F.col(f"n_b{n}")).alias(f"rouge{n}") for n in (1, 2)])


LCS_BLOCK = 4096     # words of one side that are compared with the other at once


def common_subsequence(x: list, y: list, block: int = LCS_BLOCK) -> int:
    """Length of the longest common subsequence: bits of a number stand for the words of ``x``, and each word of ``y`` is one addition.

    Long lists go block by block; what an addition carries out of a block enters the next one.  Memory is a block's bits for each
    word of the block, and one bit for each word of ``y``.
    """
    total, carry = 0, bytearray(len(y))
    for at in range(0, len(x), block):
        part, where = x[at:at + block], {}
        for i, w in enumerate(part):
            where[w] = where.get(w, 0) | (1 << i)
        size = len(part)
        full = (1 << size) - 1
        row = full
        for j, w in enumerate(y):
            hit = row & where.get(w, 0)
            added = row + hit + carry[j]
            carry[j] = added >> size
            row = (added & full) | (row - hit)
        total += size - row.bit_count()
    return total


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays (Arrow batches); null counts as empty."""
    @F.pandas_udf("int")
    def lcs(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([common_subsequence([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(xs, ys)], dtype="int32")
    return lcs(a, b)


def tfidf_cosine(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Cosine of TF-IDF vectors over character 1- and 2-grams, idf fitted on the two texts."""
    def chars(col):
        return F.filter(F.split(F.lower(col), ""), lambda ch: ch != "")
    split = pairs.select(key, chars(a).alias("_a"), chars(b).alias("_b"))
    def side(col, flag):
        grams = F.concat(F.col(col), F.filter(F.transform(F.col(col), lambda ch, i: F.concat(ch, F.get(F.col(col), i + 1))), lambda g: g.isNotNull()))
        return split.select(key, F.explode(grams).alias("g"), F.lit(flag).alias("a"), F.lit(1 - flag).alias("b"))
    tf = side("_a", 1).unionByName(side("_b", 0)).groupBy(key, "g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    idf = F.when((F.col("a") > 0) & (F.col("b") > 0), 1.0).otherwise(F.log(F.lit(1.5)) + 1)
    wa, wb = F.col("a") * idf, F.col("b") * idf
    sums = tf.groupBy(key).agg(F.sum(wa * wb).alias("ab"), F.sum(wa * wa).alias("aa"), F.sum(wb * wb).alias("bb"))
    return sums.select(key, ratio(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")).alias("similarity"))


def ground_truth(description: Column, properties: Column, operations: Column) -> Column:
    """Filled attributes on one line each; '' when there are none."""
    return F.concat_ws("\n", *[F.when(c != "", c) for c in (description, properties, operations)])
