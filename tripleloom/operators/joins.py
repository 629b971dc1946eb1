"""Joins over triples, nodes, dictionaries and mentions.

Sides are broadcast only by the optimiser's own size check, except lists held by the
caller.  A hot key on the probe side of a shuffled join is split at run time by adaptive
execution (``session.configure`` turns the split on also where it costs a shuffle).  Look-ups
of given names in dictionaries salt the hot ones beforehand with ``salted_join``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.skew import first_seen, ranked, salted_join
from tripleloom.functions.text import let
from tripleloom.operators.dictionary import hits as synonym_hits  # noqa: F401  (dictionary joins are listed here too)
from tripleloom.operators.dictionary import words_inside


# ---- edges and nodes ---------------------------------------------------------------------

def edge_endpoints(edges: DataFrame, nodes: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Attach the attributes of both nodes to each edge (inner on both sides)."""
    def side(end: str) -> DataFrame:
        return nodes.select(F.col("name").alias(end), *[F.col(a).alias(f"{end}_{a}") for a in attributes])
    return edges.join(side("head"), ["head"]).join(side("tail"), ["tail"])


def undirected(edges: DataFrame, a: str = "head", b: str = "tail") -> DataFrame:
    """Every edge seen from both ends as ``near``/``far``; a self-loop once.  One scan, no shuffle."""
    one = F.struct(F.col(a).alias("near"), F.col(b).alias("far"), F.lit(True).alias("forward"))
    two = F.struct(F.col(b).alias("near"), F.col(a).alias("far"), F.lit(False).alias("forward"))
    views = F.when(F.col(a) == F.col(b), F.array(one)).otherwise(F.array(one, two))
    return edges.withColumn("_v", F.explode(views)).select("*", "_v.*").drop("_v")


def type_lookup(df: DataFrame, name: str, dictionary: DataFrame, default: str = "ENTITY") -> DataFrame:
    """Type of a name from ``(entity, type)``, with a default; ``matched`` tells which."""
    joined = salted_join(df, dictionary.select(F.col("entity").alias(name), F.col("type").alias("_type")), [name], "left")
    return joined.withColumn("type", F.coalesce("_type", F.lit(default))).withColumn("matched", F.col("_type").isNotNull()).drop("_type")


def names_exist(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each asked name, whether a node has it."""
    known = nodes.select("name").distinct().withColumn("_known", F.lit(True))
    return names.join(known, "name", "left").select(*names.columns, F.coalesce("_known", F.lit(False)).alias("exists"))


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends both exist as nodes."""
    names = nodes.select("name").distinct()
    by_head = edges.join(names.withColumnRenamed("name", "head"), ["head"], "left_semi")
    return by_head.join(names.withColumnRenamed("name", "tail"), ["tail"], "left_semi").select(*edges.columns)


def last_filled(value: str, order: str) -> Column:
    """Latest non-empty value of a group with its place; combines on the map side."""
    filled = F.col(value).isNotNull() & (F.col(value) != "")
    return F.max(F.when(filled, F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias(value)


def upsert_attributes(nodes: DataFrame, incoming: DataFrame, attributes: Sequence[str], order: str) -> DataFrame:
    """Merge attribute records into nodes; adds ``action`` updated, inserted, skipped or kept.

    A record goes to the node of its type and name, else to the first node of its name,
    else it makes a new node; records of one new name join its first record.  Later
    non-empty values win; name and type never change.

    Records are combined per name and type first, so the joins see each name a few times
    however often it arrives.
    """
    return merge_records(nodes, attribute_records(incoming, attributes, order), attributes)


def attribute_records(incoming: DataFrame, attributes: Sequence[str], order: str) -> DataFrame:
    """One record per name and type: when it first came (``_at``) and each attribute's last filled value with its place."""
    return (incoming.where(F.coalesce("name", F.lit("")) != "").groupBy("name", "type")
            .agg(F.min(order).alias("_at"), *[last_filled(a, order) for a in attributes]))


def merge_records(nodes: DataFrame, records: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``upsert_attributes`` for records that are one per name and type already."""
    attributes = list(attributes)
    exact = nodes.select("name", "type", F.col("type").alias("_exact"))
    by_name = nodes.groupBy("name").agg(F.min("type").alias("_any"))
    first_type = records.groupBy("name").agg(F.min_by("type", "_at").alias("_new"))
    aimed = (records.join(exact, ["name", "type"], "left").join(by_name, "name", "left")
             .join(first_type, "name").withColumn("type", F.coalesce("_exact", "_any", "_new"))
             .withColumn("_there", F.coalesce("_exact", "_any").isNotNull()))
    merged = aimed.groupBy("name", "type").agg(F.first("_there").alias("_there"), *[F.max(a)["v"].alias(f"_n_{a}") for a in attributes])
    given = F.coalesce(*[F.col(f"_n_{a}") for a in attributes], F.lit(None)).isNotNull()
    action = (F.when(F.col("_there").isNull(), "kept").when(~F.col("_there"), "inserted")
              .when(given, "updated").otherwise("skipped"))
    both = nodes.join(merged, ["name", "type"], "full")
    return both.select("name", "type", *[F.coalesce(f"_n_{a}", a).alias(a) for a in attributes], action.alias("action"))


# ---- labels and matching -----------------------------------------------------------------

def distant_label(samples: DataFrame, triples: DataFrame, order: Sequence[str], fold_case: bool = True,
                  default: str = "None") -> DataFrame:
    """Relation of the first triple with the sample's head and tail, else ``default``."""
    fold = F.lower if fold_case else (lambda c: F.col(c))
    known = (triples.select(fold("head").alias("_h"), fold("tail").alias("_t"), "relation", F.struct(*order).alias("_o"))
             .groupBy("_h", "_t").agg(F.min_by("relation", "_o").alias("_relation")))
    probe = samples.withColumn("_h", fold("head")).withColumn("_t", fold("tail"))
    joined = salted_join(probe, known, ["_h", "_t"], "left")
    return joined.select(*samples.columns, F.coalesce("_relation", F.lit(default)).alias("relation"))


def synonyms_inside(text: Column, dictionary: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Canonical names with a synonym inside the text, in dictionary order; for a list the caller holds."""
    hits = [F.when(_any(text, words), F.lit(name)) for name, words in dictionary]
    return F.array_compact(F.array(*hits))


def _any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def kg_membership(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rank names: those inside some node name first, then longer ones."""
    inside = words_inside(nodes, "name", names, "name")
    flagged = names.join(inside.withColumn("_in", F.lit(True)), "name", "left")
    keyed = flagged.select("name", F.coalesce("_in", F.lit(False)).alias("in_graph"),
                           F.when(F.col("_in"), 0).otherwise(1).alias("_a"), (-F.length("name")).alias("_b"))
    return ranked(keyed, [], ["_a", "_b", "name"], stage=True).drop("_a", "_b")


def gold_pred(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of the last gold and last predicted record per key, and gold records without prediction."""
    def last(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias(name))
    g, p = last(gold, "gold"), last(predicted, "predicted")
    return g.join(p, list(keys)), g.join(p, list(keys), "left_anti")


def mention_lookup(arguments: DataFrame, mentions: DataFrame) -> DataFrame:
    """Event arguments with the span of the entity mention they name, by document and id."""
    spans = first_seen(mentions.select("doc", "entity_id", "start", "end"), ["doc", "entity_id"], ["start", "end"])
    return arguments.join(spans, ["doc", "entity_id"])


# ---- pairs -------------------------------------------------------------------------------

def pair_ranges(entities: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """Unordered pairs i<j per sentence, one row per entity: its partners are ranks ``first``..``last``.

    This states every pair without listing n*(n-1)/2 rows, so one long sentence stays
    linear.  Sentences with one entity give nothing.
    """
    sizes = entities.groupBy(by).agg(F.count("*").alias("last"))
    at = ranked(entities, [by], order, "rank", stage=True)
    joined = at.join(sizes, [by])
    return joined.where(F.col("rank") < F.col("last")).withColumn("first", F.col("rank") + 1).withColumn(
        "pairs", F.col("last") - F.col("rank"))


def labelled_pairs(entities: DataFrame, gold: DataFrame, by: str, entity: str, none: str = "no_relation") -> DataFrame:
    """Ordered pairs with a gold label, and per sentence one row that counts all other ordered pairs.

    Gold rows are ``(by, head, tail, label)``; both ends must be entities of the sentence.
    The unlabelled pairs are stated by their number, never listed.
    """
    ends = entities.select(by, F.col(entity).alias("_e")).distinct()
    linked = gold.where(F.col("head") != F.col("tail"))
    for end in ("head", "tail"):
        linked = linked.join(ends.withColumnRenamed("_e", end), [by, end], "left_semi")
    linked = linked.select(by, "head", "tail", "label").distinct()
    sizes = ends.groupBy(by).agg(F.count("*").alias("_n"))
    known = linked.select(by, "head", "tail").distinct().groupBy(by).agg(F.count("*").alias("_k"))
    rest = (sizes.join(known, by, "left")
            .select(by, F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("tail"),
                    F.lit(none).alias("label"), (F.col("_n") * (F.col("_n") - 1) - F.coalesce("_k", F.lit(0))).alias("pairs")))
    listed = linked.select(by, F.col("head").cast("string"), F.col("tail").cast("string"), "label", F.lit(1).cast("long").alias("pairs"))
    return listed.unionByName(rest.where(F.col("pairs") > 0))


def new_pair_counts(entities: DataFrame, known: DataFrame, by: str, entity: str) -> DataFrame:
    """Per sentence, the number of ordered pairs not yet linked in either direction."""
    ends = entities.select(by, F.col(entity).alias("_e")).distinct()
    pairs = (known.where(F.col("head") != F.col("tail"))
             .select(by, F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).distinct())
    for end in ("a", "b"):
        pairs = pairs.join(ends.withColumnRenamed("_e", end), [by, end], "left_semi")
    linked = pairs.groupBy(by).agg((F.count("*") * 2).alias("_k"))
    sizes = ends.groupBy(by).agg(F.count("*").alias("entities"))
    return sizes.join(linked, by, "left").select(
        by, "entities", (F.col("entities") * (F.col("entities") - 1) - F.coalesce("_k", F.lit(0))).alias("new_pairs"))


def mention_facts(facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entity-level facts to distinct (head name, tail name, relation) over the names of the mentions."""
    names = mentions.select("doc", "entity", "name").distinct()
    heads = facts.join(names.select("doc", F.col("entity").alias("h"), F.col("name").alias("head_name")), ["doc", "h"])
    both = heads.join(names.select("doc", F.col("entity").alias("t"), F.col("name").alias("tail_name")), ["doc", "t"])
    return both.select("head_name", "tail_name", "relation").distinct()


def known_facts(facts: DataFrame, mentions: DataFrame, triples: DataFrame) -> DataFrame:
    """Distinct entity-level facts (doc, h, t, relation) of which some pair of names is a known triple (head_name, tail_name, relation).

    Names of an entity are rows (doc, entity, name), never pairs: a fact meets the names of its head, those meet the triples that begin
    with them, and what is left is looked up among the names of the tail, sorted and not held: what a name begins may be many rows a task.
    """
    facts, names = facts.select("doc", "h", "t", "relation").distinct(), mentions.select("doc", "entity", "name").distinct()
    triples = triples.select("head_name", "tail_name", "relation").distinct()
    heads = names.select("doc", F.col("entity").alias("h"), F.col("name").alias("head_name"))
    tails = names.select("doc", F.col("entity").alias("t"), F.col("name").alias("tail_name"))
    begun = triples.select("head_name", "relation").distinct()
    started = facts.join(heads, ["doc", "h"]).join(begun, ["head_name", "relation"], "left_semi")
    ended = started.join(triples, ["head_name", "relation"]).select("doc", "h", "t", "relation", "tail_name")
    return ended.join(tails, ["doc", "t", "tail_name"], "left_semi").select("doc", "h", "t", "relation").distinct()


# ---- spans -------------------------------------------------------------------------------

def spans_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open spans share a position."""
    return ~((e1 <= s2) | (s1 >= e2))


def relation_coverage(relations: DataFrame, spans: DataFrame) -> DataFrame:
    """Gold relations, those with both spans predicted, those with overlapping ends, candidate pairs.

    ``relations``: doc, s1, e1, s2, e2; ``spans``: doc, start, end.
    """
    known = spans.select("doc", "start", "end").distinct()
    covered = relations
    for n in ("1", "2"):
        covered = covered.join(known.select("doc", F.col("start").alias(f"s{n}"), F.col("end").alias(f"e{n}")),
                              ["doc", f"s{n}", f"e{n}"], "left_semi")
    per_doc = known.groupBy("doc").agg(F.count("*").alias("n"))
    shared = spans_overlap(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    return relations.agg(F.count("*").alias("relations"), F.count_if(shared).alias("overlapping"),
                         covered.agg(F.count("*")).scalar().alias("covered"),
                         per_doc.agg(F.sum(F.col("n") * (F.col("n") - 1))).scalar().alias("candidates"))


def closest(starts: Column, at: Column) -> Column:
    """Nearest start to a position; ties go to the smaller one."""
    return F.array_min(let(F.struct(starts.alias("s"), at.alias("a")), lambda v: F.transform(
        v["s"], lambda p: F.struct(F.abs(p - v["a"]).alias("gap"), p.alias("start")))))["start"]


def closest_pair(a: Column, b: Column) -> Column:
    """The nearest pair between two lists of starts, in one pass over the merged order.

    Returns ``(gap, a, b)``; ties go to the smaller position.
    """
    def tag(side: Column, which: int) -> Column:
        return F.transform(side, lambda p: F.struct(p.cast("int").alias("p"), F.lit(which).alias("w")))

    merged = F.array_sort(F.concat(tag(a, 0), tag(b, 1)))
    none = F.lit(None).cast("int")
    best0 = F.lit(None).cast("struct<gap:int,a:int,b:int>")
    start = F.struct(none.alias("la"), none.alias("lb"), best0.alias("best"))

    def step(acc: Column, x: Column) -> Column:
        is_a = x["w"] == 0
        la = F.when(is_a, x["p"]).otherwise(acc["la"])
        lb = F.when(is_a, acc["lb"]).otherwise(x["p"])
        pair = F.when(la.isNotNull() & lb.isNotNull(), F.struct(F.abs(la - lb).alias("gap"), la.alias("a"), lb.alias("b")))
        return F.struct(la.alias("la"), lb.alias("lb"), F.least(acc["best"], pair).alias("best"))

    return F.aggregate(merged, start, step, lambda acc: acc["best"])
