"""The query surface of the graph: lookups, batches of questions, contexts, displays, pipelines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions import constants as K
from tripleloom.functions.skew import ranked, top_k
from tripleloom.operators import aggregate as A
from tripleloom.functions.session import staged
from tripleloom.operators import clean as C
from tripleloom.operators import joins as J
from tripleloom.operators import select as S

ATTRIBUTES = ["type", "description", "properties", "time_complexity", "space_complexity", "common_operations"]
EDGE_ORDER = ["row_no", "head", "relation", "tail"]
NO_ANSWER = "暂无可靠知识支持"


def with_attributes(found: DataFrame, nodes: DataFrame, a: str, b: str, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Attributes of both ends of each row found; the optimiser's size check picks the joins."""
    out = found
    for i, end in enumerate((a, b), 1):
        side = nodes.select(F.col("name").alias(end), *[F.col(x).alias(f"entity{i}_{x}") for x in attributes])
        out = out.join(side, end)
    return out


def _first(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """All rows, or the first ``limit`` when the caller states one."""
    return df if limit is None else df.orderBy(*order).limit(limit)


# ---- lookups by part of a name -----------------------------------------------------------

def entity_relations(edges: DataFrame, nodes: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Edges of the nodes whose name contains the text, seen from that node."""
    near = _first(J.undirected(edges).where(F.col("near").contains(text)), limit, *EDGE_ORDER, "near")
    return with_attributes(near.select("row_no", "near", "relation", "far"), nodes, "near", "far")


def entities_by_relation(edges: DataFrame, nodes: DataFrame, names: Sequence[str], relation: str, limit: int | None = None) -> DataFrame:
    """Directed edges whose source contains any of the names and whose relation contains the text."""
    source = reduce(or_, [F.col("head").contains(n) for n in names])
    hit = _first(edges.where(source & F.col("relation").contains(relation)), limit, *EDGE_ORDER)
    return with_attributes(hit.select("row_no", "head", "relation", "tail"), nodes, "head", "tail")


def relations_between(edges: DataFrame, nodes: DataFrame, a: str, b: str, bidirectional: bool = True, limit: int | None = None) -> DataFrame:
    """Edges between names containing a and b; in both directions every edge is seen from both ends."""
    if bidirectional:
        seen = J.undirected(edges)
        near, far = F.col("near"), F.col("far")
        hit = seen.where((near.contains(a) & far.contains(b)) | (near.contains(b) & far.contains(a)))
    else:
        hit = edges.withColumn("near", F.col("head")).withColumn("far", F.col("tail"))
        hit = hit.where(F.col("near").contains(a) & F.col("far").contains(b))
    return with_attributes(_first(hit, limit, *EDGE_ORDER, "near").select("row_no", "near", "relation", "far"), nodes, "near", "far")


# ---- lookups by exact name ---------------------------------------------------------------

def entity_relations_exact(edges: DataFrame, names: Sequence[str], threshold: float = 0.8, compat: bool = False) -> DataFrame:
    hit = edges.where(F.col("head").isin(list(names)) | F.col("tail").isin(list(names)))
    return S.by_confidence(hit, EDGE_ORDER, threshold=threshold, compat=compat)


def entities_by_relation_exact(edges: DataFrame, names: Sequence[str], relation: str, threshold: float = 0.8, compat: bool = False) -> DataFrame:
    return entity_relations_exact(edges.where(F.col("relation") == relation), names, threshold, compat)


def relations_between_exact(edges: DataFrame, a: str, b: str, threshold: float = 0.8, bidirectional: bool = True, compat: bool = False) -> DataFrame:
    forward = (F.col("head") == a) & (F.col("tail") == b)
    back = (F.col("head") == b) & (F.col("tail") == a)
    hit = edges.where(forward | back if bidirectional else forward).withColumn("direction", F.when(forward, "forward").otherwise("reverse"))
    return S.by_confidence(hit, EDGE_ORDER, threshold=threshold, compat=compat)


def path_text(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat_ws(" → ", head, relation, tail)


def seen_from(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The edges of the names (``near``, distinct), seen from them, a self-loop once.

    Edges are looked at from both ends in one pass: where they are costly to derive, two joins would derive them twice.  What moves is
    the name and the other end, not the name once more.
    """
    rest = [c for c in edges.columns if c not in ("head", "tail")]
    side = lambda near, far: F.struct(F.col(near).alias("near"), F.col(far).alias("far"), F.lit(near == "head").alias("forward"))
    ends = F.when(F.col("head") != F.col("tail"), F.array(side("head", "tail"), side("tail", "head"))).otherwise(F.array(side("head", "tail")))
    seen = edges.select(*rest, F.explode(ends).alias("_e")).select(*rest, "_e.*").join(names, "near")
    head, tail = F.when(F.col("forward"), F.col("near")).otherwise(F.col("far")), F.when(F.col("forward"), F.col("far")).otherwise(F.col("near"))
    return seen.select(*rest, "near", head.alias("head"), tail.alias("tail")).select(*edges.columns, "near")


def answer_questions(edges: DataFrame, questions: DataFrame, threshold: float = 0.8, limit: int | None = None) -> DataFrame:
    """Answers and traces of a whole table of questions ``(question, names, relation)`` in one job.

    Without a relation, all edges of the names; with one, only edges of that relation.
    Rank 1 is the answer; a question without an edge gets the fixed text.  ``limit`` keeps the best
    so many edges of a question when the caller states it.
    """
    names = questions.select("question", F.col("relation").alias("_asked"), F.explode(F.array_distinct("names")).alias("near"))
    strong = C.conf_filter(edges, threshold, "~>=").select(*EDGE_ORDER, "confidence")
    order = [F.col("confidence").desc_nulls_last(), *[F.col(o) for o in EDGE_ORDER]]
    asked = seen_from(strong, names.select("near").distinct())
    if limit is not None:       # no answer needs more of a name and relation, so a hub is cut before the join
        asked = top_k(asked, ["near", "relation"], order, limit, "_near_rank")
    hit = asked.join(names, "near").where(F.col("_asked").isNull() | (F.col("_asked") == F.col("relation")))
    once = hit.select("question", *EDGE_ORDER, "confidence").distinct()
    if limit is None:           # a hot question is ranked in ranges by many tasks
        once = once.withColumns({"_none": F.col("confidence").isNull(), "_least": -F.col("confidence")})
        best = ranked(once, ["question"], ["_none", "_least", *EDGE_ORDER], "rank", stage=True)
    else:
        best = top_k(once, ["question"], order, limit)
    traced = best.select("question", "rank", path_text(F.col("head"), F.col("relation"), F.col("tail")).alias("path"), "confidence")
    return (questions.select("question").join(traced, "question", "left")
            .select("question", F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("path", F.lit(NO_ANSWER)).alias("path"), "confidence"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node count, edge count and edges per relation as (measure, n) rows."""
    def one(df, name):
        return df.agg(A.rows().alias("n")).select(F.lit(name).alias("measure"), "n")
    per = A.value_counts(edges, "relation").select(F.concat(F.lit("relation:"), "relation").alias("measure"), "n")
    return one(nodes, "nodes").unionByName(one(edges, "edges")).unionByName(per)


# ---- contexts ------------------------------------------------------------------------------

def pick_attributes(seen: DataFrame, topic: str, order: Sequence[str], attributes: Sequence[str], length: int | None = None) -> DataFrame:
    """First filled value of each attribute over the edges of a topic, cut to ``length`` when stated.

    ``seen`` holds the attributes of the topic's own end of each edge.
    """
    def first(a: str) -> Column:
        value = F.trim(a)
        filled = F.when(value != "", value if length is None else F.substring(value, 1, length))
        return F.min_by(filled, F.when(filled.isNotNull(), F.struct(*order))).alias(a)
    return seen.groupBy(topic).agg(*[first(a) for a in attributes])


def context_batch(edges: DataFrame, nodes: DataFrame, topics: DataFrame, limit: int = 8, words: Sequence[str] = K.SCORING_WORDS, length: int | None = None) -> DataFrame:
    """The best ``limit`` relations of every topic, with the topic's attributes.

    A hub's edges are cut to ``limit`` per task before the shuffle, by the group limit of
    the window.
    """
    named = topics.select(F.col("name").alias("near")).distinct()
    seen = seen_from(edges.select(*EDGE_ORDER), named)
    score = S.relation_score(F.col("near"), F.col("head"), F.col("relation"), F.col("tail"), words)
    best = top_k(seen.withColumn("score", score), ["near"], [F.desc("score"), *[F.col(o) for o in EDGE_ORDER]], limit)
    own = nodes.select(F.col("name").alias("near"), *[(F.trim(a) if length is None else F.substring(F.trim(a), 1, length)).alias(a) for a in ATTRIBUTES])
    return best.join(own, "near", "left").select(F.col("near").alias("topic"), "rank", "score", "head", "relation", "tail", *ATTRIBUTES)


def context_json(batch: DataFrame) -> DataFrame:
    """One JSON context per topic; at most ``limit`` relations each."""
    rels = F.transform(F.array_sort(F.collect_list(F.struct("rank", "head", "relation", "tail"))),
                       lambda r: F.struct(r["head"].alias("entity1"), r["relation"].alias("relation"), r["tail"].alias("entity2")))
    return batch.groupBy("topic", *ATTRIBUTES).agg(rels.alias("relations")).select(
        "topic", F.to_json(F.struct("topic", F.struct(*ATTRIBUTES).alias("attributes"), "relations")).alias("context"))


def evidence_lines(batch: DataFrame, length: int | None = None) -> DataFrame:
    """Evidence of each topic, one line per attribute and relation; attributes cut when a length is stated."""
    part = lambda a: F.col(a) if length is None else F.substring(a, 1, length)
    attrs = F.filter(F.array(*[F.when(F.col(a) != "", F.concat(F.lit(f"属性-{a}："), part(a))) for a in ATTRIBUTES]), lambda x: x.isNotNull())
    kind = batch.schema["rank"].dataType
    own = F.transform(F.when(F.col("rank") == 1, attrs).otherwise(F.array().cast("array<string>")), lambda x, i: F.struct((i - 100).cast(kind).alias("line"), x.alias("text")))
    rel = F.concat(F.lit("关系"), F.col("rank").cast("string"), F.lit("："), F.concat_ws(" ", "head", "relation", "tail"))
    # all lines of a row at once: a batch is costly to work out, and two passes would do it twice
    lines = F.concat(own, F.array(F.struct(F.col("rank").alias("line"), rel.alias("text"))))
    return batch.select("topic", F.explode(lines).alias("e")).select("topic", "e.*")


def relation_lines(found: DataFrame, order: Sequence[str], detailed: int = 5) -> DataFrame:
    """Numbered lines of a result, ``order`` being unique; the first five carry the attributes of both ends."""
    numbered = ranked(found, [], order, "no")
    def detail(i):
        return F.concat_ws("，", *[F.concat(F.lit(f"{a}: "), F.col(f"entity{i}_{a}")) for a in ATTRIBUTES])
    details = F.concat_ws("；", detail(1), detail(2))
    head = F.concat(F.col("no").cast("string"), F.lit(". "), F.concat_ws(" ", "head", "relation", "tail"))
    return numbered.select("no", F.when(F.col("no") <= detailed, F.concat_ws("\n", head, details)).otherwise(head).alias("text"))


# ---- displays ------------------------------------------------------------------------------

def type_group(type_: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.TYPE_GROUPS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, type_), F.lit(K.OTHER_GROUP))


def subgraph(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Display nodes (with group) and links, first 20 and first 30 in first-seen order."""
    n, links = S.graph_caps(edges, EDGE_ORDER)
    typed = F.broadcast(n).join(nodes.select("name", "type"), "name")
    shown = typed.withColumn("group", type_group(C.translate(F.col("type"), K.TYPE_NAMES)))
    return shown, links


def sample_nodes(edges: DataFrame, nodes: DataFrame, limit: int, seed: int, rounds: int = 3, share: float = 0.7, drawn: Column | None = None) -> DataFrame:
    """``limit`` nodes: 70 % by seeded hash, then neighbours of the chosen, then more by hash (``drawn``, where the caller has its own).

    The chosen set has at most ``limit`` rows in every round, so it is broadcast, and written, since the next round reads it twice;
    each round keeps the first free places by hash, and three rounds are planned.  Links meet the chosen where they lie and are not made
    distinct before: what they reach is.
    """
    order = [F.xxhash64("name", F.lit(seed)) if drawn is None else drawn, F.col("name")]
    every = nodes.select("name").distinct()
    chosen = staged(every.orderBy(*order).limit(int(limit * share)).select("name", F.lit(0).alias("round")))
    links = J.undirected(edges).select("near", "far")
    for i in range(1, rounds + 1):
        reached = links.join(F.broadcast(chosen.select(F.col("name").alias("near"))), "near").select(F.col("far").alias("name"), F.lit(i).alias("round")).distinct()
        chosen = staged(chosen.unionByName(reached).groupBy("name").agg(F.min("round").alias("round"))
                        .orderBy("round", *order).limit(limit))
    rest = every.select("name", F.lit(rounds + 1).alias("round"))
    return chosen.unionByName(rest).groupBy("name").agg(F.min("round").alias("round")).orderBy("round", *order).limit(limit)


# ---- utterances ------------------------------------------------------------------------------

def understand(texts: DataFrame, text: str, entities, relations, families=None) -> DataFrame:
    """Intent, entities and relations of each text from lists the caller holds."""
    return texts.select("*", C.intent_rules(F.col(text), families).alias("intent"),
                        J.synonyms_inside(F.col(text), entities).alias("entities"), J.synonyms_inside(F.col(text), relations).alias("relations"))


def route(asked: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Answer a table of understood utterances ``(id, intent, e1, e2, relation)``, each by its intent.

    Unknown intents, and relation questions without a relation, take the general route.
    """
    between, by_rel, define = [name for name, _ in K.INTENT_KEYWORDS]
    e = edges.select(*EDGE_ORDER)
    pair = asked.where(F.col("intent") == between)
    fwd = pair.join(e.withColumnRenamed("relation", "r"), (F.col("e1") == F.col("head")) & (F.col("e2") == F.col("tail")))
    back = pair.where(F.col("e1") != F.col("e2")).join(e.withColumnRenamed("relation", "r"), (F.col("e2") == F.col("head")) & (F.col("e1") == F.col("tail")))
    out = lambda df, name: df.select("id", F.lit(name).alias("route"), F.col("head").alias("source"), F.col("r").alias("relation"), F.col("tail").alias("target"))
    rel = asked.where((F.col("intent") == by_rel) & F.col("relation").isNotNull()).withColumnRenamed("relation", "r")
    ends = e.select(F.col("head").alias("e1"), F.col("relation").alias("r"), "tail")
    found = rel.join(ends, ["e1", "r"]).withColumn("head", F.col("e1"))
    defined = asked.where(F.col("intent") == define).join(nodes.select(F.col("name").alias("e1"), "type", "description"), "e1")
    defs = defined.select("id", F.lit(define).alias("route"), F.col("e1").alias("source"), F.col("type").alias("relation"), F.col("description").alias("target"))
    general = asked.where(~F.col("intent").isin(between, by_rel, define) | ((F.col("intent") == by_rel) & F.col("relation").isNull()))
    none = F.lit(None).cast("string")
    gen = general.select("id", F.lit("general").alias("route"), none.alias("source"), none.alias("relation"), none.alias("target"))
    return out(fwd, between).unionByName(out(back, between)).unionByName(out(found, by_rel)).unionByName(defs).unionByName(gen)


# ---- pipelines -------------------------------------------------------------------------------

def build(raw: DataFrame, schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from raw triples: normalise, drop invalid, first per triple, enforce the
    schema in one vocabulary, translate last."""
    c = F.col
    clean = raw.withColumn("head", C.norm_entity(c("head"))).withColumn("tail", C.norm_entity(c("tail")))
    clean = staged(clean.where(C.valid_triple(c("head"), c("relation"), c("tail"))))      # read for edges and for nodes
    legal = C.enforce_schema(S.dedup_triples(clean, ["row_no"]), schema)
    nodes = S.node_union(clean).withColumn("type", C.translate(c("type"), K.EXPORT_TYPE_NAMES))
    edges = legal.withColumn("relation", C.translate(c("relation"), K.RELATION_NAMES))
    return nodes, edges


def curate(edges: DataFrame) -> DataFrame:
    """Delete, rename, fill context."""
    return C.fill_context(C.curate_rename(C.curate_delete(edges)))


def curate_report(edges: DataFrame) -> DataFrame:
    """One row on a curation: deleted, renamed, filled, hubs, flagged hub relations, coverage."""
    kept = C.curate_delete(edges)
    fixed = C.curate_rename(kept)
    rules = {r[:3] for r in K.RENAME_RULES}
    renamed = reduce(or_, [(F.col("head_type") == h) & (F.col("relation") == r) & (F.col("tail_type") == t) for h, r, t in sorted(rules)])
    hubs, flagged = A.degree(fixed, K.HUB_DEGREE), A.hub_skew(fixed).where("flagged")
    return kept.agg((edges.agg(A.rows()).scalar() - A.rows()).alias("deleted"), F.count_if(renamed).alias("renamed"),
                    F.count_if(F.col("sentence").isNull()).alias("filled"), A.rows().alias("edges"),
                    hubs.agg(A.rows()).scalar().alias("hubs"), flagged.agg(A.rows()).scalar().alias("flagged"))


def expand(known: DataFrame, sentences: DataFrame, scorer, threshold: float = 0.5) -> DataFrame:
    """One expansion round: score sentences with a user scorer, keep what is new and sure, merge.

    ``scorer`` maps batches of ``sentences``, with all their columns, to (sentence, head, relation, tail,
    confidence); pairs are tried inside the batch and only scored triples come out.  ``known``, which
    may itself come from a model, is written once and read twice.
    """
    known = staged(known)
    scored = sentences.mapInPandas(scorer, "sentence string, head string, relation string, tail string, confidence double")
    sure = C.conf_filter(scored, threshold, ">")
    a, b = F.least("head", "tail").alias("_a"), F.greatest("head", "tail").alias("_b")
    linked = known.select("sentence", a, b).distinct()
    fresh = sure.select("*", a, b).join(linked, ["sentence", "_a", "_b"], "left_anti").drop("_a", "_b")
    return known.select(*fresh.columns).withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)))
