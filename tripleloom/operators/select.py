"""Windows, ordering, top-k, set operations and deduplication."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions import constants as K
from tripleloom.functions.session import staged
from tripleloom.functions.skew import first_seen, prefix_sum, ranked, scalar, top_k
from tripleloom.functions.text import let
from tripleloom.operators.aggregate import endpoints, value_counts


# ---- deduplication and sets ---------------------------------------------------------------

def dedup_triples(triples: DataFrame, order: Sequence[str]) -> DataFrame:
    return first_seen(triples, ["head", "relation", "tail"], order)


def undirected_links(links: DataFrame, order: Sequence[str]) -> DataFrame:
    """One link per unordered pair and relation, in the orientation seen first."""
    keyed = links.withColumn("_a", F.least("head", "tail")).withColumn("_b", F.greatest("head", "tail"))
    return first_seen(keyed, ["_a", "_b", "relation"], order).drop("_a", "_b")


def node_union(triples: DataFrame) -> DataFrame:
    """Distinct (name, type) over both sides, from one scan."""
    side = lambda s: F.struct(F.col(s).alias("name"), F.col(f"{s}_type").alias("type"))
    return triples.select(F.explode(F.array(side("head"), side("tail"))).alias("n")).select("n.*").distinct()


def merge_datasets(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of datasets, the first row per key kept; earlier datasets come first."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    whole = tagged[0]
    for p in tagged[1:]:
        whole = whole.unionByName(p)
    return first_seen(whole, keys, ["_part", *order]).drop("_part")


def missing_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value): the values of the whole table that a key does not have, e.g. the types a sentence could have as negatives.

    Keys meet the list of all distinct values, the schema, and pairs that occur are taken out by an anti-join of distinct pairs; no
    key's own values are gathered.  Null values are no values.
    """
    pairs = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    every = pairs.select(value).distinct().agg(F.array_sort(F.collect_list(value))).scalar()
    return df.select(*keys).distinct().withColumn(value, F.explode(every)).join(pairs, [*keys, value], "left_anti")


def tp_fp_fn(gold: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set counts of two frames by a flagged union: one shuffle, no join."""
    both = (gold.select(*keys, F.lit(1).alias("_g"), F.lit(0).alias("_p"))
            .unionByName(predicted.select(*keys, F.lit(0).alias("_g"), F.lit(1).alias("_p"))))
    flags = both.groupBy(*keys).agg(F.max("_g").alias("g"), F.max("_p").alias("p"))
    return flags.agg(F.sum(F.col("g") * F.col("p")).alias("tp"),
                     F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"))


# ---- windows --------------------------------------------------------------------------------

def k_shot(df: DataFrame, label: str, key: str, k: int, seeds: Sequence[int]) -> DataFrame:
    """k rows per class for each seed, drawn by a seeded hash of the key."""
    drawn = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    drawn = drawn.withColumn("_h", F.md5(F.concat_ws("|", "seed", key)))
    return top_k(drawn, ["seed", label], [F.col("_h"), F.col(key)], k).drop("_h")


def context_tokens(sentences: Column, budget: int) -> Column:
    """For each sentence (token array) of a document: its tokens with neighbours up to ``budget``.

    Works on one document row; each item is at most ``budget`` tokens (or the sentence itself),
    so the result stays linear in the document.
    """
    def per_doc(v: Column) -> Column:
        def widen(s: Column) -> Column:
            n = F.size(s["tokens"])
            left = F.floor((budget - n) / 2).cast("int")
            right = budget - n - left
            add_left = F.when(left > 0, F.least(left, s["start"])).otherwise(0)
            after = F.size(v["all"]) - s["start"] - n
            add_right = F.when(right > 0, F.least(right, after)).otherwise(0)
            return F.struct(F.slice(v["all"], s["start"] - add_left + 1, add_left + n + add_right).alias("tokens"),
                            add_left.cast("int").alias("start"), (add_left + n).cast("int").alias("end"))
        return F.transform(v["s"], widen)
    return let(F.struct(F.flatten(F.transform(sentences, lambda s: s["tokens"])).alias("all"), sentences.alias("s")), per_doc)


def sentence_windows(sentences: Column, width: int) -> Column:
    """Sliding windows of ``width`` sentences (all of them when there are fewer)."""
    def windows(s: Column) -> Column:
        w = F.least(F.lit(width), F.size(s))
        return F.transform(F.sequence(F.lit(1), F.size(s) - w + 1), lambda i: F.struct((i - 1).alias("first"), F.slice(s, i, w).alias("sentences")))
    return let(sentences, windows)


def running_offset(sentences: DataFrame, by: Sequence[str], order: Sequence[str], length: str) -> DataFrame:
    """Start of each sentence: the sum of the lengths before it."""
    out = prefix_sum(sentences, by, order, F.col(length).cast("long"), "_incl", stage=True)
    return out.withColumn("start", F.col("_incl") - F.col(length)).drop("_incl")


def kfold(df: DataFrame, order: Sequence[str], folds: int = 10) -> DataFrame:
    """Contiguous folds: ``fold`` f tests rows [n*f/folds, n*(f+1)/folds); training is every other row."""
    total = df.agg(F.count(F.lit(1))).scalar()
    at = ranked(df, [], order, "_r").withColumn("_n", total)
    return at.withColumn("fold", F.floor((F.col("_r") * folds - 1) / F.col("_n")).cast("int")).drop("_r", "_n")


def tag_islands(tokens: DataFrame, by: str, pos: str, tag: str) -> DataFrame:
    """Chunks of consecutive tags from a long token table: (by, start, end, type).

    The tag before comes from an equi-join on the position and the chunk number from a
    running count in ranges, so one very long sentence is not sorted in one task.  Tokens may come of
    texts that are multiplied, which look small to the optimiser: the join is told to sort and merge.
    """
    prev = tokens.select(by, (F.col(pos) + 1).alias(pos), F.col(tag).alias("_before"))
    inside = tokens.where(F.col(tag) != "O").join(prev.hint("merge"), [by, pos], "left")
    opens = F.col(tag).startswith("B") | F.coalesce(F.col("_before") == "O", F.lit(True))
    numbered = prefix_sum(inside, [by], [pos], opens.cast("long"), "_chunk", stage=True)
    return numbered.groupBy(by, "_chunk").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"),
                                              F.min_by(F.substring(tag, F.lit(3), F.length(tag)), pos).alias("type")).drop("_chunk")


# ---- ordering and top-k --------------------------------------------------------------------

def by_confidence(df: DataFrame, order: Sequence[str], limit: int | None = None, compat: bool = False,
                  threshold: float | None = None) -> DataFrame:
    """Best rows by confidence, all of them unless a limit is stated.  Null confidences come last; ``compat`` puts them first and
    takes the limit before the threshold, as a graph database would."""
    first = F.col("confidence").desc_nulls_first() if compat else F.col("confidence").desc_nulls_last()
    keep = df if threshold is None else df.where(F.col("confidence") >= threshold - 1e-10)
    if limit is None:
        return keep.orderBy(first, *order)
    if compat:
        top = df.orderBy(first, *order).limit(limit)
        return top if threshold is None else top.where(F.col("confidence") >= threshold - 1e-10)
    return keep.orderBy(first, *order).limit(limit)


def names_containing(nodes: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    return nodes.where(F.col("name").contains(keyword)).select("name").distinct().orderBy("name").limit(limit)


def relation_score(topic: Column, head: Column, relation: Column, tail: Column, words: Sequence[str] = K.SCORING_WORDS) -> Column:
    """How much an edge says about a topic: places of the topic, and a telling relation word."""
    part = F.when(head == topic, 3).when(F.contains(head, topic), 2).otherwise(0)
    part = part + F.when(tail == topic, 2).when(F.contains(tail, topic), 1).otherwise(0)
    telling = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(relation, w))
    return part + F.coalesce(telling, F.lit(False)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for null, empty or zero vectors."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    def mul(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    norm = F.sqrt(total(mul(a, a))) * F.sqrt(total(mul(b, b)))
    return F.coalesce(F.when(norm > 0, total(mul(a, b)) / norm), F.lit(0.0))


def candidate_score(sim: Column, length: Column, named: Column, boosted: Column) -> Column:
    return sim * F.greatest(F.lit(1.0), F.sqrt(length)) * F.when(named, 1.2).otherwise(1.0) * F.when(boosted, 1.5).otherwise(1.0)


def links_by_degree(edges: DataFrame, chosen: DataFrame, order: Sequence[str], limit: int, few: bool = False) -> DataFrame:
    """Links inside the chosen nodes, by the sum of the degrees of their ends.

    Edges are written once and read for the degrees and for the links.  With ``few`` the caller has bounded the chosen nodes: these
    are broadcast, and only what touches them is shuffled.
    """
    inside = edges = staged(edges, "zstd")
    names = chosen.select("name")
    ends = endpoints(edges)
    deg = value_counts(ends.join(F.broadcast(names), "name", "left_semi") if few else ends, "name")
    known = names.join(deg, "name")
    for end in ("head", "tail"):
        side = known.select(F.col("name").alias(end), F.col("n").alias(f"_{end}"))
        inside = inside.join(F.broadcast(side) if few else side, end)
    return inside.withColumn("score", F.col("_head") + F.col("_tail")).orderBy(F.desc("score"), *order).limit(limit).drop("_head", "_tail")


def graph_caps(triples: DataFrame, order: Sequence[str], max_nodes: int = 20, max_links: int = 30) -> tuple[DataFrame, DataFrame]:
    """First nodes and links in first-seen order, for a display."""
    sides = F.array(F.struct(F.col("head").alias("name"), F.lit(0).alias("side")), F.struct(F.col("tail").alias("name"), F.lit(1).alias("side")))
    def seen(rows: DataFrame) -> DataFrame:
        return rows.select(F.struct(*order).alias("_at"), F.explode(sides).alias("e")).groupBy("e.name").agg(F.min(F.struct("_at", "e.side")).alias("_at"))

    def pairs(rows: DataFrame) -> DataFrame:
        return undirected_links(rows, order).select(F.struct(F.struct(*order).alias("_at")).alias("_at"))
    nodes = seen(_until(triples, order, seen, max_nodes)).orderBy("_at").limit(max_nodes).select("name")
    links = undirected_links(_until(triples, order, pairs, max_links), order).orderBy(*order).limit(max_links)
    return nodes, links


def _until(df: DataFrame, order: Sequence[str], seen: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """The rows up to the one by which ``seen`` has seen ``most`` things, so that only those are shuffled for them.

    That row is looked for among the first 50 of a thing; where these do not show so many things, all rows stay.  ``seen`` gives each thing's place
    as ``_at``.
    """
    early = seen(df.orderBy(*order).limit(50 * most)).orderBy("_at").limit(most)
    last = scalar(early.agg(F.when(F.count(F.lit(1)) == most, F.max("_at._at")).alias("last")))
    return df.withColumn("_last", last).where(F.col("_last").isNull() | (F.struct(*order) <= F.col("_last"))).drop("_last")


def length_sorted(df: DataFrame, text: str) -> DataFrame:
    """Rows ranged by length and sorted inside each partition, so that batches for a model are alike."""
    return df.withColumn("_len", F.length(text)).repartitionByRange("_len").sortWithinPartitions("_len").drop("_len")


def topic_pick(entities: DataFrame, types: Sequence[str], order: str, each: int = 25, total: int = 50) -> DataFrame:
    """``each`` first names of every listed type, topped up to ``total`` from the rest in order."""
    ranked_names = top_k(entities.where(F.col("type").isin(list(types))), ["type"], [F.col(order)], each).drop("rank")
    first = entities.join(ranked_names.select("name").withColumn("_p", F.lit(0)), "name", "left")
    return first.orderBy(F.coalesce("_p", F.lit(1)), order).limit(total).drop("_p")
