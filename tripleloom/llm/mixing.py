"""Mixing to target weights with soft membership.  DataFrame expressions throughout.

A naive Bayes classifier, counted from a labelled table, gives every document a posterior over the
domains.  Document rates between 0 and ``highest`` are then fitted so that the expected tokens of each
domain come as near to its target as they can: least squares by projected gradient steps from a rate of 1 for all.

With t the tokens, p the posteriors, T all tokens and w = t / T, the misfit is m = sum(w r p) - target and a document's
gradient p . m.  A projected gradient step from 1 gives r = clip(1 - p . y) with y = m / lambda, lambda being one over the step's
length, and the rates looked for are those whose own misfit is the m they step along: they minimise the squared misfit plus lambda
times the squared distance from 1, and as lambda falls, the misfit falls to the least there is.  That fixed point is an equation in
as many numbers as there are domains, the slope of a convex function, and is met by Newton steps in y, halved until the function falls;
plain steps need thousands of passes when a domain is rare.  The gap sum(w (r g + highest max(0, -g))), g = p . m, bounds how far half
the squared misfit may still be above the least within the bounds, and is given with the result.

A pass is a few sums for each domain.  A rate follows from the posteriors and y; no table of rates is joined back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.session import staged
from tripleloom.llm.common import word_count

# Strings whose share of a text tells languages and kinds of text apart.
MARKERS = ("é", "è", "ñ", "ó", "ü", "ä", "th", "ch", "qu", "ll", "ei", "nt", " de ", "TH", "!!", "|")
BINS = 24
STEPS = 40           # Newton steps for each weight at most
CLOSE = 1e-6         # largest misfit, as a share of all tokens, at which targets are met
PULLS = (1e-2, 1e-4, 1e-6)       # weights of the distance from 1, one after the other
EXACT = 1e-10        # a fixed point is met when its equation is met so closely
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.003)       # of a Newton step
HIGHEST = 100.0      # copies of a document
SMOOTH = 1.0
TEMPER = 0.5         # default targets: shares to this power,
MOST = 4.0           # but no domain wanted more often than this


def features(text: Column) -> Column:
    """One bin number for each marker, and one for the mean word length: cells of one long table."""
    whole = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.lit(1), F.length(whole))
    shares = [(F.length(whole) - F.length(F.replace(whole, F.lit(m), F.lit("")))) / chars for m in MARKERS]
    shares.append(F.least(F.lit(1.0), word_count(whole) / chars))
    return F.array(*[F.least(F.lit(BINS - 1), F.floor(F.lit(BINS) * F.cbrt(s)).cast("int")) + F.lit(BINS * i) for i, s in enumerate(shares)])


CELLS = BINS * (len(MARKERS) + 1)


def classifier(featured: DataFrame, labelled: DataFrame) -> dict:
    """Log weights of every (cell, domain) and the priors, from labelled (doc_id, domain).

    Rows with a null domain or without a document are left out; what comes to the driver is a table
    of cells x domains."""
    seen = featured.select("doc_id", "f").join(labelled.where("domain is not null"), "doc_id")
    counts = seen.select("domain", F.explode("f").alias("cell")).groupBy("domain", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
    domains = sorted({r["domain"] for r in counts})
    table = np.full((CELLS, len(domains)), SMOOTH)
    for r in counts:
        table[r["cell"], domains.index(r["domain"])] += r["n"]
    by_marker = table.reshape(len(MARKERS) + 1, BINS, len(domains))
    weights = np.log(by_marker / by_marker.sum(axis=1, keepdims=True)).reshape(CELLS, len(domains))
    docs = by_marker[0].sum(axis=0) if domains else np.zeros(0)
    return {"domains": domains, "weights": weights, "prior": np.log(docs / docs.sum()) if domains else docs}


def numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def posterior(f: Column, model: dict) -> Column:
    """Array of the domains' posteriors for an array of cells."""
    weights = F.array(*[numbers(row) for row in model["weights"]])
    logits = F.aggregate(f, numbers(model["prior"]), lambda acc, cell: F.zip_with(acc, F.get(weights, cell), lambda a, b: a + b))
    shifted = F.transform(F.array(logits), lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x))))[0]
    return F.transform(F.array(shifted), lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b)))[0]


def dot(p: Column, y: np.ndarray) -> Column:
    out = F.lit(0.0)
    for i, v in enumerate(y):
        out = out + p[i] * F.lit(float(v))
    return out


def rate_at(slope: Column, highest: float) -> Column:
    """The rate that a projected step from 1 along ``slope`` leads to."""
    return F.least(F.lit(highest), F.greatest(F.lit(0.0), 1.0 - slope))


def area(slope: Column, highest: float) -> Column:
    """The integral of ``rate_at`` over the slope, up to a constant."""
    edge = 1.0 - highest
    return F.when(slope >= 1.0, 0.5).when(slope <= edge, highest * slope + (edge - edge * edge / 2 - highest * edge)).otherwise(slope - slope * slope / 2)


def with_rate(df: DataFrame, fitted: dict, p: str = "p", name: str = "rate") -> DataFrame:
    return df.withColumn(name, rate_at(dot(F.col(p), fitted["step"]), fitted["highest"]))


def fit(docs: DataFrame, labelled: DataFrame, targets: dict | None = None, total: float | None = None, highest: float = HIGHEST) -> dict:
    """Classifier, targets, the step, what it reaches, half the squared misfit for each weight, and the gap that is left.

    ``targets``: weight of each domain (missing ones 0; scaled to sum 1); by default each domain's
    share of tokens to the power TEMPER, at most MOST times itself.  ``total``: tokens wanted, by default as many as there are.
    Targets that no rates within the bounds can meet are met as nearly as possible; ``reached`` says how near.
    Without a labelled row there are no domains and all rates stay 1.
    """
    highest = float(highest)
    featured = staged(docs.select("doc_id", word_count(F.col("text")).alias("t"), features(F.col("text")).alias("f")))
    model = classifier(featured, labelled)
    d = len(model["domains"])
    soft = staged(featured.select("doc_id", "t", (posterior(F.col("f"), model) if d else F.array().cast("array<double>")).alias("p")))
    all_tokens = float((soft.agg(F.sum("t")).first()[0] if d else 0) or 0)
    model["soft"] = soft
    if not all_tokens:
        return model | {"step": np.zeros(d), "targets": [], "reached": [], "highest": highest, "misfits": [], "gap": 0.0}
    p, share = F.col("p"), F.col("t") / all_tokens
    gram = [F.sum(share * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]
    row = soft.agg(*gram, *[F.sum(share * p[i]).alias(f"s{i}") for i in range(d)]).first()
    g, now = np.zeros((d, d)), np.array([row[f"s{i}"] for i in range(d)])
    for i in range(d):
        for j in range(i, d):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    if targets is None:
        want = np.minimum(now ** TEMPER / (now ** TEMPER).sum(), MOST * now)
    else:
        want = np.array([float(targets.get(x, 0.0)) for x in model["domains"]])
    want = want / want.sum() * ((total or all_tokens) / all_tokens)
    y = np.zeros(d)
    model |= {"targets": list(want), "highest": highest, "misfits": [0.5 * float((now - want) @ (now - want))], "gap": 0.0}
    for pull in PULLS:
        if np.abs(now - want).max() <= CLOSE:
            break
        for _ in range(STEPS):
            off = pull * y + want - now
            if np.abs(off).max() <= EXACT:
                break
            slope = dot(p, y)
            free = F.when((slope < 1.0) & (slope > 1.0 - highest), share).otherwise(0.0)
            row = soft.agg(F.sum(share * area(slope, highest)).alias("h"), *[F.sum(free * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]).first()
            for i in range(d):
                for j in range(i, d):
                    g[i, j] = g[j, i] = row[f"g{i}_{j}"]
            height = pull / 2 * float(y @ y) + float(want @ y) - row["h"]
            step = np.linalg.solve(pull * np.eye(d) + g, -off)
            tried, sums = [y + a * step for a in LENGTHS], []
            for k, x in enumerate(tried):
                at = dot(p, x)
                sums += [F.sum(share * area(at, highest)).alias(f"h{k}"), *[F.sum(share * rate_at(at, highest) * p[i]).alias(f"s{k}_{i}") for i in range(d)]]
            row = soft.agg(*sums).first()
            heights = [pull / 2 * float(x @ x) + float(want @ x) - row[f"h{k}"] for k, x in enumerate(tried)]
            totals = [np.array([row[f"s{k}_{i}"] for i in range(d)], float) for k in range(len(tried))]
            left = [np.abs(pull * x + want - s).max() for x, s in zip(tried, totals)]
            best = min(range(len(tried)), key=lambda k: heights[k])
            if heights[best] >= height - 1e-14:                  # the function is flat to rounding: go by its slope
                best = min(range(len(tried)), key=lambda k: left[k])
                if left[best] >= np.abs(off).max():
                    break
            y, now = tried[best], totals[best]
        model["misfits"].append(0.5 * float((now - want) @ (now - want)))
    g_ = dot(p, now - want)
    model["step"] = y
    gap = F.sum(share * (F.col("rate") * g_ + F.lit(highest) * F.greatest(F.lit(0.0), -g_)))
    model["gap"] = max(0.0, float(with_rate(soft, model).agg(gap).first()[0]))
    return model | {"reached": list(now)}


def drawn(rate_: Column, of: Column, seed: int = 11) -> Column:
    """``rate_`` rounded up or down by a hash of ``of``, so that its mean is the rate."""
    at = F.pmod(F.xxhash64(of, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return (F.floor(rate_) + F.when(at < rate_ - F.floor(rate_), 1).otherwise(0)).cast("int")


def rated(fitted: dict) -> DataFrame:
    """(doc_id, n_tokens, membership, rate, copies, wanted, reached, gap) of every row the fit saw; membership maps domains to
    posteriors, ``wanted`` and ``reached`` map them to shares of all tokens, the same in every row, as is the gap.

    Rows that repeat an id and text get equal values, a null id has a hash too, and null and empty
    texts have a rate as every text has.  Without domains the rate is 1 and membership empty."""
    names = F.array(*[F.lit(x) for x in fitted["domains"]]).cast("array<string>")
    shares = lambda name: F.map_from_arrays(names if fitted[name] else F.array().cast("array<string>"), numbers(fitted[name]).cast("array<double>")).alias(
        {"targets": "wanted"}.get(name, name))
    return with_rate(fitted["soft"], fitted).select(
        "doc_id", F.col("t").alias("n_tokens"), F.map_from_arrays(names, "p").alias("membership"), "rate", drawn(F.col("rate"), F.col("doc_id")).alias("copies"),
        shares("targets"), shares("reached"), F.lit(fitted["gap"]).alias("gap"))


def once(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` with costly columns that Catalyst works out once, however often they are used."""
    return docs.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def mixed(docs: DataFrame, fitted: dict, id_col: str = "doc_id") -> DataFrame:
    """The mixture: each row as many times as its copies say, columns as given, whatever their names.
    No row moves."""
    if not fitted["targets"]:
        return docs
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col("text").alias("text"))
    out = once(once(rows, f=features(F.col("text"))), p=posterior(F.col("f"), fitted))
    out = with_rate(out, fitted)
    return out.select("row", F.explode(F.array_repeat(F.lit(1), drawn(F.col("rate"), F.col("id"))))).select("row.*")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Domains of the labelled table: language and quality of the documents it covers."""
    one = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return (docs.where("lang is not null").select("doc_id", "lang").join(one, "doc_id")
            .select("doc_id", F.concat("lang", F.lit("/"), F.col("quality").cast("string")).alias("domain")))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rates of every document for domains of language and quality, with what is wanted and reached."""
    return rated(fit(docs, labelled_domains(docs, labels)))
