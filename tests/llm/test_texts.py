"""Toxicity, language, tokens, mixing and packing: brute force, held-out accuracy, edge cases."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import langid, mixing, packing, tokens, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing names."""
    rows = [(None, None, None, 1), (1, "", "en", 2), (1, "", "en", 2), (2, " \n\t", None, 3), (3, "word " * 60_000, "en", 4), (4, "12 !?", "xx", None), (5, "x" * 200_000, "en", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


# tokens ---------------------------------------------------------------------------------------------

def test_tokens_equal_the_library(docs):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY))
    for r in tokens.token_counts(docs.limit(300)).collect():
        assert r["n_tokens"] == len(library.encode(r["text"], add_special_tokens=False).ids)


def test_odd_texts_equal_the_library():
    from tokenizers import Tokenizer
    path = tokens.vocabulary_path(tokens.VOCABULARY)
    library, count = Tokenizer.from_file(path), tokens.Counter(path).count
    texts = ["", " ", "It's THE cat's; we'll don't", "a<|endoftext|>b", "<|startoftext|>", "<|endoftext", "naïve Ünïcode ŽŠ İıſ", "é ẛ̣", "数据 structure", "a\x1cb\x85c d e", "ΑΣ Σας",
             "x" * 5000, "1234 ½ ²", "'S 'T 'LL", "\U0001F600!!", "a­b", "tab\tnew\nline\r\n", "\x00", "ÀÉÎõü ÿ", "'", "''s's"]
    rnd = random.Random(1)
    texts += ["".join(rnd.choice("abcZ'st ré.!0ß\n") for _ in range(60)) for _ in range(300)]
    assert [count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert count(None) == 0


def test_token_query_edges(spark):
    out = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in tokens.query(odd(spark)).collect()}
    assert out[None, 0] == (0, False) and out[1, 0] == (0, False) and out[3, 300_000] == (60_000, True)
    assert tokens.query(odd(spark).limit(0)).count() == 0


# language -------------------------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    path = tokens.vocabulary_path(langid.VOCABULARY)
    p = langid.pieces(path)
    number = {name: i for i, name in enumerate(p.names)}
    prob = np.random.default_rng(2).random((p.size, 2))
    prob /= prob.sum(axis=0)
    for word in ("the", "maison", "ñandú", "zzz", "q"):
        w = langid.START + word
        total = np.zeros(2)
        for cut in itertools.product((0, 1), repeat=len(w) - 1):
            ends = [i + 1 for i, c in enumerate(cut) if c] + [len(w)]
            parts = [w[a:b] for a, b in zip([0, *ends], ends)]
            if all(x in number or len(x) == 1 for x in parts):
                total += np.prod([prob[number.get(x, p.size - 1)] for x in parts], axis=0)
        assert np.allclose(langid.word_scores([word], path, prob)[0], np.log(total))


def test_long_words_do_not_underflow():
    path = tokens.vocabulary_path(langid.VOCABULARY)
    prob = np.full((langid.pieces(path).size, 3), 1e-5)
    assert np.isfinite(langid.word_scores(["a" * 20_000, "ab"], path, prob)).all()


def test_expected_counts_equal_enumeration_and_long_runs_teach():
    path = tokens.vocabulary_path(langid.VOCABULARY)
    p = langid.pieces(path)
    prob = np.random.default_rng(3).random(p.size)
    prob /= prob.sum()

    def enumerate_counts(word):
        total, out = 0.0, np.zeros(p.size)
        word = langid.START + word
        number = {name: i for i, name in enumerate(p.names)}

        def walk(at, weight, used):
            nonlocal total
            if at == len(word):
                total += weight
                for u in used:
                    out[u] += weight
                return
            for l in range(1, min(langid.LONGEST, len(word) - at) + 1):
                k = number.get(word[at:at + l], p.size - 1 if l == 1 else None)
                if k is not None:
                    walk(at + l, weight * prob[k], [*used, k])
        walk(0, 1.0, [])
        return out / total
    words, weight = ["the", "aux", "a", "nationale"], np.array([1.0, 2.0, 1.0, 3.0])
    assert np.abs(langid.expected(words, weight, path, prob) - sum(w * enumerate_counts(x) for x, w in zip(words, weight))).max() < 1e-9
    got = langid.expected(["thecat" * 700], np.array([1.0]), path, prob)
    assert np.isfinite(got).all() and got.sum() > 700            # a run of 4,200 letters: at least a piece for every 16
    lengths = np.array([len(n) for n in p.names] + [1] * (p.size - len(p.names)))
    assert abs((got * lengths[:p.size]).sum() - 4201) < 1e-6


def test_held_out_languages(docs):
    rows = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, docs):
    got = langid.query(docs.select("doc_id", "text", "lang").limit(200).unionByName(odd(spark).drop("score").withColumn("doc_id", F.col("doc_id") - 1000)))
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in got.where("doc_id is null or doc_id < 0").collect()]
    assert len(out) == 7
    assert {x for x in out if x[0] in (None, -999, -998, -996)} == {(None, "und", 0.0), (-999, "und", 0.0), (-998, "und", 0.0), (-996, "und", 0.0)}
    empty = odd(spark).limit(0)
    assert langid.query(empty).count() == 0
    assert {r["lang_pred"] for r in langid.query(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# toxicity -------------------------------------------------------------------------------------------

def toxic_corpus(spark, n=900):
    rnd = random.Random(8)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        y = int(i % 6 == 0)
        text = [rnd.choice(plain) for _ in range(rnd.randint(20, 400))]
        if y:
            for _ in range(rnd.randint(1, 3)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["vile", "awful", "nasty"]))
        if i % 30 == 1:
            text += ["boiler", "plate", "copied"] * 40            # one passage, often copied: no sign of anything
        rows.append((i, " ".join(text)))
        labels.append((i, y))
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    rows = toxicity.query(docs, labels.where("doc_id % 3 < 2")).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 900 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == r["toxic"] for r in rows) > 0.98 * len(rows)
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in rows)


def test_counts_are_of_contexts(spark):
    df = spark.createDataFrame([("a b c a b c", 1), ("a b c", 0), ("x b y", 0)], "text string, label int")
    ids = {w: int(toxicity.word_ids(w)[0].view(np.int64)) for w in "abcxy"}
    got = {r["word"]: (r["n1"], r["n0"]) for r in toxicity.word_counts(df).collect()}
    assert got[ids["b"]] == (1, 2) and got[ids["a"]] == (1, 1) and got[ids["x"]] == (0, 1)


@pytest.mark.parametrize("flush", [7, 1_000_000])
def test_counts_do_not_switch_with_size(spark, monkeypatch, flush):
    monkeypatch.setattr(toxicity, "FLUSH", flush)
    rows = [(f"b{i} hot a{i}", 0) for i in range(700)] * 2 + [(f"b{i} hot a{i}", 1) for i in range(200)] * 3
    got = {r["word"]: (r["n1"], r["n0"]) for r in toxicity.word_counts(spark.createDataFrame(rows, "text string, label int")).collect()}
    assert got[int(toxicity.word_ids("hot")[0].view(np.int64))] == (200, 700)
    assert got[int(toxicity.word_ids("b5")[0].view(np.int64))] == (1, 1) and len(got) == 1401


def test_contexts_are_dealt_by_word_and_a_share(spark):
    """Rows of a word lie together in the shuffle, and those of a frequent word in several parts; they are moved once."""
    rows = [(f"b{i} hot a{i}", i % 2) for i in range(3000)]
    counts = toxicity.word_counts(spark.createDataFrame(rows, "text string, label int"))
    moves = [x for x in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert len(moves) == 2 and "share" not in moves[0] and "word" in moves[1] and "share" in moves[1]
    assert {r["word"]: (r["n1"], r["n0"]) for r in counts.collect()}[int(toxicity.word_ids("hot")[0].view(np.int64))] == (1500, 1500)


def test_toxicity_edges(spark):
    docs, labels = toxic_corpus(spark, 200)
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 7), (5, 1), (999, 1)], "doc_id long, toxic int"))
    both = docs.unionByName(odd(spark).select(F.col("doc_id") - 1000, "text").toDF("doc_id", "text"))
    out = toxicity.query(both, labels)
    assert out.count() == 207 and out.where("score is null or score < 0 or score > 1").count() == 0
    assert out.where("doc_id = -999 and predicted = 1").count() == 0
    assert {r["predicted"] for r in toxicity.query(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.query(docs.limit(0), labels).count() == 0


def test_tables_grow_with_the_words(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_SLOTS", 4)
    monkeypatch.setattr(toxicity, "MOST_SLOTS", 12)
    counts = spark.range(1, 5000).select((F.col("id") * 7919).alias("word"), F.lit(1).cast("long").alias("n1"), F.lit(2).cast("long").alias("n0"))
    few, some, many = (toxicity.fit(counts.limit(n))["tables"] for n in (3, 100, 4000))
    assert few.shape == (2, 2, 16) and some.shape == (2, 2, 512) and many.shape == (2, 2, 4096)
    assert (many.sum(axis=2) == [[8000, 8000], [4000, 4000]]).all()


def plain_peaks(rows, learned):
    """Peaks by a plain model: counts in dictionaries, nothing hashed."""
    import math
    import re
    seen = {0: {}, 1: {}}
    df = {0: Counter(), 1: Counter()}
    for i, text in rows:
        y = learned.get(i)
        if y is None:
            continue
        words = re.findall(r"\w+", text.lower())
        for k, w in enumerate(words):
            around = (words[k - 1] if k else None, words[k + 1] if k + 1 < len(words) else None)
            seen[y].setdefault(w, set()).add(around)
        df[y].update(set(words))
    n = {y: {w: min(len(c), df[y][w]) for w, c in seen[y].items()} for y in (0, 1)}
    size, facts = len({*n[0], *n[1]}), {}
    for y in (0, 1):
        k = [0] + [max(1, sum(c == j for c in n[y].values())) for j in (1, 2, 3, 4)]
        share = k[1] / (k[1] + 2 * k[2])
        off = [0, 1 - 2 * share * k[2] / k[1], 2 - 3 * share * k[3] / k[2], 3 - 4 * share * k[4] / k[3]]
        off = [max(0.0, min(float(j), x)) for j, x in enumerate(off)]
        total = max(1, sum(n[y].values()))
        freed = sum(off[min(3, c)] for c in n[y].values())
        facts[y] = (off, total, max(freed / total, 1e-9))
    out = {}
    for i, text in rows:
        best = -20.0 if not re.findall(r"\w+", text) else -math.inf
        for w in re.findall(r"\w+", text.lower()):
            c = {y: n[y].get(w, 0) for y in (0, 1)}
            shared = (c[0] + c[1] + 0.5) / (facts[0][1] + facts[1][1] + 0.5 * (size + 1))
            p = {y: max(c[y] - facts[y][0][min(3, c[y])], 0) / (facts[y][1] * facts[y][2]) + shared for y in (0, 1)}
            best = max(best, math.log(p[1]) - math.log(p[0]))
        out[i] = best
    return out


@pytest.mark.parametrize("slots, words", [(23, 1 << 20), (3, 1 << 20), (3, 40)])
def test_decisions_rest_on_exact_counts_whatever_the_tables(spark, monkeypatch, slots, words):
    docs, labels = toxic_corpus(spark, 400)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    learned = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    want = plain_peaks(rows, learned)
    monkeypatch.setattr(toxicity, "LEAST_SLOTS", slots)
    monkeypatch.setattr(toxicity, "MOST_SLOTS", slots)
    monkeypatch.setattr(toxicity, "LISTED", words)
    model, shared, at = toxicity.trained_on(docs, labels)
    got = {i: toxicity.peak(model, shared.value, t) for i, t in rows}
    low = shared.value[1]["low"]
    assert sum(v >= at for v in want.values()) > 30 and at > (low if words == 40 else -100)
    for i in got:
        assert abs(got[i] - want[i]) < 1e-9 if words > 40 or want[i] > low else got[i] <= low + 1e-9
    assert {i for i in got if got[i] >= at} == {i for i in want if want[i] >= at}


def test_names_that_clash_with_a_score(spark):
    docs, labels = toxic_corpus(spark, 120)
    clash = docs.withColumns({"score": F.lit("mine"), "predicted": F.lit(9), "lang_pred": F.lit("mine")})
    out = toxicity.score(clash, toxicity.trained_on(clash, labels))
    assert sorted(out.columns) == sorted(clash.columns) and dict(out.dtypes)["score"] == "double"
    model = langid.fit(docs, F.lit("en"), F.lit(True))
    said = langid.predict(clash, model)
    assert sorted(said.columns) == sorted(clash.columns) and {r["lang_pred"] for r in said.collect()} == {"en"}


# mixing ---------------------------------------------------------------------------------------------

def test_rates_meet_targets(spark, docs):
    labelled = docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("domain"))
    targets = {"en": 0.25, "fr": 0.25, "es": 0.25, "de": 0.25}
    fitted = mixing.fit(docs, labelled, targets)
    rows = mixing.rated(fitted).collect()
    t = np.array([r["n_tokens"] for r in rows], float)
    p = np.array([[r["membership"][d] for d in fitted["domains"]] for r in rows])
    rate = np.array([r["rate"] for r in rows])
    assert np.abs((t * rate) @ p / t.sum() - 0.25).max() < 1e-3 and (rate >= 0).all()
    lang = {x["doc_id"]: x["lang"] for x in docs.select("doc_id", "lang").collect()}
    best = [max(r["membership"], key=r["membership"].get) for r in rows if r["doc_id"] % 2]
    assert np.mean([a == lang[r["doc_id"]] for a, r in zip(best, [r for r in rows if r["doc_id"] % 2])]) > 0.9


def least_misfit(p, w, want, highest, rounds=15_000):
    """The bounded least-squares optimum by accelerated plain projected gradient."""
    b = p * np.sqrt(w)[:, None]                              # in z = sqrt(w) r
    top, z = highest * np.sqrt(w), np.sqrt(w)
    y, t, size, last = z.copy(), 1.0, 1 / np.linalg.eigvalsh(b.T @ b)[-1], None
    for k in range(rounds):
        new = np.clip(y - size * (b @ (y @ b - want)), 0, top)
        again = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / again * (new - z)
        if (y - new) @ (new - z) < 0 and k % 7 == 0:         # restart
            y, again = new.copy(), 1.0
        z, t = new, again
    return 0.5 * ((z @ b - want) ** 2).sum(), z @ b


@pytest.mark.parametrize("targets", ["equal", "one", "none_of_two", "steep"])
def test_hard_targets_end_at_the_least_misfit(spark, docs, targets):
    labelled = mixing.labelled_domains(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    names = sorted(r["domain"] for r in labelled.select("domain").distinct().collect())
    wanted = {"equal": dict.fromkeys(names, 1.0), "one": {names[0]: 1.0}, "none_of_two": dict.fromkeys(names[2:], 1.0), "steep": {n: 2.0 ** -i for i, n in enumerate(names)}}[targets]
    fitted = mixing.fit(docs, labelled, wanted, highest=40.0)
    rows = mixing.rated(fitted).collect()
    t, p = np.array([r["n_tokens"] for r in rows], float), np.array([[r["membership"][d] for d in fitted["domains"]] for r in rows])
    rate, want = np.array([r["rate"] for r in rows]), np.array(fitted["targets"])
    w = t / t.sum()
    assert (rate >= 0).all() and (rate <= 40).all() and abs(want.sum() - 1) < 1e-12
    assert (np.diff(fitted["misfits"]) < 1e-12).all()        # never rises
    assert np.abs((w * rate) @ p - fitted["reached"]).max() < 1e-9 and rows[0]["reached"] == dict(zip(fitted["domains"], fitted["reached"]))
    least, at = least_misfit(p, w, want, 40.0)
    assert fitted["misfits"][-1] <= least + 2e-6 and fitted["gap"] < 2e-5
    assert np.abs(at - fitted["reached"]).max() < 2e-3


def test_mixture_follows_copies(spark, docs):
    fitted = mixing.fit(docs, docs.select("doc_id", F.col("lang").alias("domain")), {"de": 1.0})
    copies = {r["doc_id"]: r["copies"] for r in mixing.rated(fitted).collect()}
    got = {r["doc_id"]: r["count"] for r in mixing.mixed(docs, fitted).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in copies.items() if v} and mixing.mixed(docs, fitted).columns == docs.columns


def test_mixing_is_native(docs):
    labels = docs.sparkSession.read.parquet(f"{SF}/labels.parquet")
    plan = mixing.query(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mixing_edges(spark):
    rows = odd(spark)
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {r["rate"] for r in mixing.rated(mixing.fit(rows, none)).collect()} == {1.0}
    some = spark.createDataFrame([(3, "a"), (4, "b"), (4, None), (77, "c")], "doc_id long, domain string")
    out = mixing.rated(mixing.fit(rows, some)).collect()
    assert len(out) == 7 and all(r["rate"] >= 0 and r["copies"] >= 0 for r in out)
    assert mixing.rated(mixing.fit(rows.limit(0), some)).count() == 0
    assert mixing.mixed(rows, mixing.fit(rows, some)).columns == rows.columns


# packing --------------------------------------------------------------------------------------------

def test_boundaries_are_optimal():
    rnd = random.Random(4)
    for _ in range(20):
        edges = np.array(sorted(rnd.sample(range(0, 60), 9)))
        counts = np.array([rnd.randint(1, 9) for _ in edges])
        def padding(ends):
            return sum(int(c) * (min(e for e in ends if e >= x) - int(x)) for x, c in zip(edges, counts))
        for k in (1, 2, 3, 4):
            got = packing.boundaries(edges, counts, k)
            best = min(padding([*s, int(edges[-1])]) for n in range(k) for s in itertools.combinations([int(e) for e in edges[:-1]], n))
            assert len(got) <= k and got[-1] == edges[-1] and padding(got) == best


def test_batches_keep_every_row_and_the_budget(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 50)
    rows = packing.pack(docs, buckets=6, budget=4000).collect()
    assert sorted(r["id"] for r in rows) == list(range(1000))
    batches = {}
    for r in rows:
        batches.setdefault(r["batch_id"], []).append(r)
    for b in batches.values():
        assert len({r["bucket"] for r in b}) == 1 and sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len(b) == 1 or sum(r["padded_tokens"] for r in b) <= 4000
        assert all(r["n_tokens"] <= r["padded_tokens"] for r in b)
    assert sorted(batches) == list(range(len(batches)))
    by_bucket = {}
    for b in batches.values():
        by_bucket.setdefault(b[0]["bucket"], []).append((len(b), max(1, 4000 // max(1, b[0]["padded_tokens"]))))
    assert all(sum(n < full for n, full in v) <= 1 for v in by_bucket.values())


def test_packing_edges(spark):
    rows = packing.pack(odd(spark), budget=1000).collect()
    assert len(rows) == 7 and {r["n_tokens"] for r in rows if r["id"] == 3} == {60_000}
    assert packing.pack(odd(spark).limit(0)).count() == 0


def test_boundaries_of_long_texts_are_lengths_that_occur(spark):
    rnd = random.Random(5)
    lengths = [rnd.randint(1, 3000) for _ in range(60)] + [rnd.randint(1000, 60_000) for _ in range(40)]
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    rows = packing.pack(df, buckets=5).collect()
    ends = sorted({r["padded_tokens"] for r in rows})
    assert set(ends) <= set(lengths) and all(r["padded_tokens"] == min(e for e in ends if e >= r["n_tokens"]) for r in rows)
    # the least padding by a plain programme over all lengths
    have = sorted(set(lengths))
    cost = {(i, j): sum(have[j] - n for n in lengths if (have[i - 1] if i else 0) < n <= have[j]) for i in range(len(have)) for j in range(i, len(have))}
    best = [cost[0, j] for j in range(len(have))]
    for _ in range(4):
        best = [min([best[j]] + [best[i - 1] + cost[i, j] for i in range(1, j + 1)]) for j in range(len(have))]
    assert sum(r["padded_tokens"] - r["n_tokens"] for r in rows) == best[-1]


def test_packing_follows_the_rows_not_their_files(spark, docs):
    few = docs.where("doc_id < 200")
    pick = lambda df: sorted((r["id"], r["bucket"], r["batch_id"], r["slot"]) for r in packing.pack(df, budget=3000).collect())
    assert pick(few.repartition(7)) == pick(few.orderBy(F.desc("doc_id")).coalesce(2))
