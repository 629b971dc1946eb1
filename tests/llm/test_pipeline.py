"""The stages in order: each works on what the one before kept, and its decisions take effect."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tripleloom.functions.session import staged
from tripleloom.llm import mixing, simhash, toxicity

SF = "/root/testdata/sf0.001"


def removed_bytes(texts, length):
    """Bytes of each text that a string of ``length`` bytes covers which also starts elsewhere."""
    seen = Counter(t[k:k + length] for t in texts.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        covered = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                covered[k:k + length] = b"\1" * length
        out[i] = sum(covered)
    return out


def test_repeated_passages_of_over_fifty_words_go(spark):
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnoprstuv") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    passages = [words(n) for n in range(51, 61)]
    rows = [(10 * k + i, f"{words(30)} {p} {words(40)}") for k, p in enumerate(passages) for i in range(3)] + [(1000 + i, words(120)) for i in range(20)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    cut = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, docs, SF).collect()}
    for i, t in rows:
        assert cut[i] == t if i >= 1000 else passages[i // 10] not in cut[i] and len(t) - len(cut[i]) >= len(passages[i // 10])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "suffix_dedup", "mixing", "packing"]
    clean = staged(stages["toxicity"](spark, docs, SF))
    rejected = {r["doc_id"] for r in toxicity.query(docs, labels).where("predicted = 1").collect()}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(clean) == sorted({*ids(docs)} - rejected) and clean.columns == docs.columns
    one = staged(stages["simhash"](spark, clean, SF))
    assert ids(one) == sorted({r["component_id"] for r in simhash.query(clean).collect()}) and one.columns == docs.columns
    cut = staged(stages["suffix_dedup"](spark, one, SF))
    assert ids(cut) == ids(one) and cut.columns == docs.columns
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (one, cut))
    gone = removed_bytes({i: t.encode() for i, t in before.items()}, corpus_pipeline.PASSAGE)
    for i, n in gone.items():       # narrowed to whole characters: at most 6 bytes a span stay
        assert 0 <= len(after[i].encode()) - (len(before[i].encode()) - n) <= 6 * 50
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    mix = staged(stages["mixing"](spark, cut, SF))
    fitted = mixing.fit(cut, mixing.labelled_domains(cut, labels))
    assert ids(mix) == sorted(i for r in mixing.rated(fitted).collect() for i in [r["doc_id"]] * r["copies"]) and mix.columns == docs.columns
    packed = stages["packing"](spark, mix, SF)
    assert ids(packed) == ids(mix)


def test_stages_keep_other_columns_whatever_their_names(spark):
    names = ["score", "predicted", "id", "fp", "h", "k", "b", "row", "may", "f", "p", "_f", "_p", "rate", "n", "word", "component", "_key", "_first", "key", "at", "rank", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = staged(stage(spark, docs, SF))
        assert kept.columns == docs.columns and kept.count() > 0
        assert kept.where(" or ".join(f"coalesce(`{n}`, '') <> concat('{n}', doc_id)" for n in names)).count() == 0
        docs = kept


def test_run_on_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {"doc_id", "n_tokens", "bucket", "padded_tokens", "batch_id", "slot"} <= set(out[0].asDict())
