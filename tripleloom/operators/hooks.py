"""Plug points for user models, run batch-wise in the executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.operators.clean import conf_filter

ENTITY_SCHEMA = "sentence_id bigint, sentence string, entities array<struct<text:string,label:string,start:int,end:int,confidence:double>>"
TRIPLE_SCHEMA = ("sentence_id bigint, sentence string, head string, head_type string, relation string, "
                 "tail string, tail_type string, confidence double")


_LOADED: dict = {}


class Model:
    """A model that every worker loads once, however many tasks it runs: ``load()`` returns a function from a list of texts to one
    result for each."""

    def __init__(self, load: Callable[[], Callable[[list[str]], Sequence]]):
        self.mark, self.load = uuid.uuid4().hex, load

    def __call__(self, texts: list[str]) -> Sequence:
        if self.mark not in _LOADED:
            _LOADED[self.mark] = self.load()
        results = _LOADED[self.mark](texts)
        if len(results) != len(texts):
            raise ValueError(f"the model gave {len(results)} results for {len(texts)} texts")
        return results


def _results(batches: Iterator[pd.Series], model: Model, each: Callable, batch: int) -> Iterator[pd.Series]:
    """Results of the texts that are not null, handed to the model ``batch`` at a time."""
    for texts in batches:
        out: list = [None] * len(texts)
        places = [i for i, t in enumerate(texts) if t is not None]
        for at in range(0, len(places), batch):
            part = places[at:at + batch]
            for i, r in zip(part, model([texts.iloc[i] for i in part])):
                out[i] = each(r)
        yield pd.Series(out, dtype=object)


def embed(df: DataFrame, text: str, model: Model, size: int, name: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` with a vector of ``size`` numbers for each text; null texts have none.  No shuffle; Arrow batches in and out."""
    def vector(v) -> list[float]:
        v = np.asarray(v, float)
        if v.shape != (size,):
            raise ValueError(f"the model gave a vector of shape {v.shape}, not ({size},)")
        return v.tolist()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _results(batches, model, vector, batch)
    return df.withColumn(name, run(F.col(text)))


def tokenize(df: DataFrame, text: str, model: Model, name: str = "tokens", batch: int = 256) -> DataFrame:
    """``df`` with the tokens of each text; null texts have none."""
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _results(batches, model, lambda tokens: [str(t) for t in tokens], batch)
    return df.withColumn(name, run(F.col(text)))


def annotate(sentences: DataFrame, entity_fn: Callable[[pd.Series], Iterable[list[dict]]]) -> DataFrame:
    """Entities of each sentence by a user function that is given a batch of sentences and returns a list
    of entities for each; sentences with fewer than two are dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(entities=list(entity_fn(pdf["sentence"])))[["sentence_id", "sentence", "entities"]]
    found = sentences.select("sentence_id", "sentence").mapInPandas(run, ENTITY_SCHEMA)
    return found.where(F.size("entities") >= 2)


def relate(annotated: DataFrame, relation_fn: Callable[[pd.Series, pd.Series], Iterable[Iterable[tuple]]], threshold: float = 0.5,
           none: str = "NA") -> DataFrame:
    """Triples by a user function that is given a batch of sentences and of their entities, walks the pairs
    inside each sentence and gives ``(i, j, relation, confidence)`` rows for each; only confident ones
    leave the task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            entities = pdf["entities"].map(list)
            for sid, sentence, ents, related in zip(pdf["sentence_id"], pdf["sentence"], entities, relation_fn(pdf["sentence"], entities)):
                for i, j, rel, conf in related:
                    if conf > threshold and rel != none:
                        out.append((sid, sentence, ents[i]["text"], ents[i]["label"], rel, ents[j]["text"], ents[j]["label"], float(conf)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TRIPLE_SCHEMA.split(", ")])
    return conf_filter(annotated.mapInPandas(run, TRIPLE_SCHEMA), threshold, ">", skip_label=none)


def extract(sentences: DataFrame, entity_fn, relation_fn, threshold: float = 0.5) -> DataFrame:
    """Text to triples: entities, then relations, with the cheap size filter in between."""
    return relate(annotate(sentences, entity_fn), relation_fn, threshold)
