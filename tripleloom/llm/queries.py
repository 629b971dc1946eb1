"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripleloom.functions.session import configure
from tripleloom.llm import alignment, langid, mixing, packing, personal, simhash, suffix_dedup, tokens, topk, toxicity, vector_dedup, warc, whitening
from tripleloom.llm.common import small_batches, table


def over(query: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(*[table(small_batches(configure(spark)), sf_dir, n) for n in names])


QUERIES = {
    "op1_suffix_dedup": over(suffix_dedup.query, "documents"),
    "op2_mixing": over(mixing.query, "documents", "labels"),
    "op3_language": over(langid.query, "documents"),
    "op4_vector_dedup": over(vector_dedup.query, "embeddings"),
    "op5_packing": over(packing.query, "documents"),
    "op6_toxicity": over(toxicity.query, "documents", "labels"),
    "op7_warc": over(warc.query, "pages"),
    "op8_token_counts": over(tokens.query, "documents"),
    "op9_topk": over(topk.query, "embeddings"),
    "op10_simhash": over(simhash.query, "documents"),
    "op11_alignment": over(alignment.query, "documents"),
    "op12_whitening": over(whitening.query, "embeddings"),
    "op13_personal": over(personal.query, "documents"),
}

SQL = {"op4_vector_dedup": vector_dedup.ORACLE, "op7_warc": warc.ORACLE, "op9_topk": topk.ORACLE}
