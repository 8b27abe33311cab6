"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Part of the training-data operators (``quarry.llm``). Stage results and intermediate tables go to the folder
in ``spark.checkpoint.dir``; those that are no longer read are removed after each stage.

Defined cases: an empty table gives an empty one; without any labelled row only documents without a letter go in
the first stage; rows without a doc_id count as documents, of which one for each group stays; columns beyond
those of documents are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, language_id, line_dedup, mixing, ngram_join
from quarry.llm.common import STORED, documents, remove_stored, stored


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the network is trained on the labelled rows of the stage's input."""
    return language_id.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first only."""
    return line_dedup.dedup(docs)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.representatives(docs, k=5, num=80, den=100, keep_unnamed=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, token_ids and n_tokens of every document in the mix, repeats included."""
    return bpe.encode(docs).selectExpr("doc_id", "source", "lang", "token_ids", "cast(size(token_ids) as long) as n_tokens")


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_representatives),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: Language identification has no SQL form, so the pipeline has none; tests hold its stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = documents(spark, sf_dir), len(STORED)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_stored(spark, since, keep=(STORED[-1],))
    return STAGES[-1][1](spark, docs, sf_dir)
