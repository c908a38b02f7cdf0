"""The corpus pipeline: each stage reads what the one before has kept.

toxicity: texts predicted toxic go.  language: texts without a letter go, and those in which no
language is likelier than all others together.  near_duplicates: one document of each group
stays.  repeats: passages that an earlier text holds are cut.  packing: what is left is packed
in sequences.

A null text has no letter, so the language stage rejects it, and empty texts with it; a text
that the repeats stage empties stays, as its end token.  A row without an id is a document of
its own, and of rows that repeat an id and a text one stays.  Of a group the smallest id stays,
of equal passages the earliest.  Other columns are carried, whatever their names, up to the
packing.  Without labels no text is toxic, and without languages every text is rejected; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidrill.llm import bpe, langid, minhash, packing, suffix, toxicity
from evidrill.llm.common import discard, materialize, table

#: Least score of the predicted language.
CLEAR = 0.5


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, counted = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    discard(counted)
    return toxicity.reject_toxic(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.reject_unclear(docs, langid.fit(docs), CLEAR)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, bpe.vocabulary(bpe.BYTE_VOCAB))


STAGES = [("toxicity", clean), ("language", known_language), ("near_duplicates", distinct), ("repeats", without_repeats), ("packing", packed)]

#: SQL expresses neither the classifiers nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*stored)
        stored = [docs]
    return docs
