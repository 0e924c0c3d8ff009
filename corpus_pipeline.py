"""The corpus pipeline: stages over `documents`, each written as Parquet and read again for the next one.

Every stage takes all that its predecessor kept.  All but the last return the columns of documents: the
quality rules take failed lines out of the texts (and set `n_chars` anew) and reject documents, language
identification rejects what is in no learned language, the Jaccard join leaves one document of each group,
mixing repeats or drops documents by their source's weight.  The last one returns every document with its
token ids in place of its text.

Empty input passes through all stages; nulls and repeated rows are treated as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framesift.llm import bpe_transducer, jaccard_join, language_id, line_cleaning, source_mixing
from framesift.llm.queries import byte_bpe
from framesift.session import materialise, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and the documents that lose too much with them."""
    return line_cleaning.clean(docs)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; learned from those of `docs` that are not held out."""
    return language_id.keep_known(docs, language_id.train(language_id.training_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that their sources' weights ask for, in a random order."""
    return source_mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    return bpe_transducer.encode(docs, byte_bpe())


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe_encode", encode),
]

#: Neither the classifier nor the tokenizer can be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over `documents`."""
    docs = ship_package(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
