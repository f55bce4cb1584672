"""Corpus pipeline: quality rules, quality classifier, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result to the shared folder and rereads it as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import forest_join, packing, poisson_mix, repetition, subword_classifier
from tidemark.llm.common import read_table
from tidemark.llm.queries import TOKENIZER, quality_model
from tidemark.session import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules. A null or empty text has no words and goes. No documents give none."""
    return repetition.keep_passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least one half. Without labels every score is one half and all documents stay. A null text scores as an empty one."""
    return subword_classifier.keep_positive(docs, quality_model(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the lowest id of each group of near copies. Documents without words or with a null id stay; repeated rows count once."""
    return forest_join.keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at their source's rate, in random order. A null text counts as empty, a null source as a source of its own. No documents give none."""
    return poisson_mix.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null text is one end token, a null source a queue of its own. No documents give no pieces."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), digest=True)


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources to target weights", mixing), ("packing", pack)]

#: The classifier and the tokenizer have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, "stage")
    return docs
