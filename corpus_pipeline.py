"""From documents to packed training sequences, stage by stage.

Each stage works on everything the stage before kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavelspark.llm.decontamination import without_contaminated
from gavelspark.llm.language import in_known_language
from gavelspark.llm.packing import packed
from gavelspark.llm.queries import benchmark, documents, tokenizer_file
from gavelspark.llm.secrets import without_secrets
from gavelspark.llm.simhash import without_near_duplicates
from gavelspark.llm.token_counts import n_tokens
from gavelspark.sources.storage import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language for sure, go."""
    return in_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return without_contaminated(docs, benchmark(spark, sf_dir))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; all documents stay."""
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in length buckets and batches."""
    return packed(docs, n_tokens(docs["text"], tokenizer_file("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs


#: Trained models, fingerprints and merges decide here: SQL cannot express them.
ORACLE_SQL = None
