"""The corpus pipeline: quality, near-dedup, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and returns all columns of its input, but for the last, which returns
where each piece of a document is packed. Nulls, repeated rows, empty tables
and further columns are as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import mixing, packing, pii, quality, simhash
from lociframe.llm.common import materialise, table

#: No SQL: trees are fitted and texts are tokenised.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles of Jaccard similarity 0.8 or more.

    Null and blank texts are copies of each other; an empty table stays empty.
    """
    return simhash.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document once per epoch it is taken in, the last one cut to the words taken."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
