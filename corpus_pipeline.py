"""The pipeline over documents: toxic and untold-language documents go, one of each near-duplicate group
stays, the rest is packed into training sequences. Every stage's result is written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import langid, packing, simhash, toxicity
from tidewire.llm.common import load, ship
from tidewire.session import cut


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 4 scores below its threshold."""
    return toxicity.accepted(docs, load(spark, sf_dir, "labels"))


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language operator 1 tells with enough probability."""
    ship(spark)
    return langid.accepted(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the document with the smallest id of each group."""
    ship(spark)
    return simhash.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of the documents in sequences of 2048 tokens."""
    ship(spark)
    pieces = packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("language_id", of_known_language),
    ("simhash_neardup", one_of_near_copies),
    ("packing", packed),
]

#: Learned models and tokenizers are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
