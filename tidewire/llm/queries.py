"""The operators over their whole tables, as the registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import alignment, collisions, langid, lattice, packing, piecebpe, simhash, spelling, substrings, tokencount, topk, toxicity, urlfilter
from tidewire.llm.common import load
from tidewire.llm.oracle import SQL as SQL


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(load(spark, folder, "documents"))


def op2_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    found = piecebpe.encode(load(spark, folder, "documents"), public_tokenizers.path(piecebpe.MODEL))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_vector_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return collisions.near_duplicates(load(spark, folder, "embeddings"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(load(spark, folder, "documents"), load(spark, folder, "labels"))


def op5_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.score_documents(load(spark, folder, "documents"), public_tokenizers.path(lattice.MODEL))


def op6_simhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(load(spark, folder, "documents"), public_tokenizers.path(tokencount.VOCABULARY))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urlfilter.judge(load(spark, folder, "pages")).drop("score")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(load(spark, folder, "documents"), public_tokenizers.path(packing.VOCABULARY))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(load(spark, folder, "embeddings"), F.col("vec_id") % topk.EVERY == 0)


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.without_repeats(load(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(load(spark, folder, "documents"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_tokenizers.path(alignment.BYTES), public_tokenizers.path(alignment.PIECES)
    found = alignment.align(load(spark, folder, "documents"), *paths, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_piece_encoding": op2_piece_encoding,
    "op3_vector_neardup": op3_vector_neardup,
    "op4_toxicity": op4_toxicity,
    "op5_lm_score": op5_lm_score,
    "op6_simhash_neardup": op6_simhash_neardup,
    "op7_token_counts": op7_token_counts,
    "op8_url_filter": op8_url_filter,
    "op9_packing": op9_packing,
    "op10_topk": op10_topk,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_alignment": op13_token_alignment,
}
