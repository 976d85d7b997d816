"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    alignment,
    balltree,
    bpe,
    brown,
    forest_dedup,
    langid,
    mixing,
    pii,
    refinement,
    secrets,
    substrings,
    turns,
    vectors,
)
from riskloom.llm.common import table
from riskloom.llm.oracle import ORACLE_SQL  # noqa: F401  (part of the registration)

Query = Callable[[SparkSession, str], DataFrame]

# Rows of the embeddings whose id is divisible by this are the queries of the search.
QUERY_EVERY = 50


def vocabulary() -> str:
    """The vocabulary file that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> str:
    """The SentencePiece model that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return balltree.top_k(table(spark, folder, "embeddings"), F.col("id") % QUERY_EVERY == 0)


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.predict(docs, *langid.fitted(langid.training_rows(docs)))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.places(table(spark, folder, "documents"))


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return forest_dedup.near_duplicates(table(spark, folder, "documents"), width=2)


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(table(spark, folder, "documents"))


def op7_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return brown.score(table(spark, folder, "documents"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, folder, "documents"), vocabulary())


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents"))


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return turns.digests(turns.repair(turns.damaged(rows)), rows)


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return alignment.align_documents(docs, vocabulary(), pieces())


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return refinement.exact_duplicates(docs, digest="text_sha256")


QUERIES: dict[str, Query] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_language": op3_language,
    "op4_mixing": op4_mixing,
    "op5_near_dedup": op5_near_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_bpe": op8_bpe,
    "op9_secrets": op9_secrets,
    "op10_pii": op10_pii,
    "op11_turn_repair": op11_turn_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_exact_dedup": op13_exact_dedup,
}
