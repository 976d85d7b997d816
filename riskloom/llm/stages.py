"""The stages of the corpus pipeline: (session, documents, folder) -> documents.

Every stage but the last returns the columns of its input. Rows with nulls, empty or very long
texts, ties and repeated rows are treated as the stage's operator says; an empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, forest_dedup, langid, mixing, pii
from riskloom.llm.common import share_package
from riskloom.llm.queries import vocabulary


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the documents in a language that was learned; ``lang`` is what their texts are told to be.

    Texts without a letter, and those that are no nearer to any learned language than chance, go. The last
    stage returns the languages with the tokens."""
    share_package(spark)
    learned = langid.fitted(langid.training_rows(docs))
    return langid.keep_known(docs, *learned, least=langid.CHANCE, lang_column="lang")


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each group of near-duplicates.

    Shingles of five words, similarity of 0.8 or more."""
    share_package(spark)
    return forest_dedup.first_of_each_group(docs, width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Take personal data, and terms that reveal it, out of the texts; ``n_chars`` follows."""
    clean = pii.sanitised(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.coalesce(length, "n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, in the order in which their sources have their target weights.

    The last stage returns the positions of this order."""
    return mixing.in_mixed_order(docs)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, lang, ids, n_tokens, position): the tokens of every document, in the mixed order.

    Files are not read in the order they were written in, so the positions are found anew: they follow from ids,
    texts and sources alone. Texts are encoded once they are in place, as they take less room to move than
    their tokens. Ascending ``position`` is the order of the stage before.
    """
    share_package(spark)
    placed = mixing.mix(docs, carried=["doc_id", "lang", "text"])
    ordered = placed.repartitionByRange("position").sortWithinPartitions("position")
    texts = ordered.select("row.doc_id", "row.lang", "row.text", "position")
    tokens = bpe.encode_documents(texts, vocabulary(), carried=["lang", "position"])
    return tokens.select("doc_id", "lang", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "position")
