"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after A-Z are put in lower case, which keeps their lengths. Each stage
reads the table anew, computes its key next to the scan and counts the documents of each key; texts
themselves never move.

1. Length in bytes. A text whose length no other one has is settled.
2. Length and hash of the first PREFIX characters, for the others. A text alone with it is settled.
3. SHA-256 of the whole normalised text, for what is left. Equal hashes are one group.

The next stage knows what is left by a bitmap of FILTER_BITS bits with one bit per key that several
documents share. It is broadcast and its size is fixed (4 MB); two keys with the same bit only mean that
a text is read although it is alone, since groups are formed by the full hash. In a table with many more
shared keys than bits the filter lets everything pass and the result stays the same.

Edge cases: a null text is empty; all empty texts are one group. Rows that repeat id and text
count as documents of their group and get the same result each. A missing id ranks below all
others: it stays only where its group has no other id. An empty table gives an empty result. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import apart
from riskloom.session import durable

# Characters of the prefix that stage 2 hashes.
PREFIX = 64
# Bits of the filter between two stages: 2**25 are 1024 buckets of 4 kB.
FILTER_BITS = 1 << 25


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def length_key(text: Column) -> Column:
    return F.xxhash64(F.octet_length(F.coalesce(text, F.lit(""))))


def prefix_key(text: Column) -> Column:
    start = normalised(F.substring(text, 1, PREFIX))
    return F.xxhash64(F.octet_length(F.coalesce(text, F.lit(""))), start)


def content_key(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _slot(key: Column) -> Column:
    """The key's place in the filter; bitmaps count their positions from one."""
    return F.pmod(key, F.lit(FILTER_BITS)) + 1


def shared_keys(keys: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap with one bit per ``key`` that several rows have."""
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    slots = shared.select(_slot(F.col("key")).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )


def with_shared(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """``rows`` with ``shared``: whether another row may have the same ``key``. No row moves."""
    # Safe to broadcast: FILTER_BITS / 32768 buckets of 4 kB, however many keys there are.
    kept = F.broadcast(filters)
    position = F.bitmap_bit_position(_slot(F.col("key")))
    byte = F.conv(F.hex(F.substring("bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.expr("shiftright(_byte, _bit) & 1") == 1
    met = rows.withColumn("bucket", F.bitmap_bucket_number(_slot(F.col("key"))))
    met = met.join(kept, "bucket", "left").withColumns(
        {"_byte": byte.cast("int"), "_bit": (position % 8).cast("int")}
    )
    return met.withColumn("shared", F.coalesce(bit, F.lit(False))).drop(
        "bucket", "bits", "_byte", "_bit"
    )


def left_after_lengths(rows: DataFrame) -> DataFrame:
    """Rows (text, ...) with ``shared``: whether another text may have the same length."""
    filters = shared_keys(rows.select(length_key(F.col("text")).alias("key")))
    return with_shared(rows.withColumn("key", length_key(F.col("text"))), durable(filters))


def left_after_prefixes(rows: DataFrame) -> DataFrame:
    """Rows with ``shared``: whether another text may have the same length and prefix."""
    same_length = left_after_lengths(rows).where("shared")
    filters = shared_keys(same_length.select(prefix_key(F.col("text")).alias("key")))
    keyed = rows.withColumn("key", prefix_key(F.col("text")))
    return with_shared(keyed, durable(filters)).drop("key")


def _plain(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: str | None = None,
) -> DataFrame:
    """(id, keep_id, group_size, kept) of every row; the largest id of equal texts stays.

    ``digest`` names a further column with the SHA-256 of every normalised text. Without it only the
    texts that stage 3 is left with are hashed.
    """
    rows = left_after_prefixes(_plain(docs, id_column, text_column))
    whole = content_key(F.col("text"))
    content = F.when(F.col("shared"), whole).alias("content")
    more = [whole.alias("digest")] if digest else []
    judged = durable(rows.select("id", content, *more))
    groups = judged.where("content IS NOT NULL").groupBy("content").agg(
        F.max("id").alias("keep_id"), F.count("*").alias("group_size")
    )
    met = judged.join(apart(groups, "content"), "content")
    alone = judged.where("content IS NULL").withColumns(
        {"keep_id": F.col("id"), "group_size": F.lit(1).cast("bigint")}
    )
    return met.unionByName(alone).select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *([F.col("digest").alias(digest)] if digest else []),
    )


def one_of_each_text(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` with one row of each text, that with the largest id.

    Only rows that stage 3 is left with move, at most one of each text from every task.
    """
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row")
    rows = left_after_prefixes(
        docs.select(row, F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    )
    rank = F.struct(F.col("id").isNotNull(), "id")
    chosen = rows.where("shared").groupBy(content_key(F.col("text"))).agg(
        F.max_by("row", rank).alias("row")
    )
    return rows.where("NOT shared").select("row.*").union(chosen.select("row.*"))
