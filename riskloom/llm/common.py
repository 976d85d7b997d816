"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that are turned into arrays at once inside a task.
BLOCK_BYTES = 1 << 20


def share_package(spark: SparkSession) -> None:
    """Let Python workers look for this package where the driver found it.

    That is enough where all machines see the same path; else submit it with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a missing id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def arrow_map(
    df: DataFrame, rows: Callable[[dict[str, list]], dict[str, object]], schema: str
) -> DataFrame:
    """Apply ``rows`` to each Arrow batch, given and returned as lists by column."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch.to_pydict())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[field.name], field.type) for field in target], schema=target
            )

    return df.mapInArrow(run, schema)


def apart(sums: DataFrame, key: str) -> DataFrame:
    """``sums`` with its key column computed anew, so that a join by it shuffles ``sums``.

    A join with an aggregation by the same key would stay in the aggregation's partitions, and the
    engine's skew join could not split the rows of a hot key, as it does between two shuffles.
    """
    kind = sums.schema[key].dataType.typeName()
    if kind == "binary":
        same = F.concat(F.col(key), F.lit(bytearray()))
    elif kind == "string":
        same = F.concat(F.col(key), F.lit(""))
    else:
        same = F.col(key).bitwiseXOR(F.lit(0).cast(sums.schema[key].dataType))
    return sums.withColumn(key, same)


def segments(
    batches: Iterator[pa.RecordBatch], names: list[str]
) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Runs of rows that agree in the named columns, with their bounds.

    A run may span several batches, and many short runs come together in one.
    """
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        n = batch.num_rows
        new = np.zeros(max(n - 1, 0), bool)
        for name in names:
            column = batch.column(batch.schema.get_field_index(name))
            differs = pc.not_equal(column.slice(1), column.slice(0, max(n - 1, 0)))
            new |= differs.to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(new) + 1).tolist()]
        if len(bounds) > 1:
            yield batch.slice(0, bounds[-1]), bounds
        rest = batch.slice(bounds[-1])
    if rest is not None and rest.num_rows:
        yield rest, [0, rest.num_rows]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes; one longer text is a block of its own."""
    yield from ranges(list(map(len, texts)), limit)


def ranges(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """The same for texts of the given sizes."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on all bits of the input."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _P)
_LOWER_BYTE = _BYTE[_LOWER]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, per text, where its words begin (one entry more than texts).

    A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case. The hash of a
    word is a polynomial over its bytes modulo 2**64, finalised with its length.
    """
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    # Words and spaces take turns, and the last byte is a space.
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        turns = np.r_[0, turns]
    starts, ends = turns[::2], turns[1::2]
    # Horner sums from the left need powers; each word's sum is rescaled by the inverse power.
    n = len(raw)
    powers = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    value = _LOWER_BYTE[raw]
    value *= powers[0][:n]
    np.cumsum(value, out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers[1][starts]
    value = mix64(value + (ends - starts).astype(np.uint64) * _P)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.searchsorted(starts, np.r_[0, np.cumsum(lengths)])
    return value, bounds


_CACHE: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_CACHE.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for name, base in (("up", _P), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _CACHE[name] = np.cumprod(steps)
    return _CACHE["up"], _CACHE["down"]


def as_utf8(texts: list[str | None]) -> list[bytes]:
    return [b"" if text is None else text.encode() for text in texts]
