"""Embedding near-dedup with Euclidean p-stable hashing.

Vectors are scaled to length one. Each of TABLES tables hashes a vector by HASHES quantised random
projections, floor((a . v + b) / WIDTH); vectors of one label that agree in all of a table's
hashes share a bucket. Within buckets all cosines are checked in double precision, a block of
rows against a block of rows, so a bucket of any size is spread over tasks. A pair is counted in
the first table that brings it together: rows carry the hashes of all tables for that. Nothing
is emitted per pair: a block gives one row per vector, with the number of its links and the
lowest vector that its links reach within the block.

At the threshold of 0.93 a pair shares a bucket of one table with probability 0.12, so it
is missed by all tables with probability 0.006, and at a cosine of 0.98 with less than 1e-9.

Identical vectors of a label are taken together first and count by their number.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
without a label, link with nothing and are their own component; vectors of different lengths never
link. Rows without an id are left out, as a link could not name them; rows that repeat id, label and vector count
once. Several vectors of one id are vectors of their own, each with a row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import apart, segments
from riskloom.llm.components import components
from riskloom.session import durable

THRESHOLD = 0.93
TABLES = 40
HASHES = 6
WIDTH = 1.0
SEED = 20240229
# Rows of a bucket that a task compares at once with as many others.
BLOCK_ROWS = 2048
# The exact check cuts a label into BLOCKS blocks of no fewer rows, and into more where one would have more
# than so many components.
BLOCKS = 8
BLOCK_COMPONENTS = 1 << 20
# Rows that are multiplied at once with a block, and pairs that are looked at together.
SLAB_ROWS = 512
PAIRS = 100_000
# Cosines this close to the threshold are summed again.
ROUNDING = 1e-9


def directions(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections and offsets for vectors of ``length``; the same wherever they are drawn."""
    random = np.random.default_rng([SEED, length])
    normal = random.standard_normal((length, TABLES * HASHES))
    return normal, random.uniform(0, WIDTH, TABLES * HASHES)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    matrix = vectors.astype(np.float64)
    # Scaling by the largest component's power of two keeps tiny and huge vectors from vanishing, and is exact.
    matrix = np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1, keepdims=True))[1])
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def bucket_keys(unit: np.ndarray) -> np.ndarray:
    """A 32-bit key for each row and table."""
    normal, offsets = directions(unit.shape[1])
    cells = np.floor((unit @ normal + offsets) / WIDTH).astype(np.int64).astype(np.uint32)
    cells = cells.reshape(len(unit), TABLES, HASHES)
    key = np.full(cells.shape[:2], 0x811C9DC5, np.uint32)
    for h in range(HASHES):
        key = (key ^ cells[:, :, h]) * np.uint32(0x01000193)
        key ^= key >> np.uint32(15)
    return key.view(np.int32)


def usable(vector) -> F.Column:
    """A vector that may link: no null or non-finite component, and not all zero."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hashed(distinct: DataFrame) -> DataFrame:
    """(id, label, vector, copies, keys) of distinct usable vectors (id, label, vector, copies)."""

    def run(frames):
        for frame in frames:
            lengths = frame["vector"].map(len)
            for _, part in frame.groupby(lengths):
                keys = bucket_keys(unit_rows(np.array(part["vector"].tolist())))
                yield part.assign(keys=list(keys))

    return distinct.mapInPandas(run, distinct._jdf.schema().toDDL() + ", keys ARRAY<INT>")


def near_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``left``, rows of ``right``) of unit vectors with a cosine of ``threshold`` or more."""
    cosines = left @ right.T
    a, b = np.nonzero(cosines >= threshold - ROUNDING)
    unsure = np.flatnonzero(cosines[a, b] < threshold + ROUNDING)
    near = np.ones(len(a), bool)
    for at in range(0, len(unsure), PAIRS):
        part = unsure[at : at + PAIRS]
        near[part] = (left[a[part]] * right[b[part]]).sum(axis=1) >= threshold
    return a[near], b[near]


def share_key(keys_a: np.ndarray, keys_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` of the one and ``b`` of the other agree in the key of any table."""
    shared = np.zeros(len(a), bool)
    for at in range(0, len(a) if keys_a.shape[1] else 0, PAIRS):
        part = slice(at, at + PAIRS)
        shared[part] = (keys_a[a[part]] == keys_b[b[part]]).any(axis=1)
    return shared


def lowest_reached(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the lowest id that chains of the links between rows ``a`` and ``b`` reach, or its own."""
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(ids))
    a, b = place[a], place[b]
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[a], low[b])
        now = low.copy()
        for rows in (a, b, low[a], low[b]):
            np.minimum.at(now, rows, least)
        now = now[now]
        if np.array_equal(now, low):
            return ids[order][low[place]]
        low = now


def block_links(ids, vectors, keys, copies, left: int, table: int, threshold: float, same: bool = False):
    """Links between two blocks of a bucket, the first ``left`` rows and the others.

    Per row of the first its weighted number of links and the lowest id that links reach; with ``same`` the
    first meets itself. Pairs that share a bucket of a table before are not counted again.
    """
    unit = unit_rows(vectors)
    start = 0 if same else left
    a, b = near_pairs(unit[:left], unit[start:], threshold)
    b = b + start
    apart_ids = ids[a] != ids[b]
    a, b = a[apart_ids], b[apart_ids]
    if not len(a):
        return None
    first = ~share_key(keys[:, :table], keys[:, :table], a, b)
    weights = copies.astype(np.float64)
    found = np.bincount(a[first], weights[b[first]], left).astype(np.int64)[:left]
    lowest = lowest_reached(ids, a, b)[:left]
    has = (found > 0) | (lowest < ids[:left])
    return ids[:left][has], found[has], lowest[has]


def unmet_links(ids, vectors, keys, copies, left: int, threshold: float, same: bool):
    """As :func:`block_links` for the pairs that share no bucket, with the rows of both blocks."""
    unit = unit_rows(vectors)
    start = 0 if same else left
    pairs = []
    for at in range(0, left, SLAB_ROWS):
        end = min(at + SLAB_ROWS, left)
        # A block that meets itself is compared with what comes after, so each pair is seen once.
        base = at if same else start
        a, b = near_pairs(unit[at:end], unit[base:], threshold)
        a, b = a + at, b + base
        if same:
            a, b = a[a < b], b[a < b]
        unmet = ~share_key(keys, keys, a, b)
        pairs.append((a[unmet], b[unmet]))
    a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    if not len(a):
        return None
    weights, n = copies.astype(np.float64), len(ids)
    found = (np.bincount(a, weights[b], n) + np.bincount(b, weights[a], n)).astype(np.int64)
    has = found > 0
    return ids[has], found[has], lowest_reached(ids, a, b)[has]


BUCKET = ["label", "length", "table", "key", "i", "j"]


def near_links(keyed: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n, lowest): for each block pair a row per linked vector, see :func:`block_links`."""
    entries = keyed.select(
        "label", F.size("vector").alias("length"), F.posexplode("keys").alias("table", "key"), "id"
    )
    bucket = BUCKET[:4]
    # Buckets of one vector go before any vector is moved.
    sizes = entries.groupBy(bucket).agg(F.count("*").alias("size")).where("size > 1")
    met = (
        entries.join(apart(sizes, "key"), bucket)
        .withColumn("parts", F.ceil(F.col("size") / block_rows).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .join(keyed.select("id", "vector", "copies", "keys"), "id")
    )
    # A row meets every block of its bucket: on the left in row part, on the right in column part.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    payload = ["id", "vector", "copies", "keys"]
    left = met.select(
        *bucket, F.col("part").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), *payload
    )
    right = met.where("part != other").select(
        *bucket, F.col("other").alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), *payload
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in segments(batches, BUCKET):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            ids, copies = column("id").to_numpy(), column("copies").to_numpy()
            side, table = column("side").to_numpy(), column("table").to_numpy()
            same = column("i").to_numpy() == column("j").to_numpy()
            length = column("length").to_numpy()
            keys = column("keys").flatten().to_numpy().reshape(len(ids), TABLES)
            flat = column("vector").flatten().to_numpy()
            ends = np.r_[0, np.cumsum(length)]
            found = []
            for a, b in zip(bounds, bounds[1:]):
                part = slice(a, b)
                rows = flat[ends[a] : ends[b]].reshape(b - a, -1)
                left = int(np.count_nonzero(side[part] == 0))
                if left:
                    links = block_links(
                        ids[part], rows, keys[part], copies[part], left, table[a], threshold, same[a]
                    )
                    if links:
                        found.append(links)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*found)],
                    names=["id", "n", "lowest"],
                )

    # Sorted runs instead of one call for each of the many small buckets.
    rows = left.union(right).repartition(*BUCKET).sortWithinPartitions(*BUCKET, "side")
    return rows.mapInArrow(run, "id bigint, n bigint, lowest bigint")


def unmet_near_links(keyed: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n, lowest) of the links between vectors of a label that share no bucket, see :func:`unmet_links`."""
    block = ["label", "length", "i", "j"]
    rows = keyed.withColumn("length", F.size("vector"))
    # Small enough to broadcast: only what is cut, one row for every block_rows vectors at most.
    sizes = rows.groupBy("label", "length").agg(F.count("*").alias("size")).where(F.col("size") > block_rows)
    most = F.least(F.ceil(F.col("size") / BLOCKS), F.lit(BLOCK_COMPONENTS) / F.col("length"))
    parts = F.ceil(F.col("size") / F.greatest(F.lit(float(block_rows)), most)).cast("int")
    cut = sizes.select("label", "length", parts.alias("parts"))
    met = (
        rows.join(F.broadcast(cut), ["label", "length"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        # Each two blocks meet once, and each with itself.
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    met = met.select(
        "label",
        "length",
        F.least("part", "other").alias("i"),
        F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).cast("int").alias("side"),
        "id",
        "vector",
        "copies",
        "keys",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in segments(batches, block):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            ids, copies = column("id").to_numpy(), column("copies").to_numpy()
            side, length = column("side").to_numpy(), column("length").to_numpy()
            same = column("i").to_numpy() == column("j").to_numpy()
            keys = column("keys").flatten().to_numpy().reshape(len(ids), TABLES)
            flat = column("vector").flatten().to_numpy()
            ends = np.r_[0, np.cumsum(length)]
            for a, b in zip(bounds, bounds[1:]):
                part = slice(a, b)
                vectors = flat[ends[a] : ends[b]].reshape(b - a, -1)
                left = int(np.count_nonzero(side[part] == 0))
                links = unmet_links(ids[part], vectors, keys[part], copies[part], left, threshold, same[a])
                if links:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, links)), names=["id", "n", "lowest"])

    dealt = met.repartition(*block).sortWithinPartitions(*block, "side")
    return dealt.mapInArrow(run, "id bigint, n bigint, lowest bigint")


def near_duplicates(
    embeddings: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) for each id and vector."""
    # Single precision is kept where it came so, to move less; cosines are in double precision.
    kind = "float" if embeddings.schema[vector_column].dataType.simpleString() == "array<float>" else "double"
    vector = F.col(vector_column).cast(f"array<{kind}>")
    rows = embeddings.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(label_column).alias("label"),
        vector.alias("vector"),
    ).where("id IS NOT NULL")
    rows = rows.distinct()
    can = usable(F.col("vector")) & F.col("label").isNotNull()
    linkable = durable(rows.where(can))
    # Copies of a vector are one entry; their number is its weight. -0.0 and 0.0 are the same.
    plain = F.transform("vector", lambda x: x + F.lit(0.0).cast(kind))
    distinct = linkable.groupBy("label", plain.alias("vector")).agg(
        F.min("id").alias("low"), F.count("*").alias("copies")
    )
    # An id may have several vectors, so these are told apart by numbers, which the stored table fixes.
    numbered = distinct.withColumn("id", F.monotonically_increasing_id())
    keyed = durable(hashed(numbered.select("id", "label", "vector", "copies", "low")))
    links = durable(near_links(keyed, threshold).union(unmet_near_links(keyed, threshold)))
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(links.select(F.col("id").alias("u"), F.col("lowest").alias("v")))
    entries = (
        keyed.join(counts, "id", "left")
        .join(groups, "id", "left")
        .select(
            "label",
            "vector",
            "low",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "id").alias("group"),
        )
    )
    entries = durable(entries)
    named = entries.groupBy("group").agg(F.min("low").alias("component_id"))
    per_vector = entries.join(apart(named, "group"), "group").select(
        "label", "vector", "n_links", "component_id"
    )
    member = linkable.select("id", "label", plain.alias("vector"))
    found = member.join(per_vector, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where(~can).select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    result = found.union(alone).withColumn("kept", F.col("id") == F.col("component_id"))
    return result.withColumnRenamed("id", id_column)
