"""Exact top-k inner product search: a ball tree per shard, searched by branch and bound.

Vectors become integers, floor(256 * x). Candidates are dealt by a hash of their id into shards of
about SHARD_ROWS; each shard's task builds a ball tree. Queries are packed into blocks, and
a block goes from shard to shard within a lane of LANE_SHARDS shards, taking its k best scores
along. Before that, each block searches one shard of its own; the k-th scores found there are
shared with all lanes of the block, so every lane begins with a good bound.

Within a tree, nodes are visited in the order of their upper bound q . centre + |q| * radius, and the
search of a query ends when the best bound left is below its current k-th score. Bounds get a
margin for rounding, so results are exact; ties go to the smaller id.

Edge cases: vectors that are null or hold null or non-finite components neither ask nor answer; a query
meets the vectors of its own length, an empty vector none. Rows without an id take no part. Repeated rows of an
id count once. Fewer candidates than k give fewer rows. Components that do not fit 64 bits after scaling become
the largest that do. Scores are 64-bit integers: one that fits is exact whatever its summands are, one that does
not wraps; where scores could wrap, nothing is pruned. Only the named columns are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import durable

K = 5
SCALE = 256
SHARD_ROWS = 16_384
LANE_SHARDS = 8
BLOCK_QUERIES = 512
LEAF_ROWS = 64
# The largest whole number below 2**63 that a double holds.
LARGEST = 2.0**63 - 1024
# Bounds are inexact in the last digits; this share of |q| * (|centre| + radius) covers it.
MARGIN = 1e-9
EXACT = 2.0**52


class BallTree:
    """Nodes in breadth-first order; a leaf is a range of ``ids`` and ``rows``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(ids))
        points = rows.astype(np.float64)
        nodes: list[tuple[int, int]] = [(0, len(ids))]
        centres, radii, children = [], [], []
        at = 0
        while at < len(nodes):
            start, end = nodes[at]
            members = points[order[start:end]]
            centre = members.mean(axis=0)
            away = np.sqrt(((members - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(away.max())
            if end - start <= LEAF_ROWS or away.max() == 0:
                children.append(-1)
            else:  # halve along the line between two far members
                one = members[away.argmax()]
                other = members[((members - one) ** 2).sum(axis=1).argmax()]
                middle = (end - start) // 2
                by = np.argpartition(members @ (other - one), middle)
                order[start:end] = order[start:end][by]
                children.append(len(nodes))
                nodes += [(start, start + middle), (start + middle, end)]
            at += 1
        self.ids, self.rows = ids[order], rows[order]
        self.points = self.rows.astype(np.float64)
        self.nodes = nodes
        self.children = children
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query (row) with each node's members."""
        length = np.sqrt((queries**2).sum(axis=1))[:, None]
        bound = queries @ self.centres.T + length * self.radii
        bound += MARGIN * length * self.reach + MARGIN
        bound[length * self.reach >= EXACT * 512] = np.inf  # scores may wrap: never prune
        return bound


def better(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((ids, -scores))[:k]
    return scores[best], ids[best]


def search(
    tree: BallTree, query: np.ndarray, own: int, bounds: np.ndarray, k: int,
    scores: np.ndarray, ids: np.ndarray, floor: int | None,
) -> tuple[np.ndarray, np.ndarray]:
    """Best-first branch and bound from the k best so far; ``floor``: a k-th score found elsewhere."""
    as_float = query.astype(np.float64)
    small = np.abs(as_float).sum() * max(1.0, np.abs(tree.points).max(initial=0)) < EXACT
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        least = scores[-1] if len(scores) == k else None
        if floor is not None:
            least = floor if least is None else max(least, floor)
        if least is not None and -bound < least:
            break
        child = tree.children[node]
        if child >= 0:
            for side in (child, child + 1):
                heapq.heappush(heap, (max(bound, -bounds[side]), side))
            continue
        start, end = tree.nodes[node]
        if small:
            found = (tree.points[start:end] @ as_float).astype(np.int64)
        else:
            found = tree.rows[start:end] @ query
        members = tree.ids[start:end]
        use = members != own
        if least is not None:
            use &= found >= least
        if use.any():
            scores, ids = better(
                np.concatenate([scores, found[use]]), np.concatenate([ids, members[use]]), k
            )
    return scores, ids


def integer_rows(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) with whole components, without the vectors that take no part."""
    scaled = F.transform(F.col(vector_column).cast("array<double>"), lambda x: x * F.lit(256.0))
    finite = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    whole = F.transform(
        "vector",
        lambda x: F.floor(F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST))).cast("bigint"),
    )
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), scaled.alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.where(F.size("vector") > 0).select("id", whole.alias("vector"))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64)


def _search_block(k: int):
    def run(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """One block of queries through the shards of one lane."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        if len(queries) and len(trees):
            asked, own = _matrix(queries["vector"]), queries["id"].to_numpy()
            floors = [None if pd.isna(x) else int(x) for x in queries["floor"]]
            empty = np.zeros(0, np.int64)
            out = [(empty, empty)] * len(queries)
            for _, shard in trees.groupby("shard"):
                tree = BallTree(shard["id"].to_numpy(), _matrix(shard["vector"]))
                bounds = tree.bounds(asked.astype(np.float64))
                for i, query in enumerate(asked):
                    out[i] = search(tree, query, own[i], bounds[i], k, *out[i], floors[i])
        count = [len(scores) for scores, _ in out]
        return pd.DataFrame(
            {
                "query_id": np.repeat(queries["id"].to_numpy(), count) if out else [],
                "vec_id": np.concatenate([ids for _, ids in out]) if out else [],
                "score": np.concatenate([scores for scores, _ in out]) if out else [],
            }
        )

    return run


FOUND = "query_id bigint, vec_id bigint, score bigint"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. A query has at most k rows for each lane."""
    best = F.slice(
        F.array_sort(
            F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score"))
        ),
        1,
        k,
    )
    return found.groupBy("query_id").agg(best.alias("best"))


def top_k(
    embeddings: DataFrame,
    is_query: F.Column,
    k: int = K,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows that meet ``is_query`` the k best other rows."""
    rows = integer_rows(embeddings, id_column, vector_column)
    rows = durable(rows.withColumn("length", F.size("vector")))
    lengths = rows.groupBy("length").agg(
        F.count("*").alias("n"), F.count_if(is_query).alias("asked")
    )
    # One row per length of vectors, so the plan of shards and blocks goes along with every row.
    plan = lengths.select(
        "length",
        F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"),
        F.ceil(F.col("asked") / BLOCK_QUERIES).cast("int").alias("blocks"),
    )
    planned = rows.join(plan, "length")
    hashed = F.xxhash64("id")
    lane = F.floor(F.col("shard") / LANE_SHARDS).cast("int")
    dealt = planned.withColumn("shard", F.pmod(hashed, F.col("shards")).cast("int"))
    asked = planned.where(is_query).withColumn(
        "block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    )
    search_block = _search_block(k)

    def run(trees: DataFrame, blocks: DataFrame) -> DataFrame:
        keys = ["length", "block", "lane"]
        blocks = blocks.toDF(*blocks.columns)  # columns of its own, though both read the same rows
        return trees.groupBy(keys).cogroup(blocks.groupBy(keys)).applyInPandas(search_block, FOUND)

    # First each block looks into one shard. Its k-th score bounds the search of all others.
    blocks_of = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    copies = dealt.where("blocks > 0").withColumn("block", blocks_of)
    own = copies.where("shard = pmod(block, shards)").withColumn("lane", F.lit(-1))
    first = run(
        own.select("length", "block", "lane", "shard", "id", "vector"),
        asked.select(
            "length", "block", F.lit(-1).alias("lane"), "id", "vector",
            F.lit(None).cast("bigint").alias("floor"),
        ),
    )
    first = first.toDF(*first.columns)
    floors = _ranked(first, k).select(
        F.col("query_id").alias("id"),
        F.when(F.size("best") == k, F.col("best")[k - 1]["score"]).alias("floor"),
    )
    lanes = F.sequence(F.lit(0), F.floor((F.col("shards") - 1) / LANE_SHARDS).cast("int"))
    found = run(
        copies.withColumn("lane", lane).select(
            "length", "block", "lane", "shard", "id", "vector"
        ),
        asked.join(floors, "id", "left")
        .withColumn("lane", F.explode(lanes))
        .select("length", "block", "lane", "id", "vector", "floor"),
    )
    ranked = _ranked(found, k).select("query_id", F.posexplode("best").alias("place", "row"))
    return ranked.select(
        "query_id", (F.col("place") + 1).alias("rank"), "row.vec_id", "row.score"
    )
