"""Ball-tree search against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import balltree
from riskloom.llm.queries import QUERIES


def brute_force(rows: dict[int, list], queries: list[int], k: int = 5) -> list[tuple]:
    whole = {
        i: [math.floor(256 * x) for x in v]
        for i, v in rows.items()
        if v and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for q in queries:
        if q in whole:
            scores = [
                (-sum(a * b for a, b in zip(whole[q], v)), i)
                for i, v in whole.items()
                if i != q and len(v) == len(whole[q])
            ]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(df) -> list[tuple]:
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_query(spark, folder):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = found(QUERIES["op1_exact_topk"](spark, folder))
    assert got == brute_force(rows, [i for i in rows if i % 50 == 0])


@pytest.mark.parametrize("seed", range(3))
def test_many_shards_and_ties(spark, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(8, 6))
    vectors = centres[random.integers(0, 8, 900)] + random.normal(scale=0.05, size=(900, 6))
    vectors[300:600] = vectors[0]  # a third are copies of one vector
    rows = {int(i): v.tolist() for i, v in enumerate(vectors)}
    df = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")
    got = found(balltree.top_k(df, F.col("id") % 10 == 0, shard_rows=25))
    assert got == brute_force(rows, [i for i in rows if i % 10 == 0])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [0.5, -0.001]), (1, [1.0, 2.0]), (2, [nan, 1.0]), (3, [1.0, inf]),
        (100, None), (150, []), (4, [None, 1.0]), (200, [0.0, 0.0, 0.0]), (5, [3.0, -2.0]),
        (250, [1.0]), (5, [3.0, -2.0]), (None, [9.0, 9.0]),
    ]
    data = [(i, v, "x", 1) for i, v in rows]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, score string, shard int")
    got = found(balltree.top_k(df, F.col("id") % 50 == 0))
    plain = {i: v for i, v in rows if i is not None}
    assert got == brute_force(plain, [0, 50, 200, 250])
    assert {r[0] for r in got} == {0, 50}  # 200 and 250 have no partner of their length
    assert balltree.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_large_values_stay_exact(spark):
    rows = {i: [float(2**36 + 3 * i), float(-(2**35) + i)] for i in range(0, 60)}
    df = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")

    def wrapped(x: int) -> int:
        return (x + 2**63) % 2**64 - 2**63

    want = []
    for q in (0, 50):
        scores = []
        for i, v in rows.items():
            if i != q:
                total = sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(rows[q], v))
                scores.append((-wrapped(total), i))
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:5], 1)]
    assert found(balltree.top_k(df, F.col("id") % 50 == 0)) == sorted(want)


def test_search_prunes():
    random = np.random.default_rng(1)
    centres = random.normal(size=(64, 16)) * 300
    rows = (centres[random.integers(0, 64, 8000)] + random.normal(scale=8, size=(8000, 16))).astype(np.int64)
    tree = balltree.BallTree(np.arange(8000), rows)
    seen = []

    class Counted(list):
        def __getitem__(self, node):
            seen.append(node)
            return super().__getitem__(node)

    tree.nodes = Counted(tree.nodes)
    none = np.zeros(0, np.int64)
    bounds = tree.bounds(rows[:1].astype(float))[0]
    balltree.search(tree, rows[0], 0, bounds, 5, none, none, None)
    assert len(seen) < 40 < len(tree.children) / 4


def test_large_components(spark):
    """Scores that fit 64 bits are exact, however large the components are; some sums only fit in the end."""
    cases = (
        {0: [1.0, 0.0], 1: [1e12, 0.0], 2: [2e12, 0.0], 3: [3e13, -5.0], 4: [-1e12, 7.0], 5: [2e12, 1.0]},
        {0: [3e6, 3e6], 6: [4e6, -3.9999999e6], 7: [0.5, 0.25], 9: [4e6, 4e6]},
        {0: [2.0**-8, 2.0**-8], 8: [2.0**54, -(2.0**54) + 64], 7: [0.5, 0.25], 9: [2.0**54 - 64, -(2.0**54)]},
    )
    for rows in cases:
        df = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")
        got = found(balltree.top_k(df, F.col("id") == 0, k=8))
        assert got == brute_force(rows, [0], k=8)
    assert brute_force(cases[0], [0])[1:3] == [(0, 2, 2, 131072000000000000), (0, 3, 5, 131072000000000000)]


def test_components_beyond_64_bits(spark):
    rows = [(0, [1e-2, 0.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in balltree.top_k(df, F.col("id") == 0).orderBy("rank").collect()]
    assert len(got) == 3 and dict(got)[3] == 2 * 256
