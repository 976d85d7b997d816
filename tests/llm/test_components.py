"""Connected components against a plain search, and a hot node that the engine splits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm.common import apart
from riskloom.llm.components import components
from tests.test_skew import final_plan, low_thresholds  # noqa: F401


def plain(links):
    near = {}
    for u, v in links:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = {}
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        if min(seen) != node:
            out[node] = min(seen)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_links(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)]
    links += [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(600, 680)] + [(9, 9)]
    df = spark.createDataFrame(links, "u bigint, v bigint")
    assert dict(components(df).collect()) == plain([x for x in links if x[0] != x[1]])


def test_binary_and_empty(spark):
    df = spark.createDataFrame([(bytearray(b"c"), bytearray(b"a")), (bytearray(b"b"), bytearray(b"c"))],
                               "u binary, v binary")
    found = {bytes(r["id"]): bytes(r["component_id"]) for r in components(df).collect()}
    assert found == {b"b": b"a", b"c": b"a"}
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("cast", ["bigint", "binary", "string"])
def test_a_hot_node_is_split(spark, low_thresholds, cast):  # noqa: F811
    links = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("string").cast(cast).alias("u"),
        "id",
    ).repartition(6)
    lowest = links.groupBy("u").agg(F.min("id").alias("m"))
    assert "skew=true" in final_plan(links.join(apart(lowest, "u"), "u"))
