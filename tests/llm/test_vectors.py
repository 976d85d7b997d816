"""Embedding near-dedup against all cosines."""

from __future__ import annotations

import numpy as np
import pytest

from riskloom.llm import vectors
from riskloom.llm.queries import QUERIES


def brute_force(rows):
    """rows: (id, vector, label) with unique ids."""
    good = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, float) / np.abs(np.array(v, float)).max()
            good[i] = (u / np.linalg.norm(u), label)
    links = {i: set() for i, _, _ in rows}
    for i, (u, a) in good.items():
        for j, (v, b) in good.items():
            if i < j and a == b and len(u) == len(v) and u @ v >= 0.93:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def found(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(QUERIES["op2_embedding_dedup"](spark, folder)) == brute_force(rows)


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_clusters_copies_and_chains(spark, block_rows, monkeypatch):
    random = np.random.default_rng(7)
    rows = []
    for c in range(6):  # clusters of near copies, one of them large
        centre = random.normal(size=24)
        for _ in range(60 if c == 0 else 8):
            rows.append((centre + random.normal(scale=0.06, size=24)).tolist())
    rows += [rows[0]] * 40  # copies
    for k in range(14):  # a chain: neighbours link, ends do not
        v = np.zeros(24)
        v[0], v[1] = np.cos(0.3 * k), np.sin(0.3 * k)
        rows.append(v.tolist())
    data = [(int(i), v, int(i % 2 if i > 140 else 1)) for i, v in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")
    monkeypatch.setattr(vectors.near_links, "__defaults__", (block_rows,))
    assert found(vectors.near_duplicates(df)) == brute_force(data)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1),
        (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1),
        (11, [1.0, 0.0, 0.0], 1), (12, [1e-300, 0.0], 1), (13, [1e300, -0.0], 1), (14, [-1.0, 0.0], 1),
    ]
    data = [(i, v, label, "x", 5) for i, v, label in rows]
    data += [data[0], (None, [1.0, 0.0], 1, "x", 5)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int, id string, copies int")
    got = found(vectors.near_duplicates(df))
    assert got == brute_force(rows)
    assert got[1] == (3, 1, True) and got[13] == (3, 1, False)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs barely above the threshold, the hardest ones, are found in more than nine of ten."""
    random = np.random.default_rng(11)
    rows = []
    for p in range(400):
        u, w = random.normal(size=(2, 64))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        rows += [(2 * p, u.tolist(), p % 9), (2 * p + 1, (0.931 * u + np.sqrt(1 - 0.931**2) * w).tolist(), p % 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = found(vectors.near_duplicates(df))
    assert sum(n for n, _, _ in got.values()) >= 0.97 * 800


def test_several_vectors_of_one_id(spark):
    """Each has its row and its links; only what repeats altogether counts once."""
    data = [
        (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1), (3, [0.01, 1.0], 1), (3, [0.01, 1.0], 1),
        (4, [-1.0, 0.02], 1), (4, [1.0, 0.01], 1), (2, None, 1), (2, None, 1),
    ]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")
    got = sorted(tuple(r) for r in vectors.near_duplicates(df).collect())
    assert got == [
        (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (2, 1, 2, True), (3, 1, 1, False),
        (4, 1, 1, False), (4, 1, 2, False),
    ]


def test_links_through_a_higher_vector_join_what_it_links():
    """1 and 2 are linked with 3 only; the three share every bucket."""
    angles = [-0.3, 0.3, 0.0]
    points = np.array([[np.cos(x), np.sin(x)] for x in angles])
    keys = np.zeros((3, vectors.TABLES), np.int32)
    ids, found, lowest = vectors.block_links(
        np.array([1, 2, 3]), points, keys, np.ones(3, np.int64), 3, 0, 0.93, same=True
    )
    assert (ids.tolist(), found.tolist(), lowest.tolist()) == ([1, 2, 3], [1, 1, 2], [1, 1, 1])


def test_every_pair_at_the_threshold_is_found(spark):
    """Of 2000 pairs the tables miss some; labels of one block and of several."""
    random = np.random.default_rng(12)
    data = []
    for p in range(2000):
        u, w = random.normal(size=(2, 64))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        near = 0.9301 * u + np.sqrt(1 - 0.9301**2) * w
        data += [(2 * p, u.tolist(), p % 2), (2 * p + 1, near.tolist(), p % 2)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")
    want = {i: (1, i - i % 2, i % 2 == 0) for i, _, _ in data}
    assert found(vectors.near_duplicates(df)) == want


def test_unmet_links_over_blocks(spark):
    """Without any shared bucket the exact check alone finds every link, each once, from both its ends."""
    random = np.random.default_rng(13)
    centres = random.normal(size=(40, 16))
    points = [c + random.normal(scale=0.08, size=16) for c in centres for _ in range(7)]
    data = [(i, i % 2, x.tolist(), 1, [i * 50 + t for t in range(vectors.TABLES)]) for i, x in enumerate(points)]
    keyed = spark.createDataFrame(data, "id bigint, label int, vector array<double>, copies bigint, keys array<int>")
    want = brute_force([(i, x, label) for i, label, x, _, _ in data])
    for block_rows in (4096, 11):
        n = {}
        for row in vectors.unmet_near_links(keyed, 0.93, block_rows).collect():
            n[row["id"]] = n.get(row["id"], 0) + row["n"]
        assert n == {i: k for i, (k, _, _) in want.items() if k}


def test_a_cosine_of_just_the_threshold_links(spark):
    v = [0.93, float(np.sqrt(1 - 0.93**2))]
    cosine = 0.93 / np.sqrt(v[0] ** 2 + v[1] ** 2)
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], 1), (2, v, 1), (3, [2.0**40, 0.0], 1)], "vec_id bigint, embedding array<double>, label int"
    )
    want = {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)}
    assert cosine >= 0.93 and found(vectors.near_duplicates(df)) == want
