"""Near-duplicate documents against all pairs of full sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import forest_dedup
from riskloom.llm.queries import QUERIES


def shingles(text, width):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_force(rows, width):
    """rows: (id, text) with unique ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        a = sets[i]
        for j in ids[:k]:
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 80 * (len(a) + len(b) - common):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = found(QUERIES["op5_near_dedup"](spark, folder))
    assert got == brute_force(rows, 2)
    assert sum(not kept for _, _, kept in got.values()) > 20


def planted(seed):
    """Groups of near copies of several degrees, a star, copies, and unrelated texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(1, 4)))
    texts = []
    for size, length, changes in ((60, 120, 2), (40, 80, 4), (12, 300, 20), (9, 15, 1), (25, 200, 11)):
        base = [word() for _ in range(length)]
        texts.append(" ".join(base))
        for _ in range(size):
            copy = list(base)
            for _ in range(changes):
                copy[draw.randrange(length)] = word()
            texts.append(" ".join(copy))
    texts += [texts[3]] * 30 + [texts[3].upper()] * 3
    texts += [" ".join(word() for _ in range(draw.randint(1, 60))) for _ in range(250)]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("width,limits", [(2, None), (2, (8, 6)), (5, None)])
def test_planted_groups(spark, width, limits, monkeypatch):
    if limits:  # so small that regions are cut deeper and into blocks
        monkeypatch.setattr(forest_dedup, "RUN_ROWS", limits[0])
        monkeypatch.setattr(forest_dedup, "REGION_ROWS", limits[1])
    rows = planted(3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(forest_dedup.near_duplicates(docs, width)) == brute_force(rows, width)


def test_edges(spark):
    long = " ".join(f"w{i % 9000}" for i in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "é É"), (8, "É é"),
        (9, "one two\x0bthree"), (10, "One  two three "), (11, long), (12, long + " more"), (13, "\xa0"),
    ]
    data = [(i, t, "x", 3) for i, t in rows] + [(4, "one", "x", 3), (None, "one", "x", 3), (None, "alone", "y", 1)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, node string, n int")
    out = forest_dedup.near_duplicates(docs, 2).collect()
    assert len(out) == len(data)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"]}
    assert got == brute_force(rows, 2)
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, True)] * 2
    kept = forest_dedup.first_of_each_group(docs, 2)
    assert kept.schema == docs.schema
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    assert ids == [0, 0, 1, 2, 3, 4, 6, 7, 8, 9, 11, 13]
    empty = docs.limit(0)
    assert forest_dedup.near_duplicates(empty, 2).count() == 0
    assert forest_dedup.first_of_each_group(empty).count() == 0


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.r_[a[:1600], draw.integers(0, 2**63, 400).astype(np.uint64)]
    rows = forest_dedup.minhash(np.r_[a, b], np.array([0, 2000]))
    assert abs((rows[0] == rows[1]).mean() - 1600 / 2400) < 0.08


def test_repeated_id_with_other_texts(spark):
    draw = random.Random(4)
    one, two, three = (" ".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(3))
    data = [
        (1, two), (3, one), (3, two + " z"), (4, one + " z"), (4, one),  # 3 stands for one, and is a copy of two
        (5, three), (5, three + " z"), (6, three), (7, None), (7, ""), (None, three),
    ]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    kept = [tuple(r) for r in forest_dedup.first_of_each_group(docs, 2).collect()]
    assert (1, two) in kept and (3, one) in kept
    assert sum(i == 5 for i, _ in kept) == 1
    assert sorted(i or 0 for i, _ in kept) == [0, 1, 3, 5, 7, 7]


def test_large_regions_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(forest_dedup, "REGION_ROWS", 4)
    names = [bytes([i]) for i in range(12)]
    # Six values agree, the seventh differs; the sets are larger than what is compared of them.
    data = [(0, i << 8, name, 12, name, 600, bytes(forest_dedup.SKETCH)) for i, name in enumerate(names)]
    schema = "tree int, key bigint, node binary, size bigint, component binary, n bigint, sketch binary"
    rows = spark.createDataFrame(data, schema)
    lowest = np.arange(forest_dedup.BOTTOM, dtype=np.uint32).tobytes()
    sets = spark.createDataFrame([(name, lowest) for name in names], "node binary, bottom binary")
    pairs = forest_dedup.cross_links(rows, sets, 80).collect()
    got = sorted((bytes(r["u"]), bytes(r["v"])) for r in pairs)
    assert got == [(a, b) for a in names for b in names if a < b]


def test_sets_known_whole_give_spanning_links(spark, monkeypatch):
    names = [bytes([i]) for i in range(40)]
    data = [(0, i << 8, name, 40, name, 100, bytes(forest_dedup.SKETCH)) for i, name in enumerate(names)]
    schema = "tree int, key bigint, node binary, size bigint, component binary, n bigint, sketch binary"
    # The second half shares 70 of 100 with the first.
    low = [np.arange(k, k + 100, dtype=np.uint32).tobytes() for k in (0, 30)]
    sets = spark.createDataFrame([(x, low[i >= 20]) for i, x in enumerate(names)], "node binary, bottom binary")
    pairs = forest_dedup.cross_links(spark.createDataFrame(data, schema), sets, 80).collect()
    assert len(pairs) == 38
    group = {name: {name} for name in names}
    for r in pairs:
        one, two = group[bytes(r["u"])], group[bytes(r["v"])]
        one |= two
        for x in two:
            group[x] = one
    assert {frozenset(x) for x in group.values()} == {frozenset(names[:20]), frozenset(names[20:])}


@pytest.mark.parametrize("n", [10, 300, 512, 513, 900, 4000])
def test_lowest_hashes_decide_as_whole_sets_do(n):
    draw = np.random.default_rng(n)
    for share in (0.5, 0.78, 0.8, 0.82, 0.95):
        base = np.unique(draw.integers(0, 2**64, 3 * n, dtype=np.uint64))
        draw.shuffle(base)
        both = int(n * 2 * share / (1 + share))
        one, two = np.sort(base[:n]), np.sort(np.r_[base[:both], base[n : 2 * n - both]])
        common = len(np.intersect1d(one, two))
        linked = 100 * common >= 80 * (len(one) + len(two) - common)
        low = [(x[: forest_dedup.BOTTOM] >> np.uint64(32)).astype(np.uint32) for x in (one, two)]
        found, certain = forest_dedup.may_link(*low, len(one), len(two), 80)
        assert certain == (n <= forest_dedup.BOTTOM)
        assert found == linked if certain else found >= linked
        if share == 0.5:
            assert not found


def test_pair_is_compared_in_one_tree():
    """Rows that share all trees, as near copies do, meet once and not in every tree."""
    trees, rows = 12, 9
    draw = np.random.default_rng(3)
    sketch = np.tile(draw.integers(0, 255, forest_dedup.SKETCH, dtype=np.uint8), (rows, 1))
    sketch[:, : 2 * forest_dedup.DEPTH] = draw.integers(0, 255, (rows, 2 * forest_dedup.DEPTH))  # two unlike trees
    batch = pa.table(
        {
            "tree": pa.array(np.repeat(np.arange(2, trees), rows), pa.int32()),
            "i": np.zeros((trees - 2) * rows, np.int32),
            "j": np.zeros((trees - 2) * rows, np.int32),
            "component": np.tile(np.arange(rows), trees - 2),
            "n": np.full((trees - 2) * rows, 50),
            "sketch": pa.array([x.tobytes() for x in sketch] * (trees - 2), pa.binary()),
            "part": np.zeros((trees - 2) * rows, np.int32),
        }
    ).to_batches()[0]
    block = forest_dedup.Block(batch, 80)
    met = []
    for start in range(0, batch.num_rows, rows):
        for a, b, agree in block.candidates(start, start + rows, first=True):
            met += [(a % rows, x % rows) for x in b.tolist()]
            assert np.allclose(agree, (sketch[b % rows] == sketch[a % rows]).mean(axis=1))
    assert sorted({(min(x), max(x)) for x in met}) == [(a, b) for a in range(rows) for b in range(a + 1, rows)]
    assert len(met) == rows * (rows - 1) // 2


def test_row_with_all_partners():
    """Many partners at once are judged as each one is against the plain sets."""
    draw = np.random.default_rng(5)
    base = np.unique(draw.integers(0, 1 << 63, 2000, dtype=np.uint64))
    sets = []
    for size, share in ((300, 1.0), (300, 0.95), (300, 0.6), (310, 0.9), (1500, 0.97), (1500, 0.5), (1800, 0.85)):
        kept = base[:size][draw.random(size) < share]
        sets.append(np.unique(np.r_[kept, draw.integers(0, 1 << 63, size - len(kept), dtype=np.uint64)]))
    low = [(x[: forest_dedup.BOTTOM] >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets]
    size = np.array(list(map(len, sets)))
    bottoms = forest_dedup.Bottoms(low, size, 80)
    for a, one in enumerate(sets):
        others = np.array([b for b in range(len(sets)) if b != a])
        links, certain = bottoms.may_link(a, others)
        for b, link, sure in zip(others.tolist(), links, certain):
            common = len(np.intersect1d(one, sets[b]))
            linked = 100 * common >= 80 * (len(one) + len(sets[b]) - common)
            assert sure == (max(len(one), len(sets[b])) <= forest_dedup.BOTTOM)
            assert link == linked if sure else link >= linked
