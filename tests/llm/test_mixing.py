"""Pfair schedules: deviation from exact targets over the whole stream, and completeness."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from riskloom.llm import mixing


@pytest.mark.parametrize("seed", range(20))
def test_less_than_one_block_of_deviation(seed):
    random.seed(seed)
    weights = {f"s{i}": random.randint(1, 60) for i in range(random.randint(1, 9))}
    slots = mixing.pfair_period(weights)
    total = sum(weights.values())
    assert Counter(slots) == weights
    had = Counter()
    for t, name in enumerate(slots, 1):
        had[name] += 1
        for s, w in weights.items():
            assert abs(had[s] - w * t / total) < 1
            assert had[s] * total <= w * t + total - 1


def shares(counts, weights):
    """The share of each source after each slot, in exact fractions, slot by slot: active sources
    split what is left of a slot in proportion to their weights, until one of them runs out."""
    had = {s: Fraction(0) for s in counts}
    for _ in range(sum(counts.values())):
        left = Fraction(1)
        while left:
            active = [s for s in counts if had[s] < counts[s]]
            total = sum(weights[s] for s in active)
            step = min([left / total, *[(counts[s] - had[s]) / weights[s] for s in active]])
            for s in active:
                had[s] += weights[s] * step
            left -= total * step
        yield dict(had)


def check_order(order, counts, weights, most):
    """Every piece once, in order, and no source ``most`` pieces or more away from its share."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    had = Counter()
    for (name, piece), target in zip(order, shares(counts, exact), strict=True):
        assert piece == had[name]
        had[name] += 1
        for s in counts:
            assert abs(had[s] - target[s]) < most, s
    assert had == Counter(counts)


def in_slots(spark, counts, weights):
    rows = mixing.schedule(spark, counts, weights).collect()
    assert sorted(r["slot"] for r in rows) == list(range(sum(counts.values())))
    return [(r["source"], r["piece"]) for r in sorted(rows, key=lambda r: r["slot"])]


@pytest.mark.parametrize("seed", range(30))
def test_periods_round_exact_shares(seed):
    random.seed(seed)
    n = random.randint(1, 12)
    counts = [random.randint(1, 60) for _ in range(n)]
    weights = [random.choice([random.random(), random.randint(1, 9), 0.002]) for _ in range(n)]
    exact = list(shares(dict(enumerate(counts)), dict(enumerate(map(Fraction, weights)))))
    last = np.zeros(n, int)
    for start, had, after in mixing.allotments(np.array(counts), np.array(weights), random.randint(1, 30)):
        assert (had == last).all() and (after >= had).all() and had.sum() == start
        for s in range(n):
            assert abs(int(after[s]) - exact[int(after.sum()) - 1][s]) < 1
        last = after
    assert last.tolist() == counts


@pytest.mark.parametrize("seed", range(6))
def test_schedule_over_sources_that_run_out(spark, monkeypatch, seed):
    random.seed(seed)
    monkeypatch.setattr(mixing, "PERIOD_SLOTS", random.choice([5, 40, 4096]))
    monkeypatch.setattr(mixing, "PERIODS", 50)
    names = [f"s{i}" for i in range(random.randint(1, 7))]
    counts = {s: random.randint(1, 90) for s in names}
    weights = {s: random.choice([random.random(), 3, 0.01]) for s in names}
    check_order(in_slots(spark, counts, weights), counts, weights, 2)


def test_one_large_source_beside_many_small(spark):
    """Weights are not rounded: 0.9 beside 500 of 0.0002 is nine tenths."""
    counts = {"big": 1800} | {f"s{i}": 1 for i in range(500)}
    weights = {"big": 0.9} | {f"s{i}": 0.0002 for i in range(500)}
    order = in_slots(spark, counts, weights)
    had = 0
    for t, (name, _) in enumerate(order[:2000], 1):
        had += name == "big"
        assert abs(had - 0.9 * t) < 2
    assert sorted(order) == sorted([("big", i) for i in range(1800)] + [(f"s{i}", 0) for i in range(500)])


def frame(spark, sizes):
    rows = [(i, s, f"text {i}") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2, "unused": 1}, None])
def test_every_document_once_and_in_proportion(spark, weights):
    sizes = {"a": 3000, "b": 900, "c": 350, "": 40}
    rows = mixing.mix(frame(spark, sizes), weights, block_docs=10).collect()
    rows.sort(key=lambda r: r["position"])
    assert sorted(r["row"]["doc_id"] for r in rows) == list(range(4290))
    assert len({r["position"] for r in rows}) == 4290
    slots = {}
    for r in rows:
        slots.setdefault(r["slot"], set()).add((r["source"], r["piece"]))
    assert sorted(slots) == list(range(len(slots)))
    assert all(len(x) == 1 for x in slots.values())
    # Less than a block of ten documents, two pieces of five, from the target, to the very end.
    target = {"a": 5.0, "b": 3.0, "c": 2.0, "": 0.011} if weights else {s: n**0.5 for s, n in sizes.items()}
    order = [next(iter(slots[t])) for t in range(len(slots))]
    check_order(order, {s: n // 5 for s, n in sizes.items()}, target, 2)


def test_edges(spark):
    schema = "doc_id bigint, source string, text string, slot int, row string, first int"
    rows = [(1, "a", "x", 1, "r", 2), (1, "a", "x", 1, "r", 2), (None, None, None, None, None, None)]
    rows += [(3, "", "", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    out = mixing.in_mixed_order(docs)
    assert out.schema == docs.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert len({r["position"] for r in mixing.places(docs).collect()}) == 4
    assert mixing.places(docs.limit(0)).count() == 0
    assert mixing.in_mixed_order(docs.limit(0)).count() == 0
    assert mixing.mix(docs, {}).count() == 4
    for weight in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.mix(docs, {"a": weight})


def test_order_is_written(spark, tmp_path):
    docs = frame(spark, {"a": 500, "b": 500})
    path = str(tmp_path / "mixed")
    mixing.in_mixed_order(docs, {"a": 1, "b": 1}).write.parquet(path)
    want = [r["row"]["doc_id"] for r in sorted(
        mixing.mix(docs, {"a": 1, "b": 1}).collect(), key=lambda r: r["position"])]
    import pyarrow.parquet as pq

    files = sorted(tmp_path.glob("mixed/*.parquet"))
    assert [x for f in files for x in pq.read_table(f)["doc_id"].to_pylist()] == want
