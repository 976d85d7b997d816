"""Exact duplicates against a grouping in memory."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from riskloom.llm import refinement

SCHEMA = "doc_id bigint, text string"


def normalised(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_force(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[normalised(text)].append(i)
    out = []
    for i, text in rows:
        same = groups[normalised(text)]
        keep = max((x for x in same if x is not None), default=None)
        digest = hashlib.sha256(normalised(text).encode()).hexdigest()
        out.append((i, keep, len(same), i == keep, digest))
    return sorted(out, key=str)


def found(spark, rows):
    df = refinement.exact_duplicates(spark.createDataFrame(rows, SCHEMA), digest="sha")
    return sorted((tuple(row) for row in df.collect()), key=str)


LONG = "word " * 200_000

ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "same texT"), (4, "same tex"), (5, "different"),
    (6, None), (7, ""), (8, " "), (9, "İ"), (10, "i̇"), (11, "Ä"), (12, "ä"),
    (13, "x" * 64 + "one"), (14, "x" * 64 + "two"), (15, "X" * 64 + "ONE"),
    (16, LONG), (17, LONG + "a"), (18, LONG.upper()), (None, "same text"), (None, "no id"),
    (None, "no id"), (20, "twice"), (20, "twice"), (20, "other"), (-5, "minus"), (-7, "Minus"),
]


def test_cases(spark):
    assert found(spark, ROWS) == brute_force(ROWS)


def test_one_group_of_copies_beside_others(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"Text {i % 40}") for i in range(3000)]
    assert found(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("bits", [64, 40_000])
def test_a_full_filter_changes_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(refinement, "FILTER_BITS", bits)
    rows = [(i, f"t{'x' * (i % 90)}{i % 700}") for i in range(2000)]
    assert found(spark, rows) == brute_force(rows)


def test_stages_leave_only_what_may_be_equal(spark):
    rows = [(1, "a"), (2, "bb"), (3, "cc"), (4, "dddd"), (5, "DDDD"), (6, "y" * 64 + "1"), (7, "y" * 64 + "2")]
    plain = refinement._plain(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    ids = lambda df: sorted(r["id"] for r in df.where("shared").collect())
    assert ids(refinement.left_after_lengths(plain)) == [2, 3, 4, 5, 6, 7]
    assert ids(refinement.left_after_prefixes(plain)) == [4, 5, 6, 7]


def test_no_text_moves(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = refinement.left_after_prefixes(refinement._plain(docs, "doc_id", "text"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_one_row_of_each_text(spark):
    rows = [(i, t, t) for i, t in ROWS if i is not None and (i, t) != (20, "twice")] + [(20, "twice", "a")]
    docs = spark.createDataFrame(rows, SCHEMA + ", key string")
    kept = sorted(r["doc_id"] for r in refinement.one_of_each_text(docs).collect())
    assert kept == sorted(i for i, _, _, stays, _ in brute_force([r[:2] for r in rows]) if stays)
    assert refinement.one_of_each_text(docs).columns == docs.columns


def test_empty_table_and_clashing_names(spark):
    assert found(spark, []) == []
    assert refinement.one_of_each_text(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a", 7, True, "b"), (2, "A", 8, False, "c")]
    docs = spark.createDataFrame(rows, SCHEMA + ", id bigint, shared boolean, key string")
    got = {tuple(r) for r in refinement.exact_duplicates(docs).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True)}
    assert [tuple(r) for r in refinement.one_of_each_text(docs).collect()] == [rows[1]]
