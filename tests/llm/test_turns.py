"""Repaired conversations against a plain search over rows, states and edits."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from functools import lru_cache
from zlib import crc32

import numpy as np
import pytest
import xxhash

from riskloom.llm import turns
from riskloom.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def hash_of(text):
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).astype(np.int64)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hash_of(r[3]), r[3]))


def faults(rows):
    seen = set()
    for _, _, role, text in rows:
        said = text.strip(BLANKS)
        if not said:
            yield "blank"
        elif (role, text) in seen:
            yield "duplicate"
        else:
            yield "" if said[-1] in ".!?" else "truncated"
        seen.add((role, text))


def cheapest(rows, found):
    """(cost, edits): the least pair of both, by trying everything from every row and state."""
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        options = []
        if inserted < 2:
            cost, edits = best(i, after[state], inserted + 1)
            options.append((cost + 5, "I" + edits))
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, ""))
            return min(options) if options else (10**9, "")
        cost, edits = best(i + 1, state, 0)
        options.append((cost + 2, "D" + edits))
        if found[i] not in ("blank", "duplicate"):
            more = 5 * (found[i] == "truncated")
            initial = rows[i][2][:1]
            if (state, initial) in move:
                cost, edits = best(i + 1, move[state, initial], 0)
                options.append((cost + more, "K" + edits))
            cost, edits = best(i + 1, after[state], 0)
            options.append((cost + more + 1, "R" + edits))
        return min(options)

    return best(0, "", 0)


def repaired(rows, edits):
    lines, state, i = [], "", 0
    for letter in edits:
        if letter == "K":
            state = rows[i][2][0]
            lines.append(f"{rows[i][2]}:{rows[i][3]}")
        elif letter in "RI":
            state = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[state]
            lines.append(f"{name}:{rows[i][3] if letter == 'R' else ''}")
        i += letter != "I"
    return "\n".join(lines)


def brute_force(original, damaged=damage):
    groups = defaultdict(list)
    for row in damaged(original):
        groups[row[0]].append(row)
    out = []
    for conv in {row[0] for row in original}:
        rows = in_order(groups[conv])
        found = list(faults(rows))
        given = [row[1] for row in rows if row[1] is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
        cost, edits = cheapest(rows, tuple(found)) if rows else (0, "")
        digest = hashlib.sha256(repaired(rows, edits).encode()).hexdigest()
        counts = [found.count(x) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((conv, gaps, *counts, illegal, cost, edits, digest))
    return sorted(out, key=str)


def found(spark, rows, damaged=True, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    result = turns.digests(turns.repair(turns.damaged(df) if damaged else df), df)
    assert result.columns == (
        "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    )
    return sorted((tuple(row) for row in result.collect()), key=str)


def as_given(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


def conversations(seed, n=60, longest=14):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "Why?", "cut", " ", "", None, "Ends. \n", f"T{rnd.random()}."])
            rows.append((conv, rnd.choice([turn, turn, turn, turn // 2, None]), role, text))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("symbols", [1, 2, 3])
def test_tables_are_closed_and_agree(symbols):
    single, block = turns.tables(1), turns.tables(symbols)
    assert 4 < len(single.vectors) < 100
    rnd = np.random.default_rng(symbols)
    for _ in range(50):
        row = rnd.integers(0, turns.SYMBOLS, symbols)
        v = after = int(rnd.integers(len(single.vectors)))
        cost = 0
        for s in row[::-1]:
            cost += single.cost[v, s]
            v = single.before[v, s]
        number = turns.blocks_of(row, symbols)[0]
        assert (block.before[after, number], block.cost[after, number]) == (v, cost)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = conversations(seed)
    assert found(spark, rows) == brute_force(rows)


def test_without_damage(spark):
    rows = as_given(conversations(9))
    assert found(spark, rows, damaged=False) == brute_force(rows, damaged=lambda x: x)


def test_chunks_and_parts_make_no_difference(spark, monkeypatch):
    rows = conversations(4, n=4, longest=150) + [(None, t, "user", f"a{t}.") for t in range(30)]
    expected = brute_force(rows)
    monkeypatch.setattr(turns, "CHUNK", 4)
    assert found(spark, rows) == expected
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows) == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_copies_become_one_row(spark):
    rows = [(1, 0, "user", "Same.")] * 200 + [(1, 1, "assistant", "Right.")] + [(1, None, "x", "")] * 40
    got = found(spark, rows, damaged=False)
    assert got == brute_force(rows, damaged=lambda x: x)
    judged = turns._judged(turns._rows(spark.createDataFrame(rows, SCHEMA)))
    assert judged.count() == 3


def test_texts_of_any_kind(spark):
    rows = [
        (1, 0, "user", "x" * 300_000), (1, 1, "assistant", "word. " * 50_000),
        (2, 0, "system", "Only."), (3, 0, "ünder", "No role of the pattern."), (3, 1, "usher", "Kept."),
        (4, 0, "user", " "), (4, 1, "assistant", "Line.\x0b\x0c"), (5, 0, "assistant", None),
    ]
    assert found(spark, rows, damaged=False) == brute_force(as_given(rows), damaged=lambda x: x)


def test_empty_table_and_clashing_names(spark):
    assert found(spark, []) == []
    rows = [(1, 0, "user", "Yes.", "x", 1), (1, 1, "assistant", "No.", "y", 2)]
    got = found(spark, rows, False, SCHEMA + ", c string, n int")
    assert got == brute_force([r[:4] for r in rows], damaged=lambda x: x)


def test_repaired_rows(spark):
    rows = [(7, 0, "user", "Hi."), (7, 1, "user", "Hello."), (7, 2, "user", " "), (7, 3, "user", "Bye.")]
    mended = turns.repair(spark.createDataFrame(rows, SCHEMA))
    lines = mended.turns.orderBy("part", "chunk", "place").select("role", "text").collect()
    # DKDR costs as much as KRDD and comes before it.
    assert [tuple(x) for x in lines] == [("user", "Hello."), ("assistant", "Bye.")]
    assert [x["audit"] for x in mended.edits.collect()] == ["DKDR"]


def test_query(spark, folder):
    df = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_turn_repair"](spark, folder).collect()), key=str)
    assert got == brute_force(rows)
