"""Repeated passages against a table of all strings of 100 bytes."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import substrings, suffixes
from riskloom.llm.queries import QUERIES
from riskloom.llm.suffixes import Block


@pytest.mark.parametrize("seed", range(60))
def test_suffix_order(seed):
    draw = random.Random(seed)
    letters = draw.choice(["ab", "abc", "a", "abcdefgh"])
    strings = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(draw.randint(1, 30))]
    if seed % 3 == 0:
        strings = [s * draw.randint(1, 6) for s in strings]
    strings = [s.encode() for s in strings]
    group = np.sort(np.array([draw.randint(0, 3) for _ in strings]))
    block = Block(strings)
    piece = np.repeat(np.arange(len(strings)), block.lengths + 1)
    got = []
    for place in block.suffix_order(group).tolist():
        k = piece[place]
        got.append((group[k], strings[k][place - block.starts[k] :]))
    assert got == sorted((group[k], s[i:]) for k, s in enumerate(strings) for i in range(len(s)))


def brute_force(rows, length=100):
    """rows: (id, text) in the order of documents. id -> n_bytes, n_removed, n_spans, sha256."""
    seen, out = set(), {}
    for i, text in rows:
        raw = (text or "").encode()
        covered = np.zeros(len(raw) + 1, bool)
        for a in range(len(raw) - length + 1):
            string = raw[a : a + length]
            if string in seen:
                covered[a : a + length] = True
            seen.add(string)
        covered = covered[:-1]
        spans = int(np.sum(covered & ~np.r_[False, covered[:-1]]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~covered])
        out[i] = (len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    got = found(QUERIES["op6_suffix_dedup"](spark, folder))
    assert got == brute_force(rows)
    assert sum(n for _, n, _, _ in got.values()) > 1000


def planted(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdeé", k=draw.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (30, 45, 80, 12, 26, 25, 24)] + ["ab" * 150, "x" * 400, "abcdefg " * 60]
    docs = []
    for _ in range(220):
        parts = [text(draw.randint(0, 40))]
        for _ in range(draw.choice([0, 0, 1, 2])):
            p = draw.choice(passages)
            a = draw.randint(0, max(0, len(p) - 120)) if draw.random() < 0.4 else 0
            parts += [p[a : a + draw.randint(90, 500)], text(draw.randint(0, 9))]
        docs.append("".join(parts))
    docs += [docs[5]] * 12 + [docs[7] + "!", "", "short", "y" * 99, "z" * 100, "z" * 101]
    draw.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,limits", [(1, None), (2, (3, 2000, 60, 500)), (3, (7, 100, 512, 1))])
def test_planted_passages(spark, seed, limits, monkeypatch):
    if limits:  # many blocks of an anchor, small arrays, short pieces, small chunks
        for name, value in zip(("BLOCK_PIECES", "ARRAY_BYTES", "PIECE", "CHUNK_BYTES"), limits):
            monkeypatch.setattr(substrings, name, value)
    rows = planted(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert found(substrings.digests(docs)) == brute_force(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    long = "".join(random.Random(4).choices("abcdefghij ", k=60_000))
    rows = [
        (7, long, 1, "x"), (7, long, 1, "x"), (9, "start " + long[100:400], 1, None), (None, long, None, None),
        (3, None, None, None), (2, "", None, None), (9, "other text of the same id " * 2, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, doc int, spans string")
    out = substrings.digests(docs).collect()
    assert len(out) == len(rows)
    by_id = {}
    for r in out:
        by_id.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"]))
    assert by_id[7] == [(60_000, 0, 0)] * 2  # the row repeated is one document
    assert by_id[None] == [(60_000, 60_000, 1)]
    assert sorted(by_id[9]) == [(52, 0, 0), (306, 300, 1)]
    assert by_id[3] == [(0, 0, 0)] and by_id[2] == [(0, 0, 0)]
    assert substrings.digests(docs.limit(0)).count() == 0
    kept = {(r["doc_id"], r["n_bytes"]): r for r in substrings.without_repeats(docs).collect()}
    assert kept[(9, 306)]["kept"] == b"start " and kept[(9, 306)]["removed"][0]["start"] == 6


def sorted_rows(rows, sizes):
    """What comes of rows (anchor, digest, doc, twice) in batches of the given sizes."""
    names = ["anchor", "digest", "doc", "start", "strings", "twice"]
    batches, at = [], 0
    for n in sizes:
        part = [(a, d, doc, 0, 1, twice) for a, d, doc, twice in rows[at : at + n]]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.bool_()]
        columns = [pa.array([r[i] for r in part], kind) for i, kind in enumerate(kinds)]
        batches.append(pa.RecordBatch.from_arrays(columns, names=names))
        at += n
    assert at == len(rows)
    return sorted(
        (r["doc"], r["anchor"], r["block"], r["whole"])
        for batch in substrings.dealt(iter(batches)) for r in batch.to_pylist()
    )


def test_batch_borders():
    # X | its copy, Y, Y | Y, Z: the repeat within X stays known, and Y's pieces stay together.
    x, y, z = 1, 2, 3
    rows = [(x, 1, 0, True), (x, 1, 1, True), (y, 1, 2, False), (y, 2, 3, False), (y, 3, 4, False)]
    rows += [(z, 1, 5, False)]
    want = [(0, x, 0, False), (1, x, 0, True), (2, y, 0, False), (3, y, 0, False), (4, y, 0, False)]
    assert sorted_rows(rows, [1, 3, 2]) == want


@pytest.mark.parametrize("seed", range(40))
def test_any_batches(seed, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_PIECES", 2)
    draw = random.Random(seed)
    keys = sorted((draw.randint(1, 6), draw.randint(1, 4)) for _ in range(draw.randint(1, 30)))
    twice = {key: draw.random() < 0.3 for key in keys}
    rows = [(*key, doc, twice[key]) for doc, key in enumerate(keys)]
    pieces = {}
    for a, d in keys:
        pieces.setdefault(a, {}).setdefault(d, len(pieces[a]))
    want, seen = [], set()
    for a, d, doc, again in rows:
        if (a, d) in seen:
            want.append((doc, a, 0, True))
        elif len(pieces[a]) > 1 or again:
            want.append((doc, a, pieces[a][d] // 2, False))
        seen.add((a, d))
    sizes, left = [], len(rows)
    while left:
        sizes.append(draw.randint(1, min(left, 4)))
        left -= sizes[-1]
    assert sorted_rows(rows, sizes) == want


def test_next_smaller_suffix():
    """Near and far next smaller suffixes, and those that many equal bytes put off."""
    draw = random.Random(8)
    strings = [b"a" * 40, b"ab" * 60 + b"a", b"a" + b"zyxwvutsrqponmlkjihgfedcb" * 3, b"", b"q"]
    strings += [bytes(draw.choices(b"abc", k=draw.randint(1, 90))) for _ in range(40)]
    strings += [bytes(range(65, 115)), b"".join(bytes([65 + k]) * 20 for k in range(4))]
    block = suffixes.Block(strings)
    assert suffixes.NEAR < 40
    found = block.next_smaller()
    for first, text in zip(block.starts.tolist(), strings):
        for i in range(len(text)):
            after = (j for j in range(i + 1, len(text)) if text[j:] < text[i:])
            assert found[first + i] == first + next(after, len(text))
