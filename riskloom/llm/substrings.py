"""Removal of repeated passages with suffix groups.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a document with a
smaller id, or earlier in the same one. Texts are UTF-8 bytes, and strings never cross documents.

1. Anchors. The anchor of a string of LENGTH bytes is the least hash of its substrings of ANCHOR bytes.
   Equal strings have equal anchors, and neighbouring strings mostly share theirs, so a document
   becomes pieces: runs of strings with the same anchor. Pieces, of two numbers each, are grouped
   by anchor. An anchor met once has no repeated string. Of pieces with the same content all but the
   first are repeats as a whole; within a task they are taken out before anything is shuffled.
2. Suffix groups. Where an anchor has several pieces, or comes twice in one, a suffix array decides,
   of as much of their text around the anchor as any two have in common: suffixes with a common prefix of LENGTH bytes stand together, and all but
   the first of them are repeats. See :mod:`riskloom.llm.suffixes`. Anchors with more pieces than
   a block holds have several blocks; what the blocks find is joined by a digest of the string.
3. The removed spans of each document are joined to its text.

Edge cases: a null text is empty; texts shorter than LENGTH keep all; repeated rows of a document
(same id and text) are one document and get the same result each; rows of one id with different texts
come in the order of a hash of the text, and rows without an id after all others. An empty
table gives an empty result. Only the id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import _BYTE, _P, _powers, as_utf8, blocks, mix64
from riskloom.llm.suffixes import Block
from riskloom.session import durable

LENGTH = 100
ANCHOR = 32
WINDOW = LENGTH - ANCHOR + 1
# Strings of a piece at most; longer runs occur in periodic text and are cut.
PIECE = 512
# Text in which a task takes out copies before the shuffle.
CHUNK_BYTES = 16 << 20
# Pieces of one anchor, and bytes of text, in a suffix array.
BLOCK_PIECES = 1500
ARRAY_BYTES = 512 << 10


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = of(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return of(values[: len(values) - rest], values[rest:]) if rest else values


def _anchor_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on."""
    value, size = _BYTE[raw], 1
    while size < ANCHOR:
        value = value[:-size] * np.uint64(pow(int(_P), size, 1 << 64)) + value[size:]
        size *= 2
    return mix64(value)


def pieces_of(texts: list[bytes]):
    """(anchor, digest, text number, start, strings, twice) of all pieces, in order.

    ``twice``: the anchor occurs more than once within the piece.
    """
    empty = np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < LENGTH:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty.astype(bool)
    hashes = _anchor_hashes(raw)
    least = _sliding(hashes, WINDOW, np.minimum)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[owner])
    least_at, owner_at = least[at], owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (least_at[1:] != least_at[:-1]) | (owner_at[1:] != owner_at[:-1])
    first = np.flatnonzero(new)
    strings = np.diff(np.r_[first, len(at)])
    for i in np.flatnonzero(strings > PIECE):
        new[first[i] : first[i] + strings[i] : PIECE] = True
    first = np.flatnonzero(new)
    strings = np.diff(np.r_[first, len(at)])
    start, anchor, number = at[first], least_at[first], owner_at[first]
    stop = start + strings + LENGTH - 1
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    digest = mix64((sums[stop] - sums[start]) * down[start] + strings.astype(np.uint64) * _P)
    # Places whose hash is the least of some window, found by value and place.
    pad = np.zeros(WINDOW - 1, np.uint64)
    reach = _sliding(np.r_[pad, least, pad], WINDOW, np.maximum)[: len(hashes)]
    places = np.flatnonzero(hashes == reach)
    _, kind = np.unique(np.r_[hashes[places], anchor], return_inverse=True)
    scale = len(raw) + 1
    known = np.sort(kind[: len(places)] * scale + places)
    own = kind[len(places) :] * scale
    count = np.searchsorted(known, own + stop - ANCHOR, side="right") - np.searchsorted(
        known, own + start
    )
    return anchor, digest, number, start - (ends - lengths)[number], strings, count > 1


RAW = "copy boolean, anchor bigint, digest bigint, doc bigint, start int, strings int, twice boolean"


def pieces(docs: DataFrame) -> DataFrame:
    """All pieces of the documents (doc, text); ``copy``: a first one is known in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def passed_on() -> pa.RecordBatch:
            anchor, digest, doc, start, strings, twice = map(np.concatenate, zip(*held))
            order = np.lexsort((start, doc))  # nearly in order, as documents mostly are
            both = mix64(anchor[order] ^ mix64(digest[order]))
            order = order[np.argsort(both, kind="stable")]
            a, d = anchor[order], digest[order]
            copy = np.zeros(len(order), bool)
            copy[1:] = (a[1:] == a[:-1]) & (d[1:] == d[:-1])
            columns = [copy, a.view(np.int64), d.view(np.int64), doc[order]]
            columns += [start[order].astype(np.int32), strings[order].astype(np.int32), twice[order]]
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in columns],
                names=["copy", "anchor", "digest", "doc", "start", "strings", "twice"],
            )

        for batch in batches:
            doc = batch.column(0).to_numpy()
            texts = as_utf8(batch.column(1).to_pylist())
            for a, b in blocks(texts):
                anchor, digest, number, start, strings, twice = pieces_of(texts[a:b])
                if len(anchor):
                    held.append((anchor, digest, doc[a:b][number], start, strings, twice))
                size += sum(map(len, texts[a:b]))
                if size > CHUNK_BYTES and held:
                    yield passed_on()
                    held, size = [], 0
        if held:
            yield passed_on()

    return docs.select("doc", "text").mapInArrow(run, RAW)


SORTED = "doc bigint, start int, strings int, anchor bigint, block int, whole boolean"


def sorted_out(rows: DataFrame) -> DataFrame:
    """(doc, start, strings, anchor, block, whole): pieces that repeat as a ``whole``, and those
    whose anchor has other pieces, dealt into blocks of an anchor.

    Rows stream by in the order of anchor, content and place, so an anchor may have any number.
    """
    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", "digest", "doc", "start")
    columns = ["anchor", "digest", "doc", "start", "strings", "twice"]
    return ordered.select(*columns).mapInArrow(dealt, SORTED)


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`sorted_out` makes of rows in order, wherever batches begin and end."""
    last = None  # anchor and digest of the last row
    current = None  # anchor of the last piece, which is the last row's
    met = 0  # its different pieces that are passed on
    alone = None  # its only piece, held back as long as no other is known; then none is passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, digest, doc, start, strings, twice = (
            batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)
        )
        same = np.zeros(len(anchor), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])
        same[0] = last == (anchor[0], digest[0])
        last = (anchor[-1], digest[-1])
        whole = [doc[same], start[same], strings[same], anchor[same]]
        part = [x[~same] for x in (doc, start, strings, anchor, twice)]
        out = [np.zeros(0, np.int32), np.zeros(0, bool)]
        if len(part[0]):
            # The piece held back comes before the new ones, be they of its anchor or not.
            if alone is not None:
                part = [np.r_[x, y] for x, y in zip(alone, part)]
                alone = None
            keys = part[3]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            rows = np.diff(np.r_[first, len(keys)])
            index = np.arange(len(keys)) - np.repeat(first, rows)
            size = rows.copy()
            if keys[0] == current:
                index[: rows[0]] += met
                size[0] += met
            keep = (np.repeat(size, rows) > 1) | part[4]
            current, met = keys[-1], int(size[-1])
            if met == 1:
                alone, met = [x[-1:] for x in part], 0
                keep[-1] = False
            part = [x[keep] for x in part]
            out = [(index[keep] // BLOCK_PIECES).astype(np.int32), np.zeros(int(keep.sum()), bool)]
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(np.r_[x, y]) for x, y in zip(whole, part)),
                pa.array(np.r_[np.zeros(len(whole[0]), np.int32), out[0]]),
                pa.array(np.r_[np.ones(len(whole[0]), bool), out[1]]),
            ],
            names=["doc", "start", "strings", "anchor", "block", "whole"],
        )
    if alone is not None and alone[4][0]:
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x) for x in alone[:4]), pa.array([0], pa.int32()), pa.array([False])],
            names=["doc", "start", "strings", "anchor", "block", "whole"],
        )


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc, start, strings, anchor, block) with the bytes of each piece."""
    per_doc = wanted.groupBy("doc").agg(
        F.collect_list(F.struct("start", "strings", "anchor", "block")).alias("wanted")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_utf8(batch.column(1).to_pylist())
            asked = batch.column(2)
            number = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(asked).to_numpy())
            start, strings, anchor, block = asked.flatten().flatten()
            bounds = zip(number.tolist(), start.to_numpy().tolist(), strings.to_numpy().tolist())
            text = [texts[i][a : a + n + LENGTH - 1] for i, a, n in bounds]
            doc = pa.array(batch.column(0).to_numpy()[number])
            for a in range(0, len(text), 20_000):
                b = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [anchor[b], block[b], doc[b], start[b], pa.array(text[b], pa.binary())],
                    names=["anchor", "block", "doc", "start", "text"],
                )

    met = docs.join(per_doc, "doc").select("doc", "text", "wanted")
    return met.mapInArrow(run, "anchor bigint, block int, doc bigint, start int, text binary")


def _common_length(rows: np.ndarray, group: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The most bytes that each row has in common with another one of its group, from the left."""
    words = rows.view(">u8")
    order = np.lexsort((*(words[:, k] for k in reversed(range(words.shape[1]))), group))
    differs = rows[order][1:] != rows[order][:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    common[group[order][1:] != group[order][:-1]] = 0
    most = np.zeros(len(rows), np.int64)
    most[order] = np.maximum(np.r_[0, common], np.r_[common, 0])
    return np.minimum(most, reach)


def shared_parts(anchor: np.ndarray, texts: list[bytes], group: np.ndarray):
    """Where each piece can have a string in common with another one of its group, as (from, to).

    Around the anchor a piece agrees with any other for at most some bytes to the left and some to the
    right, which sorting shows. Where both and the anchor make less than LENGTH, there is no common
    string, and none reaches beyond them. Pieces that hold the anchor twice stay whole.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    raw = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), lengths)
    hashes = _anchor_hashes(raw)
    own = owner[: len(hashes)]
    at = np.flatnonzero((hashes == anchor[own]) & (np.arange(len(hashes)) + ANCHOR <= ends[own]))
    own = owner[at]
    wide = (LENGTH - ANCHOR + 7) // 8 * 8
    plus = raw + np.uint8(1)  # UTF-8 has no byte 0xff, so zero is free to stand for the end

    def beside(places: np.ndarray, inside: np.ndarray) -> np.ndarray:
        rows = plus[np.clip(places, 0, len(raw) - 1)]
        rows[~inside] = 0
        return np.ascontiguousarray(rows)

    step = np.arange(wide)
    to_right = at[:, None] + ANCHOR + step
    to_left = at[:, None] - 1 - step
    right = beside(to_right, to_right < ends[own][:, None])
    left = beside(to_left, to_left >= starts[own][:, None])
    after = _common_length(right, group[own], ends[own] - at - ANCHOR)
    before = _common_length(left, group[own], at - starts[own])
    count = np.bincount(own, minlength=len(texts))
    low, high = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    once = (count[own] == 1) & (before + ANCHOR + after >= LENGTH)
    low[own[once]] = at[once] - before[once] - starts[own[once]]
    high[own[once]] = at[once] + ANCHOR + after[once] - starts[own[once]]
    high[count > 1] = lengths[count > 1]
    return low, high


def repeated_starts(texts: list[bytes], group: np.ndarray):
    """Strings of LENGTH bytes that stand together in the suffix order of their group.

    ``texts`` are pieces, ordered by group and within it by place. Returns the piece and the start
    of each string in that order, and the number of its class, classes counted from 0.
    """
    block = Block(texts)
    order = block.suffix_order(group)
    piece = np.searchsorted(block.starts, order, side="right") - 1
    start = order - block.starts[piece]
    whole = start + LENGTH <= block.lengths[piece]
    order, piece, start = order[whole], piece[whole], start[whole]
    same = np.zeros(len(order), bool)
    if len(order):
        near = np.flatnonzero(group[piece][1:] == group[piece][:-1]) + 1
        same[near] = block.same_prefix(order[near - 1], order[near], LENGTH)
    return piece, start, np.cumsum(~same) - 1


FOUND = "doc bigint, start int, end int, one binary"


def suffix_repeats(pieces: DataFrame) -> DataFrame:
    """(doc, start, end, one): spans of repeated strings of the pieces with their bytes.

    Rows with ``one`` are not repeated in their block, but a block may not be all of its anchor's: ``one``
    is the digest of such a first string, to be compared with those of the other blocks.
    """
    ordered = pieces.repartition("anchor", "block").sortWithinPartitions(
        "anchor", "block", "doc", "start"
    )

    found = pa.schema(
        [("doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("one", pa.binary())]
    )

    def solved(anchor, block, doc, start, text) -> pa.RecordBatch:
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])]
        group = np.cumsum(new) - 1
        # A full block may not be all of its anchor's, so its pieces stay as they are.
        partial = (np.bincount(group)[group] >= BLOCK_PIECES) | (block > 0)
        low, high = shared_parts(anchor.view(np.uint64), text, group)
        low[partial], high[partial] = 0, [len(text[i]) for i in np.flatnonzero(partial)]
        some = np.flatnonzero(high - low >= LENGTH)
        if not len(some):
            return pa.RecordBatch.from_pylist([], schema=found)
        doc, start, group, partial = doc[some], (start + low)[some], group[some], partial[some]
        text = [text[i][a:b] for i, a, b in zip(some, low[some], high[some])]
        piece, at, kind = repeated_starts(text, group)
        place = doc[piece], start[piece] + at
        by = np.lexsort((place[1], place[0], kind))
        kind, piece, at = kind[by], piece[by], at[by]
        first = np.r_[True, kind[1:] != kind[:-1]][: len(kind)]
        # Repeated strings of a piece that follow each other are one span.
        again = np.lexsort((at[~first], piece[~first]))
        p, s = piece[~first][again], at[~first][again]
        opens = np.ones(len(p), bool)
        opens[1:] = (p[1:] != p[:-1]) | (s[1:] > s[:-1] + LENGTH)
        head = np.flatnonzero(opens)
        tail = np.r_[head[1:], len(p)][: len(head)] - 1
        out_doc = doc[p[head]].tolist()
        out_start = (start[p[head]] + s[head]).tolist()
        out_end = (start[p[tail]] + s[tail] + LENGTH).tolist()
        one: list[bytes | None] = [None] * len(head)
        for i, a in zip(piece[first & partial[piece]].tolist(), at[first & partial[piece]].tolist()):
            out_doc.append(doc[i])
            out_start.append(start[i] + a)
            out_end.append(start[i] + a + LENGTH)
            one.append(hashlib.blake2b(text[i][a : a + LENGTH], digest_size=16).digest())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(out_doc, pa.int64()),
                pa.array(out_start, pa.int32()),
                pa.array(out_end, pa.int32()),
                pa.array(one, pa.binary()),
            ],
            schema=found,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            anchor, block, doc, start = (batch.column(i).to_numpy() for i in range(4))
            text = batch.column(4).to_pylist()
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])]
            first = np.flatnonzero(new).tolist() if len(anchor) else []
            for a, b in zip(first, [*first[1:], len(anchor)]):
                fresh = not held or (held[-1][0][-1], held[-1][1][-1]) != (anchor[a], block[a])
                if fresh and size > ARRAY_BYTES:
                    yield solved(*(np.concatenate(x) for x in list(zip(*held))[:4]),
                                 [t for x in held for t in x[4]])
                    held, size = [], 0
                held.append((anchor[a:b], block[a:b], doc[a:b], start[a:b], text[a:b]))
                size += sum(map(len, text[a:b]))
        if held:
            yield solved(*(np.concatenate(x) for x in list(zip(*held))[:4]),
                         [t for x in held for t in x[4]])

    return ordered.mapInArrow(run, FOUND)


def with_doc(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc, id, text): the rows with a number that orders the documents.

    It is the id itself where ids are unique whole numbers. Otherwise the different rows are numbered
    in the order of id and hash of the text.
    """
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    counts = plain.groupBy("id").agg(F.count("*").alias("k"))
    strange = counts.where("k > 1 OR id IS NULL").limit(1).count()
    whole = plain.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and not strange:
        return plain.select(F.col("id").cast("bigint").alias("doc"), "id", "text")
    hashed = plain.withColumn("hash", F.xxhash64("text"))
    ordered = hashed.select("id", "hash").distinct().orderBy(F.asc_nulls_last("id"), "hash")
    numbered = ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    kind = plain.schema["id"].dataType.simpleString()
    ranks = docs.sparkSession.createDataFrame(numbered, f"i {kind}, h bigint, doc bigint")
    ranks = durable(ranks)
    met = hashed.join(ranks, F.expr("id <=> i AND hash = h"))
    return durable(met.select("doc", "id", "text"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc, start, end) of all repeats; they may overlap. ``docs``: (doc, text), doc unique."""
    found = pieces(docs)
    sent = durable(
        found.where("NOT copy").transform(sorted_out).unionByName(
            found.where("copy").select(
                "doc", "start", "strings", "anchor",
                F.lit(0).alias("block"), F.lit(True).alias("whole"),
            )
        )
    )
    whole = sent.where("whole").select(
        "doc", "start", (F.col("start") + F.col("strings") + LENGTH - 1).alias("end")
    )
    repeats = durable(suffix_repeats(cut_out(docs, sent.where("NOT whole").drop("whole"))))
    ones = repeats.where("one IS NOT NULL")
    place = F.struct("doc", "start")
    firsts = ones.groupBy("one").agg(F.min(place).alias("first"), F.count("*").alias("k"))
    later = ones.join(firsts.where("k > 1"), "one").where(place != F.col("first"))
    spans_of = ["doc", "start", "end"]
    return whole.union(repeats.where("one IS NULL").select(spans_of)).union(later.select(spans_of))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by spans."""
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def without_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary, removed array): the remaining bytes and the
    removed spans of each document. Cuts follow bytes, so what is left need not be whole characters."""
    return _joined(docs, id_column, text_column, True)


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    return _joined(docs, id_column, text_column, False)


def _joined(docs: DataFrame, id_column: str, text_column: str, content: bool) -> DataFrame:
    rows = with_doc(docs, id_column, text_column)
    found = spans(rows.select("doc", "text").dropDuplicates(["doc"]) if _repeats(rows) else rows)
    # Few rows cover a hot passage of a document twice: same spans are one before the shuffle.
    per_doc = found.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_utf8(batch.column(1).to_pylist())
            columns: list[list] = [[] for _ in range(5)]
            lists = batch.column(2)
            for i, text in enumerate(texts):
                pairs = lists[i].values
                removed: list[tuple[int, int]] = []
                if pairs is not None and len(pairs):
                    a, b = (x.to_numpy() for x in pairs.flatten())
                    removed = merged(a, b)
                at, rest = 0, []
                for a, b in removed:
                    rest.append(text[at:a])
                    at = b
                kept = b"".join([*rest, text[at:]])
                values = (len(text), len(text) - len(kept), len(removed))
                values += (kept, removed) if content else (hashlib.sha256(kept).hexdigest(), None)
                for column, value in zip(columns, values):
                    column.append(value)
            arrays = [pa.array(x, pa.int64()) for x in columns[:3]]
            if content:
                kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                spans = [[{"start": a, "end": b} for a, b in x] for x in columns[4]]
                arrays += [pa.array(columns[3], pa.binary()), pa.array(spans, pa.list_(kind))]
                names = ["kept", "removed"]
            else:
                arrays += [pa.array(columns[3], pa.string())]
                names = ["kept_sha256"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow_kind), *arrays],
                names=["id", "n_bytes", "n_removed", "n_spans", *names],
            )

    schema = f"id {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, " + (
        "kept binary, removed array<struct<start: int, end: int>>" if content else "kept_sha256 string"
    )
    met = rows.join(per_doc, "doc", "left").select("id", "text", "spans")
    return met.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def _repeats(rows: DataFrame) -> bool:
    """Whether a document has several rows; only then the texts are brought together by number."""
    return bool(rows.groupBy("doc").count().where("count > 1").limit(1).count())
