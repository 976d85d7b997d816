"""Alignment of two tokenizers by inverted pair bitmaps.

Both tokenizers encode the same bytes, a blank and the text. Places where tokens of both end cut
the tokens into groups; two tokens are linked where their byte ranges overlap.

The index is inverted: for each pair of linked token ids, the documents that hold it. Documents are numbered
within chunks of at most CHUNK_DOCS documents and about CHUNK_BYTES of text, so a chunk is one container of a compressed
bitmap: a sorted list of 16-bit numbers, or 65,536 bits where that is shorter. Plane 0 has a bit per
document that holds the pair; plane j > 0 has bit j - 1 of one less than the number of its links in
the document. The parts of a chunk are OR-merged where they are made. Then

1. the bits of plane 0 are counted over all chunks, which gives each pair's number of documents, and
   the highest of each id of the first tokenizer;
2. each container, joined with its pair's count, returns scores to the documents of its chunk: a plane's
   bit is worth its power of two in links.

A pair that all documents hold has one container per chunk and plane; the join splits it between tasks.
A task holds the postings of one chunk.

Edge cases: texts that are null or empty, or whose tokens do not give back their bytes (as where a text has a
character that one tokenizer uses for blanks), have no tokens and zeros everywhere. Strings of special
tokens in a text are plain text. A text longer than a chunk is a chunk of its own. Repeated rows
are documents of their own. A missing id is returned as it is. An empty table gives an empty result.
Only id and text are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bpe import PATTERN, byte_letters
from riskloom.llm.common import apart, blocks, share_package
from riskloom.session import durable

# A chunk is at most this many documents, as their numbers have 16 bits, and about this many bytes of text.
CHUNK_DOCS = 1 << 16
CHUNK_BYTES = 16 << 20
# Bytes of text that are tokenized at once.
BLOCK_BYTES = 1 << 20
# A container of so many documents or more is stored as bits, 8 kB; a list is always shorter.
LIST_DOCS = 4096
# Token ids of either tokenizer need at most this many bits.
ID_BITS = 24


class Codec(NamedTuple):
    encode: object  # list[str] -> list of lists of ids
    pieces: list[bytes]  # bytes of each id
    lengths: np.ndarray
    names: list[str]  # ids in decimal


def _codec(encode, pieces: list[bytes]) -> Codec:
    lengths = np.array([len(piece) for piece in pieces], np.int64)
    return Codec(encode, pieces, lengths, list(map(str, range(len(pieces)))))


@lru_cache(maxsize=None)
def byte_bpe(path: str) -> Codec:
    """A byte-level BPE vocabulary (JSON), which encodes a blank and the text."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters = byte_letters()
    special = {x["content"] for x in content["added_tokens"] if x["special"]}
    vocabulary = content["model"]["vocab"]
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    codec = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return _codec(lambda texts: [codec.encode_ordinary(" " + text) for text in texts], pieces)


@lru_cache(maxsize=None)
def piece_bpe(path: str) -> Codec:
    """A SentencePiece model, which puts the blank in front itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else None
        pieces.append(byte or piece.replace("▁", " ").encode())
    return _codec(lambda texts: model.encode(texts, num_threads=1), pieces)


class Aligned(NamedTuple):
    """Links of several texts, all in one row: text, id of either tokenizer."""

    n_a: list[int]
    n_b: list[int]
    n_groups: list[int]
    n_links: list[int]
    groups: list[str]  # "a1,a2|b1;a3|b2" of each text
    text: np.ndarray
    a: np.ndarray
    b: np.ndarray


def align(texts: list[str | None], first: Codec, second: Codec) -> Aligned:
    n = len(texts)
    some = [i for i, text in enumerate(texts) if text]
    tokens = [
        (i, a, b)
        for i, a, b in zip(
            some, first.encode([texts[i] for i in some]), second.encode([texts[i] for i in some])
        )
    ]
    kept = []
    for i, a, b in tokens:
        whole = b" " + texts[i].encode()
        if b"".join([first.pieces[x] for x in a]) == whole == b"".join([second.pieces[x] for x in b]):
            kept.append((i, a, b))
    out = Aligned(
        [0] * n, [0] * n, [0] * n, [0] * n, [""] * n, *(np.zeros(0, np.int64) for _ in range(3))
    )
    if not kept:
        return out
    ids = [np.fromiter(chain.from_iterable(row[k] for row in kept), np.int64) for k in (1, 2)]
    ends = [np.cumsum(codec.lengths[x]) for codec, x in zip((first, second), ids)]
    ending = np.zeros((2, ends[0][-1] + 1), bool)  # by byte: whether a token ends there
    ending[0, ends[0]] = ending[1, ends[1]] = True
    cuts = np.flatnonzero(ending[0] | ending[1])  # each piece between two cuts is one link
    at = [np.searchsorted(e, cuts) for e in ends]
    common = np.flatnonzero(ending[0] & ending[1])
    stops = [np.searchsorted(e, common, side="right").tolist() for e in ends]
    counts = [np.array([len(row[k]) for row in kept]) for k in (1, 2)]
    last = ends[0][np.cumsum(counts[0]) - 1]
    links = np.diff(np.searchsorted(cuts, last, side="right"), prepend=0)
    groups = np.diff(np.searchsorted(common, last, side="right"), prepend=0)
    names = [list(map(c.names.__getitem__, x.tolist())) for c, x in zip((first, second), ids)]
    cells = []
    i = j = 0
    for p, q in zip(*stops):
        a = names[0][i] if p - i == 1 else ",".join(names[0][i:p])
        b = names[1][j] if q - j == 1 else ",".join(names[1][j:q])
        cells.append(a + "|" + b)
        i, j = p, q
    start = 0
    for (place, a, b), n_groups, n_links in zip(kept, groups.tolist(), links.tolist()):
        out.n_a[place], out.n_b[place] = len(a), len(b)
        out.n_groups[place], out.n_links[place] = n_groups, n_links
        out.groups[place] = ";".join(cells[start : start + n_groups])
        start += n_groups
    text = np.repeat([row[0] for row in kept], links)
    return out._replace(text=text, a=ids[0][at[0]], b=ids[1][at[1]])


def planes(keys: np.ndarray, links: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(plane, keys with a bit in it) of pairs' documents and their numbers of links."""
    yield 0, keys
    more = links - 1
    for j in range(int(more.max(initial=0)).bit_length()):
        yield j + 1, keys[(more >> j) & 1 == 1]


def container(docs: np.ndarray) -> bytes:
    """Sorted document numbers of a chunk, in the shorter form."""
    if len(docs) < LIST_DOCS:
        return docs.astype("<u2").tobytes()
    bits = np.zeros(CHUNK_DOCS, np.uint8)
    bits[docs] = 1
    return np.packbits(bits).tobytes()


def documents(content: bytes) -> np.ndarray:
    """The inverse of :func:`container`."""
    if len(content) < CHUNK_DOCS // 8:
        return np.frombuffer(content, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(content, np.uint8)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """OR of postings, as sorted keys with their numbers of links."""
    keys = np.concatenate([keys for keys, _ in parts])
    links = np.concatenate([links for _, links in parts])
    order = np.argsort(keys, kind="stable")
    keys, links = keys[order], links[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[new], np.add.reduceat(links, new) if len(new) else links


STORED = (
    "chunk bigint, place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pair bigint, plane int, content binary"
)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def index(docs: DataFrame, first: str, second: str, id_column: str, text_column: str) -> DataFrame:
    """Documents with their counts (``pair`` is null) and containers (``pair`` is not), by chunk."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, {STORED}"
    target = _arrow(schema)

    def batch(n: int, **columns) -> pa.RecordBatch:
        made = [
            pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
            for f in target
        ]
        return pa.RecordBatch.from_arrays(made, schema=target)

    def containers(chunk: int, parts: list) -> Iterator[pa.RecordBatch]:
        for plane, keys in planes(*merged(parts)):
            pairs = keys >> np.uint64(16)
            place = (keys & np.uint64(CHUNK_DOCS - 1)).astype("<u2")
            starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(keys) else []
            bounds = np.r_[starts, len(keys)]
            for a in range(0, len(starts), 1 << 15):
                some = bounds[a : a + (1 << 15) + 1]
                if (np.diff(some) >= LIST_DOCS).any():
                    content = pa.array([container(place[x:y]) for x, y in zip(some, some[1:])], pa.binary())
                else:  # all lists: the places themselves are the buffer
                    offsets = ((some - some[0]) * 2).astype(np.int32)
                    content = pa.Array.from_buffers(
                        pa.binary(), len(some) - 1,
                        [None, pa.py_buffer(offsets), pa.py_buffer(place[some[0] : some[-1]].tobytes())],
                    )
                n = len(some) - 1
                pair = pairs[some[:-1]].astype(np.int64)
                yield batch(n, chunk=[chunk] * n, pair=pair, plane=[plane] * n, content=content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_bpe(first), piece_bpe(second)
        part, chunk, place, size, parts = TaskContext.get().partitionId(), 0, 0, 0, []
        for rows in batches:
            texts = rows.column(1).to_pylist()
            sizes = [b"" if text is None else text.encode() for text in texts]
            for a, b in [
                (start, min(start + CHUNK_DOCS, stop))
                for first_row, stop in blocks(sizes, BLOCK_BYTES)
                for start in range(first_row, stop, CHUNK_DOCS)
            ]:
                here = sum(map(len, sizes[a:b]))
                if place and (place + b - a > CHUNK_DOCS or size + here > CHUNK_BYTES):
                    yield from containers((part << 32) + chunk, parts)
                    chunk, place, size, parts = chunk + 1, 0, 0, []
                found = align(texts[a:b], one, two)
                n = b - a
                groups = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found.groups]
                yield batch(
                    n, id=rows.column(0).slice(a, n).cast(target.field("id").type),
                    chunk=[(part << 32) + chunk] * n, place=range(place, place + n), n_a=found.n_a, n_b=found.n_b,
                    n_groups=found.n_groups, n_links=found.n_links, groups_sha256=groups,
                )
                keys = (found.a.astype(np.uint64) << np.uint64(ID_BITS + 16)) | (
                    found.b.astype(np.uint64) << np.uint64(16)
                ) | (found.text + place).astype(np.uint64)
                parts.append(np.unique(keys, return_counts=True))
                place, size = place + n, size + here
        if parts:
            yield from containers((part << 32) + chunk, parts)

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, schema)


def _bits() -> Column:
    """Number of documents in a container."""
    as_bits = F.octet_length("content") == CHUNK_DOCS // 8
    listed = F.shiftright(F.octet_length("content"), 1).cast("bigint")
    return F.when(as_bits, F.bitmap_count("content")).otherwise(listed)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, n_docs, best): documents that hold a pair, and whether no other pair of its id has more."""
    counts = postings.where("plane = 0").groupBy("pair").agg(F.sum(_bits()).alias("n_docs"))
    counts = durable(counts.withColumn("a", F.shiftright("pair", ID_BITS)))
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    best = (F.col("n_docs") == F.col("highest")).cast("bigint").alias("best")
    return counts.join(apart(highest, "a"), "a").select("pair", "n_docs", best)


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, place, n_best, count_sum) of the documents that hold any pair."""
    schema = "chunk bigint, place int, n_best bigint, count_sum bigint"
    target = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, 0), np.int64)

        def out() -> pa.RecordBatch:
            some = np.flatnonzero(sums[1])
            columns = [np.full(len(some), now), some.astype(np.int32), sums[0, some], sums[1, some]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, target)], schema=target
            )

        for batch in batches:
            chunk = batch.column(0).to_numpy()
            links = np.int64(1) << np.maximum(batch.column(1).to_numpy().astype(np.int64) - 1, 0)
            contents = batch.column(2).to_pylist()
            worth = np.stack([links * batch.column(k).to_numpy() for k in (4, 3)])
            cuts = np.r_[0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, len(chunk)]
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                if chunk[a] != now:
                    if now is not None:
                        yield out()
                    now, sums = chunk[a], np.zeros((2, CHUNK_DOCS), np.int64)
                places = [documents(content) for content in contents[a:b]]
                size = [len(x) for x in places]
                places = np.concatenate(places)
                for k in range(2):
                    np.add.at(sums[k], places, np.repeat(worth[k, a:b], size))
        if now is not None:
            yield out()

    met = postings.select("chunk", "pair", "plane", "content").join(counts, "pair")
    dealt = met.repartition("chunk").sortWithinPartitions("chunk")
    return dealt.select("chunk", "plane", "content", "n_docs", "best").mapInArrow(run, schema)


def align_documents(
    docs: DataFrame, first: str, second: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: its tokens, groups and links, and what its links' pairs count.

    ``first`` is the path of a byte-level BPE vocabulary, ``second`` that of a SentencePiece model.
    """
    share_package(docs.sparkSession)
    stored = durable(index(docs, first, second, id_column, text_column))
    postings = stored.where("pair IS NOT NULL")
    found = scores(postings, pair_counts(postings))
    rows = stored.where("pair IS NULL").drop("pair", "plane", "content")
    met = rows.join(found, ["chunk", "place"], "left")
    return met.select(
        F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )


def pair_table(docs: DataFrame, first: str, second: str, text_column: str = "text") -> DataFrame:
    """(a, b, n_docs, n_links) of every pair of linked ids, from the planes of the index."""
    share_package(docs.sparkSession)
    plain = docs.select(F.lit(0).alias("id"), F.col(text_column).alias("text"))
    stored = durable(index(plain, first, second, "id", "text").where("pair IS NOT NULL"))
    bits = _bits()
    worth = F.expr("shiftleft(1L, greatest(plane - 1, 0))")
    return stored.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, bits).otherwise(0)).alias("n_docs"),
        F.sum(bits * worth).alias("n_links"),
    ).select(
        F.shiftright("pair", ID_BITS).cast("int").alias("a"),
        F.expr(f"CAST(pair & {(1 << ID_BITS) - 1} AS INT)").alias("b"), "n_docs", "n_links",
    )
