"""Byte-level BPE with content-defined chunk reuse.

A text is cut into chunks where a rolling hash of the bytes before a blank meets a mask, so equal
passages of different documents are cut alike, wherever they lie. A worker encodes a chunk once
and reuses it for all documents it sees. Chunk joins are then repaired: the words around a join
are encoded again as one string; if the result differs from what the two chunks gave, the two
chunks are joined and encoded as one, until all joins agree.

Edge cases: a null or empty text has no tokens and decodes to the empty string; a text without
a blank is one chunk; repeated rows give repeated results; an empty table gives an empty result.
Columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from riskloom.llm.common import arrow_map, ranges

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A chunk ends at a blank with probability 1 / CHUNK_BLANKS: about a kilobyte of prose.
CHUNK_BLANKS = 160
# Bytes hashed before a blank.
WINDOW = 8
# Memory of one worker's chunk store, and the longest chunk that is worth keeping.
STORE_BYTES = 48 << 20
KEEP_BYTES = 16384

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160]] = True


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkEncoder:
    """Encoder of one worker. ``path`` is a vocabulary file with byte-level letters."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in content["added_tokens"] if x["special"]}
        ranks = {
            bytes(letters[c] for c in token): rank
            for token, rank in content["model"]["vocab"].items()
            if token not in special
        }
        self.special = [token.encode() for token in special]
        self.codec = tiktoken.Encoding(
            "chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self.store: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.stored = 0
        self.joins: dict[bytes, bool] = {}

    def whole(self, text: bytes) -> np.ndarray:
        ids = self.codec.encode(text.decode(), allowed_special="all")
        return np.array(ids, np.uint32)

    def chunk(self, text: bytes) -> np.ndarray:
        found = self.store.get(text)
        if found is not None:
            self.store.move_to_end(text)
            return found
        ids = self.whole(text)
        if len(text) <= KEEP_BYTES:
            self.store[text] = ids
            self.stored += len(text) + ids.nbytes + 200
            while self.stored > STORE_BYTES:
                old, gone = self.store.popitem(last=False)
                self.stored -= len(old) + gone.nbytes + 200
        return ids

    def agrees(self, left: bytes, right: bytes) -> bool:
        """Whether the last word of ``left`` and the first of ``right`` encode alike apart."""
        tail = left[max(0, left.rfind(b" ")) :]
        stop = right.find(b" ", 1)
        head = right if stop < 0 else right[:stop]
        around = tail + b"\0\0" + head
        known = self.joins.get(around)
        if known is None:
            apart = np.concatenate([self.whole(tail), self.whole(head)])
            known = np.array_equal(self.whole(tail + head), apart)
            if len(self.joins) > 200_000:
                self.joins.clear()
            self.joins[around] = known
        return known

    def encode(self, text: bytes) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        chunks = cut(text)
        i = 0
        while i + 1 < len(chunks):
            # A word that began before its chunk can only be judged with the chunk before.
            whole_word = i == 0 or b" " in chunks[i]
            if whole_word and self.agrees(chunks[i], chunks[i + 1]):
                i += 1
            else:  # repair: the two are one chunk, and its join to the one before is new
                chunks[i : i + 2] = [chunks[i] + chunks[i + 1]]
                i = max(0, i - 1)
        return np.concatenate([self.chunk(piece) for piece in chunks])

    def decode(self, ids: np.ndarray) -> str:
        return self.codec.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


def cut(text: bytes) -> list[bytes]:
    """Chunks of ``text``: a cut may lie before a single blank between two words."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < 2 * WINDOW:
        return [text]
    blank = np.flatnonzero(raw[WINDOW:-1] == 32) + WINDOW
    blank = blank[~_BLANK[raw[blank - 1]] & ~_BLANK[raw[blank + 1]]]
    value = np.zeros(len(blank), np.uint32)
    for k in range(WINDOW, 0, -1):
        value = value * np.uint32(0x01000193) ^ raw[blank - k]
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(12)
    places = blank[value % CHUNK_BLANKS == 0].tolist()
    return [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder: its chunk store lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encode_documents(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    carried: list[str] | None = None,
) -> DataFrame:
    """(id, ids array<int>): the tokens of every whole text. ``vocabulary`` is a file's path.

    Rows stay in order; the columns named in ``carried`` come after the tokens, as they are. A worker
    holds the texts and tokens of about BLOCK_BYTES of text at a time, or of one longer text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [id_column, *(carried or [])]
    kinds = [docs.schema[name].dataType.simpleString() for name in names]
    aliases = ["id", *[f"_{i}" for i in range(len(names) - 1)]]
    pairs = docs.selectExpr(
        *[f"`{name}` AS {alias}" for name, alias in zip(names, aliases)],
        f"CAST(`{text_column}` AS BINARY) AS text",
    )
    schema = ", ".join(f"{alias} {kind}" for alias, kind in zip(aliases, kinds)) + ", ids array<int>"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(names))), 0).to_pylist()
            for a, b in ranges(sizes):
                part = batch.slice(a, b - a)
                ids = [codec.encode(text or b"") for text in part.column(len(names)).to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = np.concatenate(ids).view(np.int32)
                tokens = pa.ListArray.from_arrays(offsets, values, type=target.field("ids").type)
                kept = [part.column(i).cast(target.field(i).type) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, tokens], schema=target)

    encoded = pairs.mapInArrow(run, schema)
    renamed = [F.col(alias).alias(name) for name, alias in zip(names, aliases)]
    return encoded.select(renamed[0], "ids", *renamed[1:])


def decode_documents(
    encoded: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """(id, text): the inverse of :func:`encode_documents`. Null ids give the empty text."""

    def rows(batch):
        codec = encoder(vocabulary)
        return {
            "id": batch["id"],
            "text": [codec.decode(np.array(ids or [], np.uint32)) for ids in batch["ids"]],
        }

    kind = encoded.schema[id_column].dataType.simpleString()
    pairs = encoded.selectExpr(f"`{id_column}` AS id", f"`{ids_column}` AS ids")
    return arrow_map(pairs, rows, f"id {kind}, text string").withColumnRenamed("id", id_column)


def round_trip_digests(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode without moving the tokens."""

    def rows(batch):
        codec = encoder(vocabulary)
        out = {"id": batch["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch["text"]:
            ids = codec.encode((text or "").encode())
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            decoded = codec.decode(ids).encode()
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
        return out

    kind = docs.schema[id_column].dataType.simpleString()
    pairs = docs.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text")
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return arrow_map(pairs, rows, schema).withColumnRenamed("id", id_column)
