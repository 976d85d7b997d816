"""Secret scan: fixed patterns, and a likelihood ratio of two character Markov models.

One model describes random strings, the other ordinary words and identifiers. Both are trained on
samples that the corpus labels itself: the values matched by the fixed patterns are random, all
other runs of key characters are ordinary, but for the long ones that mix letters and digits: those
may be either, so they have no label. Counts of character pairs are summed over all
documents; a model is a table of ALPHABET x ALPHABET counts, whatever the corpus's size.

The models judge every run of key characters outside the spans of the patterns, of any length and any
mix of characters. It is a further span of kind ``markov`` if its log-likelihood ratio reaches
MIN_EVIDENCE in all, which outweighs how much rarer secrets are than words, also where each pair of
characters counts once only, as a line of one character is no secret, and MIN_RATIO per character, so that a
run is not found for being long.

Edge cases: a null or empty text has no spans; texts are scanned whole; repeated rows give repeated
results and count as often as they occur; an empty table gives an empty result; without any
random string in the corpus that model is uniform. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, as_utf8, blocks

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_WORDS = ("passw", "secret", "token", "api")

# Runs without a label, if they have both letters and digits.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
# Natural log units by which the random model must be the likelier one, per character and in all.
MIN_RATIO = 0.7
MIN_EVIDENCE = 14.0

BACK_OFF = 20

# Character 0 is the start or end of a run.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ALPHABET = len(LETTERS) + 1
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(1, ALPHABET)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                spans.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                spans.append((m.start(), 1, m.end()))
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def mixed_runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of long runs of key characters with both letters and digits."""
    return [
        m.span()
        for m in RUN.finditer(text)
        if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())
    ]


def random_value(text: str, span: tuple[int, int, int]) -> str:
    """The part of a matched span that was drawn at random."""
    start, kind, end = span
    piece = text[start:end]
    if kind == 0:
        return ASSIGN.fullmatch(piece).group(2)
    return piece[4:] if kind == 1 else piece


def pair_counts(runs: bytes) -> np.ndarray:
    codes = _CODE[np.frombuffer(runs, np.uint8)]
    return np.bincount(codes[:-1] * ALPHABET + codes[1:], minlength=ALPHABET * ALPHABET)


def train(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(is_random, pair, n): counts of character pairs of both labelled samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, ALPHABET * ALPHABET), np.int64)
        for batch in batches:
            texts = [text or "" for text in batch.column(0).to_pylist()]
            values = []
            for i, text in enumerate(texts):
                spans = base_spans(text) + [(a, -1, b) for a, b in mixed_runs(text)]
                if spans:
                    values += [random_value(text, span) for span in spans if span[1] >= 0]
                    at, rest = 0, []
                    for start, _, end in sorted(spans):
                        rest.append(text[at : max(at, start)])
                        at = max(at, end)
                    texts[i] = " ".join([*rest, text[at:]])
            total[1] += pair_counts(("\n" + "\n".join(values) + "\n").encode())
            raw = as_utf8(texts)
            for a, b in blocks(raw):
                total[0] += pair_counts(b"\n" + b"\n".join(raw[a:b]) + b"\n")
        total[:, 0] = 0  # two separators in a row say nothing
        which, pair = np.nonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"is_random": which.astype(np.int32), "pair": pair, "n": total[which, pair]}
        )

    parts = docs.select(F.col(text_column).alias("text")).mapInArrow(
        run, "is_random int, pair bigint, n bigint"
    )
    return parts.groupBy("is_random", "pair").agg(F.sum("n").alias("n"))


def log_ratio(counts: DataFrame) -> np.ndarray:
    """log P(b | a, random) - log P(b | a, ordinary) as a table.

    After a rare character a model falls back to how often characters occur at all: its pairs are
    smoothed with BACK_OFF observations spread like the single characters, those with one of each.
    ``counts`` has at most 2 * ALPHABET**2 rows.
    """
    table = np.zeros((2, ALPHABET * ALPHABET))
    for row in counts.collect():
        table[row["is_random"], row["pair"]] = row["n"]
    table = table.reshape(2, ALPHABET, ALPHABET)
    single = table.sum(axis=1, keepdims=True) + 1
    single /= single.sum(axis=2, keepdims=True)
    logs = np.log((table + BACK_OFF * single) / (table.sum(axis=2, keepdims=True) + BACK_OFF))
    return logs[1] - logs[0]


def random_runs(
    texts: list[bytes], ratio: np.ndarray, least: float, evidence: float
) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) in bytes of all runs of key characters that the random model explains better."""
    joined = b"\n".join(texts) + b"\n"
    codes = np.r_[0, _CODE[np.frombuffer(joined, np.uint8)]]
    inside = codes > 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    # From the step onto the first character to the step off the last one.
    steps = ratio[codes[:-1], codes[1:]]
    sums = np.r_[0.0, np.cumsum(np.where(inside[1:] | inside[:-1], steps, 0.0))]
    scores = sums[ends + 1] - sums[starts]
    begins = np.r_[0, np.cumsum([len(text) + 1 for text in texts])]
    for k in np.flatnonzero((scores >= evidence) & (scores >= least * (ends - starts))):
        start, end = int(starts[k]), int(ends[k])
        distinct = np.unique(codes[start : end + 1] * ALPHABET + codes[start + 1 : end + 2])
        if ratio.ravel()[distinct].sum() >= evidence:
            of = int(np.searchsorted(begins, start, "right")) - 1
            yield of, start - int(begins[of]), end - int(begins[of])


def markov_spans(
    texts: list[str], base: list[list], ratio: np.ndarray, least: float, evidence: float
) -> list[list]:
    """For each text the (start, kind number, end) of its random runs outside the spans of ``base``."""
    raw = as_utf8(texts)
    spans: list[list] = [[] for _ in texts]
    for a, b in blocks(raw):
        for i, start, end in random_runs(raw[a:b], ratio, least, evidence):
            i, text = a + i, raw[a + i]
            # Key characters are one byte each.
            at = start if text.isascii() else len(text[:start].decode())
            to = at + end - start
            if not any(first < to and at < last for first, _, last in base[i]):
                spans[i].append((at, 3, to))
    return spans


def scan(
    docs: DataFrame,
    ratio: np.ndarray,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: float = MIN_RATIO,
    evidence: float = MIN_EVIDENCE,
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) for every document."""

    def joined(spans: list) -> str:
        return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)

    def rows(batch):
        out = {name: [] for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        out |= {"id": batch["id"], "n_markov": []}
        texts = [text or "" for text in batch["text"]]
        bases = [base_spans(text) for text in texts]
        for base, more in zip(bases, markov_spans(texts, bases, ratio, least, evidence)):
            for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(span[1] == kind for span in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(sorted(base + more)))
            out["n_markov"].append(len(more))
        return out

    kind = docs.schema[id_column].dataType.simpleString()
    pairs = docs.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text")
    schema = (
        f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
        "spans string, n_markov bigint"
    )
    return arrow_map(pairs, rows, schema).withColumnRenamed("id", id_column)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"):
    """Train both models on ``docs`` and scan ``docs`` with them."""
    return scan(docs, log_ratio(train(docs, text_column)), id_column, text_column)
