"""Language identification with hyperdimensional profiles.

Each letter has a random vector of DIMENSIONS signs. The vector of an n-gram binds its letters:
the product of the letters' vectors, each rotated by its place in the n-gram. A text's vector
bundles (sums) those of all its n-grams, a language's prototype those of all its training texts.
A text gets the language whose prototype has the largest cosine with it.

Letters are the alphabetic characters, in lower case; every run of other characters counts as one
gap. Letter vectors follow from the code point alone, so no alphabet is learned or shipped.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is every text where
nothing could be learned. Of equal cosines the first language in order wins. Rows without a
language, or with a null id, do not train, a null id being in no fold. Repeated rows count as
often as they occur. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, fold, mix64

DIMENSIONS = 1024
GRAM = 3
FOLDS = 5
UNDETERMINED = "und"
# n-gram vectors that a worker keeps (1 KB each), before it starts anew.
KEPT_GRAMS = 40_000
# Cosines of unrelated vectors have a mean of 0 and a deviation of DIMENSIONS ** -0.5; three of those are chance.
CHANCE = 3 / DIMENSIONS**0.5
# Prototypes are sent to all tasks: DIMENSIONS numbers for each language.
MOST_LANGUAGES = 10_000

_BITS = 21  # of a code point


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, runs of anything else as one 0, with 0 at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letter_table()[codes], codes, 0).astype(np.int64)
    codes = np.concatenate([[0], codes, [0]])
    return codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]


_TABLES: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _TABLES["letters"]


class Profiles:
    """n-gram vectors of one worker, made when first needed."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.matrix = np.zeros((1024, DIMENSIONS), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            lanes = np.arange(DIMENSIONS // 64, dtype=np.uint64)
            seed = np.uint64((code + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            words = mix64(mix64(lanes + np.uint64(1)) ^ seed)
            self.letters[code] = np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1
        return self.letters[code]

    def slot(self, gram: int) -> int:
        """Row of the n-gram's vector: letters bound after rotation by their places."""
        found = self.slots.get(gram)
        if found is None:
            vector = np.ones(DIMENSIONS, np.int8)
            for place in range(GRAM):
                code = gram >> (_BITS * place) & ((1 << _BITS) - 1)
                vector = vector * np.roll(self.letter(code), place)
            found = self.slots[gram] = len(self.slots)
            if found >= len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[found] = vector
        return found

    def bundle(self, text: str) -> np.ndarray | None:
        """The text's vector; None without a letter."""
        codes = letter_codes(text)
        if len(codes) < GRAM:
            return None
        grams = codes[:-2] << (2 * _BITS) | codes[1:-1] << _BITS | codes[2:]
        grams, counts = np.unique(grams, return_counts=True)
        total = np.zeros(DIMENSIONS, np.float32)
        for a in range(0, len(grams), KEPT_GRAMS // 2):
            if len(self.slots) > KEPT_GRAMS // 2:
                self.clear()
            slots = [self.slot(gram) for gram in grams[a : a + KEPT_GRAMS // 2].tolist()]
            part = counts[a : a + KEPT_GRAMS // 2].astype(np.float32)
            total += part @ self.matrix[slots].astype(np.float32)
        return total


_WORKER: list[Profiles] = []


def profiles() -> Profiles:
    if not _WORKER:
        _WORKER.append(Profiles())
    return _WORKER[0]


def prototypes(labelled: DataFrame) -> DataFrame:
    """(lang, place, value): the prototypes from (lang, text), summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vector = profiles().bundle(text)
                if vector is not None:
                    if lang not in made:
                        made[lang] = np.zeros(DIMENSIONS, np.int64)
                    made[lang] += vector.astype(np.int64)
        for lang, vector in made.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * DIMENSIONS, pa.string()),
                    pa.array(np.arange(DIMENSIONS, dtype=np.int32)),
                    pa.array(vector),
                ],
                names=["lang", "place", "value"],
            )

    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    parts = rows.mapInArrow(run, "lang string, place int, value bigint")
    return parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))


def fitted(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, scaled to length one."""
    found = prototypes(labelled)
    rows = found.limit(MOST_LANGUAGES * DIMENSIONS + 1).toArrow()
    if rows.num_rows > MOST_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; map rare ones to one label")
    names = sorted(set(rows.column("lang").to_pylist()))
    index = {name: i for i, name in enumerate(names)}
    matrix = np.zeros((len(names), DIMENSIONS))
    which = [index[name] for name in rows.column("lang").to_pylist()]
    matrix[which, rows.column("place").to_numpy()] = rows.column("value").to_numpy()
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return names, matrix / np.where(length > 0, length, 1)


def classify(text: str | None, names: list[str], matrix: np.ndarray) -> tuple[str, float]:
    """The language and its cosine, as a score from 0 to 1."""
    vector = profiles().bundle(text) if text and names else None
    if vector is None:
        return UNDETERMINED, 0.0
    length = float(np.linalg.norm(vector))
    cosines = matrix @ (vector / length if length else vector)
    best = int(np.argmax(cosines))
    return names[best], float(min(1.0, max(0.0, cosines[best])))


def training_rows(docs: DataFrame) -> DataFrame:
    """(lang, text) of the documents outside the held-out fold."""
    return docs.where(fold("doc_id", FOLDS) != 0).select("lang", "text")


def predict(
    docs: DataFrame, names: list[str], matrix: np.ndarray, id_column: str = "doc_id"
) -> DataFrame:
    """(id, held_out, lang_pred, score) for every document."""

    def rows(batch):
        found = [classify(text, names, matrix) for text in batch["text"]]
        return {
            "id": batch["id"],
            "held_out": batch["held_out"],
            "lang_pred": [lang for lang, _ in found],
            "score": [score for _, score in found],
        }

    held_out = F.coalesce(fold(id_column, FOLDS) == 0, F.lit(False)).alias("held_out")
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, lang_pred string, score double"
    inputs = docs.select(F.col(id_column).alias("id"), held_out, "text")
    return arrow_map(inputs, rows, schema).withColumnRenamed("id", id_column)


def keep_known(
    docs: DataFrame,
    names: list[str],
    matrix: np.ndarray,
    least: float = 0.0,
    lang_column: str | None = None,
) -> DataFrame:
    """The documents with a language, and a score of ``least`` or more; all columns stay.

    ``lang_column`` names a column that gets the predicted language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = [classify(text, names, matrix) for text in texts]
            if lang_column:
                place = batch.schema.get_field_index(lang_column)
                told = pa.array([lang for lang, _ in found], batch.schema.field(place).type)
                batch = batch.set_column(place, batch.schema.field(place), told)
            kept = [lang != UNDETERMINED and score >= least for lang, score in found]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
