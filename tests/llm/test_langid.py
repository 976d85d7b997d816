"""Language identification: held-out accuracy, the bundle's definition, and edge cases."""

from __future__ import annotations

import zlib

import numpy as np

from riskloom.llm import langid
from riskloom.llm.queries import QUERIES


def test_bundle_is_the_sum_of_bound_ngrams():
    profiles = langid.Profiles()
    text = "Abba, 12 abc!"
    letters = [0, *map(ord, "abba"), 0, *map(ord, "abc"), 0]
    assert langid.letter_codes(text).tolist() == letters
    total = np.zeros(langid.DIMENSIONS)
    for i in range(len(letters) - 2):
        vector = np.ones(langid.DIMENSIONS)
        for place, code in enumerate(reversed(letters[i : i + 3])):
            vector *= np.roll(profiles.letter(code), place)
        total += vector
    assert np.array_equal(profiles.bundle(text), total)
    assert set(np.unique(profiles.letter(97))) == {-1, 1}
    different = profiles.letter(97).astype(int) @ profiles.letter(98)
    assert abs(different) < 6 * np.sqrt(langid.DIMENSIONS)


def test_kept_grams_are_bounded(monkeypatch):
    text = "".join(chr(0x4E00 + i * 7 % 9000) for i in range(5000))
    whole = langid.Profiles().bundle(text)
    monkeypatch.setattr(langid, "KEPT_GRAMS", 64)
    profiles = langid.Profiles()
    assert np.array_equal(profiles.bundle(text), whole)
    assert len(profiles.slots) <= 64


def test_held_out_accuracy(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op3_language"](spark, folder).collect()
    assert len(rows) == len(truth)
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1
    held = [row for row in rows if row["held_out"]]
    right = sum(row["lang_pred"] == truth[row["doc_id"]] for row in held)
    assert right >= 0.99 * len(held) > 100


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, held_out string")


def test_edges(spark):
    rows = [(i, "the house and the garden " * 3, "en", "x") for i in range(20)]
    rows += [(20 + i, "das haus und der garten " * 3, "de", "x") for i in range(20)]
    odd = [None, "", "123 ... 456", "а", "x" * 200_000, "🙂", "the", "the house and the garden"]
    rows += [(100 + i, text, None, None) for i, text in enumerate(odd)]
    rows += [(None, "das haus", "de", None), (107, odd[7], None, None)]
    docs = frame(spark, rows)
    names, matrix = langid.fitted(langid.training_rows(docs))
    assert names == ["de", "en"]
    found = [tuple(r) for r in langid.predict(docs, names, matrix).collect()]
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in found}
    for i in (100, 101, 102, 105):
        assert by_id[i][2:] == ("und", 0.0)
    assert by_id[107][2] == "en" and by_id[107][3] > 0.9 and by_id[None][2] == "de"
    assert by_id[None][1] is False
    kept = langid.keep_known(docs, names, matrix)
    assert kept.schema == docs.schema
    assert kept.count() == len(rows) - 4


def test_nothing_to_learn(spark):
    docs = frame(spark, [(1, "text", None, None), (2, None, "en", None), (3, "12", "de", None)])
    names, matrix = langid.fitted(langid.training_rows(docs))
    found = langid.predict(docs, names, matrix).collect()
    assert [r["lang_pred"] for r in found] == ["und"] * 3
    empty = docs.limit(0)
    assert langid.predict(empty, *langid.fitted(langid.training_rows(empty))).count() == 0
