"""Class-based language model: counts and base score by brute force, the model by its definition."""

from __future__ import annotations

import pickle
import random
import re
import zlib
from collections import Counter
from math import isclose, log10

import numpy as np
import pytest

from riskloom.llm import brown
from riskloom.llm.common import word_hashes
from riskloom.llm.queries import QUERIES
from pyspark.sql import functions as F

END = object()


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), END]


def base(rows):
    """rows: (id, text). id -> (held_out, n_tokens, n_known, train_tokens, base score)."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in words_of(t))
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = words_of(t)
        points = sum(log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        out[i] = (held[i], len(w), sum(counts[x] > 0 for x in w), total, points)
    return out


def compare(found, rows):
    want = base(rows)
    assert len(found) == len(rows)
    for r in found:
        held, n, known, total, points = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert isclose(r["base_score"], points, rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] <= 1e-9


@pytest.fixture(scope="module")
def scored(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    return folder, rows, QUERIES["op7_lm_score"](spark, folder).collect()


def test_query(scored):
    _, rows, found = scored
    compare(found, rows)
    held = [r for r in found if r["held_out"]]
    # The model is the better one on texts it has not seen.
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("held", [0, 300])
def test_words_that_are_joined_score_alike(spark, scored, monkeypatch, held):
    folder, rows, found = scored
    monkeypatch.setattr(brown, "HELD", held)
    joined = QUERIES["op7_lm_score"](spark, folder).collect()
    compare(joined, rows)
    score = {r["doc_id"]: r["score"] for r in found}
    assert all(isclose(r["score"], score[r["doc_id"]], rel_tol=1e-9) for r in joined)


@pytest.fixture(scope="module")
def trained(spark):
    draw = random.Random(1)
    nouns, verbs = [f"noun{i}" for i in range(12)], [f"verb{i}" for i in range(9)]
    texts = [
        " ".join(f"the {draw.choice(nouns)} {draw.choice(verbs)}" for _ in range(draw.randint(1, 9)))
        for _ in range(300)
    ]
    texts += [f"odd{i} noun1" for i in range(20)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = brown.word_counts(docs)
    words, classes = brown.trained(docs, counts)
    return texts, docs, counts, {r["word"]: (r["c"], r["cls"]) for r in words.collect()}, classes


def hashed(word):
    return int(word_hashes([word.encode()])[0].view(np.int64)[0])


def test_exchange_finds_word_classes(trained):
    _, _, _, words, _ = trained

    pairs = np.zeros((6, 6))
    for a, b in ((0, 2), (0, 3), (1, 2), (1, 3), (2, 4), (3, 4), (4, 0), (4, 1)):
        pairs[a, b] = 10
    of = brown.exchange(pairs, 5, 3)
    assert of[0] == of[1] and of[2] == of[3] and len({of[0], of[2], of[4]}) == 3
    before = brown.likelihood(pairs)
    member = np.eye(len(set(of)))[np.unique(of, return_inverse=True)[1]]
    assert brown.likelihood(member.T @ pairs @ member) <= before + 1e-9
    assert words[hashed("noun1")][1] != words[hashed("the")][1]
    assert words[hashed("odd1")] == (1, None)


def definition(joint, right, left, place):
    """The likelihood with the word's neighbours counted in one class."""
    out = joint.copy()
    out[place] += right
    out[:, place] += left
    return brown.likelihood(out)


def test_other_words_join_the_class_of_most_gain(trained):
    texts, docs, counts, _, _ = trained
    words = {r["word"]: r["cls"] for r in brown.trained(docs, counts, 12, 4)[0].collect()}
    top = brown.clustered_words(counts, 12)
    assert len(top.words) == 12
    pairs = brown.symbol_pairs(docs, top)
    of = brown.exchange(pairs, 12, 4)
    member = np.eye(6)[of]
    joint = member.T @ pairs @ member
    seed = dict(zip(top.words.view(np.int64).tolist(), of[top.symbols].tolist()))
    seen = Counter(w for t in texts for w in words_of(t)[:-1])
    others = [w for w, c in seen.items() if c > 1 and hashed(w) not in seed]
    assert others and all(words[w] == c for w, c in seed.items())
    for word in others:
        right, left = np.zeros(6), np.zeros(6)
        for text in texts:
            row = [END, *words_of(text)]
            place = [4 if w is END else seed.get(hashed(w), 5) for w in row]
            for i, w in enumerate(row):
                if w == word:
                    left[place[i - 1]] += 1
                    right[place[i + 1]] += 1
        gain = [definition(joint, right, left, c) for c in range(4)]
        assert gain[words[hashed(word)]] >= max(gain) - 1e-6


def test_class_does_not_depend_on_other_words(spark, trained):
    texts, docs, counts, words, _ = trained
    # Words that occur rarely, in texts of their own.
    more = docs.union(spark.createDataFrame([(f"new{i} new{i}",) for i in range(3000)], "text string"))
    again = {r["word"]: r["cls"] for r in brown.trained(more, brown.word_counts(more))[0].collect()}
    assert {again[hashed(f"noun{i}")] for i in range(12)}.isdisjoint({again[hashed(f"verb{i}")] for i in range(9)})


@pytest.fixture(scope="module")
def model(spark, trained):
    texts, docs, _, words, classes = trained
    k = classes + 2
    size, mass = np.zeros(k), np.zeros(k)
    for c, cls in words.values():
        size[k - 1 if cls is None else cls] += 1
        mass[k - 1 if cls is None else cls] += c
    joint = np.zeros((k, k))

    def classes_of(text):
        found = [words.get(hashed(w), (0, None))[1] for w in words_of(text)[:-1]]
        return [k - 2, *(k - 1 if cls is None else cls for cls in found), k - 2]

    for text in texts:
        row = classes_of(text)
        np.add.at(joint, (row[:-1], row[1:]), 1)
    return brown.fitted(joint, size, mass, None), classes_of, joint


def test_probabilities_sum_to_one(trained, model):
    _, _, _, words, classes = trained
    fit, k = model[0], classes + 2
    # All words, one for those never seen, and the end.
    cls = np.array([*(k - 1 if c is None else c for _, c in words.values()), k - 1, k - 2])
    counts = np.array([*(c for c, _ in words.values()), 0])
    emission = np.r_[np.log10(counts + 1.0), 0.0] - fit.weight[cls]
    for before in set(cls.tolist()):
        assert isclose((10 ** (fit.transitions[before, cls] + emission)).sum(), 1, rel_tol=1e-9)


def test_score_is_the_models(spark, trained, model):
    texts, docs, _, words, classes = trained
    fit, classes_of, joint = model
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    held = [i for i in range(10_000, 11_000) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    new = [texts[0], "the NOUN1 never seen verb1 odd3", None]
    rows = [*zip(ids, texts), *zip(held, new)]
    found = brown.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    score = {r["doc_id"]: r["score"] for r in found}
    for i, text in rows:
        cls = classes_of(text)
        total = sum(fit.transitions[a, b] - fit.weight[b] for a, b in zip(cls, cls[1:]))
        total += sum(log10(words.get(hashed(w), (0, None))[0] + 1) for w in words_of(text)[:-1])
        assert isclose(score[i], total, rel_tol=1e-9)


def test_edges(spark):
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A a É é"), (5, long), (None, "a b"), (9, "held out words"), (11, "x")]
    assert zlib.crc32(b"9") % 7 == 2 or any(zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows if i)
    data = [(i, t, 1, "y") for i, t in rows]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, row int, words string")
    compare(brown.score(docs).collect(), rows)
    twice = brown.score(docs.union(docs)).collect()
    assert len(twice) == 2 * len(rows)
    assert len({(r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 9)) for r in twice}) == len(rows)
    assert brown.score(docs.limit(0)).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    only = docs.where(F.col("doc_id").isin(-1)).union(
        spark.createDataFrame([(held[0], "a b", 1, ""), (held[1], None, 1, "")], docs.schema)
    )
    compare(brown.score(only).collect(), [(held[0], "a b"), (held[1], None)])


@pytest.mark.parametrize("listed", [1, 2, 3, 1000])
def test_places_of_listed_words(listed):
    """The table by first bits finds what a binary search does, for the least and greatest hashes too."""
    draw = np.random.default_rng(listed)
    edges = np.array([0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 2, (1 << 64) - 1], np.uint64)
    words = np.unique(draw.integers(0, 1 << 64, listed, dtype=np.uint64))
    if listed > 3:
        words = np.unique(np.r_[words, edges])
    lexicon = brown.Lexicon(words, np.arange(1, len(words) + 1), np.arange(len(words)), 5000, 5001)
    asked = np.r_[edges, words, words + np.uint64(1), draw.integers(0, 1 << 64, 500, dtype=np.uint64)]
    assert np.array_equal(lexicon.places(asked), np.searchsorted(words, asked))
    again = pickle.loads(pickle.dumps(lexicon))
    assert again._starts is None
    assert all(np.array_equal(x, y) for x, y in zip(again.look_up(asked), lexicon.look_up(asked)))


@pytest.mark.parametrize("most", [1 << 6, 1 << 21, 1 << 31])
def test_sorted_pairs(most):
    """Pairs of texts as one number, and where they are too wide for it."""
    draw = np.random.default_rng(4)
    text = draw.integers(0, 30, 4000)
    pair = draw.integers(0, most, 4000) << 32 | draw.integers(0, most, 4000)
    order = np.lexsort((pair, text))
    p, h = brown.sorted_pairs(pair, text)
    assert np.array_equal(p, pair[order]) and np.array_equal(h, text[order])


def test_classes_of_many_words():
    """Gains of many words at once choose what those of each word do."""
    draw = np.random.default_rng(6)
    k = 12
    joint = draw.integers(0, 400, (k, k)) * (draw.random((k, k)) < 0.7).astype(float)
    table = draw.integers(1, 9, (600, 2 * k)) * (draw.random((600, 2 * k)) < 0.2).astype(float)
    table[5] = 0
    each = [np.argmax(brown.gains(joint, x[:k], x[k:], 0.0)[: k - 2]) for x in table]
    assert np.array_equal(brown.best_classes(joint, table, k - 2), each)
