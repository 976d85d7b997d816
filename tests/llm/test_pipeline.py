"""The pipeline's stages, each against a plain computation on its own input."""

from __future__ import annotations

import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm import mixing
from riskloom.llm.queries import QUERIES, vocabulary
from riskloom.session import durable
from tests.llm.test_forest_dedup import brute_force
from tests.llm.test_pii import expected


@pytest.fixture(scope="module")
def steps(spark, folder):
    """Input and result of each stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = durable(stage(spark, docs, folder))
        out[name] = (docs, result)
        docs = result
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(steps):
    assert list(steps) == ["language_id", "minhash_near_dedup", "pii", "source_mixing", "bpe"]
    for name, (before, after) in steps.items():
        if name != "bpe":
            assert after.columns == before.columns


def test_language(spark, folder, steps):
    before, after = map(rows, steps["language_id"])
    predicted = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op3_language"](spark, folder).collect()}
    assert after == {i: r for i, r in before.items() if predicted[i] != "und"}
    assert all(i in after for i, r in before.items() if re.search("[a-z]", r["text"] or ""))


def test_one_of_each_group(steps):
    before, after = map(rows, steps["minhash_near_dedup"])
    groups = brute_force([(i, r["text"]) for i, r in before.items()], 5)
    assert after == {i: r for i, r in before.items() if groups[i][2]}
    assert len(after) < len(before)


def test_personal_data(steps):
    before, after = map(rows, steps["pii"])
    assert set(before) == set(after)
    changed = 0
    for i, r in after.items():
        spans = expected(before[i]["text"])
        if not spans:
            assert r == before[i]
            continue
        changed += 1
        assert r["n_chars"] == len(r["text"])
        for _, start, end in spans:
            assert before[i]["text"][start:end] not in r["text"]
    assert changed


def test_mixing(steps):
    before, after = steps["source_mixing"]
    assert rows(before) == rows(after)
    order = sorted(mixing.places(before).collect(), key=lambda r: r["position"])
    assert [r["doc_id"] for r in after.collect()] == [r["doc_id"] for r in order]


def test_encoding(steps):
    before, after = map(rows, steps["bpe"])
    reference = Tokenizer.from_file(vocabulary())
    assert set(before) == set(after)
    for i, r in after.items():
        assert r["ids"] == reference.encode(before[i]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["ids"])


def test_run(spark, folder, steps):
    ran = corpus_pipeline.run(spark, folder)
    assert rows(ran) == rows(steps["bpe"][1])


def test_edges(spark, folder, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, position int, ids string"
    data = [
        (1, "mail me at a.b@c.de please, it is a text", "en", "a", 40, 1, "x"),
        (1, "mail me at a.b@c.de please, it is a text", "en", "a", 40, 1, "x"),
        (2, "MAIL me at a.b@c.de please, it is a text", "en", None, 40, None, None),
        (3, None, "en", "b", None, None, None),
        (4, "", None, "b", 0, None, None),
        (5, "12 34", None, "b", 5, None, None),
        (None, "eine andere sprache " * 4000, "de", "b", None, None, None),
        (7, "noch ein text in dieser sprache", "de", "b", 31, None, None),
    ]
    for n, part in (("some", data), ("none", [])):
        docs = spark.createDataFrame(part, schema)
        docs.write.parquet(str(tmp_path / n / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / n)).collect()
        assert sorted(r["doc_id"] or 0 for r in out) == ([0, 1, 7] if part else [])


def test_mixed_order_reaches_the_result(spark, folder, steps):
    before, after = steps["bpe"]
    want = {r["doc_id"]: r["position"] for r in mixing.places(before).collect()}
    assert {r["doc_id"]: r["position"] for r in after.collect()} == want
    # Whatever order the documents are read in, the result is in the mixed order.
    shuffled = before.repartition(7, "text").sortWithinPartitions("n_chars")
    out = corpus_pipeline.STAGES[-1][1](spark, shuffled, folder).collect()
    assert [r["doc_id"] for r in out] == sorted(want, key=want.get)
    assert [r["position"] for r in out] == sorted(want.values())


def test_the_language_decides_what_follows(spark, folder):
    """Texts in no learned language go, and the told language stands beside the tokens."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    german = docs.where("lang = 'de'").orderBy("doc_id").first()
    odd = {
        9001: (german["text"], None),  # told
        9002: (german["text"] + " und der die", "en"),  # labelled wrongly
        9003: ("это русский текст и он довольно длинный", "en"),
        9004: ("xq zzk wvv qqx pfx", "en"),
        9005: ("if (x==1) return foo(bar);", None),
    }
    rows = [(*(odd[i][0] if c == "text" else odd[i][1] if c == "lang" else i if c == "doc_id" else german[c]
               for c in docs.columns),) for i in odd]
    before = docs.union(spark.createDataFrame(rows, docs.schema))
    known = durable(corpus_pipeline.STAGES[0][1](spark, before, folder))
    after = {r["doc_id"]: r["lang"] for r in known.collect()}
    assert [after.get(i) for i in odd] == ["de", "de", None, None, None]
    encoded = corpus_pipeline.STAGES[-1][1](spark, known, folder)
    assert {r["doc_id"]: r["lang"] for r in encoded.collect()} == after


def test_texts_move_instead_of_tokens(spark, steps):
    """Nothing moves the tokens once they are made: they take more room than the texts."""
    before, _ = steps["bpe"]
    result = corpus_pipeline.STAGES[-1][1](spark, before, None)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and plan.count("MapInArrow") == 1
