"""Personal data against a plain reading of the contract with Python's own patterns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from math import log2

import pytest

from riskloom.llm import pii
from riskloom.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def expected(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    figures = lambda m: re.sub("[^0-9]", "", m.group())
    checks = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": (CARD, lambda m: 13 <= len(figures(m)) <= 19 and luhn(figures(m))),
        "phone": (PHONE, lambda m: 9 <= len(figures(m)) <= 15),
    }
    return [
        (kind, m.start(), m.end())
        for kind, (pattern, good) in checks.items()
        for m in pattern.finditer(text)
        if good(m)
    ]


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


TEXTS = [
    None,
    "",
    " ",
    "no data here",
    "mail a.b+c@mail.example.com, or a@b or @b.c or a@b@c.de and x@y.z_w@v.u",
    "a@b.c.d..e f@g-.h é@ü.de ü.a@b.c 🙂 z@z.zz",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0255.0.00.1 1.2.3 1..2.3.4 999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004 1 2 3",
    "378282246310005 6011  000990139424 4111 1111 1111 1111 4111 1111 1111 1111",
    "+1 (386) 555-3733 +49 30 1234567890123 +1 2 ++12 345-678.901 + 4 +4(((((((((((8",
    "+123456789 12.34.56.78 +1 555.123.45.67.89",
    "a" * 50_000,
    "1" * 30_000 + " " + "1." * 20_000,
    "a@b" + ".c" * 30_000,
    "+1" + " (" * 30_000,
    "@." * 20_000 + "a@b.cd",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_edges(spark):
    rows = pii.find_personal_data(frame(spark, TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        spans = expected(TEXTS[row["doc_id"]])
        assert row["spans"] == joined(spans), TEXTS[row["doc_id"]][:80]
        assert row["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest()
        for kind in pii.KINDS:
            assert row[f"n_{kind}"] == sum(span[0] == kind for span in spans)


def test_random_texts(spark):
    random.seed(5)
    parts = ["@", ".", "+", "-", " ", "  ", "1", "25", "256", "4111", "a", "b.c", "é", "(", ")", "%", "0"]
    texts = ["".join(random.choices(parts, k=random.randint(1, 60))) for _ in range(1500)]
    for row in pii.find_personal_data(frame(spark, texts)).collect():
        assert row["spans"] == joined(expected(texts[row["doc_id"]]))


def test_query_on_the_test_tables(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_pii"](spark, folder).collect()
    assert len(rows) == len(texts)
    assert sum(row["n_email"] + row["n_phone"] for row in rows) > 0
    for row in rows:
        base = joined(expected(texts[row["doc_id"]]))
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert row["spans"] == base or row["spans"].startswith(f"{base},term:")


@pytest.fixture(scope="module")
def revealed(spark):
    """'Zebulon' stands beside one address only, 'hello' everywhere."""
    texts = [f"hello word{chr(97 + i)} Zebulon writes from zeb@mail.example.com today" for i in range(5)]
    texts = [t.replace("writes", "writes" if i % 2 else "wrote") for i, t in enumerate(texts)]
    texts += [f"hello writes wrote from today, plain text number {i}" for i in range(200)]
    texts += ["copied Quirinius q@mail.example.com"] * 6
    return frame(spark, texts)


def test_terms_that_reveal(revealed):
    rows = {r["doc_id"]: r for r in pii.find_personal_data(revealed).collect()}
    for i in range(5):
        assert rows[i]["n_term"] == 1 and ",term:12:19" in rows[i]["spans"]
    assert all(rows[i]["n_term"] == 0 for i in range(5, 211))  # copies prove nothing


def test_sanitised(revealed):
    texts = {r["doc_id"]: r["text"] for r in pii.sanitised(revealed).collect()}
    assert texts[1] == "hello wordb  writes from [EMAIL] today"
    assert texts[205] == "copied Quirinius [EMAIL]"
    kept = {r["doc_id"]: r["text"] for r in revealed.collect()}
    assert all(texts[i] == kept[i] for i in range(5, 205))


def test_overlaps_and_extra_columns(spark):
    rows = [
        (1, "x", 4, "call +1 555.123.45.67.89 now", "a"),
        (None, "y", None, "to u@1.2.3.4 or 4111 1111 1111 1111", "b"),
        (2, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, id string, n_email int, text string, term string")
    clean = {r["id"]: r for r in pii.sanitised(docs).collect()}
    assert clean["x"]["text"] == "call [PHONE] now" and clean["x"]["n_email"] == 4
    assert clean["y"]["text"] == "to [EMAIL] or [CARD]" and clean["y"]["term"] == "b"
    assert clean[None]["text"] is None
    assert pii.sanitised(docs).schema.names == docs.schema.names
    assert pii.find_personal_data(docs).count() == 3


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find_personal_data(empty).count() == 0
    assert pii.sanitised(empty).count() == 0


def test_no_python_in_the_plan(spark, folder):
    plan = QUERIES["op10_pii"](spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_entity_in_every_document(spark):
    texts = [f"Zebulon wrote{c} footer@mail.example.com" for c in "abcd"]
    for row in pii.find_personal_data(frame(spark, texts)).collect():
        assert row["n_email"] == 1 and row["n_term"] == 0


def test_documents_without_ids_are_counted(spark):
    rows = [(None, f"word{c} Zebulon zeb@mail.example.com") for c in "abc"]
    rows += [(i, f"plain text number {i}") for i in range(100)]
    schema = "doc_id bigint, text string"
    found = pii.find_personal_data(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 103
    assert [r["n_term"] for r in found if r["doc_id"] is None] == [1, 1, 1]
    assert all(r["n_term"] == 0 for r in found if r["doc_id"] is not None)
    # They count for the terms of a document with an id.
    rows.append((200, "wordd Zebulon zeb@mail.example.com"))
    found = {r["doc_id"]: r["n_term"] for r in pii.find_personal_data(spark.createDataFrame(rows, schema)).collect()}
    assert found[200] == 1


def revealing(texts: list[str | None]) -> dict[str, set[str]]:
    """Brute force: by text, the terms from whose documents one of its entities follows."""
    entities, terms = {}, {}
    for text in filter(None, set(texts)):
        spans = expected(text)
        entities[text] = {
            k + ":" + (re.sub("[^0-9]", "", text[a:b]) if k in ("card", "phone") else text[a:b].lower())
            for k, a, b in spans
        }
        rest = text
        for pattern in (EMAIL, IP, re.compile(r"[0-9]([\x20-]?[0-9]){12,}"), PHONE):
            rest = pattern.sub(" ", rest)
        terms[text] = set(re.findall(r"[^\W_]{3,}", rest.lower()))
    n = len(terms)
    with_entity, with_term, with_both = defaultdict(int), defaultdict(int), defaultdict(int)
    for text, words in terms.items():
        for e in entities[text]:
            with_entity[e] += 1
        for t in words:
            with_term[t] += 1
            for e in entities[text]:
                with_both[e, t] += 1
    found = defaultdict(set)
    for (e, t), both in with_both.items():
        content = log2(n / with_entity[e])
        pmi = log2(n * both / (with_entity[e] * with_term[t]))
        if both >= pii.SUPPORT and content > 0 and pmi / content >= pii.GENERALISE:
            for text in terms:
                if e in entities[text] and t in terms[text]:
                    found[text].add(t)
    return found


def test_a_term_far_from_its_entity(spark):
    filler = "the report of the day goes on and on as it did the day before; "
    texts = [f"Zebulon K4711 {filler * 10} note {c * 3} zeb@mail.example.com" for c in "abcdef"]
    texts += [f"{filler * 10} note number {i}" for i in range(100)]
    for row in pii.find_personal_data(frame(spark, texts)).collect():
        terms = [x for x in row["spans"].split(",") if x.startswith("term:")]
        assert terms == (["term:0:7", "term:8:13"] if row["doc_id"] < 6 else [])


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_against_brute_force(spark, seed):
    random.seed(seed)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(8)] + ["no7", "É\u0301t", "ab"]
    people = [f"p{i}@mail.example.com" for i in range(12)] + ["+1 555 123 4567", "10.0.0.1"]
    own = {p: random.sample(words, 2) for p in people}
    texts: list[str | None] = [None, "", " "]
    for _ in range(150):
        content = random.choices(words, k=random.randint(1, 25))
        for p in random.sample(people, random.choice([0, 0, 1, 1, 2])):
            content += [f"x {p} x"] + [w for w in own[p] if random.random() < 0.8]
        random.shuffle(content)
        texts += [" ".join(content)] * random.choice([1, 1, 1, 5])
    want = revealing(texts)
    assert sum(map(len, want.values())) > 20
    for row in pii.find_personal_data(frame(spark, texts)).collect():
        text = texts[row["doc_id"]] or ""
        got = [x.split(":") for x in row["spans"].split(",") if x.startswith("term:")]
        assert {text[int(a) : int(b)].lower() for _, a, b in got} == want.get(text, set())
