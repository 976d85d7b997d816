"""Personal data: fixed patterns, and information-theoretic sanitisation of revealing terms.

All of it is DataFrame expressions. Positions of matches follow from splitting a text at them:
the lengths of the pieces and of the matches add up to the starts.

Beside the patterns' own spans, words in the documents of a protected entity (an address or number found
by a pattern) may give it away. The corpus tells how strongly. Equal texts are one document; with N
documents, n(e) and n(t) that hold entity and term, and n(e, t) that hold both, the information that
the term discloses is PMI = log2(N n(e, t) / (n(e) n(t))), and the entity's own information, which PMI cannot
exceed, is IC = -log2(n(e) / N). A term that meets its entity in at least SUPPORT documents is generalised
from PMI / IC >= GENERALISE on and removed from REMOVE on, wherever it stands in the documents that hold
the entity, however far from it. Terms are runs of three or more letters and digits outside the patterns' spans.
An entity that is in every document has no information of its own, and no term reveals it.

Pairs of entity and term are counted only where they can reach SUPPORT and GENERALISE: n(e, t) is at
most n(e) and n(t), so the entity needs SUPPORT documents, and n(t) lies between SUPPORT and
N^(1 - GENERALISE) n(e)^GENERALISE. That loses no term.

Edge cases: a null text has no spans and stays null; texts of any length are scanned whole, with
patterns that neither recurse nor rescan; documents without an id have base spans but no term spans;
repeated rows give repeated results; an empty table gives an empty result. Only the id and text are read.
"""

from __future__ import annotations

from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import durable

KINDS = ("email", "ip", "card", "phone")
# A run of address characters, or of digits, is tried from its first character or from the end of
# the match before it: from any later one it would fail alike. Possessive repetition is a loop.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# As many digits as a card has, or more.
LONG_NUMBER = r"[0-9](?:[\x20-]?+[0-9]){12,}+"
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
WORD = r"[\p{L}\p{N}]{3,}+"
SUPPORT = 3
GENERALISE = 0.7
REMOVE = 0.95

SPAN = "struct<start: int, end: int, value: string>"
SPANS = f"array<{SPAN}>"
NO_SPANS = f"CAST(array() AS {SPANS})"


def matches(text: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches with their places in code points, end exclusive."""
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("spans"))

    def add(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(values)),
        values,
        lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")),
    )
    return F.aggregate(pairs, begin, add, lambda done: done["spans"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda x: x.cast("int"))

    def weighed(x: Column, i: Column) -> Column:
        twice = x * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(
        F.transform(figures, weighed), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))
    )
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    count = F.length(digits(value))
    if kind == "card":
        # Only numbers of a card's length are summed up.
        return F.when(count.between(13, 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def may_hold(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    return text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of its spans (start, end, value); empty for a null text."""
    found = {}
    for kind in KINDS:
        check = partial(valid, kind)
        kept = F.filter(matches(text, F.lit(PATTERNS[kind])), lambda span: check(span["value"]))  # noqa: B023
        found[kind] = F.when(F.coalesce(may_hold(kind, text), F.lit(False)), kept).otherwise(
            F.expr(NO_SPANS)
        )
    return found


def entity(kind: str, value: Column) -> Column:
    """One name for all writings of an entity."""
    plain = digits(value) if kind in ("card", "phone") else F.lower(value)
    return F.concat(F.lit(f"{kind}:"), plain)


def entities() -> Column:
    """The distinct entities among the arrays of :func:`base_spans`."""

    def named(kind: str):
        return lambda span: entity(kind, span["value"])

    return F.array_distinct(F.concat(*[F.transform(kind, named(kind)) for kind in KINDS]))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, its matches of the patterns left out."""
    for kind, pattern in (PATTERNS | {"card": LONG_NUMBER}).items():
        text = F.when(may_hold(kind, text), F.regexp_replace(text, pattern, " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def text_key(text: Column) -> Column:
    """One value of 128 bits for equal texts; null for a missing one."""
    return F.unhex(F.md5(text))


def revealing_terms(
    docs: DataFrame,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """(key, terms, removed): by text, the terms that reveal an entity it holds.

    ``docs`` has (key, text) and the arrays of :func:`base_spans`.
    """
    held = docs.where("key IS NOT NULL")
    of_texts = held.select("key", F.explode(entities()).alias("entity")).distinct()
    holders = (
        of_texts.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    )
    # (key, entity, n_entity): every text's entities that are in enough texts.
    known = durable(of_texts.join(holders, "entity"))
    words = durable(
        held.groupBy("key").agg(F.first("text").alias("text")).select("key", terms_of(F.col("text")).alias("terms"))
    )
    total = words.agg(F.count("*").alias("n")).scalar()
    counts = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    # The most common entity sets how common a term can be at all.
    most = known.agg(F.max("n_entity").alias("n")).scalar()
    bound = F.pow(total, F.lit(1 - generalise)) * F.pow(most, F.lit(generalise))
    rare = counts.where((F.col("n_term") >= support) & (F.col("n_term") <= bound + 1))
    holding = words.join(known.select("key").distinct(), "key", "left_semi")
    candidates = holding.select("key", F.explode("terms").alias("term")).join(rare, "term")
    pmi = F.log2(F.col("together") * total / (F.col("n_entity") * F.col("n_term")))
    content = F.log2(total / F.col("n_entity"))
    judged = durable(
        candidates.join(known, "key")
        .where(
            F.col("n_term")
            <= F.pow(total, F.lit(1 - generalise)) * F.pow(F.col("n_entity"), F.lit(generalise)) + 1
        )
        .groupBy("entity", "term", "n_entity", "n_term")
        .agg(F.count("*").alias("together"))
        .where(F.col("together") >= support)
        .select("entity", "term", F.when(content > 0, F.try_divide(pmi, content)).alias("disclosed"))
        .where(F.col("disclosed") >= generalise)
    )
    # Terms that reveal any entity of a text, if they stand in it.
    return (
        known.select("key", "entity")
        .join(judged, "entity")
        .groupBy("key")
        .agg(
            F.array_sort(F.collect_set("term")).alias("terms"),
            F.collect_set(F.when(F.col("disclosed") >= remove, F.col("term"))).alias("removed"),
        )
        .join(words.withColumnRenamed("terms", "own"), "key")
        .select("key", F.array_intersect("terms", "own").alias("terms"), "removed")
        .where("size(terms) > 0")
    )


def with_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, id, text, email, ip, card, phone, term, removed): the input row and all its spans."""
    plain = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        text_key(F.col(text_column)).alias("key"),
    )
    spans = plain.withColumns(base_spans(F.col("text")))
    revealing = durable(revealing_terms(spans.drop("row", "id")))
    pattern = F.concat(
        F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])")
    )
    term = F.when(F.size("terms") > 0, matches(F.col("text"), pattern))
    # Only texts that may hold an entity can have revealing terms; the others need not move for the join.
    tests = [F.coalesce(may_hold(kind, F.col("text")), F.lit(False)) for kind in KINDS]
    may = reduce(or_, tests)
    none = {name: F.lit(None).cast("array<string>") for name in ("terms", "removed")}
    rest = plain.where(~may).withColumns(base_spans(F.col("text"))).withColumns(none)
    some = plain.where(may).withColumns(base_spans(F.col("text")))
    joined = some.join(revealing, "key", "left").unionByName(rest)
    return joined.withColumn("term", F.coalesce(term, F.expr(NO_SPANS))).drop("terms", "key")


def written(kind: str) -> Column:
    return F.transform(
        kind, lambda span: F.concat(F.lit(f"{kind}:"), span["start"], F.lit(":"), span["end"])
    )


def find_personal_data(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) for every document."""
    found = with_spans(docs, id_column, text_column)
    base = [written(kind) for kind in KINDS]
    return found.select(
        F.col("id").alias(id_column),
        *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.array_join(F.concat(*base), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*base, written("term")), ",").alias("spans"),
        F.size("term").cast("bigint").alias("n_term"),
    )


def sanitised(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with every span taken out of the text: data and general terms leave a mark in
    brackets, removed terms leave nothing. Spans that overlap are taken out as one."""
    found = with_spans(docs, id_column, text_column)

    def marked(kind: str) -> Column:
        mark = F.lit(f"[{kind.upper()}]")
        return F.transform(
            kind,
            lambda span: F.struct(
                span["start"].alias("start"),
                span["end"].alias("end"),
                (
                    F.when(
                        F.array_contains("removed", F.lower(span["value"])), F.lit("")
                    ).otherwise(mark)
                    if kind == "term"
                    else mark
                ).alias("mark"),
            ),
        )

    every = F.array_sort(F.concat(*[marked(kind) for kind in (*KINDS, "term")]))
    begin = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("parts"))

    def take(done: Column, span: Column) -> Column:
        gap = F.substring("text", done["at"] + 1, span["start"] - done["at"])
        return F.when(
            span["start"] >= done["at"],
            F.struct(
                span["end"].alias("at"),
                F.concat(done["parts"], F.array(gap, span["mark"])).alias("parts"),
            ),
        ).otherwise(
            F.struct(F.greatest(done["at"], span["end"]).alias("at"), done["parts"].alias("parts"))
        )

    def close(done: Column) -> Column:
        rest = F.substring("text", done["at"] + 1, F.length("text"))
        return F.array_join(F.concat(done["parts"], F.array(rest)), "")

    clean = F.when(
        F.col("text").isNotNull() & (F.size(every) > 0), F.aggregate(every, begin, take, close)
    ).otherwise(F.col("text"))
    columns = [
        clean.alias(name) if name == text_column else F.col("row")[name].alias(name)
        for name in docs.columns
    ]
    return found.select(*columns)
