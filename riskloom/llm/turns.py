"""Repair of conversation structure with block tables in the manner of the Four Russians.

A conversation's rows are kept, given another role or deleted, and rows are inserted, so that the
initials of the roles read ``(s?(ua)+)?`` at the least cost. Where a repair stands is one of four
states: nothing yet, after s, after u, after a. Going through the rows from the last to the first, the
least cost of the rest from each state is a vector of four numbers. Less its first number it is one
of a few dozen vectors, whatever the rows are, and a row is one of nine symbols. So for every vector
and every block of BLOCK symbols a table holds the vector before the block, the cost it adds and,
for each state before the block, the state after it and the edits in between, expanded from the end of
the block. Edits are those of least cost and, of these, the least in ASCII, as they are chosen from the front
by the costs of the rest.

How the work is spread: equal rows of a conversation (turn, role and text) become one with a count. All
are sorted into ranges, so a conversation of any size is spread over many tasks. A task cuts what it holds of a
conversation into chunks of CHUNK rows and finds by lookups, for every vector behind a chunk, the vector
before it and the states; only these few hundred bytes a chunk then go by conversation, once from the
end, which gives each chunk its vector, and once from the front, which gives it its state. Neither holds more
than one row at a time. Texts are only joined to rows that are kept.

Edge cases: a missing role or text is one space, hence no role of the pattern and a blank text. A
missing turn comes before all others. Rows of the same turn are in the order of role and a hash of
the text, so copies are adjacent. Rows without a conversation id are one conversation. A conversation
whose rows are all deleted has an empty repair. An empty table gives an empty result. Columns other than the
four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import apart, share_package
from riskloom.session import durable

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
# Symbols of a block of the table, and rows of a chunk.
BLOCK = 3
CHUNK = 4096

# States: nothing yet, after s, after u, after a. Which follows on u or a is given by the state.
STATES = range(4)
FOLLOWS = (2, 2, 3, 2)
ENDS = (True, False, False, True)
# Symbols: 0 has to go; 1 + 2 * initial + truncated for the initials s, u, a and all others; 9 is no row.
GONE, NO_ROW, SYMBOLS = 0, 9, 10
_AFTER = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})  # by initial: state before -> state after


def _with_inserts(costs: list[float]) -> tuple[float, ...]:
    """Least costs when rows may be inserted before going on."""
    out = list(costs)
    for _ in STATES:
        out = [min(out[q], INSERT + out[FOLLOWS[q]]) for q in STATES]
    return tuple(out)


def _options(symbol: int, q: int) -> list[tuple[str, float, int]]:
    """(edit, cost, state after) of a row in state ``q``, in the order of the edits' letters."""
    if symbol == NO_ROW:
        return [("", 0, q)]
    found = [("D", DELETE, q)]
    if symbol != GONE:
        initial, truncated = divmod(symbol - 1, 2)
        more = TRUNCATED * truncated
        if q in _AFTER[initial]:
            found.append(("K", KEEP + more, _AFTER[initial][q]))
        found.append(("R", REROLE + more, FOLLOWS[q]))
    return found


def _edits(symbol: int, q: int, before: tuple, after: tuple) -> tuple[str, int]:
    """The least of the cheapest edits from state ``q`` through a row, and the state after it."""
    letters = ""
    while True:
        options = _options(symbol, q)
        cheapest = [o for o in options if o[1] + after[o[2]] == before[q]]
        if cheapest and cheapest[0][0] in ("D", ""):
            return letters + cheapest[0][0], cheapest[0][2]
        if symbol != NO_ROW and before[q] == INSERT + before[FOLLOWS[q]]:
            letters, q = letters + "I", FOLLOWS[q]
            continue
        return letters + cheapest[0][0], cheapest[0][2]


class Tables(NamedTuple):
    """By vector after a block and block: vector before it, added cost, states after, edits."""

    vectors: np.ndarray  # (vectors, 4)
    before: np.ndarray  # (vectors, blocks)
    cost: np.ndarray  # (vectors, blocks)
    states: np.ndarray  # (vectors, blocks, 4)
    edits: np.ndarray  # (vectors, blocks, 4), strings


@lru_cache(maxsize=None)
def tables(block: int = BLOCK) -> Tables:
    """The tables of blocks of ``block`` symbols, made once per worker from those of one symbol."""
    end = _with_inserts([0 if stops else np.inf for stops in ENDS])
    known = {tuple(c - end[0] for c in end): 0}
    steps: dict[tuple[int, int], tuple] = {}
    queue = list(known)
    for after in queue:
        for symbol in range(SYMBOLS):
            costs = [min(c + after[s] for _, c, s in _options(symbol, q)) for q in STATES]
            before = _with_inserts(costs)
            normal = tuple(c - before[0] for c in before)
            if normal not in known:
                known[normal] = len(known)
                queue.append(normal)
            edits = [_edits(symbol, q, before, after) for q in STATES]
            steps[known[after], symbol] = (known[normal], before[0], edits)
    n = len(known)
    blocks = list(product(range(SYMBOLS), repeat=block))
    made = Tables(
        np.array(list(known), np.int64),
        np.zeros((n, len(blocks)), np.int16),
        np.zeros((n, len(blocks)), np.int64),
        np.zeros((n, len(blocks), 4), np.int8),
        np.empty((n, len(blocks), 4), object),
    )
    for v, (b, symbols) in product(range(n), enumerate(blocks)):
        behind, cost = [v], 0
        for symbol in reversed(symbols):  # expanded from its end, it can be traced from its front
            vector, added, _ = steps[behind[-1], symbol]
            behind.append(vector)
            cost += added
        made.before[v, b], made.cost[v, b] = behind[-1], cost
        for q in STATES:
            state, letters = q, ""
            for symbol, after in zip(symbols, reversed(behind[:-1])):
                part, state = steps[after, symbol][2][state]
                letters += part
            made.states[v, b, q], made.edits[v, b, q] = state, letters
    return made


def blocks_of(symbols: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The numbers of the blocks that ``symbols`` consists of, the last filled up with NO_ROW."""
    full = np.full(-(-len(symbols) // block) * block, NO_ROW, np.int64)
    full[: len(symbols)] = symbols
    return full.reshape(-1, block) @ (SYMBOLS ** np.arange(block - 1, -1, -1))


def summary(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every vector behind the rows: the vector before them, the cost, the states after them."""
    t, numbers = tables(), blocks_of(symbols)
    vector = np.arange(len(t.vectors))
    behind, cost = [], np.zeros(len(vector), np.int64)
    for b in numbers[::-1].tolist():
        behind.append(vector)
        cost += t.cost[vector, b]
        vector = t.before[vector, b]
    state = np.tile(np.arange(4), (len(vector), 1))
    for b, after in zip(numbers.tolist(), reversed(behind)):
        state = np.take_along_axis(t.states[after, b], state, axis=1)
    return vector, cost, state


def edits(symbols: np.ndarray, vector: int, state: int) -> str:
    """The edits of the rows, for the vector behind them and the state before them."""
    t, numbers = tables(), blocks_of(symbols).tolist()
    behind = []
    for b in reversed(numbers):
        behind.append(vector)
        vector = t.before[vector, b]
    found = []
    for b, after in zip(numbers, reversed(behind)):
        found.append(t.edits[after, b, state])
        state = t.states[after, b, state]
    return "".join(found)


def closing(state: int) -> int:
    """How many rows have to be inserted at the end."""
    return 0 if ENDS[state] else 1 + closing(FOLLOWS[state])


_BLANKS = " \t\n\x0b\x0c\r"


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with the faults of a test, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes full stops, exclamation and question marks out of it, 3 repeats
    it, 4 makes its role user. Missing values are read as one space; a missing turn remains one.
    """
    space = F.lit(" ")
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), space)
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = turns.select(
        "conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
        kind.alias("kind"),
    ).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.translate("text", ".!?", "")
    ).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")
    ).drop("copy")


def _conversation(name: str) -> Column:
    """A text that stands for the conversation and is never null."""
    return F.coalesce(F.concat(F.lit("c"), F.col(name).cast("string")), F.lit(""))


def _rows(turns: DataFrame) -> DataFrame:
    """(c, turn, role, text, same): same identifies conversation, role and text."""
    role, text = (F.coalesce(F.col(name), F.lit(" ")) for name in ("role", "text"))
    rows = turns.select(
        _conversation("conv_id").alias("c"), "turn", role.alias("role"), text.alias("text")
    )
    said = F.concat_ws(":", F.length("c"), F.length("role"), "c", "role", "text")
    return rows.withColumn("same", F.unhex(F.sha2(said, 256)))


def _judged(rows: DataFrame) -> DataFrame:
    """One row for equal ones, with their count and the first fault of the first of them."""
    said = F.rtrim("text", F.lit(_BLANKS))
    counted = rows.groupBy("c", "turn", "role", "same").agg(
        F.count("*").alias("n"),
        F.first(F.xxhash64("text")).alias("hash"),
        F.first(said == "").alias("blank"),
        F.first(~F.substring(said, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    counted = durable(counted)
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    firsts = counted.groupBy("same").agg(F.min(turn).alias("first"))
    met = counted.join(apart(firsts, "same"), "same")
    return met.withColumn("again", ~F.col("turn").eqNullSafe(F.col("first.turn"))).drop("first")


CHUNKS = (
    "c string, part int, chunk bigint, symbols binary, roles array<string>, same array<binary>, "
    "counts array<bigint>, before array<smallint>, cost array<bigint>, states binary, "
    "head string, tail string, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, deleted bigint"
)
_LEGAL = ("su", "ua", "au")


def _chunks(judged: DataFrame) -> DataFrame:
    """One row per chunk of a conversation, in the order of (part, chunk)."""
    target = _arrow(CHUNKS)
    order = ["c", F.col("turn").asc_nulls_first(), "role", "hash", "same"]
    ordered = judged.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ordered.select("c", "role", "same", "n", "blank", "truncated", "again")

    def one(part: int, chunk: int, rows: pa.RecordBatch) -> dict:
        c, roles, same, n, blank, truncated, again = (column.to_pylist() for column in rows.columns)
        initials = [role[:1] for role in roles]
        symbols = [
            GONE if b or a else 1 + 2 * ("sua".index(i) if i and i in "sua" else 3) + t
            for b, a, t, i in zip(blank, again, truncated, initials)
        ]
        pairs = sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:]))
        before, cost, states = summary(np.array(symbols))
        extra = [k - 1 for k in n]  # copies right after the first
        return {
            "c": c[0], "part": part, "chunk": chunk, "symbols": bytes(symbols), "roles": roles,
            "same": same, "counts": n, "before": before, "cost": cost,
            "states": states.astype(np.int8).tobytes(), "head": initials[0], "tail": initials[-1],
            "blank": sum(k for k, b in zip(n, blank) if b),
            "duplicate": sum(k - 1 + a for k, b, a in zip(n, blank, again) if not b),
            "truncated": sum(s > 0 and s % 2 == 0 for s in symbols),
            "illegal": pairs + sum(extra), "deleted": DELETE * sum(extra),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            c = batch.column(0)
            new = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(c)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                # What the next batch may go on with waits, unless it is a whole chunk.
                whole = b if b < len(c) else a + (b - a) // CHUNK * CHUNK
                for start in range(a, whole, CHUNK):
                    stop = min(start + CHUNK, whole)
                    out.append(one(part, chunk, batch.slice(start, stop - start)))
                    chunk += 1
            rest = batch.slice(whole) if whole < len(c) else None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if rest is not None:
            yield pa.RecordBatch.from_pylist([one(part, chunk, rest)], schema=target)

    return rows.mapInArrow(run, CHUNKS)


def _passed(chunks: DataFrame) -> DataFrame:
    """(c, part, chunk, vector, state, last, cost, crossing): both ways through the summaries.

    ``crossing`` is 1 where the last role of the chunk before and the first of this one may not meet.
    """
    backward = "c string, part int, chunk bigint, vector int, added bigint, last boolean, after binary, head string, tail string"
    forward = "c string, part int, chunk bigint, vector int, state int, last boolean, added bigint, crossing int"

    to_front, to_end = _arrow(backward), _arrow(forward)

    def from_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vector = None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                last = row["c"] != now
                now, vector = row["c"], 0 if last else vector
                # Every vector's first number is 0, so added costs sum up to the cost from the front.
                out.append((*(row[k] for k in ("c", "part", "chunk")), vector, row["cost"][vector], last,
                            row["states"][4 * vector : 4 * vector + 4], row["head"], row["tail"]))
                vector = row["before"][vector]
            yield _batch(out, to_front)

    def from_front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, tail = None, 0, ""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                new = row["c"] != now
                now, state = row["c"], 0 if new else state
                crossing = int(not new and tail + row["head"] not in _LEGAL)
                out.append((*(row[k] for k in ("c", "part", "chunk", "vector")), state, row["last"],
                            row["added"], crossing))
                state, tail = row["after"][state], row["tail"]
            yield _batch(out, to_end)

    place = [F.col("part"), F.col("chunk")]
    summaries = chunks.select("c", "part", "chunk", "before", "cost", "states", "head", "tail")
    down = summaries.repartition("c").sortWithinPartitions("c", *[x.desc() for x in place])
    behind = down.mapInArrow(from_end, backward)
    up = behind.repartition("c").sortWithinPartitions("c", *place)
    return up.mapInArrow(from_front, forward)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(target)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, target)], schema=target
    )


EDITED = "c string, part int, chunk bigint, audit string, place array<int>, role array<string>, same array<binary>"


def _edited(chunks: DataFrame, passed: DataFrame) -> DataFrame:
    """Per chunk the edits, and the rows of the repair; an inserted one has no ``same``."""
    target = _arrow(EDITED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                symbols = np.frombuffer(row["symbols"], np.int8)
                letters = edits(symbols, row["vector"], row["state"])
                state, i, audit, place, role, same = row["state"], 0, [], [], [], []
                for letter in letters:
                    audit.append(letter)
                    if letter == "K":
                        name = row["roles"][i]
                        state = _AFTER["sua".index(name[0])][state]
                    elif letter != "D":
                        state = FOLLOWS[state]
                        name = "assistant" if state == 3 else "user"
                    if letter != "D":
                        place.append(len(place))
                        role.append(name)
                        same.append(None if letter == "I" else row["same"][i])
                    if letter != "I":
                        audit.append("D" * (row["counts"][i] - 1))
                        i += 1
                while row["last"] and not ENDS[state]:
                    state = FOLLOWS[state]
                    audit.append("I")
                    place.append(len(place))
                    role.append("assistant" if state == 3 else "user")
                    same.append(None)
                out.append((row["c"], row["part"], row["chunk"], "".join(audit), place, role, same))
            yield _batch(out, target)

    needed = chunks.select("part", "chunk", "symbols", "roles", "same", "counts")
    met = needed.join(passed, ["part", "chunk"])
    return met.mapInArrow(run, EDITED)


def _texts_of(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines`` with their texts, which are empty where a row was inserted."""
    texts = rows.groupBy("same").agg(F.first("text").alias("text"))
    kept = lines.where("same IS NOT NULL").join(texts, "same").drop("same")
    added = lines.where("same IS NULL").drop("same").withColumn("text", F.lit(""))
    return kept.unionByName(added)


class Repair(NamedTuple):
    """What :func:`repair` found, all keyed by ``c``, which stands for the conversation."""

    rows: DataFrame  # (c, conv_id)
    faults: DataFrame  # (c, gaps, blank, duplicate, truncated, illegal, cost)
    edits: DataFrame  # (c, part, chunk, audit)
    turns: DataFrame  # (c, part, chunk, place, role, text)


def repair(turns: DataFrame) -> Repair:
    """Find and mend the faults of conversations (conv_id, turn, role, text)."""
    share_package(turns.sparkSession)
    rows = _rows(turns)
    judged = _judged(rows)
    chunks = durable(_chunks(judged))
    passed = durable(_passed(chunks))
    edited = durable(_edited(chunks, passed))
    spans = rows.groupBy("c").agg(
        F.max("turn").alias("high"), F.min("turn").alias("low"), F.countDistinct("turn").alias("n")
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0))
    counts = chunks.groupBy("c").agg(
        *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated", "illegal", "deleted")]
    )
    costs = passed.groupBy("c").agg(F.sum("added").alias("added"), F.sum("crossing").alias("crossing"))
    faults = (
        spans.select("c", gaps.alias("gaps"))
        .join(counts, "c")
        .join(costs, "c")
        .select(
            "c", "gaps", "blank", "duplicate", "truncated",
            (F.col("illegal") + F.col("crossing")).alias("illegal"),
            (F.col("added") + F.col("deleted")).alias("cost"),
        )
    )
    lines = edited.select(
        "c", "part", "chunk", F.explode(F.arrays_zip("place", "role", "same")).alias("x")
    ).select("c", "part", "chunk", "x.place", "x.role", "x.same")
    names = turns.select(_conversation("conv_id").alias("c"), "conv_id").distinct()
    return Repair(
        names, faults, edited.select("c", "part", "chunk", "audit"), _texts_of(rows, lines)
    )


def digests(found: Repair, every: DataFrame) -> DataFrame:
    """One row per conversation of ``every`` (conv_id): its faults, cost, audit and the hash of its repair.

    The hash is a chain over the whole repair; the lines of a conversation stream through one
    task in order, and one at a time is held.
    """

    schema = "c string, repaired_sha256 string"
    target = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain = None, None
        for batch in batches:
            out = []
            for c, line in zip(*(column.to_pylist() for column in batch.columns)):
                if c != now:
                    if chain:
                        out.append((now, chain.hexdigest()))
                    now, chain = c, hashlib.sha256(line.encode())
                else:
                    chain.update(b"\n" + line.encode())
            yield _batch(out, target)
        if chain:
            yield _batch([(now, chain.hexdigest())], target)

    order = ["c", "part", "chunk", "place"]
    lines = found.turns.repartition("c").sortWithinPartitions(*order)
    lines = lines.select("c", F.concat("role", F.lit(":"), "text").alias("line"))
    hashes = lines.mapInArrow(run, schema)
    pieces = F.sort_array(F.collect_list(F.struct("part", "chunk", "audit")))
    audits = found.edits.groupBy("c").agg(F.concat_ws("", F.transform(pieces, lambda x: x["audit"])).alias("audit"))
    names = every.select("conv_id", _conversation("conv_id").alias("c")).distinct()
    met = names.join(found.faults, "c", "left").join(audits, "c", "left").join(hashes, "c", "left")
    zero = [F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias(k)
            for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return met.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
