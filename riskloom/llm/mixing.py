"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are shuffled by a hash of id and text and cut into pieces of half a block. A
source of weight w has had min(n, w v) pieces at time v, and all sources together are P(v) pieces into the stream:
piece i (from 1) is released at slot floor(P((i - 1) / w)) and due at ceil(P(i / w)). This holds the
weights as they are given, and sources that run out as well: the others share their part from then on.

Earliest deadline first is applied twice. On the driver, to periods as wide slots: from the sources' sizes
alone it finds how many pieces of each source a period takes; what a source has had at a period's end is its share,
rounded up or down. In Spark, each period by itself: its pieces have release times and deadlines from those
numbers, and in each slot the released piece with the earliest deadline is put next. Either step keeps a
source within one piece of its share, so at any slot it has had less than one block, two pieces, more or
less than its target. The driver holds up to PERIODS + 2 S counts for each of S sources, and its time grows with S
squared; no document or piece passes through it.

Edge cases: a missing source and an empty name are one source; a source without a weight gets a
thousandth of the sum of the given ones, a weight without documents is ignored; weights that are not
positive and finite are an error; the last piece of a source may be short; repeated rows are documents of
their own; null ids and texts are placed like others; an empty table gives an empty result. Other
columns are carried as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import isfinite, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import share_package
from riskloom.session import durable

BLOCK_DOCS = 64
# The stream is scheduled in about this many periods, each of them at least so many slots.
PERIODS = 1024
PERIOD_SLOTS = 1 << 12
# A source without a weight gets this part of the sum of the given weights.
UNNAMED = 1 / 1000
# Shares this close to a whole number of pieces are that number: they are sums of rounded terms.
NEAR_WHOLE = 1e-6
# A source's documents are ranked in this many parts, so one source is no task's burden.
PARTS = 1 << 14
# Running sums of the parts' sizes are made by groups of so many parts.
GROUP = 1 << 7


def pfair_period(weights: dict[str, int]) -> list[str]:
    """Which source gets each slot of a period; the period is the sum of the weights."""
    period = sum(weights.values())
    waiting = [(0, name, 0) for name in sorted(weights)]  # (release, source, blocks placed)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, blocks placed)
    heapq.heapify(waiting)
    slots = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, name, placed = heapq.heappop(waiting)
            due = -(-(placed + 1) * period // weights[name])
            heapq.heappush(ready, (due, name, placed))
        _, name, placed = heapq.heappop(ready)
        slots.append(name)
        if placed + 1 < weights[name]:
            release = (placed + 1) * period // weights[name]
            heapq.heappush(waiting, (release, name, placed + 1))
    return slots


def turning_points(pieces: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, slots): when sources run out, and how far the stream is then; both begin with 0."""
    ends = pieces / weights
    order = np.argsort(ends, kind="stable")
    times = np.r_[0.0, ends[order]]
    active = np.cumsum(weights[order][::-1])[::-1]
    return times, np.r_[0.0, np.cumsum(np.diff(times) * active)]


def allotments(
    pieces: np.ndarray, weights: np.ndarray, length: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first slot, pieces had before, pieces had after) of each period, by source.

    Periods of ``length`` slots are cut where a source runs out, so that shares grow evenly within one.
    """
    total = int(pieces.sum())
    times, slots = turning_points(pieces, weights)
    cuts = np.r_[np.arange(0, total, length), np.floor(slots), np.ceil(slots), total]
    bounds = np.unique(np.clip(cuts, 0, total).astype(np.int64))
    had = np.zeros(len(pieces), np.int64)
    for start, end in zip(bounds.tolist(), bounds[1:].tolist()):
        if end == total:
            after = pieces.astype(np.int64)
        else:
            share = np.minimum(pieces, weights * np.interp(end, slots, times))
            # What is due by the end, and what else is released, by deadline.
            after = np.maximum(np.floor(share + NEAR_WHOLE).astype(np.int64), had)
            released = np.flatnonzero(np.ceil(share - NEAR_WHOLE) > after)
            due = (after[released] + 1) / weights[released]
            after[released[np.argsort(due, kind="stable")[: end - int(after.sum())]]] += 1
        yield start, had, after
        had = after


def schedule(spark: SparkSession, pieces: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """(source, piece, slot) of every piece; pieces of a source are numbered from 0."""
    names = sorted(pieces)
    counts = np.array([pieces[name] for name in names], np.int64)
    length = max(PERIOD_SLOTS, -(-int(counts.sum()) // PERIODS))
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for start, had, after in allotments(counts, np.array([weights[n] for n in names], float), length):
        taking = np.flatnonzero(after > had)
        found = (np.full(len(taking), start), taking, had[taking], (after - had)[taking])
        for column, values in zip(columns, found):
            column.append(values)
    fields = ("start", "number", "first", "n")
    taken = {name: np.concatenate([np.zeros(0, np.int64), *c]) for name, c in zip(fields, columns)}
    taken["source"] = pa.array(names, pa.string()).take(pa.array(taken.pop("number")))
    schema = "start bigint, first bigint, n bigint, source string"
    table = pa.table(taken).select(["start", "first", "n", "source"])

    def run(period: pd.DataFrame) -> pd.DataFrame:
        slots = pfair_period(dict(zip(period["source"], period["n"].tolist())))
        placed = pd.DataFrame({"source": slots})
        first = placed["source"].map(dict(zip(period["source"], period["first"])))
        placed["piece"] = first + placed.groupby("source").cumcount()
        placed["slot"] = period["start"].iloc[0] + np.arange(len(slots))
        return placed

    share_package(spark)
    periods = spark.createDataFrame(table, schema) if table.num_rows else spark.createDataFrame([], schema)
    return periods.groupBy("start").applyInPandas(run, "source string, piece bigint, slot bigint")


def target_weights(counts: dict[str, int], weights: dict[str, float] | None) -> dict[str, float]:
    """The weight of each source that has documents."""
    if weights is None:
        return {name: sqrt(n) for name, n in counts.items()}
    for name, weight in weights.items():
        if not (isfinite(weight) and weight > 0):
            raise ValueError(f"the weight of {name!r} is not positive and finite: {weight}")
    rest = sum(weights.values()) * UNNAMED or 1.0
    return {name: float(weights.get(name, rest)) for name in counts}


def starts(sizes: DataFrame) -> DataFrame:
    """(source, part, offset): how many documents of the source are in the parts before."""
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_group = ahead.partitionBy("source", "group").orderBy("part")
    of_groups = ahead.partitionBy("source").orderBy("group")
    groups = sizes.groupBy("source", "group").agg(F.sum("size").alias("size"))
    before = groups.select("source", "group", F.sum("size").over(of_groups).alias("before"))
    within = sizes.withColumn("within", F.sum("size").over(in_group)).join(before, ["source", "group"])
    zero = F.lit(0)
    offset = F.coalesce("within", zero) + F.coalesce("before", zero)
    return within.select("source", "part", offset.alias("offset"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    block_docs: int = BLOCK_DOCS,
    carried: list[str] | None = None,
    mixed_column: str | None = None,
) -> DataFrame:
    """(row, source, piece, slot, position): each input row as a struct, and its place.

    The struct has the columns named in ``carried``, or all. ``mixed_column`` names a column that
    already has the value of :func:`mixed_by`; the text is not read then.
    ``weights``: the target share of each source in any unit; without it, the square roots of the
    sources' sizes, a usual choice to lift small sources. Ascending ``position`` is the mixed order.
    """
    if block_docs < 2:
        raise ValueError("a block has at least two documents")
    spark, half = docs.sparkSession, block_docs // 2
    content = [F.col(f"`{name}`") for name in carried or docs.columns]
    mixed = F.col(mixed_column) if mixed_column else mixed_by(id_column, text_column)
    rows = docs.select(
        F.struct(*content).alias("row"),
        F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
        mixed.alias("mixed"),
        F.pmod(mixed, F.lit(PARTS)).cast("int").alias("part"),
    )
    sizes = rows.groupBy("source", "part").agg(F.count("*").alias("size"))
    offsets = starts(sizes.withColumn("group", F.floor(F.col("part") / GROUP)))
    # One row for each source, as the driver's part of the schedule needs.
    totals = rows.groupBy("source").agg(F.count("*").alias("n")).collect()
    counts = {row["source"]: row["n"] for row in totals}
    pieces = {name: -(-n // half) for name, n in counts.items()}
    # Stored, so that the planner knows its size: it has a row for every piece of the stream.
    slots = durable(schedule(spark, pieces, target_weights(counts, weights)))
    within = Window.partitionBy("source", "part").orderBy("mixed")
    ranked = (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(offsets, ["source", "part"])
        .withColumn("index", F.col("offset") + F.col("place"))
        .withColumn("piece", F.floor(F.col("index") / half))
    )
    return ranked.join(slots, ["source", "piece"]).select(
        "row",
        "source",
        "piece",
        "slot",
        (F.col("slot") * half + F.col("index") % half).alias("position"),
    )


def mixed_by(id_column: str = "doc_id", text_column: str = "text"):
    """What the documents of a source are ordered by."""
    return F.xxhash64(id_column, text_column)


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` in the mixed order, which writing keeps: partitions are ranges of positions."""
    placed = mix(docs, weights)
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def places(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, source, piece, slot, position) of every document."""
    placed = mix(docs, weights, carried=["doc_id"])
    return placed.select("row.doc_id", "source", "piece", "slot", "position")
