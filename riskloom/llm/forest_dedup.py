"""Near-duplicate documents with an LSH forest over MinHash signatures.

A document is its set of distinct word shingles. Documents with the same set are one node. A node's
signature has TREES rows of DEPTH MinHash values of 8 bits each, a row being one 64-bit key, so
the order of the keys is the order of the signatures. In each tree's order the neighbours of
a node with the longest common prefixes are its candidates; at least MIN_DEPTH values must agree.
Two documents with a similarity of 0.8 agree that far in some tree but for one case in 100,000.

1. Nodes that share MIN_DEPTH values with no other node in a tree drop out of that tree.
2. In the first trees, each node is checked against its next neighbour in the sorted order. The links
   join the nodes of dense regions into components, however many there are.
3. Only nodes of different components still have to be compared, each with all others in its
   regions, the likeliest partners first, as they mostly join what belongs together; for that, regions with
   many are cut by longer prefixes. Then all pairs that still share MIN_DEPTH values across components are
   compared, large regions block by block. No region is skipped or shortened. The pairs are compared where
   their region lies, by the lowest hashes of their sets, which are whole sets up to BOTTOM shingles; only
   those that pass, and of sets known whole only those that join something new, leave the task.

Each link is confirmed on the sizes of intersection and union of the two full sets. Comparing first
values of the signatures and lowest hashes spares most checks of unlike sets; a pair at the threshold
fails these tests with a probability below 1e-5.

Edge cases: null and empty texts, or those without a word, have an empty set and link with
nothing; fewer words than a shingle has make one shingle. A missing id gives a missing
component_id, and the row is kept. Repeated rows are one node and get the same result each. An
empty table gives an empty result. Only the id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import apart, as_utf8, blocks, mix64, segments, word_hashes
from riskloom.llm.components import components
from riskloom.session import durable

TREES = 40
DEPTH = 8
MIN_DEPTH = 6
# Trees whose neighbours are checked before nodes of different components are compared.
FIRST_TREES = 3
# Values of the signature that are compared before two sets are.
SKETCH = 128
# Sketches of sets with a similarity of 0.8 agree in at least this share, five deviations off.
SKETCH_AGREES = 0.62
# The same for whole signatures.
SIGNATURE_AGREES = 0.68
# Lowest hashes of a set that are compared before the whole sets are, and by how many standard
# deviations their share may fall below the threshold.
BOTTOM = 512
DEVIATIONS = 4.5
# Partners of a node in a region that are checked before all others are.
LIKELIEST = 2
# Rows of a region in one task: in a sorted run, and when all of them are compared.
RUN_ROWS = 4096
REGION_ROWS = 2048

_MULTIPLIERS = mix64(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B9)) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted in each, and where each text's begin."""
    words, bounds = word_hashes(texts)
    count = np.diff(bounds)
    here = np.repeat(np.arange(len(texts)), np.maximum(count - width + 1, np.minimum(count, 1)))
    if not len(here):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.r_[0, np.cumsum(np.maximum(count - width + 1, np.minimum(count, 1)))]
    at = bounds[here] + np.arange(len(here)) - first[here]
    value = np.zeros(len(here), np.uint64)
    for k in range(width):  # a text with fewer words than a shingle has is one shingle
        inside = at + k < bounds[here + 1]
        step = value * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(at + k, len(words) - 1)]
        value = np.where(inside, mix64(step), value)
    order = np.lexsort((value, here))
    value, here = value[order], here[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (here[1:] != here[:-1])]
    value, here = value[new], here[new]
    return value, np.searchsorted(here, np.arange(len(texts) + 1))


def minhash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """TREES * DEPTH bytes for each set: parts of ``values`` that begin at ``starts``."""
    out = np.empty((len(starts), TREES * DEPTH), np.uint8)
    for k, multiplier in enumerate(_MULTIPLIERS):
        least = np.minimum.reduceat(values * multiplier, starts)
        out[:, k] = (mix64(least) >> np.uint64(56)).astype(np.uint8)
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, node, signature, hash) of every document; node stands for the set's content, and
    hash is that of the text."""
    kind = docs.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_utf8(batch.column(1).to_pylist())
            for a, b in blocks(texts):
                values, bounds = shingle_sets(texts[a:b], width)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                nodes: list[bytes | None] = [None] * (b - a)
                signed: list[bytes | None] = [None] * (b - a)
                if len(some):
                    starts = bounds[:-1][some]
                    rows = minhash(values, starts)
                    one = np.add.reduceat(mix64(values), starts)
                    two = np.add.reduceat(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    both = np.stack([one, two], axis=1)
                    for i, node, row in zip(some.tolist(), both, rows):
                        nodes[i], signed[i] = node.tobytes(), row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(arrow_kind),
                        pa.array(size.astype(np.int64)),
                        pa.array(nodes, pa.binary()),
                        pa.array(signed, pa.binary()),
                        batch.column(2).slice(a, b - a),
                    ],
                    names=["id", "n", "node", "signature", "hash"],
                )

    schema = f"id {kind.simpleString()}, n bigint, node binary, signature binary, hash bigint"
    return docs.select("id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles, bottom): the sorted shingle hashes of each document, and of the lowest the high halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_utf8(batch.column(0).to_pylist())
            for a, b in blocks(texts):
                values, bounds = shingle_sets(texts[a:b], width)
                nodes, sets, bottoms = [], [], []
                for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    part = values[start:end]
                    one = mix64(part).sum(dtype=np.uint64)
                    two = mix64(part ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    nodes.append(np.array([one, two]).tobytes())
                    sets.append(part.tobytes())
                    bottoms.append((part[:BOTTOM] >> np.uint64(32)).astype(np.uint32).tobytes())
                columns = [pa.array(column, pa.binary()) for column in (nodes, sets, bottoms)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "bottom"])

    return docs.select("text").mapInArrow(run, "node binary, shingles binary, bottom binary")


def linked(left: bytes, right: bytes, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def tree_rows(nodes: DataFrame) -> DataFrame:
    """(tree, key, node): DEPTH values of each tree as one number, the first value highest."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(
            t.alias("tree"),
            F.conv(F.hex(F.substring("signature", t * DEPTH + 1, F.lit(DEPTH))), 16, -10)
            .cast("bigint")
            .alias("key"),
        ),
    )
    return nodes.select(F.explode(keys).alias("x"), "node").select("x.tree", "x.key", "node")


def prefix(depth: int):
    return F.shiftrightunsigned("key", 8 * (DEPTH - depth))


def with_company(rows: DataFrame) -> DataFrame:
    """The rows that share MIN_DEPTH values with another one, by region and with its size.

    Sorted by key, all others are dropped before anything is counted; a few at the ends of batches
    stay until the count.
    """
    shift = np.uint64(8 * (DEPTH - MIN_DEPTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree = batch.column(0).to_numpy()
            start = batch.column(1).to_numpy().view(np.uint64) >> shift
            same = (tree[1:] == tree[:-1]) & (start[1:] == start[:-1])
            keep = np.r_[True, same] | np.r_[same, True]
            yield batch.filter(pa.array(keep))

    # Ranges split any group of equal keys, so no key is one task's burden.
    ordered = rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key")
    few = durable(ordered.mapInArrow(run, rows.schema).withColumn("region", prefix(MIN_DEPTH)))
    sizes = few.groupBy("tree", "region").agg(F.count("*").alias("size")).where("size > 1")
    return few.join(apart(sizes, "region"), ["tree", "region"])


def neighbour_links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): nodes that chains of linked neighbours join in the sorted orders of the first trees."""
    parts = F.ceil(F.col("size") / RUN_ROWS)
    rows = (
        near.where(F.col("tree") < FIRST_TREES)
        .withColumn("part", F.pmod(F.xxhash64("node", "tree"), parts))
        .join(sets.select("node", "shingles"), "node")
        .repartition("tree", "region", "part")
        .sortWithinPartitions("tree", "region", "part", "key", "node")
        .select("tree", "region", "part", "node", "shingles")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = head = None
        for batch in batches:
            u, v = [], []
            for tree, region, part, node, shingles in zip(
                *(batch.column(i).to_pylist() for i in range(5))
            ):
                near = last and last[:3] == (tree, region, part)
                if near and linked(last[3], shingles, percent):
                    u.append(head)  # a chain of links becomes a star, which is found faster
                    v.append(node)
                else:
                    head = node
                last = (tree, region, part, shingles)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"]
            )

    return rows.mapInArrow(run, "u binary, v binary").distinct()


def with_components(near: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of regions that hold nodes of different components."""
    rows = near.join(groups.select(F.col("id").alias("node"), "component_id"), "node", "left")
    rows = rows.withColumn("component", F.coalesce("component_id", "node")).drop("component_id")
    mixed = (
        rows.groupBy("tree", "region")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high")
        .select("tree", "region")
    )
    return durable(rows.join(apart(mixed, "region"), ["tree", "region"]))


def _sketches(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("sketch"))
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _numbered(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.to_numpy()


PAIR = "u binary, v binary"


def _pairs(batch: pa.RecordBatch, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    node = batch.column(batch.schema.get_field_index("node"))
    return pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], ["u", "v"])


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def in_blocks(rows: DataFrame, depths: range) -> DataFrame:
    """The rows by blocks of their regions, of which blocks i <= j of a region meet once.

    With several depths a region is as deep as its size asks for.
    """
    rows = rows.drop("size")
    narrow = rows.select("tree", "key", "node")
    depth = F.lit(depths[-1])
    for d in reversed(depths):
        sizes = narrow.groupBy("tree", prefix(d).alias(f"p{d}")).agg(F.count("*").alias(f"n{d}"))
        rows = rows.withColumn(f"p{d}", prefix(d)).join(apart(sizes, f"p{d}"), ["tree", f"p{d}"])
        depth = F.when(F.col(f"n{d}") <= REGION_ROWS, F.lit(d)).otherwise(depth)
    rows = rows.withColumn("depth", depth)
    choice = lambda name: F.coalesce(
        *[F.when(F.col("depth") == d, F.col(f"{name}{d}")) for d in depths]
    )
    parts = F.greatest(F.ceil(choice("n") / REGION_ROWS), F.lit(1)).cast("int")
    rows = rows.withColumns({"at": choice("p"), "parts": parts})
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other).select(
        "tree", "depth", "at", F.least("part", "other").alias("i"),
        F.greatest("part", "other").alias("j"), "node", "component", "n", "sketch", "part",
    )
    return rows.repartition(*MET).sortWithinPartitions(*MET)


# What rows of a block have in common.
MET = ["tree", "depth", "at", "i", "j"]


class Block:
    """The candidates among the rows of one block: of different components, sizes and sketches alike."""

    def __init__(self, batch: pa.RecordBatch, percent: int):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.sketch, self.size = _sketches(batch), column("n").to_numpy()
        self.tree = column("tree").to_numpy()
        # The first values of the trees that the sketch holds, as one number each.
        values = np.ascontiguousarray(self.sketch[:, : SKETCH // DEPTH * DEPTH])
        self.starts = values.view(">u8") >> np.uint64(8 * (DEPTH - MIN_DEPTH))
        self.component, self.part = _numbered(column("component")), column("part").to_numpy()
        self.two = column("i").to_numpy() != column("j").to_numpy()
        self.percent = percent

    def candidates(
        self, start: int, end: int, first: bool = False
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each row with its partners and the share of the sketch that agrees; every pair once.

        With ``first`` a pair whose sketches show that it also meets in an earlier tree is left to that one,
        where all rows that share MIN_DEPTH values with another component meet."""
        here = self.component[start:end]
        names, count = np.unique(here, return_counts=True)
        if len(names) == 1:
            return
        # Nodes of the largest component meet only those of the others.
        largest = here == names[count.argmax()]
        size, sketch = self.size, self.sketch
        for a in np.flatnonzero(~largest) + start:
            b = np.arange(start, end)
            can = (here != self.component[a]) & (largest | (b > a))
            can &= 100 * np.minimum(size[b], size[a]) >= self.percent * np.maximum(size[b], size[a])
            if self.two[start]:
                can &= self.part[b] != self.part[a]
            b = b[can]
            agree = self.agreeing(a, b)
            enough = agree >= SKETCH_AGREES
            b, agree = b[enough], agree[enough]
            if first and len(b):
                later = ~self.met_before(a, b)
                b, agree = b[later], agree[later]
            yield a, b, agree

    def agreeing(self, a: int, b: np.ndarray) -> np.ndarray:
        """The share of the values that sketches have in common; values of eight bytes are added at once."""
        same = (self.sketch[b] == self.sketch[a]).view(np.uint64).sum(axis=1, dtype=np.uint64)
        bytes_ = same.view(np.uint8).reshape(-1, 8)
        return bytes_.sum(axis=1) / self.sketch.shape[1]

    def met_before(self, a: int, b: np.ndarray) -> np.ndarray:
        """Whether ``a`` shares MIN_DEPTH values of an earlier tree with each of ``b``."""
        trees = min(int(self.tree[a]), self.starts.shape[1])
        return (self.starts[b, :trees] == self.starts[a, :trees]).any(axis=1)


def likeliest_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v): of all candidates of different components the LIKELIEST of each node and region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in segments(batches, MET):
            block, left, right = Block(batch, percent), [], []
            for start, end in zip(bounds, bounds[1:]):
                for a, b, agree in block.candidates(start, end):
                    if len(b) > LIKELIEST:
                        b = b[np.argsort(-agree, kind="stable")[:LIKELIEST]]
                    left.append(np.full(len(b), a))
                    right.append(b)
            if left:
                yield _pairs(batch, np.concatenate(left), np.concatenate(right))

    return ordered_pairs(in_blocks(rows, range(MIN_DEPTH, DEPTH + 1)).mapInArrow(run, PAIR))


class Bottoms:
    """The lowest hashes of the sets of one block, numbered in their order."""

    def __init__(self, bottoms: list[bytes], size: np.ndarray, percent: int):
        values = np.frombuffer(b"".join(bottoms), np.uint32)
        names, self.values = np.unique(values, return_inverse=True)
        lengths = np.fromiter(map(len, bottoms), np.int64, len(bottoms)) // 4
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.mine = np.zeros(len(names), bool)
        self.whole, self.percent = size <= BOTTOM, percent
        # Lists of part of a set tell nothing beyond their last hash.
        self.last = np.where(self.whole, len(names), self.values[self.ends - 1])

    def may_link(self, a: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether set ``a`` and each of ``b`` may link, and whether that is certain."""
        own = self.values[self.starts[a] : self.ends[a]]
        last = np.minimum(self.last[a], self.last[b])
        # All hashes up to the last one that both lists would hold.
        lengths = self.ends[b] - self.starts[b]
        begins = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(self.starts[b] - begins, lengths)
        values = self.values[at]
        inside = values <= np.repeat(last, lengths)
        self.mine[own] = True
        both = np.add.reduceat((self.mine[values] & inside).astype(np.int64), begins)
        self.mine[own] = False
        union = np.searchsorted(own, last, side="right") - both
        union += np.add.reduceat(inside.astype(np.int64), begins)
        certain = self.whole[a] & self.whole[b]
        share = self.percent / 100
        least = share - DEVIATIONS * (share * (1 - share) / union) ** 0.5
        return np.where(certain, 100 * both >= self.percent * union, both / union >= least), certain


def may_link(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> tuple[bool, bool]:
    """The same for two sets of ``n`` and ``m`` shingles with these lowest hashes."""
    two = Bottoms([a.tobytes(), b.tobytes()], np.array([n, m]), percent)
    links, certain = two.may_link(0, np.array([1]))
    return bool(links[0]), bool(certain[0])


def cross_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): what of all candidates of different components, which share MIN_DEPTH values, may link.

    A pair that meets in several trees is compared in the first of those that its sketches show. First only the
    rows that have a partner are told, then these meet again with the lowest hashes of their sets, a row with all
    its partners at once. Pairs of sets known whole are only returned where they join components within the block.
    """
    blocks_ = in_blocks(rows, range(MIN_DEPTH, MIN_DEPTH + 1))

    def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in segments(batches, MET):
            block, some = Block(batch, percent), np.zeros(batch.num_rows, bool)
            for start, end in zip(bounds, bounds[1:]):
                for a, b, _ in block.candidates(start, end, first=True):
                    some[b] = True
                    some[a] |= len(b) > 0
            yield batch.filter(pa.array(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in segments(batches, MET):
            block, left, right = Block(batch, percent), [], []
            column = batch.column(batch.schema.get_field_index("bottom")).to_pylist()
            bottoms = Bottoms(column, block.size, percent)
            for start, end in zip(bounds, bounds[1:]):
                joined: dict[int, int] = {}

                def root(x: int) -> int:
                    while x in joined:
                        x = joined[x]
                    return x

                for a, partners, agree in block.candidates(start, end, first=True):
                    one = root(int(block.component[a]))
                    apart_ = [root(x) != one for x in block.component[partners].tolist()]
                    partners, agree = partners[apart_], agree[apart_]
                    if not len(partners):
                        continue
                    links, certain = bottoms.may_link(a, partners)
                    order = np.argsort(-agree, kind="stable")
                    order = order[links[order]]
                    for b, sure in zip(partners[order].tolist(), certain[order].tolist()):
                        one, two = root(int(block.component[a])), root(int(block.component[b]))
                        if one == two:
                            continue
                        left.append(a)
                        right.append(b)
                        if sure:
                            joined[max(one, two)] = min(one, two)
            if left:
                yield _pairs(batch, np.array(left), np.array(right))

    few = blocks_.mapInArrow(with_partner, blocks_.schema)
    met = few.join(sets.select("node", "bottom"), "node")
    ordered = met.repartition(*MET).sortWithinPartitions(*MET)
    return ordered_pairs(ordered.mapInArrow(run, PAIR))


def checked(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough; whole signatures are compared before."""
    signature = nodes.select("node", "signature")

    def both(rows: DataFrame, of: DataFrame, name: str) -> DataFrame:
        for end, column in (("u", "a"), ("v", "b")):
            rows = rows.join(of.select(F.col("node").alias(end), F.col(name).alias(column)), end)
        return rows.select("u", "v", "a", "b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8) for i in (2, 3)
            )
            share = (a == b).reshape(batch.num_rows, -1).mean(axis=1)
            yield batch.select(["u", "v"]).filter(pa.array(share >= SIGNATURE_AGREES))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            keep = pa.array([linked(a, b, percent) for a, b in sets], pa.bool_())
            yield batch.select(["u", "v"]).filter(keep)

    near = durable(both(pairs, signature, "signature").mapInArrow(alike, PAIR))
    return both(near, sets, "shingles").mapInArrow(similar, PAIR)


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document.

    Links join documents whose sets of ``width``-word shingles have a Jaccard similarity of at
    least ``percent``, which must be 80 or more for the stated recall.
    """
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = _grouped(plain, width, percent)
    return found.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _grouped(plain: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, hash, n, component_id, first) of every row (id, text): the hash of its text, and that of
    the group's first text, which differ by id or text where another row stands for it."""
    signed = durable(signatures(plain, width))
    nodes = durable(
        signed.where("n > 0").groupBy("node").agg(
            F.min(F.when(F.col("id").isNotNull(), F.struct("id", "hash"))).alias("least"),
            F.first("n").alias("n"),
            F.first("signature").alias("signature"),
        ).withColumn("low", F.col("least.id"))
    )
    near = with_company(tree_rows(nodes))
    sketch = F.substring("signature", 1, SKETCH).alias("sketch")
    near = durable(near.join(nodes.select("node", "n", sketch), "node"))
    holders = near.select("node").distinct().join(nodes.select("node", "low"), "node")
    texts = plain.join(holders.select(F.col("low").alias("id")).distinct(), "id", "left_semi")
    sets = full_sets(texts, width).join(holders.select("node"), "node", "left_semi")
    # Ids may repeat, and a node may hold no id; sets are matched by content.
    without = holders.where("low IS NULL").limit(1).count()
    if without:
        lost = full_sets(plain.where("id IS NULL"), width)
        sets = sets.union(lost.join(holders.select("node"), "node", "left_semi"))
    sets = durable(sets.dropDuplicates(["node"]))
    links = durable(neighbour_links(near, sets, percent))
    groups = components(links)
    for candidates in (likeliest_pairs, lambda rows, percent: cross_links(rows, sets, percent)):
        pairs = candidates(with_components(near, groups), percent)
        links = durable(checked(pairs, nodes, sets, percent))
        if links.limit(1).count():
            known = groups.select(F.col("id").alias("u"), F.col("component_id").alias("v"))
            groups = components(known.union(links))
    group = F.coalesce("component_id", "node").alias("group")
    joined = nodes.select("node", "least").join(
        groups.withColumnRenamed("id", "node"), "node", "left"
    ).select("node", "least", group)
    lowest = joined.groupBy("group").agg(F.min("least").alias("least"))
    named = joined.select("node", "group").join(lowest, "group").select("node", "least")
    found = signed.select("id", "n", "node", "hash").join(named, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least.id", "id"))
    return found.select(
        "id",
        "hash",
        "n",
        component.alias("component_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("least.hash", "hash")).alias("first"),
    )


def first_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that another document of their group stands for.

    Rows are judged by id and text, as an id may occur with several texts: of each group the text
    with the smallest id stays, and of several with that id the one with the least hash."""
    plain = docs.select(F.col("doc_id").alias("id"), "text")
    judged = durable(_grouped(plain, width, percent))
    gone = judged.where("id != component_id OR hash != first").select("id", "hash").distinct()
    this = F.expr("d.doc_id = g.id AND xxhash64(d.text) = g.hash")
    kept = docs.alias("d").join(gone.alias("g"), this, "left_anti").select(*docs.columns)
    # Rows that repeat an id: one stays of those with the same text.
    repeated = judged.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("k"))
    repeated = durable(repeated.where("k > 1").select(F.col("id").alias("doc_id")))
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").union(once.select(*docs.columns))
