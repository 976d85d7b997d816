"""Language-model scores from a Brown class-based bigram model.

log10 P(text) is the sum over its tokens of log10 P(class | class before) + log10 P(word | class).
A text's tokens are its words and one end, which is also what comes before the first word.

Exchange clustering gives the classes: each of the CLUSTERED most frequent words is moved to the
class where the likelihood of all class pairs gains most, until no move helps or ROUNDS are over.
It works on the counts of pairs of these words in all training texts, a table whose size does
not depend on the corpus. Every other word that occurs at least twice then joins the class where the
same likelihood gains most, given how often words of each class stand before and after it; these counts
are summed in Spark, over all training texts and for all words alike. So a word's class follows from its
contexts, however many other words there are. Words that occur once show where unknown words are to be
expected: they, and unknown words, are of the class RARE.

Counts cover all training texts. The HELD most frequent words go to every task, which only saves
shuffles: words, classes and counts of the others are joined by word, and the scores are the same.

Edge cases: a null or empty text has the end as its only token; a row without an id trains and is
not held out; repeated rows count as often as they occur and get a result each; without training
texts every count is zero; an empty table gives an empty result. Only the id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import as_utf8, blocks, fold, word_hashes
from riskloom.session import durable

FOLDS = 7
HELD_OUT = 2
CLUSTERED = 1024
CLASSES = 64
ROUNDS = 8
# Words that every task holds: a hash, a count and a class of each, 20 bytes.
HELD = 500_000
# Distinct entries a counting task holds before it passes their counts on.
COUNTED_AT_ONCE = 2_000_000
# Counts a class pair is smoothed with, spread like the classes themselves.
PAIR_PRIOR = 20.0
# Words whose gains in all classes are found at once.
WORDS_AT_ONCE = 256
# The end of a text among the hashes of words.
END = np.uint64(0x0E0D0E0D0E0D0E0D)
# Words of a text that are not held get the numbers from here on, in place of a class.
OPEN = 1 << 20


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end after each, and where each text begins."""
    words, bounds = word_hashes(texts)
    out = np.insert(words, bounds[1:], END)
    return out, bounds + np.arange(len(texts) + 1)


Counts = tuple[list[np.ndarray], np.ndarray]


def summed(parts: list[Counts]) -> Counts:
    """Distinct keys, which may have several columns, and the sums of their counts."""
    columns = [np.concatenate(column) for column in zip(*[keys for keys, _ in parts])]
    counts = np.concatenate([counts for _, counts in parts])
    order = np.lexsort(columns[::-1])
    columns = [column[order] for column in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([column[1:] != column[:-1] for column in columns], axis=0)
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], starts) if len(starts) else counts
    return [column[starts] for column in columns], sums


def counted(parts: Iterator[Counts]) -> Iterator[Counts]:
    """Counts of keys, summed as far as COUNTED_AT_ONCE of them allow."""
    kept: list[Counts] = []
    held = 0
    for keys, counts in parts:
        kept.append((keys, counts))
        held += len(counts)
        if held > COUNTED_AT_ONCE:
            kept[:] = [summed(kept)]
            held = len(kept[0][1])
            if held > COUNTED_AT_ONCE // 2:
                yield kept[0]
                kept.clear()
                held = 0
    if kept:
        yield summed(kept)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): how often each token occurs in the texts, words as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[Counts]:
            for batch in batches:
                texts = as_utf8(batch.column(0).to_pylist())
                for a, b in blocks(texts):
                    words, counts = np.unique(tokens(texts[a:b])[0], return_counts=True)
                    yield [words], counts

        for (words,), counts in counted(found()):
            yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "c": counts})

    found = train.select("text").mapInArrow(run, "word bigint, c bigint")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Words sorted by hash, with their counts and symbols (of clustered words) or classes."""

    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    end: int
    other: int  # the symbol of all words that are not listed
    _starts: np.ndarray | None = field(default=None, init=False, repr=False, compare=False)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Where each hash stands in the list, or would stand.

        Hashes are spread evenly, so the first bits of one lead to a few listed words. This table is made by
        each task for itself."""
        if self._starts is None:
            self._shift = np.uint64(63 - len(self.words).bit_length())
            sizes = np.bincount((self.words >> self._shift).astype(np.int64), minlength=1 << int(64 - self._shift))
            self._starts = np.r_[0, np.cumsum(sizes)]
            self._ended = np.r_[self.words, np.uint64((1 << 64) - 1)]
        at = self._starts[words >> self._shift]
        behind = np.flatnonzero(self._ended[at] < words)
        while len(behind):
            at[behind] += 1
            behind = behind[self._ended[at[behind]] < words[behind]]
        return at

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_starts": None, "_ended": None}

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, zero if not listed, and symbols of word hashes."""
        if len(self.words):
            at = np.minimum(self.places(words), len(self.words) - 1)
            hit = self.words[at] == words
            counts = np.where(hit, self.counts[at], 0)
            symbols = np.where(hit, self.symbols[at], self.other)
        else:
            counts = np.zeros(len(words), np.int64)
            symbols = np.full(len(words), self.other)
        return counts, np.where(words == END, self.end, symbols)


def at_least(counts: DataFrame, most: int) -> int:
    """The count from which on there are at most ``most`` words, and of two at least."""
    magnitude = F.floor(F.log2("c") * 8)
    totals = counts.groupBy(magnitude.alias("m")).agg(
        F.count("*").alias("n"), F.min("c").alias("least")
    )
    rows = sorted(totals.collect(), key=lambda row: -row["m"])  # at most 8 * 63 magnitudes
    least, taken = 1 << 62, 0
    for row in rows:
        taken += row["n"]
        if taken > most or row["least"] < 2:
            break
        least = row["least"]
    return least


def listed(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """A bounded table (word, c[, class]) as arrays, sorted by hash."""
    found = words.toArrow()
    hashes = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    cls = None
    if "cls" in found.column_names:
        cls = found.column("cls").to_numpy()[order].astype(np.int64)
    return hashes[order], found.column("c").to_numpy()[order], cls


def clustered_words(counts: DataFrame, most: int = CLUSTERED) -> Lexicon:
    """The most frequent words, each a symbol; ties to the smaller hash."""
    end = int(END.view(np.int64))
    top = counts.where((F.col("word") != end) & (F.col("c") > 1)).orderBy(F.desc("c"), "word")
    words, c, _ = listed(top.limit(most))
    symbols = np.empty(len(words), np.int64)
    symbols[np.lexsort((words, -c))] = np.arange(len(words))
    return Lexicon(words, c, symbols, len(words), len(words) + 1)


def symbol_pairs(train: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """How often each symbol follows each other one; a table of symbols by symbols."""
    n = lexicon.other + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            texts = as_utf8(batch.column(0).to_pylist())
            for a, b in blocks(texts):
                _, symbols = lexicon.look_up(tokens(texts[a:b])[0])
                before = np.r_[lexicon.end, symbols[:-1]]
                total += np.bincount(before * n + symbols, minlength=n * n)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pair.astype(np.int64), "n": total[pair]})

    parts = train.select("text").mapInArrow(run, "pair bigint, n bigint")
    found = parts.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(n * n)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(n, n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """What the class pairs add to the log-likelihood of the corpus."""
    rows, columns = pairs.sum(axis=1), pairs.sum(axis=0)
    return float(_xlogx(pairs).sum() - _xlogx(rows).sum() - _xlogx(columns).sum())


def gains(joint: np.ndarray, right: np.ndarray, left: np.ndarray, own: float) -> np.ndarray:
    """What a word adds to the likelihood in each class, without it in ``joint``: it is followed
    ``right`` times and preceded ``left`` times by words of each class, ``own`` times by itself."""
    rows, columns = joint.sum(axis=1), joint.sum(axis=0)
    # Joining class c changes its row, its column, and the cell where they cross.
    after, before = np.flatnonzero(right), np.flatnonzero(left)
    some, others = joint[:, after], joint[before]
    gain = (_xlogx(some + right[after]) - _xlogx(some)).sum(axis=1)
    gain += (_xlogx(others + left[before, None]) - _xlogx(others)).sum(axis=0)
    cell = np.diag(joint)
    gain -= _xlogx(cell + right) + _xlogx(cell + left) - 2 * _xlogx(cell)
    gain += _xlogx(cell + right + left + own) - _xlogx(cell)
    gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows)
    return gain - (_xlogx(columns + left.sum() + own) - _xlogx(columns))


def exchange(pairs: np.ndarray, clustered: int, classes: int = CLASSES) -> np.ndarray:
    """A class for each symbol. The symbols after the clustered words keep one each."""
    n = len(pairs)
    classes = min(classes, max(clustered, 1))
    of = np.arange(n) - clustered + classes
    of[:clustered] = np.arange(clustered) % classes
    k = classes + n - clustered
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    joint = member.T @ pairs @ member
    for _ in range(ROUNDS):
        moved = 0
        for w in range(clustered):
            old = of[w]
            right = np.bincount(of, pairs[w], k)
            left = np.bincount(of, pairs[:, w], k)
            own = pairs[w, w]
            right[old] -= own
            left[old] -= own
            # Without the word in its class.
            joint[old] -= right
            joint[:, old] -= left
            joint[old, old] -= own
            gain = gains(joint, right, left, own)[:classes]
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9 * abs(gain[old]):
                new = old
            moved += new != old
            of[w] = new
            joint[new] += right
            joint[:, new] += left
            joint[new, new] += own
        if not moved:
            break
    return of


def neighbours(train: DataFrame, classed: Lexicon, k: int) -> DataFrame:
    """(word, place, n): for each word that is not clustered, how often a word of class ``place``
    follows it, or, from ``k`` on, of class ``place - k`` stands before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[Counts]:
            for batch in batches:
                texts = as_utf8(batch.column(0).to_pylist())
                for a, b in blocks(texts):
                    words = tokens(texts[a:b])[0]
                    _, cls = classed.look_up(words)
                    here = np.flatnonzero(cls == classed.other)
                    # The last token is an end, so every word has one after it.
                    places = np.r_[cls[here + 1], k + np.where(here, cls[here - 1], classed.end)]
                    yield [np.tile(words[here], 2), places], np.ones(len(places), np.int64)

        for (words, places), counts in counted(found()):
            columns = {"word": words.view(np.int64), "place": places.astype(np.int32), "n": counts}
            yield pa.RecordBatch.from_pydict(columns)

    found = train.select("text").mapInArrow(run, "word bigint, place int, n bigint")
    return found.groupBy("word", "place").agg(F.sum("n").alias("n"))


def best_classes(joint: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """Of the first ``classes`` that of the largest of :func:`gains` for each row of ``table``: how often
    words of each class follow a word, and then how often they stand before it."""
    k = len(joint)
    sides = np.r_[joint.T, joint][:, :classes]
    side_logs = _xlogx(sides)
    cell, rows, columns = np.diag(joint)[:classes], joint.sum(axis=1)[:classes], joint.sum(axis=0)[:classes]
    best = np.zeros(len(table), np.int32)
    for a in range(0, len(table), WORDS_AT_ONCE):
        part = table[a : a + WORDS_AT_ONCE]
        of, place = np.nonzero(part)
        gain = np.zeros((len(part), classes))
        if len(of):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            terms = _xlogx(sides[place] + part[of, place][:, None]) - side_logs[place]
            gain[of[first]] = np.add.reduceat(terms, first, axis=0)
        right, left = part[:, :classes], part[:, k : k + classes]
        gain -= _xlogx(cell + right) + _xlogx(cell + left) - 2 * _xlogx(cell)
        gain += _xlogx(cell + right + left) - _xlogx(cell)
        gain -= _xlogx(rows + part[:, :k].sum(axis=1, keepdims=True)) - _xlogx(rows)
        gain -= _xlogx(columns + part[:, k:].sum(axis=1, keepdims=True)) - _xlogx(columns)
        best[a : a + WORDS_AT_ONCE] = gain.argmax(axis=1)
    return best


def joined_classes(contexts: DataFrame, joint: np.ndarray, classes: int) -> DataFrame:
    """(word, cls): the class among the first ``classes`` where each word adds most to the likelihood.

    ``contexts`` are rows of :func:`neighbours`; ``joint`` counts the pairs of classes without the word,
    which stands for itself in the class of words that are not clustered."""
    k = len(joint)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            entries = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            table = np.zeros((batch.num_rows, 2 * k))
            of = np.repeat(np.arange(batch.num_rows), sizes)
            table[of, entries.field("place").to_numpy()] = entries.field("n").to_numpy()
            best = best_classes(joint, table, classes)
            yield pa.RecordBatch.from_pydict({"word": batch.column(0), "cls": best})

    # A word has at most 2 k entries.
    rows = contexts.groupBy("word").agg(F.collect_list(F.struct("place", "n")).alias("counts"))
    return rows.mapInArrow(run, "word bigint, cls int")


@dataclass
class Model:
    """log10 of class transitions, and per class what turns a count into an emission."""

    lexicon: Lexicon  # the held words with their classes
    transitions: np.ndarray
    weight: np.ndarray  # log10 of the sum that counts of a class are divided by

    @property
    def end(self) -> int:
        return self.lexicon.end


def fitted(joint: np.ndarray, size: np.ndarray, mass: np.ndarray, lexicon: Lexicon) -> Model:
    """The model of class pairs ``joint``, and of each class's number of words and their counts.

    The last two classes are the end and RARE, whose size has one more for all unknown words."""
    end, rare = len(joint) - 2, len(joint) - 1
    size = size.astype(float)
    size[rare] += 1
    # A class without a member is no outcome.
    used = (size > 0).astype(float)
    used[end] = 1.0
    share = used * (joint.sum(axis=0) + 1)
    share /= share.sum()
    smooth = (joint + PAIR_PRIOR * share) / (joint.sum(axis=1, keepdims=True) + PAIR_PRIOR)
    weight = np.log10(np.maximum(mass + size, 1))
    weight[end] = 0.0
    return Model(lexicon, np.log10(np.where(smooth > 0, smooth, 1)), weight)


def sorted_pairs(pair: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and their texts by text, then by pair; where both fit into 64 bits they are sorted as one number."""
    before, cls = pair >> 32, pair & 0xFFFFFFFF
    wide, texts = (int(x.max(initial=0)).bit_length() for x in (np.maximum(before, cls), text))
    if 2 * wide + texts > 63:
        order = np.lexsort((pair, text))
        return pair[order], text[order]
    key = np.sort((text << wide | before) << wide | cls)
    low = (1 << wide) - 1
    return (key >> wide & low) << 32 | key & low, key >> 2 * wide


def text_rows(docs: DataFrame, lexicon: Lexicon, ends: int) -> DataFrame:
    """One row per text: its class pairs with their numbers, sums over held words, and its other words.

    A pair is the class before times 2**32, and the class; the i-th of the text's other words has the number
    OPEN + i in place of its class. ``emitted`` are the logarithms of held words, without the end's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = as_utf8(batch.column(2).to_pylist())
            for a, b in blocks(texts):
                words, bounds = tokens(texts[a:b])
                counts, cls = lexicon.look_up(words)
                n, starts = b - a, bounds[:-1]
                here = np.repeat(np.arange(n), np.diff(bounds))
                # The distinct open words of each text, and their numbers in it.
                at = np.flatnonzero(cls == lexicon.other)
                order = at[np.lexsort((words[at], here[at]))]
                new = np.ones(len(order), bool)
                new[1:] = (words[order[1:]] != words[order[:-1]]) | (here[order[1:]] != here[order[:-1]])
                firsts = order[new]
                open_bounds = np.searchsorted(here[firsts], np.arange(n + 1))
                which = np.cumsum(new) - 1
                cls[order] = OPEN + which - open_bounds[here[order]]
                before = np.r_[lexicon.end, cls[:-1]]
                pair = before << 32 | cls
                p, h = sorted_pairs(pair, here)
                differs = np.ones(len(pair), bool)
                differs[1:] = (p[1:] != p[:-1]) | (h[1:] != h[:-1])
                runs = np.flatnonzero(differs)
                pair_bounds = np.searchsorted(h[runs], np.arange(n + 1))
                is_end = words == END
                logs = np.log10(counts + 1.0)
                held = np.where(is_end, 0.0, logs)
                logs[is_end] = np.log10(ends + 1.0)
                known = (counts > 0) | (is_end & (ends > 0))

                def lists(bounds: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))

                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)),
                        batch.column(0).slice(a, n),
                        batch.column(1).slice(a, n),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                        pa.array(np.add.reduceat(logs, starts)),
                        pa.array(np.add.reduceat(held, starts)),
                        lists(pair_bounds, p[runs], pa.int64()),
                        lists(pair_bounds, np.diff(np.r_[runs, len(p)]), pa.int32()),
                        lists(open_bounds, words[firsts].view(np.int64), pa.int64()),
                        lists(open_bounds, np.bincount(which, minlength=len(firsts)), pa.int32()),
                    ],
                    names=["row", "id", "held_out", "n_tokens", "known", "logs", "emitted",
                           "pairs", "numbers", "words", "word_numbers"],
                )
                row += n

    schema = (
        f"row bigint, id {docs.schema['id'].dataType.simpleString()}, held_out boolean, "
        "n_tokens bigint, known bigint, logs double, emitted double, pairs array<bigint>, "
        "numbers array<int>, words array<bigint>, word_numbers array<int>"
    )
    return docs.select("id", "held_out", "text").mapInArrow(run, schema)


def with_classes(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with the places and classes of their open words that ``words`` (word, c, cls) holds, and
    the sums over these: ``more_known`` and ``more_logs``."""
    found = (
        rows.select("row", F.posexplode(F.arrays_zip("words", "word_numbers")).alias("i", "x"))
        .select("row", "i", F.col("x.words").alias("word"), F.col("x.word_numbers").alias("n"))
        .join(words, "word")
        .groupBy("row")
        .agg(
            F.sum("n").alias("more_known"),
            F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"),
            F.collect_list(F.when(F.col("cls").isNotNull(), F.struct("i", "cls"))).alias("classes"),
        )
    )
    kept = rows.withColumn("n_words", F.size("words")).drop("words", "word_numbers")
    return kept.join(found, "row", "left")


PATHS = ["pairs", "numbers", "n_words", "classes"]


def resolved(
    batch: pa.RecordBatch, rare: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, number, text) of the class pairs of the texts of :func:`with_classes`."""
    pairs, numbers, n_words, classes = (batch.column(name) for name in PATHS)
    texts = np.arange(batch.num_rows)
    here = np.repeat(texts, pc.list_value_length(pairs).to_numpy())
    # The open words of all texts in one array, RARE unless their class is known.
    starts = np.r_[0, np.cumsum(n_words.to_numpy())]
    own = np.full(starts[-1], rare)
    of = np.repeat(texts, pc.fill_null(pc.list_value_length(classes), 0).to_numpy())
    found = classes.flatten()
    own[starts[of] + found.field("i").to_numpy()] = found.field("cls").to_numpy()
    pair = pairs.flatten().to_numpy()
    sides = []
    for side in (pair >> 32, pair & 0xFFFFFFFF):
        is_open = side >= OPEN
        side[is_open] = own[side[is_open] - OPEN + starts[here[is_open]]]
        sides.append(side)
    return *sides, numbers.flatten().to_numpy(), here


def class_pairs(rows: DataFrame, k: int) -> np.ndarray:
    """How often each class follows each other one in ``rows`` of :func:`with_classes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for batch in batches:
            before, cls, numbers, _ = resolved(batch, k - 1)
            total += np.bincount(before * k + cls, numbers, k * k)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pair, "n": total[pair].astype(np.int64)})

    parts = rows.select(*PATHS).mapInArrow(run, "pair bigint, n bigint")
    found = parts.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(k * k)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(k, k)


def transition_sums(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` of :func:`with_classes`, with ``path``: log10 of their classes, less the weights."""
    step = model.transitions - model.weight
    kept = ["id", "held_out", "n_tokens", "known", "logs", "emitted", "more_known", "more_logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, cls, numbers, here = resolved(batch, len(step) - 1)
            path = np.bincount(here, step[before, cls] * numbers, batch.num_rows)
            columns = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(path)], names=[*kept, "path"])

    kinds = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in kept)
    return rows.select(*kept, *PATHS).mapInArrow(run, f"{kinds}, path double")


def trained(
    train: DataFrame, counts: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES
) -> tuple[DataFrame, int]:
    """(word, c, cls) of all words of ``counts`` but the end, the class null for those of RARE, and the
    number of classes that words are dealt to."""
    top = clustered_words(counts, clustered)
    pairs = symbol_pairs(train, top)
    of = exchange(pairs, len(top.words), classes)
    k = int(of.max()) + 1
    member = np.zeros((len(of), k))
    member[np.arange(len(of)), of] = 1
    joint = member.T @ pairs @ member
    classed = Lexicon(top.words, top.counts, of[top.symbols], int(of[top.end]), int(of[top.other]))
    spark = counts.sparkSession
    seeds = spark.createDataFrame(
        pa.table({"word": top.words.view(np.int64), "seed": classed.symbols.astype(np.int32)})
    )
    words = counts.where(F.col("word") != int(END.view(np.int64)))
    often = words.where("c > 1").join(F.broadcast(seeds), "word", "left_anti").select("word")
    contexts = neighbours(train, classed, k).join(often, "word", "left_semi")
    joined = joined_classes(contexts, joint, k - 2)
    return (
        words.join(F.broadcast(seeds), "word", "left")
        .join(joined, "word", "left")
        .select("word", "c", F.coalesce("seed", "cls").alias("cls")),
        k - 2,
    )


def score(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    held_out = F.coalesce(fold(id_column, FOLDS) == HELD_OUT, F.lit(False))
    plain = docs.select(
        F.col(id_column).alias("id"), held_out.alias("held_out"), F.col(text_column).alias("text")
    )
    train = plain.where("NOT held_out").select("text")
    counts = durable(word_counts(train))
    end = int(END.view(np.int64))
    total = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("c"),
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(F.col("word") == end, F.col("c"))), F.lit(0)).alias("ends"),
    ).first()
    words, classes = trained(train, counts)
    words = durable(words)
    k = classes + 2
    least = at_least(words, HELD)
    hashes, c, cls = listed(words.where(F.col("c") >= least))
    held = Lexicon(hashes, c, cls, k - 2, k - 1)
    size, mass = np.zeros(k), np.zeros(k)
    by_class = words.groupBy(F.coalesce("cls", F.lit(k - 1)).alias("cls"))
    for row in by_class.agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect():
        size[row["cls"]], mass[row["cls"]] = row["n"], row["c"]
    rows = text_rows(plain, held, total["ends"])
    met = durable(with_classes(durable(rows), words.where(F.col("c") < least)))
    model = fitted(class_pairs(met.where("NOT held_out"), k), size, mass, held)
    sums = transition_sums(met, model)
    more_logs = F.coalesce("more_logs", F.lit(0.0))
    over = F.log10(F.lit(float(total["c"] + total["n"] + 1)))
    return sums.select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total["c"]).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n_tokens") * over).alias("base_score"),
        (F.col("path") + F.col("emitted") + more_logs).alias("score"),
    )
