"""Language-model scores by context-tree weighting over bytes.

A text is its words, lower-cased in A-Z, joined by single spaces and ended by a line feed. Each byte
is coded as eight binary decisions. A decision's node in the tree is its bits so far together with
the last ``d`` bytes, for every depth ``d`` up to ``DEPTH``. Each node estimates by
Krichevsky-Trofimov counts; nodes of all depths are mixed with the weights of context-tree
weighting, computed bottom-up from the counts of the whole training corpus. Predictions are then
propagated top-down and frozen for scoring.

The tree is never stored. Distinct grams (a byte with the ``DEPTH`` bytes before it) of all texts
are counted over the training rows and shuffled by the last two bytes of their context, so that every
subtree below depth 1 lies in one task, which computes it by arrays, a portion of subtrees at a
time. Depths 0 and 1 have at most 65,280 nodes; their counts are summed by Spark and mixed on the
driver. A second pass goes down from there and gives every distinct gram its log probability.

At most ``MAX_NODES`` grams are broadcast with theirs: all, or those learned at least 1, 3, 7 ...
times. They are a cache only: the others are looked up by a join, so scores do not depend on the
bound.

The unigram baseline needs the exact count of every word. At most ``MAX_HOT_WORDS`` words are looked
up in place: all, or those learned at least 2, 4, 8 ... times. The others are joined.

Defined results: null text counts as empty, that is, the end alone; rows in no training fold are
scored only; without training rows every bit has probability 1/2 and the base has V = N = 0;
repeated rows count as often as they occur; null ids fall in the fold of the empty text; an empty
table gives no rows; long texts are scored whole; other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmart.llm.scratch import saved
from trialmart.llm.words import lower_words, texts_of

DEPTH = 5
MAX_NODES = 1 << 21
MAX_HOT_WORDS = 1 << 19
END = b"\n"

_BYTES_AT_ONCE = 1 << 22
_GRAMS_AT_ONCE = 1 << 21
_LEAVES_AT_ONCE = 1 << 18
_WORDS_AT_ONCE = 400_000
# Bounds of a probability, as single precision has them.
_LEAST_P, _MOST_P = float(np.float32(1e-7)), float(np.float32(1 - 1e-7))


def text_bytes(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def gram_keys(streams: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``depth`` bytes before it as one number, and where each stream starts.

    Before a stream its end symbol is repeated.
    """
    pad = END * depth
    data = np.frombuffer(b"".join([pad + s for s in streams]), dtype=np.uint8)
    keys = np.zeros(max(0, len(data) - depth), dtype=np.uint64)
    for j in range(depth + 1):
        keys = (keys << np.uint64(8)) | data[j : len(data) - depth + j]
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    # The padding of later streams takes part as context only.
    own = np.arange(lengths.sum()) + np.repeat(np.arange(len(streams)) * depth, lengths)
    return keys[own], starts


def gram_counts(texts: DataFrame, depth: int) -> DataFrame:
    """``gram, n`` over all rows of ``text, trains``: how often it occurs in rows to learn from.

    Grams of other rows alone have ``n`` 0.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for streams, trains in _portions(batches):
            for learned in (True, False):
                own = [s for s, t in zip(streams, trains, strict=True) if t == learned]
                if own:
                    new, n = np.unique(gram_keys(own, depth)[0], return_counts=True)
                    keys, counts = _merged(keys, counts, new, n * learned)
            if len(keys) > _GRAMS_AT_ONCE:
                yield _gram_rows(keys, counts)
                keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield _gram_rows(keys, counts)

    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _merged(
    keys: np.ndarray, counts: np.ndarray, new: np.ndarray, n: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two sorted lists of counts; a stable sort only merges them."""
    both = np.concatenate([keys, new])
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    return both[first], np.add.reduceat(np.concatenate([counts, n])[order], first)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bool]]]:
    held: list[bytes] = []
    learned: list[bool] = []
    size = 0
    for batch in batches:
        for text, trains in zip(texts_of(batch, 0), batch.column(1).to_pylist(), strict=True):
            held.append(text_bytes(lower_words(text)))
            learned.append(trains)
            size += len(held[-1])
            if size >= _BYTES_AT_ONCE:
                yield held, learned
                held, learned, size = [], [], 0
    if held:
        yield held, learned


def _gram_rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["gram", "n"]
    )


# --- the tree -----------------------------------------------------------------------------------


class _Level(NamedTuple):
    """Nodes of one depth. A node's number holds its context bytes, the latest last, and then the
    bits so far after a leading 1."""

    depth: int
    node: np.ndarray
    #: Of each node (or gram) that this was made from, its place here.
    place: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    #: The share of a node's own estimate, against those of deeper nodes.
    own: np.ndarray


def _mask(depth: int) -> int:
    return (1 << (8 * depth + 8)) - 1


def _log_gamma(z: np.ndarray) -> np.ndarray:
    # Stirling's series, six steps up where it is exact to ten digits.
    rising = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5)
    y = z + 6
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(rising)


def _log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    found = _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1)
    return np.where(n0 + n1 > 0, found - math.log(math.pi), 0.0)


def _rise(
    node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray, deepest: int,
    depths: range,
) -> tuple[list[_Level], np.ndarray]:
    """Levels of falling depth, and the log of the last one's weighted probabilities.

    ``below``: that of the nodes given, which lie one deeper; not used for the deepest level.
    """
    levels = []
    for d in depths:
        node, place = np.unique(node & _mask(d), return_inverse=True)
        # Counts stay exact as floats up to 2 ** 53.
        n0, n1 = np.bincount(place, n0), np.bincount(place, n1)
        single = _log_estimate(n0, n1)
        if d < deepest:
            mixed = np.logaddexp(single, np.bincount(place, below)) - math.log(2)
            own = np.minimum(1, np.exp(single - mixed - math.log(2)))
        else:
            mixed, own = single, np.ones(len(node))
        levels.append(_Level(d, node, place, n0, n1, own))
        below = mixed
    return levels, below


def _fall(
    levels: list[_Level], above: tuple[np.ndarray, ...]
) -> Iterator[tuple[_Level, tuple[np.ndarray, ...]]]:
    """Per level of rising depth its ``sum, rest, p``.

    ``p`` is the probability of a 1 as mixed down to this depth, ``rest`` the weight left for deeper
    nodes. Nodes that were never visited have their parents' ``p``. ``above``: the three of each
    parent of the first level's nodes.
    """
    for at, level in reversed(list(enumerate(levels))):
        before, weight, p = above
        here = (level.n1 + 0.5) / (level.n0 + level.n1 + 1)
        total = before + weight * level.own * here
        rest = weight * (1 - level.own)
        found = total, rest, np.where(level.n0 + level.n1 > 0, total + rest * here, p)
        yield level, found
        if at:
            above = tuple(x[level.place] for x in found)


def _steps(grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per bit of the grams' last bytes its value and its deepest node."""
    byte, context = grams & 255, grams >> 8
    for i in range(8):
        yield (byte >> (7 - i)) & 1, (context << 8) | (1 << i) | (byte >> (8 - i))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``gram, n`` of sorted rows ``under, gram, n``, in portions that part no equal ``under``."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= _LEAVES_AT_ONCE:
            under, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
            end = np.searchsorted(under, under[-1])
            if end:
                yield gram[:end], n[:end]
            held, size = [[under[end:], gram[end:], n[end:]]], 0
    if held:
        _, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
        yield gram, n


@dataclass
class Crown:
    """The levels of depths 0 and 1, in rising depth, and ``sum, rest, p`` of each."""

    levels: list[_Level]
    found: list[tuple[np.ndarray, ...]]

    def at(self, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
        last = self.levels[-1]
        place = np.searchsorted(last.node, nodes & _mask(last.depth))
        return tuple(x[place] for x in self.found[-1])


def _by_subtree(grams: DataFrame) -> DataFrame:
    under = F.shiftright("gram", 8).bitwiseAND(0xFFFF).cast("int")
    rows = grams.select(under.alias("under"), "gram", "n")
    return rows.repartition("under").sortWithinPartitions("under")


def _crown(parts: DataFrame, depth: int) -> Crown:
    low = min(1, depth)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in _subtrees(batches):
            for bit, node in _steps(gram):
                n0, n1, below = n * (1 - bit), n * bit, np.zeros(len(n))
                levels, below = _rise(node, n0, n1, below, depth, range(depth, low, -1))
                if levels:
                    node, n0, n1 = levels[-1].node, levels[-1].n0, levels[-1].n1
                node, place = np.unique(node & _mask(low), return_inverse=True)
                n0, n1 = (np.bincount(place, x).astype(np.int64) for x in (n0, n1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (node, n0, n1, np.bincount(place, below))],
                    ["node", "n0", "n1", "below"],
                )

    rows = parts.mapInArrow(sums, "node long, n0 long, n1 long, below double")
    # At most 256 * 255 rows.
    table = rows.groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("below"))
    levels, _ = _rise(*_arrays(table), depth, range(low, -1, -1))
    roots = len(levels[-1].node)
    both = list(_fall(levels, (np.zeros(roots), np.ones(roots), np.full(roots, 0.5))))
    return Crown([level for level, _ in both], [found for _, found in both])


def _arrays(df: DataFrame) -> list[np.ndarray]:
    return [np.asarray(column.combine_chunks()) for column in df.toArrow().columns]


def _single(p: np.ndarray) -> np.ndarray:
    return np.clip(p.astype(np.float32), _LEAST_P, _MOST_P).astype(np.float32)


def gram_logs(grams: DataFrame, depth: int) -> DataFrame:
    """``gram, n, log`` of every row of ``gram, n``: log10 probability of the last byte of the gram,
    given the bytes before it."""
    parts = _by_subtree(saved(grams))
    shared = grams.sparkSession.sparkContext.broadcast(_crown(parts, depth))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crown = shared.value
        for gram, n in _subtrees(batches):
            logs = np.zeros(len(gram))
            for bit, node in _steps(gram):
                p = crown.at(node)[2]
                for level, found in _falling(node, bit, n, depth, crown):
                    p = found[2]
                    if level.depth == depth:
                        p = p[level.place]
                p = _single(p).astype(np.float64)
                logs += np.log10(np.where(bit == 1, p, 1 - p))
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram), pa.array(n), pa.array(logs)], ["gram", "n", "log"]
            )

    return parts.mapInArrow(look, "gram long, n long, log double")


def _falling(
    node: np.ndarray, bit: np.ndarray, n: np.ndarray, depth: int, crown: Crown
) -> Iterator[tuple[_Level, tuple[np.ndarray, ...]]]:
    depths = range(depth, crown.levels[-1].depth, -1)
    levels, _ = _rise(node, n * (1 - bit), n * bit, np.zeros(len(n)), depth, depths)
    if levels:
        yield from _fall(levels, crown.at(levels[-1].node))


@dataclass
class ByteModel:
    """Nodes and their probability of a 1, sorted, per depth."""

    nodes: list[np.ndarray]
    ones: list[np.ndarray]

    def gram_logs(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram, given the bytes before it."""
        logs = np.zeros(len(grams))
        for bit, node in _steps(grams.astype(np.int64)):
            p = np.full(len(grams), 0.5)
            for d, known in enumerate(self.nodes):
                if len(known):
                    wanted = node & _mask(d)
                    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                    p = np.where(known[at] == wanted, self.ones[d][at], p)
            logs += np.log10(np.where(bit == 1, p, 1 - p))
        return logs


def train_bytes(texts: DataFrame, depth: int = DEPTH, max_nodes: int = MAX_NODES) -> ByteModel:
    """The frozen model of all rows of the one column ``text``.

    Of each depth at most ``max_nodes`` nodes: all, or those visited at least 2, 4, 8 ... times.
    """
    learned = texts.select("text", F.lit(True).alias("trains"))
    parts = _by_subtree(saved(gram_counts(learned, depth)))
    crown = _crown(parts, depth)
    shared = texts.sparkSession.sparkContext.broadcast(crown)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in _subtrees(batches):
            for bit, node in _steps(gram):
                for level, found in _falling(node, bit, n, depth, shared.value):
                    visits = (level.n0 + level.n1).astype(np.int64)
                    depths = np.full(len(visits), level.depth, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (depths, level.node, visits, found[2])],
                        ["depth", "node", "visits", "p"],
                    )

    deep = saved(parts.mapInArrow(nodes, "depth int, node long, visits long, p double"))
    model = ByteModel([], [])
    for level, found in zip(crown.levels, crown.found, strict=True):
        visits = level.n0 + level.n1
        powers, n = np.unique(np.floor(np.log2(visits)).astype(int), return_counts=True)
        of_power = dict(zip(powers.tolist(), n.tolist(), strict=True))
        kept = visits >= _least_power(of_power, max_nodes)
        model.nodes.append(level.node[kept])
        model.ones.append(_single(found[2][kept]))
    for d in range(len(crown.levels), depth + 1):
        level = deep.filter(F.col("depth") == d)
        kept = F.col("visits") >= _least(level, F.col("visits"), max_nodes)
        # At most max_nodes rows.
        node, p = _arrays(level.filter(kept).select("node", "p"))
        order = np.argsort(node)
        model.nodes.append(node[order])
        model.ones.append(_single(p[order]))
    return model


class GramTable:
    """Log probabilities by gram, in slots at or after that of the gram's hash."""

    _EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        bits = max(1, (len(grams) * 3 // 2).bit_length())
        self.shift = np.uint64(64 - bits)
        home = self._home(grams)
        order = np.argsort(home, kind="stable")
        count = np.arange(len(grams))
        slot = np.maximum.accumulate(home[order] - count) + count
        # The last slot is empty, where every search ends.
        size = max(1 << bits, int(slot[-1]) + 1 if len(slot) else 0) + 1
        self.grams = np.full(size, self._EMPTY)
        self.logs = np.zeros(size)
        self.grams[slot], self.logs[slot] = grams[order], logs[order]

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities, 0 for grams not in the table, and which are."""
        slot = self._home(grams)
        there = self.grams[slot]
        known = there == grams
        logs = np.where(known, self.logs[slot], 0.0)
        left = np.flatnonzero(~known & (there != self._EMPTY))
        slot = slot[left]
        while len(left):
            slot = slot + 1
            there = self.grams[slot]
            hit = there == grams[left]
            logs[left[hit]] = self.logs[slot[hit]]
            known[left[hit]] = True
            on = ~hit & (there != self._EMPTY)
            left, slot = left[on], slot[on]
        return logs, known


def score_streams(
    streams: list[bytes], depth: int, table: GramTable
) -> tuple[np.ndarray, pa.Array]:
    """Scores by the grams at hand, and each text's ``gram, n`` still to be looked up."""
    keys, starts = gram_keys(streams, depth)
    logs, known = table.find(keys)
    place = np.flatnonzero(~known)
    grams, inverse = np.unique(keys[place], return_inverse=True)
    stream = np.searchsorted(starts, place, side="right") - 1
    pairs, n = np.unique(stream * len(grams) + inverse, return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(len(starts) + 1) * len(grams))
    open_grams = grams[pairs % max(1, len(grams))].view(np.int64)
    values = pa.StructArray.from_arrays(
        [pa.array(open_grams), pa.array(n, pa.int64())], ["gram", "n"]
    )
    found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    return np.add.reduceat(logs, starts), found


class Shared:
    """Hot words and cached grams as broadcast; each Python worker makes its tables once."""

    def __init__(self, hot: pa.Table, base: int, grams: np.ndarray, logs: np.ndarray):
        self.hot, self.base, self.grams, self.logs = hot, base, grams, logs
        self._tables: tuple[dict[bytes, float], GramTable] | None = None

    def tables(self) -> tuple[dict[bytes, float], GramTable]:
        if self._tables is None:
            words, counts = self.hot.column("word"), np.asarray(self.hot.column("c"))
            logs = np.log10((counts + 1) / self.base).tolist()
            known = dict(zip(words.to_pylist(), logs, strict=True))
            self._tables = known, GramTable(self.grams.view(np.uint64), self.logs)
            self.hot = self.grams = self.logs = None
        return self._tables


def _least(rows: DataFrame, visits: F.Column, most: int) -> int:
    """The smallest power of two that at most ``most`` rows have as ``visits`` or exceed."""
    power = F.floor(F.log2(visits)).cast("int")
    # A row per power of two.
    counts = rows.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()
    return _least_power(dict(map(tuple, counts)), most)


def _least_power(counts: dict[int, int], most: int) -> int:
    rows = 0
    for power in sorted(counts, reverse=True):
        rows += counts[power]
        if rows > most:
            return 2 << power
    return 1


# --- the unigram baseline and the scores --------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over all rows of the one column ``text``; the end counts as a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch, 0):
                held.update(lower_words(text))
                held[END] += 1
                if len(held) > _WORDS_AT_ONCE:
                    yield _word_rows(held)
                    held = Counter()
        yield _word_rows(held)

    rows = texts.mapInArrow(count, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def _word_rows(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"]
    )


def score_documents(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    *,
    trains: F.Column,
    depth: int = DEPTH,
    max_nodes: int = MAX_NODES,
    max_hot_words: int = MAX_HOT_WORDS,
) -> DataFrame:
    """``doc_id, trains, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte`` of every row.

    ``trains`` is a boolean expression of ``df``: the rows to learn from.
    """
    spark = df.sparkSession
    narrow = df.select(
        F.col(text_column).alias("text"), F.col(id_column).alias("doc_id"),
        F.coalesce(trains, F.lit(False)).alias("trains"),
    )
    learned = narrow.filter("trains").select("text")
    counts = saved(word_counts(learned))
    row = counts.agg(F.sum("c"), F.count("*")).first()
    total, types = row[0] or 0, row[1]
    often = F.col("c") >= _least(counts, F.col("c"), max_hot_words)
    hot = counts.filter(often).toArrow().combine_chunks()
    logs = saved(gram_logs(gram_counts(narrow.select("text", "trains"), depth), depth))
    least = _least(logs, F.col("n") + 1, max_nodes)
    cached = F.col("n") + 1 >= least
    grams = _arrays(logs.filter(cached).select("gram", "log"))
    # Both have a fixed bound: max_hot_words words, and max_nodes grams.
    shared = spark.sparkContext.broadcast(Shared(hot, total + types + 1, *grams))
    floor = math.log10(1 / (total + types + 1))
    rare = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
    gram = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            *narrow.schema.fields[1:],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("hot_known", T.LongType()),
            T.StructField("hot_score", T.DoubleType()),
            T.StructField("n_rare", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("rare", T.ArrayType(rare)),
            T.StructField("open", T.ArrayType(gram)),
        ]
    )
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value.tables()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                streams, size, sums = [], 0, []
                begin = at
                while at < batch.num_rows and size < _BYTES_AT_ONCE:
                    words = lower_words(batch.column(0)[at].as_py())
                    streams.append(text_bytes(words))
                    size += len(streams[-1])
                    sums.append(_hot_sums(words, known))
                    at += 1
                part = batch.slice(begin, at - begin)
                columns = list(zip(*sums, strict=True))
                scores, is_open = score_streams(streams, depth, table)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(3), part.column(1), part.column(2),
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.float64()),
                        pa.array(columns[3], pa.int64()),
                        pa.array(scores, pa.float64()),
                        pa.array([len(s) for s in streams], pa.int64()),
                        _rare_lists(columns[4], rare_type),
                        is_open,
                    ],
                    schema.names,
                )

    rows = narrow.select("*", F.monotonically_increasing_id().alias("row"))
    scanned = saved(rows.mapInArrow(scan, schema))
    # Words that were not learned find no partner; they are what is left of a row's rare words.
    joined = (
        scanned.select("row", F.explode("rare").alias("r"))
        .select("row", "r.word", "r.n")
        .join(counts.filter(~often), "word")
    )
    weight = F.log10((F.col("c") + 1) / F.lit(float(total + types + 1)))
    parts = joined.select(
        "row", "n", (F.col("n") * weight).alias("log"), F.lit(0.0).alias("more")
    )
    if least > 1:
        opened = scanned.select("row", F.explode("open").alias("g")).select("row", "g.*")
        stored = logs.filter(~cached).select("gram", "log")
        parts = parts.unionByName(
            opened.join(stored, "gram").select(
                "row", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("log"),
                (F.col("n") * F.col("log")).alias("more"),
            )
        )
    sums = parts.groupBy("row").agg(
        F.sum("n").alias("rare_known"), F.sum("log").alias("rare_score"),
        F.sum("more").alias("more"),
    )
    score = F.col("score") + F.coalesce(F.col("more"), F.lit(0.0))
    found = F.coalesce(F.col("rare_known"), F.lit(0))
    return scanned.drop("rare", "open").join(sums, "row", "left").select(
        "doc_id",
        "trains",
        "n_tokens",
        (F.col("hot_known") + found).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (
            F.col("hot_score")
            + F.coalesce(F.col("rare_score"), F.lit(0.0))
            + (F.col("n_rare") - found) * F.lit(floor)
        ).alias("base_score"),
        score.alias("score"),
        "n_bytes",
        (score * F.lit(-math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _hot_sums(words: list[bytes], known: dict[bytes, float]) -> tuple:
    counts = Counter(words)
    counts[END] += 1
    n_known, score, rare = 0, 0.0, []
    for word, n in counts.items():
        log = known.get(word)
        if log is None:
            rare.append((word, n))
        else:
            n_known += n
            score += n * log
    return len(words) + 1, n_known, score, len(words) + 1 - n_known, rare


def _rare_lists(lists: tuple[list[tuple[bytes, int]], ...], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    words = pa.array([word for x in lists for word, _ in x], pa.binary())
    counts = pa.array([n for x in lists for _, n in x], pa.int64())
    values = pa.StructArray.from_arrays([words, counts], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(kind)
