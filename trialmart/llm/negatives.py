"""Hard negatives by inner product, found with coordinate pruning in length buckets.

All vectors are sorted by length and packed into buckets of similar length. A bucket holds, for
every coordinate, the list of its unit vectors in order of that coordinate. A search asks for scores in
``[lo, hi]`` and for the best ``k``; as soon as ``k`` are found, ``lo`` rises to the last of them. Since
a score is the product of two lengths and a cosine, the bucket's longest and shortest vector limit the
cosine; a bucket that would need more than 1 is skipped. The limits on the cosine leave a feasible
range on each of the anchor's focus coordinates, which are those of largest value; the sorted lists
give its members, the sets of all focus coordinates are intersected, and only what is left is
verified by the exact product. Where the lists leave too much of a bucket, the whole is verified.

Two searches run: the best rows of equal label are the positives, and their scores set the ranges
for rows of different label. Anchors are packed into blocks; every block meets every bucket once, in
tasks that hold one of each. Buckets are never copied, blocks once for each ``CELL_BUCKETS`` of them.

Defined results:

* rows with a null label or vector, or a component that is null or not finite (also once multiplied
  by ``scale``) take no part;
* vectors of different length: what the shorter one lacks counts as 0;
* scores are exact integers; one beyond 64 bits counts as the nearest 64-bit number;
* equal scores are ordered by id, nulls last; rows equal in id, label and vector are separate rows;
  an anchor leaves out itself, not its copies;
* a repeated anchor row gives its results as often as it occurs;
* an anchor without other rows of its label, or a positive without feasible rows, gives no rows,
  as does an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialmart.llm.scratch import placed, saved

POSITIVES = 5
NEGATIVES = 10
# A negative's score lies within these hundredths of the positive's.
LOW, HIGH = 30, 90
# Rows of a bucket, which are numbered in 16 bits, and the least length beside its longest.
BUCKET_ROWS = 2048
SAME_LENGTH = 0.9
LEAST_ROWS = 256
# Buckets that meet the blocks in one task, and anchors of a block.
CELL_BUCKETS = 16
BLOCK_ANCHORS = 512
FOCUS = 3
# From this share of a bucket on its candidates are not worth picking out.
DENSE_SHARE = 0.25

_MIN, _MAX = -(1 << 63), (1 << 63) - 1
# Sums of products stay exact in floating point below this.
_EXACT = float(1 << 52)
_SLACK = 1e-9


# --- packing --------------------------------------------------------------------------------------


def _packed(vectors: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them."""
    largest = float(np.abs(vectors).max(initial=0))
    code = next((c for c, top in (("<i2", 1 << 15), ("<i4", 1 << 31)) if largest < top), "<f8")
    return code, vectors.astype(code).tobytes()


def _unpacked(code: str, raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=code).astype(np.float64).reshape(rows, -1)


def _stacked(rows: list[dict]) -> np.ndarray:
    """Packed vectors as one matrix, short ones filled up with zeros."""
    vectors = [_unpacked(row["code"], row["vector"], 1)[0] for row in rows]
    full = np.zeros((len(vectors), max(map(len, vectors))))
    for i, vector in enumerate(vectors):
        full[i, : len(vector)] = vector
    return full


def _vectors(df: DataFrame, id_: str, vector: str, label: str, anchor: Column, scale: float):
    """``id, label, anchor, length, code, vector`` of the rows that take part."""
    narrow = df.select(
        F.col(id_).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).filter("label IS NOT NULL AND vector IS NOT NULL")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit, lengths, codes, raws = [], [], [], []
            for i, value in enumerate(batch.column(3)):
                # A null component becomes NaN.
                row = np.array(value.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                with np.errstate(over="ignore"):
                    row = np.floor(row * scale)
                if np.isfinite(row).all():
                    fit.append(i)
                    # Scaled first: squares of large values would not fit.
                    top = float(np.abs(row).max(initial=0)) or 1.0
                    lengths.append(top * float(np.sqrt(np.square(row / top).sum())))
                    code, raw = _packed(row)
                    codes.append(code)
                    raws.append(raw)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(pa.array(fit, pa.int64())) for i in range(3)),
                    pa.array(lengths, pa.float64()),
                    pa.array(codes, pa.string()),
                    pa.array(raws, pa.binary()),
                ],
                ["id", "label", "anchor", "length", "code", "vector"],
            )

    return narrow.mapInArrow(
        pack, "id long, label long, anchor boolean, length double, code string, vector binary"
    )


_BUCKET = "rows int, ids binary, null_ids binary, labels binary, code string, vectors binary, " \
    "lists binary"  # fmt: skip


def _bucket(rows: list[dict]) -> dict:
    """One bucket, in order of id so that earlier rows win ties, with its coordinates' lists."""
    rows = sorted(rows, key=lambda row: (row["id"] is None, row["id"] or 0))
    vectors = _stacked(rows)
    unit = _units(vectors)[0]
    code, raw = _packed(vectors)
    return {
        "rows": len(rows),
        "ids": np.array([row["id"] or 0 for row in rows], dtype="<i8").tobytes(),
        "null_ids": np.array([row["id"] is None for row in rows]).tobytes(),
        "labels": np.array([row["label"] for row in rows], dtype="<i8").tobytes(),
        "code": code,
        "vectors": raw,
        "lists": np.argsort(unit, axis=0, kind="stable").T.astype("<u2").tobytes(),
    }


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a zero vector stays zero."""
    top = np.abs(vectors).max(axis=1, initial=0)
    top[top == 0] = 1
    part = vectors / top[:, None]
    norm = np.sqrt(np.square(part).sum(axis=1))
    return part / np.where(norm > 0, norm, 1)[:, None], norm * top


def buckets_of(vectors: DataFrame) -> DataFrame:
    """All vectors in buckets of descending length, numbered by ``place``."""
    spread = F.xxhash64("id")
    ordered = vectors.repartitionByRange(F.desc("length"), spread).sortWithinPartitions(
        F.desc("length"), spread
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                shorter = held and row["length"] < SAME_LENGTH * held[0]["length"]
                if len(held) >= (LEAST_ROWS if shorter else BUCKET_ROWS):
                    done.append(_bucket(held))
                    held = []
                held.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([_bucket(held)], schema=schema)

    names = ("rows", "ids", "null_ids", "labels", "code", "vectors", "lists")
    types = {"rows": pa.int32(), "code": pa.string()}
    schema = pa.schema([(name, types.get(name, pa.binary())) for name in names])
    return placed(saved(ordered.select("id", "label", "length", "code", "vector")
                        .mapInArrow(pack, _BUCKET)))


_BLOCK = "block long, anchors int, keys binary, own_ids binary, own_labels binary, " \
    "own_code string, own_vectors binary, slots int, los binary, his binary"  # fmt: skip


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """Anchors of one block; empty ranges fill up those that ask for fewer."""
    rows = sorted(table.to_pylist(), key=lambda row: row["key"])
    slots = max(len(row["los"]) for row in rows)
    los = [row["los"] + [_MAX] * (slots - len(row["los"])) for row in rows]
    his = [row["his"] + [_MIN] * (slots - len(row["his"])) for row in rows]
    code, raw = _packed(_stacked(rows))
    return pa.table({
        "block": pa.array([key[0].as_py()], pa.int64()),
        "anchors": pa.array([len(rows)], pa.int32()),
        "keys": [np.array([row["key"] for row in rows], dtype="<i8").tobytes()],
        "own_ids": [np.array([row["id"] for row in rows], dtype="<i8").tobytes()],
        "own_labels": [np.array([row["label"] for row in rows], dtype="<i8").tobytes()],
        "own_code": [code],
        "own_vectors": [raw],
        "slots": pa.array([slots], pa.int32()),
        "los": [np.array(los, dtype="<i8").tobytes()],
        "his": [np.array(his, dtype="<i8").tobytes()],
    })


# --- searching one bucket for one block -----------------------------------------------------------


class _Bucket:
    def __init__(self, row: dict):
        n = row["rows"]
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.null_ids = np.frombuffer(row["null_ids"], dtype=bool)
        self.labels = np.frombuffer(row["labels"], dtype="<i8")
        self.vectors = _unpacked(row["code"], row["vectors"], n)
        unit, lengths = _units(self.vectors)
        self.longest, self.shortest = float(lengths.max()), float(lengths.min())
        self.lists = np.frombuffer(row["lists"], dtype="<u2").reshape(-1, n)
        # Each coordinate's values in order, and each row's place in that order.
        self.values = np.take_along_axis(unit.T, self.lists.astype(np.int64), axis=1)
        self.places = np.empty_like(self.lists)
        np.put_along_axis(
            self.places, self.lists.astype(np.int64),
            np.broadcast_to(np.arange(n, dtype="<u2"), self.lists.shape), axis=1,
        )


def _ranges(
    unit: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray, bucket: _Bucket
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feasible range of each query's coordinates ``unit``, and which queries can have any row."""
    far, near = length * bucket.longest, length * bucket.shortest
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(lo > 0, lo / far, lo / near)
        most = np.where(hi >= 0, hi / near, hi / far)
    # Without a length there is no cosine; 0 / 0 says nothing either.
    least = np.where((length == 0) | np.isnan(least), -1, least)
    most = np.where((length == 0) | np.isnan(most), 1, most)
    possible = (least <= 1 + _SLACK) & (most >= -1 - _SLACK) & (lo <= hi)
    widest = np.arccos(np.clip(least, -1, 1))[:, None]
    narrowest = np.arccos(np.clip(most, -1, 1))[:, None]
    axis = np.arccos(np.clip(unit, -1, 1))
    bottom = np.cos(np.minimum(np.pi, axis + widest))
    top = np.cos(np.maximum(0, np.maximum(axis - widest, narrowest - axis)))
    whole = (length == 0) | ((bucket.shortest == 0) & (lo <= 0))
    bottom[whole], top[whole] = -1, 1
    return bottom - _SLACK, top + _SLACK, possible


def _candidates(
    focus: np.ndarray, bottom: np.ndarray, top: np.ndarray, bucket: _Bucket
) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the feasible range in the list of each focus coordinate."""
    first, last = np.empty(focus.shape, dtype=np.int64), np.empty(focus.shape, dtype=np.int64)
    for coordinate in np.unique(focus):
        here = focus == coordinate
        first[here] = np.searchsorted(bucket.values[coordinate], bottom[here], side="left")
        last[here] = np.searchsorted(bucket.values[coordinate], top[here], side="right")
    return first, last


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of all rows, as 64-bit integers."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    if exact:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    products = (whole(a) if a.size else a) @ (whole(b) if b.size else b).T
    return np.clip(products, _MIN, _MAX).astype(np.int64)


class _Search:
    """The best rows of every query of a block; a query is an anchor and one of its ranges."""

    def __init__(self, row: dict, k: int, same_label: bool):
        n, self.k, self.same_label = row["anchors"], k, same_label
        self.keys = np.frombuffer(row["keys"], dtype="<i8")
        self.ids = np.frombuffer(row["own_ids"], dtype="<i8")
        self.labels = np.frombuffer(row["own_labels"], dtype="<i8")
        self.vectors = _unpacked(row["own_code"], row["own_vectors"], n)
        self.units, self.lengths = _units(self.vectors)
        self.slots = row["slots"]
        self.lo = np.frombuffer(row["los"], dtype="<i8").copy()
        self.hi = np.frombuffer(row["his"], dtype="<i8")
        self.owner = np.repeat(np.arange(n), self.slots)
        width = min(FOCUS, self.vectors.shape[1])
        self.focus = np.argsort(-np.abs(self.units), axis=1, kind="stable")[:, :width]
        # query, score, id, whether that is null, whether the row is the anchor itself or a copy
        self.best = [np.empty(0, dtype=np.int64)] * 5

    def add(self, bucket: _Bucket) -> None:
        exact = float(self.lengths.max()) * bucket.longest < _EXACT
        query = np.arange(len(self.lo))
        usable = bool(len(bucket.lists)) and self.focus.shape[1] > 0
        focus = np.minimum(self.focus, max(0, len(bucket.lists) - 1))
        at = self.owner
        on_focus = np.take_along_axis(self.units, self.focus, axis=1)[at]
        bottom, top, possible = _ranges(
            on_focus, self.lengths[at], self.lo.astype(float), self.hi.astype(float), bucket
        )
        if not usable:
            self._verify(query[possible], bucket, exact)
            return
        # A coordinate that the bucket's vectors lack limits nothing.
        lacking = (self.focus >= len(bucket.lists))[at]
        first, last = _candidates(focus[at], bottom, top, bucket)
        first[lacking], last[lacking] = 0, len(bucket.ids)
        sizes = last - first
        possible &= sizes.min(axis=1) > 0
        few = sizes.min(axis=1) < DENSE_SHARE * len(bucket.ids)
        self._verify(query[possible & ~few], bucket, exact)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for q in query[possible & few].tolist():
            leader = int(sizes[q].argmin())
            lists = focus[at[q]]
            rows = bucket.lists[lists[leader], first[q, leader] : last[q, leader]]
            for other in range(len(lists)):
                if other != leader:
                    place = bucket.places[lists[other], rows]
                    rows = rows[(place >= first[q, other]) & (place < last[q, other])]
            same = bucket.labels[rows] == self.labels[at[q]]
            rows = rows[same if self.same_label else ~same].astype(np.int64)
            scores = _products(self.vectors[at[q] : at[q] + 1], bucket.vectors[rows], exact)[0]
            fits = (scores >= self.lo[q]) & (scores <= self.hi[q])
            found.append((np.full(int(fits.sum()), q), np.stack([rows[fits], scores[fits]])))
        if found:
            rows, scores = np.concatenate([pair for _, pair in found], axis=1)
            self._merge(np.concatenate([q for q, _ in found]), rows, scores, bucket)

    def _verify(self, query: np.ndarray, bucket: _Bucket, exact: bool) -> None:
        """Verify the whole bucket for some queries."""
        if not len(query):
            return
        anchors, at = np.unique(self.owner[query], return_inverse=True)
        scores = _products(self.vectors[anchors], bucket.vectors, exact)
        same = bucket.labels[None, :] == self.labels[anchors][:, None]
        allowed = same if self.same_label else ~same
        for slot in range(self.slots):
            # One query of each anchor at a time.
            chosen = query % self.slots == slot
            asked, mine = query[chosen], scores[at[chosen]]
            fits = allowed[at[chosen]]
            fits &= (mine >= self.lo[asked][:, None]) & (mine <= self.hi[asked][:, None])
            fits = self._best_of_each(mine, fits)
            row, column = np.nonzero(fits)
            self._merge(asked[row], column, mine[row, column], bucket)

    def _best_of_each(self, scores: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """At most ``k`` of each row; of equal scores the first, whose ids are smallest."""
        n = scores.shape[1]
        if n <= self.k or int(fits.sum(axis=1).max(initial=0)) <= self.k:
            return fits
        reduced = np.where(fits, scores, _MIN)
        last = np.partition(reduced, n - self.k, axis=1)[:, n - self.k][:, None]
        above = fits & (scores > last)
        level = fits & (scores == last)
        room = self.k - above.sum(axis=1, keepdims=True)
        return above | (level & (np.cumsum(level, axis=1) <= room))

    def _merge(
        self, query: np.ndarray, rows: np.ndarray, scores: np.ndarray, bucket: _Bucket
    ) -> None:
        if not len(query):
            return
        anchor = self.owner[query]
        own = (bucket.ids[rows] == self.ids[anchor]) & ~bucket.null_ids[rows]
        own &= bucket.labels[rows] == self.labels[anchor]
        for i in np.flatnonzero(own).tolist():
            mine, other = self.vectors[anchor[i]], bucket.vectors[rows[i]]
            dims = min(len(mine), len(other))
            own[i] = (
                np.array_equal(mine[:dims], other[:dims])
                and not mine[dims:].any() and not other[dims:].any()
            )
        new = [query, scores, bucket.ids[rows], bucket.null_ids[rows], own]
        columns = [
            np.concatenate([old, part.astype(np.int64)])
            for old, part in zip(self.best, new, strict=True)
        ]
        # Scores descend; the complement of an integer does not overflow.
        order = np.lexsort((columns[2], columns[3], ~columns[1], columns[0]))
        owner = columns[0][order]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.best = [column[order] for column in columns]
        full = rank == self.k - 1
        self.lo[self.best[0][full]] = self.best[1][full]

    def result(self) -> pa.RecordBatch:
        query, score, id_, null_id, own = self.best
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.keys[self.owner[query]]),
                pa.array((query % self.slots).astype(np.int32)),
                pa.array(score),
                pa.array(id_, mask=null_id.astype(bool)),
                pa.array(own.astype(bool)),
            ],
            ["key", "slot", "score", "id", "own"],
        )


def _best(queries: DataFrame, buckets: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``key, slot, score, id, own, rank``: the best ``k`` rows for each anchor and range.

    queries: ``key, id, label, code, vector, los, his`` and the number ``block``.
    """
    cells = max(1, -(-buckets.count() // CELL_BUCKETS))
    blocks = queries.groupBy("block").applyInArrow(_block, _BLOCK)
    dealt = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    stored = buckets.withColumn("cell", F.floor(F.col("place") / CELL_BUCKETS).cast("int"))
    # Blocks stream by the buckets of their cell, which are few.
    pairs = dealt.join(stored.hint("merge"), "cell")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[tuple, _Search] | None = None
        unpacked: OrderedDict[int, _Bucket] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                cell, block = batch["cell"][i].as_py(), batch["block"][i].as_py()
                if current is None or current[0] != (cell, block):
                    if current:
                        yield current[1].result()
                    row = {name: batch[name][i].as_py() for name in block_columns}
                    current = (cell, block), _Search(row, k, same_label)
                place = batch["place"][i].as_py()
                bucket = unpacked.pop(place, None)
                if bucket is None:
                    bucket = _Bucket({name: batch[name][i].as_py() for name in bucket_columns})
                unpacked[place] = bucket
                if len(unpacked) > CELL_BUCKETS:
                    unpacked.popitem(last=False)
                current[1].add(bucket)
        if current:
            yield current[1].result()

    block_columns = [part.split()[0] for part in _BLOCK.split(", ")]
    bucket_columns = [part.split()[0] for part in _BUCKET.split(", ")]
    found = pairs.mapInArrow(search, "key long, slot int, score long, id long, own boolean")
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _hundredths(score: Column, share: int) -> Column:
    """``share`` hundredths of a score, exact."""
    return score.cast("decimal(20,0)") * F.lit(share).cast("decimal(6,0)") / F.lit(100)


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    scale: float = 1.0,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    anchor: which rows are anchors; only rows with an id can be. Components are multiplied by
    ``scale`` and rounded down. For each of an anchor's best ``positives`` rows of its label: the
    best ``negatives`` rows of other labels with ``low * score <= 100 * theirs <= high * score``.
    """
    vectors = saved(_vectors(df, id_column, vector_column, label_column, anchor, scale))
    buckets = buckets_of(vectors)
    anchors = vectors.filter("anchor AND id IS NOT NULL").groupBy(
        "id", "label", "code", "vector"
    ).agg(F.count("*").alias("times"))
    anchors = placed(saved(anchors)).withColumnRenamed("place", "key")
    anchors = anchors.withColumn("block", F.floor(F.col("key") / BLOCK_ANCHORS))

    everything = anchors.select(
        "*", F.array(F.lit(_MIN)).alias("los"), F.array(F.lit(_MAX)).alias("his")
    ).drop("times")
    nearest = _best(everything, buckets, positives + 1, same_label=True)
    # The anchor is one of its own rows, if it scores high enough to be among them.
    copy = F.row_number().over(Window.partitionBy("key", "own").orderBy("rank"))
    others = nearest.withColumn("copy", copy).filter("NOT (own AND copy = 1)")
    ranked = F.row_number().over(Window.partitionBy("key").orderBy("rank"))
    kept = saved(
        others.withColumn("place", ranked).filter(F.col("place") <= positives)
        .select("key", "place", F.col("id").alias("positive_id"), F.col("score"))
    )

    scores = kept.groupBy("key").agg(F.sort_array(F.collect_set("score"), asc=False).alias("all"))
    # Only a positive's score of 0 or more has scores between its shares.
    bounds = scores.select(
        "key", F.filter("all", lambda score: score >= 0).alias("all")
    ).filter("size(all) > 0").select(
        "key", "all",
        F.transform("all", lambda s: F.ceil(_hundredths(s, low)).cast("long")).alias("los"),
        F.transform("all", lambda s: F.floor(_hundredths(s, high)).cast("long")).alias("his"),
    )
    ranges = saved(anchors.drop("times").join(bounds, "key"))
    feasible = _best(ranges.drop("all"), buckets, negatives, same_label=False)
    slots = ranges.select("key", F.posexplode("all").alias("slot", "score"))
    found = feasible.select("key", "slot", F.col("id").alias("negative_id"),
                            F.col("score").alias("negative_score"), "rank")
    # A positive appears as often as rows with its score do; so do its negatives.
    results = kept.join(slots, ["key", "score"]).join(found, ["key", "slot"])
    whose = anchors.select("key", F.col("id").alias("anchor_id"),
                           F.explode(F.expr("sequence(1L, times)")).alias("time"))
    return results.join(whose, "key").select(
        "anchor_id", "positive_id", "rank", "negative_id",
        F.col("score").alias("positive_score"), "negative_score",
    )
