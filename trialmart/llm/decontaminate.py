"""Benchmark decontamination: a broadcast set of benchmark word windows, scanned over documents.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one
window. A document word inside any occurrence of a window is hit. Candidates are found by a rolling
hash of word numbers and verified word by word.

The set is broadcast only if its measured size allows (``max_broadcast_bytes``); larger benchmarks
are joined by shuffling windows, with equal results.

Defined results: null text has no words, no hits and no items; an item without words matches
nothing; items of null id count under the empty id; repeated items count once per id; repeated rows
and ids of documents get a result each; an empty benchmark hits nothing, empty documents give no
rows; long texts are scanned whole; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmart.llm.scratch import placed, saved
from trialmart.llm.words import texts_of

WINDOW = 10
MAX_BROADCAST_BYTES = 64 << 20

# On lower-cased UTF-8 this is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
)
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def benchmark_windows(
    benchmark: DataFrame, id_column: str, text_column: str, window: int = WINDOW
) -> DataFrame:
    """Distinct ``window`` (words joined by spaces), ``words``, ``item`` of the benchmark."""
    narrow = benchmark.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"),
        F.col(text_column).alias("text"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
                words = item_words(text)
                size = min(window, len(words))
                if size:
                    cuts = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
                    found += [(b" ".join(cut), size, item) for cut in sorted(cuts)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.binary()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.string()),
                ],
                ["window", "words", "item"],
            )

    return narrow.mapInArrow(cut, "window binary, words int, item string").distinct()


class WindowSet:
    """Windows as tuples of word numbers, with sorted hashes for a vectorised first test."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for window, item in rows:
            words = window.split(b" ")
            key = tuple(self.numbers.setdefault(w, len(self.numbers)) for w in words)
            self.items.setdefault(len(words), {}).setdefault(key, set()).add(item)
        self.hashes = {
            size: np.unique(_hash(np.array(sorted(keys), dtype=np.int64).T))
            for size, keys in self.items.items()
        }
        self.shortest = min(self.items, default=0)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Occurrences as word ranges, merged and in order, and the items they belong to."""
        if not self.items or len(words) < self.shortest:
            return [], set()
        number = self.numbers.get
        ids = np.fromiter((number(w, -1) for w in words), np.int64, len(words))
        # Length of the run of known words that ends before each position.
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            edges = np.concatenate([[-1], unknown, [len(ids)]])
            if int(np.diff(edges).max()) - 1 < self.shortest:
                return [], set()
        bad = np.concatenate([[0], np.cumsum(ids < 0)])
        spans, items = [], set()
        for size, windows in self.items.items():
            starts = np.flatnonzero(bad[size:] == bad[:-size])
            if not len(starts):
                continue
            hashes = _hash([ids[starts + k] for k in range(size)])
            known = self.hashes[size]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for start in starts[known[at] == hashes].tolist():
                found = windows.get(tuple(ids[start : start + size].tolist()))
                if found:
                    spans.append((start, start + size))
                    items |= found
        return merge_spans(spans), items


def _hash(columns) -> np.ndarray:
    total = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        total = (total + np.asarray(column).astype(np.uint64) + np.uint64(1)) * _FACTOR
        total ^= total >> np.uint64(29)
    return total


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _size_of(windows: DataFrame) -> int:
    """An upper bound of the windows' size in memory."""
    row = windows.agg(F.sum(F.length("window") + F.length("item") + 400)).first()
    return row[0] or 0


def _collected(windows: DataFrame) -> list[tuple[bytes, str]]:
    rows = windows.select("window", "item").collect()
    return sorted((bytes(row[0]), row[1]) for row in rows)


def find_hits(
    df: DataFrame,
    benchmark: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` per row; spans are ranges of words that are hit.

    ``items`` is sorted as strings. No shuffle of documents while the benchmark is broadcast.
    """
    narrow = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    windows = benchmark_windows(benchmark, item_column, item_text_column, window)
    if _size_of(windows) > max_broadcast_bytes:
        return _shuffled_hits(narrow, windows)
    known = df.sparkSession.sparkContext.broadcast(_collected(windows))
    schema = T.StructType(
        [
            narrow.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("spans", _SPANS),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = WindowSet(known.value)
        for batch in batches:
            counts, hits, items, spans = [], [], [], []
            for text in texts_of(batch, 1):
                words = item_words(text)
                ranges, of = found.scan(words)
                counts.append(len(words))
                hits.append(sum(stop - start for start, stop in ranges))
                items.append(sorted(of))
                spans.append([{"start": a, "stop": b} for a, b in ranges])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(hits, pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, _ARROW_SPANS),
                ],
                schema.names,
            )

    return narrow.mapInArrow(scan, schema)


def _shuffled_hits(narrow: DataFrame, windows: DataFrame) -> DataFrame:
    """The same by a join on windows, for benchmarks too large to broadcast."""
    sizes = sorted(row[0] for row in windows.select("words").distinct().collect())
    numbered = narrow.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    measured = T.StructType(
        [
            T.StructField("row", T.LongType()),
            narrow.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
        ]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array([len(item_words(text)) for text in texts_of(batch, 2)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], counts], measured.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), texts_of(batch, 1), strict=True):
                words = item_words(text)
                for size in sizes:
                    count = max(0, len(words) - size + 1)
                    cuts = [b" ".join(words[k : k + size]) for k in range(count)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row.as_py()] * count, pa.int64()),
                            pa.array(range(count), pa.int64()),
                            pa.array([size] * count, pa.int32()),
                            pa.array(cuts, pa.binary()),
                        ],
                        ["row", "start", "size", "window"],
                    )

    places = numbered.select("row", "text").mapInArrow(
        cut, "row long, start long, size int, window binary"
    )
    of_window = windows.groupBy("window").agg(F.collect_set("item").alias("found"))
    span = F.struct("start", (F.col("start") + F.col("size")).alias("stop"))
    grouped = places.join(of_window, "window").groupBy("row").agg(
        F.array_sort(F.collect_set(span)).alias("found_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("items"),
    )
    merge = F.pandas_udf(
        lambda column: column.map(
            lambda spans: merge_spans([(s["start"], s["stop"]) for s in spans])
        ),
        "array<struct<start: long, stop: long>>",
    )
    spans = grouped.select("row", "items", merge("found_spans").alias("spans"))
    # One row for each document; documents have no part in the join on windows.
    found = numbered.mapInArrow(measure, measured).join(spans, "row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"),
    )


def items_digest(items: F.Column) -> F.Column:
    """SHA-256 of item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def text_without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters of the given word ranges."""
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    parts, done = [], 0
    for start, stop in spans:
        parts.append(raw[done : at[start][0]])
        done = at[stop - 1][1]
    return b"".join([*parts, raw[done:]]).decode("utf-8")


def _shuffled_removal(
    df: DataFrame, windows: DataFrame, text_column: str, spans: bool
) -> DataFrame:
    """Documents without what the windows hit; those hit are found and joined by row number."""
    row, found = "__benchmark_row", "__benchmark_spans"
    # Written, so that every read of it numbers the rows alike.
    rows = placed(saved(df)).withColumnRenamed("place", row)
    narrow = rows.select(F.col(row).alias("doc_id"), F.col(text_column).alias("text"))
    hit = _shuffled_hits(narrow, windows).filter("n_hit > 0")
    hit = hit.select(F.col("doc_id").alias(row), F.col("spans").alias(found))
    if not spans:
        return rows.join(hit, row, "left_anti").select(*_quoted(df))
    remove = F.pandas_udf(
        lambda texts, of: pd.Series([
            text if text is None or ranges is None
            else text_without(text, [(s["start"], s["stop"]) for s in ranges])
            for text, ranges in zip(texts, of, strict=True)
        ]),
        "string",
    )
    joined = rows.join(hit, row, "left")
    return joined.withColumn(text_column, remove(F.col(text_column), F.col(found))).select(
        *_quoted(df)
    )


def _quoted(df: DataFrame) -> list[F.Column]:
    return [F.col(f"`{name}`") for name in df.columns]


def remove_benchmark(
    df: DataFrame,
    benchmark: DataFrame,
    *,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    spans: bool = False,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Documents without benchmark text, all columns as they are: documents with a hit go, or,
    with ``spans``, only the words that are hit. No shuffle, unless the benchmark is over the limit:
    then windows are joined, and what they hit is joined back by row."""
    windows = benchmark_windows(benchmark, item_column, item_text_column, window)
    size = _size_of(windows)
    if size > max_broadcast_bytes:
        return _shuffled_removal(df, windows, text_column, spans)
    blocks = 1 if size else 0
    at = df.columns.index(text_column)
    context = df.sparkSession.sparkContext
    found = "__benchmark_spans"
    schema = df.schema
    if spans:
        df = df.withColumn(found, F.array().cast(_SPANS))
    names = df.columns
    for _ in range(blocks):
        known = context.broadcast(_collected(windows))

        def scan(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            windows_of = WindowSet(known.value)
            for batch in batches:
                ranges = [windows_of.scan(item_words(text))[0] for text in texts_of(batch, at)]
                if spans:
                    both = [
                        [{"start": a, "stop": b} for a, b in own] + before
                        for own, before in zip(
                            ranges, batch.column(len(names) - 1).to_pylist(), strict=True
                        )
                    ]
                    arrays = [*batch.columns[:-1], pa.array(both, _ARROW_SPANS)]
                else:
                    clean = [i for i, own in enumerate(ranges) if not own]
                    arrays = batch.take(pa.array(clean, pa.int64())).columns
                yield pa.RecordBatch.from_arrays(arrays, names)

        df = df.mapInArrow(scan, df.schema)
    if not spans:
        return df

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                text_without(text, merge_spans([(s["start"], s["stop"]) for s in own]))
                if own
                else text
                for text, own in zip(
                    texts_of(batch, at), batch.column(len(names) - 1).to_pylist(), strict=True
                )
            ]
            arrays = batch.columns[:-1]
            arrays[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(arrays, names[:-1])

    return df.mapInArrow(remove, schema)
