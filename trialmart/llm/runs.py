"""Periodic runs: stretches of words that repeat at a fixed distance, found by multi-scale minimizers.

A run is a maximal stretch of words with smallest period ``q`` and a length of at least
``max(MIN_LENGTH, MIN_PERIODS * q)``. Periods up to ``LAST_LAG`` are found by comparing the words
with themselves at each lag. Longer ones belong to the scale ``K``, a power of two, with
``K / 2 < q <= K``. Every ``K`` words in a row get a number, equal for equal words. Inside a run
these numbers repeat at distance ``q`` and, since ``K >= q``, at no smaller one. The minimum of
every window of ``K / 2`` numbers is a minimizer; a run is long enough to hold two windows at
distance ``q``, whose minimizers are then neighbours among those of equal number. Each such pair
is a seed, extended word by word to the maximal stretch.

Numbers are made from those of half the length. What occurs once in a document is left out, and so
is any stretch of repeated numbers too short for a run of this scale or a larger one; in ordinary
text nothing is left after two or three scales. Documents are worked on together, some 2^18 words at a
time, with words numbered per document, so that nothing is equal across documents.

Defined results:

* null and empty texts, and texts without a word, have no runs and an empty collapsed text;
* runs are listed by start, then period; runs may overlap, and each drops words by itself;
* a text of any length is worked on whole, in one task and in memory of some 150 bytes a word;
* repeated ids and rows are returned as often as they occur, and an empty table gives no rows;
* the result has the id under its own name, ``runs`` and ``collapsed``; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmart.llm.words import texts_of

MIN_LENGTH = 6
MIN_PERIODS = 4
# Periods up to here are compared lag by lag; half the smallest scale.
LAST_LAG = 4
WORDS_AT_ONCE = 1 << 18

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ARROW_RUNS = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
)


# --- runs of one sequence ------------------------------------------------------------------------


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true flags."""
    change = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return change[::2], change[1::2]


def _has_smaller_period(x: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of at least two periods repeats at a proper divisor of its period."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime:
            prime += 1
            continue
        while rest % prime == 0:
            rest //= prime
        lag = period // prime
        if np.array_equal(x[start : start + period], x[start + lag : start + lag + period]):
            return True
    return False


def _wanted(length: int, period: int) -> bool:
    return length >= max(MIN_LENGTH, MIN_PERIODS * period)


def _lag_scan(x: np.ndarray, period: int) -> Iterator[tuple[int, int, int]]:
    starts, ends = _stretches(x[:-period] == x[period:])
    long = ends - starts + period >= max(MIN_LENGTH, MIN_PERIODS * period)
    for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        if not _has_smaller_period(x, start, period):
            yield start, end + period - start, period


def _needed(scale: int) -> int:
    """Least number of neighbouring repeated ``scale``-grams in a run of this scale or larger."""
    return MIN_PERIODS * max(LAST_LAG + 1, scale // 2 + 1) - scale + 1


def _long_enough(at: np.ndarray, scale: int) -> np.ndarray:
    """Which positions lie in a row of neighbours that a run could make."""
    breaks = np.flatnonzero(np.diff(at) != 1) + 1
    edges = np.concatenate([[0], breaks, [len(at)]])
    sizes = np.diff(edges)
    return np.repeat(sizes >= _needed(scale), sizes)


def _minimizers(at: np.ndarray, name: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the leftmost minima of all windows of ``width`` neighbouring positions."""
    # Numbers are scattered by a fixed odd factor, so that minima do not follow their order.
    scattered = (name.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    low = (scattered << np.uint64(32)) | np.arange(len(at), dtype=np.uint64)
    span = 1
    while span < width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    whole = at[width - 1 :] - at[: len(at) - width + 1] == width - 1
    return np.unique(low[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _seeds(at: np.ndarray, name: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of neighbouring equal minimizers, for the periods of a scale."""
    chosen = _minimizers(at, name, scale // 2)
    order = chosen[np.lexsort((at[chosen], name[chosen]))]
    gap = at[order[1:]] - at[order[:-1]]
    near = (name[order[1:]] == name[order[:-1]]) & (gap > scale // 2) & (gap <= scale)
    start, gap = at[order[:-1]][near], gap[near]
    order = np.lexsort((start, gap))
    return start[order], gap[order]


def _extended(x: np.ndarray, seed: int, period: int) -> tuple[int, int]:
    """The widest range around a seed in which words equal those ``period`` further on."""
    end, step = seed, period
    while (step := min(step, len(x) - period - end)) > 0:
        same = x[end : end + step] == x[end + period : end + period + step]
        if not same.all():
            end += int(same.argmin())
            break
        end += step
        step *= 2
    start, step = seed, period
    while (step := min(step, start)) > 0:
        same = x[start - step : start] == x[start - step + period : start + period]
        if not same.all():
            start -= int(same[::-1].argmin())
            break
        start -= step
        step *= 2
    return start, end


def _scale_runs(
    x: np.ndarray, at: np.ndarray, name: np.ndarray, scale: int
) -> Iterator[tuple[int, int, int]]:
    known, covered = 0, 0
    for seed, period in zip(*(found.tolist() for found in _seeds(at, name, scale)), strict=True):
        if period == known and seed < covered:
            continue
        start, end = _extended(x, seed, period)
        known, covered = period, end
        if _wanted(end + period - start, period) and not _has_smaller_period(x, start, period):
            yield start, end + period - start, period


def find_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence of small integers, in order."""
    found: list[tuple[int, int, int]] = []
    for period in range(1, min(LAST_LAG, len(x) - 1) + 1):
        found += _lag_scan(x, period)
    at, name, scale = np.arange(len(x)), x, 1
    while len(at):
        _, name, count = np.unique(name, return_inverse=True, return_counts=True)
        repeated = count[name] > 1
        at, name = at[repeated], name[repeated]
        if not len(at):
            break
        stays = _long_enough(at, scale)
        at, name = at[stays], name[stays]
        if not len(at):
            break
        if scale > LAST_LAG:
            found += _scale_runs(x, at, name, scale)
        # Two numbers ``scale`` apart make the number of twice as many words.
        second = np.minimum(np.searchsorted(at, at + scale), len(at) - 1)
        pair = at[second] == at + scale
        name = name[pair] * (int(name.max()) + 1) + name[second[pair]]
        at = at[pair]
        scale *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


# --- documents ------------------------------------------------------------------------------------


def _group_runs(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of several documents, found together."""
    parts = [np.empty(0, dtype=np.int64)]
    base = 0
    for words in documents:
        codes: dict[bytes, int] = {}
        part = [codes.setdefault(word, len(codes)) for word in words]
        parts.append(np.array(part, dtype=np.int64) + base)
        base += len(codes)
    ends = np.cumsum([len(words) for words in documents])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    found = find_runs(np.concatenate(parts))
    owners = np.searchsorted(ends, [start for start, _, _ in found], side="right")
    for owner, (start, length, period) in zip(owners.tolist(), found, strict=True):
        offset = int(ends[owner - 1]) if owner else 0
        runs[owner].append((start - offset, length, period))
    return runs


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    stays = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stays).tolist()]


def _split(batch: pa.RecordBatch) -> Iterator[list[list[bytes]]]:
    """The words of a batch's documents, in groups of limited size."""
    group: list[list[bytes]] = []
    held = 0
    for text in texts_of(batch, 1):
        # Byte strings split at exactly the separators of the word rule.
        words = text.encode("utf-8", "replace").split() if text else []
        group.append(words)
        held += len(words)
        if held >= WORDS_AT_ONCE:
            yield group
            group, held = [], 0
    if group:
        yield group


def periodic_runs(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The id, ``runs`` (start, length, period) and ``collapsed`` text of every row."""
    narrow = df.select(F.col(id_column), F.col(text_column))
    schema = T.StructType(
        [narrow.schema[0]]
        + T.StructType.fromDDL(f"runs {RUN_TYPE}, collapsed string").fields
    )
    names = schema.fieldNames()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in _split(batch):
                runs = _group_runs(group)
                texts = [
                    b" ".join(collapse(words, found)).decode()
                    for words, found in zip(group, runs, strict=True)
                ]
                listed = [
                    [dict(zip(("start", "length", "period"), run, strict=True)) for run in found]
                    for found in runs
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(group)),
                        pa.array(listed, _ARROW_RUNS),
                        pa.array(texts, pa.string()),
                    ],
                    names,
                )
                done += len(group)

    return narrow.mapInArrow(scan, schema)


def strongest(runs: F.Column) -> F.Column:
    """The run of greatest exact length / period; ties go to the smallest start, then period."""
    # Runs come sorted by start and period, so only a greater exponent replaces an earlier run.
    return F.reduce(
        runs,
        F.get(runs, 0),
        lambda best, run: F.when(
            run["length"] * best["period"] > best["length"] * run["period"], run
        ).otherwise(best),
    )


def run_lines(runs: F.Column) -> F.Column:
    """Every run's ``start,length,period`` and a line feed, in one text."""
    return F.concat_ws(
        "",
        F.transform(
            runs,
            lambda run: F.concat(
                F.concat_ws(
                    ",", *(run[part].cast("string") for part in ("start", "length", "period"))
                ),
                F.lit("\n"),
            ),
        ),
    )
