"""Token ids in packed fixed-length rows, as little-endian binary.

Documents are tokenised, ended by an end-of-text id and split losslessly into pieces of at most
``row_tokens``; pieces are packed best-fit-decreasing, the fullest row that still has room found
by a segment tree over capacities. Each task packs its own documents in groups of bounded size, so
nothing is shuffled.

Defined results: null and empty texts give one end-of-text id, so every row of the input is in the
output; null and repeated ids are carried along as they are; long texts are split, never cut; an
empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmart.llm.words import texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
ROW_TOKENS = 2048
# Tokens that a task packs at a time.
GROUP_TOKENS = 1 << 22
_CACHED_WORDS = 200_000
_AMBIGUOUS = re.compile(r"\s | \s")
# The pattern's engine searches runs of white space with a stack that long ones exhaust. Fixed
# value in the class: the characters with the Unicode property White_Space.
_SPACES_AT_ONCE = 10_000
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@dataclass(frozen=True)
class Vocabulary:
    """Content of a public vocabulary file in rank format, with one more id for the end of text."""

    content: bytes
    pattern: str = PATTERN

    @classmethod
    def read(cls, path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
        with open(path, "rb") as file:
            return cls(file.read(), pattern)

    def ranks(self) -> dict[bytes, int]:
        lines = (line.split() for line in self.content.splitlines() if line)
        return {base64.b64decode(token): int(rank) for token, rank in lines}

    @property
    def end(self) -> int:
        return self.content.count(b"\n") + (not self.content.endswith(b"\n"))

    @property
    def dtype(self) -> str:
        return "<u2" if self.end < 1 << 16 else "<u4"


class Encoder:
    """Text to ids as bytes, remembering the ids of words seen before.

    Where every space stands alone between other characters, the split pattern never joins
    characters across it except to put the space first in the next piece. So a text can be encoded
    word by word; other texts are encoded whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        self.dtype = vocabulary.dtype
        self.encoding = tiktoken.Encoding(
            "words", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks(),
            special_tokens={},
        )
        self.known: dict[str, bytes] = {}
        self.long_space = re.compile(f"{_SPACE}{{{_SPACES_AT_ONCE},}}")

    def _ids(self, text: str) -> bytes:
        """Ids of a text; a long run of white space is encoded as the piece the pattern makes of it.

        That is the run without its last character, or all of it at the end of the text.
        """
        if len(text) < _SPACES_AT_ONCE:
            return np.array(self.encoding.encode_ordinary(text), dtype=self.dtype).tobytes()
        ids: list[int] = []
        at = 0
        for run in self.long_space.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.encoding.encode_ordinary(text[at : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        ids += self.encoding.encode_ordinary(text[at:])
        return np.array(ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if _AMBIGUOUS.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        known = self.known
        parts = [self._ids(first)]
        for word in rest:
            ids = known.get(word)
            if ids is None:
                ids = self._ids(" " + word)
                if len(word) < 40:
                    if len(known) >= _CACHED_WORDS:
                        known.clear()
                    known[word] = ids
            parts.append(ids)
        return b"".join(parts)


class FullestFit:
    """Open rows by free capacity; finds the smallest capacity that still holds a piece."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        # Segment tree over capacities: is any row open below this node?
        self.tree = bytearray(2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, row: int) -> None:
        if free:
            self.rows[free].append(row)
            at = free + self.width
            while at and not self.tree[at]:
                self.tree[at] = 1
                at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Free capacity and number of the fullest row with room for ``size``, removed."""
        at = size + self.width
        if at >= 2 * self.width:
            return None
        if not self.tree[at]:
            # Up until a set right sibling, then down along the leftmost set path.
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        free = at - self.width
        row = self.rows[free].pop()
        if not self.rows[free]:
            while at:
                self.tree[at] = 0
                at >>= 1
                if not at or self.tree[2 * at] or self.tree[2 * at + 1]:
                    break
        return free, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; every piece is in one row, and no row exceeds the capacity."""
    rows: list[list[int]] = []
    fit = FullestFit(capacity)
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = fit.take(sizes[piece])
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        free, row = found
        rows[row].append(piece)
        fit.add(free - sizes[piece], row)
    return rows


_COLUMNS = [
    ("n_tokens", T.IntegerType(), pa.int32()),
    ("ids", T.BinaryType(), pa.binary()),
    ("cu_seqlens", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    ("position_resets", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    ("doc_offsets", T.ArrayType(T.LongType()), pa.list_(pa.int64())),
]


def packed_rows(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    *,
    vocabulary: Vocabulary | None = None,
    row_tokens: int = ROW_TOKENS,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row of the id matrix per row.

    ``row_id``; ``n_tokens`` in use; ``ids``: ``row_tokens`` ids, padded with the end id;
    ``cu_seqlens``: segment boundaries from 0 to ``n_tokens``; ``position_resets``: where positions
    start again from 0; ``doc_ids`` and ``doc_offsets``: each segment's document and the place of
    its first token in it.
    """
    vocabulary = vocabulary or Vocabulary.read()
    # A public vocabulary of fixed size, some 1 MB.
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    narrow = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = narrow.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("row_id", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            *[T.StructField(name, kind) for name, kind, _ in _COLUMNS],
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        dtype = np.dtype(encoder.dtype)
        end = np.array([shared.value.end], dtype=dtype).tobytes()
        step = row_tokens * dtype.itemsize
        next_row = TaskContext.get().partitionId() << 33
        pieces: list[tuple[object, int, bytes]] = []
        held = 0
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0), texts_of(batch, 1), strict=True):
                raw = (encoder.encode(text) if text else b"") + end
                for at in range(0, len(raw), step):
                    pieces.append((doc_id.as_py(), at // dtype.itemsize, raw[at : at + step]))
                held += len(raw) // dtype.itemsize
                if held >= group_tokens:
                    yield from _packed(pieces, row_tokens, dtype, end, next_row, kind, schema)
                    next_row += len(pieces)
                    pieces, held = [], 0
        if pieces:
            yield from _packed(pieces, row_tokens, dtype, end, next_row, kind, schema)

    return narrow.mapInArrow(scan, schema)


def _packed(pieces, row_tokens, dtype, end, next_row, kind, schema) -> Iterator[pa.RecordBatch]:
    sizes = [len(raw) // dtype.itemsize for _, _, raw in pieces]
    rows = best_fit_decreasing(sizes, row_tokens)
    for at in range(0, len(rows), 1024):
        some = rows[at : at + 1024]
        ends = [np.cumsum([sizes[i] for i in row]).tolist() for row in some]
        full = [
            b"".join([pieces[i][2] for i in row]) + end * (row_tokens - stops[-1])
            for row, stops in zip(some, ends, strict=True)
        ]
        columns = [
            pa.array(range(next_row + at, next_row + at + len(some)), pa.int64()),
            pa.array([[pieces[i][0] for i in row] for row in some], pa.list_(kind)),
            pa.array([stops[-1] for stops in ends], pa.int32()),
            pa.array(full, pa.binary()),
            pa.array([[0, *stops] for stops in ends], pa.list_(pa.int32())),
            pa.array([[0, *stops[:-1]] for stops in ends], pa.list_(pa.int32())),
            pa.array([[pieces[i][1] for i in row] for row in some], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema.names)


def position_ids(position_resets: list[int], n_tokens: int) -> np.ndarray:
    """Position of every token in use within its segment."""
    starts = np.zeros(n_tokens, dtype=np.int64)
    starts[position_resets] = position_resets
    return np.arange(n_tokens) - np.maximum.accumulate(starts)
