"""Word rules that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what separates words, as a set of characters.
SEPARATORS = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8.

    Byte strings lower-case and split by ASCII rules alone, which are exactly these.
    """
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[str | None]:
    """The texts of a batch one at a time, so that only one is held as a Python string."""
    for value in batch.column(column):
        yield value.as_py()
