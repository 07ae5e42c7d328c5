"""Line-first quality rules: clean lines, then judge what is left of the document.

Each line is judged by itself: navigation lines (entries between separators that stand by
themselves, as in "Home | About | Contact"), symbol-ridden lines, shouted lines, lines without any
letter, known English boilerplate, and repeats of an earlier line are removed. A document is rejected if the base checks
fail or if the removed lines hold too large a share of its word characters.

Defined results: null text has no words and is rejected, like an empty one; every row is judged by
itself, so repeated rows and ids get equal results; an empty table gives no rows; long texts are
judged whole; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmart.llm.words import SEPARATORS, texts_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Characters counted as symbols, and separators of navigation entries.
SYMBOLS = "#*$%&|<>"
NAVIGATION = ("|", "»", "›", "•", "·", "::")
# Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "javascript is disabled",
    "click here to",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "lorem ipsum",
)

_WORDS = re.compile(f"[^{SEPARATORS}]+")
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LineRules:
    """Thresholds. Shares are of a line's words or characters, and of a document's word
    characters for ``max_removed``."""

    max_separator_share: float = 0.2
    max_symbol_share: float = 0.15
    max_shout_share: float = 0.7
    min_shout_words: int = 5
    max_removed: float = 0.5


def line_fault(line: str, words: list[str], rules: LineRules = LineRules()) -> str | None:
    """Why a line with words is removed, or None."""
    if not _LETTER.search(line):
        return "no_letter"
    separators = sum(word in NAVIGATION for word in words)
    if separators and separators > rules.max_separator_share * len(words):
        return "navigation"
    symbols = sum(line.count(symbol) for symbol in SYMBOLS)
    characters = sum(map(len, words))
    if symbols > rules.max_symbol_share * characters:
        return "punctuation"
    if len(words) >= rules.min_shout_words:
        shouted = sum(word.endswith("!!") or word.endswith("??") for word in words)
        if shouted > rules.max_shout_share * len(words):
            return "punctuation"
    lower = line.lower()
    if any(phrase in lower for phrase in BOILERPLATE):
        return "boilerplate"
    return None


def repeated_words(words: list[str]) -> int:
    """Words covered by 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, until = 0, 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + 3 - max(start, until)
            until = start + 3
    return covered


def judge(text: str | None, rules: LineRules = LineRules()) -> tuple:
    """The result columns of one document, and its text without the removed lines."""
    text = text or ""
    words = _WORDS.findall(text)
    word_chars = sum(map(len, words))
    symbols = sum(text.count(symbol) for symbol in SYMBOLS)
    seen: set[str] = set()
    repeats = removed = removed_chars = 0
    left = []
    for line in text.split("\n"):
        own = _WORDS.findall(line)
        if not own:
            left.append(line)
            continue
        if line in seen:
            repeats += 1
            fault: str | None = "repeat"
        else:
            seen.add(line)
            fault = line_fault(line, own, rules)
        if fault:
            removed += 1
            removed_chars += sum(map(len, own))
        else:
            left.append(line)
    n_repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(words)
    kept = not failed and removed_chars <= rules.max_removed * word_chars
    share = removed_chars / word_chars if word_chars else 0.0
    return (
        len(words), word_chars, symbols, repeats, n_repeat, failed, kept, removed, share,
        "\n".join(left),
    )


_FIELDS = [
    ("n_words", T.LongType(), pa.int64()),
    ("word_chars", T.LongType(), pa.int64()),
    ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()),
    ("n_repeat_words", T.LongType(), pa.int64()),
    ("base_failed", T.BooleanType(), pa.bool_()),
    ("kept", T.BooleanType(), pa.bool_()),
    ("n_removed_lines", T.LongType(), pa.int64()),
    ("removed_share", T.DoubleType(), pa.float64()),
    ("clean_text", T.StringType(), pa.string()),
]


def line_quality(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    *,
    rules: LineRules = LineRules(),
    clean_text: bool = True,
) -> DataFrame:
    """Counts, verdict and cleaned text of every row. No shuffle."""
    fields = _FIELDS if clean_text else _FIELDS[:-1]
    narrow = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType(
        [narrow.schema["doc_id"], *[T.StructField(name, kind) for name, kind, _ in fields]]
    )
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(text, rules)[: len(fields)] for text in texts_of(batch, 1)]
            columns = zip(*found, strict=True) if found else [[] for _ in fields]
            arrays = [pa.array(c, f[2]) for c, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return narrow.mapInArrow(scan, schema)


def keep_good(
    df: DataFrame,
    text_column: str = "text",
    *,
    length_column: str | None = None,
    rules: LineRules = LineRules(),
) -> DataFrame:
    """Rows whose document is kept, with its text cleaned of the removed lines.

    ``length_column``, if given, is set to the length of the new text. All other columns are
    returned as they are, whatever their names. No shuffle.
    """
    at = df.columns.index(text_column)
    length_at = df.columns.index(length_column) if length_column else None
    names = df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(text, rules) for text in texts_of(batch, at)]
            good = [i for i, row in enumerate(found) if row[6]]
            arrays = batch.take(pa.array(good, pa.int64())).columns
            cleaned = [found[i][9] for i in good]
            arrays[at] = pa.array(cleaned, batch.column(at).type)
            if length_at is not None:
                arrays[length_at] = pa.array(map(len, cleaned), batch.column(length_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(scan, df.schema)
