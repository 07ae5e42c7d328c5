"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability
is the sum over all ways to segment it into pieces, by the forward algorithm; a text is the product
of its words. Probabilities are learned by expectation maximisation from word counts of the
training rows, all gathered by grouping; only tables of vocabulary size reach the driver.

Words are runs of letters, lower-cased. A character no piece covers counts as the unknown piece.

Defined results: null text, or text without a letter, is ``und`` with score 0, and so is every text
if no language was learned; ties go to the language first in code-point order; rows of null text or
null language teach nothing; repeated rows count as often as they occur; an empty table gives no
rows; long texts are scored whole; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmart.llm.scratch import saved
from trialmart.llm.words import texts_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNDETERMINED = "und"
ROUNDS = 2
# Weight, in pieces, of the all-language distribution within each language's.
PRIOR_PIECES = 2000.0
UNKNOWN = 1e-7
_START = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHED_WORDS = 200_000
_WORDS_AT_ONCE = 20_000
_RESCALE = 8
# Odd numbers that mix hashes of substrings.
_FACTOR = 0x9E3779B97F4A7C15
_SPREAD = 0xD6E8FEB86659FD93


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """Text pieces of a vocabulary file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


def letter_words(text: str | None) -> Counter:
    """Lower-cased letter runs and how often they occur."""
    if not text:
        return Counter()
    counts = Counter(_LETTERS.findall(text.lower()))
    for word in [w for w in counts if not w.isalpha()]:
        n = counts.pop(word)
        if letters := "".join(c for c in word if c.isalpha()):
            counts[letters] += n
    return counts


class Segmenter:
    """Piece numbers of all substrings of words, words of equal length at a time.

    Substrings are compared by 64-bit hashes, which are looked up in an open table.
    """

    def __init__(self, pieces: Sequence[str]):
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)
        self.none = len(pieces) + 1
        self.shift = np.uint64(64 - max(8, (8 * len(pieces)).bit_length()))
        size = 1 << (64 - int(self.shift))
        keys, numbers = [0] * size, [self.none] * size
        self.probes = 1
        for i, piece in enumerate(pieces):
            key = 0
            for character in piece:
                key = (key * _FACTOR + ord(character) + 1) % (1 << 64)
            at, probes = (key * _SPREAD % (1 << 64)) >> int(self.shift), 1
            while numbers[at] != self.none:
                at, probes = (at + 1) % size, probes + 1
            keys[at], numbers[at] = key, i
            self.probes = max(self.probes, probes)
        self.keys = np.array(keys, dtype=np.uint64)
        self.numbers = np.array(numbers, dtype=np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * np.uint64(_SPREAD)) >> self.shift).astype(np.int64)
        found = np.where(self.keys[at] == keys, self.numbers[at], self.none)
        # Slots after an occupied one may hold the key; after a free one they cannot.
        left = np.flatnonzero((found == self.none) & (self.numbers[at] != self.none))
        for _ in range(self.probes - 1):
            at[left] = (at[left] + 1) % len(self.keys)
            hit = self.keys[at[left]] == keys[left]
            found[left[hit]] = self.numbers[at[left[hit]]]
            left = left[~hit & (self.numbers[at[left]] != self.none)]
        return found

    def lattice(self, words: list[str]) -> np.ndarray:
        """[word, end, length - 1] -> number of the piece of that length that ends there."""
        size = len(words[0]) + 1
        width = min(self.longest, size)
        text = np.array([_START + word for word in words], dtype=f"<U{size}")
        codes = text.view(np.uint32).reshape(len(words), size).astype(np.uint64) + np.uint64(1)
        rows = np.full((len(words), size, width), self.none, dtype=np.int32)
        hashes = np.zeros_like(codes)
        for length in range(1, width + 1):
            # From here on column j belongs to the substring that ends at j + length - 1.
            hashes = hashes[:, : size - length + 1] * np.uint64(_FACTOR) + codes[:, length - 1 :]
            found = self._find(hashes.ravel()).reshape(hashes.shape)
            if length == 1:
                found = np.where(found == self.none, self.unknown, found)
            rows[:, length - 1 :, length - 1] = found
        return rows

    def groups(self, words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of words, and their lattice, by length and in bounded portions."""
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, places in sorted(by_length.items()):
            portion = max(1, _WORDS_AT_ONCE * 8 // (length + 1))
            for at in range(0, len(places), portion):
                some = places[at : at + portion]
                yield np.array(some), self.lattice([words[i] for i in some])


def forward(lattice: np.ndarray, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Scaled sums over all segmentations of each prefix, and the log probability of the word.

    ``table`` has a row per piece, one for the unknown piece and one of zeros, and a column per
    language. Sums of equal scale window are comparable: the last ``width`` are rescaled together.
    """
    n, size, width = lattice.shape
    sums = [np.ones((n, table.shape[1]))]
    logs = np.zeros((n, table.shape[1]))
    for end in range(size):
        total = np.zeros_like(logs)
        for length in range(1, min(width, end + 1) + 1):
            total += sums[end + 1 - length] * table[lattice[:, end, length - 1]]
        sums.append(total)
        if end % _RESCALE == _RESCALE - 1:
            scale = np.maximum(total, 1e-300)
            for k in range(max(0, len(sums) - width), len(sums)):
                sums[k] = sums[k] / scale
            logs += np.log(scale)
    return sums, logs + np.log(np.maximum(sums[-1], 1e-300))


@dataclass
class LanguageModel:
    pieces: list[str]
    languages: list[str]
    table: np.ndarray

    def word_logs(self, segmenter: Segmenter, words: Sequence[str]) -> np.ndarray:
        logs = np.zeros((len(words), len(self.languages)))
        for places, lattice in segmenter.groups(words):
            logs[places] = forward(lattice, self.table)[1]
        return logs


def _table(counts: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts [piece, language]; rows for unknown and for none."""
    overall = counts.sum(axis=1, keepdims=True) + 1e-3
    overall = overall / overall.sum()
    mixed = counts + PRIOR_PIECES * overall
    share = mixed / mixed.sum(axis=0, keepdims=True)
    share = share * (1 - UNKNOWN)
    extra = np.zeros((2, counts.shape[1]))
    extra[0] = UNKNOWN
    return np.concatenate([share, extra])


def expected_counts(
    segmenter: Segmenter, words: list[str], weights: np.ndarray, column: np.ndarray,
    table: np.ndarray,
) -> np.ndarray:
    """Expected piece counts [piece, language] of words, each of one language.

    With the forward sums ``f``, the backward sums ``b`` and a piece of probability ``p`` from
    ``i`` to ``j``, the piece is expected ``f_i p b_j / f_end`` times.
    """
    languages = table.shape[1]
    counts = np.zeros(table.size)
    for places, lattice in segmenter.groups(words):
        n, size, width = lattice.shape
        own = column[places]
        probs = table[lattice, own[:, None, None]]
        ahead = np.zeros((n, size + 1))
        behind = np.zeros((n, size + 1))
        ahead_log, behind_log = np.zeros((n, size + 1)), np.zeros((n, size + 1))
        ahead[:, 0] = behind[:, size] = 1.0
        # Each sum is kept as a fraction with a log scale of its own.
        for end in range(size):
            spans = range(1, min(width, end + 1) + 1)
            base = np.max([ahead_log[:, end + 1 - k] for k in spans], axis=0)
            total = sum(
                ahead[:, end + 1 - k] * np.exp(ahead_log[:, end + 1 - k] - base)
                * probs[:, end, k - 1]
                for k in spans
            )
            ahead[:, end + 1], ahead_log[:, end + 1] = 1.0, base + np.log(np.maximum(total, 1e-300))
        for start in range(size - 1, -1, -1):
            spans = range(1, min(width, size - start) + 1)
            base = np.max([behind_log[:, start + k] for k in spans], axis=0)
            total = sum(
                behind[:, start + k] * np.exp(behind_log[:, start + k] - base)
                * probs[:, start + k - 1, k - 1]
                for k in spans
            )
            behind[:, start] = 1.0
            behind_log[:, start] = base + np.log(np.maximum(total, 1e-300))
        # [word, end, length - 1]: where the piece starts; before the word, nothing does.
        start = np.arange(1, size + 1)[:, None] - np.arange(1, width + 1)
        before = np.where(start >= 0, ahead_log[:, np.maximum(start, 0)], -np.inf)
        share = probs * np.exp(
            before + behind_log[:, 1:, None] - ahead_log[:, size][:, None, None]
        )
        cell = lattice.astype(np.int64) * languages + own[:, None, None]
        counts += np.bincount(
            cell.ravel(), (share * weights[places][:, None, None]).ravel(), table.size
        )
    return counts.reshape(table.shape)


def train(
    df: DataFrame,
    text_column: str = "text",
    language_column: str = "lang",
    *,
    vocabulary: str | Sequence[str] = VOCABULARY,
    rounds: int = ROUNDS,
) -> LanguageModel:
    """Piece probabilities per language, from all rows with text and language."""
    pieces = read_pieces(vocabulary) if isinstance(vocabulary, str) else list(vocabulary)
    narrow = df.select(
        F.col(language_column).cast("string").alias("lang"), F.col(text_column).alias("text")
    ).filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
                held.setdefault(lang, Counter()).update(letter_words(text))
            if sum(map(len, held.values())) > 2 * _CACHED_WORDS:
                yield _word_rows(held)
                held = {}
        yield _word_rows(held)

    words = saved(
        narrow.mapInArrow(count, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    # One row per language.
    languages = sorted(row[0] for row in words.select("lang").distinct().collect())
    if not languages:
        return LanguageModel(pieces, [], np.zeros((len(pieces) + 2, 0)))
    table = _table(np.ones((len(pieces), len(languages))))
    context = df.sparkSession.sparkContext
    number = {lang: i for i, lang in enumerate(languages)}
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        # The table has a row per piece of the vocabulary and a column per language.
        shared = context.broadcast((pieces, table, number))

        def expect(
            batches: Iterator[pa.RecordBatch], shared=shared
        ) -> Iterator[pa.RecordBatch]:
            pieces, table, number = shared.value
            segmenter = Segmenter(pieces)
            counts = np.zeros(table.shape)
            for batch in batches:
                if batch.num_rows:
                    column = np.array([number[lang] for lang in batch.column(0).to_pylist()])
                    counts += expected_counts(
                        segmenter,
                        batch.column(1).to_pylist(),
                        np.asarray(batch.column(2), dtype=float),
                        column,
                        table,
                    )
            piece, lang = np.nonzero(counts[: len(pieces)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(piece, pa.int32()),
                    pa.array(lang, pa.int32()),
                    pa.array(counts[piece, lang], pa.float64()),
                ],
                ["piece", "lang", "n"],
            )

        # Summed as integers, so that the order of summing does not matter.
        found = (
            words.repartition(tasks).mapInArrow(expect, "piece int, lang int, n double")
            .groupBy("piece", "lang")
            .agg(F.sum((F.col("n") * 1e6).cast("long")).alias("n"))
            .collect()
        )
        counts = np.zeros((len(pieces), len(languages)))
        for piece, lang, n in found:
            counts[piece, lang] = n / 1e6
        table = _table(counts)
        shared.unpersist()
    return LanguageModel(pieces, languages, table)


def _word_rows(held: dict[str, Counter]) -> pa.RecordBatch:
    rows = [(lang, word, n) for lang, counts in held.items() for word, n in counts.items()]
    langs, words, counts = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())],
        ["lang", "word", "n"],
    )


class Scorer:
    """Sums of word logs, remembering words seen before up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.segmenter = Segmenter(model.pieces)
        self.known: dict[str, int] = {}
        self.logs = np.empty((0, len(model.languages)))

    def score(self, texts: list[Counter]) -> list[tuple[str, float]]:
        known = self.known
        new = sorted({word for counts in texts for word in counts if word not in known})
        rows = {word: len(known) + i for i, word in enumerate(new)}
        logs = np.concatenate([self.logs[: len(known)], self.model.word_logs(self.segmenter, new)])
        found = [self._one(counts, rows, logs) for counts in texts]
        if len(known) + len(new) <= _CACHED_WORDS:
            known.update(rows)
            self.logs = logs
        return found

    def _one(
        self, counts: Counter, rows: dict[str, int], logs: np.ndarray
    ) -> tuple[str, float]:
        if not counts or not self.model.languages:
            return UNDETERMINED, 0.0
        known = self.known
        places = [known[word] if word in known else rows[word] for word in counts]
        total = np.array(list(counts.values()), dtype=float) @ logs[places]
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


# Scorers of this process, which a worker keeps from task to task; the latest model's only.
_scorers: dict[int, Scorer] = {}


def _scorer(shared: Broadcast[LanguageModel]) -> Scorer:
    key = id(shared.value)
    if key not in _scorers or _scorers[key].model is not shared.value:
        _scorers.clear()
        _scorers[key] = Scorer(shared.value)
    return _scorers[key]


def predict(
    df: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; score is the posterior of the language."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    narrow = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType(
        [
            narrow.schema["doc_id"],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            found: list[tuple[str, float]] = []
            texts: list[Counter] = []
            for text in texts_of(batch, 1):
                texts.append(letter_words(text))
                if len(texts) == 1024:
                    found += scorer.score(texts)
                    texts = []
            found += scorer.score(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([row[0] for row in found], pa.string()),
                    pa.array([min(1.0, max(0.0, row[1])) for row in found], pa.float64()),
                ],
                schema.names,
            )

    return narrow.mapInArrow(scan, schema)

