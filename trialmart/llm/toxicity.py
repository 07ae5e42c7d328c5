"""Toxicity after noisy-channel deobfuscation.

Every word that is not plain letters, or that has a doubled letter, is decoded: the lattice of what
its characters may stand for (look-alike letters, repeated letters, characters put in between) is
searched by Viterbi under a character language model learned from the corpus. Runs of single
characters are joined and decoded as one word and, with the gaps as possible word breaks, as several;
wide gaps also split them. The restored words are scored by a logistic regression over all those
words and beginnings of words (for inflected and compound forms) that are in enough toxic documents and
tell them from other labelled ones.

Defined results: null and empty texts get the score of a text without any telling word; without
labels of both kinds every text gets the share of toxic labels (0 without labels); rows without
label or id teach no label; repeated rows get equal scores; an empty table gives no rows; long texts
are scored whole; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmart.llm.labelled import MAX_LABELLED, label_sample, sigmoid, sparse_logistic
from trialmart.llm.scratch import saved
from trialmart.llm.words import texts_of

THRESHOLD = 0.3
# How much more often a telling word must be in toxic documents than in others.
MIN_RATIO = 5
# Lengths of beginnings of words that may tell; they are written with a mark in front.
BEGINNINGS = (4, 5, 6, 7)
# In how many toxic documents one must be.
MIN_DOCUMENTS = 3
# Least evidence, in nats, that its share among toxic documents is no chance: the log-likelihood
# ratio of its two shares against one for both. Eight nats come by chance once in 16,000 words.
MIN_GAIN = 8.0
# One in so many clean documents is asked first: a word that is too frequent there already is out.
# Below MIN_RATIO, so that words equally frequent in both are.
FIRST_CLEAN = 4
PENALTY = 0.3

# What characters may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e",
    "£": "l", "¡": "i", "§": "s", "¥": "y",
}
# Costs in nats of the channel's errors.
LOOK_ALIKE_COST = 1.5
REPEAT_COST = 0.7
INSERT_COST = 2.0

_SYMBOLS = 28
_EDGE, _OTHER = 0, 27
_PLAIN = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_REPEATS = re.compile(r"(.)\1+")
_WIDE = re.compile(r"[ \t]{2,}|\t")
_SINGLES = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}")
# A plain word, perhaps with marks after it that stand for no letter.
_PLAIN_ENDED = re.compile(r"([^\W\d_]+)[.,;:?*#%&)\]'\"-]*")
# The same with any marks.
_LETTERS_ENDED = re.compile(r"([^\W\d_]+)[^\w\s]*")
_CACHED_WORDS = 200_000
_KNOWN_TOKENS = 1_000_000
_CHARACTERS_AT_ONCE = 1 << 20


def _class_table() -> bytes:
    # Letters 1 to 26 whatever their case, lead bytes of other characters 27, the rest is an edge.
    table = bytearray(256)
    for i in range(26):
        table[65 + i] = table[97 + i] = i + 1
    for i in range(0xC0, 256):
        table[i] = _OTHER
    return bytes(table)


_CLASSES = _class_table()
_CONTINUATION = bytes(range(0x80, 0xC0))


def symbol(character: str) -> int:
    return _CLASSES[character.encode("utf-8", "replace")[0]]


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of three successive symbols, edges of words included.

    Texts joined by two line feeds are counted like each by itself.
    """
    raw = (text or "").encode("utf-8", "replace").translate(_CLASSES, _CONTINUATION)
    s = np.frombuffer(b"\0\0" + raw + b"\0", dtype=np.uint8).astype(np.int32)
    cell = (s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:]
    return np.bincount(cell, minlength=_SYMBOLS**3)


def character_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(third | first, second), interpolated with shorter contexts."""
    three = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(float).copy()
    # Edges that follow edges say nothing about words.
    three[_EDGE, _EDGE, _EDGE] = 0
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + _SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3)


@lru_cache(maxsize=1 << 16)
def _channel(character: str) -> tuple[bool, tuple[tuple[int, str, float], ...]]:
    """Whether a character is a letter; symbol, letter and cost of all it may stand for."""
    letter = symbol(character) != _EDGE
    options = [(character, 0.0)] if letter else []
    options += [(c, LOOK_ALIKE_COST) for c in LOOK_ALIKES.get(character, "")]
    return letter, tuple((symbol(meant), meant, extra) for meant, extra in options)


def decode(token: str, costs, breaks: bool = False) -> str:
    """The likeliest intended word of a lower-cased token, over its whole lattice.

    costs: of a symbol after two others, as an array or nested lists. With ``breaks`` words may also
    end between characters; they are parted by spaces.
    """
    # State: last two symbols and the last character as it was written, so there are no more than
    # 28 * 28 for each distinct character -> cost, word so far as a chain of letters.
    states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {
        (_EDGE, _EDGE, ""): (0.0, None)
    }
    for character in token:
        letter, options = _channel(character)
        sources = list(states.items())
        if breaks:
            ended: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            for (first, second, _), (cost, word) in sources:
                if second:
                    state, total = (second, _EDGE, ""), cost + costs[first][second][_EDGE]
                    if state not in ended or total < ended[state][0]:
                        ended[state] = total, (word, " ")
            sources += ended.items()
        after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        known = after.get
        for state, (cost, word) in sources:
            first, second, written = state
            following = costs[first][second]
            for s, meant, extra in options:
                total, reached = cost + (extra + following[s]), (second, s, character)
                before = known(reached)
                if before is None or total < before[0]:
                    after[reached] = total, (word, meant)
            if second and written == character:
                total, before = cost + REPEAT_COST, known(state)
                if before is None or total < before[0]:
                    after[state] = total, word
            if not letter:
                # The character before it may still be repeated.
                total, before = cost + INSERT_COST, known(state)
                if before is None or total < before[0]:
                    after[state] = total, word
        states = after
    total, word = min(
        ((cost + costs[first][second][_EDGE], word)
         for (first, second, _), (cost, word) in states.items()),
        key=lambda end: end[0],
    )
    letters = []
    while word:
        word, meant = word
        letters.append(meant)
    return "".join(reversed(letters))


def readings(word: str, costs) -> tuple[str, ...]:
    """A word of letters as it is, and its decoding if a letter is doubled."""
    if not _DOUBLE.search(word):
        return (word,)
    return tuple(dict.fromkeys((word, decode(word, costs))))


def restored(token: str, costs) -> tuple[str, ...]:
    """Words a lower-cased token may be meant as: its letters if plain, else also the decoding."""
    if token.isalpha() and not _RUN.search(token):
        return readings(token, costs)
    plain = _PLAIN_ENDED.fullmatch(token)
    if plain and not _RUN.search(plain[1]):
        return readings(plain[1], costs)
    core = token.strip("".join(c for c in set(token) if not c.isalnum()))
    if _PLAIN.fullmatch(core) and not _RUN.search(core):
        edges = token.replace(core, "", 1)
        if not any(c in LOOK_ALIKES for c in edges):
            return readings(core, costs)
        return tuple(dict.fromkeys((*readings(core, costs), decode(token, costs))))
    if not any(c.isalpha() or c in LOOK_ALIKES for c in token):
        return ()
    return tuple(dict.fromkeys(filter(None, (decode(token, costs), decode(core, costs)))))


class Restorer:
    """Sets of restored words of texts and their beginnings, remembering tokens seen before."""

    def __init__(self, costs: np.ndarray, wanted: frozenset[str] | None = None):
        self.wanted = wanted
        # Most words begin like no wanted one, nor do they once repeated letters are dropped.
        self.heads = wanted and {word.removeprefix("^")[: BEGINNINGS[0]] for word in wanted}
        self.flat_heads = wanted and {_REPEATS.sub(r"\1", head) for head in self.heads}
        self.words = lru_cache(maxsize=_CACHED_WORDS)(self._words)
        self.parted = lru_cache(maxsize=_CACHED_WORDS)(self._parted)
        # Tokens known to restore to nothing wanted, which are most.
        self.nothing: set[str] = set()
        # Nested lists are read faster than an array's single cells.
        self.costs = costs.tolist()

    def _may_tell(self, token: str) -> bool:
        """Whether a token can be meant as a word that begins like a wanted one.

        Letters at its beginning are kept, but for repeats, whatever the marks after them stand for.
        """
        plain, word = True, token
        if not token.isalpha():
            plain = _PLAIN_ENDED.fullmatch(token)
            ended = plain or _LETTERS_ENDED.fullmatch(token)
            if not ended:
                return True
            word = ended[1]
        if _DOUBLE.search(word):
            flat = _REPEATS.sub(r"\1", word)
            # Marks may stand for more letters where these are too few.
            if not plain and len(flat) < BEGINNINGS[0]:
                return True
            return any(flat[:k] in self.flat_heads for k in range(1, BEGINNINGS[0] + 1))
        if not plain and len(word) < BEGINNINGS[0]:
            return True
        return word[: BEGINNINGS[0]] in self.heads

    def _words(self, token: str) -> tuple[str, ...]:
        if self.heads is not None and not self._may_tell(token):
            return ()
        found = restored(token, self.costs)
        if self.heads is not None:
            found = tuple([w for w in found if w[: BEGINNINGS[0]] in self.heads])
            if not found:
                return found
        found += tuple(["^" + w[:k] for w in found for k in BEGINNINGS if len(w) > k])
        if self.wanted is not None:
            found = tuple([word for word in found if word in self.wanted])
        return found

    def _parted(self, run: str) -> list[str]:
        """Words of joined single characters, the gaps between them taken as possible breaks."""
        return decode(run, self.costs, breaks=True).split()

    def restore(self, text: str | None) -> set[str]:
        if not text:
            return set()
        lower = text.lower()
        tokens = set(lower.split())
        for run in _SINGLES.findall(lower):
            parts = ["".join(part.split()) for part in _WIDE.split(run)]
            for joined in {"".join(parts), *parts}:
                tokens.add(joined)
                tokens.update(self.parted(joined))
        found: set[str] = set()
        for token in tokens - self.nothing:
            words = self.words(token)
            if words:
                found.update(words)
            else:
                self.nothing.add(token)
        if len(self.nothing) > _KNOWN_TOKENS:
            self.nothing.clear()
        return found


@dataclass
class ToxicityModel:
    costs: np.ndarray
    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.array([-35.0]))

    def score(self, present: set[str]) -> float:
        known = self.by_word
        return float(sigmoid(
            self.weights[0] + sum(known[word] for word in sorted(present) if word in known)
        ))

    @cached_property
    def by_word(self) -> dict[str, float]:
        return dict(zip(self.words, self.weights[1:].tolist(), strict=True))


def character_model(df: DataFrame, text_column: str = "text") -> np.ndarray:
    """Costs of the character language model, learned from all rows of ``df``."""
    narrow = df.select(F.col(text_column).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, dtype=np.int64)
        held: list[str] = []
        size = 0
        for batch in batches:
            for text in filter(None, texts_of(batch, 0)):
                held.append(text)
                size += len(text)
                if size > _CHARACTERS_AT_ONCE:
                    total += trigram_counts("\n\n".join(held))
                    held, size = [], 0
        total += trigram_counts("\n\n".join(held))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell, pa.int32()), pa.array(total[cell], pa.int64())], ["cell", "n"]
        )

    counts = np.zeros(_SYMBOLS**3, dtype=np.int64)
    # At most 28 ** 3 rows.
    rows = narrow.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for cell, n in rows.collect():
        counts[cell] = n
    return character_costs(counts)


def train(
    df: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    *,
    max_labelled: int = MAX_LABELLED,
) -> ToxicityModel:
    """Learn from the rows of ``df``, and from the labels of those that have one.

    The character model covers all rows. The classifier is fitted on at most ``max_labelled``
    labelled rows, chosen by hash.
    """
    spark = df.sparkSession
    costs = spark.sparkContext.broadcast(character_model(df, text_column))
    sample = F.broadcast(label_sample(labels, id_column, label_column, max_labelled))
    known = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(
        sample, F.col("doc_id") == F.col("label_id")
    ).select("label_id", "label", "text")

    # The two totals need no text: the scan reads ids alone.
    totals = known.agg(
        F.count_if(F.col("label") <= 0).alias("clean"), F.count_if(F.col("label") > 0).alias("toxic")
    ).first()
    clean, toxic = float(totals["clean"]), float(totals["toxic"])
    if not clean and not toxic:
        return ToxicityModel(costs.value)
    if not clean or not toxic:
        edge = 35.0 if toxic else -35.0
        return ToxicityModel(costs.value, [], np.array([edge]))
    # A telling word is in toxic documents, and its share there exceeds that of any part of the
    # others by far.
    of_toxic = _document_counts(known.filter("label > 0"), costs)
    candidates = {
        row["word"]: row["n"] for row in of_toxic.filter(f"n >= {MIN_DOCUMENTS}").collect()
    }
    first = known.filter((F.col("label") <= 0) & (F.pmod(F.xxhash64("label_id"), F.lit(FIRST_CLEAN)) == 0))
    for word, n in _document_counts(first, costs, frozenset(candidates)).collect():
        if candidates[word] / toxic <= MIN_RATIO * n / clean:
            del candidates[word]
    wanted = frozenset(candidates)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs.value, wanted)
        for batch in batches:
            found = [sorted(restorer.restore(text)) for text in texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.string()))], ["label", "found"]
            )

    texts = known.select("label", "text")
    examples = saved(texts.mapInArrow(sets, "label int, found array<string>"))
    words = examples.filter("label <= 0").select(F.explode("found").alias("word"))
    # No more rows than candidates, which are words of the sample's toxic documents.
    in_clean = dict(words.groupBy("word").agg(F.count("*").alias("n")).collect())
    telling = sorted(
        word for word, n in candidates.items() if _tells(n, in_clean.get(word, 0), toxic, clean)
    )
    if not telling:
        share = np.log(toxic / clean)
        return ToxicityModel(costs.value, [], np.array([share]))
    told = F.filter("found", lambda word: word.isin(telling))
    rows = (
        examples.groupBy(told.alias("found"))
        .agg(F.count_if(F.col("label") > 0).alias("ones"), F.count("*").alias("n"))
        .orderBy("found")
        .collect()
    )
    place = {word: i for i, word in enumerate(telling)}
    present = [[place[word] for word in row["found"]] for row in rows]
    ones = np.array([row["ones"] for row in rows], dtype=float)
    zeros = np.array([row["n"] for row in rows], dtype=float) - ones
    weights = sparse_logistic(present, len(telling), ones, zeros, PENALTY)
    return ToxicityModel(costs.value, telling, weights)


def _tells(in_toxic: int, in_clean: int, toxic: float, clean: float) -> bool:
    """Whether a word in so many toxic and clean documents tells them apart."""
    if in_toxic / toxic <= MIN_RATIO * in_clean / clean:
        return False
    rate = (in_toxic + in_clean) / (toxic + clean)
    gain = in_toxic * np.log(in_toxic / (toxic * rate))
    if in_clean:
        gain += in_clean * np.log(in_clean / (clean * rate))
    return gain >= MIN_GAIN


def _document_counts(texts: DataFrame, costs, wanted: frozenset[str] | None = None) -> DataFrame:
    """``word, n``: in how many of the texts each restored word, or each wanted one, is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs.value, wanted)
        held: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch, 0):
                held.update(restorer.restore(text))
            if len(held) > 2 * _CACHED_WORDS:
                yield _count_rows(held)
                held = Counter()
        yield _count_rows(held)

    rows = texts.select("text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _count_rows(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
    )


def toxicity(
    df: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, score, telling`` for every row: telling restored words that were found."""
    # 28 ** 3 costs, and words of the labelled sample.
    shared = df.sparkSession.sparkContext.broadcast(model)
    narrow = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType(
        [
            narrow.schema["doc_id"],
            T.StructField("score", T.DoubleType()),
            T.StructField("telling", T.ArrayType(T.StringType())),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restorer = Restorer(model.costs, frozenset(model.words))
        for batch in batches:
            found = [restorer.restore(text) for text in texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([model.score(words) for words in found], pa.float64()),
                    pa.array([sorted(words) for words in found], pa.list_(pa.string())),
                ],
                schema.names,
            )

    return narrow.mapInArrow(scan, schema)
