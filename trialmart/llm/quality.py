"""Quality classifier: document evidence combined with site posteriors by empirical Bayes.

A logistic regression over binned traits of the text gives each document's evidence. Sites have two
levels, host and path. Each document adds its label, or with less weight its evidence, to its
host and path; a host's share of good documents is shrunk toward the global share, a path's toward
its host's, by as much as the spread between sites says. A document's own part is taken out of the
posteriors that judge it. Everything is gathered by grouping.

Defined results: null and empty texts have the traits of an empty text; null host and path are a
site of their own; a site with no other document gets the posterior above it; without labels of
both kinds the evidence is the share of good labels (0.5 without any); rows without id teach no
label; repeated rows are scored alike, and each counts for its site; an empty table gives no
rows; long texts are judged whole; other columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmart.llm.labelled import MAX_LABELLED, label_sample, logistic, sigmoid
from trialmart.llm.rules import NAVIGATION, SYMBOLS, repeated_words
from trialmart.llm.scratch import join_frequent, saved
from trialmart.llm.words import texts_of

# Sites with over one in so many of all documents are looked up in place; there cannot be more.
FREQUENT_SITES = 1000
THRESHOLD = 0.5
# Weight of a document without label in the counts of its site; a label counts 1.
SOFT_WEIGHT = 0.25
PENALTY = 1.0
# Bounds of the strength of shrinking, in documents.
STRENGTH = (2.0, 1e4)

_EDGES = {
    "words": (10, 50, 200, 1000),
    "word_length": (3.5, 4.5, 5.5, 7.0, 9.0),
    "symbols": (0.001, 0.01, 0.05, 0.2),
    "navigation": (0.001, 0.02, 0.1, 0.3),
    "shouted": (0.001, 0.02, 0.1, 0.5),
    "capitals": (0.02, 0.05, 0.2, 0.5),
    "digits": (0.001, 0.02, 0.1, 0.3),
    "distinct": (0.1, 0.3, 0.5, 0.7),
    "repeated_lines": (0.001, 0.1, 0.3, 0.6),
    "repeated_words": (0.001, 0.05, 0.2, 0.5),
    "ended_lines": (0.1, 0.5, 0.9),
    "largest_word": (0.05, 0.1, 0.2, 0.4),
}
TRAITS = tuple(_EDGES)
_BINS = {name: len(edges) + 1 for name, edges in _EDGES.items()}
_WIDTH = sum(_BINS.values())


def traits(text: str | None) -> dict[str, float]:
    """Counts and shares a document is judged by."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    characters = max(1, sum(map(len, words)))
    lines = [line for line in text.split("\n") if line.strip()]
    counts = Counter(words)
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    return {
        "words": len(words),
        "word_length": characters / n if words else 0.0,
        "symbols": sum(text.count(c) for c in SYMBOLS) / characters,
        "navigation": sum(counts[c] for c in NAVIGATION) / n,
        "shouted": (text.count("!!") + text.count("??")) / n,
        "capitals": capitals / characters,
        "digits": sum(text.count(c) for c in "0123456789") / characters,
        "distinct": len(counts) / n,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "repeated_words": repeated_words(words) / n,
        "ended_lines": sum(line.rstrip()[-1] in ".!?:;\"'" for line in lines) / max(1, len(lines)),
        "largest_word": max(counts.values(), default=0) / n,
    }


def bins(text: str | None) -> list[int]:
    """The bin of each trait."""
    found = traits(text)
    return [sum(found[name] >= edge for edge in _EDGES[name]) for name in TRAITS]


def _one_hot(rows: np.ndarray) -> np.ndarray:
    offsets = np.cumsum([0, *list(_BINS.values())[:-1]])
    x = np.zeros((len(rows), _WIDTH))
    x[np.arange(len(rows))[:, None], rows + offsets] = 1.0
    return x


@dataclass
class QualityModel:
    """Weights of every bin of every trait, and the intercept."""

    weights: np.ndarray

    def evidence(self) -> F.Column:
        """Probability of good quality as an expression of the column ``bins``."""
        total, at = F.lit(float(self.weights[0])), 1
        for i, name in enumerate(TRAITS):
            own = [float(w) for w in self.weights[at : at + _BINS[name]]]
            at += _BINS[name]
            total = total + F.element_at(
                F.array(*map(F.lit, own)), F.element_at("bins", i + 1) + 1
            )
        return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), total))))


def document_bins(
    df: DataFrame, id_column: str, text_column: str, host: F.Column, path: F.Column
) -> DataFrame:
    """``doc_id, host, path, bins`` for every row: all that is kept of the texts."""
    narrow = df.select(
        F.col(id_column).alias("doc_id"),
        host.cast("string").alias("host"),
        path.cast("string").alias("path"),
        F.col(text_column).alias("text"),
    )
    schema = T.StructType(
        [*narrow.schema.fields[:3], T.StructField("bins", T.ArrayType(T.IntegerType()))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bins(text) for text in texts_of(batch, 3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], schema.names
            )

    return narrow.mapInArrow(scan, schema)


def fit(examples: DataFrame) -> QualityModel:
    """Fit on ``bins, label``. Equal examples are grouped first; the sample is bounded."""
    rows = (
        examples.groupBy("bins")
        .agg(F.sum("label").alias("ones"), F.count("*").alias("n"))
        .orderBy("bins")
        .collect()
    )
    weights = np.zeros(_WIDTH + 1)
    if rows:
        ones = np.array([row["ones"] for row in rows], dtype=float)
        zeros = np.array([row["n"] for row in rows], dtype=float) - ones
        if ones.sum() and zeros.sum():
            x = _one_hot(np.array([row["bins"] for row in rows]))
            weights = logistic(x, ones, zeros, PENALTY)
        else:
            weights[0] = 35.0 if ones.sum() else -35.0
    return QualityModel(weights)


def _strength(sites: DataFrame, mean: float) -> float:
    """How many documents the prior of a site is worth, from the spread between sites.

    By moments: the spread of shares beyond what chance gives is m (1 - m) / (strength + 1).
    """
    row = sites.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("sites"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, 2)).alias("spread"),
    ).first()
    chance = mean * (1 - mean)
    if not row["n"] or chance <= 0:
        return STRENGTH[1]
    beyond = row["spread"] / row["n"] - chance * row["sites"] / row["n"]
    return float(np.clip(chance / max(beyond, 1e-9) - 1, *STRENGTH))


def quality(
    df: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    *,
    host: F.Column | None = None,
    path: F.Column | None = None,
    teaches: F.Column | None = None,
    threshold: float = THRESHOLD,
    soft_weight: float = SOFT_WEIGHT,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``doc_id, evidence, host_posterior, path_posterior, score, kept`` for every row.

    ``host`` and ``path`` are expressions of ``df``; by default its column ``source``, and that
    with ``lang``. ``teaches`` says of which ids labels may be used. Texts are read once.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    docs = saved(document_bins(df, id_column, text_column, host, path))
    sample = label_sample(labels, id_column, label_column, max_labelled)
    if teaches is not None:
        sample = sample.withColumn(id_column, F.col("label_id")).filter(teaches)
    sample = F.broadcast(sample.select("label_id", "label"))
    labelled = docs.join(sample, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    model = fit(labelled.filter("label IS NOT NULL"))
    weight = F.when(F.col("label").isNull(), F.lit(soft_weight)).otherwise(F.lit(1.0))
    # Null names must not meet names that are empty, and joins on null find nothing.
    names = [
        F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("-")).alias(name)
        for name in ("host", "path")
    ]
    judged = saved(
        labelled.withColumn("evidence", model.evidence()).select(
            "doc_id", *names, "evidence", weight.alias("w"),
            (weight * F.coalesce(F.col("label").cast("double"), F.col("evidence"))).alias("g"),
        )
    )
    counts = [F.sum("w").alias("n"), F.sum("g").alias("good")]
    paths = saved(judged.groupBy("host", "path").agg(*counts, F.count("*").alias("documents")))
    hosts = saved(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    mean = float((total[1] + 0.5) / (total[0] + 1)) if total[0] else 0.5
    of_host, of_path = _strength(hosts, mean), _strength(paths, mean)
    sites = paths.join(
        hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host"
    )
    documents = sites.agg(F.sum("documents")).first()[0] or 0
    often = F.col("documents") * FREQUENT_SITES > documents
    rows = join_frequent(judged, sites, ["host", "path"], often)
    host_posterior = (F.col("host_good") - F.col("g") + of_host * mean) / (
        F.col("host_n") - F.col("w") + of_host
    )
    rows = rows.withColumn("host_posterior", host_posterior)
    path_posterior = (F.col("good") - F.col("g") + of_path * F.col("host_posterior")) / (
        F.col("n") - F.col("w") + of_path
    )
    rows = rows.withColumn("path_posterior", path_posterior)
    odds = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    score = 1 / (1 + F.exp(-odds))
    return rows.withColumn("score", score).select(
        "doc_id", "evidence", "host_posterior", "path_posterior", "score",
        (F.col("score") >= threshold).alias("kept"),
    )


def _logit(p: F.Column) -> F.Column:
    inside = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.ln(inside / (1 - inside))


def reference_evidence(model: QualityModel, text: str | None) -> float:
    """The evidence of one text, computed directly."""
    x = _one_hot(np.array([bins(text)]))
    return float(sigmoid(model.weights[0] + x @ model.weights[1:])[0])
