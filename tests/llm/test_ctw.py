from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialmart.llm import ctw
from trialmart.llm.ctw import GramTable, gram_keys, score_documents, text_bytes, train_bytes
from trialmart.llm.queries import op4_ctw
from trialmart.llm.words import lower_words

TEXTS = ["a b ab", "ab ab a", "Ba\tab", "", None, "b b b b a", "äb"]


def kt(n0, n1):
    """Log probability of n0 zeros and n1 ones, one after the other."""
    total, counts = 0.0, [0, 0]
    for bit in [0] * n0 + [1] * n1:
        total += math.log((counts[bit] + 0.5) / (sum(counts) + 1))
        counts[bit] += 1
    return total


class Plain:
    """Context-tree weighting by its recursive definition."""

    def __init__(self, streams, depth):
        self.depth, self.counts = depth, Counter()
        for stream in streams:
            padded = b"\n" * depth + stream
            for at in range(depth, len(padded)):
                for i in range(8):
                    path = (1 << i) | padded[at] >> (8 - i)
                    bit = padded[at] >> (7 - i) & 1
                    for d in range(depth + 1):
                        self.counts[padded[at - d : at], path, bit] += 1

    def pair(self, context, path):
        return self.counts[context, path, 0], self.counts[context, path, 1]

    def weighted(self, context, path):
        own = kt(*self.pair(context, path))
        if len(context) == self.depth:
            return own
        below = sum(
            self.weighted(bytes([b]) + context, path)
            for b in range(256)
            if sum(self.pair(bytes([b]) + context, path))
        )
        high = max(own, below)
        return math.log(0.5) + high + math.log(math.exp(own - high) + math.exp(below - high))

    def one(self, history, path):
        total, weight, known = 0.0, 1.0, 0.5
        for d in range(self.depth + 1):
            context = history[len(history) - d :]
            n0, n1 = self.pair(context, path)
            if not n0 + n1:
                break
            known = (n1 + 0.5) / (n0 + n1 + 1)
            share = 1.0
            if d < self.depth:
                share = math.exp(math.log(0.5) + kt(n0, n1) - self.weighted(context, path))
            total += weight * share * known
            weight *= 1 - share
        return total + weight * known

    def score(self, stream):
        padded, total = b"\n" * self.depth + stream, 0.0
        for at in range(self.depth, len(padded)):
            for i in range(8):
                path = (1 << i) | padded[at] >> (8 - i)
                p = self.one(padded[at - self.depth : at], path)
                total += math.log10(p if padded[at] >> (7 - i) & 1 else 1 - p)
        return total


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_scores_equal_the_recursive_definition(llm, depth):
    df = llm.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    found = score_documents(df, trains=F.col("doc_id") != 2, depth=depth)
    streams = [text_bytes(lower_words(text)) for text in TEXTS]
    plain = Plain(streams[:2] + streams[3:], depth)
    got = {row["doc_id"]: row["score"] for row in found.collect()}
    for i, stream in enumerate(streams):
        assert got[i] == pytest.approx(plain.score(stream), rel=1e-5)


@pytest.mark.parametrize("max_nodes", [1, 20, 100])
def test_nodes_that_are_not_broadcast_are_looked_up(llm, max_nodes):
    df = llm.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    found = score_documents(df, trains=F.col("doc_id") != 2, depth=2, max_nodes=max_nodes)
    streams = [text_bytes(lower_words(text)) for text in TEXTS]
    plain = Plain(streams[:2] + streams[3:], 2)
    for row in found.collect():
        assert row["score"] == pytest.approx(plain.score(streams[row["doc_id"]]), rel=1e-5)


def test_base_and_counts_equal_brute_force_however_words_are_looked_up(llm, small):
    docs = llm.read.parquet(f"{small}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in docs}
    counts = Counter()
    for row in docs:
        if not held[row["doc_id"]]:
            counts.update(lower_words(row["text"]) + [b"\n"])
    total, types = sum(counts.values()), len(counts)
    want = {}
    for row in docs:
        tokens = lower_words(row["text"]) + [b"\n"]
        base = sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in tokens)
        known = sum(counts[t] > 0 for t in tokens)
        want[row["doc_id"]] = (held[row["doc_id"]], len(tokens), known, total, base)
    df = llm.read.parquet(f"{small}/documents.parquet")
    few = score_documents(
        df, trains=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, depth=1,
        max_hot_words=20,
    ).withColumn("held_out", ~F.col("trains"))
    for found in (op4_ctw(llm, small), few):
        rows = found.collect()
        assert len(rows) == len(docs)
        for row in rows:
            *exact, base = want[row["doc_id"]]
            got = [row[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens")]
            assert got == exact
            assert row["base_score"] == pytest.approx(base, rel=1e-9)


def test_model_beats_the_base_on_held_out_documents(llm):
    sf_dir = "/root/testdata/sf0.1"
    row = op4_ctw(llm, sf_dir).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_probabilities_of_a_byte_sum_to_one(llm):
    df = llm.createDataFrame([(t,) for t in TEXTS], "text string")
    model = train_bytes(df, depth=2, max_nodes=200)
    grams = np.array([0x6120 << 8 | b for b in range(256)], dtype=np.uint64)
    assert (10 ** model.gram_logs(grams)).sum() == pytest.approx(1, abs=1e-6)


def test_grams_of_streams_do_not_run_into_each_other():
    keys, starts = gram_keys([b"ab\n", b"c\n"], 2)
    assert [int(k).to_bytes(3, "big") for k in keys] == [
        b"\n\na", b"\nab", b"ab\n", b"\n\nc", b"\nc\n",
    ]
    assert starts.tolist() == [0, 3]


def test_awkward_rows(awkward):
    found = score_documents(awkward, trains=F.col("doc_id") > 1, depth=2).cache()
    assert found.count() == awkward.count()
    assert found.filter("score IS NULL OR base_score IS NULL OR score > 0").count() == 0
    assert {r["n_tokens"] for r in found.filter("doc_id IN (3, 4, 7)").collect()} == {1}
    nothing = score_documents(awkward, trains=F.lit(False), depth=1)
    assert {r["train_tokens"] for r in nothing.collect()} == {0}
    assert score_documents(awkward.limit(0), trains=F.lit(True)).count() == 0


def test_rows_stored_grow_with_words_and_grams_not_with_nodes(llm, monkeypatch):
    stored = []
    saved = ctw.saved

    def counted(df):
        stored.append(saved(df))
        return stored[-1]

    monkeypatch.setattr(ctw, "saved", counted)
    df = llm.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    assert score_documents(df, trains=F.lit(True), depth=3).count() == len(TEXTS)
    words = [lower_words(text) for text in TEXTS]
    grams = set(gram_keys([text_bytes(w) for w in words], 3)[0].tolist())
    types = len({w for one in words for w in one}) + 1
    assert sum(df.count() for df in stored) <= types + 2 * len(grams) + len(TEXTS)


@pytest.mark.parametrize("max_nodes", [3, 1000])
def test_grams_of_held_out_rows_alone_are_scored(llm, max_nodes):
    df = llm.createDataFrame([(0, "ab ab b"), (1, "zab q"), (2, "ba")], "doc_id int, text string")
    found = score_documents(df, trains=F.col("doc_id") != 1, depth=2, max_nodes=max_nodes)
    plain = Plain([b"ab ab b\n", b"ba\n"], 2)
    got = {row["doc_id"]: row["score"] for row in found.collect()}
    assert got[1] == pytest.approx(plain.score(b"zab q\n"), rel=1e-5)


def test_portions_do_not_part_subtrees(monkeypatch):
    monkeypatch.setattr(ctw, "_LEAVES_AT_ONCE", 3)
    under = [1, 1, 2, 2, 2, 2, 2, 2, 3, 4, 4, 5]
    rows = pa.record_batch(
        [pa.array(under, pa.int32()), pa.array(range(12)), pa.array([1] * 12)],
        ["under", "gram", "n"],
    )
    parts = [gram.tolist() for gram, _ in ctw._subtrees(rows.slice(i, 2) for i in range(0, 12, 2))]
    assert len(parts) > 1
    assert sum(parts, []) == list(range(12))
    held = [{under[gram] for gram in part} for part in parts]
    assert sum(map(len, held)) == len(set(under))
    assert list(ctw._subtrees(iter([]))) == []


@pytest.mark.parametrize("n", [0, 1, 5, 5000])
def test_gram_table_finds_all_and_nothing_else(n):
    grams = np.random.default_rng(n).choice(1 << 40, 2 * n, replace=False).astype(np.uint64)
    logs = -np.arange(1, n + 1, dtype=float)
    found, known = GramTable(grams[:n], logs).find(grams)
    assert known.tolist() == [True] * n + [False] * n
    assert found.tolist() == logs.tolist() + [0.0] * n
