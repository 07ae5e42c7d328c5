from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmart.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, score string, slot int, key long"


def brute(rows, scale=1, positives=5, count=10, low=30, high=90):
    """By the definition, with Python's integers."""
    taking = []
    for id_, vector, label, *_ in rows:
        if label is not None and vector is not None:
            if all(x is not None and math.isfinite(x) for x in vector):
                taking.append((id_, [math.floor(scale * x) for x in vector], label))
    found = []
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    order = lambda pair: (-pair[0], pair[1] is None, pair[1] or 0)
    for i, (id_, vector, label) in enumerate(taking):
        if id_ is None or id_ % 100:
            continue
        scores = [clip(sum(x * y for x, y in zip(vector, v, strict=False))) for _, v, _ in taking]
        same = [(scores[j], row[0]) for j, row in enumerate(taking) if j != i and row[2] == label]
        other = [(scores[j], row[0]) for j, row in enumerate(taking) if row[2] != label]
        for score, positive in sorted(same, key=order)[:positives]:
            fits = [o for o in other if low * score <= 100 * o[0] <= high * score]
            for rank, (s, negative) in enumerate(sorted(fits, key=order)[:count], 1):
                found.append((id_, positive, rank, negative, score, s))
    return sorted(found, key=str)


def mined(llm, rows, **options):
    df = llm.createDataFrame([(*row, "x", 1, 2) for row in rows], SCHEMA)
    found = negatives.hard_negatives(df, anchor=F.col("vec_id") % 100 == 0, **options)
    return sorted(map(tuple, found.collect()), key=str)


@pytest.fixture
def tiny_buckets(monkeypatch):
    """The rows of the small cases spread over many buckets, cells and blocks."""
    for name, value in {"BUCKET_ROWS": 16, "LEAST_ROWS": 4, "CELL_BUCKETS": 3, "BLOCK_ANCHORS": 2}.items():
        monkeypatch.setattr(negatives, name, value)


def vectors(count, dims, spread, seed=1):
    """Skewed directions of very different lengths, so that buckets and coordinates prune."""
    chance = np.random.default_rng(seed)
    v = chance.normal(size=(count, dims)) ** 3
    v *= np.exp(chance.normal(size=(count, 1)) * spread)
    return [(i, row.tolist(), int(chance.integers(3))) for i, row in enumerate(v)]


@pytest.mark.parametrize(("dims", "spread", "scale"), [(6, 0, 100), (6, 1.5, 50), (2, 0.5, 300), (1, 1, 9)])
def test_equals_brute_force(llm, tiny_buckets, dims, spread, scale):
    rows = vectors(500, dims, spread)
    assert mined(llm, rows, scale=scale) == brute(rows, scale)


def test_other_counts_and_shares(llm, tiny_buckets):
    rows = vectors(300, 5, 0.7, seed=4)
    options = {"positives": 2, "negatives": 3, "low": 50, "high": 77}
    assert mined(llm, rows, scale=30, **options) == brute(rows, 30, 2, 3, 50, 77)


def test_ties_copies_and_zero_vectors(llm, tiny_buckets):
    chance = random.Random(3)
    rows = [(i, [float(chance.randint(-1, 1)) for _ in range(3)], chance.randint(0, 1))
            for i in range(200)]
    # A repeated anchor, copies of an anchor under other ids, and one id with several vectors.
    rows += [rows[100]] * 2 + [(900 + i, rows[0][1], rows[0][2]) for i in range(30)]
    rows += [(0, [1.0, 1.0, 1.0], 0), (0, [1.0, 1.0, 1.0], 1), (None, [1.0, 1.0, 0.0], 0)]
    rows += [(None, [1.0, 1.0, 0.0], 1)] * 3 + [(200, [0.0] * 3, 0), (201, [0.0] * 3, 0)]
    assert mined(llm, rows) == brute(rows)


def test_awkward_vectors(llm):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (1, [2.0, 2.0], 1), (2, [1.0], 0), (3, [1.0, 1.0, 5.0], 0), (4, [], 0),
        (5, None, 0), (6, [1.0, None], 0), (7, [nan, 1.0], 0), (8, [1.0, inf], 0), (9, [9.0, 9.0], None),
        (100, [], 1), (200, [3.0], None), (300, None, 1), (400, [5.0, 5.0], 7), (-100, [1.0, 1.0], 0),
    ]
    assert mined(llm, rows) == brute(rows)
    assert mined(llm, []) == []
    assert mined(llm, [(0, [1.0], 1)]) == []


def test_scores_beyond_floating_point(llm):
    chance = random.Random(8)
    for top in (1 << 31, 1 << 40):
        rows = [(i, [float(chance.randrange(-top, top)) for _ in range(3)], i % 2)
                for i in range(120)]
        assert mined(llm, rows) == brute(rows)


def test_pruning_leaves_out_work_and_no_row(monkeypatch):
    """Focus coordinates rule out most of a bucket once the limit is known."""
    rows = vectors(negatives.BUCKET_ROWS, 8, 0, seed=2)
    # A bucket's vectors are of about one length.
    rows = [(i, (np.array(v) * 9 / np.linalg.norm(v)).tolist(), label) for i, v, label in rows]
    packed = [{"id": i, "label": label, "code": "<f8", "vector": np.floor(np.array(v) * 99).tobytes()}
              for i, v, label in rows]
    bucket = negatives._Bucket(negatives._bucket(packed))
    verified = []
    original = negatives._products
    monkeypatch.setattr(
        negatives, "_products",
        lambda a, b, exact: verified.append(len(a) * len(b)) or original(a, b, exact),
    )
    vector = negatives._unpacked("<f8", packed[5]["vector"], 1)
    scores = (bucket.vectors @ vector[0]).astype(int)
    limit = int(np.sort(scores)[-4])
    raw = lambda *values: np.array(values, dtype="<i8").tobytes()
    search = negatives._Search(
        {"anchors": 1, "keys": raw(1), "own_ids": raw(5), "own_labels": raw(rows[5][2]),
         "own_code": "<f8", "own_vectors": vector.tobytes(), "slots": 1, "los": raw(limit),
         "his": raw((1 << 63) - 1)}, 10, same_label=True)
    search.add(bucket)
    wanted = [i for i, _, label in rows if scores[i] >= limit and label == rows[5][2]]
    assert sorted(search.result().column("id").to_pylist()) == wanted
    assert sum(verified) < negatives.BUCKET_ROWS / 10


def test_query_on_given_vectors(llm, small):
    rows = [tuple(r) for r in llm.read.parquet(f"{small}/embeddings.parquet").collect()]
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    found = queries.op11_negatives(llm, small).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, 256)
