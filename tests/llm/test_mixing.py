from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trialmart.llm.mixing import mix, mixed_documents, numbered, source_targets


@pytest.mark.parametrize(
    ("sizes", "want"),
    [
        # Shares of 5, 2, 1 of 1.5 x 800 stay below twice each size.
        ({"a": 500, "b": 200, "c": 100}, {"a": 750.0, "b": 300.0, "c": 150.0}),
        # a stops at 20; the rest is shared 2 to 1.
        ({"a": 10, "b": 100, "c": 100}, {"a": 20.0, "b": 590 / 3, "c": 295 / 3}),
        ({"a": 0, None: 10}, {"a": 0.0, None: 15.0}),
    ],
)
def test_targets(llm, sizes, want):
    df = llm.createDataFrame(list(sizes.items()), "source string, size long")
    found = {row["source"]: row["target"] for row in source_targets(df).collect()}
    assert found == pytest.approx(want)


def test_each_source_takes_its_target_and_reruns_agree(documents):
    found = mix(documents).cache()
    by_source = found.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"))
    assert by_source.filter("abs(t - w) > 1").count() == 0
    assert found.filter("taken > 2 * size OR taken < 0").count() == 0
    # Documents are taken in order of finish time: whole up to the cut, at most one in part.
    part = found.filter("taken % size <> 0").groupBy("source").count().filter("count > 1")
    assert part.count() == 0
    again = mix(documents.repartition(7))
    assert rows(again, "doc_id", "taken") == rows(found, "doc_id", "taken")


def test_ranks_without_a_single_task(llm):
    df = llm.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert rows(numbered(df, "v"), "v", "rank") == [(i, i + 1) for i in range(1000)]


def test_mixed_documents_are_whole_rows_in_order(documents):
    found = mixed_documents(documents)
    assert found.columns == documents.columns
    texts = {row["doc_id"]: row["text"] for row in documents.collect()}
    copies = Counter()
    for row in found.collect():
        assert row["text"] == texts[row["doc_id"]]
        copies[row["doc_id"]] += 1
    want = {
        row["doc_id"]: row["times"]
        for row in mix(documents).selectExpr("doc_id", "round(taken / size) AS times").collect()
        if row["times"]
    }
    assert copies == want


def test_awkward_rows(awkward):
    found = mix(awkward).cache()
    assert found.count() == awkward.count()
    assert found.filter("size = 0 AND taken <> 0").count() == 0
    assert found.filter("source IS NULL").agg(F.max("source_size")).first()[0] == 10
    assert mixed_documents(awkward).columns == awkward.columns
    assert mix(awkward.limit(0)).count() == 0
    assert mixed_documents(awkward.limit(0)).count() == 0


def test_cutting_each_source_equals_the_global_queue(llm):
    """The queue sorted by finish time over all sources and cut at the budget, by hand."""
    rng = random.Random(9)
    rows = [
        (i, " ".join("w" * rng.randint(0, 30)), rng.choice(["a", "b", "c", "d", None]))
        for i in range(400)
    ]
    df = llm.createDataFrame(rows, "doc_id long, text string, source string")
    found = [row.asDict() for row in mix(df).collect()]
    queue = []
    for row in found:
        if row["size"]:
            for epoch in range(2):
                finish = row["finish"] + epoch * row["source_size"] / row["target"]
                queue.append((finish, row["doc_id"], row))
    queue.sort(key=lambda entry: entry[:2])
    # A document is in service from its start; all are served at rates that meet at virtual time 1.
    taken = {row["doc_id"]: 0 for row in found}
    budget = sum({row["source"]: math.floor(row["target"]) for row in found}.values())
    spent = 0
    for finish, doc_id, row in queue:
        start = finish - row["size"] / row["target"]
        if start >= 1:
            continue
        words = row["size"] if finish < 1 + 1e-12 else math.floor(row["target"]) - round(start * row["target"])
        taken[doc_id] += max(0, words)
        spent += max(0, words)
    assert spent == budget
    assert {row["doc_id"]: row["taken"] for row in found} == taken
