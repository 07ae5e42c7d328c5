from __future__ import annotations

import re

import pytest
from conftest import rows

from trialmart.llm.decontaminate import find_hits, item_words, merge_spans, remove_benchmark

ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "Short item!"),
    (3, ""),
    (4, None),
    (None, "three four five six seven eight nine ten eleven twelve"),
    (1, "one two three four five six seven eight nine ten eleven twelve"),
]
DOCS = [
    (10, "x One, TWO three four five six seven eight nine ten y"),
    (11, "one two three four five six seven eight nine and ten"),
    (12, "a short ITEM and zero one two three four five six seven eight nine ten eleven twelve."),
    (13, "nothing"),
    (14, None),
    (14, ""),
]


@pytest.fixture
def tables(llm):
    items = llm.createDataFrame(ITEMS, "item_id int, text string")
    docs = llm.createDataFrame(DOCS, "doc_id int, text string").selectExpr("*", "'i' AS item")
    return docs, items


def slow(docs, items, window=10):
    found = []
    for doc_id, text in docs:
        words = item_words(text)
        hit, of = set(), set()
        for item, item_text in items:
            own = item_words(item_text)
            size = min(window, len(own))
            for i in range(len(own) - size + 1) if size else ():
                for at in range(len(words) - size + 1):
                    if words[at : at + size] == own[i : i + size]:
                        hit |= set(range(at, at + size))
                        of.add("" if item is None else str(item))
        found.append((doc_id, len(words), len(hit), sorted(of)))
    return sorted(found, key=str)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_hits_equal_brute_force_broadcast_or_shuffled(tables, limit):
    docs, items = tables
    found = find_hits(docs, items, max_broadcast_bytes=limit)
    got = [tuple(row) for row in found.select("doc_id", "n_words", "n_hit", "items").collect()]
    assert sorted(got, key=str) == slow(DOCS, ITEMS)


def test_words_are_those_of_the_definition():
    text = "Ab-c_d 'É' ﬁ 1２ \x7f\x80 ÀB~K"
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    want = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    assert [w.decode() for w in item_words(text)] == want


@pytest.mark.parametrize("limit", [1 << 26, 700])
def test_documents_or_spans_go(tables, limit):
    docs, items = tables
    clean = remove_benchmark(docs, items, max_broadcast_bytes=limit)
    assert clean.columns == docs.columns
    assert rows(clean, "doc_id") == [(11,), (13,), (14,), (14,)]
    cut = remove_benchmark(docs, items, spans=True, max_broadcast_bytes=limit)
    texts = {row["doc_id"]: row["text"] for row in cut.collect()}
    assert texts[10] == "x  y"
    assert texts[12] == "a  and zero ."
    assert texts[11] == DOCS[1][1]


def test_empty_tables_and_awkward_rows(tables, awkward):
    docs, items = tables
    assert find_hits(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert remove_benchmark(docs, items.limit(0)).count() == docs.count()
    assert find_hits(docs.limit(0), items).count() == 0
    found = find_hits(awkward, items)
    assert found.count() == awkward.count() and found.filter("n_hit IS NULL").count() == 0


def test_spans_merge():
    assert merge_spans([(5, 7), (0, 2), (1, 3), (7, 9)]) == [(0, 3), (5, 9)]
