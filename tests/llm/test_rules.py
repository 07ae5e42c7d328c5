from __future__ import annotations

import pytest
from checks.compare import difference
from conftest import rows

from trialmart.llm.oracle import ORACLES
from trialmart.llm.queries import QUERIES
from trialmart.llm.rules import judge, keep_good, line_fault, line_quality, repeated_words

PROSE = " ".join(f"plain{i}" for i in range(60)) + "."


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(llm, sf_dir, name):
    assert difference(QUERIES[name](llm, sf_dir), sf_dir, ORACLES[name]) is None


@pytest.mark.parametrize(
    ("line", "fault"),
    [
        ("An ordinary line of words.", None),
        ("Home | About | Contact", "navigation"),
        ("some### words$$$ with&&& marks***", "punctuation"),
        ("THIS!! IS!! ALL!! VERY!! LOUD!!", "punctuation"),
        ("2024 - 12 - 31", "no_letter"),
        ("© Somebody. All rights reserved.", "boilerplate"),
        ("ü é", None),
    ],
)
def test_line_rules(line, fault):
    assert line_fault(line, line.split()) == fault


def test_repeated_words_count_first_occurrences_and_overlaps():
    assert repeated_words("a b c d a b c".split()) == 6
    assert repeated_words("a a a a".split()) == 4
    assert repeated_words("a b c".split()) == 0


def test_documents_that_lose_too_much_are_rejected():
    navigation = "\n".join("one | two | three | four" + str(i) for i in range(40))
    assert judge(PROSE)[6]
    assert judge(PROSE + "\nHome | About")[6]
    assert not judge(PROSE + "\n" + navigation)[6]
    assert judge(PROSE + "\n" + PROSE)[3] == 1


def test_awkward_rows(awkward):
    found = line_quality(awkward)
    assert found.count() == awkward.count()
    by_id = {row["doc_id"]: row for row in found.collect()}
    for doc_id in (3, 4, 7):
        assert by_id[doc_id]["n_words"] == 0 and not by_id[doc_id]["kept"]
    assert by_id[8]["n_words"] == 30_000
    kept = keep_good(awkward, length_column=None)
    assert kept.columns == awkward.columns
    assert keep_good(awkward.limit(0)).count() == 0


def test_kept_documents_lose_the_lines_that_fail(llm):
    text = PROSE + "\nHome | About\n\nLast line here."
    df = llm.createDataFrame([(1, text, len(text)), (2, "short", 5)], "doc_id int, text string, n int")
    clean = PROSE + "\n\nLast line here."
    assert rows(keep_good(df, length_column="n")) == [(1, clean, len(clean))]
