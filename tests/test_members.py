"""The filter of the cohort: no member is lost, and few others reach the parse."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trialmart.operators import members
from trialmart.operators.members import filter_words, member_filter, possible_members


def users_frame(spark, ids, kind="long"):
    return spark.createDataFrame([(i,) for i in ids], f"event_user {kind}")


@pytest.mark.parametrize("count", [1, 40, 5_000, 60_000])
def test_members_pass_and_others_hardly_do(spark, count):
    users = spark.range(0, 2 * count, 2).select(F.col("id").alias("event_user"))
    facts = spark.range(0, 200_000).select(F.col("id").alias("event_user"))
    found = possible_members(facts, users)
    ids = {row[0] for row in found.collect()}
    wanted = set(range(0, min(2 * count, 200_000), 2))
    assert wanted <= ids
    assert len(ids - wanted) < 0.02 * (200_000 - len(wanted)) + 5


def test_fewer_bits_let_more_through_but_lose_no_member(spark):
    users = spark.range(0, 40_000, 2).select(F.col("id").alias("event_user"))
    facts = spark.range(0, 40_000).select(F.col("id").alias("event_user"))
    passed = {}
    for words in (512, 2048, members.MAX_WORDS):
        ids = {row[0] for row in possible_members(facts, users, max_words=words).collect()}
        assert set(range(0, 40_000, 2)) <= ids
        passed[words] = len(ids)
    assert passed[512] > passed[2048] > passed[members.MAX_WORDS]


def test_the_size_is_bounded_whatever_the_cohort():
    assert filter_words(0) == filter_words(1) == 1
    assert filter_words(10**12) == members.MAX_WORDS
    sizes = [filter_words(n) for n in range(1, 100_000, 997)]
    assert sizes == sorted(sizes)
    assert all(16 * n <= 64 * filter_words(n) for n in (1, 10, 999, 10**6, 33 * 10**6))


def test_every_word_is_there(spark):
    words = filter_words(50_000)
    (row,) = member_filter(users_frame(spark, ["a", None, "b"], "string"), "event_user", words).collect()
    assert [len(block) for block in row.words] == [members.BLOCK_WORDS] * (words // members.BLOCK_WORDS)
    assert 2 <= sum(bin(w & (2**64 - 1)).count("1") for block in row.words for w in block) <= 8


def test_awkward_users(spark):
    facts = spark.createDataFrame([("a", 1), (None, 2), ("", 3), ("z" * 9999, 4)], "event_user string, n int")
    users = users_frame(spark, ["a", None, "", "z" * 9999, "a"], "string")
    assert {row.n for row in possible_members(facts, users).collect()} >= {1, 3, 4}
    assert possible_members(facts, users.limit(0)).count() == 0
    # Numbers and texts hash differently: the join casts, so nothing may be left out.
    numbers = users_frame(spark, [1, 2])
    assert possible_members(facts, numbers) is facts
