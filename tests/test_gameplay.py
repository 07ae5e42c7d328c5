import json
import os
from datetime import date, datetime, timedelta
from urllib.parse import urlparse

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trialmart.operators.attempts import ATTEMPT_COLUMNS, COINS, attempt_facts
from trialmart.operators.panel import (
    CUMULATIVE_METRICS,
    cumulative_metric,
    cumulative_metrics,
    cumulative_panel,
    observed_days,
    user_day_panel,
)
from trialmart.operators.skew import hot_key_rows
from trialmart.operators.timeline import CELL, PLACE, attempt_features, cut_timelines
from trialmart.operators.user_days import MEASURES, user_day_metrics, user_day_partials
from trialmart.plans.jobs import gameplay_metrics
from trialmart.session import session_conf, temporary_tables
from trialmart.sources.catalog import Source
from trialmart.sources.derived import DerivedSources

START, END = date(2024, 1, 4), date(2024, 1, 30)
LEVEL_SCHEMA = (
    "event_id long, user_id string, partition_date date, client_time timestamp_ntz, level int,"
    " complexity string, attempt int, reason string, influence boolean, event_payload string"
)
IN_BOOSTERS = {
    "boosts_hammer": 1,
    "boosts_swap": 2,
    "boosts_reshuffle": "3",
    "boosts_vertical_line": 0,
    "boosts_horizontal_line": 1.5,
}


def level(event_id, user, when, attempt=1, reason="completed", influence=True, **payload):
    text = payload.pop("raw", None) or json.dumps(payload)
    return (event_id, user, when.date(), when, 1, "easy", attempt, reason, influence, text)


def users_of(spark, *names):
    return spark.createDataFrame(
        [(name, "a", START) for name in names],
        "event_user string, abgroup string, start_feature_user date",
    )


def facts_of(spark, levels, *names, **options):
    options = {"broadcast_users": True, "tie_breaker": "event_id", **options}
    return attempt_facts(
        spark.createDataFrame(levels, LEVEL_SCHEMA), users_of(spark, *names), START, END, **options
    )


def features_of(spark, levels, *names, **options):
    return attempt_features(facts_of(spark, levels, *names), END, tie_breaker="event_id", **options)


def at(day, hour=12, minute=0, second=0):
    return datetime(2024, 1, day, hour, minute, second)


def test_attempts_are_limited_to_users_dates_and_feature_days(spark):
    levels = [
        level(1, "u", at(4)),
        level(2, "u", at(30, 23, 59)),
        level(3, "u", at(3)),
        level(4, "u", datetime(2024, 1, 31)),
        level(5, "stranger", at(5)),
    ]
    facts = facts_of(spark, levels, "u")
    assert facts.columns == [*ATTEMPT_COLUMNS, "event_id"]
    assert len(ATTEMPT_COLUMNS) == 34
    assert rows(facts, "event_id", "n_day") == [(1, 1), (2, 27)]


def test_payload_values(spark):
    levels = [
        level(
            1,
            "u",
            at(4),
            coins_spent="12.5",
            real_coins_spent=4,
            boosts_aircraft=True,
            unlimited_boosts_lightning="true",
            boosts_lightning="no",
            boosts_super_lightning=True,
            mortas_helmets="3.9",
            levels_winstreak="x",
            **IN_BOOSTERS,
        ),
        level(
            2,
            "u",
            at(5),
            attempt=2,
            reason=None,
            influence=None,
            coins_spent="many",
            real_coins_spent=7,
            mortas_helmets=2,
            levels_winstreak=4,
            **{**IN_BOOSTERS, "boosts_swap": None},
        ),
        level(3, "u", at(6), reason="failed", raw='{"coins_spent": 5, '),
    ]
    found = {row["event_id"]: row.asDict() for row in facts_of(spark, levels, "u").collect()}
    first, second, broken = found[1], found[2], found[3]
    assert (first["coins_spent"], first["real_coins_spent"]) == (12.5, 4.0)
    assert (first["pre_boosters"], first["in_boosters"]) == (2, 7.5)
    assert (first["mortas_helmets"], first["is_streak"], first["levels_winstreak"]) == (3, 1, None)
    assert (first["is_superball"], first["influence"]) == (1, 1)
    assert (first["is_win"], first["is_lose"]) == (1, 0)
    assert (first["coins_spent_1att"], first["coins_spent_2plus_att"]) == (12.5, 0.0)
    assert first["real_coins_spent_superball"] == 4.0
    # One missing booster makes their sum unknown; an unknown reason is a loss.
    assert (second["pre_boosters"], second["in_boosters"]) == (0, None)
    assert (second["is_win"], second["is_lose"], second["influence"]) == (0, 1, 0)
    assert (second["coins_spent"], second["coins_spent_2plus_att"]) == (None, None)
    assert (second["real_coins_spent_1att"], second["real_coins_spent_2plus_att"]) == (0.0, 7.0)
    assert (second["coins_spent_superball"], second["is_streak"]) == (0.0, 0)
    assert (broken["is_lose"], broken["is_streak"], broken["pre_boosters"]) == (1, 0, 0)
    assert all(found[3][name] is None for name in COINS)


def test_churn_needs_a_week_without_attempts_and_time_to_tell(spark):
    levels = [
        level(1, "six", at(5, 23, 59)),
        level(2, "six", at(11, 0, 1)),
        level(3, "seven", at(5, 23, 59)),
        level(4, "seven", at(12, 0, 1), reason="failed"),
        level(5, "last", at(23)),
        level(6, "near_end", at(24)),
    ]
    found = rows(
        features_of(spark, levels, "six", "seven", "last", "near_end"),
        "event_id", "timediff_att", "churn_m3", "churn_m3_win", "churn_m3_lose",
    )
    assert found == [
        (1, 6, 0, 0, 0),
        (2, None, 1, 1, 0),
        (3, 7, 1, 1, 0),
        (4, None, 1, 0, 1),
        (5, None, 1, 1, 0),
        (6, None, 0, 0, 0),
    ]


def test_streak_superball_and_stuck_flags(spark):
    balls, streaks = (False, True, True, False), (5, 0, 40, 10)
    levels = [
        level(
            i,
            "u",
            at(4, i),
            attempt=(20, 21, 40, 41)[i],
            reason="failed",
            boosts_super_lightning=balls[i],
            levels_winstreak=streaks[i],
        )
        for i in range(4)
    ]
    features = features_of(spark, levels, "u")
    found = rows(
        features,
        "event_id", "is_get_sb", "is_lose_sb", "prev_levels_winstreak", "is_5plus_ws",
        "is_20plus_ws", "is_40plus_ws", "is_stucked", "is_super_stucked",
    )
    assert found == [
        (0, 1, 0, 0, 0, 0, 0, 0, 0),
        (1, 0, 1, 5, 1, 0, 0, 1, 0),
        (2, 0, 1, 0, 0, 0, 0, 1, 0),
        (3, 0, 0, 40, 1, 1, 1, 1, 1),
    ]


def busy_levels():
    """Two busy users and a quiet one, with ties, gaps and attempts at cell borders."""
    levels, event_id = [], 0
    for user, count, step in (("hot", 400, 7), ("warm", 120, 31), ("quiet", 5, 86400)):
        when = at(4, 23, 50)
        for i in range(count):
            levels.append(
                level(
                    event_id,
                    user,
                    when,
                    attempt=1 + i % 45,
                    reason="completed" if i % 3 else "failed",
                    boosts_super_lightning=i % 4 < 2,
                    levels_winstreak=i % 50,
                    coins_spent=i,
                    mortas_helmets=i % 5,
                )
            )
            event_id += 1
            # Every fifth attempt ties with the one before; a long break halfway.
            when += timedelta(seconds=0 if i % 5 == 0 else step)
            if i == count // 2:
                when += timedelta(days=8)
    return levels


def one_moment(levels):
    """The same attempts, those of the hot user all at one time."""
    return [(*row[:3], at(4), *row[4:]) if row[1] == "hot" else row for row in levels]


def untimed(levels):
    return [(*row[:3], None, *row[4:]) if row[1] == "hot" else row for row in levels]


@pytest.mark.parametrize("times", [list, one_moment, untimed])
@pytest.mark.parametrize("hot_rows, cells", [(100, 3), (4, 50), (150, None)])
def test_cutting_hot_timelines_changes_nothing(spark, times, hot_rows, cells):
    levels, names = times(busy_levels()), ("hot", "warm", "quiet")
    whole = features_of(spark, levels, *names)
    cut = features_of(spark, levels, *names, hot_rows=hot_rows, hot_share=0.0, cells=cells)
    found = cut.filter("event_user = 'hot'").groupBy(CELL).count().collect()
    assert len(found) > 1 and max(row["count"] for row in found) < 400
    assert whole.select(CELL).distinct().count() == 1
    columns = [name for name in whole.columns if name != CELL]
    assert rows(cut, *columns) == rows(whole, *columns)
    assert rows(user_day_metrics(cut)) == rows(user_day_metrics(whole))


def test_cells_work_for_both_timestamp_types(spark):
    levels = busy_levels()
    facts = facts_of(spark, levels, "hot").withColumn(
        "client_time", F.col("client_time").cast("timestamp")
    )
    cut = attempt_features(facts, END, tie_breaker="event_id", hot_rows=100, hot_share=0.0)
    whole = attempt_features(facts, END, tie_breaker="event_id")
    columns = ["event_id", "timediff_att", "is_get_sb", "prev_levels_winstreak"]
    assert rows(cut, *columns) == rows(whole, *columns)


def test_ties_without_tie_breaker_do_not_depend_on_input_order(spark):
    levels = busy_levels()
    results = []
    for order in (levels, levels[::-1]):
        facts = facts_of(spark, order, "hot", "warm", "quiet", tie_breaker=None).repartition(7)
        results.append(rows(user_day_metrics(attempt_features(facts, END))))
    assert results[0] == results[1]


def test_panel_is_dense_and_limited_to_the_users(spark):
    levels = [
        level(1, "u", at(4), coins_spent=3),
        level(2, "u", at(6), coins_spent=4),
        level(3, "gone", at(9), coins_spent=9),
    ]
    facts = facts_of(spark, levels, "u", "gone")
    partials = user_day_partials(attempt_features(facts, END, tie_breaker="event_id"))
    users = users_of(spark, "u", "idle")
    panel = user_day_panel(users, partials, observed_days(facts))
    assert rows(panel, "event_user", "n_day", "attempts", "coins_spent", "start_feature_user") == [
        ("idle", 1, 0, 0.0, START),
        ("idle", 3, 0, 0.0, START),
        ("idle", 6, 0, 0.0, START),
        ("u", 1, 1, 3.0, START),
        ("u", 3, 1, 4.0, START),
        ("u", 6, 0, 0.0, START),
    ]
    assert panel.columns == ["event_user", "abgroup", "n_day", "start_feature_user", *MEASURES]
    assert len(MEASURES) == 35


def test_a_user_in_another_group_has_no_part_in_the_panel(spark):
    facts = facts_of(spark, [level(1, "u", at(4))], "u").withColumn("abgroup", F.lit("b"))
    partials = user_day_partials(attempt_features(facts, END, tie_breaker="event_id"))
    panel = user_day_panel(users_of(spark, "u"), partials, observed_days(facts))
    assert rows(panel, "abgroup", "n_day", "attempts") == [("a", 1, 0)]


def test_panel_of_no_attempts_is_empty(spark):
    facts = facts_of(spark, [level(1, "stranger", at(4))], "u")
    partials = user_day_partials(attempt_features(facts, END, tie_breaker="event_id"))
    assert user_day_panel(users_of(spark, "u"), partials, observed_days(facts)).count() == 0


def test_gameplay_metrics_leave_out_other_days_and_users(spark):
    levels = [level(i, user, at(day)) for i, (user, day) in enumerate(
        [("u", 5), ("u", 7), ("gone", 9), ("v", 7)]
    )]
    facts = facts_of(spark, levels, "u", "v", "gone")
    for broadcast_users in (True, False):
        found = gameplay_metrics(
            facts,
            users_of(spark, "u", "v"),
            date(2024, 1, 6),
            END,
            broadcast_users=broadcast_users,
            tie_breaker="event_id",
        )
        assert rows(found, "event_user", "n_day", "attempts", "cum_user_attempts") == [
            ("u", 4, 1, 1),
            ("v", 4, 1, 1),
        ]


def test_cumulative_metrics(spark):
    panel = spark.createDataFrame(
        [("u", 1, 2, 0), ("u", 3, 0, 1), ("u", 2, 5, 0), ("v", 1, 1, 1), ("v", 2, 0, 0)],
        "event_user string, n_day int, attempts long, churn_m3 int",
    ).withColumn("abgroup", F.lit("a"))
    found = cumulative_metrics(panel, ["attempts", "churn_m3"])
    assert rows(found, "event_user", "n_day", "cum_user_attempts", "cum_user_churn_m3") == [
        ("u", 1, 2, 0),
        ("u", 2, 7, 0),
        ("u", 3, 7, 1),
        ("v", 1, 1, 1),
        ("v", 2, 1, 1),
    ]
    assert rows(cumulative_metric(panel, "attempts")) == rows(found.drop("cum_user_churn_m3"))
    assert len(CUMULATIVE_METRICS) == 16


def test_running_values_of_the_sparse_panel_equal_those_of_the_dense_one(spark):
    # Days 1, 3, 6, 7 and 20 are observed; users have gaps before, between and behind theirs.
    played = {"u": (4, 9, 9), "v": (6, 10), "w": (23,), "x": (4, 6, 9, 10, 23), "gone": (6,)}
    levels = [
        level(i, user, at(day, i % 3), coins_spent=i, reason="completed" if i % 2 else "failed")
        for i, (user, day) in enumerate((u, d) for u, days in played.items() for d in days)
    ]
    facts = facts_of(spark, levels, *played)
    partials = user_day_partials(attempt_features(facts, END, tie_breaker="event_id"))
    users, days = users_of(spark, "u", "v", "w", "x", "idle"), observed_days(facts)
    dense = cumulative_metrics(user_day_panel(users, partials, days))
    found = cumulative_panel(users, partials, days)
    assert found.dtypes == dense.dtypes
    assert rows(found) == rows(dense)
    assert found.count() == 5 * 5
    some = cumulative_panel(users, partials, days, ["wins"])
    assert rows(some) == rows(dense.select(*some.columns))


def test_days_that_are_not_observed_or_missing(spark):
    facts = facts_of(spark, [level(i, "u", at(day)) for i, day in enumerate((4, 6, 9))], "u")
    partials = user_day_partials(attempt_features(facts, END, tie_breaker="event_id"))
    undated = partials.withColumn("n_day", F.expr("nullif(n_day, 6)"))
    days = spark.sql("SELECT array(1, 2, 5, 7) AS days")
    # Attempts on days 1, 3 and 6: day 3 falls between, and day 6 has no day in the second case.
    columns = ("n_day", "attempts", "cum_user_attempts")
    for frame, last in ((partials, 3), (undated, 2)):
        found = cumulative_panel(users_of(spark, "u"), frame, days)
        assert rows(found, *columns) == [(1, 1, 1), (2, 0, 1), (5, 0, 2), (7, 0, last)]
    none = spark.sql("SELECT CAST(array() AS array<int>) AS days")
    assert rows(cumulative_panel(users_of(spark, "u"), partials, none)) == []


def test_totals_are_conserved(spark):
    levels, names = busy_levels(), ("hot", "warm", "quiet")
    facts = facts_of(spark, levels, *names)
    result = gameplay_metrics(
        facts, users_of(spark, *names), START, END, broadcast_users=True, tie_breaker="event_id"
    )
    totals = result.agg(F.sum("attempts"), F.sum("coins_spent")).first()
    assert tuple(totals) == (facts.count(), facts.agg(F.sum("coins_spent")).first()[0])
    last = result.groupBy("event_user").agg(F.max("cum_user_attempts").alias("last"))
    per_user = facts.groupBy("event_user").agg(F.count(F.lit(1)).alias("last"))
    assert rows(last) == rows(per_user)


def test_levels_have_a_row_for_every_event(spark, sf_dir):
    levels = DerivedSources(spark, sf_dir).table(Source.LEVELS)
    assert levels.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_times_as_text_are_refused(spark):
    attempts = spark.createDataFrame([("u", "2024-01-01 10:00")], "event_user string, client_time string")
    with pytest.raises(TypeError, match="timestamp"):
        attempt_features(attempts, None)


@pytest.mark.parametrize("partitions", ["1", "64"])
@pytest.mark.parametrize("times", [list, one_moment, untimed])
def test_no_cell_is_larger_than_a_task_should_hold(spark, times, partitions):
    levels = times(busy_levels())
    # Attempts that are equal in the order, and some in every column, are cut as well.
    levels += levels[:30] * 6
    facts = facts_of(spark, levels, "hot", "warm", "quiet", tie_breaker=None)
    with session_conf(spark, {"spark.sql.shuffle.partitions": partitions}):
        cut = attempt_features(facts, END, hot_rows=40, hot_share=0.0, cell_rows=40)
        sizes = cut.filter(F.col(CELL) > 0).groupBy("event_user", CELL).count().collect()
        found = rows(user_day_metrics(cut))
    assert sum(row["count"] for row in sizes) == 400 + 180 + 120
    assert max(row["count"] for row in sizes) <= 40
    assert found == rows(user_day_metrics(attempt_features(facts, END)))


def test_cells_are_ranges_of_the_order(spark):
    facts = facts_of(spark, busy_levels(), "hot", "warm", "quiet")
    hot = hot_key_rows(facts, "event_user", 100, 0.0)
    cut = cut_timelines(facts, hot, ["client_time", "event_id"], 30)
    found = sorted((r.event_user, r.event_id, r[CELL], r[PLACE]) for r in cut.collect())
    in_order = [(user, cell, place) for user, _, cell, place in found]
    assert in_order == sorted(in_order) and len({place for *_, place in found}) == 520
    assert {row.event_user: row.key_rows for row in hot.collect()} == {"hot": 400, "warm": 120}


def test_stored_timelines_are_removed_with_their_block(spark):
    facts = facts_of(spark, busy_levels(), "hot", "warm", "quiet")
    with temporary_tables(spark):
        cut = attempt_features(facts, END, tie_breaker="event_id", hot_rows=100, hot_share=0.0)
        files = [path for path in cut.inputFiles() if "trialmart-" in path]
        assert files and all(os.path.exists(urlparse(path).path) for path in files)
    assert not any(os.path.exists(urlparse(path).path) for path in files)
