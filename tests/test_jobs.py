from datetime import date

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from checks.queries import EXPERIMENT, QUERIES, TIE_BREAKER, Case
from trialmart import (
    CatalogSources,
    Experiment,
    Source,
    SourceTable,
    calc_attempts,
    calc_m3_metrics,
    create_dataset,
    prepare_base_metrics,
    prepare_m3_metrics,
    prepare_streak_metrics,
    verify_ab_exp,
)
from trialmart.session import sized_for
from trialmart.sources.commits import commit_days, valid_stretches
from trialmart.sources.sinks import finished_table, replace_days, replace_table

DAYS = [date(2024, 1, day) for day in range(1, 6)]
SMALL = SF_DIR.replace("sf0.01", "sf0.001")


def days_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "day date, value int")


def test_replace_days_is_repeatable_and_keeps_other_days(spark):
    first = days_of(spark, (DAYS[0], 1), (DAYS[1], 2), (DAYS[1], 3), (DAYS[2], 4))
    for _ in range(2):
        table = replace_days(first, "days_a", "day", DAYS[0], DAYS[4])
        assert rows(table, "day", "value") == [
            (DAYS[0], 1), (DAYS[1], 2), (DAYS[1], 3), (DAYS[2], 4)
        ]
    # Day 1 gets new rows, day 2 becomes empty, day 0 and later days stay as they are.
    replace_days(days_of(spark, (DAYS[1], 9)), "days_a", "day", DAYS[1], DAYS[2])
    assert rows(spark.table("days_a"), "day", "value") == [(DAYS[0], 1), (DAYS[1], 9)]
    replace_days(days_of(spark, (DAYS[4], 5)), "days_a", "day", DAYS[4], DAYS[4])
    assert rows(spark.table("days_a"), "day", "value") == [
        (DAYS[0], 1), (DAYS[1], 9), (DAYS[4], 5)
    ]
    replace_days(days_of(spark).limit(0), "days_a", "day", DAYS[0], DAYS[1])
    assert rows(spark.table("days_a"), "day", "value") == [(DAYS[4], 5)]


def test_replace_days_matches_columns_by_name(spark):
    replace_days(days_of(spark, (DAYS[0], 1)), "days_b", "day", DAYS[0], DAYS[0])
    swapped = days_of(spark, (DAYS[1], 2)).select("value", "day")
    replace_days(swapped, "days_b", "day", DAYS[1], DAYS[1])
    assert rows(spark.table("days_b"), "day", "value") == [(DAYS[0], 1), (DAYS[1], 2)]
    with pytest.raises(ValueError, match="other columns"):
        other = days_of(spark, (DAYS[1], 2)).withColumn("more", F.lit(1))
        replace_days(other, "days_b", "day", DAYS[1], DAYS[1])


def test_a_failed_run_leaves_the_table_as_it_was(spark):
    replace_days(days_of(spark, (DAYS[0], 1), (DAYS[1], 2)), "days_c", "day", DAYS[0], DAYS[1])
    broken = days_of(spark, (DAYS[0], 0)).withColumn("value", (1 / F.col("value")).cast("int"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        replace_days(broken, "days_c", "day", DAYS[0], DAYS[1])
    assert rows(spark.table("days_c"), "day", "value") == [(DAYS[0], 1), (DAYS[1], 2)]
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert mode.lower() == "static"


def test_a_table_with_days_half_replaced_is_refused_until_they_are_written(spark, monkeypatch):
    first = days_of(spark, (DAYS[0], 1), (DAYS[1], 2), (DAYS[2], 3))
    replace_days(first, "days_d", "day", DAYS[0], DAYS[2])
    assert finished_table(spark, "days_d").count() == 3

    def lost(*_):
        raise ConnectionError("lost")

    new = days_of(spark, (DAYS[1], 9))
    with monkeypatch.context() as patch:
        patch.setattr("trialmart.sources.sinks._stored_days", lost)
        with pytest.raises(ConnectionError):
            replace_days(new, "days_d", "day", DAYS[1], DAYS[2])
    # Day 2 is stale.
    with pytest.raises(RuntimeError, match="2024-01-02/2024-01-03"):
        finished_table(spark, "days_d")
    with pytest.raises(ValueError, match="first write"):
        replace_days(new, "days_d", "day", DAYS[1], DAYS[1])
    replace_days(new, "days_d", "day", DAYS[1], DAYS[2])
    assert rows(finished_table(spark, "days_d"), "day", "value") == [(DAYS[0], 1), (DAYS[1], 9)]


def test_replace_table_replaces_rows_and_schema(spark):
    replace_table(days_of(spark, (DAYS[0], 1), (DAYS[1], 2)), "whole")
    table = replace_table(spark.createDataFrame([("x",)], "other string"), "whole")
    assert table.columns == ["other"] and rows(table) == [("x",)]


def test_catalog_sources_resolve_names_at_each_call(spark):
    days_of(spark, (DAYS[0], 1)).createOrReplaceTempView("late_bound")
    sources = CatalogSources(
        spark, {"levels": SourceTable("late_bound", "attempts"), "ab_users": "late_bound"}
    )
    assert sources.table(Source.LEVELS).count() == 1
    days_of(spark, (DAYS[0], 1), (DAYS[0], 2)).createOrReplaceTempView("late_bound")
    assert sources.table("levels").count() == 2
    assert sources.entry(Source.LEVELS).description == "attempts"
    with pytest.raises(KeyError, match="sessions"):
        sources.table(Source.SESSIONS)
    with pytest.raises(ValueError):
        CatalogSources(spark, {"nonsense": "t"})


@pytest.fixture(scope="module")
def catalog(spark):
    """The source tables saved under catalog names, as a deployment would have them."""
    case, names = Case(spark, SMALL), {}
    for source in (Source.AB_USERS, Source.AB_USERS_METRICS, Source.SESSIONS, Source.LEVELS):
        names[source.value] = f"src_{source.value}"
        case.sources.table(source).write.mode("overwrite").saveAsTable(names[source.value])
    return CatalogSources(spark, names)


def test_whole_workflow_on_catalog_tables(spark, catalog):
    experiment = Experiment("T1", owner="flow")
    dates = verify_ab_exp(catalog, experiment)
    assert (dates.test_start_date, dates.feature_start_date) == (date(2024, 1, 1), date(2024, 1, 4))

    base = create_dataset(catalog, experiment)
    assert len(base.columns) == 20
    assert rows(prepare_base_metrics(catalog, experiment)) == rows(QUERIES["base_kpis"](spark, SMALL))

    full = create_dataset(
        catalog, experiment, dates, add_m3_metrics=True, need_calc_attempts=True,
        tie_breaker=TIE_BREAKER,
    )
    assert len(full.columns) == 72
    expected = {
        name: rows(QUERIES[name](spark, SMALL)) for name in ("m3_kpis", "streak_kpis")
    }
    assert rows(prepare_m3_metrics(catalog, experiment)) == expected["m3_kpis"]
    assert rows(prepare_streak_metrics(catalog, experiment)) == expected["streak_kpis"]

    # Once more from the attempts already saved; more days and users in that table
    # must not show.
    saved, day = spark.table(experiment.attempts_table), date(2024, 1, 4)
    stranger = (
        saved.limit(1)
        .withColumn("event_user", F.lit(-1).cast("long"))
        .withColumn("n_day", F.lit(99))
        .withColumn("date_attempt", F.lit(day))
    )
    more = saved.filter(F.col("date_attempt") == F.lit(day)).unionByName(stranger)
    commit_days(more, experiment.attempts_table, "date_attempt", day, day)
    assert spark.table(experiment.attempts_table).filter("event_user = -1").count() == 1
    again = create_dataset(catalog, experiment, add_m3_metrics=True, tie_breaker=TIE_BREAKER)
    assert len(again.columns) == 72
    assert rows(prepare_m3_metrics(catalog, experiment)) == expected["m3_kpis"]


def test_a_cohort_too_large_to_broadcast_gives_the_same_dataset(spark, catalog):
    experiment = Experiment("T1", owner="large")
    full = create_dataset(
        catalog, experiment, add_m3_metrics=True, need_calc_attempts=True,
        tie_breaker=TIE_BREAKER, max_broadcast_rows=0,
    )
    expected = QUERIES["m3_dataset"](spark, SMALL)
    found = full.select(
        *[F.col(name).cast(kind).alias(name) for name, kind in expected.dtypes]
    )
    assert rows(found) == rows(expected)


def test_no_cached_data_is_left_behind(spark, catalog):
    storage = spark.sparkContext._jsc.getPersistentRDDs()
    before = storage.size()
    create_dataset(catalog, Experiment("T1", owner="cache"))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_attempts_of_a_part_of_the_days_can_be_redone(spark, catalog):
    case, experiment = Case(spark, SMALL), Experiment("T1", owner="redo")
    start, end = date(2024, 1, 4), date(2024, 1, 30)
    options = {"broadcast_users": True, "tie_breaker": TIE_BREAKER}
    whole = rows(calc_attempts(catalog, experiment, start, end, case.users, **options))
    part = calc_attempts(
        catalog, experiment, date(2024, 1, 10), date(2024, 1, 12), case.users,
        tie_breaker=TIE_BREAKER,
    )
    assert rows(part) == whole
    arguments = (catalog, experiment, start, end, case.users)
    found = calc_m3_metrics(*arguments, False, tie_breaker=TIE_BREAKER)
    expected = QUERIES["cumulative_metrics"](spark, SMALL)
    found = found.withColumn("start_feature_user", F.col("start_feature_user").cast("string"))
    assert rows(found.select(*expected.columns)) == rows(expected)
    chosen = calc_m3_metrics(*arguments, False, tie_breaker=TIE_BREAKER, cumulative=["wins"])
    assert [name for name in chosen.columns if name.startswith("cum_user_")] == ["cum_user_wins"]
    stretches = valid_stretches(spark, experiment.attempts_table)
    assert [(part.first.day, part.last.day) for part in stretches] == [(4, 9), (10, 12), (13, 30)]


def test_lookup_of_an_unknown_experiment_fails(catalog):
    with pytest.raises(ValueError, match="no row"):
        create_dataset(catalog, Experiment("T9"))
    assert EXPERIMENT.test_id == "T1"


def test_shuffles_are_sized_by_rows_and_settings_restored(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with sized_for(spark, 1_000_001, rows_per_task=1000):
        assert spark.conf.get(key) == "1001"
        with sized_for(spark, 10, rows_per_task=1000):
            assert spark.conf.get(key) == "1001"
    assert spark.conf.get(key) == before


def test_many_shuffle_partitions_do_not_change_the_dataset(spark, catalog, monkeypatch):
    monkeypatch.setattr(
        "trialmart.plans.jobs.sized_for", lambda session, rows: sized_for(session, rows, 50)
    )
    experiment = Experiment("T1", owner="sized")
    found = create_dataset(
        catalog, experiment, add_m3_metrics=True, need_calc_attempts=True,
        tie_breaker=TIE_BREAKER, max_broadcast_rows=0,
    )
    expected = QUERIES["m3_dataset"](spark, SMALL)
    found = found.select(*[F.col(name).cast(kind).alias(name) for name, kind in expected.dtypes])
    assert rows(found) == rows(expected)
