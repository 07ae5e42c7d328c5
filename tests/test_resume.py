"""The dataset job goes on behind the steps that an earlier run finished."""

from datetime import date

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from checks.queries import QUERIES, TIE_BREAKER, Case
from trialmart import CatalogSources, Experiment, Source, create_dataset
from trialmart.plans import jobs
from trialmart.plans.steps import input_state, is_finished, step_key, table_state

SMALL = SF_DIR.replace("sf0.01", "sf0.001")
OPTIONS = {
    "add_m3_metrics": True, "need_calc_attempts": True, "tie_breaker": TIE_BREAKER, "resume": True
}


@pytest.fixture
def catalog(spark, request):
    case, names = Case(spark, SMALL), {}
    for source in (Source.AB_USERS, Source.AB_USERS_METRICS, Source.SESSIONS, Source.LEVELS):
        names[source.value] = f"{request.node.name}_{source.value}"
        case.sources.table(source).write.mode("overwrite").saveAsTable(names[source.value])
    return CatalogSources(spark, names)


@pytest.fixture
def steps(monkeypatch):
    """Which steps ran, by the tables they wrote."""
    ran = []
    replace_table, calc_attempts = jobs.replace_table, jobs.calc_attempts

    def watched_replace(df, table):
        ran.append("cohort" if table.endswith("_cohort") else "dataset")
        return replace_table(df, table)

    def watched_attempts(*arguments, **settings):
        ran.append("attempts")
        return calc_attempts(*arguments, **settings)

    monkeypatch.setattr(jobs, "replace_table", watched_replace)
    monkeypatch.setattr(jobs, "calc_attempts", watched_attempts)

    def since():
        found = list(ran)
        ran.clear()
        return found

    return since


def as_expected(df, expected):
    return rows(df.select(*[F.col(name).cast(kind).alias(name) for name, kind in expected.dtypes]))


def test_a_run_lost_after_the_attempt_table_goes_on_from_there(spark, catalog, steps, monkeypatch):
    experiment = Experiment("T1", owner="resumed")
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "add_gameplay", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            create_dataset(catalog, experiment, **OPTIONS)
    assert steps() == ["cohort", "attempts"]
    assert not spark.catalog.tableExists(experiment.dataset_table)

    found = create_dataset(catalog, experiment, **OPTIONS)
    assert steps() == ["dataset"]
    expected = QUERIES["m3_dataset"](spark, SMALL)
    assert as_expected(found, expected) == rows(expected)

    again = create_dataset(catalog, experiment, **OPTIONS)
    assert steps() == []
    assert again.columns == found.columns and again.count() == found.count()

    # Other settings make only the steps that depend on them run again.
    fewer = create_dataset(catalog, experiment, **OPTIONS, cumulative=["wins"])
    assert steps() == ["dataset"]
    assert [name for name in fewer.columns if name.startswith("cum_user_")] == ["cum_user_wins"]
    # The way a cohort is joined does not.
    create_dataset(catalog, experiment, **OPTIONS, cumulative=["wins"], max_broadcast_rows=0)
    assert steps() == []


def test_a_run_lost_before_the_commit_of_the_attempts_repeats_them(
    spark, catalog, steps, monkeypatch
):
    experiment = Experiment("T1", owner="resumed_early")
    with monkeypatch.context() as patch:
        patch.setattr("trialmart.sources.commits._point", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            create_dataset(catalog, experiment, **OPTIONS)
    assert steps() == ["cohort", "attempts"]
    found = create_dataset(catalog, experiment, **OPTIONS)
    assert steps() == ["attempts", "dataset"]
    expected = QUERIES["m3_dataset"](spark, SMALL)
    assert as_expected(found, expected) == rows(expected)


def test_changed_inputs_make_their_steps_run_again(spark, catalog, steps):
    experiment = Experiment("T1", owner="resumed_inputs")
    create_dataset(catalog, experiment, **OPTIONS)
    assert steps() == ["cohort", "attempts", "dataset"]
    levels, users = catalog.entry(Source.LEVELS).path, catalog.entry(Source.AB_USERS).path

    # A day after the experiment, and another experiment, do not matter.
    day = F.lit(date(2024, 3, 1))
    spark.table(levels).limit(1).withColumn("partition_date", day).write.insertInto(levels)
    other = spark.table(users).limit(1).withColumn("test_id", F.lit("T3"))
    other.write.insertInto(users)
    create_dataset(catalog, experiment, **OPTIONS)
    assert steps() == []

    played = spark.table(levels).filter("partition_date = '2024-01-10'").limit(1)
    played.write.insertInto(levels)
    create_dataset(catalog, experiment, **OPTIONS)
    assert steps() == ["attempts", "dataset"]

    # Tables that another writer changed since are not taken for the step's result.
    attempts = spark.table(experiment.attempts_table).filter("date_attempt = '2024-01-10'")
    jobs.commit_days(
        attempts, experiment.attempts_table, "date_attempt", date(2024, 1, 10), date(2024, 1, 10)
    )
    cohort = f"{experiment.dataset_table}_cohort"
    spark.table(cohort).limit(1).write.insertInto(cohort)
    create_dataset(catalog, experiment, **OPTIONS)
    assert steps() == ["cohort", "attempts", "dataset"]


def test_without_resume_every_step_runs_and_leaves_no_mark_that_counts(spark, catalog, steps):
    experiment = Experiment("T1", owner="resumed_not")
    create_dataset(catalog, experiment, **OPTIONS)
    steps()
    plain = {**OPTIONS, "resume": False}
    create_dataset(catalog, experiment, **plain)
    assert steps() == ["attempts", "dataset"]
    create_dataset(catalog, experiment, **OPTIONS)
    assert steps() == ["attempts", "dataset"]


def test_sources_that_are_no_files_need_a_named_state(spark, steps):
    case, experiment = Case(spark, SMALL), Experiment("T1", owner="resumed_views")
    with pytest.raises(ValueError, match="`inputs`"):
        create_dataset(case.sources, experiment, resume=True)
    for inputs, ran in (("a", ["cohort", "dataset"]), ("a", []), ("b", ["cohort", "dataset"])):
        create_dataset(case.sources, experiment, resume=True, inputs=inputs)
        assert steps() == ran


def test_states_and_keys(spark):
    spark.range(4).write.mode("overwrite").saveAsTable("state_a")
    before = input_state(spark.table("state_a"))
    assert before == table_state(spark, "state_a") == input_state(spark.table("state_a"))
    spark.range(1).write.insertInto("state_a")
    assert input_state(spark.table("state_a")) != before
    assert input_state(spark.table("state_a").filter("id > 9")) == "0 files, None"
    assert input_state(spark.table("state_a"), "v1") == "v1"
    assert step_key("s", a=1, b=None) == step_key("s", b=None, a=1) != step_key("s", a=2, b=None)
    assert not is_finished(spark, "state_a", "k") and not is_finished(spark, "no_such_table", "k")
