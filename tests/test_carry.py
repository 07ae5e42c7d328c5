"""Days carried on one by one, against all attempts at once."""

import re
from datetime import date, timedelta

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from checks.queries import TIE_BREAKER, Case
from trialmart import Experiment, calc_attempts, carried_metrics, carry_attempts, gameplay_metrics
from trialmart.operators.carry import carry_on
from trialmart.sources.sinks import set_property

SMALL = SF_DIR.replace("sf0.01", "sf0.001")
START, END = date(2024, 1, 4), date(2024, 1, 30)
SETTINGS = {"tie_breaker": TIE_BREAKER}


def attempts_of(case, owner):
    experiment = Experiment("T1", owner=owner)
    calc_attempts(case.sources, experiment, START, END, case.users, **SETTINGS)
    return experiment


def whole(case, experiment, last=END):
    attempts = case.spark.table(experiment.attempts_table).filter(F.col("date_attempt") <= last)
    return rows(gameplay_metrics(attempts, case.users, START, END, **SETTINGS).drop("start_feature_user"))


def test_every_day_by_itself_equals_all_days_at_once(spark):
    case = Case(spark, SMALL)
    experiment = attempts_of(case, "daily")
    day = START
    while day <= END:
        carry_attempts(case.sources, experiment, day, day, END, **SETTINGS)
        if day in (START, date(2024, 1, 11), END):
            # After each day: the last attempt so far counts as such, and stops doing so later.
            found = carried_metrics(case.sources, experiment, END, case.users, **SETTINGS)
            columns = [name for name in found.columns if name != "start_feature_user"]
            assert rows(found, *columns) == whole(case, experiment, day)
        day += timedelta(days=1)


def test_a_day_is_read_by_itself(spark, monkeypatch):
    case = Case(spark, SMALL)
    experiment = attempts_of(case, "alone")
    carry_attempts(case.sources, experiment, START, date(2024, 1, 19), END, **SETTINGS)
    read = []

    def watched(attempts, opened, *arguments, **settings):
        read.extend(frame.inputFiles() for frame in (attempts, opened))
        return carry_on(attempts, opened, *arguments, **settings)

    monkeypatch.setattr("trialmart.plans.jobs.carry_on", watched)
    carry_attempts(case.sources, experiment, date(2024, 1, 20), date(2024, 1, 20), END, **SETTINGS)
    attempt_files, open_files = read
    # One day of attempts and one of open attempts, by their partitions.
    assert {re.search(r"date_attempt=([\d-]+)", name)[1] for name in attempt_files} == {"2024-01-20"}
    assert {re.search(r"as_of=([\d-]+)", name)[1] for name in open_files} == {"2024-01-19"}


def test_days_are_carried_on_in_order_and_can_be_done_again(spark):
    case = Case(spark, SMALL)
    experiment = attempts_of(case, "order")
    go = lambda first, last: carry_attempts(
        case.sources, experiment, date(2024, 1, first), date(2024, 1, last), END, **SETTINGS
    )
    go(4, 12)
    with pytest.raises(ValueError, match="go on from there"):
        go(14, 15)
    go(13, 20)
    for first, last in ((4, 12), (15, 22), (15, 20)):
        with pytest.raises(ValueError, match="carried on already"):
            go(first, last)
    go(13, 20)
    go(21, 30)
    found = carried_metrics(case.sources, experiment, END, case.users, **SETTINGS)
    columns = [name for name in found.columns if name != "start_feature_user"]
    assert rows(found, *columns) == whole(case, experiment)
    set_property(spark, f"{experiment.attempts_table}_open", "trialmart.carried", None)
    with pytest.raises(RuntimeError, match="run that again"):
        carried_metrics(case.sources, experiment, END, case.users, **SETTINGS)


def test_hot_users_and_late_attempts(spark):
    case = Case(spark, SMALL)
    attempts = case.attempts.cache()
    early, later = (attempts.filter(f"date_attempt {sign} DATE'2024-01-15'") for sign in ("<", ">="))
    plain = carry_on(early, None, END, **SETTINGS)
    cut = carry_on(early, None, END, hot_rows=20, hot_share=0.0, cell_rows=7, **SETTINGS)
    assert rows(plain.open) == rows(cut.open)
    sums = [F.sum("attempts"), F.sum("wins"), F.sum("churn_m3_lose"), F.sum("cnt_get_sb")]
    totals = [
        rows(found.closed.groupBy("event_user").agg(*sums)) for found in (plain, cut)
    ]
    assert [row[:3] for row in totals[0]] == [row[:3] for row in totals[1]]
    assert carry_on(later, plain.open, END, **SETTINGS).open.count() >= plain.open.count()
    with pytest.raises(ValueError, match="lie before"):
        carry_on(early, carry_on(later, None, END, **SETTINGS).open, END, **SETTINGS)
    attempts.unpersist()
