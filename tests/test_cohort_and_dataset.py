from datetime import date

import pytest
from conftest import rows

from trialmart.experiment import Experiment, ExperimentDates, Platform, experiment_lookup, read_dates
from trialmart.operators.cohort import count_unique_users, enrolled_users, experiment_cohort
from trialmart.operators.dataset import base_dataset
from trialmart.operators.monetisation import (
    main_metrics_pivot,
    metrics_with_covariate,
    pre_period_covariate,
)

EXPERIMENT = Experiment("T")
DATES = ExperimentDates(
    date(2024, 1, 1), date(2024, 1, 30), date(2024, 1, 10), date(2024, 1, 4), date(2024, 1, 30)
)
USER_SCHEMA = (
    "test_id string, app_short string, abgroup string, event_user string, good_user boolean,"
    " test_enroll_date date, metric_calc_start_date date, device_region string,"
    " test_start_date date, test_end_date date, enroll_end_date date, feature_start_date date,"
    " feature_end_date date"
)


def user(name, enrolled=date(2024, 1, 2), good=True, test="T", app="hs_as", feature=DATES.feature_start_date):
    return (
        test, app, "a", name, good, enrolled, enrolled, "EU", DATES.test_start_date,
        DATES.test_end_date, DATES.enroll_end_date, feature, DATES.feature_end_date,
    )


def session(name, day, text, store="ios", session_id="s"):
    return (name, day, store, session_id, text)


def cohort_of(spark, users, sessions, broadcast_users=True):
    sessions = spark.createDataFrame(
        sessions,
        "user_id string, partition_date date, store string, session_id string, user_payload string",
    )
    enrolled = enrolled_users(spark.createDataFrame(users, USER_SCHEMA), EXPERIMENT)
    return experiment_cohort(enrolled, sessions, EXPERIMENT, DATES, broadcast_users=broadcast_users)


def metrics_of(spark, data):
    return spark.createDataFrame(
        data,
        "event_user string, personal_test_participation_day_num int, metric_name string,"
        " value double",
    )


def test_platform_codes():
    assert (Platform.IOS.app_short, Platform.IOS.store) == ("hs_as", "ios")
    assert (Platform("Android").app_short, Platform("Android").store) == ("hs_gp", "googleplay")
    assert Experiment("T", Platform.ANDROID, "me", "db").dataset_table == "db.me_ab_dataset_T_hs_gp"
    ios, android = (Experiment("T", platform, "me") for platform in Platform)
    assert ios.attempts_table != android.attempts_table
    with pytest.raises(ValueError, match="table name"):
        _ = Experiment("a-b", owner="me").dataset_table
    with pytest.raises(ValueError, match="owner"):
        _ = Experiment("T").dataset_table


def test_lookup_wants_exactly_one_set_of_dates(spark):
    one = spark.createDataFrame([user("a"), user("b"), user("c", test="other")], USER_SCHEMA)
    assert read_dates(experiment_lookup(one, EXPERIMENT)) == DATES
    assert experiment_lookup(one, EXPERIMENT).columns == [
        "test_id", "app_short", "test_start_date", "test_end_date", "enroll_end_date",
        "feature_start_date", "feature_end_date",
    ]
    with pytest.raises(ValueError, match="no row"):
        read_dates(experiment_lookup(one, Experiment("absent")))
    two = spark.createDataFrame([user("a"), user("b", feature=date(2024, 1, 5))], USER_SCHEMA)
    with pytest.raises(ValueError, match="more than one"):
        read_dates(experiment_lookup(two, EXPERIMENT))
    with pytest.raises(ValueError, match="test_end_date"):
        experiment_lookup(one.drop("test_end_date"), EXPERIMENT)


def test_unset_dates_are_refused(spark):
    unset = ExperimentDates(None, date(2024, 1, 2), None, None, None)
    with pytest.raises(ValueError, match="test_start_date, enroll_end_date"):
        unset.require("test_start_date", "enroll_end_date")


@pytest.mark.parametrize("broadcast_users", [True, False])
def test_cohort_has_good_users_with_their_enrolment_day_attributes(spark, broadcast_users):
    first, second = date(2024, 1, 2), date(2024, 1, 6)
    cohort = cohort_of(
        spark,
        [
            user("early", first),
            user("late", second),
            user("silent", second),
            user("bad", second, good=False),
            user("other_app", second, app="hs_gp"),
        ],
        [
            session("early", first, '{"level": 5, "segment.skill": 0.3, "payer_type": "whale"}'),
            session("early", second, '{"level": 1, "payer_type": "zzz"}'),
            session("late", second, '{"level": 200, "segment.payment": 9}'),
            session("silent", first, '{"level": 7}'),
            session("silent", second, '{"level": 7}', session_id="-1"),
            session("stranger", second, '{"level": 7}'),
        ],
        broadcast_users,
    )
    found = rows(
        cohort, "event_user", "start_feature_user", "payer_type", "skill_payment_seg", "skill", "level"
    )
    assert found == [
        # The feature starts later than this user, so it counts from its start.
        ("early", date(2024, 1, 4), "whale", "0_early_game", 40.0, 5),
        ("late", second, None, "4_super_payers", 0.0, 200),
        # No valid session that day: numbers become 0, labels stay NULL.
        ("silent", second, None, None, 0.0, 0),
    ]


def test_a_user_listed_twice_is_refused(spark):
    users = spark.createDataFrame([user("a"), user("b"), user("a")], USER_SCHEMA)
    with pytest.raises(ValueError, match="more than once"):
        count_unique_users(enrolled_users(users, EXPERIMENT))
    assert count_unique_users(enrolled_users(users.limit(0), EXPERIMENT)) == 0


def test_metric_pivots(spark):
    metrics = metrics_of(
        spark,
        [
            ("a", 1, "revenue", 2.0),
            ("a", 1, "revenue", 3.0),
            ("a", 1, "active", 1.0),
            ("a", 2, "active", 1.0),
            ("a", 0, "revenue", 9.0),
            ("a", -1, "prev_revenue_cum", 4.0),
            ("a", -1, "prev_active", 1.0),
            ("a", -1, "revenue", 8.0),
            ("a", -9, "prev_revenue_cum", 50.0),
            ("b", -1, "prev_revenue_cum", 6.0),
        ],
    )
    main = rows(main_metrics_pivot(metrics), "event_user", "n_day", "revenue", "retained", "churn")
    assert main == [("a", 1, 5.0, 1.0, None), ("a", 2, None, 1.0, None)]
    prior = rows(pre_period_covariate(metrics))
    assert prior == [("a", 1, 4.0), ("a", 9, 50.0), ("b", 1, 6.0)]

    both = metrics_with_covariate(metrics)
    joined = main_metrics_pivot(metrics).join(
        pre_period_covariate(metrics), ["event_user", "n_day"], "left"
    )
    assert both.columns == joined.columns
    assert rows(both) == rows(joined)


def test_base_dataset_keeps_users_without_metrics(spark):
    cohort = cohort_of(spark, [user("a"), user("b"), user("c")], [])
    metrics = metrics_of(
        spark,
        [
            ("a", 1, "active", 1.0),
            ("a", 2, "revenue", 2.5),
            ("a", 2, "active", 1.0),
            ("a", -2, "prev_revenue_cum", 7.0),
            # Day 9 is no day of the result, so it has no part in the maximum.
            ("a", -9, "prev_revenue_cum", 50.0),
            ("b", -1, "prev_revenue_cum", 7.0),
            ("stranger", 1, "active", 1.0),
        ],
    )
    dataset = base_dataset(cohort, metrics_with_covariate(metrics))
    assert len(dataset.columns) == 20
    found = rows(
        dataset, "event_user", "n_day", "revenue", "is_payer", "revenue_before", "revenue_before_d14"
    )
    assert found == [
        ("a", 1, None, 0, None, 7.0),
        ("a", 2, 2.5, 1, 7.0, 7.0),
        ("b", None, None, 0, None, None),
        ("c", None, None, 0, None, None),
    ]
    types = dict(dataset.dtypes)
    assert {types[c] for c in ("skill", "level", "is_payer", "n_day", "retained", "churn")} == {"int"}
    assert {types[c] for c in ("revenue", "revenue_cum", "revenue_before")} == {"float"}
