"""Who takes part in the experiment, described as of the day they joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialmart.experiment import Experiment, ExperimentDates
from trialmart.operators.segments import session_segments, session_snapshot, valid_sessions


def enrolled_users(ab_users: DataFrame, experiment: Experiment) -> DataFrame:
    """Good users of the experiment and the first day the feature could affect each."""
    enrolled = F.to_date("test_enroll_date")
    return (
        experiment.rows_of(ab_users)
        .filter(F.col("good_user").try_cast("boolean"))
        .select(
            "test_id",
            "app_short",
            "abgroup",
            "event_user",
            "metric_calc_start_date",
            "device_region",
            enrolled.alias("test_enroll_date"),
            F.greatest(enrolled, F.to_date("feature_start_date")).alias("start_feature_user"),
        )
    )


def experiment_cohort(
    enrolled: DataFrame,
    sessions: DataFrame,
    experiment: Experiment,
    dates: ExperimentDates,
    *,
    broadcast_users: bool,
) -> DataFrame:
    """Enrolled users with the session attributes of their enrolment day.

    The day must match exactly. Users without a valid session that day keep NULL
    labels and get 0 for skill and level.

    Only enrolment-day sessions matter, so with a cohort small enough to
    broadcast all others are dropped before their payload is parsed.
    """
    start, end = dates.require("test_start_date", "enroll_end_date")
    kept = valid_sessions(sessions, experiment.store, start, end)
    if broadcast_users:
        enrolment_days = enrolled.selectExpr(
            "event_user AS user_id", "test_enroll_date AS partition_date"
        )
        kept = kept.join(F.broadcast(enrolment_days), ["user_id", "partition_date"], "left_semi")
    snapshot = session_snapshot(session_segments(kept))
    return enrolled.join(snapshot, ["event_user", "test_enroll_date"], "left").fillna(
        0, subset=["skill", "level"]
    )


def cohort_users(cohort: DataFrame) -> DataFrame:
    """The narrow cohort relation the gameplay metrics need."""
    return cohort.select("event_user", "abgroup", "start_feature_user")


def count_unique_users(users: DataFrame) -> int:
    """Number of users; an error if one is listed twice, which would double every metric."""
    row = (
        users.groupBy("event_user")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("users"), F.max("n").alias("most"))
        .first()
    )
    if row["most"] is not None and row["most"] > 1:
        raise ValueError("the cohort lists a user more than once")
    return row["users"]
