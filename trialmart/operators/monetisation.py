"""Money, activity and churn per user and day, from the long metric table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "personal_test_participation_day_num"

# Metric names in the source table and the columns they become.
MAIN_METRICS = {
    "revenue": "revenue",
    "is_payer": "converted",
    "revenue_cum": "revenue_cum",
    "is_payer_cum": "converted_cum",
    "active": "retained",
    "weekly_churn": "churn",
}
COVARIATE_METRIC = "prev_revenue_cum"
COVARIATE = "revenue_before"


def _total(metric: str, output: str, extra: Column | None = None) -> Column:
    """Sum of one metric's values; NULL when there are none."""
    wanted = F.col("metric_name") == metric
    if extra is not None:
        wanted = wanted & extra
    return F.sum(F.when(wanted, F.col("value"))).alias(output)


def pre_period_covariate(metrics: DataFrame) -> DataFrame:
    """Revenue before the test, with day -k placed on test day k."""
    return (
        metrics.filter(F.col("metric_name") == COVARIATE_METRIC)
        .groupBy("event_user", F.abs(DAY).alias("n_day"))
        .agg(F.sum("value").alias(COVARIATE))
    )


def main_metrics_pivot(metrics: DataFrame) -> DataFrame:
    """The main metrics of each user and test day as columns."""
    return (
        metrics.filter(F.col(DAY) > 0)
        .groupBy("event_user", F.col(DAY).alias("n_day"))
        .agg(*[_total(metric, output) for metric, output in MAIN_METRICS.items()])
    )


def metrics_with_covariate(metrics: DataFrame) -> DataFrame:
    """Both of the above joined on user and day, in one scan and one shuffle.

    Day -k and day k share the group ``abs(day)``; a group counts only if the
    user has some row on the positive day itself.
    """
    in_test = F.col(DAY) > 0
    return (
        metrics.groupBy("event_user", F.abs(DAY).alias("n_day"))
        .agg(
            *[_total(metric, output, in_test) for metric, output in MAIN_METRICS.items()],
            _total(COVARIATE_METRIC, COVARIATE),
            F.max(F.when(in_test, F.lit(1))).alias("has_test_day"),
        )
        .filter("has_test_day = 1")
        .drop("has_test_day")
    )
