"""The user-by-day dataset every KPI is computed from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialmart.functions import flag


def _int(name: str) -> Column:
    return F.col(name).try_cast("int").alias(name)


def _float(name: str) -> Column:
    return F.col(name).cast("float").alias(name)


def base_dataset(cohort: DataFrame, user_days: DataFrame) -> DataFrame:
    """Cohort attributes beside each user's daily metrics: 20 columns.

    A user without any test day keeps one row with NULL ``n_day``.
    ``revenue_before_d14`` is the user's highest covariate over all days present.
    The join and the window both cluster by user, so they share one shuffle.
    """
    all_days = Window.partitionBy("event_user")
    return (
        cohort.join(user_days, "event_user", "left")
        .withColumn("is_payer", flag(F.col("revenue") > 0))
        .withColumn("revenue_before_d14", F.max("revenue_before").over(all_days))
        .select(
            "test_id",
            "app_short",
            "abgroup",
            "event_user",
            "metric_calc_start_date",
            "device_region",
            "skill_payment_seg",
            "payer_type",
            _int("skill"),
            _int("level"),
            _int("is_payer"),
            _int("n_day"),
            _float("revenue_before"),
            _int("retained"),
            _int("churn"),
            _float("revenue_cum"),
            _int("converted_cum"),
            _float("revenue"),
            _int("converted"),
            _float("revenue_before_d14"),
        )
    )


def add_gameplay(dataset: DataFrame, gameplay: DataFrame) -> DataFrame:
    """Put the gameplay metrics beside the dataset rows of the same user, day and group."""
    return dataset.join(gameplay, ["event_user", "n_day", "abgroup"], "left")
