"""Every user on every day, and running metrics along the days."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trialmart.operators.user_days import FLAGS, MEASURES, USER_DAY, merged_measures

# The prefix, and the metrics that get a running value unless others are asked for.
CUMULATIVE_PREFIX = "cum_user_"
CUMULATIVE_METRICS = (
    "attempts",
    "wins",
    "coins_spent",
    "real_coins_spent",
    "cnt_streak",
    "cnt_superball",
    "real_coins_spent_1att",
    "real_coins_spent_2plus_att",
    "real_coins_spent_superball",
    "cnt_lose_sb",
    "cnt_get_sb",
    "churn_m3",
    "churn_m3_win",
    "churn_m3_lose",
    "is_stucked",
    "is_super_stucked",
)


def observed_days(attempts: DataFrame) -> DataFrame:
    """One row with the sorted days that occur; no longer than the experiment in days."""
    return attempts.select("n_day").distinct().agg(F.array_sort(F.collect_list("n_day")).alias("days"))


def user_day_panel(users: DataFrame, user_days: DataFrame, days: DataFrame) -> DataFrame:
    """One row per user and observed day; measures are 0 on days without attempts.

    Partial measures come clustered by user; users are dealt out the same way and
    put in one relation with them. Measures of users outside ``users``, of days
    outside ``days``, and without a day are dropped.
    """
    return cumulative_panel(users, user_days, days, ())


def cumulative_panel(
    users: DataFrame,
    user_days: DataFrame,
    days: DataFrame,
    metrics: Iterable[str] = CUMULATIVE_METRICS,
) -> DataFrame:
    """The panel with running values of the metrics named.

    A user's days with attempts, and before them a row for the user, are merged and run through by
    one window. Only then does each of these rows unfold, into its own day and the observed days up
    to the user's next one; on those it stands for no attempts and the running values as they were.
    So neither the measures nor the dense panel are shuffled, and no dense row is aggregated, sorted or
    run through. Someone listed in two groups is a user in each. Running values count a day that is
    not among ``days``, too.
    """
    metrics = list(metrics)
    members = users.select(
        "event_user", "abgroup", F.lit(None).cast("int").alias("n_day"), "start_feature_user",
        F.lit(True).alias("is_member"),
    )
    played = user_days.filter(F.col("n_day").isNotNull())
    together = played.unionByName(members.repartition("event_user"), allowMissingColumns=True)
    # The user's own row has no day and comes first.
    along = Window.partitionBy("event_user", "abgroup").orderBy("n_day")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own_days = (
        together.groupBy(*USER_DAY)
        .agg(
            F.max("start_feature_user").alias("start_feature_user"),
            F.max("is_member").alias("is_member"),
            *merged_measures(),
        )
        .fillna(0, subset=list(MEASURES))
        .select(
            "event_user",
            "abgroup",
            F.col("n_day").alias("own_day"),
            F.max("start_feature_user").over(so_far).alias("start_feature_user"),
            F.max("is_member").over(so_far).alias("is_member"),
            F.lead("n_day").over(along).alias("next_day"),
            *MEASURES,
            *_running(metrics, so_far),
        )
        .filter("is_member")
    )
    first = F.coalesce(_place("own_day"), F.lit(1))
    behind = F.coalesce(_place("next_day"), F.size("days") + 1)
    is_own = F.col("n_day").eqNullSafe(F.col("own_day"))
    unfolded = own_days.withColumn("days", days.scalar()).withColumn(
        "n_day", F.explode(F.slice("days", first, behind - first))
    )
    return unfolded.select(
        *USER_DAY,
        "start_feature_user",
        *[F.when(is_own, F.col(name)).otherwise(0).alias(name) for name in MEASURES],
        *[CUMULATIVE_PREFIX + metric for metric in metrics],
    )


def _place(day: str) -> Column:
    """Where in ``days``, from 1, the first one stands that is not before this day."""
    found = F.array_position("days", F.col(day))
    before = F.filter("days", lambda other: other < F.col(day))
    return F.when(found > 0, found).when(found == 0, F.size(before) + 1).cast("int")


def _running(metrics: Iterable[str], so_far: WindowSpec) -> list[Column]:
    """Running values: the sum, or for a flag the highest so far."""
    return [
        (F.max if metric in FLAGS else F.sum)(metric).over(so_far).alias(CUMULATIVE_PREFIX + metric)
        for metric in metrics
    ]


def cumulative_metric(panel: DataFrame, metric: str) -> DataFrame:
    """Add the running value of one metric: the sum, or for a flag the highest so far."""
    return cumulative_metrics(panel, [metric])


def cumulative_metrics(
    panel: DataFrame, metrics: Iterable[str] = CUMULATIVE_METRICS
) -> DataFrame:
    """Running values along the days of a panel that is dense already."""
    so_far = (
        Window.partitionBy("event_user")
        .orderBy("n_day", "abgroup")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return panel.select("*", *_running(metrics, so_far))
