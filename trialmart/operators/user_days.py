"""Attempt features summed up per user, group and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialmart.operators.attempts import COINS, SPLIT_COINS
from trialmart.operators.timeline import CELL, CUT, STUCK_ABOVE, WIN_STREAK_ABOVE

USER_DAY = ("event_user", "abgroup", "n_day")

# Output column -> attempt column it sums.
SUMMED = {
    **{name: name for name in COINS},
    "pre_boosters": "pre_boosters",
    "in_boosters": "in_boosters",
    "cnt_streak": "is_streak",
    "wins": "is_win",
    "cnt_superball": "is_superball",
    **{name: name for name in SPLIT_COINS},
    "cnt_lose_sb": "is_lose_sb",
    "cnt_get_sb": "is_get_sb",
}
# Whether any attempt of the day had the flag.
FLAGS = (
    "churn_m3",
    "churn_m3_win",
    "churn_m3_lose",
    *WIN_STREAK_ABOVE,
    "is_lose_sb",
    "is_get_sb",
    *STUCK_ABOVE,
    "is_streak",
    "is_superball",
)
ADDITIVE = ("attempts", *SUMMED)
MEASURES = (*ADDITIVE, *FLAGS)


def user_day_partials(features: DataFrame) -> DataFrame:
    """Measures per user, day and timeline cell.

    This needs no shuffle: the features are already clustered by user and cell.
    Unless timelines were cut, the result is final and clustered by user. Otherwise
    the small remainder that is still to be merged moves to its user.
    """
    partials = (
        features.groupBy("event_user", CELL, "abgroup", "n_day")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            *[F.sum(source).alias(name) for name, source in SUMMED.items()],
            *[F.max(name).alias(name) for name in FLAGS],
        )
        .drop(CELL)
    )
    return partials.repartition("event_user") if features.schema[CELL].metadata.get(CUT) else partials


def merged_measures() -> list:
    """Aggregates that combine partial measures into measures."""
    return [
        *[F.sum(name).alias(name) for name in ADDITIVE],
        *[F.max(name).alias(name) for name in FLAGS],
    ]


def user_day_metrics(features: DataFrame) -> DataFrame:
    """The 35 measures of each user, group and day with attempts."""
    return user_day_partials(features).groupBy(*USER_DAY).agg(*merged_measures())
