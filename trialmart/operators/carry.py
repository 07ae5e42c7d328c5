"""Timelines carried on from day to day, so that a new day is read by itself.

What an attempt's neighbours say about it is settled once the user's next attempt is known. All
attempts but the last of each user are therefore summed up for good, as partial user-days; the last
one stays *open* and is kept as it is, with the win streak before it. The next days' attempts are put
behind the open ones, which closes these and leaves new ones open. At any time the metrics of all
days follow from the partial user-days so far and the open attempts, which count as last.
"""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialmart.operators.timeline import CARRIED, LAST, attempt_features
from trialmart.operators.user_days import user_day_partials
from trialmart.session import stored


class Carried(NamedTuple):
    """Partial user-days of the attempts closed, and the attempts left open."""

    closed: DataFrame
    open: DataFrame


def carry_on(
    attempts: DataFrame, opened: DataFrame | None, end: date, *, tie_breaker: str, **hot
) -> Carried:
    """Close what new attempts allow to close.

    attempts: those of days not seen before. opened: the ``open`` attempts so far, None at the
    beginning. Attempts that lie before a user's open attempt come too late to be put behind it:
    they are an error, and the days have to be carried on anew from before them.
    """
    timeline = attempts.withColumn(CARRIED, F.lit(None).cast("int"))
    if opened is not None:
        _refuse_late(attempts, opened, tie_breaker)
        timeline = timeline.unionByName(opened.select(*timeline.columns))
    features = attempt_features(
        timeline, end, tie_breaker=tie_breaker, mark_last=True, **hot
    )
    # Read twice; the days carried on are few.
    features = stored(features)
    last = features.filter(LAST).withColumn(CARRIED, F.col("prev_levels_winstreak").cast("int"))
    return Carried(
        user_day_partials(features.filter(~F.col(LAST)).drop(LAST)),
        last.select(*timeline.columns),
    )


def _refuse_late(attempts: DataFrame, opened: DataFrame, tie_breaker: str) -> None:
    place = F.struct("client_time", tie_breaker)
    first = attempts.groupBy("event_user").agg(F.min(place).alias("first"))
    late = first.join(opened.select("event_user", place.alias("open")), "event_user").filter(
        F.col("first") < F.col("open")
    )
    found = late.select("event_user").head()
    if found:
        raise ValueError(
            f"attempts of user {found[0]} lie before those carried on; start from an earlier day"
        )


def user_days_so_far(closed: DataFrame, opened: DataFrame, end: date, *, tie_breaker: str) -> DataFrame:
    """Partial user-days of all attempts carried on, clustered by user; open ones count as last."""
    features = attempt_features(opened, end, tie_breaker=tie_breaker)
    partials = closed.unionByName(user_day_partials(features).select(*closed.columns))
    return partials.repartition("event_user")
