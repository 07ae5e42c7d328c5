"""KPI tables per experiment group and day, declared as lists of terms."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmart.functions import flag, percent, ratio

GROUP_DAY = ("abgroup", "n_day")
USER = "event_user"


class Users(NamedTuple):
    """Number of distinct users, or of those for whom ``where`` holds on some row."""

    name: str
    where: str | None = None


class Total(NamedTuple):
    name: str
    of: str


class Mean(NamedTuple):
    name: str
    of: str


class Ratio(NamedTuple):
    """``numerator / denominator``; as a percentage, and rounded, if so asked."""

    name: str
    numerator: str
    denominator: str
    as_percent: bool = False
    digits: int | None = None

    def column(self) -> Column:
        top, bottom = F.col(self.numerator), F.col(self.denominator)
        if self.digits is not None:
            # Divides before scaling, and so rounds the very same double.
            return F.round(ratio(top, bottom) * 100, self.digits)
        return (percent if self.as_percent else ratio)(top, bottom)


Term = Users | Total | Mean


def _direct(term: Term) -> Column:
    match term:
        case Users(name, None):
            return F.count(USER).alias(name)
        case Users(name, where):
            return F.count(F.when(F.expr(where), F.col(USER))).alias(name)
        case Total(name, of):
            return F.sum(of).alias(name)
        case Mean(name, of):
            return F.avg(of).alias(name)


def _within_user(term: Term) -> list[Column]:
    match term:
        case Users(_, None):
            return []
        case Users(name, where):
            return [F.max(flag(F.expr(where))).alias(name)]
        case Total(name, of):
            return [F.sum(of).alias(name)]
        case Mean(name, of):
            return [F.sum(of).alias(name), F.count(of).alias(f"{name}__rows")]


def _across_users(term: Term) -> Column:
    match term:
        case Users(name, None):
            return F.count(USER).alias(name)
        case Users(name, _):
            return F.count(F.when(F.col(name) == 1, F.col(USER))).alias(name)
        case Total(name, _):
            return F.sum(name).alias(name)
        case Mean(name, _):
            return ratio(F.sum(name), F.sum(f"{name}__rows")).alias(name)


def rollup(
    dataset: DataFrame, terms: Sequence[Term], ratios: Sequence[Ratio], *, one_row_per_user_day: bool
) -> DataFrame:
    """Aggregate the dataset to one row per group and day, then add the ratios.

    If each user has one row per group and day, counting users is counting rows
    and only the handful of partial results per task is shuffled. Otherwise rows
    are first reduced per user, which keeps user counts distinct without
    duplicating the input for each of them.
    """
    if one_row_per_user_day:
        totals = dataset.groupBy(*GROUP_DAY).agg(*[_direct(term) for term in terms])
    else:
        inner = [column for term in terms for column in _within_user(term)]
        per_user = dataset.groupBy(*GROUP_DAY, USER).agg(*inner)
        totals = per_user.groupBy(*GROUP_DAY).agg(*[_across_users(term) for term in terms])
    return totals.withColumns({r.name: r.column() for r in ratios})


def _totals(*names: str) -> list[Total]:
    return [Total(name, name) for name in names]


def _cumulative_means(*names: str) -> list[Mean]:
    return [Mean(f"cum_{name}", f"cum_user_{name}") for name in names]


# Names and formulas of the KPI columns, here and below.
BASE_TERMS = (
    Users("total_users"),
    Total("retained_users", "retained"),
    Total("churned_users", "churn"),
    Total("converted_users", "converted_cum"),
    Users("paying_users", where="revenue > 0"),
    *_totals("revenue_cum", "revenue"),
)
BASE_RATIOS = (
    Ratio("arpu", "revenue_cum", "total_users"),
    Ratio("arppu", "revenue_cum", "converted_users"),
    Ratio("darpu", "revenue", "retained_users"),
    Ratio("darppu", "revenue", "paying_users"),
    Ratio("conversion", "converted_users", "total_users", as_percent=True, digits=2),
    Ratio("paying_share", "paying_users", "retained_users", as_percent=True, digits=2),
    Ratio("retention", "retained_users", "total_users", as_percent=True, digits=2),
    Ratio("churn", "churned_users", "total_users", as_percent=True, digits=2),
)

M3_TERMS = (
    Users("total_users"),
    Total("retained_users", "retained"),
    Total("sum_attempts", "attempts"),
    Total("sum_wins", "wins"),
    *_cumulative_means(
        "attempts",
        "wins",
        "coins_spent",
        "real_coins_spent",
        "real_coins_spent_1att",
        "real_coins_spent_2plus_att",
        "real_coins_spent_superball",
    ),
    Total("sum_churn_m3", "churn_m3"),
    Total("sum_churn_m3_lose", "churn_m3_lose"),
    Total("sum_churn_m3_win", "churn_m3_win"),
    *_totals(
        "is_stucked",
        "is_super_stucked",
        "coins_spent",
        "real_coins_spent",
        "real_coins_spent_1att",
        "coins_spent_1att",
        "real_coins_spent_2plus_att",
    ),
)
M3_RATIOS = (
    Ratio("dwins", "sum_wins", "retained_users"),
    Ratio("dattempts", "sum_attempts", "retained_users"),
    Ratio("daily_share_stucked", "is_stucked", "retained_users", as_percent=True),
    Ratio("daily_share_super_stucked", "is_super_stucked", "retained_users", as_percent=True),
    Ratio("daily_coins_spent", "coins_spent", "retained_users"),
    Ratio("daily_real_coins_spent", "real_coins_spent", "retained_users"),
    Ratio("daily_real_coins_spent_1att", "real_coins_spent_1att", "retained_users"),
    Ratio("daily_real_coins_spent_2plus_att", "real_coins_spent_2plus_att", "retained_users"),
    Ratio("daily_churn_m3", "sum_churn_m3", "retained_users", as_percent=True),
    Ratio("daily_churn_m3_lose", "sum_churn_m3_lose", "retained_users", as_percent=True),
    Ratio("daily_churn_m3_win", "sum_churn_m3_win", "retained_users", as_percent=True),
    Ratio("daily_share_rcoins_1att", "real_coins_spent_1att", "real_coins_spent", as_percent=True),
    Ratio("daily_share_coins_1att", "coins_spent_1att", "coins_spent", as_percent=True),
    Ratio(
        "cum_share_rcoins_1att", "cum_real_coins_spent_1att", "cum_real_coins_spent", as_percent=True
    ),
)

STREAK_TERMS = (
    Users("total_users"),
    Total("m3_users", "is_m3"),
    Total("sb_users", "is_superball"),
    Total("streak_users", "is_streak"),
    Total("lose_sb_users", "is_lose_sb"),
    Total("not_sb_not_streak_users", "is_not_sb_not_streak"),
    Total("sum_attempts", "attempts"),
    *_totals(
        "coins_spent",
        "real_coins_spent",
        "real_coins_spent_1att",
        "real_coins_spent_superball",
        "coins_spent_1att",
        "real_coins_spent_2plus_att",
    ),
    *_cumulative_means("cnt_superball", "cnt_lose_sb"),
    Total("daily_avg_length_sb_streak", "sb_streak_length"),
    # Users with such a streak that day; not cumulative over days.
    *_totals("is_5plus_ws", "is_10plus_ws", "is_20plus_ws", "is_40plus_ws"),
)
STREAK_RATIOS = (
    Ratio("share_sb_users", "sb_users", "m3_users", as_percent=True),
    Ratio("share_lost_sb_users", "lose_sb_users", "sb_users", as_percent=True),
    Ratio("share_not_sb_not_streak", "not_sb_not_streak_users", "m3_users", as_percent=True),
    Ratio("share_streak_users", "streak_users", "m3_users", as_percent=True),
    Ratio("daily_avg_length_sb_streak", "daily_avg_length_sb_streak", "sb_users"),
    Ratio("daily_share_users_5plus_ws", "is_5plus_ws", "m3_users", as_percent=True),
    Ratio("daily_share_users_10plus_ws", "is_10plus_ws", "m3_users", as_percent=True),
    Ratio("daily_share_users_20plus_ws", "is_20plus_ws", "m3_users", as_percent=True),
    Ratio("daily_share_users_40plus_ws", "is_40plus_ws", "m3_users", as_percent=True),
    Ratio("daily_share_rcoins_1att", "real_coins_spent_1att", "real_coins_spent", as_percent=True),
    Ratio(
        "daily_share_rcoins_superball",
        "real_coins_spent_superball",
        "real_coins_spent",
        as_percent=True,
    ),
    Ratio("daily_share_coins_1att", "coins_spent_1att", "coins_spent", as_percent=True),
)


def base_kpis(dataset: DataFrame, *, one_row_per_user_day: bool = False) -> DataFrame:
    """Monetisation, conversion, retention and churn.

    ``total_users`` counts the users present on the day, not all enrolled ones.
    """
    return rollup(dataset, BASE_TERMS, BASE_RATIOS, one_row_per_user_day=one_row_per_user_day)


def m3_kpis(dataset: DataFrame, *, one_row_per_user_day: bool = False) -> DataFrame:
    """Attempts, wins, coins, churn and stuck players of the core game."""
    return rollup(dataset, M3_TERMS, M3_RATIOS, one_row_per_user_day=one_row_per_user_day)


def _with_streaks(dataset: DataFrame) -> DataFrame:
    played = F.col("attempts") > 0
    neither = (F.col("is_superball") == 0) & (F.col("is_streak") == 0)
    superballs, lost = F.col("cnt_superball"), F.col("cnt_lose_sb")
    # A run of superballs that was never lost counts as one run.
    runs = F.when((superballs > 0) & (lost == 0), F.lit(1)).otherwise(lost)
    return dataset.withColumns(
        {
            "is_m3": flag(played),
            "is_not_sb_not_streak": flag(neither & played),
            "sb_streak_length": ratio(superballs, runs),
        }
    )


def streak_kpis(dataset: DataFrame, *, one_row_per_user_day: bool = False) -> DataFrame:
    """Superball and win-streak engagement."""
    prepared = _with_streaks(dataset)
    return rollup(prepared, STREAK_TERMS, STREAK_RATIOS, one_row_per_user_day=one_row_per_user_day)


# --- partial states -----------------------------------------------------------------------------

TABLES = {
    "base": (BASE_TERMS, BASE_RATIOS),
    "m3": (M3_TERMS, M3_RATIOS),
    "streak": (STREAK_TERMS, STREAK_RATIOS),
}


def _states(term: Term) -> dict[str, tuple[Column | None, Column]]:
    """State name -> value within a user, if rows have to be reduced to users first, and the
    same over rows of which each user has one."""
    match term:
        case Users(_, None):
            return {"users": (None, F.count(USER))}
        case Users(name, where):
            state, holds = f"users__{name}", F.expr(where)
            return {state: (F.max(flag(holds)), F.count(F.when(holds, F.col(USER))))}
        case Total(_, of):
            return {f"sum__{of}": (F.sum(of), F.sum(of))}
        case Mean(_, of):
            return {f"sum__{of}": (F.sum(of), F.sum(of)), f"rows__{of}": (F.count(of), F.count(of))}


def _of_states(term: Term) -> Column:
    match term:
        case Users(name, None):
            return F.col("users").alias(name)
        case Users(name, _):
            return F.col(f"users__{name}").alias(name)
        case Total(name, of):
            return F.col(f"sum__{of}").alias(name)
        case Mean(name, of):
            return ratio(F.col(f"sum__{of}"), F.col(f"rows__{of}")).alias(name)


def kpi_states(
    dataset: DataFrame, tables: Sequence[str] = tuple(TABLES), *, one_row_per_user_day: bool = False
) -> DataFrame:
    """One row per group and day with what all the given KPI tables are made of, in one pass.

    States of different users can be added up: those of batches of users, or of days, are merged
    by ``kpis_of_states``.
    """
    if "streak" in tables:
        dataset = _with_streaks(dataset)
    states = {name: parts for table in tables for term in TABLES[table][0]
              for name, parts in _states(term).items()}
    if one_row_per_user_day:
        return dataset.groupBy(*GROUP_DAY).agg(*[row.alias(name) for name, (_, row) in states.items()])
    within = [user.alias(name) for name, (user, _) in states.items() if user is not None]
    per_user = dataset.groupBy(*GROUP_DAY, USER).agg(*within)
    return per_user.groupBy(*GROUP_DAY).agg(
        *[
            (F.count(USER) if name == "users" else
             F.count(F.when(F.col(name) == 1, F.col(USER))) if name.startswith("users__") else
             F.sum(name)).alias(name)
            for name in states
        ]
    )


def kpis_of_states(states: DataFrame, table: str) -> DataFrame:
    """One of the KPI tables, from states of any number of batches with different users."""
    terms, ratios = TABLES[table]
    names = {name for term in terms for name in _states(term)}
    merged = states.groupBy(*GROUP_DAY).agg(*[F.sum(name).alias(name) for name in sorted(names)])
    totals = merged.select(*GROUP_DAY, *[_of_states(term) for term in terms])
    return totals.withColumns({r.name: r.column() for r in ratios})
