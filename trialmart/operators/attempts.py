"""The attempt fact table: one typed row per level attempt of a cohort user."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmart.functions import flag, json_texts, loose_bool, loose_double, loose_int
from trialmart.operators.members import possible_members
from trialmart.operators.skew import HOT_ROWS, HOT_SHARE, join_users

# Keys of the attempt payload.
SPEND_KINDS = (
    "coins_spent",
    "coins_spent_additional_moves",
    "coins_spent_inlevelboosters",
    "coins_spent_startboosters",
)
COINS = (*SPEND_KINDS, *(f"real_{kind}" for kind in SPEND_KINDS))
PRE_BOOSTERS = (
    "boosts_aircraft",
    "unlimited_boosts_aircraft",
    "boosts_bomb_rocket",
    "unlimited_boosts_bomb_rocket",
    "boosts_lightning",
    "unlimited_boosts_lightning",
)
IN_BOOSTERS = (
    "boosts_hammer",
    "boosts_swap",
    "boosts_reshuffle",
    "boosts_vertical_line",
    "boosts_horizontal_line",
)
SUPERBALL = "boosts_super_lightning"
COUNTERS = ("mortas_helmets", "levels_winstreak", "levels_sb_streak")
PAYLOAD_KEYS = (*COINS, *PRE_BOOSTERS, *IN_BOOSTERS, SUPERBALL, *COUNTERS)
WIN_REASON = "completed"
STREAK_HELMETS = 3

SPLIT_COINS = tuple(
    f"{coins}_{part}"
    for coins in ("coins_spent", "real_coins_spent")
    for part in ("1att", "2plus_att", "superball")
)
# The 34 columns of the table, in order.
ATTEMPT_COLUMNS = (
    "event_user",
    "abgroup",
    "n_day",
    "date_attempt",
    "start_feature_user",
    "client_time",
    "level",
    "complexity",
    "attempt",
    "reason",
    *COINS,
    "pre_boosters",
    "in_boosters",
    "mortas_helmets",
    "is_streak",
    "influence",
    "is_win",
    "is_lose",
    "is_superball",
    *SPLIT_COINS,
    "levels_winstreak",
    "levels_sb_streak",
)


def attempt_facts(
    levels: DataFrame,
    users: DataFrame,
    start: date,
    end: date,
    *,
    broadcast_users: bool,
    tie_breaker: str | None = None,
    hot_rows: int = HOT_ROWS,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Attempts of cohort users from their first feature day on.

    One scan covers the whole inclusive date range. The payload is parsed once
    per row: after the join and the day filter where the facts stay in place, before
    the shuffle otherwise, so that it moves as a few typed columns; a filter of the cohort spares
    most other users' payloads that parse. ``tie_breaker`` names a unique
    column of ``levels`` to carry along, so that attempts with equal
    ``client_time`` have a defined order later.
    """
    carried = [tie_breaker] if tie_breaker else []
    in_range = levels.filter(F.col("partition_date").between(F.lit(start), F.lit(end))).select(
        F.col("user_id").alias("event_user"),
        F.col("partition_date").alias("date_attempt"),
        "client_time",
        "level",
        "complexity",
        "attempt",
        "reason",
        "influence",
        "event_payload",
        *carried,
    )
    parse = json_texts("event_payload", PAYLOAD_KEYS)
    if not broadcast_users:
        in_range = _typed(possible_members(in_range, users).withColumn("payload", parse))
    joined = join_users(
        in_range, users, broadcast_users=broadcast_users, hot_rows=hot_rows, hot_share=hot_share
    )
    present = joined.withColumn(
        "n_day", F.datediff("date_attempt", "start_feature_user") + 1
    ).filter(F.col("n_day") > 0)
    if broadcast_users:
        present = _typed(present.withColumn("payload", parse))
    return (
        present.withColumns(
            {
                "influence": flag(loose_bool(F.col("influence"))),
                "is_win": flag(F.col("reason") == WIN_REASON),
                # An unknown reason counts as a loss.
                "is_lose": 1 - flag(F.col("reason") == WIN_REASON),
                **split_coins(),
            }
        )
        .select(*ATTEMPT_COLUMNS, *carried)
    )


def _typed(parsed: DataFrame) -> DataFrame:
    return parsed.select("*", *_payload_columns()).drop("payload", "event_payload")


def _text(key: str) -> Column:
    return F.col("payload").getField(key)


def _payload_columns() -> list[Column]:
    is_set = [flag(loose_bool(_text(key))) for key in PRE_BOOSTERS]
    used = [loose_double(_text(key)) for key in IN_BOOSTERS]
    counters = {name: loose_int(_text(name)) for name in COUNTERS}
    return [
        *[loose_double(_text(name)).alias(name) for name in COINS],
        reduce(add, is_set).alias("pre_boosters"),
        # NULL if any of the five is missing.
        reduce(add, used).alias("in_boosters"),
        *[column.alias(name) for name, column in counters.items()],
        flag(counters["mortas_helmets"] == STREAK_HELMETS).alias("is_streak"),
        flag(loose_bool(_text(SUPERBALL))).alias("is_superball"),
    ]


def split_coins() -> dict[str, Column]:
    """Each coin amount where the attempt is of the given kind, else 0."""
    kinds = {
        "1att": F.col("attempt") == 1,
        "2plus_att": F.col("attempt") > 1,
        "superball": F.col("is_superball") == 1,
    }
    return {
        f"{coins}_{part}": F.when(condition, F.col(coins)).otherwise(F.lit(0.0))
        for coins in ("coins_spent", "real_coins_spent")
        for part, condition in kinds.items()
    }
