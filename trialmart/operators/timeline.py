"""What an attempt's neighbours in the user's timeline say about it.

Each attempt looks at the one before and the one after it, over the user's whole
timeline. A window per user does that, but would put all attempts of one user in
one task. The timelines of hot users are therefore cut into cells, which are ranges
of the very order the window uses: the window runs inside each cell, and the first
and last attempt of a cell get their missing neighbour from the adjoining cells'
edge rows.

How many ranges are written follows from the counted rows, and a cell is a number of
successive rows of a written range; so no cell is larger than a task should hold, whatever
the session's settings and however the sampled bounds of the ranges turned out. Attempts of
one moment, without a time, or equal in the whole order are cut like any others.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmart.functions import flag
from trialmart.operators.attempts import split_coins
from trialmart.operators.skew import HOT_ROWS, HOT_SHARE, hot_key_rows
from trialmart.session import stored

# Fixed values of the metric definitions.
CHURN_GAP_DAYS = 7
WIN_STREAK_ABOVE = {"is_5plus_ws": 4, "is_10plus_ws": 9, "is_20plus_ws": 19, "is_40plus_ws": 39}
STUCK_ABOVE = {"is_stucked": 20, "is_super_stucked": 40}

# An attempt that opens a timeline may bring along the win streak before it.
CARRIED = "carried_winstreak"
# Whether an attempt is the last of its user; there if asked for.
LAST = "is_last"

CELL = "timeline_cell"
PLACE = "timeline_place"
LEAST_CELL_ROWS = 100
# Metadata of the cell column where timelines were cut: attempts are not clustered by user alone.
CUT = "cut"

# Without a unique tie-breaker, attempts of the same moment are ordered by what
# the features read from them; rows that agree on all of it are interchangeable.
CONTENT_ORDER = (
    "date_attempt",
    "n_day",
    "level",
    "attempt",
    "is_win",
    "is_superball",
    "levels_winstreak",
    "coins_spent",
    "real_coins_spent",
)


def attempt_features(
    attempts: DataFrame,
    end: date,
    *,
    tie_breaker: str | None = None,
    hot_rows: int = HOT_ROWS,
    hot_share: float = HOT_SHARE,
    cells: int | None = None,
    cell_rows: int | None = None,
    mark_last: bool = False,
) -> DataFrame:
    """Attempts with churn, win-streak, superball and stuck flags.

    The result carries the column ``timeline_cell``; it is 0 unless the user is
    hot, and ``user_day_partials`` aggregates within it. A cell has at most ``cell_rows``
    attempts, by default as many as a user may have without being hot, or 100 if those are fewer;
    all hot users together are cut into no less than ``cells`` ranges. ``mark_last`` adds the
    column ``is_last``.
    """
    if not isinstance(attempts.schema["client_time"].dataType, T.TimestampType | T.TimestampNTZType):
        raise TypeError("client_time must be a timestamp: times as text have no definite order")
    order = ("client_time", *([tie_breaker] if tie_breaker else CONTENT_ORDER))
    hot = hot_key_rows(attempts, "event_user", hot_rows, hot_share)
    if hot is None:
        linked = _neighbours(attempts.withColumn(CELL, F.lit(0).cast("long")), ["event_user"], order)
    else:
        cell_rows = cell_rows or max(hot_rows, LEAST_CELL_ROWS)
        linked = _neighbours_across_cells(attempts, hot, order, cell_rows, cells or 1)
    return _features(linked if mark_last else linked.drop(LAST), end)


def _neighbours(attempts: DataFrame, timeline: Sequence[str], order: Sequence[str]) -> DataFrame:
    window = Window.partitionBy(*timeline).orderBy(*order)
    before = F.lag("levels_winstreak").over(window)
    return attempts.withColumns(
        {
            "next_time": F.lead("client_time").over(window),
            "next_superball": F.lead("is_superball").over(window),
            "prev_winstreak": F.coalesce(before, CARRIED) if CARRIED in attempts.columns else before,
            LAST: F.lead(F.lit(1)).over(window).isNull(),
        }
    )


def cut_timelines(
    attempts: DataFrame, hot: DataFrame, order: Sequence[str], cell_rows: int, ranges: int = 1
) -> DataFrame:
    """The attempts of hot users, stored in order, with the cell each lies in and its place.

    hot: ``event_user, key_rows``. A range is written by one task, so there are enough of them
    for twice the rows; cells are cut from the files as they were written.
    """
    total = hot.agg(F.sum("key_rows")).first()[0]
    ranges = max(ranges, -(-2 * total // cell_rows))
    # Rows equal in the whole order are told apart by their other columns, to be cut as well.
    full_order = ["event_user", *order, F.xxhash64(*attempts.columns)]
    ranged = stored(
        attempts.join(F.broadcast(hot.select("event_user")), "event_user", "left_semi")
        # Given a number, the adaptive planner leaves the partitions alone.
        .repartitionByRange(ranges, *full_order)
        .sortWithinPartitions(*full_order)
    )
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    # Files hold no more than 2^40 rows, and there are no more than 2^22 of them.
    position = part * (1 << 40) + F.col("_metadata.row_index")
    within = F.col("_metadata.row_index") % cell_rows
    return ranged.select("*", (position - within + 1).alias(CELL), position.alias(PLACE))


def _neighbours_across_cells(
    attempts: DataFrame, hot: DataFrame, order: Sequence[str], cell_rows: int, ranges: int
) -> DataFrame:
    ranged = cut_timelines(attempts, hot, order, cell_rows, ranges)
    # Their cell is 0, but no literal: the planner would leave that out of the clustering, and the
    # union below keeps a clustering only if it is the same on both sides.
    others = (
        attempts.join(F.broadcast(hot), "event_user", "left")
        .filter(F.col("key_rows").isNull())
        .withColumn(CELL, F.coalesce("key_rows", F.lit(0)))
        .drop("key_rows")
    )
    cell_order = Window.partitionBy("event_user").orderBy(CELL)
    edges = (
        ranged.groupBy("event_user", CELL)
        .agg(
            F.min_by(F.struct("client_time", "is_superball"), PLACE).alias("first"),
            F.max_by(F.struct("levels_winstreak"), PLACE).alias("last"),
        )
        .select(
            "event_user",
            CELL,
            F.lead("first").over(cell_order).alias("after"),
            F.lag("last").over(cell_order).alias("before"),
        )
        # Stated, so that the join never settles on clustering attempts by user alone.
        .repartition("event_user", CELL)
    )
    timeline = ["event_user", CELL]
    in_cell = Window.partitionBy(*timeline).orderBy(*order)
    within = _neighbours(ranged, timeline, order).withColumns(
        {
            "opens_cell": F.lag(F.lit(1)).over(in_cell).isNull(),
            "closes_cell": F.col(LAST),
        }
    )
    across = (
        within.join(edges, timeline, "left")
        .withColumns(
            {
                "next_time": F.when(F.col("closes_cell"), F.col("after.client_time")).otherwise(
                    F.col("next_time")
                ),
                "next_superball": F.when(
                    F.col("closes_cell"), F.col("after.is_superball")
                ).otherwise(F.col("next_superball")),
                # The first cell of a timeline has none before it.
                "prev_winstreak": F.when(
                    F.col("opens_cell") & F.col("before").isNotNull(),
                    F.col("before.levels_winstreak"),
                ).otherwise(F.col("prev_winstreak")),
                LAST: F.col("closes_cell") & F.col("after").isNull(),
            }
        )
        .drop("after", "before", "opens_cell", "closes_cell", PLACE)
    )
    linked = _neighbours(others, timeline, order).unionByName(across)
    return linked.withMetadata(CELL, {CUT: True})


def _when_else_zero(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.lit(0))


def _features(linked: DataFrame, end: date) -> DataFrame:
    gap = F.datediff("next_time", "client_time")
    # The last attempt has no gap: it counts as churn unless the end is too near to tell.
    too_late_to_tell = F.col("date_attempt") > F.date_sub(F.lit(end), CHURN_GAP_DAYS)
    churn = F.when((gap < CHURN_GAP_DAYS) | too_late_to_tell, F.lit(0)).otherwise(F.lit(1))
    superball, next_superball = F.col("is_superball"), F.col("next_superball")
    return (
        linked.withColumns(
            {
                # Derived anew from columns that are here anyway, so that the stored
                # ones are neither read nor shuffled.
                "is_lose": 1 - F.col("is_win"),
                **split_coins(),
                "timediff_att": gap,
                "churn_m3": churn,
                "prev_levels_winstreak": F.coalesce("prev_winstreak", F.lit(0)),
            }
        )
        .withColumns(
            {
                "churn_m3_win": _when_else_zero(F.col("is_win") == 1, F.col("churn_m3")),
                "churn_m3_lose": _when_else_zero(F.col("is_win") == 0, F.col("churn_m3")),
                **{
                    name: flag(F.col("prev_levels_winstreak") > above)
                    for name, above in WIN_STREAK_ABOVE.items()
                },
                "is_lose_sb": _when_else_zero(superball == 1, F.col("is_lose")),
                "is_get_sb": flag((superball == 0) & (next_superball == 1)),
                **{name: flag(F.col("attempt") > above) for name, above in STUCK_ABOVE.items()},
            }
        )
        .drop("prev_winstreak")
    )
