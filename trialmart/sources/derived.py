"""The four source tables derived from a plain ``events`` table.

Used by the registered queries and by tests. All arithmetic is on integers and
decimals and payloads are built by concatenation, so that any SQL engine derives
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialmart.sources.catalog import Source

FIRST_DAY = "DATE'2024-01-01'"
ENROLLED = f"date_add({FIRST_DAY}, CAST(user_id % 10 AS INT))"
CALENDAR = f"""
    {FIRST_DAY} AS test_start_date, DATE'2024-01-30' AS test_end_date,
    DATE'2024-01-10' AS enroll_end_date,
    DATE'2024-01-04' AS feature_start_date, DATE'2024-01-30' AS feature_end_date"""

AB_USERS = f"""
WITH users AS (SELECT DISTINCT user_id FROM {{events}}),
enrolled AS (
    SELECT 'T1' AS test_id, 'hs_as' AS app_short, user_id FROM users
    UNION ALL SELECT 'T1', 'hs_gp', user_id FROM users WHERE user_id % 5 = 0
    UNION ALL SELECT 'T2', 'hs_as', user_id FROM users WHERE user_id % 7 = 0
)
SELECT test_id, app_short, concat('g', user_id % 3) AS abgroup, user_id AS event_user,
       user_id % 11 <> 0 AS good_user,
       {ENROLLED} AS test_enroll_date, {ENROLLED} AS metric_calc_start_date,
       CASE user_id % 4 WHEN 0 THEN 'EU' WHEN 1 THEN 'US' WHEN 2 THEN 'ASIA' ELSE 'OTHER' END
           AS device_region,
       {CALENDAR}
FROM enrolled"""


def _json(fields: dict[str, str], *awkward: tuple[str, str]) -> str:
    """SQL for JSON text of the fields; a field whose expression is NULL is left out.

    awkward: name and expression of more members behind them, names repeated or not.
    """
    members = [f"""concat('"{name}": ', {value})""" for name, value in (*fields.items(), *awkward)]
    return f"concat('{{{{', concat_ws(', ', {', '.join(members)}), '}}}}')"


def _some(n: int, value: str) -> str:
    return f"CASE WHEN event_id % {n} = 0 THEN {value} END"


# A string with a raw tab and a raw line feed in it.
_NOTE = ("note", _some(59, """concat('"a', chr(9), 'b', chr(10), 'c"')"""))


def _unless(n: int, value: str) -> str:
    return f"CASE WHEN event_id % {n} <> 0 THEN {value} END"


WITH_K = """
    SELECT *, CAST(ts AS DATE) AS day, CAST(get_json_object(props, '$.k') AS INT) AS k
    FROM {events}"""

_SESSION_PAYLOAD = _json(
    {
        # Some whole numbers are recorded with a fraction, which the readers drop.
        "level": (
            "concat((k * 7 + event_id) % 300, if(event_id % 67 = 0, '.9', ''))"
        ),
        "segment.skill": _unless(
            43, "if(event_id % 29 = 0, '0.829', concat('0.', lpad(k % 25 * 4, 2, '0')))"
        ),
        "segment.payment": (
            "if(event_type = 'purchase',"
            " concat(cents DIV 100, '.', lpad(cents % 100, 2, '0')), '0.0')"
        ),
        "payer_type": _unless(
            41, """CASE k % 3 WHEN 0 THEN '"none"' WHEN 1 THEN '"minnow"' ELSE '"whale"' END"""
        ),
        "segment.skillpayment": """CASE WHEN event_id % 47 = 0 THEN '"custom_seg"' END""",
    },
    _NOTE,
    # Repeated keys, of which the first value that is not null counts.
    ("level", _some(53, "event_id % 7")),
    ("payer_type", "CASE WHEN event_id % 71 = 0 AND event_id % 41 <> 0 THEN 'null' END"),
    ("note", _some(59, "1")),
)
SESSIONS = f"""
SELECT user_id, day AS partition_date,
       CASE WHEN event_id % 17 = 0 THEN 'googleplay' ELSE 'ios' END AS store,
       CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '-1'
            ELSE concat('s', event_id) END AS session_id,
       {_SESSION_PAYLOAD} AS user_payload
FROM (SELECT *, CAST(floor(value * 5) AS BIGINT) AS cents FROM ({WITH_K}))"""

_LEVEL_PAYLOAD = _json(
    {
        "coins_spent": _unless(13, "if(event_id % 73 = 0, 'null', CAST(k AS STRING))"),
        "coins_spent_additional_moves": "k % 7",
        "coins_spent_inlevelboosters": "k % 5",
        "coins_spent_startboosters": "k % 3",
        "real_coins_spent": "k % 40",
        "real_coins_spent_additional_moves": "k % 6",
        "real_coins_spent_inlevelboosters": "k % 4",
        "real_coins_spent_startboosters": "k % 2",
        "boosts_aircraft": "event_id % 3 = 0",
        "boosts_bomb_rocket": "event_id % 4 = 0",
        "boosts_lightning": "event_id % 6 = 0",
        "unlimited_boosts_aircraft": "event_id % 7 = 0",
        "unlimited_boosts_bomb_rocket": "event_id % 8 = 0",
        "unlimited_boosts_lightning": "event_id % 9 = 0",
        "boosts_super_lightning": "event_id % 5 = 0",
        "boosts_hammer": "event_id % 2",
        "boosts_swap": _unless(31, "event_id % 3"),
        "boosts_reshuffle": "event_id % 4",
        "boosts_vertical_line": "event_id % 5",
        "boosts_horizontal_line": "event_id % 6",
        "mortas_helmets": "k % 4",
        "levels_winstreak": "concat(event_id % 60, if(event_id % 61 = 0, '.7', ''))",
        "levels_sb_streak": "event_id % 10",
    },
    _NOTE,
    # Repeated keys, of which the first value that is not null counts.
    ("coins_spent", "CASE WHEN event_id % 73 = 0 AND event_id % 13 <> 0 THEN k END"),
    ("boosts_super_lightning", _some(53, "event_id % 5 <> 0")),
    ("levels_winstreak", _some(79, "'null'")),
    ("mortas_helmets", _some(83, """'"3"'""")),
    ("note", _some(59, "1")),
)
# These users' later days come two weeks earlier, so that some users stop playing.
_MOVED = "user_id % 4 = 0 AND day >= DATE'2024-01-15'"
LEVELS = f"""
SELECT event_id, user_id, if({_MOVED}, date_sub(day, 14), day) AS partition_date,
       if({_MOVED}, ts - INTERVAL '14' DAY, ts) AS client_time,
       CAST((k * 7 + event_id) % 300 AS INT) AS level,
       CASE k % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' ELSE 'super_hard' END AS complexity,
       CAST(1 + (event_id * 7 + k) % 45 AS INT) AS attempt,
       CASE WHEN event_id % 37 = 0 THEN NULL
            WHEN event_type IN ('purchase', 'signup', 'view') THEN 'completed'
            ELSE 'failed' END AS reason,
       event_id % 2 = 0 AS influence,
       {_LEVEL_PAYLOAD} AS event_payload
FROM ({WITH_K})"""



def _metric_rows(metrics: dict[str, str]) -> str:
    rows = [
        f"named_struct('metric_name', '{name}', 'value', CAST({value} AS DOUBLE))"
        for name, value in metrics.items()
    ]
    return f"array({', '.join(rows)})"


_IN_TEST = _metric_rows(
    {
        "revenue": "revenue",
        "revenue_cum": "total",
        "is_payer": "revenue > 0",
        "is_payer_cum": "total > 0",
        "active": "1",
        "weekly_churn": "(user_id + n_day) % 9 = 0",
    }
)
_BEFORE_TEST = _metric_rows({"prev_revenue_cum": "total", "prev_active": "1"})
# Before the test, ``total`` sums from the given day up to day -1; within it, from day 1.
AB_USERS_METRICS = f"""
WITH per_day AS (
    SELECT user_id, datediff(CAST(ts AS DATE), {ENROLLED}) AS since,
           sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12, 2)) ELSE 0 END)
               AS revenue
    FROM {{events}} GROUP BY ALL
),
numbered AS (
    SELECT user_id, revenue, CASE WHEN since >= 0 THEN since + 1 ELSE since END AS n_day
    FROM per_day
),
daily AS (
    SELECT *, sum(revenue) OVER (PARTITION BY user_id, n_day > 0 ORDER BY abs(n_day)) AS total
    FROM numbered
),
named AS (
    SELECT 'T1' AS test_id, user_id, n_day,
           inline(CASE WHEN n_day > 0 THEN {_IN_TEST} ELSE {_BEFORE_TEST} END)
    FROM daily
    UNION ALL
    SELECT 'T2', user_id, n_day, 'revenue', CAST(revenue * 2 AS DOUBLE)
    FROM daily WHERE n_day > 0 AND user_id % 7 = 0
)
SELECT test_id, 'hs_as' AS app_short, user_id AS event_user,
       n_day AS personal_test_participation_day_num, metric_name, value
FROM named"""

_STATEMENTS = {
    Source.AB_USERS: AB_USERS,
    Source.AB_USERS_METRICS: AB_USERS_METRICS,
    Source.SESSIONS: SESSIONS,
    Source.LEVELS: LEVELS,
    Source.EVENTS: "SELECT * FROM {events}",
}
# Tables whose rows carry a payload to write and parse.
_HEAVY = (Source.SESSIONS, Source.LEVELS)


class DerivedSources:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._events = spark.read.parquet(f"{sf_dir}/events.parquet")
        self._few_files = len(self._events.inputFiles()) < spark.sparkContext.defaultParallelism

    def table(self, source: Source) -> DataFrame:
        source, events = Source(source), self._events
        if source in _HEAVY and self._few_files:
            # A lone small file would be read, and its payloads parsed, by one task.
            events = events.repartition(self.spark.sparkContext.defaultParallelism, "event_id")
        return self.spark.sql(_STATEMENTS[source], events=events)
