"""The same results in plain SQL, written straight from the metric definitions.

Each statement derives its input from ``events`` by arithmetic and never touches
a JSON payload, so it shares no code and little structure with the Spark plans.
"""

from __future__ import annotations

START, END = "DATE '2024-01-01'", "DATE '2024-01-30'"
ENROLL_END, FEATURE_START = "DATE '2024-01-10'", "DATE '2024-01-04'"

_COINS = [
    f"{prefix}coins_spent{kind}"
    for prefix in ("", "real_")
    for kind in ("", "_additional_moves", "_inlevelboosters", "_startboosters")
]
_PARTS = ["1att", "2plus_att", "superball"]
_SPLIT = [f"{coins}_{part}" for coins in ("coins_spent", "real_coins_spent") for part in _PARTS]
_COUNTED = {
    "cnt_streak": "is_streak",
    "wins": "is_win",
    "cnt_superball": "is_superball",
    "cnt_lose_sb": "is_lose_sb",
    "cnt_get_sb": "is_get_sb",
    "pre_boosters": "pre_boosters",
}
_FLAGS = [
    "churn_m3",
    "churn_m3_win",
    "churn_m3_lose",
    "is_5plus_ws",
    "is_10plus_ws",
    "is_20plus_ws",
    "is_40plus_ws",
    "is_lose_sb",
    "is_get_sb",
    "is_stucked",
    "is_super_stucked",
    "is_streak",
    "is_superball",
]
_DOUBLES = [*_COINS, *_SPLIT, "in_boosters"]
_MEASURES = ["attempts", *_DOUBLES, *_COUNTED, *_FLAGS]
_RUNNING_SUM_INT = ["attempts", "wins", "cnt_streak", "cnt_superball", "cnt_lose_sb", "cnt_get_sb"]
_RUNNING_SUM_DOUBLE = [
    "coins_spent",
    "real_coins_spent",
    "real_coins_spent_1att",
    "real_coins_spent_2plus_att",
    "real_coins_spent_superball",
]
_RUNNING_MAX = ["churn_m3", "churn_m3_win", "churn_m3_lose", "is_stucked", "is_super_stucked"]
_RUNNING = [*_RUNNING_SUM_INT, *_RUNNING_SUM_DOUBLE, *_RUNNING_MAX]


def _lines(parts: list[str]) -> str:
    return ",\n    ".join(parts)


def _flag(condition: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END AS {name}"


_CTES = {
    "ev": """
    SELECT event_id AS e, user_id AS u, ts, event_type AS kind, value, CAST(ts AS DATE) AS d,
           CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
    FROM events""",
    "member": f"""
    SELECT 'T1' AS test_id, 'hs_as' AS app_short, 'g' || CAST(u % 3 AS VARCHAR) AS abgroup,
           u AS event_user, en AS metric_calc_start_date,
           CASE u % 4 WHEN 0 THEN 'EU' WHEN 1 THEN 'US' WHEN 2 THEN 'ASIA' ELSE 'OTHER' END
               AS device_region,
           en AS test_enroll_date, greatest(en, {FEATURE_START}) AS start_feature_user
    FROM (SELECT DISTINCT u, {START} + CAST(u % 10 AS INTEGER) AS en FROM ev)
    WHERE u % 11 <> 0""",
    "sess": f"""
    SELECT u, d, CAST((k * 7 + e) % 300 AS INTEGER) AS level,
           CASE WHEN e % 43 = 0 THEN NULL
                WHEN e % 29 = 0 THEN CAST('0.829' AS FLOAT)
                ELSE CAST('0.' || lpad(CAST(k % 25 * 4 AS VARCHAR), 2, '0') AS FLOAT) END AS skill,
           CASE WHEN kind = 'purchase' THEN CAST(
                    CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
                    AS FLOAT)
                ELSE CAST(0 AS FLOAT) END AS payment,
           CASE WHEN e % 47 = 0 THEN 'custom_seg' END AS given,
           CASE WHEN e % 41 = 0 THEN NULL WHEN k % 3 = 0 THEN 'none'
                WHEN k % 3 = 1 THEN 'minnow' ELSE 'whale' END AS payer_type
    FROM (SELECT *, CAST(floor(value * 5) AS BIGINT) AS c FROM ev)
    WHERE d BETWEEN {START} AND {ENROLL_END} AND e % 17 <> 0 AND e % 23 <> 0 AND e % 19 <> 0""",
    "seg": """
    SELECT u AS event_user, d AS partition_date, level,
           20 * round(CAST(skill * CAST(100 AS FLOAT) AS DOUBLE) / 20) AS skill,
           coalesce(given, CASE
               WHEN level < 100 THEN '0_early_game'
               WHEN CAST(payment AS DOUBLE) >= CAST(7.912 AS DOUBLE) THEN '4_super_payers'
               WHEN CAST(payment AS DOUBLE) >= CAST(3.575 AS DOUBLE) THEN '3_top_payers'
               WHEN CAST(payment AS DOUBLE) >= CAST(1.120 AS DOUBLE) THEN '2_normal_payers'
               WHEN payment > 0 AND CAST(skill AS DOUBLE) >= CAST(0.829 AS DOUBLE)
                   THEN '1_low_payers_skill_3'
               WHEN payment > 0 AND CAST(skill AS DOUBLE) >= CAST(0.684 AS DOUBLE)
                   THEN '1_low_payers_skill_2'
               WHEN payment > 0 THEN '1_low_payers_skill_1'
               WHEN CAST(skill AS DOUBLE) >= CAST(0.846 AS DOUBLE) THEN '0_non_payers_skill_3'
               WHEN CAST(skill AS DOUBLE) >= CAST(0.736 AS DOUBLE) THEN '0_non_payers_skill_2'
               ELSE '0_non_payers_skill_1' END) AS skill_payment_seg,
           payer_type
    FROM sess""",
    "snap": """
    SELECT event_user, partition_date AS test_enroll_date, max(payer_type) AS payer_type,
           max(skill_payment_seg) AS skill_payment_seg, max(skill) AS skill, min(level) AS level
    FROM seg GROUP BY event_user, partition_date""",
    "cohort": """
    SELECT m.*, s.payer_type, s.skill_payment_seg, coalesce(s.skill, 0) AS skill,
           coalesce(s.level, 0) AS level
    FROM member m LEFT JOIN snap s
      ON s.event_user = m.event_user AND s.test_enroll_date = m.test_enroll_date""",
    "daily": f"""
    SELECT u, CASE WHEN off >= 0 THEN off + 1 ELSE off END AS nd, rev
    FROM (SELECT u, CAST(d - ({START} + CAST(u % 10 AS INTEGER)) AS INTEGER) AS off,
                 sum(CASE WHEN kind = 'purchase' THEN CAST(value AS DECIMAL(12, 2)) ELSE 0 END)
                     AS rev
          FROM ev GROUP BY 1, 2)""",
    "main": """
    SELECT u AS event_user, CAST(nd AS INTEGER) AS n_day, CAST(rev AS DOUBLE) AS revenue,
           CASE WHEN rev > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS converted,
           CAST(rc AS DOUBLE) AS revenue_cum,
           CASE WHEN rc > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS converted_cum,
           1.0::DOUBLE AS retained,
           CASE WHEN (u + nd) % 9 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS churn
    FROM (SELECT *, sum(rev) OVER (PARTITION BY u ORDER BY nd) AS rc FROM daily WHERE nd > 0)""",
    "prior": """
    SELECT u AS event_user, CAST(-nd AS INTEGER) AS n_day,
           CAST(sum(rev) OVER (PARTITION BY u ORDER BY nd DESC) AS DOUBLE) AS revenue_before
    FROM daily WHERE nd < 0""",
    "base": """
    SELECT c.test_id, c.app_short, c.abgroup, c.event_user, c.metric_calc_start_date,
           c.device_region, c.skill_payment_seg, c.payer_type, CAST(c.skill AS INTEGER) AS skill,
           c.level, CASE WHEN m.revenue > 0 THEN 1 ELSE 0 END AS is_payer, m.n_day,
           CAST(p.revenue_before AS FLOAT) AS revenue_before, CAST(m.retained AS INTEGER) AS retained,
           CAST(m.churn AS INTEGER) AS churn, CAST(m.revenue_cum AS FLOAT) AS revenue_cum,
           CAST(m.converted_cum AS INTEGER) AS converted_cum, CAST(m.revenue AS FLOAT) AS revenue,
           CAST(m.converted AS INTEGER) AS converted,
           CAST(max(p.revenue_before) OVER (PARTITION BY c.event_user) AS FLOAT)
               AS revenue_before_d14
    FROM cohort c
    LEFT JOIN main m ON m.event_user = c.event_user
    LEFT JOIN prior p ON p.event_user = m.event_user AND p.n_day = m.n_day""",
    "att": f"""
    SELECT *,
           CASE WHEN reason = 'completed' THEN 1 ELSE 0 END AS is_win,
           CASE WHEN reason = 'completed' THEN 0 ELSE 1 END AS is_lose,
           {_lines([
               f"CASE WHEN {condition} THEN {coins} ELSE 0 END AS {coins}_{part}"
               for coins in ("coins_spent", "real_coins_spent")
               for part, condition in zip(
                   _PARTS, ("attempt = 1", "attempt > 1", "is_superball = 1"))
           ])}
    FROM (
        SELECT e, m.event_user, m.abgroup, m.start_feature_user, d AS date_attempt,
               ts AS client_time, CAST(d - m.start_feature_user AS INTEGER) + 1 AS n_day,
               CAST((k * 7 + e) % 300 AS INTEGER) AS level,
               CASE k % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' ELSE 'super_hard' END AS complexity,
               CAST(1 + (e * 7 + k) % 45 AS INTEGER) AS attempt,
               CASE WHEN e % 37 = 0 THEN NULL
                    WHEN kind IN ('purchase', 'signup', 'view') THEN 'completed'
                    ELSE 'failed' END AS reason,
               CASE WHEN e % 13 <> 0 THEN CAST(k AS DOUBLE) END AS coins_spent,
               CAST(k % 7 AS DOUBLE) AS coins_spent_additional_moves,
               CAST(k % 5 AS DOUBLE) AS coins_spent_inlevelboosters,
               CAST(k % 3 AS DOUBLE) AS coins_spent_startboosters,
               CAST(k % 40 AS DOUBLE) AS real_coins_spent,
               CAST(k % 6 AS DOUBLE) AS real_coins_spent_additional_moves,
               CAST(k % 4 AS DOUBLE) AS real_coins_spent_inlevelboosters,
               CAST(k % 2 AS DOUBLE) AS real_coins_spent_startboosters,
               {" + ".join(f"CAST(e % {n} = 0 AS INTEGER)" for n in (3, 4, 6, 7, 8, 9))}
                   AS pre_boosters,
               CASE WHEN e % 31 <> 0
                    THEN CAST(e % 2 + e % 3 + e % 4 + e % 5 + e % 6 AS DOUBLE) END AS in_boosters,
               k % 4 AS mortas_helmets,
               {_flag("k % 4 = 3", "is_streak")},
               {_flag("e % 2 = 0", "influence")},
               {_flag("e % 5 = 0", "is_superball")},
               CAST(e % 60 AS INTEGER) AS levels_winstreak,
               CAST(e % 10 AS INTEGER) AS levels_sb_streak
        FROM (
            SELECT * REPLACE (
                CASE WHEN moved THEN d - 14 ELSE d END AS d,
                CASE WHEN moved THEN ts - INTERVAL 14 DAY ELSE ts END AS ts)
            FROM (SELECT *, u % 4 = 0 AND d >= DATE '2024-01-15' AS moved FROM ev)
        ) AS played JOIN member m ON m.event_user = played.u
        WHERE d BETWEEN {FEATURE_START} AND {END}
    ) WHERE n_day > 0""",
    "feat": f"""
    SELECT *,
           CASE WHEN is_win = 1 THEN churn_m3 ELSE 0 END AS churn_m3_win,
           CASE WHEN is_win = 0 THEN churn_m3 ELSE 0 END AS churn_m3_lose,
           {_lines([
               _flag(f"prev_levels_winstreak >= {n}", f"is_{n}plus_ws") for n in (5, 10, 20, 40)
           ])},
           {_flag("is_superball = 1 AND is_lose = 1", "is_lose_sb")},
           {_flag("is_superball = 0 AND next_sb = 1", "is_get_sb")},
           {_flag("attempt > 20", "is_stucked")},
           {_flag("attempt > 40", "is_super_stucked")}
    FROM (
        SELECT *, CAST(CAST(next_time AS DATE) - CAST(client_time AS DATE) AS INTEGER)
                      AS timediff_att,
               CASE WHEN date_attempt > DATE '2024-01-23' THEN 0
                    WHEN next_time IS NOT NULL
                         AND CAST(next_time AS DATE) - CAST(client_time AS DATE) < 7 THEN 0
                    ELSE 1 END AS churn_m3
        FROM (
            SELECT *, lead(client_time) OVER line AS next_time, lead(is_superball) OVER line AS next_sb,
                   coalesce(lag(levels_winstreak) OVER line, 0) AS prev_levels_winstreak
            FROM att WINDOW line AS (PARTITION BY event_user ORDER BY client_time, e)
        )
    )""",
    "uday": f"""
    SELECT event_user, abgroup, n_day, count(*) AS attempts,
           {_lines([f"sum({c}) AS {c}" for c in _DOUBLES])},
           {_lines([f"CAST(sum({s}) AS BIGINT) AS {c}" for c, s in _COUNTED.items()])},
           {_lines([f"max({c}) AS {c}" for c in _FLAGS])}
    FROM feat GROUP BY event_user, abgroup, n_day""",
    "panel": f"""
    SELECT m.event_user, m.abgroup, t.n_day, m.start_feature_user,
           {_lines([f"coalesce(x.{c}, 0) AS {c}" for c in _MEASURES])}
    FROM member m CROSS JOIN (SELECT DISTINCT n_day FROM att) t
    LEFT JOIN uday x ON x.event_user = m.event_user AND x.n_day = t.n_day""",
    "cum": f"""
    SELECT *,
           {_lines(
               [f"CAST(sum({c}) OVER upto AS BIGINT) AS cum_user_{c}" for c in _RUNNING_SUM_INT]
               + [f"sum({c}) OVER upto AS cum_user_{c}" for c in _RUNNING_SUM_DOUBLE]
               + [f"max({c}) OVER upto AS cum_user_{c}" for c in _RUNNING_MAX]
           )}
    FROM panel WINDOW upto AS (PARTITION BY event_user ORDER BY n_day
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "whole": f"""
    SELECT b.*, c.start_feature_user,
           {_lines([f"c.{name}" for name in _MEASURES])},
           {_lines([f"c.cum_user_{name}" for name in _RUNNING])}
    FROM base b LEFT JOIN cum c ON c.event_user = b.event_user AND c.n_day = b.n_day""",
    "base_total": """
    SELECT abgroup, n_day, count(DISTINCT event_user) AS total_users,
           CAST(sum(retained) AS BIGINT) AS retained_users,
           CAST(sum(churn) AS BIGINT) AS churned_users,
           CAST(sum(converted_cum) AS BIGINT) AS converted_users,
           count(DISTINCT CASE WHEN revenue > 0 THEN event_user END) AS paying_users,
           sum(CAST(revenue_cum AS DOUBLE)) AS revenue_cum, sum(CAST(revenue AS DOUBLE)) AS revenue
    FROM base GROUP BY abgroup, n_day""",
    "m3_total": f"""
    SELECT abgroup, n_day, count(DISTINCT event_user) AS total_users,
           CAST(sum(retained) AS BIGINT) AS r,
           CAST(sum(attempts) AS BIGINT) AS sum_attempts, CAST(sum(wins) AS BIGINT) AS sum_wins,
           {_lines([
               f"avg(cum_user_{c}) AS cum_{c}"
               for c in ("attempts", "wins", *_RUNNING_SUM_DOUBLE)
           ])},
           {_lines([
               f"CAST(sum({c}) AS BIGINT) AS sum_{c}"
               for c in ("churn_m3", "churn_m3_lose", "churn_m3_win")
           ])},
           {_lines([
               f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("is_stucked", "is_super_stucked")
           ])},
           {_lines([
               f"sum({c}) AS {c}" for c in ("coins_spent", "real_coins_spent",
               "real_coins_spent_1att", "coins_spent_1att", "real_coins_spent_2plus_att")
           ])}
    FROM whole GROUP BY abgroup, n_day""",
    "streak_total": f"""
    SELECT abgroup, n_day, count(DISTINCT event_user) AS total_users,
           count(*) FILTER (WHERE attempts > 0) AS m3_users,
           CAST(sum(is_superball) AS BIGINT) AS sb_users,
           CAST(sum(is_streak) AS BIGINT) AS streak_users,
           CAST(sum(is_lose_sb) AS BIGINT) AS lose_sb_users,
           count(*) FILTER (WHERE attempts > 0 AND is_superball = 0 AND is_streak = 0)
               AS not_sb_not_streak_users,
           CAST(sum(attempts) AS BIGINT) AS sum_attempts,
           {_lines([
               f"sum({c}) AS {c}" for c in ("coins_spent", "real_coins_spent",
               "real_coins_spent_1att", "real_coins_spent_superball", "coins_spent_1att",
               "real_coins_spent_2plus_att")
           ])},
           avg(cum_user_cnt_superball) AS cum_cnt_superball,
           avg(cum_user_cnt_lose_sb) AS cum_cnt_lose_sb,
           sum(CASE WHEN cnt_superball > 0 AND cnt_lose_sb = 0 THEN CAST(cnt_superball AS DOUBLE)
                    WHEN cnt_lose_sb > 0 THEN cnt_superball / cnt_lose_sb END) AS len,
           {_lines([
               f"CAST(sum(is_{n}plus_ws) AS BIGINT) AS is_{n}plus_ws" for n in (5, 10, 20, 40)
           ])}
    FROM whole GROUP BY abgroup, n_day""",
}


def _sql(select: str) -> str:
    ctes = ",\n".join(f"{name} AS ({body}\n)" for name, body in _CTES.items())
    return f"WITH {ctes}\n{select}"


def _per(top: str, bottom: str, name: str) -> str:
    return f"{top} / nullif({bottom}, 0) AS {name}"


def _share(top: str, bottom: str, name: str) -> str:
    return f"100 * {top} / nullif({bottom}, 0) AS {name}"


def _rounded(top: str, bottom: str, name: str) -> str:
    # Rounds the decimal text of the double, half away from zero.
    quotient = f"{top} / nullif({bottom}, 0) * 100"
    return (
        f"CAST(round(CAST(CAST({quotient} AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS {name}"
    )


_TEXT_DATES = {
    name: f"CAST({name} AS VARCHAR) AS {name}"
    for name in (
        "partition_date",
        "test_enroll_date",
        "metric_calc_start_date",
        "start_feature_user",
        "date_attempt",
        "client_time",
    )
}


def _all_of(cte: str, *dates: str, without: tuple[str, ...] = ()) -> str:
    exclude = f" EXCLUDE ({', '.join(without)})" if without else ""
    swaps = ", ".join(_TEXT_DATES[name] for name in dates)
    swap = f" REPLACE ({swaps})" if dates else ""
    return _sql(f"SELECT *{exclude}{swap} FROM {cte}")


_BASE_KPIS = _sql(f"""
SELECT abgroup, n_day, total_users, retained_users, churned_users, converted_users, paying_users,
    revenue_cum, revenue,
    {_lines([
        _per("revenue_cum", "total_users", "arpu"),
        _per("revenue_cum", "converted_users", "arppu"),
        _per("revenue", "retained_users", "darpu"),
        _per("revenue", "paying_users", "darppu"),
        _rounded("converted_users", "total_users", "conversion"),
        _rounded("paying_users", "retained_users", "paying_share"),
        _rounded("retained_users", "total_users", "retention"),
        _rounded("churned_users", "total_users", "churn"),
    ])}
FROM base_total""")

_M3_KPIS = _sql(f"""
SELECT * EXCLUDE (r), r AS retained_users,
    {_lines([
        _per("sum_wins", "r", "dwins"),
        _per("sum_attempts", "r", "dattempts"),
        _share("is_stucked", "r", "daily_share_stucked"),
        _share("is_super_stucked", "r", "daily_share_super_stucked"),
        *[
            _per(c, "r", f"daily_{c}")
            for c in ("coins_spent", "real_coins_spent", "real_coins_spent_1att",
                      "real_coins_spent_2plus_att")
        ],
        *[
            _share(f"sum_{c}", "r", f"daily_{c}")
            for c in ("churn_m3", "churn_m3_lose", "churn_m3_win")
        ],
        _share("real_coins_spent_1att", "real_coins_spent", "daily_share_rcoins_1att"),
        _share("coins_spent_1att", "coins_spent", "daily_share_coins_1att"),
        _share("cum_real_coins_spent_1att", "cum_real_coins_spent", "cum_share_rcoins_1att"),
    ])}
FROM m3_total""")

_STREAK_KPIS = _sql(f"""
SELECT * EXCLUDE (len),
    {_lines([
        _per("len", "sb_users", "daily_avg_length_sb_streak"),
        _share("sb_users", "m3_users", "share_sb_users"),
        _share("lose_sb_users", "sb_users", "share_lost_sb_users"),
        _share("not_sb_not_streak_users", "m3_users", "share_not_sb_not_streak"),
        _share("streak_users", "m3_users", "share_streak_users"),
        *[
            _share(f"is_{n}plus_ws", "m3_users", f"daily_share_users_{n}plus_ws")
            for n in (5, 10, 20, 40)
        ],
        _share("real_coins_spent_1att", "real_coins_spent", "daily_share_rcoins_1att"),
        _share("real_coins_spent_superball", "real_coins_spent", "daily_share_rcoins_superball"),
        _share("coins_spent_1att", "coins_spent", "daily_share_coins_1att"),
    ])}
FROM streak_total""")

_ATTEMPTS = _all_of("att", "date_attempt", "client_time", "start_feature_user", without=("e",))
_M3_DATASET = _all_of("whole", "metric_calc_start_date", "start_feature_user")
_FEATURES = _sql(f"""
SELECT e AS event_id, event_user, n_day, timediff_att, churn_m3, churn_m3_win, churn_m3_lose,
       prev_levels_winstreak, {", ".join(f"is_{n}plus_ws" for n in (5, 10, 20, 40))},
       is_lose_sb, is_get_sb, is_stucked, is_super_stucked
FROM feat""")

ORACLES = {
    "experiment_lookup": """
        SELECT 'T1' AS test_id, 'hs_as' AS app_short, '2024-01-01' AS test_start_date,
               '2024-01-30' AS test_end_date, '2024-01-10' AS enroll_end_date,
               '2024-01-04' AS feature_start_date, '2024-01-30' AS feature_end_date
        WHERE EXISTS (SELECT 1 FROM events)""",
    "session_segments": _all_of("seg", "partition_date"),
    "session_snapshot": _all_of("snap", "test_enroll_date"),
    "test_cohort": _all_of(
        "cohort", "metric_calc_start_date", "test_enroll_date", "start_feature_user"
    ),
    "test_cohort_android": _all_of(
        "cohort", "metric_calc_start_date", "test_enroll_date", "start_feature_user"
    )
    .replace("'hs_as' AS app_short", "'hs_gp' AS app_short")
    .replace("WHERE u % 11 <> 0", "WHERE u % 11 <> 0 AND u % 5 = 0")
    .replace("e % 17 <> 0", "e % 17 = 0"),
    "pre_period_covariate": _sql("SELECT * FROM prior"),
    "main_metrics_pivot": _sql(
        "SELECT main.* FROM main JOIN member ON member.event_user = main.event_user"
    ),
    "base_dataset": _all_of("base", "metric_calc_start_date"),
    "attempt_facts": _ATTEMPTS,
    "attempt_features": _FEATURES,
    "user_day_metrics": _sql("SELECT * FROM uday"),
    "user_day_panel": _all_of("panel", "start_feature_user"),
    "cumulative_metrics": _all_of("cum", "start_feature_user"),
    "m3_dataset": _M3_DATASET,
    "base_kpis": _BASE_KPIS,
    "base_kpis_distinct": _BASE_KPIS,
    "m3_kpis": _M3_KPIS,
    "streak_kpis": _STREAK_KPIS,
    "attempt_facts_shuffled": _ATTEMPTS,
    "attempt_features_split": _FEATURES,
    "m3_dataset_shuffled": _M3_DATASET,
    "attempt_table": _ATTEMPTS,
    "cumulative_metrics_carried": _all_of("cum", "start_feature_user"),
    "dataset_table": _M3_DATASET,
    "prepare_all_m3": _M3_KPIS,
    "prepare_all_streak": _STREAK_KPIS,
    "kpi_states_base": _BASE_KPIS,
    "prepare_base": _BASE_KPIS,
    "prepare_m3": _M3_KPIS,
    "prepare_streak": _STREAK_KPIS,
}
