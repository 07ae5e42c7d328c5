import pytest
from conftest import rows
from pyspark.sql import functions as F

from trialmart import CatalogSources, Experiment, prepare_all_metrics, prepare_base_metrics
from trialmart.operators.panel import CUMULATIVE_METRICS
from trialmart.operators.user_days import ADDITIVE, MEASURES
from trialmart.plans.kpi import base_kpis, kpi_states, kpis_of_states, m3_kpis, streak_kpis
from trialmart.sources.sinks import replace_table

BASE_SCHEMA = (
    "abgroup string, n_day int, event_user string, retained int, churn int, converted_cum int,"
    " revenue_cum float, revenue float"
)


def base_of(spark, data):
    return spark.createDataFrame(data, BASE_SCHEMA)


def game_of(spark, data):
    """Rows given as dicts; measures not named are 0, as on a panel day without attempts."""
    numbers = [*MEASURES, *(f"cum_user_{name}" for name in CUMULATIVE_METRICS)]
    kinds = ", ".join(f"{name} {'double' if 'coins' in name else 'long'}" for name in numbers)
    schema = f"abgroup string, n_day int, event_user string, retained int, {kinds}"
    full = [
        tuple(
            [row.get("abgroup", "a"), row.get("n_day", 1), row["event_user"], row.get("retained", 1)]
            + [
                float(row.get(name, 0)) if "coins" in name else row.get(name, 0)
                for name in numbers
            ]
        )
        for row in data
    ]
    return spark.createDataFrame(full, schema)


@pytest.mark.parametrize("direct", [True, False])
def test_base_kpis(spark, direct):
    data = base_of(
        spark,
        [
            ("a", 1, "u", 1, 0, 1, 10.0, 10.0),
            ("a", 1, "v", 1, 1, 0, 0.0, 0.0),
            ("a", 1, "w", 0, 0, 0, 0.5, None),
            ("a", None, "x", None, None, None, None, None),
            ("b", 1, "y", 0, 0, 0, 0.0, 0.0),
        ],
    )
    kpis = base_kpis(data, one_row_per_user_day=direct)
    assert len(kpis.columns) == 17
    found = {(r["abgroup"], r["n_day"]): r.asDict() for r in kpis.collect()}
    day = found["a", 1]
    assert (day["total_users"], day["retained_users"], day["churned_users"]) == (3, 2, 1)
    assert (day["converted_users"], day["paying_users"]) == (1, 1)
    assert (day["arpu"], day["arppu"], day["darpu"], day["darppu"]) == (3.5, 10.5, 5.0, 10.0)
    assert (day["conversion"], day["paying_share"]) == (33.33, 50.0)
    assert (day["retention"], day["churn"]) == (66.67, 33.33)
    # Users without any test day form a group of their own.
    lost = found["a", None]
    assert (lost["total_users"], lost["retained_users"], lost["paying_users"]) == (1, None, 0)
    # No division by zero under ANSI mode.
    empty = found["b", 1]
    assert [empty[name] for name in ("arppu", "darpu", "darppu", "paying_share")] == [None] * 4
    assert (empty["arpu"], empty["conversion"], empty["churn"]) == (0.0, 0.0, 0.0)


def test_users_are_counted_once_however_many_rows_they_have(spark):
    data = base_of(
        spark,
        [
            ("a", 1, "u", 1, 0, 1, 4.0, 4.0),
            ("a", 1, "u", 1, 0, 1, 2.0, 2.0),
            ("a", 1, "v", 1, 0, 0, 0.0, 0.0),
        ],
    )
    row = base_kpis(data).first()
    assert (row["total_users"], row["paying_users"], row["retained_users"]) == (2, 1, 3)
    assert row["revenue"] == 6.0


@pytest.mark.parametrize("direct", [True, False])
def test_m3_kpis(spark, direct):
    data = game_of(
        spark,
        [
            dict(event_user="u", attempts=4, wins=2, coins_spent=10, coins_spent_1att=5,
                 cum_user_attempts=6, churn_m3=1, is_stucked=1),
            dict(event_user="v", cum_user_attempts=2),
            dict(event_user="w", n_day=2, retained=0, attempts=1),
        ],
    )
    kpis = m3_kpis(data, one_row_per_user_day=direct)
    assert len(kpis.columns) == 37
    found = {row["n_day"]: row for row in kpis.collect()}
    day = found[1]
    assert (day["sum_attempts"], day["sum_wins"], day["cum_attempts"]) == (4, 2, 4.0)
    assert (day["dattempts"], day["dwins"], day["daily_coins_spent"]) == (2.0, 1.0, 5.0)
    assert (day["daily_share_stucked"], day["daily_churn_m3"]) == (50.0, 50.0)
    assert (day["daily_share_coins_1att"], day["daily_share_rcoins_1att"]) == (50.0, None)
    assert (found[2]["dattempts"], found[2]["cum_share_rcoins_1att"]) == (None, None)


@pytest.mark.parametrize("direct", [True, False])
def test_streak_kpis(spark, direct):
    data = game_of(
        spark,
        [
            # Never lost: one run of three.
            dict(event_user="u", attempts=3, is_superball=1, cnt_superball=3),
            # Four superballs in two runs.
            dict(event_user="v", attempts=5, is_superball=1, cnt_superball=4, cnt_lose_sb=2,
                 is_lose_sb=1, is_5plus_ws=1),
            dict(event_user="w", attempts=1),
            dict(event_user="x", attempts=1, is_streak=1),
            dict(event_user="idle"),
            dict(event_user="z", n_day=2),
        ],
    )
    kpis = streak_kpis(data, one_row_per_user_day=direct)
    assert len(kpis.columns) == len(set(kpis.columns)) == 33
    found = {row["n_day"]: row for row in kpis.collect()}
    day = found[1]
    assert (day["total_users"], day["m3_users"], day["sb_users"]) == (5, 4, 2)
    assert (day["not_sb_not_streak_users"], day["streak_users"]) == (1, 1)
    assert day["daily_avg_length_sb_streak"] == 2.5
    assert (day["share_sb_users"], day["share_lost_sb_users"]) == (50.0, 50.0)
    assert day["daily_share_users_5plus_ws"] == 25.0
    # Nobody played: every share is unknown, and nothing fails.
    idle = found[2]
    assert (idle["m3_users"], idle["share_sb_users"], idle["daily_avg_length_sb_streak"]) == (
        0, None, None,
    )


def test_days_without_gameplay_rows_count_no_players(spark):
    data = game_of(spark, [dict(event_user="u", **{name: None for name in ADDITIVE if "coins" not in name})])
    row = streak_kpis(data).first()
    assert (row["total_users"], row["m3_users"], row["not_sb_not_streak_users"]) == (1, 0, 0)


def test_group_key_rows(spark):
    data = base_of(spark, [("a", 1, "u", 1, 0, 0, 0.0, 0.0), ("b", 2, "u", 1, 0, 0, 0.0, 0.0)])
    assert rows(base_kpis(data), "abgroup", "n_day") == [("a", 1), ("b", 2)]


def all_of(spark):
    rows_ = [
        {"event_user": f"u{i % 7}", "abgroup": "ab"[i % 2], "n_day": i % 3, "attempts": i % 5,
         "coins_spent": i, "real_coins_spent": i % 4, "cnt_superball": i % 3, "cnt_lose_sb": i % 2,
         "cum_user_attempts": 3 * i, "wins": i % 2, "is_streak": i % 2, "churn_m3": i % 2}
        for i in range(60)
    ]
    money = game_of(spark, rows_).selectExpr(
        "*", "0 AS churn", "retained AS converted_cum", "CAST(attempts AS FLOAT) AS revenue_cum",
        "CAST(attempts % 3 AS FLOAT) AS revenue",
    )
    return money.drop("churn").withColumn("churn", F.col("retained"))


TABLES = {"base": base_kpis, "m3": m3_kpis, "streak": streak_kpis}


@pytest.mark.parametrize("direct", [True, False])
def test_states_give_every_table(spark, direct):
    data = all_of(spark)
    if direct:
        data = data.dropDuplicates(["abgroup", "n_day", "event_user"])
    states = kpi_states(data, one_row_per_user_day=direct)
    for name, kpis in TABLES.items():
        wanted = kpis(data, one_row_per_user_day=direct)
        found = kpis_of_states(states, name)
        assert found.columns == wanted.columns
        assert rows(found) == rows(wanted)


def test_states_of_batches_of_users_are_merged(spark):
    data = all_of(spark)
    batches = [kpi_states(data.filter(f"hash(event_user) % 2 {sign} 0")) for sign in ("=", "<>")]
    both = batches[0].unionByName(batches[1])
    for name, kpis in TABLES.items():
        assert rows(kpis_of_states(both, name)) == rows(kpis(data))


def test_all_tables_take_one_scan(spark, tmp_path):
    path = str(tmp_path / "dataset")
    all_of(spark).write.parquet(path)
    states = kpi_states(spark.read.parquet(path), one_row_per_user_day=True)
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_a_table_another_writer_left_is_counted_by_users(spark):
    experiment, sources = Experiment("T1", owner="foreign"), CatalogSources(spark, {})
    twice = all_of(spark).unionByName(all_of(spark))
    replace_table(twice, experiment.dataset_table)
    assert rows(prepare_base_metrics(sources, experiment)) == rows(base_kpis(twice))
    found = prepare_all_metrics(sources, experiment)
    assert {name: rows(df) for name, df in found.items()} == {
        name: rows(kpis(twice)) for name, kpis in TABLES.items()
    }
