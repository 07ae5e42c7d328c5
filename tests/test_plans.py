"""What the plans look like where nothing is small enough to broadcast on its own."""

import re
from datetime import date, datetime, timedelta

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from checks.queries import EXPERIMENT, TIE_BREAKER, Case
from trialmart.operators.attempts import attempt_facts
from trialmart.operators.cohort import cohort_users, enrolled_users
from trialmart.operators.dataset import add_gameplay, base_dataset
from trialmart.operators.members import possible_members
from trialmart.operators.monetisation import main_metrics_pivot
from trialmart.operators.segments import session_segments, valid_sessions
from trialmart.operators.skew import hot_keys, join_users
from trialmart.operators.timeline import attempt_features
from trialmart.operators.user_days import user_day_partials
from trialmart.plans.jobs import cohort_user_days, gameplay_metrics
from trialmart.plans.kpi import base_kpis
from trialmart.session import session_conf
from trialmart.sources.catalog import Source

START, END = date(2024, 1, 4), date(2024, 1, 30)


@pytest.fixture(autouse=True)
def no_automatic_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    with session_conf(spark, settings):
        yield


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """The source tables as files partitioned by day, as a warehouse would hold them."""
    folder, case = str(tmp_path_factory.mktemp("sources")), Case(spark, SF_DIR)
    for source in (Source.AB_USERS, Source.AB_USERS_METRICS):
        case.sources.table(source).write.parquet(f"{folder}/{source.value}")
    for source in (Source.SESSIONS, Source.LEVELS):
        table = case.sources.table(source)
        table.write.partitionBy("partition_date").parquet(f"{folder}/{source.value}")
    return lambda source: spark.read.parquet(f"{folder}/{source.value}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|rangepartitioning)", plan)


def users_of(saved):
    return cohort_users(enrolled_users(saved(Source.AB_USERS), EXPERIMENT))


def facts_of(saved, **options):
    options = {"broadcast_users": True, "tie_breaker": TIE_BREAKER, **options}
    return attempt_facts(saved(Source.LEVELS), users_of(saved), START, END, **options)


def test_attempts_are_one_pruned_scan_without_shuffle(saved):
    plan = plan_of(facts_of(saved))
    assert exchanges(plan) == []
    assert plan.count("from_json") == 1
    assert "BroadcastHashJoin" in plan and "Nested" not in plan and "Cartesian" not in plan
    assert re.search(r"PartitionFilters: \[[^\]]*partition_date#\d+ >= 2024-01-04", plan)


def test_reading_few_columns_parses_no_payload(saved):
    plan = plan_of(facts_of(saved).groupBy("n_day").count())
    assert "from_json" not in plan and "event_payload" not in plan


def test_sessions_push_their_filters_down(saved):
    sessions = valid_sessions(saved(Source.SESSIONS), "ios", START, END)
    plan = plan_of(session_segments(sessions))
    assert "EqualTo(store,ios)" in plan and "Not(EqualTo(session_id,-1))" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*partition_date#\d+ >= 2024-01-04", plan)
    assert plan.count("from_json") == 1


def test_covariate_and_main_metrics_share_one_shuffle(saved):
    metrics = EXPERIMENT.rows_of(saved(Source.AB_USERS_METRICS))
    plan = plan_of(cohort_user_days(metrics, users_of(saved), broadcast_users=True))
    assert len(exchanges(plan)) == 1
    assert "EqualTo(test_id,T1)" in plan


def test_gameplay_shuffles_attempts_once_and_never_the_dense_panel(saved):
    gameplay = gameplay_metrics(
        facts_of(saved), users_of(saved), START, END, broadcast_users=True, tie_breaker=TIE_BREAKER
    )
    plan = plan_of(gameplay)
    above, below = plan.split("Union", 1)
    # The attempts and the users move once each, the user-days made of attempts never.
    assert [e for e in exchanges(above) if "event_user" in e] == []
    assert len([e for e in exchanges(below) if "event_user" in e]) == 2
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    # Rows are merged, sorted and run through before they unfold into days, not afterwards.
    unfolding, merging = plan.split("Generate explode", 1)
    for step in ("Exchange", "Sort", "Window", "Aggregate"):
        assert f"{step} " not in unfolding and f"{step}(" not in unfolding
        assert step in merging


def test_base_and_gameplay_join_where_they_are(saved):
    users, metrics = users_of(saved), EXPERIMENT.rows_of(saved(Source.AB_USERS_METRICS))
    cohort = enrolled_users(saved(Source.AB_USERS), EXPERIMENT).selectExpr(
        "*", "0D AS skill", "0 AS level", "'x' AS payer_type", "'x' AS skill_payment_seg"
    )
    base = base_dataset(cohort, cohort_user_days(metrics, users, broadcast_users=True))
    gameplay = gameplay_metrics(
        facts_of(saved), users, START, END, broadcast_users=True, tie_breaker=TIE_BREAKER
    )
    plan = plan_of(add_gameplay(base, gameplay))
    joined = [e for e in exchanges(plan) if e.count("#") >= 3]
    assert joined == []
    # The dense side arrives in join order: no sort between the join and its window.
    dense_side = plan.split("Window [sum(attempts", 1)[0].rsplit("+-", 2)[1]
    assert "Sort" not in dense_side


def test_counting_users_of_a_checked_dataset_moves_only_partial_results(saved, spark):
    data = spark.createDataFrame(
        [], "abgroup string, n_day int, event_user long, retained int, churn int,"
        " converted_cum int, revenue_cum float, revenue float"
    )
    direct = plan_of(base_kpis(data, one_row_per_user_day=True))
    assert len(exchanges(direct)) == 1 and "Expand" not in direct
    assert "Expand" not in plan_of(base_kpis(data))


def hot_frame(spark):
    start, rows_ = datetime(2024, 1, 5), []
    for i in range(600):
        user = "hot" if i % 3 == 0 else f"u{i % 97}"
        rows_.append((i, user, start + timedelta(minutes=i)))
    return spark.createDataFrame(rows_, "event_id long, event_user string, client_time timestamp_ntz")


def test_hot_keys_are_few_by_construction(spark):
    frame = hot_frame(spark)
    assert rows(hot_keys(frame, "event_user", hot_rows=50, hot_share=0.0)) == [("hot",)]
    # The share bounds the number of keys whatever the row threshold.
    assert hot_keys(frame, "event_user", hot_rows=1, hot_share=0.3).count() == 1
    assert hot_keys(frame, "event_user", hot_rows=300, hot_share=0.0) is None
    assert hot_keys(frame, "event_user") is None


def test_hot_users_are_joined_in_parts(spark):
    frame = hot_frame(spark)
    users = frame.select("event_user").distinct().filter("event_user <> 'u5'")
    joined = join_users(frame, users, broadcast_users=False, hot_rows=50, hot_share=0.0)
    assert rows(joined) == rows(frame.join(users, "event_user"))
    moved = [re.sub(r"#\d+L?", "", e) for e in exchanges(plan_of(joined))]
    assert moved.count("hashpartitioning(event_user, salt, 4)") == 2


def test_large_cohorts_read_attempts_once_and_move_no_payload(saved):
    for options in ({}, {"hot_rows": 50, "hot_share": 0.0}):
        plan = saved_plan = plan_of(facts_of(saved, broadcast_users=False, **options))
        assert len(re.findall(r"FileScan parquet [^\n]*event_payload", plan)) == 1
        assert plan.count("from_json") == 1
        # What lies above the first shuffle of the attempts never names the payload.
        above = saved_plan.split("from_json")[0].rsplit("Exchange", 1)[0]
        assert "event_payload" not in above


def test_large_cohorts_parse_only_possible_members(saved):
    few = users_of(saved).filter("event_user % 10 = 3")
    facts = attempt_facts(
        saved(Source.LEVELS), few, START, END, broadcast_users=False, tie_breaker=TIE_BREAKER
    )
    execution = facts._jdf.queryExecution()
    # The filter lies between the scan and the parse.
    scan_side = execution.executedPlan().toString().split("from_json", 1)[1]
    assert "Subquery" in scan_side.split("FileScan", 1)[0]
    wanted = facts_of(saved).join(few.select("event_user"), "event_user", "left_semi")
    columns = ["event_id", "n_day", "coins_spent", "is_win"]
    assert rows(facts, *columns) == rows(wanted, *columns)
    # Rows that pass the filter are the rows parsed.
    levels = saved(Source.LEVELS).filter(F.col("partition_date").between(START, END))
    levels = levels.withColumnRenamed("user_id", "event_user")
    parsed = possible_members(levels, few).count()
    of_members = levels.join(few.select("event_user"), "event_user", "left_semi").count()
    assert of_members <= parsed < of_members + 0.02 * levels.count()


def test_metrics_join_gives_the_same_rows_for_every_strategy(spark, saved):
    metrics, users = EXPERIMENT.rows_of(saved(Source.AB_USERS_METRICS)), users_of(saved)
    ids = users.select("event_user")
    found = [
        rows(main_metrics_pivot(join_users(metrics, ids, **options)))
        for options in (
            {"broadcast_users": True},
            {"broadcast_users": False},
            {"broadcast_users": False, "hot_rows": 150, "hot_share": 0.0},
        )
    ]
    assert found[0] == found[1] == found[2]


def test_derivable_columns_are_neither_read_nor_shuffled(spark, saved, tmp_path):
    path = str(tmp_path / "attempts")
    facts_of(saved).write.parquet(path)
    features = attempt_features(spark.read.parquet(path), END, tie_breaker=TIE_BREAKER)
    plan = plan_of(user_day_partials(features))
    schema = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "coins_spent_1att" not in schema and "is_lose" not in schema
    assert "level:" not in schema and "reason" not in schema


def test_hot_timelines_are_clustered_by_user_and_cell(saved):
    cut = attempt_features(
        facts_of(saved), END, tie_breaker=TIE_BREAKER, hot_rows=50, hot_share=0.0
    )
    plan = plan_of(user_day_partials(cut))
    keys = [re.sub(r"#\d+L?", "", e) for e in exchanges(plan)]
    # The attempts move once, by user and cell; by user alone only edge rows do.
    assert keys.count("hashpartitioning(event_user, timeline_cell, 4)") >= 2
    attempts_side = plan.split("SortMergeJoin", 1)[1].split("min_by")[0]
    moved = [re.sub(r"#\d+L?", "", e) for e in exchanges(attempts_side)]
    assert moved[0] == "hashpartitioning(event_user, timeline_cell, 4)"


def test_cut_and_whole_timelines_meet_without_a_shuffle(saved):
    cut = attempt_features(
        facts_of(saved), END, tie_breaker=TIE_BREAKER, hot_rows=50, hot_share=0.0
    )
    above = plan_of(user_day_partials(cut)).split("Union", 1)[0]
    # Only user-days move, to their user; edges are looked up for cut timelines alone.
    assert [re.sub(r"#\d+L?", "", e) for e in exchanges(above)] == ["hashpartitioning(event_user, 4)"]
    assert "SortMergeJoin" not in above


def test_large_cohorts_have_no_broadcast_of_users(saved):
    facts = facts_of(saved, broadcast_users=False)
    assert "Broadcast" not in plan_of(facts)
    split = facts_of(saved, broadcast_users=False, hot_rows=50, hot_share=0.0)
    columns = ["event_id", "n_day", "coins_spent", "is_win"]
    assert rows(split, *columns) == rows(facts_of(saved), *columns)
