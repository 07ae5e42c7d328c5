"""One query per operator, each over whole tables derived from ``events``.

Dates and times are returned as text, so that both engines hand over the same
representation to whatever compares them.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmart.experiment import Experiment, Platform, experiment_lookup
from trialmart.operators.attempts import ATTEMPT_COLUMNS, attempt_facts
from trialmart.operators.cohort import (
    cohort_users,
    count_unique_users,
    enrolled_users,
    experiment_cohort,
)
from trialmart.operators.dataset import add_gameplay, base_dataset
from trialmart.operators.monetisation import main_metrics_pivot, pre_period_covariate
from trialmart.operators.panel import cumulative_panel, observed_days, user_day_panel
from trialmart.operators.segments import session_segments, session_snapshot, valid_sessions
from trialmart.operators.skew import MAX_BROADCAST_ROWS, join_users
from trialmart.operators.timeline import attempt_features
from trialmart.operators.user_days import user_day_metrics, user_day_partials
from trialmart.plans.jobs import (
    calc_attempts,
    carried_metrics,
    carry_attempts,
    cohort_user_days,
    create_dataset,
    gameplay_metrics,
    prepare_all_metrics,
    prepare_base_metrics,
    prepare_m3_metrics,
    prepare_streak_metrics,
    verify_ab_exp,
)
from trialmart.plans.kpi import base_kpis, kpi_states, kpis_of_states, m3_kpis, streak_kpis
from trialmart.session import configure
from trialmart.sources.catalog import CatalogSources, Source
from trialmart.sources.derived import DerivedSources
from trialmart.sources.sinks import replace_table

EXPERIMENT = Experiment("T1")
TIE_BREAKER = "event_id"
FEATURES = (
    "timediff_att",
    "churn_m3",
    "churn_m3_win",
    "churn_m3_lose",
    "prev_levels_winstreak",
    "is_5plus_ws",
    "is_10plus_ws",
    "is_20plus_ws",
    "is_40plus_ws",
    "is_lose_sb",
    "is_get_sb",
    "is_stucked",
    "is_super_stucked",
)


class Case:
    """The parts of the pipeline, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sources = DerivedSources(spark, sf_dir)

    @cached_property
    def dates(self):
        return verify_ab_exp(self.sources, EXPERIMENT)

    @cached_property
    def sessions(self) -> DataFrame:
        start, end = self.dates.require("test_start_date", "enroll_end_date")
        return valid_sessions(self.sources.table(Source.SESSIONS), EXPERIMENT.store, start, end)

    @cached_property
    def metrics(self) -> DataFrame:
        return EXPERIMENT.rows_of(self.sources.table(Source.AB_USERS_METRICS))

    @cached_property
    def enrolled(self) -> DataFrame:
        return enrolled_users(self.sources.table(Source.AB_USERS), EXPERIMENT)

    @cached_property
    def users(self) -> DataFrame:
        return cohort_users(self.enrolled)

    @cached_property
    def broadcast_users(self) -> bool:
        return count_unique_users(self.users) <= MAX_BROADCAST_ROWS

    @cached_property
    def cohort(self) -> DataFrame:
        return experiment_cohort(
            self.enrolled,
            self.sources.table(Source.SESSIONS),
            EXPERIMENT,
            self.dates,
            broadcast_users=self.broadcast_users,
        )

    @cached_property
    def base(self) -> DataFrame:
        days = cohort_user_days(self.metrics, self.users, broadcast_users=self.broadcast_users)
        return base_dataset(self.cohort, days)

    @cached_property
    def attempts(self) -> DataFrame:
        start, end = self.dates.require("feature_start_date", "test_end_date")
        return attempt_facts(
            self.sources.table(Source.LEVELS),
            self.users,
            start,
            end,
            broadcast_users=self.broadcast_users,
            tie_breaker=TIE_BREAKER,
        )

    @cached_property
    def features(self) -> DataFrame:
        return attempt_features(
            self.attempts, self.dates.test_end_date, tie_breaker=TIE_BREAKER
        )

    @cached_property
    def panel(self) -> DataFrame:
        partials = user_day_partials(self.features)
        return user_day_panel(self.users, partials, observed_days(self.attempts))

    @cached_property
    def full(self) -> DataFrame:
        partials = user_day_partials(self.features)
        return add_gameplay(
            self.base, cumulative_panel(self.users, partials, observed_days(self.attempts))
        )


def _lookup(case: Case) -> DataFrame:
    return experiment_lookup(case.sources.table(Source.AB_USERS), EXPERIMENT)


def _main_metrics(case: Case) -> DataFrame:
    ids = case.users.select("event_user")
    joined = join_users(case.metrics, ids, broadcast_users=case.broadcast_users)
    return main_metrics_pivot(joined)


def _features(case: Case) -> DataFrame:
    return case.features.select(TIE_BREAKER, "event_user", "n_day", *FEATURES)


# The ways taken for large cohorts and hot users, forced on small data: every user
# with more than a thousandth of the rows is hot. At most 999 can be.
_FORCED = {"hot_rows": 1, "hot_share": 1e-3}


def _split_features(case: Case) -> DataFrame:
    end = case.dates.test_end_date
    features = attempt_features(case.attempts, end, tie_breaker=TIE_BREAKER, **_FORCED)
    return features.select(TIE_BREAKER, "event_user", "n_day", *FEATURES)


def _shuffled_facts(case: Case) -> DataFrame:
    start, end = case.dates.require("feature_start_date", "test_end_date")
    levels = case.sources.table(Source.LEVELS)
    return attempt_facts(levels, case.users, start, end, broadcast_users=False, **_FORCED)


def _shuffled_dataset(case: Case) -> DataFrame:
    start, end = case.dates.require("feature_start_date", "test_end_date")
    cohort = experiment_cohort(
        case.enrolled,
        case.sources.table(Source.SESSIONS),
        EXPERIMENT,
        case.dates,
        broadcast_users=False,
    )
    days = cohort_user_days(case.metrics, case.users, broadcast_users=False)
    gameplay = gameplay_metrics(
        case.attempts,
        case.users,
        start,
        end,
        broadcast_users=False,
        tie_breaker=TIE_BREAKER,
        **_FORCED,
    )
    return add_gameplay(base_dataset(cohort, days), gameplay)


def _attempt_table(case: Case) -> DataFrame:
    """Writes the attempt table twice; the second run must change nothing."""
    experiment, (start, end) = _saved_experiment(case), case.dates.require(
        "feature_start_date", "test_end_date"
    )
    for _ in range(2):
        table = calc_attempts(
            case.sources,
            experiment,
            start,
            end,
            case.users,
            broadcast_users=case.broadcast_users,
            tie_breaker=TIE_BREAKER,
        )
    return table.select(*ATTEMPT_COLUMNS)


def _carried_metrics(case: Case) -> DataFrame:
    """The metrics carried on over three stretches of days, the last of them twice."""
    experiment = replace(_saved_experiment(case), owner="carried")
    start, end = case.dates.require("feature_start_date", "test_end_date")
    settings = {"tie_breaker": TIE_BREAKER}
    calc_attempts(case.sources, experiment, start, end, case.users, **settings)
    for table in (f"{experiment.attempts_table}_{kind}" for kind in ("closed", "open")):
        case.spark.sql(f"DROP TABLE IF EXISTS {table}")
    steps = [start, start + timedelta(days=9), start + timedelta(days=10), end + timedelta(days=1)]
    stretches = [(a, b - timedelta(days=1)) for a, b in zip(steps, steps[1:], strict=False)]
    for first, last in (*stretches, stretches[-1]):
        carry_attempts(case.sources, experiment, first, last, end, **settings)
    return carried_metrics(case.sources, experiment, end, case.users, **settings)


def _dataset_table(case: Case) -> DataFrame:
    return create_dataset(
        case.sources,
        replace(_saved_experiment(case), owner="job"),
        add_m3_metrics=True,
        need_calc_attempts=True,
        tie_breaker=TIE_BREAKER,
    )


def _catalog(case: Case) -> CatalogSources:
    """The sources saved under catalog names, as a deployment has them."""
    schema, names = _saved_experiment(case).schema, {}
    for source in (Source.AB_USERS, Source.AB_USERS_METRICS, Source.SESSIONS, Source.LEVELS):
        names[source.value] = f"{schema}.src_{source.value}"
        replace_table(case.sources.table(source), names[source.value])
    return CatalogSources(case.spark, names)


def _prepared(prepare: Callable[..., DataFrame], **settings) -> Callable[[Case], DataFrame]:
    """The way users go: sources in a catalog, the dataset job, and a KPI table of what it saved."""

    def build(case: Case) -> DataFrame:
        sources = _catalog(case)
        experiment = replace(_saved_experiment(case), owner=prepare.__name__)
        create_dataset(sources, experiment, tie_breaker=TIE_BREAKER, **settings)
        return prepare(sources, experiment)

    return build


def _all_prepared(table: str) -> Callable[[Case], DataFrame]:
    """One KPI table of the states that a single scan of the saved dataset gave."""

    def build(case: Case) -> DataFrame:
        sources = _catalog(case)
        experiment = replace(_saved_experiment(case), owner=f"states_{table}")
        create_dataset(
            sources, experiment, tie_breaker=TIE_BREAKER, add_m3_metrics=True, need_calc_attempts=True
        )
        return prepare_all_metrics(sources, experiment)[table]

    return build


def _android_cohort(case: Case) -> DataFrame:
    """The same test on the other platform, with that platform's codes."""
    experiment = replace(EXPERIMENT, platform=Platform.ANDROID)
    enrolled = enrolled_users(case.sources.table(Source.AB_USERS), experiment)
    return experiment_cohort(
        enrolled,
        case.sources.table(Source.SESSIONS),
        experiment,
        verify_ab_exp(case.sources, experiment),
        broadcast_users=count_unique_users(enrolled) <= MAX_BROADCAST_ROWS,
    )


def _saved_experiment(case: Case) -> Experiment:
    """The experiment with a schema of its own, placed where all executors can write."""
    context = case.spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="trialmart-")
    location = os.path.join(shared, f"trialmart_{context.applicationId}")
    case.spark.sql(f"CREATE DATABASE IF NOT EXISTS trialmart_saved LOCATION '{location}'")
    return replace(EXPERIMENT, schema="trialmart_saved", owner="step")


_QUERIES: dict[str, Callable[[Case], DataFrame]] = {
    "experiment_lookup": _lookup,
    "session_segments": lambda case: session_segments(case.sessions),
    "session_snapshot": lambda case: session_snapshot(session_segments(case.sessions)),
    "test_cohort": lambda case: case.cohort,
    "test_cohort_android": _android_cohort,
    "pre_period_covariate": lambda case: pre_period_covariate(case.metrics),
    "main_metrics_pivot": _main_metrics,
    "base_dataset": lambda case: case.base,
    "attempt_facts": lambda case: case.attempts.select(*ATTEMPT_COLUMNS),
    "attempt_features": _features,
    "user_day_metrics": lambda case: user_day_metrics(case.features),
    "user_day_panel": lambda case: case.panel,
    "cumulative_metrics": lambda case: gameplay_metrics(
        case.attempts,
        case.users,
        *case.dates.require("feature_start_date", "test_end_date"),
        broadcast_users=case.broadcast_users,
        tie_breaker=TIE_BREAKER,
    ),
    "m3_dataset": lambda case: case.full,
    "base_kpis": lambda case: base_kpis(case.base, one_row_per_user_day=True),
    "base_kpis_distinct": lambda case: base_kpis(case.base),
    "m3_kpis": lambda case: m3_kpis(case.full, one_row_per_user_day=True),
    "streak_kpis": lambda case: streak_kpis(case.full, one_row_per_user_day=True),
    "attempt_facts_shuffled": _shuffled_facts,
    "attempt_features_split": _split_features,
    "m3_dataset_shuffled": _shuffled_dataset,
    "attempt_table": _attempt_table,
    "cumulative_metrics_carried": _carried_metrics,
    "dataset_table": _dataset_table,
    "prepare_all_m3": _all_prepared("m3"),
    "prepare_all_streak": _all_prepared("streak"),
    "kpi_states_base": lambda case: kpis_of_states(kpi_states(case.full), "base"),
    "prepare_base": _prepared(prepare_base_metrics),
    "prepare_m3": _prepared(prepare_m3_metrics, add_m3_metrics=True, need_calc_attempts=True),
    "prepare_streak": _prepared(
        prepare_streak_metrics, add_m3_metrics=True, need_calc_attempts=True
    ),
}


def _times_as_text(df: DataFrame) -> DataFrame:
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[
            F.col(field.name).cast("string").alias(field.name)
            if isinstance(field.dataType, times)
            else F.col(field.name)
            for field in df.schema
        ]
    )


def _runner(build: Callable[[Case], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _times_as_text(build(Case(spark, sf_dir)))

    return run


QUERIES = {name: _runner(build) for name, build in _QUERIES.items()}
