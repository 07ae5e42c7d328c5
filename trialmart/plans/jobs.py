"""The jobs: look up an experiment, build and save its dataset, roll it up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialmart.experiment import Experiment, ExperimentDates, experiment_lookup, read_dates
from trialmart.operators.attempts import attempt_facts
from trialmart.operators.carry import carry_on, user_days_so_far
from trialmart.operators.cohort import (
    cohort_users,
    count_unique_users,
    enrolled_users,
    experiment_cohort,
)
from trialmart.operators.dataset import add_gameplay, base_dataset
from trialmart.operators.monetisation import metrics_with_covariate
from trialmart.operators.panel import (
    CUMULATIVE_METRICS,
    cumulative_panel,
    observed_days,
)
from trialmart.operators.skew import HOT_ROWS, HOT_SHARE, MAX_BROADCAST_ROWS
from trialmart.operators.timeline import attempt_features
from trialmart.operators.user_days import user_day_partials
from trialmart.plans.kpi import (
    TABLES,
    base_kpis,
    kpi_states,
    kpis_of_states,
    m3_kpis,
    streak_kpis,
)
from trialmart.plans.steps import (
    finish,
    input_state,
    is_finished,
    mark_finished,
    step_key,
    table_state,
)
from trialmart.session import PLAN_CONF, session_conf, sized_for, temporary_tables
from trialmart.sources.catalog import Source, Sources
from trialmart.sources.commits import commit_days
from trialmart.sources.contract import checked
from trialmart.sources.sinks import (
    finished_table,
    replace_days,
    replace_table,
    set_property,
    table_property,
)

ATTEMPT_DAY = "date_attempt"
# First and last day carried on by a run; table property with the last of all.
FROM_DAY, AS_OF = "from_day", "as_of"
CARRIED_TO = "trialmart.carried"
# Table property of datasets whose cohort was checked.
ONE_ROW_PER_USER_DAY = "trialmart.one_row_per_user_day"


def verify_ab_exp(sources: Sources, experiment: Experiment) -> ExperimentDates:
    """Check that the experiment is set up, and return its dates."""
    return read_dates(experiment_lookup(sources.table(Source.AB_USERS), experiment))


def _settled(broadcast_users: bool | None, users: DataFrame) -> bool:
    """Whether to broadcast the users: as told, else if they are few enough."""
    return users.count() <= MAX_BROADCAST_ROWS if broadcast_users is None else broadcast_users


def calc_attempts(
    sources: Sources,
    experiment: Experiment,
    start: date,
    end: date,
    users: DataFrame,
    *,
    broadcast_users: bool | None = None,
    tie_breaker: str | None = None,
    attempts_table: str | None = None,
) -> DataFrame:
    """Write the attempts of the given days; running it again replaces just those days."""
    broadcast_users = _settled(broadcast_users, users)
    table, levels = attempts_table or experiment.attempts_table, checked(sources, Source.LEVELS)
    facts = attempt_facts(
        levels,
        users,
        start,
        end,
        broadcast_users=broadcast_users,
        tie_breaker=tie_breaker,
    )
    # Without the hint every task would write a file of its own for each of its days: after a
    # shuffle by user those are all days, and of a small cohort a scan's tasks find few rows.
    # Days too large for one task stay split.
    facts = facts.hint("rebalance", ATTEMPT_DAY)
    if broadcast_users:
        return commit_days(facts, table, ATTEMPT_DAY, start, end)
    in_range = levels.filter(F.col("partition_date").between(F.lit(start), F.lit(end)))
    with sized_for(sources.spark, in_range.count()):
        return commit_days(facts, table, ATTEMPT_DAY, start, end)


def gameplay_metrics(
    attempts: DataFrame,
    users: DataFrame,
    start: date,
    end: date,
    *,
    broadcast_users: bool | None = None,
    tie_breaker: str | None = None,
    hot_rows: int = HOT_ROWS,
    hot_share: float = HOT_SHARE,
    cumulative: Sequence[str] = CUMULATIVE_METRICS,
) -> DataFrame:
    """Daily and cumulative gameplay metrics of every user on every observed day.

    Only attempts of the date range and of the given users take part, whatever
    else the attempt table holds. ``cumulative`` names the daily metrics that
    also get a running value.
    """
    broadcast_users = _settled(broadcast_users, users)
    attempts = attempts.filter(F.col(ATTEMPT_DAY).between(F.lit(start), F.lit(end)))
    ids = users.select("event_user")
    if broadcast_users:
        attempts = attempts.join(F.broadcast(ids), "event_user", "left_semi")
        days = observed_days(attempts)
    else:
        # Attempts of others drop out in the panel; filtering them here would
        # only add a shuffle. The days must still come from these users alone.
        user_days = attempts.select("event_user", "n_day").distinct()
        days = observed_days(user_days.join(ids, "event_user", "left_semi"))
    features = attempt_features(
        attempts, end, tie_breaker=tie_breaker, hot_rows=hot_rows, hot_share=hot_share
    )
    return cumulative_panel(users, user_day_partials(features), days, cumulative)


def calc_m3_metrics(
    sources: Sources,
    experiment: Experiment,
    start: date,
    end: date,
    users: DataFrame,
    need_calc_attempts: bool,
    *,
    broadcast_users: bool | None = None,
    tie_breaker: str | None = None,
    attempts_table: str | None = None,
    cumulative: Sequence[str] = CUMULATIVE_METRICS,
) -> DataFrame:
    """Gameplay metrics from the experiment's attempt table, brought up to date first if asked."""
    broadcast_users = _settled(broadcast_users, users)
    attempts_table = attempts_table or experiment.attempts_table
    if need_calc_attempts:
        calc_attempts(
            sources,
            experiment,
            start,
            end,
            users,
            broadcast_users=broadcast_users,
            tie_breaker=tie_breaker,
            attempts_table=attempts_table,
        )
    return gameplay_metrics(
        finished_table(sources.spark, attempts_table),
        users,
        start,
        end,
        broadcast_users=broadcast_users,
        tie_breaker=tie_breaker,
        cumulative=cumulative,
    )


def carry_attempts(
    sources: Sources,
    experiment: Experiment,
    first: date,
    last: date,
    end: date,
    *,
    tie_breaker: str,
    attempts_table: str | None = None,
) -> None:
    """Carry the user-days on by the attempts of the days from first to last.

    Only these days of the attempt table are read, and the attempts that the latest days carried on
    before left open. Days are carried on in order; running it again replaces what the same days gave.
    ``end`` is the last day of the experiment, which settles whose last attempt counts as churn.
    """
    spark, table = sources.spark, attempts_table or experiment.attempts_table
    closed_table, open_table = f"{table}_closed", f"{table}_open"
    new = finished_table(spark, table).filter(F.col(ATTEMPT_DAY).between(F.lit(first), F.lit(last)))
    before = None
    if spark.catalog.tableExists(open_table):
        known = finished_table(spark, open_table)
        runs = known.select(FROM_DAY, AS_OF).distinct().collect()
        later = [run for run in runs if run[AS_OF] > last or run[FROM_DAY] < first <= run[AS_OF]]
        if later:
            days = f"{later[0][FROM_DAY]} to {later[0][AS_OF]}"
            raise ValueError(f"{table}: the days {days} are carried on already, in one run")
        as_of = max((run[AS_OF] for run in runs if run[AS_OF] < first), default=None)
        if as_of is not None:
            if as_of != first - timedelta(days=1):
                raise ValueError(f"{table}: days are carried on up to {as_of}; go on from there")
            before = known.filter(F.col(AS_OF) == F.lit(as_of)).drop(FROM_DAY, AS_OF)
    with session_conf(spark, PLAN_CONF), temporary_tables(spark), sized_for(spark, new.count()):
        found = carry_on(new, before, end, tie_breaker=tie_breaker)
        dated = {
            closed_table: found.closed.withColumn(AS_OF, F.lit(last)),
            open_table: found.open.withColumns({FROM_DAY: F.lit(first), AS_OF: F.lit(last)}),
        }
        for name, rows in dated.items():
            # Until both are written they do not belong together.
            if spark.catalog.tableExists(name):
                set_property(spark, name, CARRIED_TO, None)
            replace_days(rows.hint("rebalance"), name, AS_OF, first, last)
        for name in dated:
            set_property(spark, name, CARRIED_TO, last.isoformat())


def carried_metrics(
    sources: Sources,
    experiment: Experiment,
    end: date,
    users: DataFrame,
    *,
    tie_breaker: str,
    attempts_table: str | None = None,
    cumulative: Sequence[str] = CUMULATIVE_METRICS,
) -> DataFrame:
    """Gameplay metrics of all days carried on; equal to those computed from all attempts.

    The attempts carried on have to be those of the given users' first feature days and later, as
    ``calc_attempts`` writes them. Attempts of other users drop out.
    """
    table = attempts_table or experiment.attempts_table
    names = [f"{table}_closed", f"{table}_open"]
    carried_to = {table_property(sources.spark, name, CARRIED_TO) for name in names}
    if len(carried_to) != 1 or None in carried_to:
        raise RuntimeError(f"{table}: days were not carried on to the end; run that again")
    closed, known = (finished_table(sources.spark, name) for name in names)
    as_of = date.fromisoformat(carried_to.pop())
    opened = known.filter(F.col(AS_OF) == F.lit(as_of)).drop(FROM_DAY, AS_OF)
    partials = user_days_so_far(closed.drop(AS_OF), opened, end, tie_breaker=tie_breaker)
    observed = closed.select("event_user", "n_day").unionByName(opened.select("event_user", "n_day"))
    ids = users.select("event_user")
    days = observed_days(observed.distinct().join(ids, "event_user", "left_semi"))
    return cumulative_panel(users, partials, days, cumulative)


def cohort_user_days(
    metrics: DataFrame, users: DataFrame, *, broadcast_users: bool
) -> DataFrame:
    """Daily metrics and covariate, of cohort users only where that is cheap to ensure.

    With a large cohort others stay in: the join with the cohort removes them.
    """
    if broadcast_users:
        ids = F.broadcast(users.select("event_user"))
        metrics = metrics.join(ids, "event_user", "left_semi")
    return metrics_with_covariate(metrics)


def create_dataset(
    sources: Sources,
    experiment: Experiment,
    dates: ExperimentDates | None = None,
    *,
    add_m3_metrics: bool = False,
    need_calc_attempts: bool = False,
    tie_breaker: str | None = None,
    dataset_table: str | None = None,
    attempts_table: str | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    cumulative: Sequence[str] = CUMULATIVE_METRICS,
    resume: bool = False,
    inputs: str | None = None,
) -> DataFrame:
    """Build the user-by-day dataset of an experiment, save it, and return the saved table.

    ``add_m3_metrics`` adds the gameplay columns (72 in all instead of 20). They
    are computed from the experiment's attempt table, which
    ``need_calc_attempts`` brings up to date first. Of the running values among
    them, only those of the metrics in ``cumulative`` are computed.

    With ``resume`` the cohort is saved as well (``<dataset table>_cohort``), and steps that an
    earlier run finished, from the same inputs with the same settings, are read instead of run:
    the cohort, the attempts, the dataset. Whether inputs are the same is told by the files that
    hold the rows of this experiment and its days; for sources that are no file tables, ``inputs``
    has to name their state, for example by a version.
    """
    dates = dates or verify_ab_exp(sources, experiment)
    spark, table = sources.spark, dataset_table or experiment.dataset_table
    attempts_table = attempts_table or (experiment.attempts_table if add_m3_metrics else None)
    ab_users, sessions = checked(sources, Source.AB_USERS), checked(sources, Source.SESSIONS)
    enrolled = enrolled_users(ab_users, experiment)
    user_count = count_unique_users(enrolled)
    broadcast_users = user_count <= max_broadcast_rows
    (first,), last = dates.require("test_start_date"), dates.test_end_date or date.today()
    metrics = experiment.rows_of(checked(sources, Source.AB_USERS_METRICS))
    cohort = experiment_cohort(
        enrolled, sessions, experiment, dates, broadcast_users=broadcast_users
    )
    if resume:
        cohort_table = f"{table}_cohort"
        joined = _between(sessions, *dates.require("test_start_date", "enroll_end_date"))
        cohort_key = step_key(
            "cohort",
            test=experiment.test_id,
            platform=experiment.app_short,
            dates=dates,
            users=input_state(experiment.rows_of(ab_users), inputs),
            sessions=input_state(joined, inputs),
        )
        with session_conf(spark, PLAN_CONF):
            finish(spark, cohort_table, cohort_key, lambda: replace_table(cohort, cohort_table))
        # From here on the saved one, so that no later step depends on a lost driver's cache.
        cohort = spark.table(cohort_table)
        if add_m3_metrics and need_calc_attempts:
            start, end = dates.require("feature_start_date", "test_end_date")
            played = _between(checked(sources, Source.LEVELS), start, end)
            attempts_key = step_key(
                "attempts",
                cohort=cohort_key,
                levels=input_state(played, inputs),
                tie_breaker=tie_breaker,
            )

            def attempts_step() -> None:
                calc_attempts(
                    sources,
                    experiment,
                    start,
                    end,
                    cohort_users(cohort),
                    broadcast_users=broadcast_users,
                    tie_breaker=tie_breaker,
                    attempts_table=attempts_table,
                )

            with session_conf(spark, PLAN_CONF):
                finish(spark, attempts_table, attempts_key, attempts_step)
            need_calc_attempts = False
        dataset_key = step_key(
            "dataset",
            cohort=cohort_key,
            metrics=input_state(metrics, inputs),
            attempts=table_state(spark, attempts_table) if add_m3_metrics else None,
            tie_breaker=tie_breaker,
            cumulative=list(cumulative) if add_m3_metrics else None,
        )
        if is_finished(spark, table, dataset_key):
            return spark.table(table)
    else:
        cohort = cohort.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with session_conf(spark, PLAN_CONF), temporary_tables(spark):
            users = cohort_users(cohort)
            # The result has at most this many rows.
            rows = user_count * ((last - first).days + 1)
            dataset = base_dataset(
                cohort, cohort_user_days(metrics, users, broadcast_users=broadcast_users)
            )
            if add_m3_metrics:
                start, end = dates.require("feature_start_date", "test_end_date")
                gameplay = calc_m3_metrics(
                    sources,
                    experiment,
                    start,
                    end,
                    users,
                    need_calc_attempts,
                    broadcast_users=broadcast_users,
                    tie_breaker=tie_breaker,
                    attempts_table=attempts_table,
                    cumulative=cumulative,
                )
                dataset = add_gameplay(dataset, gameplay)
                rows = max(rows, spark.table(attempts_table).count())
            with sized_for(spark, rows):
                replace_table(dataset, table)
                # Gone when another writer replaces the table.
                set_property(spark, table, ONE_ROW_PER_USER_DAY, "true")
                if resume:
                    mark_finished(spark, table, dataset_key)
                return spark.table(table)
    finally:
        if not resume:
            cohort.unpersist()


def _between(table: DataFrame, start: date, end: date) -> DataFrame:
    return table.filter(F.col("partition_date").between(F.lit(start), F.lit(end)))


def _saved(sources: Sources, experiment: Experiment, dataset_table: str | None) -> DataFrame:
    return sources.spark.table(dataset_table or experiment.dataset_table)


def _one_row_per_user_day(
    sources: Sources, experiment: Experiment, dataset_table: str | None
) -> bool:
    """Whether the dataset is one that ``create_dataset`` saved under the experiment's name.

    The cohort was checked to be free of duplicates then. Any other table may hold anything.
    """
    if dataset_table is not None:
        return False
    return table_property(sources.spark, experiment.dataset_table, ONE_ROW_PER_USER_DAY) == "true"


def _prepare(
    kpis: Callable[..., DataFrame], sources: Sources, experiment: Experiment, table: str | None
) -> DataFrame:
    one_row = _one_row_per_user_day(sources, experiment, table)
    return kpis(_saved(sources, experiment, table), one_row_per_user_day=one_row)


def prepare_base_metrics(
    sources: Sources, experiment: Experiment, dataset_table: str | None = None
) -> DataFrame:
    return _prepare(base_kpis, sources, experiment, dataset_table)


def prepare_m3_metrics(
    sources: Sources, experiment: Experiment, dataset_table: str | None = None
) -> DataFrame:
    return _prepare(m3_kpis, sources, experiment, dataset_table)


def prepare_streak_metrics(
    sources: Sources, experiment: Experiment, dataset_table: str | None = None
) -> DataFrame:
    return _prepare(streak_kpis, sources, experiment, dataset_table)


def prepare_all_metrics(
    sources: Sources,
    experiment: Experiment,
    dataset_table: str | None = None,
    states_table: str | None = None,
) -> dict[str, DataFrame]:
    """All KPI tables the dataset has the columns for, by name, from one scan of it.

    The scan's result, one row per group and day, is saved as ``states_table``; the tables are
    computed from that.
    """
    dataset = _saved(sources, experiment, dataset_table)
    tables = list(TABLES) if "attempts" in dataset.columns else ["base"]
    one_row = _one_row_per_user_day(sources, experiment, dataset_table)
    states = kpi_states(dataset, tables, one_row_per_user_day=one_row)
    name = states_table or f"{dataset_table or experiment.dataset_table}_kpi_states"
    saved = replace_table(states, name)
    return {table: kpis_of_states(saved, table) for table in tables}
