"""Experiment datasets and KPI tables on Spark."""

from trialmart.experiment import Experiment, ExperimentDates, Platform, experiment_lookup, read_dates
from trialmart.plans.jobs import (
    calc_attempts,
    calc_m3_metrics,
    carried_metrics,
    carry_attempts,
    create_dataset,
    gameplay_metrics,
    prepare_all_metrics,
    prepare_base_metrics,
    prepare_m3_metrics,
    prepare_streak_metrics,
    verify_ab_exp,
)
from trialmart.plans.kpi import base_kpis, m3_kpis, streak_kpis
from trialmart.session import configure
from trialmart.sources.catalog import CatalogSources, Source, SourceTable

__all__ = [
    "CatalogSources",
    "Experiment",
    "ExperimentDates",
    "Platform",
    "Source",
    "SourceTable",
    "base_kpis",
    "calc_attempts",
    "calc_m3_metrics",
    "carried_metrics",
    "carry_attempts",
    "configure",
    "create_dataset",
    "experiment_lookup",
    "gameplay_metrics",
    "m3_kpis",
    "prepare_all_metrics",
    "prepare_base_metrics",
    "prepare_m3_metrics",
    "prepare_streak_metrics",
    "read_dates",
    "streak_kpis",
    "verify_ab_exp",
]
