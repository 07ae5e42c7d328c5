"""Faulty source tables are refused by name, before any plan is built on them."""

from datetime import date

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from checks.queries import TIE_BREAKER, Case
from trialmart import CatalogSources, Experiment, Source, calc_attempts, create_dataset
from trialmart.sources.contract import CONTRACTS, SourceError, checked, faults

SMALL = SF_DIR.replace("sf0.01", "sf0.001")


class Altered:
    """The derived sources, one of them changed."""

    def __init__(self, case, source, change):
        self.spark, self._case, self._source, self._change = case.spark, case, source, change

    def table(self, source):
        table = self._case.sources.table(source)
        return self._change(table) if Source(source) == self._source else table


@pytest.mark.parametrize("source", list(CONTRACTS))
def test_each_source_names_all_its_faulty_columns(spark, source):
    case = Case(spark, SMALL)
    assert faults(case.sources.table(source), source) == []
    first, *_, last = CONTRACTS[source]
    change = lambda table: table.drop(first).withColumn(last, F.array(last))
    with pytest.raises(SourceError) as error:
        checked(Altered(case, source, change), source)
    text = str(error.value)
    assert text.startswith(f"source {source.value}: {first} is missing; {last} is array<")


def test_jobs_refuse_faulty_tables(spark):
    case, experiment = Case(spark, SMALL), Experiment("T1", owner="faulty")
    as_text = lambda table: table.withColumn("partition_date", F.col("partition_date").cast("string"))
    with pytest.raises(SourceError, match="sessions: partition_date is string, not date"):
        create_dataset(Altered(case, Source.SESSIONS, as_text), experiment)
    with pytest.raises(SourceError, match="levels: event_payload is missing"):
        calc_attempts(
            Altered(case, Source.LEVELS, lambda table: table.drop("event_payload")),
            experiment, date(2024, 1, 4), date(2024, 1, 5), case.users, tie_breaker=TIE_BREAKER,
        )


def test_sources_without_a_contract_pass(spark):
    spark.range(3).createOrReplaceTempView("any_events")
    sources = CatalogSources(spark, {"events": "any_events"})
    assert checked(sources, Source.EVENTS).count() == 3
