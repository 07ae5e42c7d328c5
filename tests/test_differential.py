"""Every registered query against its SQL oracle, on whole tables."""

import pytest

from __spark_entry__ import entry
from checks.compare import difference
from checks.oracle import ORACLES
from checks.queries import QUERIES
from trialmart.session import session_conf


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name]) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows_and_the_kpi_columns(spark):
    result = entry(spark)
    assert len(result.columns) == 17
    assert result.count() > 0


@pytest.mark.parametrize(
    "settings",
    [
        {"spark.sql.ansi.enabled": "false"},
        # A zone whose clocks jump, and other partition counts.
        {"spark.sql.session.timeZone": "America/New_York", "spark.sql.shuffle.partitions": "13"},
    ],
)
@pytest.mark.parametrize("name", ["session_snapshot", "attempt_features_split", "m3_dataset"])
def test_results_do_not_depend_on_session_settings(spark, sf_dir, name, settings):
    with session_conf(spark, settings):
        found = difference(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name])
    assert found is None
