"""What the jobs read from each source table, checked when a table is resolved.

A column of another type than those listed, or a missing one, would surface deep in a plan or as a
column of nulls. All faults of a table are named in one error instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trialmart.sources.catalog import Source, Sources

_TEXT = (T.StringType,)
_ID = (T.StringType, T.IntegralType, T.DecimalType)
_DAY = (T.DateType,)
# Days that are read through ``to_date``, which takes all of these.
_DAY_LIKE = (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
_TIME = (T.TimestampType, T.TimestampNTZType)
_WHOLE = (T.IntegralType, T.DecimalType)
_NUMBER = (T.NumericType,)
# Read through lenient casts.
_FLAG = (T.BooleanType, T.IntegralType, T.StringType)

_EXPERIMENT = {"test_id": _TEXT, "app_short": _TEXT}
CONTRACTS: dict[Source, dict[str, tuple[type[T.DataType], ...]]] = {
    Source.AB_USERS: {
        **_EXPERIMENT,
        "abgroup": _ID,
        "event_user": _ID,
        "good_user": _FLAG,
        "test_enroll_date": _DAY_LIKE,
        "metric_calc_start_date": _DAY_LIKE,
        "device_region": _TEXT,
        **dict.fromkeys(
            ("test_start_date", "test_end_date", "enroll_end_date", "feature_start_date",
             "feature_end_date"), _DAY_LIKE,
        ),
    },
    Source.AB_USERS_METRICS: {
        **_EXPERIMENT,
        "event_user": _ID,
        "personal_test_participation_day_num": _WHOLE,
        "metric_name": _TEXT,
        "value": _NUMBER,
    },
    Source.SESSIONS: {
        "user_id": _ID,
        "partition_date": _DAY,
        "store": _TEXT,
        "session_id": _TEXT,
        "user_payload": _TEXT,
    },
    Source.LEVELS: {
        "user_id": _ID,
        "partition_date": _DAY,
        "client_time": _TIME,
        "level": _NUMBER,
        "complexity": _ID,
        "attempt": _NUMBER,
        "reason": _TEXT,
        "influence": _FLAG,
        "event_payload": _TEXT,
    },
}


class SourceError(ValueError):
    """A source table is not as the jobs need it."""


def faults(table: DataFrame, source: Source) -> list[str]:
    """What is wrong with a table, one text per column."""
    present = {field.name: field.dataType for field in table.schema}
    found = []
    for name, kinds in CONTRACTS.get(Source(source), {}).items():
        if name not in present:
            found.append(f"{name} is missing")
        elif not isinstance(present[name], kinds):
            wanted = " or ".join(kind.__name__.removesuffix("Type").lower() for kind in kinds)
            found.append(f"{name} is {present[name].simpleString()}, not {wanted}")
    return found


def checked(sources: Sources, source: Source) -> DataFrame:
    """The source table, or one error that names the source and all its faulty columns."""
    table = sources.table(source)
    found = faults(table, source)
    if found:
        raise SourceError(f"source {Source(source).value}: {'; '.join(found)}")
    return table
