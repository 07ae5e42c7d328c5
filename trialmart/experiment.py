"""What identifies one experiment, and the calendar it runs on."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, fields
from datetime import date, datetime
from enum import Enum
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Codes(NamedTuple):
    app_short: str
    store: str


class Platform(str, Enum):
    IOS = "iOS"
    ANDROID = "Android"

    @property
    def app_short(self) -> str:
        return _PLATFORM_CODES[self.value].app_short

    @property
    def store(self) -> str:
        return _PLATFORM_CODES[self.value].store


# The codes the source tables use for each platform.
_PLATFORM_CODES = {
    "iOS": _Codes(app_short="hs_as", store="ios"),
    "Android": _Codes(app_short="hs_gp", store="googleplay"),
}


@dataclass(frozen=True)
class Experiment:
    """An experiment on one platform, and where its results are saved.

    ``owner`` is part of the names of the two tables the jobs write, so that analysts do not
    overwrite each other's; it may only be left out where tables are named in the call.
    ``schema`` is the catalog schema for the two tables the jobs write; leave it
    out for the session's current schema.
    """

    test_id: str
    platform: Platform = Platform.IOS
    owner: str | None = None
    schema: str | None = None

    @property
    def app_short(self) -> str:
        return Platform(self.platform).app_short

    @property
    def store(self) -> str:
        return Platform(self.platform).store

    @property
    def dataset_table(self) -> str:
        return self._table("dataset")

    @property
    def attempts_table(self) -> str:
        # The platform is part of the name, so the two platforms of one test
        # never share a table.
        return self._table("attempts")

    def _table(self, kind: str) -> str:
        if not self.owner:
            raise ValueError("name the experiment's owner, or pass a table name to the job")
        name = f"{self.owner}_ab_{kind}_{self.test_id}_{self.app_short}"
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"{name!r} is no valid table name; pass one to the job")
        return f"{self.schema}.{name}" if self.schema else name

    def rows_of(self, table: DataFrame) -> DataFrame:
        """The rows of a source table that belong to this experiment and platform."""
        return table.filter((F.col("test_id") == self.test_id) & (F.col("app_short") == self.app_short))


@dataclass(frozen=True)
class ExperimentDates:
    test_start_date: date | None
    test_end_date: date | None
    enroll_end_date: date | None
    feature_start_date: date | None
    feature_end_date: date | None

    def require(self, *names: str) -> list[date]:
        """The named dates, refusing unset ones: a range with an open end matches no row."""
        values = [getattr(self, name) for name in names]
        unset = [name for name, value in zip(names, values) if value is None]
        if unset:
            raise ValueError(f"the experiment has no {', '.join(unset)}")
        return values


DATE_FIELDS = tuple(f.name for f in fields(ExperimentDates))


def experiment_lookup(ab_users: DataFrame, experiment: Experiment) -> DataFrame:
    """The distinct date settings recorded for the experiment: one row if it is set up well."""
    _check_columns(ab_users.columns, ("test_id", "app_short", *DATE_FIELDS))
    return experiment.rows_of(ab_users).select("test_id", "app_short", *DATE_FIELDS).distinct()


def read_dates(lookup: DataFrame) -> ExperimentDates:
    """Fetch the single row of an experiment lookup; any other row count is an error."""
    _check_columns(lookup.columns, DATE_FIELDS)
    rows = lookup.select(*DATE_FIELDS).limit(2).collect()
    if len(rows) != 1:
        found = "no row" if not rows else "more than one set of dates"
        raise ValueError(f"the experiment lookup must give exactly one row, found {found}")
    return ExperimentDates(**{name: _as_date(rows[0][name]) for name in DATE_FIELDS})


def _check_columns(present: Iterable[str], wanted: Iterable[str]) -> None:
    missing = sorted(set(wanted) - set(present))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _as_date(value: date | datetime | str | None) -> date | None:
    if isinstance(value, datetime):
        return value.date()
    return date.fromisoformat(value) if isinstance(value, str) else value
