"""Logical source names and the tables behind them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from enum import Enum
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Source(str, Enum):
    AB_USERS = "ab_users"
    AB_USERS_METRICS = "ab_users_metrics"
    SESSIONS = "sessions"
    EVENTS = "events"
    LEVELS = "levels"


@dataclass(frozen=True)
class SourceTable:
    path: str
    description: str = ""
    link: str = ""


class Sources(Protocol):
    """Anything that can hand out the source tables."""

    spark: SparkSession

    def table(self, source: Source) -> DataFrame: ...


class CatalogSources:
    """Source tables by catalog name, looked up anew on each call."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, str | SourceTable]):
        self.spark = spark
        self._tables = {
            Source(name): entry if isinstance(entry, SourceTable) else SourceTable(entry)
            for name, entry in tables.items()
        }

    def entry(self, source: Source) -> SourceTable:
        source = Source(source)
        if source not in self._tables:
            raise KeyError(f"no table is registered for source {source.value!r}")
        return self._tables[source]

    def table(self, source: Source) -> DataFrame:
        return self.spark.table(self.entry(source).path)
