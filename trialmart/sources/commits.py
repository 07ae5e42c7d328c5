"""Days of a table replaced by one commit.

Rows are written as a *run* of their own to ``<table>_runs``, where nothing reads them yet.
``table`` is a view that names, for each stretch of days, the run that is valid. Changing its text is
one catalog operation: whoever reads the view, by whatever means, sees all days of a run or none,
and a write that was broken off leaves no trace. The text is the only record of what is valid.

A DataFrame made before a commit keeps reading the rows it was made for: files are removed by the
commit after the one that replaced them. One job at a time may write a table, as two commits at once
would start from the same text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialmart.sources.sinks import is_view, replace_days

RUN = "_run"
_DAY = timedelta(days=1)
_TERM = re.compile(
    rf"`{RUN}` = '([0-9a-f]+)' AND `[^`]+` BETWEEN DATE'([\d-]+)' AND DATE'([\d-]+)'"
)


class Stretch(NamedTuple):
    """Days of which a run's rows are valid."""

    run: str
    first: date
    last: date

    def condition(self, day_column: str) -> str:
        return (
            f"`{RUN}` = '{self.run}' AND"
            f" `{day_column}` BETWEEN DATE'{self.first}' AND DATE'{self.last}'"
        )


def commit_days(df: DataFrame, table: str, day_column: str, start: date, end: date) -> DataFrame:
    """Make ``df`` the table's content for the days from start to end; keep all other days.

    A row of another day, or of none, is an error. Repeated rows stay. Days without rows become
    empty, also if ``df`` is. A plain table of that name, which another writer made, is replaced in
    place as ``replace_days`` does.
    """
    spark = df.sparkSession
    exists = spark.catalog.tableExists(table)
    if exists and not is_view(spark, table):
        return replace_days(df, table, day_column, start, end)
    runs = f"{table}_runs"
    valid = valid_stretches(spark, table) if exists else []
    if not spark.catalog.tableExists(runs):
        empty = spark.createDataFrame([], df.schema).withColumn(RUN, F.lit(""))
        empty.write.partitionBy(RUN, day_column).saveAsTable(runs)
    columns = spark.table(table).columns if exists else df.columns
    stored = spark.table(runs).columns
    if not set(columns) == set(df.columns) == set(stored) - {RUN}:
        raise ValueError(f"{table} has other columns than the rows to write")

    run = uuid.uuid4().hex
    day = F.col(day_column)
    outside = F.raise_error(F.lit(f"{table}: a row is not of the days {start} to {end}"))
    inside = F.when(day.between(F.lit(start), F.lit(end)), day).otherwise(outside.cast("date"))
    rows = df.withColumns({day_column: inside, RUN: F.lit(run)})
    rows.select(*stored).write.insertInto(runs)

    new = [*_without(valid, start, end)]
    if start <= end:
        new.append(Stretch(run, start, end))
    _point(spark, table, runs, columns, day_column, sorted(new, key=lambda part: part.first), exists)
    _remove_all_but(spark, runs, day_column, [*valid, *new])
    return spark.table(table)


def valid_stretches(spark: SparkSession, table: str) -> list[Stretch]:
    """Which run each stretch of days is read from, by the view's text."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    text = described.filter(F.col("col_name") == "View Text").head()["data_type"]
    if not re.search(rf" FROM (\w+\.)*{table.split('.')[-1]}_runs WHERE ", text):
        raise ValueError(f"{table} is a view that was not made by a commit")
    return [
        Stretch(run, date.fromisoformat(first), date.fromisoformat(last))
        for run, first, last in _TERM.findall(text)
    ]


def _without(stretches: Iterable[Stretch], start: date, end: date) -> Iterator[Stretch]:
    """What is left of stretches outside the days from start to end."""
    for part in stretches:
        if start > end:
            yield part
            continue
        if part.first < start:
            yield part._replace(last=min(part.last, start - _DAY))
        if part.last > end:
            yield part._replace(first=max(part.first, end + _DAY))


def _point(
    spark: SparkSession,
    table: str,
    runs: str,
    columns: list[str],
    day_column: str,
    stretches: list[Stretch],
    exists: bool,
) -> None:
    """The commit: from now on the view reads these stretches."""
    names = ", ".join(f"`{name}`" for name in columns)
    terms = " OR ".join(f"({part.condition(day_column)})" for part in stretches) or "false"
    verb = "ALTER" if exists else "CREATE"
    spark.sql(f"{verb} VIEW {table} AS SELECT {names} FROM {runs} WHERE {terms}")


def _remove_all_but(
    spark: SparkSession, runs: str, day_column: str, stretches: list[Stretch]
) -> None:
    """Remove the days of runs that no stretch covers, those of broken-off writes among them."""
    covered: dict[str, list[Stretch]] = {}
    for part in stretches:
        covered.setdefault(part.run, []).append(part)
    unread = []
    for row in spark.sql(f"SHOW PARTITIONS {runs}").collect():
        run, day = (value.split("=", 1)[1] for value in row["partition"].split("/"))
        moment = date.fromisoformat(day)
        if not any(part.first <= moment <= part.last for part in covered.get(run, [])):
            unread.append(f"PARTITION (`{RUN}` = '{run}', `{day_column}` = '{day}')")
    if unread:
        spark.sql(f"ALTER TABLE {runs} DROP IF EXISTS {', '.join(unread)}")
