"""Writes that can be repeated: the same call again leaves the same table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trialmart.session import session_conf

# Table property with the days that are being replaced.
UNFINISHED = "trialmart.unfinished"


def replace_table(df: DataFrame, table: str) -> DataFrame:
    """Write ``df`` as the whole content and schema of ``table``."""
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)
    return df.sparkSession.table(table)


def replace_days(df: DataFrame, table: str, day_column: str, start: date, end: date) -> DataFrame:
    """Make ``df`` the table's content for the days from start to end; keep all other days.

    Days that ``df`` has rows for are swapped in by the write itself. Days of the
    range it has none for are dropped after the write has succeeded, so a failed
    run never leaves fewer days than before. Until both steps are done the table
    carries a mark by which ``finished_table`` refuses it.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], df.schema)
        empty.write.partitionBy(day_column).saveAsTable(table)
    columns = spark.table(table).columns
    if set(columns) != set(df.columns):
        raise ValueError(f"{table} has other columns than the rows to write")
    days = f"{start.isoformat()}/{end.isoformat()}"
    unfinished = table_property(spark, table, UNFINISHED)
    if unfinished:
        first, last = unfinished.split("/")
        if first < start.isoformat() or last > end.isoformat():
            raise ValueError(f"{table}: first write the unfinished days {unfinished} again")
    set_property(spark, table, UNFINISHED, days)

    written = Observation()
    rows = df.select(*columns).observe(written, F.collect_set(day_column).alias("days"))
    with session_conf(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        rows.write.insertInto(table, overwrite=True)

    filled = {str(day) for day in written.get["days"]}
    stale = [
        day
        for day in _stored_days(spark, table)
        if start.isoformat() <= day <= end.isoformat() and day not in filled
    ]
    if stale:
        specs = ", ".join(f"PARTITION ({day_column} = '{day}')" for day in stale)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    set_property(spark, table, UNFINISHED, None)
    return spark.table(table)


def finished_table(spark: SparkSession, table: str) -> DataFrame:
    """The table, or an error if replacing some of its days was broken off."""
    unfinished = table_property(spark, table, UNFINISHED)
    if unfinished:
        raise RuntimeError(f"{table}: the days {unfinished} were not written to the end; run again")
    return spark.table(table)


def table_property(spark: SparkSession, table: str, name: str) -> str | None:
    properties = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
    return {row["key"]: row["value"] for row in properties}.get(name)


def is_view(spark: SparkSession, table: str) -> bool:
    return spark.catalog.getTable(table).tableType == "VIEW"


def set_property(spark: SparkSession, table: str, name: str, value: str | None) -> None:
    """Set a property of a table or view, or with None take it away."""
    kind = "VIEW" if is_view(spark, table) else "TABLE"
    if value is None:
        spark.sql(f"ALTER {kind} {table} UNSET TBLPROPERTIES IF EXISTS ('{name}')")
    else:
        spark.sql(f"ALTER {kind} {table} SET TBLPROPERTIES ('{name}' = '{value}')")


def _stored_days(spark: SparkSession, table: str) -> list[str]:
    partitions = spark.sql(f"SHOW PARTITIONS {table}").collect()
    return [row["partition"].split("=", 1)[1] for row in partitions]
