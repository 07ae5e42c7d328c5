"""Intermediate tables in the folder that all executors share; the package on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import trialmart

_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return tempfile.gettempdir()
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def saved(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once and read back: cuts lineage, survives lost executors.

    Unlike ``checkpoint()`` it runs the plan a single time and stores compressed columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trialmart-llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_frequent(
    rows: DataFrame, table: DataFrame, keys: list[str], frequent: Column
) -> DataFrame:
    """Inner join with a table of one row per key, in which some keys hold many of the rows.

    frequent: a condition on the table that only few of its rows can meet, as those with over a
    thousandth of all. These are broadcast, and their rows never meet in a task; the others are
    joined by shuffling.
    """
    often = table.filter(frequent)
    found = rows.join(F.broadcast(often), keys)
    others = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti")
    rare = table.filter(~frequent)
    return found.unionByName(others.join(rare.hint("merge"), keys).select(*found.columns))


def placed(stored: DataFrame) -> DataFrame:
    """Number the rows of a table just saved, in the order they were written: ``place``, from 0.

    Ranges written by ``repartitionByRange`` and ``sortWithinPartitions`` are so numbered in their
    order over all tasks. Only the row count of each written file is gathered.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    rows = stored.select(
        "*", part.alias("_part"), F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    files = rows.groupBy("_part", "_file").agg(F.max("_row").alias("_last"))
    before = F.sum(F.col("_last") + 1).over(
        Window.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = files.select("_file", F.coalesce(before, F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_file").select(
        *stored.columns, (F.col("_start") + F.col("_row")).alias("place")
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, where it is not installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(trialmart.__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="trialmart-")) / "trialmart.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
