"""Steps of a job whose results are kept, so that a run that broke off goes on behind them.

A finished step's table carries a mark, a table property: the key of what the step was made from, and
the state the table was in afterwards. A step counts as finished only while both are the same as
then: other inputs, other parameters and other writers all make it run again. A step that broke off
leaves no mark.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialmart.sources.commits import valid_stretches
from trialmart.sources.sinks import is_view, set_property, table_property

STEP = "trialmart.step"
_FILE_FIELDS = ("file_path", "file_size", "file_modification_time")


def step_key(step: str, **made_from: object) -> str:
    """One text for a step and everything its result depends on."""
    told = json.dumps({"step": step, **made_from}, sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()


def input_state(df: DataFrame, inputs: str | None = None) -> str:
    """A text that changes with the files ``df`` has rows of: their names, sizes and times.

    One row per file leaves a task and none is collected. Columns are read only where ``df`` filters
    by them. Rows that do not come straight from files, as those of a view, have no such state:
    the caller must then name it as ``inputs``.
    """
    if inputs is not None:
        return inputs
    file = F.struct(*[F.col(f"_metadata.{name}") for name in _FILE_FIELDS])
    try:
        files = df.select(F.xxhash64(file).alias("file")).distinct()
    except AnalysisException as error:
        raise ValueError(
            "a source is not read straight from files; name the state of the sources as `inputs`"
        ) from error
    found = files.agg(F.count("*"), F.sum(F.col("file").cast("decimal(38, 0)"))).first()
    return f"{found[0]} files, {found[1]}"


def table_state(spark: SparkSession, table: str) -> str:
    """A text that changes with the content of a table the jobs wrote."""
    if not is_view(spark, table):
        return input_state(spark.table(table))
    # Every commit writes a run of its own.
    return step_key("state", stretches=valid_stretches(spark, table))


def is_finished(spark: SparkSession, table: str, key: str) -> bool:
    if not spark.catalog.tableExists(table):
        return False
    mark = table_property(spark, table, STEP)
    return mark is not None and mark == f"{key} {table_state(spark, table)}"


def finish(spark: SparkSession, table: str, key: str, run: Callable[[], object]) -> bool:
    """Run a step that writes ``table``, unless it is finished; whether it ran."""
    if is_finished(spark, table, key):
        return False
    run()
    mark_finished(spark, table, key)
    return True


def mark_finished(spark: SparkSession, table: str, key: str) -> None:
    set_property(spark, table, STEP, f"{key} {table_state(spark, table)}")
