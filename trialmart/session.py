"""Spark settings the plans rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Several steps are clustered by user and then join on user, day and group. A
# user has at most one row per day by then, so clustering by user alone is
# balanced, and both sides of such a join can stay where they are. The panel's union
# keeps the clustering that both its sides have.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.unionOutputPartitioning": "true",
}

SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
# An attempt takes some 180 bytes in a shuffle, a row of the dense panel some 450. AQE
# merges partitions that turn out small.
ROWS_PER_TASK = 1_000_000


def configure(spark: SparkSession) -> SparkSession:
    for key, value in PLAN_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def session_conf(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Apply settings for the duration of a block."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def sized_for(
    spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK
) -> Iterator[None]:
    """Allow shuffles of ``rows`` rows enough partitions for each to fit in a task.

    Never lowers the session's number. AQE merges partitions but does not split those
    of a window, so their number has to be right from the start.
    """
    wanted = max(int(spark.conf.get(SHUFFLE_PARTITIONS)), -(-rows // rows_per_task))
    with session_conf(spark, {SHUFFLE_PARTITIONS: str(wanted)}):
        yield


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-"):
        return tempfile.gettempdir()
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


# Folders written inside the innermost ``temporary_tables`` block.
_written: list[list[str]] = []


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the folder all executors share and read from there.

    Runs the plan once; what reads the result survives lost executors, and sees the same rows in
    the same files each time. Inside ``temporary_tables`` the files are removed at its end,
    otherwise they stay.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trialmart-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what ``stored`` writes inside the block."""
    _written.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        settings = spark.sparkContext._jsc.hadoopConfiguration()
        for name in _written.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(settings).delete(path, True)
