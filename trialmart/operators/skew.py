"""Joins and key statistics that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only after its rows were counted and found below this.
# A cohort row is three short columns, so this is some 100 MB on each executor.
MAX_BROADCAST_ROWS = 1_000_000

# A key is hot when it holds more than this many rows and more than this share
# of all rows. By the share, fewer than 1 / HOT_SHARE keys can be hot, whatever
# the data; that bound is what allows the list of them to be fetched. Up to 10^12
# rows the number of rows alone decides.
HOT_ROWS = 1_000_000
HOT_SHARE = 1 / MAX_BROADCAST_ROWS

# Parts that a hot user's rows are dealt to, where they must be shuffled.
SALTS = 64


def hot_key_rows(
    df: DataFrame, key: str, hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE
) -> DataFrame | None:
    """The keys that hold too many rows for one task with their ``key_rows``, or None.

    The counts are combined map-side and read only the key column. Fewer than
    ``1 / hot_share`` keys can pass the cutoff, so the result is small by
    construction and safe to broadcast.
    """
    total = df.count()
    if total <= hot_rows:
        return None
    cutoff = max(hot_rows, total * hot_share)
    keys = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("key_rows"))
        .filter(F.col("key_rows") > cutoff)
    )
    found = keys.collect()
    return df.sparkSession.createDataFrame(found, keys.schema) if found else None


def hot_keys(
    df: DataFrame, key: str, hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE
) -> DataFrame | None:
    """The keys that hold too many rows for one task, or None if there are none."""
    found = hot_key_rows(df, key, hot_rows, hot_share)
    return None if found is None else found.select(key)


def join_users(
    facts: DataFrame,
    users: DataFrame,
    *,
    broadcast_users: bool,
    key: str = "event_user",
    hot_rows: int = HOT_ROWS,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Inner join of a large fact table with one row per user.

    With a small user side the facts never move. Otherwise both sides are
    shuffled by user and a salt, in one pass over the facts. The salt is 0 but
    for hot users, whose facts are dealt to ``SALTS`` parts by their content,
    each of which meets a copy of the user's row.
    """
    if broadcast_users:
        return facts.join(F.broadcast(users), key)
    hot = hot_keys(facts, key, hot_rows, hot_share)
    if hot is None:
        return facts.join(users, key)
    hot = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    content = F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)).cast("int")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted_facts = facts.join(hot, key, "left").withColumn(
        "salt", F.when(F.col("is_hot"), content).otherwise(F.lit(0))
    )
    salted_users = users.join(hot, key, "left").withColumn(
        "salt", F.explode(F.when(F.col("is_hot"), every).otherwise(F.array(F.lit(0))))
    )
    # Stated, so that the join never settles on clustering facts by user alone.
    salted_users = salted_users.drop("is_hot").repartition(key, "salt")
    return salted_facts.drop("is_hot").join(salted_users, [key, "salt"]).drop("salt")
