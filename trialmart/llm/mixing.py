"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id and queue up, for as many epochs as the
source's target needs. A document's virtual finish time is the number of source words up to its
end, over all epochs, divided by the source's target. Every source therefore reaches its target at
virtual time 1, where the total budget is spent: the queue is sorted by finish time and cut there.
What is in service at the cut is taken in part, so each source takes its target to the word.

Running sums are taken in two steps, within buckets of the shuffle order and over bucket totals, so
that no source has to fit in a task.

Defined results: null or empty texts have size 0 and nothing is taken of them; a null source is a
source, last in order; null and repeated ids are ordered by size and text; rows equal in everything
are interchangeable; a source without words has target 0; an empty table gives no rows; other
columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialmart.llm.scratch import saved
from trialmart.llm.words import word_count

# Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
# The budget is this share of all words, and no source is taken more often than this.
BUDGET = 1.5
EPOCHS = 2
# Up to so many sources their table is broadcast; a name takes some 100 bytes.
MAX_BROADCAST_SOURCES = 100_000
_ROWS_PER_BUCKET = 256


def numbered(df: DataFrame, *order: F.Column | str) -> DataFrame:
    """``df`` with its place ``rank`` (from 1) in a total order, without a single sorting task."""
    dealt = saved(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # One row per partition.
    return (
        dealt.withColumn("__place", place)
        .join(F.broadcast(starts), "__part")
        .withColumn("rank", F.col("__start") + F.col("__place"))
        .drop("__part", "__place", "__start")
    )


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    epochs: float = EPOCHS,
) -> DataFrame:
    """``source, source_id, source_size, target`` from ``source, size`` of every document.

    The budget is shared by weight; a target stops at ``epochs`` times its source's size, and the
    excess is shared again by weight until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(totals, F.col("source").isNull(), F.col("source"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    capped = saved(
        ranked.select(
            "source", F.col("rank").alias("source_id"), "source_size", weight.alias("weight"),
            (F.lit(float(epochs)) * F.col("source_size")).alias("cap"),
        )
    )
    everything = capped.agg(F.sum("source_size")).first()[0] or 0
    total = min(budget, epochs) * everything
    share, full = 0.0, -1
    while True:
        at_cap = F.col("cap") <= F.lit(share) * F.col("weight")
        row = capped.agg(
            F.sum(F.when(at_cap, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight"))),
            F.count_if(at_cap),
        ).first()
        if row[2] == full or not row[1]:
            break
        full = row[2]
        share = (total - row[0]) / row[1]
    target = F.least(F.col("cap"), F.lit(share) * F.col("weight"))
    return capped.select("source", "source_id", "source_size", target.alias("target"))


def mix(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    *,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    epochs: int = EPOCHS,
) -> DataFrame:
    """``doc_id, source, text_hash, size, source_size, target, finish, taken`` of every row.

    ``taken`` is the number of words the mix takes of the document, repeats counted; ``finish``
    the virtual finish time of its first copy. The shuffles move ids and sizes only, no texts.
    """
    sized = saved(
        df.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            word_count(F.col(text_column)).alias("size"),
            F.xxhash64(F.col(text_column)).alias("text_hash"),
        )
    )
    sources = saved(source_targets(sized, weights, budget, epochs))
    if sources.count() <= MAX_BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    rows = sized.count()
    bits = min(16, max(6, math.ceil(math.log2(max(rows, 1) / _ROWS_PER_BUCKET + 1))))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bucket = F.conv(F.substring(key, 1, 4), 16, 10).cast("int")
    sized = sized.withColumnRenamed("source", "own_source")
    queued = (
        sized.join(sources, F.col("own_source").eqNullSafe(F.col("source")))
        .drop("own_source")
        .withColumn("key", key)
        .withColumn("bucket", F.shiftright(bucket, 16 - bits))
    )
    group = ["source_id", "bucket"]
    earlier = Window.partitionBy("source_id").orderBy("bucket")
    starts = (
        queued.groupBy(*group)
        .agg(F.sum("size").alias("in_bucket"))
        .select(
            *group,
            F.coalesce(
                F.sum("in_bucket").over(earlier.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("start"),
        )
    )
    inside = Window.partitionBy(*group).orderBy("key", "doc_id", "size", "text_hash")
    running = queued.withColumn(
        "ending", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ).join(starts, group)
    end = F.col("start") + F.col("ending")
    taken = None
    for epoch in range(epochs):
        left = F.floor("target") - (end - F.col("size") + F.lit(epoch) * F.col("source_size"))
        part = F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size")))
        taken = part if taken is None else taken + part
    return running.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        F.try_divide(end.cast("double"), F.col("target")).alias("finish"),
        taken.cast("long").alias("taken"),
    )


def mixed_documents(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    **settings,
) -> DataFrame:
    """The mix as whole documents, globally range-sorted by virtual finish time.

    A document comes as often as the words taken of it come nearest to; texts are not cut. All
    columns are returned as they are. Rows equal in id, source and text share their copies evenly.
    """
    epochs = settings.get("epochs", EPOCHS)
    key = "__mix_key"
    chosen = mix(df, id_column, text_column, source_column, **settings)
    # One hash key for the join: nulls count as values, and rows of an id that differ stay apart.
    chosen = chosen.filter("taken > 0").select(
        F.xxhash64(
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            F.coalesce(F.col("source").cast("string"), F.lit("")),
            F.col("text_hash"),
        ).alias(key),
        F.col("finish"), F.col("source_size"), F.col("target"),
        (F.col("taken") / F.col("size")).alias("times"),
    )
    chosen = chosen.groupBy(key).agg(
        F.min("finish").alias("__mix_finish"),
        F.first(F.col("source_size") / F.col("target")).alias("__mix_epoch"),
        F.round(F.avg("times")).cast("int").alias("__mix_copies"),
    ).filter("__mix_copies > 0")
    keyed = df.withColumn(
        key,
        F.xxhash64(
            F.coalesce(F.col(id_column).cast("string"), F.lit("")),
            F.coalesce(F.col(source_column).cast("string"), F.lit("")),
            F.xxhash64(F.col(text_column)),
        ),
    )
    copies = F.explode(F.sequence(F.lit(0), F.least("__mix_copies", F.lit(epochs)) - 1))
    out = keyed.join(chosen, key).withColumn("__mix_copy", copies)
    finish = F.col("__mix_finish") + F.col("__mix_copy") * F.col("__mix_epoch")
    return (
        out.withColumn("__mix_at", finish)
        .orderBy("__mix_at", key)
        .select(*[F.col(f"`{name}`") for name in df.columns])
    )
