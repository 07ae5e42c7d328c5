"""A Bloom filter of the cohort, to leave out other users' rows before their payloads are read.

Where a cohort is too large to be broadcast, its join shuffles the facts, which have to be typed first
so that no raw payload moves. The filter is tested on the user alone, right above the scan: what
it rejects is neither parsed nor shuffled. It never rejects a member, and the join that follows
removes the few others it lets through.

Each user sets ``PROBES`` bits within one 64-bit word. Words are combined by aggregation and gathered
into one row of at most ``MAX_WORDS`` words, which reaches the scan as a scalar subquery. Up to
33 million users have 16 bits each and one other user in about 150 passes; with more users it is
more, one in five at 130 million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmart.session import stored

WORD_BITS = 64
BITS_PER_USER = 16
PROBES = 4
# 64 MB on the driver and in every executor, whatever the cohort.
MAX_WORDS = 1 << 23
# Words of one inner array of the row.
BLOCK_WORDS = 1 << 12


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words).cast("long"))


def _mask(key: Column) -> Column:
    """The bits of a user, from a hash of its own."""
    bits = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for probe in range(PROBES):
        place = F.shiftrightunsigned(bits, 6 * probe).bitwiseAND(F.lit(WORD_BITS - 1))
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")))
    return mask


def filter_words(users: int, max_words: int = MAX_WORDS) -> int:
    """Number of words for so many users: whole blocks, or a power of two below one."""
    wanted = max(1, min(max_words, -(-users * BITS_PER_USER // WORD_BITS)))
    if wanted <= BLOCK_WORDS:
        return 1 << (wanted - 1).bit_length()
    return -(-wanted // BLOCK_WORDS) * BLOCK_WORDS


def member_filter(users: DataFrame, key: str, words: int) -> DataFrame:
    """One row with ``words``: an array of blocks of words."""
    members = users.filter(F.col(key).isNotNull()).select(
        _word(F.col(key), words).alias("word"), _mask(F.col(key)).alias("mask")
    )
    # So that no word is missing from its block.
    unset = users.sparkSession.range(words).select(
        F.col("id").alias("word"), F.lit(0).cast("long").alias("mask")
    )
    set_words = members.unionByName(unset).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    place, block = F.col("word") % BLOCK_WORDS, F.floor(F.col("word") / BLOCK_WORDS)
    blocks = set_words.groupBy(block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct(place.alias("place"), "mask"))).alias("masks")
    )
    rows = F.sort_array(F.collect_list(F.struct("block", F.col("masks.mask").alias("masks"))))
    return blocks.agg(rows.alias("blocks")).select(F.col("blocks.masks").alias("words"))


def possible_members(
    facts: DataFrame, users: DataFrame, key: str = "event_user", max_words: int = MAX_WORDS
) -> DataFrame:
    """The facts but for most of those whose user is not among the users.

    Hashes only agree on equal types; with different ones all facts stay, for the join to cast.
    """
    if facts.schema[key].dataType != users.schema[key].dataType:
        return facts
    words = filter_words(users.count(), max_words)
    # Stored, since every action on the facts reads it.
    row = stored(member_filter(users, key, words)).scalar()
    word = _word(F.col(key), words)
    block = F.get(row, F.floor(word / BLOCK_WORDS).cast("int"))
    found = F.get(block, (word % BLOCK_WORDS).cast("int"))
    mask = _mask(F.col(key))
    return facts.filter(found.bitwiseAND(mask) == mask)
