"""SimHash near-duplicates: fingerprints and a binary trie self-join over them.

Two fingerprints within ``max_bits`` differing bits agree on at least one of ``max_bits + 1``
blocks of bits. For each block a binary trie is built that starts with the block: node pairs are
traversed together from the nodes of equal block downwards, differing bits add up, and a pair is
pruned when they exceed the budget. Tries larger than a task should hold are first traversed as
DataFrames of node pairs, until each pair is small enough.

Defined results:

* a null or empty text has fingerprint 0 and is linked like any other;
* exact and near copies are compared once per distinct fingerprint, whatever their number;
* null ids: the component id is the smallest id that is not null, or null if there is none;
* repeated ids and rows are returned as often as they occur, and an empty table gives no rows;
* other columns are neither read nor returned by ``simhash_components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialmart.llm.scratch import saved
from trialmart.llm.words import lower_words, texts_of

SHINGLE_WORDS = 4
MAX_BITS = 4
# Smallest number of fingerprints from which a trie is split over tasks.
SPLIT_ROWS = 2048
# Bits that a node pair descends by at a time while tries are split.
SPLIT_BITS = 4
# Links from which on components are found by contraction rather than in one task.
FINISH_LINKS = 10_000

_VOTES_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 19
_LEAF_PAIRS = 64
_ROWS_AT_ONCE = 1 << 18


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles (repeats count), as a signed integer."""
    words = lower_words(text)
    if not words:
        return 0
    parts = [words[i:] for i in range(min(shingle_words, len(words)))]
    votes = np.zeros(64, dtype=np.int64)
    count = 0
    block: list[int] = []
    digest = xxhash.xxh64_intdigest
    for shingle in zip(*parts, strict=False):
        block.append(digest(b" ".join(shingle), 42))
        if len(block) == _VOTES_AT_ONCE:
            votes += _bit_counts(block)
            count += len(block)
            block = []
    if block:
        votes += _bit_counts(block)
        count += len(block)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<i8")[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(
    df: DataFrame, id_column: str, text_column: str, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """``doc_id, fp`` for every row."""
    narrow = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = narrow.select("doc_id", F.lit(0).cast("long").alias("fp")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, shingle_words) for text in texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"]
            )

    return narrow.mapInArrow(scan, schema)


# --- the trie join within a task ---------------------------------------------------------------


def _rotated(values: np.ndarray, left: np.ndarray | int) -> np.ndarray:
    left = np.asarray(left, dtype=np.uint64)
    right = (np.uint64(64) - left) & np.uint64(63)
    return (values << left) | (values >> right)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges ``[start, start + size)``."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return np.empty(0, dtype=np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the components of every pair (i, j); labels are smallest members."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            onward = label[label]
            if np.array_equal(onward, label):
                break
            label = onward
    return label


def trie_components(keys: np.ndarray, pairs: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Label per key, equal for keys linked by a chain of differences of ``max_bits`` or fewer.

    keys: unsigned, sorted within each node. pairs: rows ``a_lo, a_hi, b_lo, b_hi, depth, bits``
    of node pairs to traverse; a node is the range of its keys, ``depth`` the number of leading
    bits that are fixed in both, ``bits`` how many of these differ. The pair of a node with
    itself stands for all pairs inside it.
    """
    label = np.arange(len(keys))
    stack = [pairs.astype(np.int64)]
    while stack:
        pairs = stack.pop()
        if len(pairs) > _PAIRS_AT_ONCE:
            stack.append(pairs[_PAIRS_AT_ONCE:])
            pairs = pairs[:_PAIRS_AT_ONCE]
        if len(pairs) * 4 >= len(keys):
            pairs = pairs[~_joined(label, pairs)]
        a_lo, a_hi, b_lo, b_hi, depth, bits = pairs.T
        same = a_lo == b_lo
        # At the bottom keys are equal throughout; near it everything may be within the budget.
        whole = (bits + 64 - depth <= max_bits) & ((a_hi - a_lo) + (b_hi - b_lo) > 0)
        small = ~whole & ((a_hi - a_lo) * (b_hi - b_lo) <= _LEAF_PAIRS)
        label = _link_whole(label, pairs[whole])
        label = _link_leaves(label, keys, pairs[small], max_bits)
        deep = ~whole & ~small
        if not deep.any():
            continue
        a_lo, a_hi, b_lo, b_hi, depth, bits = pairs[deep].T
        same = same[deep]
        a_mid, b_mid = _middle(keys, a_lo, a_hi, depth), _middle(keys, b_lo, b_hi, depth)
        below = depth + 1
        within = bits < max_bits
        # Nodes of equal path first: what they join need not be compared across them.
        children = [
            np.stack([a_lo, a_mid, b_lo, b_mid, below, bits], 1),
            np.stack([a_mid, a_hi, b_mid, b_hi, below, bits], 1),
            np.stack([a_lo, a_mid, b_mid, b_hi, below, bits + 1], 1)[within],
            np.stack([a_mid, a_hi, b_lo, b_mid, below, bits + 1], 1)[within & ~same],
        ]
        child = np.concatenate(children)
        some = (child[:, 0] < child[:, 1]) & (child[:, 2] < child[:, 3])
        alone = (child[:, 0] == child[:, 2]) & (child[:, 1] - child[:, 0] == 1)
        child = child[some & ~alone]
        if len(child):
            stack.append(child)
    return label


def _joined(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which node pairs lie in one component already."""
    changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    a_lo, a_hi, b_lo, b_hi = pairs.T[:4]
    return (
        (changes[a_hi - 1] == changes[a_lo])
        & (changes[b_hi - 1] == changes[b_lo])
        & (label[a_lo] == label[b_lo])
    )


def _link_whole(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    if not len(pairs):
        return label
    a_lo, a_hi, b_lo, b_hi = pairs.T[:4]
    label = _merge(label, a_lo, b_lo)
    for lo, hi in ((a_lo, a_hi), (b_lo, b_hi)):
        inner = _spread(lo, hi - lo - 1)
        label = _merge(label, inner, inner + 1)
    return label


def _link_leaves(
    label: np.ndarray, keys: np.ndarray, pairs: np.ndarray, max_bits: int
) -> np.ndarray:
    if not len(pairs):
        return label
    a_lo, a_hi, b_lo, b_hi = pairs.T[:4]
    a = _spread(a_lo, a_hi - a_lo)
    widths = np.repeat(b_hi - b_lo, a_hi - a_lo)
    b = _spread(np.repeat(b_lo, a_hi - a_lo), widths)
    a = np.repeat(a, widths)
    near = (a != b) & (np.bitwise_count(keys[a] ^ keys[b]) <= max_bits)
    return _merge(label, a[near], b[near])


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First position in each node whose key has bit ``depth`` (from the top) set."""
    bit = np.uint64(1) << (np.uint64(63) - depth.astype(np.uint64))
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        middle = (lo + hi) // 2
        set_ = (keys[np.minimum(middle, len(keys) - 1)] & bit) != 0
        hi = np.where(open_ & set_, middle, hi)
        lo = np.where(open_ & ~set_, middle + 1, lo)


def _task_links(
    batches: Iterator[pa.RecordBatch], lefts: list[int], max_bits: int
) -> Iterator[pa.RecordBatch]:
    """Links that connect what a partition's node pairs connect: chains, so one or two a member.

    Rows come sorted by pair and key. Whole pairs are traversed together, some 100,000 rows of
    them at a time.
    """
    held: list[np.ndarray] = []
    count = 0

    def links(rows: np.ndarray) -> pa.RecordBatch:
        group, table, depth, bits, key = rows
        key = key.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends = np.r_[starts[1:], len(group)]
        # A pair of two nodes has two leading paths; the second starts where the path changes.
        shift = np.uint64(64) - depth.astype(np.uint64)
        path = np.where(depth == 0, np.uint64(0), key >> np.minimum(shift, np.uint64(63)))
        change = np.flatnonzero(np.r_[False, (path[1:] != path[:-1]) & (group[1:] == group[:-1])])
        owner = np.searchsorted(starts, change, side="right") - 1
        middle = np.full(len(starts), -1)
        middle[owner] = change
        two = middle >= 0
        pairs = np.stack(
            [
                starts,
                np.where(two, middle, ends),
                np.where(two, middle, starts),
                ends,
                depth[starts],
                bits[starts],
            ],
            1,
        )
        pairs = pairs[two | (bits[starts] == 0)]
        label = trie_components(key, pairs, max_bits)
        order = np.argsort(label, kind="stable")
        linked = np.flatnonzero(label[order][1:] == label[order][:-1])
        left = np.array(lefts, dtype=np.uint64)[table]
        original = _rotated(key, (np.uint64(64) - left) & np.uint64(63)).view(np.int64)
        u, v = original[order[linked]], original[order[linked + 1]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(
            np.stack([np.asarray(batch.column(i), dtype=np.int64) for i in range(5)])
        )
        count += batch.num_rows
        if count >= _ROWS_AT_ONCE:
            rows = np.concatenate(held, axis=1)
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield links(rows[:, :last])
            held, count = [rows[:, last:]], rows.shape[1] - last
    if count:
        yield links(np.concatenate(held, axis=1))


# --- the trie join over all fingerprints --------------------------------------------------------


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """``max_bits + 1`` blocks of bits covering all 64: rotation to the left, and width."""
    edges = [round(64 * i / (max_bits + 1)) for i in range(max_bits + 2)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def _prefix(key: str, bits: str) -> F.Column:
    return F.expr(f"shiftrightunsigned({key}, int(64 - {bits}))")


def links(fps: DataFrame, max_bits: int = MAX_BITS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``u, v``: links that connect all distinct fingerprints ``max_bits`` or fewer bits apart.

    Not every such pair is returned, but every such pair is connected by those returned. ``fps``
    has one column ``fp`` of distinct signed integers and is read several times.
    """
    if not 0 <= max_bits <= 15:
        raise ValueError("max_bits must be between 0 and 15")
    blocks = _blocks(max_bits)
    lefts = [left for left, _ in blocks]
    tables = [
        F.struct(
            F.lit(table).alias("t"),
            F.lit(width).alias("depth"),
            (F.shiftleft("fp", left).bitwiseOR(F.shiftrightunsigned("fp", 64 - left)) if left
             else F.col("fp")).alias("key"),
        )
        for table, (left, width) in enumerate(blocks)
    ]
    rows = fps.select(F.explode(F.array(*tables)).alias("r")).select("r.*")
    rows = rows.withColumn("path", _prefix("key", "depth"))
    nodes = rows.groupBy("t", "depth", "path").agg(F.count("*").alias("n"))
    # The limit follows the mean, so that the number of larger nodes has a fixed bound:
    # each holds over four times the mean of its block's table.
    total = fps.count()
    limit = max(split_rows, 4 * total >> min(width for _, width in blocks))
    heavy = nodes.filter(F.col("n") > limit)
    heavy = saved(heavy)
    heavy_count = heavy.count()
    numbered = F.shiftleft(F.col("t").cast("long"), 32).bitwiseOR(F.col("path"))
    tasks = rows
    if heavy_count:
        marked = F.broadcast(heavy.select("t", "path", F.lit(True).alias("heavy")))
        rows = rows.join(marked, ["t", "path"], "left")
        tasks = rows.filter("heavy IS NULL")
    tasks = tasks.select(
        numbered.alias("g"), F.col("t"), F.col("depth"), F.lit(0).alias("bits"), F.col("key")
    )
    if heavy_count:
        tasks = tasks.unionByName(_split(rows.filter("heavy"), heavy, limit, max_bits))
    # A group's rows meet in one task; no group exceeds twice the limit.
    dealt = tasks.select(
        F.col("g"), *[F.col(c).cast("long") for c in ("t", "depth", "bits", "key")]
    )
    dealt = dealt.repartition("g").sortWithinPartitions("g", "key")
    found = dealt.mapInArrow(
        lambda batches: _task_links(batches, lefts, max_bits), "u long, v long"
    )
    return found.distinct()


def _split(members: DataFrame, heavy: DataFrame, limit: int, max_bits: int) -> DataFrame:
    """Rows of the node pairs into which heavy tries fall, each row once per pair it is in."""
    members = saved(members.select("t", "key", F.col("depth").alias("top")))
    frontier = heavy.select(
        "t", "depth", F.col("path").alias("a"), F.col("path").alias("b"), F.lit(0).alias("bits")
    )
    done = None
    for _ in range(64 // SPLIT_BITS + 1):
        step = F.least(F.lit(SPLIT_BITS), 64 - F.col("depth"))
        # Nodes a level down, of every trie; tries start at different depths.
        at = frontier.select("t", "depth").distinct().withColumn("below", F.col("depth") + step)
        children = (
            members.join(F.broadcast(at), "t")
            .withColumn("path", _prefix("key", "below"))
            .groupBy("t", "depth", "below", "path")
            .agg(F.count("*").alias("n"))
            .withColumn("parent", F.expr("shiftrightunsigned(path, below - depth)"))
        )
        children = saved(children)
        a = children.select("t", "depth", "below", F.col("parent").alias("a"),
                            F.col("path").alias("a2"), F.col("n").alias("na"))
        b = children.select("t", "depth", F.col("parent").alias("b"),
                            F.col("path").alias("b2"), F.col("n").alias("nb"))
        pairs = (
            frontier.join(a, ["t", "depth", "a"])
            .join(b, ["t", "depth", "b"])
            .withColumn("bits2", F.col("bits") + F.bit_count(
                F.expr("(a2 ^ b2) & (shiftleft(1L, below - depth) - 1)")))
            .filter((F.col("bits2") <= max_bits) & ((F.col("a") != F.col("b"))
                                                    | (F.col("a2") <= F.col("b2"))))
            .select("t", F.col("below").alias("depth"), F.col("a2").alias("a"),
                    F.col("b2").alias("b"), F.col("bits2").alias("bits"), "na", "nb")
        )
        pairs = saved(pairs)
        fits = (F.col("na") + F.col("nb") <= 2 * limit) | (F.col("depth") >= 64)
        ready = pairs.filter(fits).drop("na", "nb")
        done = ready if done is None else done.unionByName(ready)
        frontier = pairs.filter(~fits).drop("na", "nb")
        if frontier.isEmpty():
            break
    # Negative numbers, so that pairs do not meet the groups of whole nodes.
    done = done.withColumn("g", -1 - F.xxhash64("t", "depth", "a", "b").bitwiseAND(2**62 - 1))
    sides = done.select(
        "g", "t", "depth", "bits",
        F.explode(F.array_distinct(F.array("a", "b"))).alias("path"),
    )
    depths = F.broadcast(done.select("t", "depth").distinct())
    return (
        members.join(depths, "t")
        .withColumn("path", _prefix("key", "depth"))
        .join(sides, ["t", "depth", "path"])
        .select("g", "t", "depth", "bits", "key")
    )


# --- components ---------------------------------------------------------------------------------


def connected(edges: DataFrame, finish_links: int = FINISH_LINKS) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``); equal roots if and only if linked.

    Each round every node moves to the neighbour (or itself) of smallest hash, and edges between
    nodes that met disappear. Edges shrink by a factor each round and no table ever holds a row
    per pair of members. The last few, at most ``finish_links``, are joined in one task.
    """
    edges = saved(edges.filter("u <> v"))
    levels = []
    while edges.count() > finish_links:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        turn = F.lit(len(levels))
        least = F.min(F.struct(F.xxhash64("v", turn).alias("h"), F.col("v").alias("v")))
        moves = both.groupBy("u").agg(least.alias("best"))
        moves = saved(
            moves.select(
                "u",
                F.when(F.col("best.h") < F.xxhash64("u", turn), F.col("best.v"))
                .otherwise(F.col("u"))
                .alias("r"),
            )
        )
        levels.append(moves)
        left = edges.join(moves, "u").select(F.col("r").alias("ru"), F.col("v").alias("u"))
        edges = left.join(moves, "u").select(F.col("ru"), F.col("r").alias("rv"))
        edges = saved(
            edges.filter("ru <> rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct()
        )
    roots = edges.coalesce(1).mapInArrow(_finish, "node long, root long")
    for moves in reversed(levels):
        onward = roots.select(F.col("node").alias("r"), "root")
        roots = moves.join(onward, "r", "left").select(
            F.col("u").alias("node"), F.coalesce("root", "r").alias("root")
        )
    return roots


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [np.stack([np.asarray(c) for c in b.columns]) for b in batches if b.num_rows]
    if found:
        ends = np.concatenate(found, axis=1)
        nodes, index = np.unique(ends, return_inverse=True)
        i, j = index.reshape(ends.shape)
        label = _merge(np.arange(len(nodes)), i, j)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array(nodes[label])], ["node", "root"]
        )


def simhash_components(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    *,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    split_rows: int = SPLIT_ROWS,
    finish_links: int = FINISH_LINKS,
) -> DataFrame:
    """``doc_id, fp, root, component_id`` per row; the component id is the smallest id reachable.

    ``root`` is a fingerprint that names the component, also where no row has an id.
    """
    docs = saved(fingerprints(df, id_column, text_column, shingle_words))
    return _with_components(docs, max_bits, split_rows, finish_links)


def _with_components(
    docs: DataFrame, max_bits: int, split_rows: int, finish_links: int
) -> DataFrame:
    least = saved(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = links(least.select("fp"), max_bits, split_rows)
    roots = saved(connected(found, finish_links).withColumnRenamed("node", "fp"))
    members = roots.join(least, "fp")
    of_root = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(of_root, "root").select("fp", "root", "component_id")
    of_fp = least.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id"))
        .alias("component_id"),
        "n",
    )
    # A fingerprint of over 1/1000 of all rows is looked up in place: there are under 1000.
    of_fp = saved(of_fp)
    total = docs.count()
    often = F.col("n") * 1000 > total
    columns = ["doc_id", "fp", "root", "component_id"]
    hot = F.broadcast(of_fp.filter(often).drop("n"))
    common = docs.join(hot, "fp").select(*columns)
    rest = docs.join(hot, "fp", "left_anti").join(of_fp.filter(~often).drop("n"), "fp")
    return rest.select(*columns).unionByName(common)


def fingerprint_text(fp: F.Column) -> F.Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    *,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row of each component, whole: that of the smallest id.

    Rows without an id come last, ties are settled by fingerprint and then by a hash of all
    values, so reruns keep the same row. All columns are returned as they are.
    """
    prints = saved(fingerprints(df, id_column, text_column, shingle_words))
    found = _with_components(prints, max_bits, SPLIT_ROWS, FINISH_LINKS)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("fp"))
    keep = found.groupBy("root").agg(F.min(rank).alias("k")).select("k.doc_id", "k.fp")
    times = prints.groupBy("doc_id").agg(F.count("*").alias("times"))
    key, fp, kept_id, kept_fp = "__simhash_id", "__simhash_fp", "__kept_id", "__kept_fp"
    keep = saved(
        keep.join(times, keep["doc_id"].eqNullSafe(times["doc_id"]))
        .select(keep["doc_id"].alias(kept_id), keep["fp"].alias(kept_fp), "times")
    )
    rows = df.withColumn(key, F.col(id_column))
    # The ids kept grow with the documents: joined by shuffling at every size.
    once = keep.filter("times = 1 AND __kept_id IS NOT NULL").select(kept_id).hint("merge")
    result = rows.join(once, F.col(key) == F.col(kept_id), "left_semi").drop(key)
    several = keep.filter("times > 1 OR __kept_id IS NULL").drop("times")
    if several.isEmpty():
        return result
    # Rows of a repeated id differ by fingerprint, or by a hash where even that is the same.
    again = F.pandas_udf(
        lambda texts: texts.map(lambda text: fingerprint(text, shingle_words)), "long"
    )
    ids = several.select(kept_id).distinct()
    candidates = rows.join(ids, F.col(key).eqNullSafe(F.col(kept_id)), "left_semi")
    candidates = candidates.withColumn(fp, again(F.col(text_column)))
    names = df.columns
    packed = candidates.select(key, fp, F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    packed = packed.join(
        several,
        packed[key].eqNullSafe(several[kept_id]) & (packed[fp] == several[kept_fp]),
        "left_semi",
    )
    one = packed.groupBy(key, fp).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return result.unionByName(one.select("row.*"))
