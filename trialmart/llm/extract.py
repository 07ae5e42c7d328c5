"""Main text of HTML pages by differencing each page with the pages of nearest URL.

Elements that HTML itself or a page's own class names set apart (menus, page headers and footers,
asides, adverts, forms, scripts, comments) are left out when a page is cut into lines. What else a site
repeats shows by comparison: pages are sorted by host and path, each is paired with the pages next to it
within its host, and the lines of a pair are aligned by their longest common subsequence. Aligned
lines outside the page's main element are deleted, and a container goes whole if half of its lines
and no less than two are aligned. Within the main element only such containers go, and only if they
hold less than half of its text: articles quote each other. A neighbour that has nearly all of the
page's lines, and hardly others, is a copy and says nothing; the next one is asked instead.

Pages are compared by hashes of their lines. These are sorted over all tasks, numbered in that order, and
compared in blocks of ``BLOCK_PAGES`` neighbours with the ``REACH`` pages around; so a host may hold any
number of pages, and the result does not depend on how they were dealt to tasks. Equal pages (URL and
HTML) are compared once.

Defined results:

* a null or empty page, and one whose lines all go, has an empty text;
* a null URL and one without host belong to no host: only what is set apart by markup goes;
* repeated ids and rows are returned as often as they occur, and an empty table gives no rows;
* pages of any length are read whole; tags that the end of the page cuts off are dropped;
* the result has the columns ``id`` and ``url`` under their own names and ``text``; others are not
  read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmart.llm.markup import APART, MAIN_LINE, Line, page_lines
from trialmart.llm.scratch import placed, saved
from trialmart.llm.urls import host_of, path_of

# Neighbours asked on either side, and how far to look for those that are no copies.
PARTNERS = 2
REACH = 6
# Share of either page's text that makes a pair copies of each other.
COPY_SHARE = 0.9
BLOCK_PAGES = 512
# Deleted lines are broadcast up to this size, beyond that joined by shuffling.
MAX_BROADCAST_BYTES = 64 << 20
# Parts that the pages of one URL and HTML are dealt to in that join.
SALTS = 16
# Largest alignment table in bits that is kept whole.
_TABLE_BITS = 1 << 26


# --- alignment ------------------------------------------------------------------------------------


def _rows(a: Sequence[int], b: Sequence[int]) -> Iterator[int]:
    """For every prefix of ``a`` the prefixes of ``b`` where its LCS grows, as unset bits."""
    places: dict[int, int] = {}
    for j, value in enumerate(b):
        places[value] = places.get(value, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for value in a:
        match = row & places.get(value, 0)
        row = ((row + match) | (row - match)) & full
        yield row


def _lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """LCS length of ``a`` with every prefix of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    raw = np.frombuffer(row.to_bytes((len(b) + 7) // 8, "little"), dtype=np.uint8)
    grows = np.unpackbits(raw, bitorder="little")[: len(b)] == 0
    return np.concatenate([[0], np.cumsum(grows)])


def aligned(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Indexes of ``a`` that a longest common subsequence with ``b`` takes, in order."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [*range(lead)], [*range(len(a) - tail, len(a))]
    inner, other = a[lead : len(a) - tail], b[lead : len(b) - tail]
    # Lines that the other page lacks are in no common subsequence.
    known = set(other)
    spots = [i for i, value in enumerate(inner) if value in known]
    known = {inner[i] for i in spots}
    other = [value for value in other if value in known]
    found = _aligned([inner[i] for i in spots], other)
    return [*ends[0], *(lead + spots[i] for i in found), *ends[1]]


def _aligned(a: Sequence[int], b: Sequence[int]) -> list[int]:
    if not len(a) or not len(b):
        return []
    if len(a) * len(b) <= _TABLE_BITS or len(a) == 1:
        rows = list(_rows(a, b))
        i, j, found = len(a), len(b), []
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            # The growth belongs to the first row that shows it.
            if not i or rows[i - 1] >> (j - 1) & 1:
                found.append(i)
                j -= 1
        return found[::-1]
    # Too large a table: find where the halves of ``a`` meet, and align each by itself.
    half = len(a) // 2
    total = _lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]
    cut = int(total.argmax())
    return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]


# --- one page and its neighbours -------------------------------------------------------------------


class _Page:
    """What is compared of a page: hash, length, container and depth of each line."""

    def __init__(self, hashes, sizes, containers, depths):
        self.hashes: list[int] = hashes
        self.sizes = np.array(sizes, dtype=np.int64)
        self.containers = np.array(containers, dtype=np.int64)
        self.depths = np.array(depths, dtype=np.int64)
        self.total = int(self.sizes.sum())


def _shared(page: _Page, partner: _Page) -> np.ndarray | None:
    """Which lines of a page its partner shares; None if they are copies of each other."""
    mask = np.zeros(len(page.hashes), dtype=bool)
    mask[aligned(page.hashes, partner.hashes)] = True
    common = int(page.sizes[mask].sum())
    if common and common >= COPY_SHARE * max(page.total, partner.total):
        return None
    return mask


def deleted_lines(page: _Page, before: Sequence[_Page], after: Sequence[_Page]) -> list[int]:
    """Indexes of lines to delete, given the neighbours on either side, nearest first."""
    shared = np.zeros(len(page.hashes), dtype=bool)
    for side in (before, after):
        asked = 0
        for partner in side:
            mask = _shared(page, partner)
            if mask is not None:
                shared |= mask
                asked += 1
            if asked == PARTNERS:
                break
    if not shared.any():
        return []
    gone = shared & (page.depths == APART)
    main_text = int(page.sizes[page.depths != APART].sum())
    for container in np.unique(page.containers[shared]):
        held = page.containers == container
        depth = int(page.depths[held][0])
        common = int((held & shared).sum())
        text = main_text if depth else page.total
        small = 2 * int(page.sizes[held].sum()) < text
        if depth != MAIN_LINE and small and common >= 2 and 2 * common >= int(held.sum()):
            gone |= held
    return np.flatnonzero(gone).tolist()


# --- all pages --------------------------------------------------------------------------------------

_LINES = "hashes array<bigint>, sizes array<int>, containers array<int>, depths array<int>"


def _page_keys(url: F.Column, html: F.Column) -> list[F.Column]:
    return [F.xxhash64(url, html).alias("k1"), F.xxhash64(html, url).alias("k2")]


def _described(pages: DataFrame) -> DataFrame:
    """``k1, k2, host, path`` and the lines' hashes of every page that has a host and lines."""
    narrow = pages.select(
        *_page_keys(F.col("url"), F.col("html")),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        "html",
    ).filter("host <> '' AND html <> ''")
    schema = T.StructType(narrow.schema.fields[:4] + T.StructType.fromDDL(_LINES).fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for html in batch.column(4):
                lines = page_lines(html.as_py())
                columns[0].append([xxhash.xxh64_intdigest(x.text) - (1 << 63) for x in lines])
                columns[1].append([len(x.text) for x in lines])
                columns[2].append([x.container for x in lines])
                columns[3].append([x.depth for x in lines])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(4)),
                    pa.array(columns[0], pa.list_(pa.int64())),
                    *(pa.array(column, pa.list_(pa.int32())) for column in columns[1:]),
                ],
                schema.fieldNames(),
            )

    return narrow.mapInArrow(scan, schema).filter("size(hashes) > 0")


def _numbered(described: DataFrame) -> DataFrame:
    """The distinct pages with their number ``place`` in the order of host, path and key."""
    order = ["host", "path", "k1", "k2"]
    ordered = described.dropDuplicates(["k1", "k2"]).repartitionByRange(*order)
    stored = saved(ordered.sortWithinPartitions(*order))
    return placed(stored)


def _compared(table: pa.Table, block: int, block_pages: int) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda row: row["place"])
    found: dict[str, list] = {"k1": [], "k2": [], "deleted": []}
    for _, group in groupby(rows, key=lambda row: row["host"]):
        site = list(group)
        pages = [
            _Page(row["hashes"], row["sizes"], row["containers"], row["depths"]) for row in site
        ]
        for i, row in enumerate(site):
            if row["place"] // block_pages != block:
                continue
            before = pages[max(0, i - REACH) : i][::-1]
            lines = deleted_lines(pages[i], before, pages[i + 1 : i + 1 + REACH])
            if lines:
                found["k1"].append(row["k1"])
                found["k2"].append(row["k2"])
                found["deleted"].append(lines)
    return pa.table(found, schema=pa.schema(
        [("k1", pa.int64()), ("k2", pa.int64()), ("deleted", pa.list_(pa.int32()))]
    ))


def repeated_lines(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """``k1, k2, deleted``: line numbers to delete, for the pages that have any.

    pages: ``url`` and ``html``.
    """
    numbered = _numbered(_described(pages))
    first, last = ((F.col("place") + by) / block_pages for by in (-REACH, REACH))
    blocks = F.sequence(F.greatest(F.floor(first), F.lit(0)), F.floor(last))
    dealt = numbered.drop("path").withColumn("block", F.explode(blocks))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        return _compared(table, key[0].as_py(), block_pages)

    return dealt.groupBy("block").applyInArrow(
        compare, "k1 bigint, k2 bigint, deleted array<int>"
    )


def _kept_text(html: str | None, deleted: list[int] | None) -> str:
    lines: list[Line] = page_lines(html)
    gone = set(deleted or ())
    return "\n".join(line.text for i, line in enumerate(lines) if i not in gone)


def main_texts(
    df: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    block_pages: int = BLOCK_PAGES,
) -> DataFrame:
    """The id, the URL and the main ``text`` of every page."""
    pages = df.select(
        F.struct(F.col(id_column), F.col(url_column)).alias("row"),
        F.col(url_column).alias("url"),
        F.col(html_column).alias("html"),
    )
    deleted = saved(repeated_lines(pages.select("url", "html"), block_pages))
    size = deleted.agg(F.sum(F.size("deleted") * 4 + 100)).first()[0] or 0
    keyed = pages.select("row", "html", *_page_keys(F.col("url"), F.col("html")))
    if size <= max_broadcast_bytes:
        joined = keyed.join(F.broadcast(deleted), ["k1", "k2"], "left")
    else:
        # A page may be repeated any number of times: its rows are dealt to several tasks.
        salts = F.array(*(F.lit(salt).cast("long") for salt in range(SALTS)))
        salted = deleted.withColumn("salt", F.explode(salts))
        joined = keyed.withColumn("salt", F.monotonically_increasing_id() % SALTS).join(
            salted.hint("merge"), ["k1", "k2", "salt"], "left"
        )
    schema = T.StructType([T.StructField("row", pages.schema["row"].dataType),
                           T.StructField("text", T.StringType(), False)])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                _kept_text(html.as_py(), lines.as_py())
                for html, lines in zip(batch.column(1), batch.column(2), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["row", "text"]
            )

    found = joined.select("row", "html", "deleted").mapInArrow(extract, schema)
    return found.select("row.*", "text")
