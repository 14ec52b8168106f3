"""Feed pages by a cursor in place of offsets, with a set of rows that were seen already.

A page of the general feed takes ten of the next fifty rows, so rows stay behind it that later pages owe.
The state of a walk is therefore a cursor, before which every row was shown, and the few rows shown ahead of
it. The first row of a window is always shown, so the cursor moves with every page. Rows that
were seen elsewhere come as a table of ids; where they are dense enough they are sent as bitmaps (exact,
4 KB for 32,768 ids), else they are anti-joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cmp_to_key

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialize
from .feed import ORDERS, PAGE_SIZE, WINDOW, FeedRequest, matching, order_by

#: Bitmaps (of 4 KB) that are broadcast at most.
BITMAPS = 1 << 12


@dataclass
class Walk:
    """Where a walk stands: (sort value, id) of the last row before which all were shown, and those shown behind it."""

    cursor: tuple | None = None
    ahead: list[tuple] = field(default_factory=list)


def _directions(sort: str) -> tuple[str, bool, bool]:
    """Column, whether it ascends (nulls last; else they come first), whether ids do."""
    first, column, tie = ORDERS.get(sort, ORDERS["newest"])
    return column, first is F.asc_nulls_last, tie is F.asc_nulls_last


def after(sort: str, cursor: tuple) -> Column:
    """Rows behind ``cursor`` in the order of ``sort``."""
    name, up, id_up = _directions(sort)
    value, last = cursor
    c, i = F.col(name), F.col("id")
    behind = i > last if id_up else i < last
    if value is None:
        return c.isNull() & behind if up else (c.isNull() & behind) | c.isNotNull()
    further = (c > value) | c.isNull() if up else c < value
    return further | ((c == value) & behind)


def _compare(sort: str):
    name, up, id_up = _directions(sort)

    def compare(a: tuple, b: tuple) -> int:
        (x, i), (y, j) = a, b
        if (x is None) != (y is None):
            return (1 if x is None else -1) * (1 if up else -1)
        if x is not None and x != y:
            return (1 if x > y else -1) * (1 if up else -1)
        return ((i > j) - (i < j)) * (1 if id_up else -1)

    return cmp_to_key(compare)


class Seen:
    """Ids (long, not null) of rows that are not to be shown again."""

    def __init__(self, ids: DataFrame):
        """``ids``: one column id; repeats and nulls do no harm. Aggregated by task before it is shuffled."""
        named = ids.select(F.col("id").cast("long").alias("id")).filter("id IS NOT NULL")
        maps = named.groupBy(F.bitmap_bucket_number("id").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("__bits"))
        kept = materialize(maps.limit(BITMAPS + 1))
        self.bitmaps = kept if kept.count() <= BITMAPS else None
        self.ids = None if self.bitmaps is not None else materialize(named.distinct())

    def drop_from(self, rows: DataFrame) -> DataFrame:
        if self.bitmaps is None:
            return rows.join(self.ids, "id", "left_anti")
        joined = rows.withColumn("__bucket", F.bitmap_bucket_number("id")).join(F.broadcast(self.bitmaps), "__bucket", "left")
        place = F.bitmap_bit_position("id")
        byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2
        return joined.filter(F.coalesce(bit, F.lit(0)) == 0).drop("__bucket", "__bits")


def unseen(jobs: DataFrame, companies: DataFrame | None, r: FeedRequest, seen: Seen | None = None) -> DataFrame:
    """Rows that a walk goes over, in any order: those that the request selects and that were not seen elsewhere.

    Written once (``materialize``) they serve all pages, and all orders of the same request, without another join.
    """
    found = matching(jobs, companies, r)
    return found if seen is None else seen.drop_from(found)


def next_page(jobs: DataFrame, companies: DataFrame | None, r: FeedRequest, walk: Walk, seen: Seen | None = None) -> tuple[list, Walk]:
    """The next rows of a walk (at most PAGE_SIZE, as ``feed.page`` picks them), and where it stands then.

    No rows: the walk is at its end. Ids must not be null.
    """
    return next_rows(unseen(jobs, companies, r, seen), r.sort, walk)


def next_rows(found: DataFrame, sort: str, walk: Walk) -> tuple[list, Walk]:
    """``next_page`` over the rows of ``unseen``."""
    name, *_ = _directions(sort)
    if walk.cursor is not None:
        found = found.filter(after(sort, walk.cursor))
    if walk.ahead:
        found = found.filter(~F.col("id").isin(*[i for _, i in walk.ahead]))
    window = found.orderBy(*order_by(sort)).limit(WINDOW).collect()
    firsts = {}
    for row in window:
        firsts.setdefault(row["company_id"], row["id"])
    shown = [row for row in window if firsts[row["company_id"]] == row["id"]][:PAGE_SIZE]
    shown += [row for row in window if firsts[row["company_id"]] != row["id"]][: PAGE_SIZE - len(shown)]
    taken = {row["id"] for row in shown}
    key = _compare(sort)
    done = sorted([*walk.ahead, *((row[name], row["id"]) for row in shown)], key=key)
    owed = next(((row[name], row["id"]) for row in window if row["id"] not in taken), None)
    before = done if owed is None else [x for x in done if key(x) < key(owed)]
    return shown, Walk(before[-1] if before else walk.cursor, done[len(before) :])
