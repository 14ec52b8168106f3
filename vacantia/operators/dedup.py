"""Keyed and greedy de-duplication of postings."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize
from .merge import with_sequence

#: Rows at which the rounds of ``greedy`` end, and the share of the rows that a round has to decide.
REST_ROWS, LEAST_PROGRESS = 1 << 16, 0.1


def last_value(df: DataFrame, key: str | list[str], pos: str) -> DataFrame:
    """One row per key: the last value by ``pos``, at the key's first position (column first_pos)."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("__n", F.row_number().over(w.orderBy(F.col(pos).desc()))).withColumn("first_pos", F.min(pos).over(w))
    return ranked.filter("__n = 1").drop("__n")


def first_value(df: DataFrame, key: str | list[str], pos: str) -> DataFrame:
    """One row per key: the first by ``pos``."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).filter("__n = 1").drop("__n")


def greedy(df: DataFrame, group: str, key: str, url: str, pos: str) -> DataFrame:
    """Rows whose key and whose url are both unseen among the rows kept before, by ``pos`` in each group.

    A rejected row blocks nothing. What a loop over the rows would keep is found in rounds: of the rows
    that are left, those that come first both among the rows of their key and among those of their url
    are kept, as nothing before them can reject them; then all rows that share a key or url with a kept one go.
    Classes are aggregated before they are shuffled, and joins are plain equi-joins, so neither a large
    group nor a common key is one task.

    Rows of one group and pos go by key, url, then their place in the input's files; null keys (urls) equal
    each other. Rows that are left when few remain (REST_ROWS), or when rounds no longer decide many (a
    chain in which each row waits for the one before), are walked through by group, three numbers a row.
    """
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()))
    # classes by number: group and key, group and url; ranks are distinct, so the least row of a class is one row
    named = rows.select("__row", F.col(group).alias("g"), F.col(key).alias("k"), F.col(url).alias("u"), F.col(pos).alias("p"))
    left = materialize(with_sequence(named, "r", ["g", "p", "k", "u", "__row"]).select("__row", "r", "g", "k", "u"))
    n, kept = left.count(), []
    while n > REST_ROWS:
        least = lambda c: left.groupBy("g", c).agg(F.min("r").alias("r")).select("r")
        first = materialize(left.join(least("k").intersect(least("u")), "r", "left_semi"))
        kept.append(first.select("__row"))
        left = materialize(_unlike(_unlike(left, first, ["g", "k"]), first, ["g", "u"]))
        before, n = n, left.count()
        if before - n < before * LEAST_PROGRESS:
            break
    if n:
        kept.append(left.groupBy("g").applyInArrow(_walk, "__row long"))
    found = reduce(DataFrame.unionByName, kept) if kept else left.select("__row")
    return rows.join(found, "__row", "left_semi").drop("__row")


def _unlike(df: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``df`` that equal none of ``other`` in ``columns``; nulls equal each other."""
    named = other.select(*(F.col(c).alias(f"__{c}") for c in columns)).distinct()
    return df.join(named, reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns)), "left_anti")


def _walk(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("r")
    keys, urls, chosen = set(), set(), []
    for row, k, u in zip(rows.column("__row").to_pylist(), rows.column("k").to_pylist(), rows.column("u").to_pylist()):
        if k not in keys and u not in urls:
            keys.add(k)
            urls.add(u)
            chosen.append(row)
    return pa.table({"__row": pa.array(chosen, pa.int64())})
