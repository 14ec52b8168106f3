"""Counts by group, kept up to date by what a sync adds and removes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bucketed import BucketedTable


def changes(before: DataFrame, after: DataFrame, key: str, ref: str) -> DataFrame:
    """ref and delta (not 0) of every group whose number of rows differs: rows are told apart by ``key``.

    A row that moves to another group counts there and no longer here; rows that stay are dropped before
    anything is grouped. Null groups are left out, as no company has them.
    """
    old, new = before.select(F.col(key).alias("__k"), F.col(ref).alias("__old")), after.select(F.col(key).alias("__k"), F.col(ref).alias("__new"))
    moved = old.join(new, "__k", "full").filter(~F.col("__old").eqNullSafe(F.col("__new")))
    steps = F.explode(F.array(F.struct(F.col("__old").alias("ref"), F.lit(-1).alias("d")), F.struct(F.col("__new").alias("ref"), F.lit(1).alias("d"))))
    deltas = moved.select(steps.alias("s")).filter("s.ref IS NOT NULL").groupBy(F.col("s.ref").alias(ref)).agg(F.sum("s.d").alias("delta"))
    return deltas.filter("delta <> 0")


def apply(table: BucketedTable, deltas: DataFrame, ref: str, name: str = "active_jobs_count", version: int | None = None) -> int | None:
    """Add ``deltas`` (ref, delta) to the counts in ``table`` (ref, name): only their buckets are read and written.

    A count that would fall below zero is an error, since then the table and its changes are not of one history.
    """
    held = table.lookup(deltas)
    n = F.coalesce(name, F.lit(0).cast("long")) + F.col("delta")
    checked = F.when(n >= 0, n).otherwise(F.raise_error(F.lit("a count would be negative")).cast("long"))
    return table.upsert(deltas.join(held, ref, "left").select(ref, checked.alias(name)), version)
