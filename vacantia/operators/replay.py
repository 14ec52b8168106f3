"""Replay of a probe log: the failure counter after every event, for whole logs at once.

The counter of a source is a scan over its events that restarts after each success and after a long
silence. A source may hold any share of the log, so it is no window over a source: events are range-sorted by
source and time, each range is scanned by itself, and the ranges of one source are chained by a second scan
over one row a source and range. Only the first source of a range takes something over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize
from .sync import FAILURE_LIMIT

SILENCE_HOURS = 48


def status_of(count: Column, known: Column) -> Column:
    """ok after a success, dead below FAILURE_LIMIT failures in a row, then a manual review; null before any verdict."""
    failing = F.when(count >= FAILURE_LIMIT, "needs_manual_review").when(count > 0, "dead")
    return F.coalesce(failing, F.when(known, "ok"))


def _silent(ts: Column, before: Column, hours: int) -> Column:
    return F.coalesce(ts >= before + F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))


def replay(log: DataFrame, source: str = "source_id", ts: str = "ts", event: str = "event_id", failed: str = "failed", hours: int = SILENCE_HOURS) -> DataFrame:
    """``log`` with ats_failure_count and ats_status after each event.

    Events of a source go by ``ts``, then ``event``; nulls first. A null verdict changes neither count nor status,
    but ends a silence. After ``hours`` without an event a source starts anew. The null source is a source
    of its own; rows equal in source, time and event may go in either order.
    """
    order = [F.asc_nulls_first(c) for c in (source, ts, event)]
    ranged = materialize(log.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    here = Window.partitionBy("__range", source).orderBy(*order[1:])
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    quiet = _silent(F.col(ts), F.lag(ts).over(here), hours)
    success = F.coalesce(~F.col(failed), F.lit(False))
    steps = ranged.withColumn("__row", F.row_number().over(here)).withColumn("__quiet", quiet).withColumn("__reset", success | F.col("__quiet")).withColumn("__add", F.coalesce(F.col(failed), F.lit(False)).cast("long"))
    steps = steps.withColumn("__run", F.count_if("__reset").over(upto))
    # known: a verdict since the run began; a success begins its run with one
    within = Window.partitionBy("__range", source, "__run").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    local = steps.withColumn("__count", F.sum("__add").over(within)).withColumn("__known", F.max(F.col(failed).isNotNull()).over(within))
    local = materialize(local.drop("__quiet", "__reset", "__add"))

    ends = local.groupBy("__range", source).agg(
        F.max("__run").alias("runs"), F.min(ts).alias("begin"), F.max(ts).alias("end"), F.max_by(F.struct("__count", "__known"), F.struct("__run", "__row")).alias("tail"),
    )
    chain = Window.partitionBy(source).orderBy("__range")
    linked = ends.withColumn("gap", _silent(F.col("begin"), F.lag("end").over(chain), hours)).withColumn("piece", F.count_if((F.col("runs") > 0) | F.col("gap")).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    piece = Window.partitionBy(source, "piece").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    out = linked.withColumn("count", F.sum("tail.__count").over(piece)).withColumn("known", F.max("tail.__known").over(piece))
    before = out.withColumn("__carry", F.lag("count").over(chain)).withColumn("__was", F.lag("known").over(chain)).filter("NOT gap AND (__carry > 0 OR __was)")
    carried = before.select(F.col("__range").alias("__at"), F.col(source).alias("__of"), "__carry", "__was")  # at most a row a range

    joined = local.join(F.broadcast(carried), (F.col("__range") == F.col("__at")) & F.col(source).eqNullSafe(F.col("__of")) & (F.col("__run") == 0), "left")
    count = F.col("__count") + F.coalesce("__carry", F.lit(0))
    known = F.col("__known") | F.coalesce("__was", F.lit(False))
    return joined.select(*log.columns, count.alias("ats_failure_count"), status_of(count, known).alias("ats_status"))
