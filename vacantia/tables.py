"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table that is broadcast at most.
SMALL_ROWS = 1 << 16
#: Spark's setting that removes an execution's shuffle files at its end; it counts for what is planned while it is set.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session is local (tests) a temporary folder is made and kept for the
    session; on a cluster an unset folder is an error, as executors could not see it.
    """
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the frames that are made and run within go when each run ends.

    Otherwise they stay until the driver's garbage collector meets their plan, so a few large shuffles may lie on the
    disk at once. Only for frames that are run once: a second run of the same frame would compute its shuffles anew.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the cluster's shared folder, and read it there.

    Unlike a checkpoint this computes ``df`` once, and the table's size is known to later joins. What was shuffled for
    it is removed. The application's tables are removed when its driver ends, or by ``drop_table``.
    """
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[kept] = path
    return kept


def drop_table(kept: DataFrame) -> None:
    """Remove a table of ``materialize`` that nothing reads any more."""
    _remove(kept.sparkSession, _written.pop(kept))


def lookup(df: DataFrame) -> DataFrame:
    """``df`` as the smaller side of an inner join: written and counted, broadcast up to SMALL_ROWS rows, else merged.

    Left to estimates Spark may broadcast the other side: it takes rows that were exploded for no more bytes than before,
    and a table made by the driver for the largest of all.
    """
    kept = materialize(df)
    return F.broadcast(kept) if kept.count() <= SMALL_ROWS else kept.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over ``spark.sql.shuffle.partitions`` tasks, before work that is long or large a row.

    A narrow table is read by very few tasks. As the number is given, tasks are not joined again by the bytes they read.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch(spark: SparkSession) -> str:
    """The application's folder for intermediate tables in the shared folder, removed when its driver ends."""
    home = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_remove, spark, home)
    return home


_homes: set[str] = set()
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
