"""A keyed table in buckets: an upsert reads and rewrites only the buckets that its batch touches.

Layout under one folder that driver and executors share::

    data/v=7/bucket=3/part-*.parquet   rows of bucket 3 as written by version 7
    log/v=7/                           for each bucket that is not empty the version that wrote it (one small file)

A version exists once its log is whole, so readers see the old table or the new one, and a writer that
dies leaves files that nothing names. A bucket is the hash partition of its keys: both sides of the merge
are dealt by key to as many tasks as there are buckets, so a task writes one file of one bucket and there is no
further shuffle. Choose the number of buckets so that one fits a task; keys are unique, so none is hot.
One writer at a time.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import merge


def latest_of_batch(batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row a key: the latest by ``order``, ties (and all, without an order) by the rows' text."""
    rest = [c for c in batch.columns if c not in keys]
    version = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct(*rest)).alias("text"))
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*").select(*batch.columns)


class BucketedTable:
    """Rows of ``schema`` with unique ``keys`` (none null) in ``buckets`` buckets; both are fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    # ------------------------------------------------------------ versions

    def _folders(self, name: str) -> tuple[object, list[tuple[int, object]]]:
        """The file system, and number and path of each version's folder there."""
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        home = jvm(f"{self.path}/{name}")
        fs = home.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.listStatus(home) if fs.exists(home) else []
        return fs, sorted((int(s.getPath().getName()[2:]), s.getPath()) for s in found if s.getPath().getName().startswith("v="))

    def versions(self) -> list[int]:
        fs, found = self._folders("log")
        return [v for v, path in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))]

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket to the version that wrote it; at most one entry a bucket."""
        known = self.versions()
        version = (known[-1] if known else None) if version is None else version
        if version is None:
            return {}
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version long").json(f"{self.path}/log/v={version}").collect()}

    # ------------------------------------------------------------ reading

    def bucket(self) -> Column:
        """The number of the hash partition to which Spark deals a row."""
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """Rows of a version (default: the last); ``only``: of these buckets."""
        files = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(self.manifest(version).items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows whose keys are among ``wanted``; other buckets than theirs are not opened."""
        keys = wanted.select(*self.keys).distinct()
        touched = {r.b for r in keys.select(self.bucket().alias("b")).distinct().collect()}
        return self.read(only=touched).join(keys, self.keys, "left_semi")

    # ------------------------------------------------------------ writing

    def _commit(self, rows: DataFrame, touched: set[int], version: int) -> int:
        data = f"{self.path}/data/v={version}"
        rows.select(*self.schema.names).withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(data)
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        home = jvm(data)
        fs = home.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        written = {int(s.getPath().getName()[7:]) for s in fs.listStatus(home) if s.getPath().getName().startswith("bucket=")}
        kept = {b: v for b, v in self.manifest().items() if b not in touched} | {b: version for b in written}
        log = self.spark.createDataFrame(sorted(kept.items()), "bucket int, version long")
        log.coalesce(1).write.mode("overwrite").json(f"{self.path}/log/v={version}")
        return version

    def _begin(self, version: int | None) -> int | None:
        """The version to write; None where it is there already (a batch that is sent again)."""
        known = self.versions()
        if version is None:
            return known[-1] + 1 if known else 0
        return None if version in known else version

    def _touched(self, batch: DataFrame) -> set[int]:
        complete = reduce(and_, (F.col(k).isNotNull() for k in self.keys))
        checked = batch.select(F.when(complete, self.bucket()).otherwise(F.raise_error(F.lit("a key is null")).cast("int")).alias("b"))
        return {r.b for r in checked.distinct().collect()}

    def upsert(self, batch: DataFrame, version: int | None = None, update: list[str] | None = None, insert: list[str] | None = None) -> int | None:
        """Insert or overwrite rows by key (``merge.upsert``); the new version's number, None if ``version`` was there.

        Keys of the batch must be unique; a null key is an error. An empty batch makes a version that names the same files.
        """
        number = self._begin(version)
        if number is None:
            return None
        touched = self._touched(batch)
        dealt = lambda df: df.repartition(self.buckets, *self.keys)
        return self._commit(merge.upsert(dealt(self.read(only=touched)), dealt(batch), self.keys, update, insert), touched, number)

    def delete(self, keys: DataFrame, version: int | None = None) -> int | None:
        """Rows of these keys go; a bucket that is empty then is no longer named."""
        number = self._begin(version)
        if number is None:
            return None
        gone = keys.select(*self.keys).na.drop().distinct()
        touched = self._touched(gone)
        dealt = lambda df: df.repartition(self.buckets, *self.keys)
        return self._commit(dealt(self.read(only=touched)).join(dealt(gone), self.keys, "left_anti"), touched, number)

    def vacuum(self, keep: int = 2) -> int:
        """Drop what only versions before the last ``keep`` name; the number of data folders removed."""
        known = self.versions()[-keep:]
        named = {(b, v) for n in known for b, v in self.manifest(n).items()}
        fs, logs = self._folders("log")
        for v, path in logs:
            if known and v < known[0]:
                fs.delete(path, True)
        removed = 0
        for v, path in self._folders("data")[1]:
            for s in fs.listStatus(path):
                name = s.getPath().getName()
                if known and v <= known[-1] and name.startswith("bucket=") and (int(name[7:]), v) not in named:
                    removed += bool(fs.delete(s.getPath(), True))
        return removed
