"""Extras: scheduled micro-batches as Structured Streaming (the batch operators, run per increment)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..operators.bucketed import BucketedTable, latest_of_batch


def stream_of(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A file stream with the schema of the files there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events by window and type, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def dedup_deliveries(events: DataFrame, key: str = "event_id", within: str = "1 hour") -> DataFrame:
    """Redelivered events of a push source count once."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def upsert_batches(stream: DataFrame, target_path: str, keys: list[str], checkpoint: str, order: str | None = None):
    """Writer that merges every micro-batch into versioned snapshots under ``target_path``.

    Version n is written from version n-1, so a batch that is retried writes the same version again: of the
    rows of one key the latest by ``order`` stays, ties (and all, without an order) by the rows' text.
    """

    def apply(batch: DataFrame, n: int) -> None:
        latest = latest_of_batch(batch, keys, order)
        out = latest if n == 0 else merge.upsert(batch.sparkSession.read.parquet(f"{target_path}/v={n - 1}"), latest, keys)
        out.write.mode("overwrite").parquet(f"{target_path}/v={n}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def upsert_buckets(stream: DataFrame, table: BucketedTable, checkpoint: str, order: str | None = None):
    """Writer that merges every micro-batch into a bucketed table: only the buckets of its keys are read and written.

    Batch n makes version n; a batch that comes again after a restart finds its version there.
    """
    return stream.writeStream.foreachBatch(lambda batch, n: table.upsert(latest_of_batch(batch, table.keys, order), n) and None).option("checkpointLocation", checkpoint)


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append the rows of a stream over all that is there as files, exactly once, and go on from ``checkpoint`` the next time.

    State is kept in RocksDB, so that it is no part of the executors' heap (and timers need it); set for the start of this query alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        started = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
        started.awaitTermination()
    finally:
        conf.set(name, before)


def _run_to_memory(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and give its result table, which the driver holds: for a few aggregated rows alone."""
    name = f"t_{abs(hash(tempfile.mktemp())) % 10**12}"
    started = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    started.awaitTermination()
    return df.sparkSession.table(name)


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run_to_memory(tumbling_counts(_events(spark, sf_dir)), "complete")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a file source takes a folder or a pattern
    raw = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def queries() -> dict:
    return {"stream_daily_counts": stream_daily_counts}
