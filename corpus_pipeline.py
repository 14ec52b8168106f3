"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns
of ``documents``. ``run`` applies them to the documents of ``sf_dir`` through the shared folder. The first stage sets
the session's Arrow batches to a small size for all of them, as stages share the executors' memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import exact_dedup, jaccard, mixing, pieces, toxicity
from vacantia.llm.common import keep_rows, scratch, small_batches, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic (score under 0.7)."""
    small_batches(spark)
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, machine, "__score").filter(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the most code points, then the smallest doc_id."""
    return keep_rows(docs, exact_dedup.copies(docs)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id."""
    return keep_rows(docs, jaccard.copies(docs)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum's training order: a row for each take of a document."""
    return mixing.mixture(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, ids and position of each row; position grows in the training order of the stage before."""
    placed = docs.withColumn("position", mixing.written_position(docs))
    return pieces.with_ids(placed).select("doc_id", "source", F.size("ids").alias("n_pieces"), "ids", "position")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]

#: No SQL: the first stage learns a model. tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{out}/{k}")
            docs = spark.read.parquet(f"{out}/{k}")
    return docs
