"""How five text filters interact: what each removes, alone and after the others, in every order.

A document's failures are a mask of five bits, A to E from the lowest. The first four depend on the
text alone; the fifth (a copy of a smaller id's text) takes the least id of each text, found by
grouping SHA-256 digests, so no text is shuffled. Documents then fall into at most 32 cells a part
of the corpus, and everything that the 120 orders of the filters ask for is a sum over cells: a
filter removes the documents whose mask has its bit and none of an earlier filter's.

Defined results: a null text counts as empty; a null or empty ``lang`` is the part ''; a row without id
is never a copy and never the first of one, nor has it labels; rows that share the least id are
no copies of each other; an id with several labels is good (toxic) if one of them says so; an empty
table gives no rows. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent of the words
MAX_CAPITALS = 3  # per cent of the code points
SYMBOLS = r"[#$%&*|]"


def _bits(conditions: list[Column]) -> Column:
    """Bit k is set where condition k holds."""
    total = F.lit(0)
    for k, condition in enumerate(conditions):
        total = total + F.when(condition, F.lit(1 << k)).otherwise(F.lit(0))
    return total


def masks(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, mask (int, 0 to 31: bit 0 is filter A)."""
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    read = texts.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("chars"),
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("capitals"), F.col("text").rlike(SYMBOLS).alias("symbols"),
    )
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    alone = _bits([n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * F.col("capitals").cast("long") > MAX_CAPITALS * F.col("chars").cast("long"), F.col("symbols")])
    rows = materialize(read.select("doc_id", "part", "digest", alone.alias("alone")))
    # only texts of several ids are joined back: their number is known by then, so a small table is broadcast
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return rows.join(materialize(least.select("digest", "least")), "digest", "left").select("doc_id", "part", (F.col("alone") + F.when(copy, 16).otherwise(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part and mask that occurs: n documents, good (quality 1) and toxic ones."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(one("quality"), one("toxic"))
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    joined = masks(docs).join(known, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def steps(spark: SparkSession) -> DataFrame:
    """Every order, step and mask (120 x 5 x 32 rows): filter_order, step, mask, bit of the step's filter, bits of the earlier ones."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, 1 << k, before))
            before |= 1 << k
    known = spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")
    return known.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Each cell meets every order and step once, so a part that has one document has all 600 rows. Over
    all orders a document with j failures is removed by each of their filters in 120 / j of them.
    """
    joined = cells(docs, labels).join(F.broadcast(steps(docs.sparkSession)), "mask")
    fails, free = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda value, condition, name: F.sum(F.when(condition, value).otherwise(F.lit(0).cast("long"))).alias(name)
    n = F.col("n")
    first = (F.lit(120) / F.bit_count("mask")).cast("long")
    return joined.groupBy("part", "filter_order", "step").agg(
        total(n, free & ~fails, "kept"), total(n, free & fails, "removed"), total(n, ~free & fails, "redundant"), total(n, F.col("mask") == F.col("bit"), "unique_fails"),
        total(F.col("good"), free & fails, "good_lost"), total(F.col("toxic"), free & fails, "toxic_lost"), total(n * first, fails, "shapley"),
    )
