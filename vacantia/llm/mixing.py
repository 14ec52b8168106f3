"""Mixing sources to target weights with a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words;
a target above 3 times its source is cut to that, and the excess is shared again by weight.

Curriculum: at training time t in [0, 1] source s has the weight target_s * (1 + slope_s * (2t - 1)),
whose integral is target_s * (t + slope_s * (t^2 - t)). A document's place in its source's
demand (words of earlier passes and earlier documents) is put through the inverse of that
integral, which gives its training position; documents are range-sorted by position.

Each source's prefix sums are taken in three levels: slices of the id hash are summed, runs of slices
are summed, and rows are accumulated within their slice, slices within their run, runs within their
source, so no source is in one task. Sources are ranked and given targets as a table too: nothing
here grows with their number on the driver, and it is Spark that decides whether the table is broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import keep_rows, materialize, row_key

WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (0.6, 0.0, -0.6)
MAX_PASSES = 3
#: Rows that a slice of the order holds on average, and slices at most (beyond that they grow; a slice is sorted by one task, with spill).
SLICE_ROWS, MAX_SLICES = 4096, 1 << 13
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], cap: float = MAX_PASSES) -> list[float]:
    """Share sum(sizes) by weight; none above cap * its size, the excess reshared until none is."""
    total, target, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in free)
        whole = sum(weights[i] for i in free)
        for i in free:
            target[i] = rest * weights[i] / whole
        over = {i for i in free if target[i] > cap * sizes[i]}
        for i in over:
            target[i] = float(cap * sizes[i])
        if not over:
            break
        free -= over
    return target


def word_sizes(docs: DataFrame) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), row_key(docs).alias("key"))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with rank: 0, 1, ... by code point of source, null last.

    Range partitions are sorted by themselves; only their row counts pass through the driver.
    """
    spark = sources.sparkSession
    by = [F.asc_nulls_last("source")]
    dealt = materialize(sources.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    ahead = [(part, sum(n for _, n in counts[:k])) for k, (part, _) in enumerate(counts)]
    offsets = spark.createDataFrame(ahead, "__part int, __ahead long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1
    return dealt.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__ahead") + within).drop("__part", "__ahead")


def _cycle(rank: Column, values: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_table(sized: DataFrame) -> DataFrame:
    """Per source: rank, source_size, target, slope.

    Shares above MAX_PASSES * size are cut and the excess is shared again by weight, one aggregation a
    turn; every turn cuts a source at least, and in practice a few turns cut all.
    """
    sizes = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    known = materialize(sizes.withColumn("weight", _cycle(F.col("rank"), WEIGHTS)).withColumn("slope", _cycle(F.col("rank"), SLOPES)))
    most = MAX_PASSES * F.col("source_size")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    # a share a unit of weight: sources whose own share of it is above their bound are cut, the rest share again
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) > most
        r = known.agg(F.sum(F.when(over, most).otherwise(0)).alias("cut"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        found = (total - (r["cut"] or 0)) / r["weight"] if r["weight"] else level
        if found <= level:
            break
        level = found
    target = F.least(F.col("weight") * F.lit(level), most.cast("double"))
    return known.select("source", "rank", "source_size", target.alias("target"), "slope")


def _position(place, target, slope):
    """Inverse of target * (t + slope * (t^2 - t)) at ``place``."""
    y = F.least(F.lit(1.0), place / target)
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * y)
    return F.when(target <= 0, F.lit(0.0)).when(slope == 0, y).otherwise((root - (1 - slope)) / (2 * slope))


def assign(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, takes.

    takes: array of (words, position), one entry for each pass that takes the document; the
    last pass over a source may take the first words of one document only, so a source's taken
    words meet its target to the word. taken is their sum, never above 3 times the size.
    Order within a source: hash of the id, then the id (rows that share an id are
    interchangeable). Null sources are one source, null texts have size 0.
    """
    return _plan(docs).drop("key")


def _plan(docs: DataFrame) -> DataFrame:
    """``assign`` with the key of each row."""
    sized = materialize(word_sizes(docs))
    slices = min(max(1, -(-sized.count() // SLICE_ROWS)), MAX_SLICES)
    known = _with_sources(sized).withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))))
    # slices are ranges of the order itself, so rows that share an id are dealt over as many as they fill; of equal rows any may be first
    known = known.withColumn("tie", F.monotonically_increasing_id())
    order = ["h", "doc_id", "size", "key", "tie"]
    known = materialize(known.repartitionByRange(slices, "rank", *order).withColumn("slice", F.spark_partition_id()))
    sums = known.groupBy("rank", "slice").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("run", F.floor(F.col("slice") / SLICE_ROWS))
    before = lambda c, *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy("rank", "run").agg(F.sum("n").alias("n")).select("rank", "run", before("run", "rank").alias("of_run"))
    offsets = sums.withColumn("in_run", before("slice", "rank", "run")).join(runs, ["rank", "run"]).select("rank", "slice", (F.col("of_run") + F.col("in_run")).alias("offset"))
    within = Window.partitionBy("rank", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = known.join(offsets, ["rank", "slice"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    quota = F.floor(F.col("target") + F.lit(0.5)).cast("long")

    def take(k):
        start = F.lit(k) * F.col("source_size") + F.col("before")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), quota - start))
        return F.struct(words.alias("words"), _position(start + words / 2, F.col("target"), F.col("slope")).alias("position"))

    takes = F.filter(F.array(*[take(k) for k in range(MAX_PASSES)]), lambda x: x["words"] > 0)
    taken = F.aggregate(F.col("takes"), F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return placed.withColumn("takes", takes).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "takes", "key")


def _with_sources(sized: DataFrame) -> DataFrame:
    per = materialize(source_table(sized)).withColumnRenamed("source", "of_source")
    return sized.join(per, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


@F.pandas_udf(StringType())
def _first_words(text: pd.Series, words: pd.Series) -> pd.Series:
    import re

    word = re.compile(WORD)

    def cut(t, n):
        end = 0
        for k, m in enumerate(word.finditer(t)):
            if k == n:
                break
            end = m.end()
        return t[:end]

    return pd.Series([cut(t or "", int(n)) for t, n in zip(text, words)], dtype=object)


def mixture(docs: DataFrame) -> DataFrame:
    """The training order: the columns of ``docs``, a row for each take, range-sorted by position.

    A take of fewer words than the document has keeps its first words. Rows are matched to their
    takes by their key; of equal rows one is joined with the takes of all of them.
    """
    plan = materialize(_plan(docs).select("key", "size", "takes"))
    alone = keep_rows(docs, plan.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(True)))
    takes = plan.select(F.col("key").alias("__key"), F.col("size").alias("__size"), F.explode("takes").alias("__take"))
    joined = alone.join(takes, "__key")
    part = F.col("__take.words") < F.col("__size")
    text = F.when(part, _first_words(F.when(part, F.col("text")), F.col("__take.words"))).otherwise(F.col("text"))
    cols = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    order = ["__position", "doc_id", "__key"]
    chosen = joined.select(*cols, F.col("__take.position").alias("__position"), "__key")
    return chosen.repartitionByRange(*order).sortWithinPartitions(*order).drop("__position", "__key")


def in_order(docs: DataFrame) -> DataFrame:
    """One row per document, range-sorted by first_position (null: never taken, last).

    doc_id, size, source_size, target, taken, first_position, and positions: that of each take, ascending.
    """
    plan = _plan(docs).withColumn("positions", F.array_sort(F.transform("takes", lambda x: x["position"])))
    found = plan.select("doc_id", "size", "source_size", "target", "taken", F.array_min("positions").alias("first_position"), "positions", "key")
    order = [F.asc_nulls_last("first_position"), F.asc("doc_id"), F.asc("key")]
    return found.repartitionByRange(*order).sortWithinPartitions(*order).drop("key")


def written_position(docs: DataFrame) -> Column:
    """A number that grows in the row order of ``docs``, distinct but with gaps.

    For rows read from Spark's files it comes from the file's task and part number and the row's
    place in it, as the scan deals files out by size; else from the partition and the place in it.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()

    def number(pattern):
        return F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0).cast("long"))

    return F.shiftleft(number(r"^part-(\d+)"), 43) + F.shiftleft(number(r"c(\d{3,})\."), 33) + F.col("_metadata.row_index")
