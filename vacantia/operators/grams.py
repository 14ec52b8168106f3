"""Character n-grams behind ILIKE: many patterns at once, and an index for substring search.

A match of a pattern contains the pattern's literal runs (what stands between % and _), so it contains their
n-grams. Rows and patterns, or rows and a search term, are first joined on a gram; ILIKE then decides
on those candidates alone. A pattern without any literal has no gram and is tried on every row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import dealt, lookup, materialize

#: Characters of a gram, and folders of postings in a segment.
SIZE, BUCKETS = 3, 64
#: Postings that a task sorts and writes, about; and grams told apart by the bits of one number.
RANGE_ROWS, BITS = 1 << 21, 60


def _lower(c: Column) -> Column:
    """As ILIKE compares; a final sigma is like any other, as a run may end elsewhere than its word."""
    return F.translate(F.lower(c), "ς", "σ")


def grams(text: Column, size: int = SIZE) -> Column:
    """Distinct runs of ``size`` characters (code points); none in a shorter text."""
    some = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.char_length(text) >= size, some).otherwise(F.array().cast("array<string>"))


def _runs(pattern: Column) -> Column:
    """Literal runs of a LIKE pattern; an escaped character ends one."""
    return F.filter(F.split(_lower(pattern), r"\\.|[%_]"), lambda r: r != "")


def anchors(patterns: DataFrame) -> DataFrame:
    """``patterns`` (rule, pattern) with the gram that its matches are looked up by (null: no literal).

    Of the grams of the longest run the one that fewest patterns have; runs of one or two characters are their own gram.
    """
    run = F.array_max(F.transform(_runs(F.col("pattern")), lambda r: F.struct(F.char_length(r).alias("n"), r.alias("r"))))["r"]
    named = patterns.select("rule", "pattern", F.explode_outer(F.when(F.char_length(run) >= SIZE, grams(run)).otherwise(F.array(run))).alias("gram"))
    often = named.filter("gram IS NOT NULL").groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    counted = named.join(often, F.col("gram") == F.col("g"), "left")
    return counted.groupBy("rule", "pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def candidates(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs (id, text, rule) that contain every match of ``texts`` (id, text) and ``patterns`` (rule, pattern).

    Texts are dealt by id and exploded into the gram sizes that patterns have, in place; the table of anchors has a row a pattern.
    """
    known = materialize(anchors(patterns.filter("pattern IS NOT NULL")))
    sizes = sorted(r.n for r in known.filter("gram IS NOT NULL").select(F.char_length("gram").alias("n")).distinct().collect())  # 1, 2, 3 at most
    low = _lower(F.col("text"))
    parts = F.concat(*[grams(low, n) for n in sizes]) if sizes else F.array().cast("array<string>")
    given = dealt(texts.filter("text IS NOT NULL").select("id", "text"), "id")
    exploded = given.select("id", "text", F.explode(parts).alias("gram"))
    found = exploded.join(lookup(known.filter("gram IS NOT NULL").select("rule", "gram")), "gram").select("id", "text", "rule")
    wide = known.filter("gram IS NULL").select("rule")
    if not wide.isEmpty():  # % and _ alone: a few rules, tried on each text
        numbers = F.array(*[F.lit(r.rule) for r in wide.distinct().collect()])
        found = found.unionByName(given.select("id", "text", F.explode(numbers).alias("rule")))
    return found


class GramIndex:
    """Postings (kind, gram, id) of short texts, a folder of segments that driver and executors share.

    ``add`` appends the rows of a batch. Postings are never taken back: candidates are held against the
    present rows, so what was changed or deleted costs a look but gives no wrong row; ``add`` of all rows to a new
    index drops them. A segment is dealt by ranges of bucket, gram and id, so a common gram is several files, and a
    search opens the buckets of its grams only. The number of ranges follows the number of postings, so a task's does not.
    """

    SCHEMA = "kind string, gram string, id long, bucket int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def _bucket(gram: Column) -> Column:
        return F.pmod(F.hash(gram), F.lit(BUCKETS)).alias("bucket")

    def add(self, kind: str, texts: DataFrame) -> None:
        """Index ``texts`` (id, text) under ``kind``; null texts have no grams."""
        postings = texts.agg(F.sum(F.greatest(F.char_length("text") - (SIZE - 1), F.lit(0)))).first()[0] or 0
        rows = dealt(texts.select("id", "text"), "id").select(F.lit(kind).alias("kind"), F.explode(grams(_lower(F.col("text")))).alias("gram"), F.col("id").cast("long").alias("id"))
        order = ["bucket", "gram", "id"]
        rows.withColumn("bucket", self._bucket(F.col("gram"))).repartitionByRange(postings // RANGE_ROWS + 1, *order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{self.path}/{uuid.uuid4().hex}")

    def segments(self) -> list[str]:
        """Folders that are whole."""
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        home = jvm(self.path)
        fs = home.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(home)] if fs.exists(home) else []
        return sorted(str(p) for p in found if fs.exists(jvm(p, "_SUCCESS")))

    def postings(self, wanted: list[str]) -> DataFrame:
        """Postings of these grams; other buckets' files are not opened."""
        buckets = {r.bucket for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(self._bucket(F.col("gram"))).collect()}
        out = None
        for segment in self.segments():
            rows = self.spark.read.schema(self.SCHEMA).parquet(segment).filter(F.col("bucket").isin(*buckets) & F.col("gram").isin(*wanted))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], self.SCHEMA)

    def grams_of(self, term: str) -> list[str]:
        """Grams that every text with ``term`` has (% and _ are wildcards); none where no literal run has SIZE characters."""
        parts = F.array_distinct(F.flatten(F.transform(_runs(F.col("term")), lambda r: grams(r))))
        return sorted(self.spark.createDataFrame([(term,)], "term string").select(parts.alias("g")).first().g)

    def having(self, kind: str, wanted: list[str]) -> DataFrame:
        """Ids of texts that have (or had) all of these grams; postings are compressed well, so they are dealt before they are grouped."""
        parts = {f"m{k}": wanted[k : k + BITS] for k in range(0, len(wanted), BITS)}
        bit = lambda part: F.coalesce(*[F.when(F.col("gram") == g, F.lit(1 << k)) for k, g in enumerate(part)], F.lit(0)).cast("long")
        marked = self.postings(wanted).filter(F.col("kind") == kind).select("id", *[bit(part).alias(m) for m, part in parts.items()])
        found = dealt(marked, "id").groupBy("id").agg(*[F.bit_or(m).alias(m) for m in parts])
        for m, part in parts.items():
            found = found.filter(F.col(m) == (1 << len(part)) - 1)
        return found.select("id")


def indexed_search(index: GramIndex, jobs: DataFrame, term: str) -> DataFrame:
    """Rows of ``jobs`` that the feed's search for ``term`` can find: title (kind title) or company name (kind company).

    All of ``jobs`` where the term is too short for the index. The feed's own ILIKE stays behind this.
    """
    wanted = index.grams_of(term)
    if not wanted:
        return jobs
    titles, names = index.having("title", wanted), index.having("company", wanted)
    by_title = jobs.join(titles, "id", "left_semi")
    by_name = jobs.join(names.select(F.col("id").alias("company_id")), "company_id", "left_semi").join(titles, "id", "left_anti")
    return by_title.unionByName(by_name)
