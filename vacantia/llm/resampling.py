"""Resample a corpus towards a target: hashed n-gram ratios as weights, Gumbel noise, the highest scores drawn.

Every run of 1 to ``grams`` words is a feature, its crc32 modulo ``buckets`` a bucket. A bucket's gain is the
log ratio of its shares in target and corpus, a document's weight the mean gain of its features. With
Gumbel noise made from the id, the highest weights-plus-noise are a draw without replacement in proportion
to exp(weight).

Words are exploded and counted in place: before a shuffle the counts are a row a bucket and the sums a row a
document. The gain table has ``buckets`` rows and is broadcast. Ranks come from one range sort: the place of a row
is its place in its range plus the rows of the ranges ahead, which are counted after the sorted rows are written.

Defined results: a null text has no features and weight 0; a null id draws its noise as the empty
text and comes first among ties; rows that share id and score are interchangeable; an empty table gives no
rows; an empty target gives each bucket the gain of a target without features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, materialize, row_key

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GRAMS, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(feature: Column) -> Column:
    """A-Z lowered, nothing else; the quick way where the feature is ASCII."""
    return F.when(F.octet_length(feature) == F.char_length(feature), F.lower(feature)).otherwise(F.translate(feature, _UPPER, _LOWER))


def _features(texts: DataFrame, *keep: str, grams: int, buckets: int) -> DataFrame:
    """``keep``, n_words and bucket: a row a feature; a text without words has one row with a null bucket."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    cut = texts.select(*keep, words.alias("words"))
    n = F.size("words").alias("n_words")
    if grams == 1:
        found = cut.select(*keep, n, F.explode_outer("words").alias("feature"))
    else:
        run = lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - (size - 1)), lambda i: F.array_join(F.slice("words", i, size), " "))
        none = F.array().cast("array<string>")
        runs = F.concat("words", *[F.when(F.size("words") >= k, run(k)).otherwise(none) for k in range(2, grams + 1)])
        found = cut.select(*keep, n, F.explode_outer(runs).alias("feature"))
    return found.select(*keep, "n_words", F.pmod(F.crc32(_folded(F.col("feature")).cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain (thousandths): a row for each of the ``buckets``, whether met or not."""
    count = lambda texts, name: _features(texts, grams=grams, buckets=buckets).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(count(docs, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = materialize(both)
    of_docs, of_target = both.agg(F.sum("s"), F.sum("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * F.lit(float(of_docs + buckets))) / ((s + 1) * F.lit(float(of_target + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _noise(seed: int) -> Column:
    """Thousandths of a standard Gumbel variate that the id alone decides."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, ``keep``, n_words, n_features, weight, score."""
    table = materialize(gains(docs, target, grams, buckets))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *keep, "text")  # tells rows apart within this one pass
    found = _features(rows, "row", "doc_id", *keep, grams=grams, buckets=buckets).join(F.broadcast(table), "bucket", "left")
    first = [F.first(c).alias(c) for c in ("doc_id", *keep, "n_words")]
    each = found.groupBy("row").agg(*first, F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    weight = F.expr("(sum - pmod(sum, greatest(n_features, 1))) div greatest(n_features, 1)")  # floors go down
    return each.select("doc_id", *keep, F.col("n_words").cast("long").alias("n_words"), "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + _noise(seed))


def ranked(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with rank: 1, 2, 3... for the floor(percent * N / 100) highest scores of the N rows with ``min_words``, else null."""
    fit = F.col("n_words") >= min_words
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_first("doc_id")]
    dealt = scored.withColumn("fit", fit).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = materialize(dealt)
    part, within = F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("rows"), F.count_if("fit").alias("n"))  # a row a range
    ahead = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead")
    sizes = sizes.select("part", ahead, F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("drawn"))
    placed = dealt.withColumn("part", part).join(F.broadcast(sizes), "part").withColumn("rank", F.col("ahead") + within + 1)
    return placed.withColumn("rank", F.when(F.col("fit") & (F.col("rank") <= F.col("drawn")), F.col("rank"))).drop("part", "place", "ahead", "drawn", "fit")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (undrawn: null)."""
    return ranked(scores(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn documents themselves: the columns of ``docs`` and ``rank``; rows are matched by their key."""
    keyed = docs.withColumn("__row", row_key(docs))
    drawn = ranked(scores(keyed, target, grams, buckets, seed, ("__row",)), min_words, percent).filter("rank IS NOT NULL")
    drawn = materialize(drawn.select("__row", F.col("rank").alias("__rank")))
    alone = keep_rows(docs, drawn.groupBy(F.col("__row").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(True)))
    names = [F.col(c) for c in docs.columns if c != "rank"]
    return alone.join(drawn, alone["__key"] == drawn["__row"]).select(*names, F.col("__rank").alias("rank"))
