"""Snapshot synchronisation of postings, and source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.location import SOME_LOCATIONS, default_evidence, is_uk_job, is_uk_location_v1, normalize_location
from ..functions.titles import infer_level, infer_sector, valid_title
from ..functions.values import cut, has_words, js_trim
from ..tables import materialize
from . import dedup, merge

FAILURE_LIMIT = 3


def health_after(status: Column, failures: Column, failed: Column) -> Column:
    """struct<ats_status, ats_failure_count>: failures count up and from the third need a review; success resets."""
    n = F.coalesce(failures, F.lit(0)) + 1
    bad = F.struct(F.when(n >= FAILURE_LIMIT, "needs_manual_review").otherwise("dead").alias("ats_status"), n.cast("int").alias("ats_failure_count"))
    good = F.struct(F.lit("ok").alias("ats_status"), F.lit(0).alias("ats_failure_count"))
    return F.when(failed.isNull(), F.struct(status.alias("ats_status"), failures.cast("int").alias("ats_failure_count"))).when(failed, bad).otherwise(good)


def nhs_company(name: Column) -> Column:
    """The name has nhs as a word of its own; null: no."""
    return F.coalesce(has_words(F.lower(name), "nhs"), F.lit(False))


def classify(postings: DataFrame, nhs: Column | None = None) -> DataFrame:
    """postings (company_id, title, location, url, department, pos) with a valid title, and keep: location passes, or an NHS company."""
    postings = postings.filter(valid_title(F.col("title")))
    keep = is_uk_job(default_evidence(F.col("location")))
    return postings.withColumn("keep", keep if nhs is None else keep | F.coalesce(nhs, F.lit(False)))


def to_rows(kept: DataFrame) -> DataFrame:
    """Stored columns of postings that passed: greedy dedup, texts cut to 255, level and sector."""
    usable = kept.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    key = F.concat_ws("_", js_trim(F.lower("title")), js_trim(F.lower(F.coalesce("location", F.lit("")))))
    unique = dedup.greedy(usable.withColumn("dedup_key", key), "company_id", "dedup_key", "url", "pos")
    department = F.when(F.col("department") != "", cut(F.col("department"), 255))
    return unique.select(
        "company_id", cut(F.col("title"), 255).alias("title"), cut(F.coalesce("location", F.lit("")), 255).alias("location"), "url", department.alias("department"),
        infer_level(F.col("title")).alias("level"), infer_sector(F.col("title"), F.col("department")).alias("sector"),
    )


def outcomes(attempted: DataFrame, postings: DataFrame) -> DataFrame:
    """One row per attempted company: fetched, uk, and its bucket (zero_jobs, non_uk_jobs, uk_jobs)."""
    counts = postings.groupBy("company_id").agg(F.count(F.lit(1)).alias("fetched"), F.count_if("keep").alias("uk"))
    joined = attempted.select("company_id").distinct().join(counts, "company_id", "left").na.fill(0, ["fetched", "uk"])
    return joined.withColumn("bucket", F.when(F.col("fetched") == 0, "zero_jobs").when(F.col("uk") == 0, "non_uk_jobs").otherwise("uk_jobs"))


def sync(jobs: DataFrame, attempted: DataFrame, postings: DataFrame, nhs: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """New jobs table and outcomes.

    jobs: url (its key), company_id, title, location, department, level, sector, more columns kept.
    attempted: company_id of every company tried. A company that fetched nothing keeps its jobs; one
    whose postings are all rejected loses them; else its rows are upserted by url and stale ones go.
    """
    # both are needed several times: places are judged and rows deduplicated once
    marked = materialize(classify(postings, nhs))
    out = outcomes(attempted, marked)
    rows = materialize(to_rows(marked.filter("keep")))
    # companies are synchronised one after the other, by company_id: of a url that several post the last one has it,
    # and a url that moved to another company is no stale row of the old one
    latest = rows.groupBy("url").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "url"]), "company_id").alias("r")).select("url", "r.*")
    merged = merge.upsert(jobs, latest, ["url"])
    seen = rows.select("company_id", "url").distinct().withColumn("__seen", F.lit(True))
    state = out.select("company_id", "bucket")
    kept = merged.join(state, "company_id", "left").join(seen, ["company_id", "url"], "left")
    kept = kept.filter(F.col("bucket").isNull() | (F.col("bucket") == "zero_jobs") | F.col("__seen").isNotNull())
    return kept.select(*jobs.columns), out


def resume_after(ordered: DataFrame, pos: str, found: Column) -> DataFrame:
    """Rows from the first that ``found`` marks; unchanged where none is marked."""
    start = ordered.filter(found).agg(F.min(pos).alias("__start"))
    return ordered.crossJoin(F.broadcast(start)).filter(F.col("__start").isNull() | (F.col(pos) >= F.col("__start"))).drop("__start")


def first_attempt(attempts: DataFrame) -> DataFrame:
    """Per company the first attempt (attempt_no) with rows; none: no row."""
    best = attempts.filter("n_rows > 0").groupBy("company_id").agg(F.min(F.struct("attempt_no", "provider", "n_rows")).alias("b"))
    return best.select("company_id", "b.attempt_no", "b.provider", "b.n_rows")


def with_samples(boards: DataFrame, postings: DataFrame, first: int = 20) -> DataFrame:
    """``boards`` (board_id, ...) with n_uk and n_other: places of each board's ``first`` postings inside and outside.

    postings: board_id, pos, location. Places that say nothing (empty, vague, several locations) count for
    neither. The rank limit is applied by every task before the shuffle, so a board of any size brings at most ``first`` rows a task.
    """
    rank = F.row_number().over(Window.partitionBy("board_id").orderBy("pos", "location"))
    sample = postings.select("board_id", "pos", "location").withColumn("__n", rank).filter(F.col("__n") <= first)
    place = normalize_location(F.col("location"))
    vague = (place == "") | place.rlike(SOME_LOCATIONS) | place.isin(*R.SAMPLE_VAGUE)
    uk = is_uk_location_v1(F.col("location"))
    judged = sample.select("board_id", uk.alias("uk"), vague.alias("vague"))
    counts = judged.groupBy("board_id").agg(F.count_if("uk").alias("n_uk"), F.count_if(~F.col("uk") & ~F.col("vague")).alias("n_other"))
    return boards.join(counts, "board_id", "left").na.fill(0, ["n_uk", "n_other"])


def facet_trust(boards: DataFrame) -> DataFrame:
    """Whether a board's country facet can be trusted.

    boards: board_id, total, global_total, applied, n_uk, n_other (counts of the first page).
    """
    reduced = F.col("applied") & (F.col("global_total") > 0) & (F.col("total") / F.col("global_total") < 0.75)
    facet = reduced & ~(F.col("n_other") > F.col("n_uk"))
    return boards.withColumn("trusted", facet | (F.col("n_other") == 0)).withColumn("uses_facet", facet)
