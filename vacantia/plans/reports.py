"""Diagnostic and baseline aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import infer_v4, infer_v5


def company_job_counts(companies: DataFrame, jobs: DataFrame, patterns: list[str]) -> DataFrame:
    """Companies by name pattern with the number and newest of their jobs (0 and null without any)."""
    like = F.lit(False)
    for p in patterns:
        like = like | F.col("trading_name").ilike(p)
    found = companies.filter(like).select("id", "trading_name")
    counts = jobs.groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("jobs_in_db"), F.max("created_at").alias("most_recent_job"))
    return found.join(counts, "id", "left").na.fill(0, ["jobs_in_db"])


def location_counts(companies: DataFrame, jobs: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    mine = companies.filter(F.col("trading_name").ilike(pattern)).select(F.col("id").alias("company_id"))
    return jobs.join(mine, "company_id").groupBy("location").agg(F.count(F.lit(1)).alias("job_count")).orderBy(F.desc("job_count"), F.asc_nulls_last("location")).limit(limit)


def provider_summary(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per provider: companies, jobs, companies without jobs. Jobs are counted per company before the join."""
    counts = jobs.groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    joined = companies.filter(F.col("ats_provider").isNotNull()).join(counts, "id", "left")
    return joined.groupBy("ats_provider").agg(F.count(F.lit(1)).alias("company_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_jobs"), F.count_if(F.col("n").isNull()).alias("companies_with_zero_jobs"))


def null_provider(companies: DataFrame) -> DataFrame:
    return companies.filter(F.col("ats_provider").isNull()).agg(F.count(F.lit(1)).alias("null_provider_companies"), F.count_if(F.col("careers_url").isNotNull()).alias("with_careers_url"))


def config_status(companies: DataFrame) -> DataFrame:
    status = F.when(F.col("careers_url").isNotNull(), "Has careers_url").otherwise("No careers_url")
    return companies.filter(F.col("ats_provider").isNull()).groupBy(status.alias("config_status")).agg(F.count(F.lit(1)).alias("company_count"))


def likely_ats(companies: DataFrame, limit: int = 100) -> DataFrame:
    found = companies.filter(F.col("ats_provider").isNull() & F.col("careers_url").isNotNull())
    return found.select("id", "trading_name", "careers_url", infer_v4(F.col("careers_url")).alias("likely_ats")).orderBy("likely_ats", "trading_name").limit(limit)


def provider_status(companies: DataFrame) -> DataFrame:
    provider, status = F.coalesce("ats_provider", F.lit("unknown")), F.coalesce("ats_status", F.lit("null"))
    return companies.groupBy(provider.alias("ats_provider"), status.alias("ats_status")).agg(F.count(F.lit(1)).alias("company_count"))


def detectable(companies: DataFrame) -> DataFrame:
    """Providers that addresses of unconfigured companies point to, with shares in percent."""
    counts = companies.filter(F.col("ats_provider").isNull()).groupBy(infer_v5(F.col("careers_url")).alias("ats")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("ats", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("pct"))


def rejection_top(rejected: DataFrame, k: int = 5) -> DataFrame:
    return rejected.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def status_counts(companies: DataFrame, statuses: list[str]) -> DataFrame:
    """One row: companies, and how many have each status."""
    return companies.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("ats_status") == s).alias(s) for s in statuses))


def jobs_by_provider(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    c = companies.select(F.col("id").alias("company_id"), F.coalesce("ats_provider", F.lit("unknown")).alias("ats_provider"))
    return jobs.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).join(c, "company_id").groupBy("ats_provider").agg(F.sum("n").alias("job_count"))


def jobs_by_company(companies: DataFrame, jobs: DataFrame, k: int = 200) -> DataFrame:
    counts = jobs.groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("job_count"))
    return companies.join(counts, "id").select(F.col("id").alias("company_id"), "trading_name", "ats_provider", "job_count").orderBy(F.desc("job_count"), "company_id").limit(k)
