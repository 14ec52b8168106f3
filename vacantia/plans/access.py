"""User-scoped tables and row-level access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R

#: Tables that anyone may read; all others are the owner's.
PUBLIC = ("companies", "jobs", "graduate_roles")


def visible(table: str, df: DataFrame, role: str, user_id=None, owner: str = "user_id") -> DataFrame:
    """Rows that a role (anon, authenticated, service) may read."""
    if role == "service" or table in PUBLIC:
        return df
    if role == "authenticated" and owner in df.columns:
        return df.filter(F.col(owner) == user_id)
    return df.limit(0)


def applied_jobs(applied: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """A user's applications with job and company; applications whose job is gone are dropped."""
    j = jobs.select(F.col("id").alias("job_id"), "title", "company_id")
    c = companies.select(F.col("id").alias("company_id"), "trading_name")
    return applied.join(j, "job_id", "left").join(c, "company_id", "left").filter(F.col("title").isNotNull())


def reports(reported: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Reports with job and company, also where the job is gone."""
    j = jobs.select(F.col("id").alias("job_id"), "title", "company_id")
    c = companies.select(F.col("id").alias("company_id"), "trading_name")
    return reported.join(j, "job_id", "left").join(c, "company_id", "left")


def allowed(values: Column, kind: str) -> Column:
    """Preference values that are on the allow-list (types, locations or sectors)."""
    lists = {"types": R.ALLOWED_TYPES, "locations": R.ALLOWED_LOCATIONS, "sectors": R.ALLOWED_SECTORS}
    return F.array_intersect(values, F.array(*map(F.lit, lists[kind])))


def applied_times(page: DataFrame, applied: DataFrame, user_id) -> DataFrame:
    """Rows of a page (id, ...) with applied_at, the user's latest application to each; null: none.

    Looked up by join for the page's rows; a user's whole history is never put into one map.
    """
    mine = applied.filter(F.col("user_id") == user_id).join(F.broadcast(page.select(F.col("id").alias("job_id"))), "job_id", "left_semi")
    latest = mine.groupBy(F.col("job_id").alias("id")).agg(F.max("created_at").alias("applied_at"))
    return page.join(latest, "id", "left")


def is_admin(role: str, email: str | None, admins: list[str]) -> bool:
    """The service, or a signed-in user whose address is on the list (any case)."""
    return role == "service" or (role == "authenticated" and (email or "").strip().lower() in {a.strip().lower() for a in admins})


def report(reported: DataFrame, job_id: int, user_id, notes: str | None = None) -> DataFrame:
    """``reported`` (id, job_id, user_id, notes) with a new report; an empty note is null, an absent user an error.

    The column user_id is left out where the table lacks it.
    """
    if user_id is None:
        raise PermissionError("not authenticated")
    row = {"job_id": job_id, "notes": notes or None} | ({"user_id": user_id} if "user_id" in reported.columns else {})
    one = reported.sparkSession.range(1).select(*[F.lit(v).cast(reported.schema[c].dataType).alias(c) for c, v in row.items()])
    top = reported.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    return reported.unionByName(one.withColumn("id", F.lit(top + 1).cast(reported.schema["id"].dataType)), allowMissingColumns=True)


def dismiss(reported: DataFrame, report_id: int, role: str, email: str | None, admins: list[str]) -> DataFrame:
    """``reported`` without one report; for administrators."""
    if not is_admin(role, email, admins):
        raise PermissionError("for administrators")
    return reported.filter(~F.col("id").eqNullSafe(F.lit(report_id)))


def delete_reported(jobs: DataFrame, reported: DataFrame, report_id: int, role: str, email: str | None, admins: list[str]) -> tuple[DataFrame, DataFrame]:
    """Jobs without the one that a report names, and reports without all of that job; for administrators."""
    if not is_admin(role, email, admins):
        raise PermissionError("for administrators")
    of = reported.filter(F.col("id") == report_id).select("job_id").limit(1)
    return jobs.join(F.broadcast(of), F.col("id") == F.col("job_id"), "left_anti"), reported.join(F.broadcast(of), "job_id", "left_anti").select(*reported.columns)


def subscriptions(events: DataFrame) -> DataFrame:
    """Current subscription of each user: the latest event by time, then id."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def delete_account(user_id, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the user's rows."""
    return {name: df.filter(~F.col("user_id").eqNullSafe(F.lit(user_id))) for name, df in tables.items()}
