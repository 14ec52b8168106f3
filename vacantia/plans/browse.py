"""Company, register and occupation browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import any_of
from .feed import PAGE_SIZE

ORDERS = {
    "alphabetical": lambda: [F.asc_nulls_last("trading_name")],
    "alphabetical_desc": lambda: [F.desc_nulls_first("trading_name")],
    "jobs_asc": lambda: [F.asc_nulls_last("active_jobs_count"), F.asc_nulls_last("trading_name")],
    "jobs": lambda: [F.desc_nulls_last("active_jobs_count"), F.asc_nulls_last("trading_name")],
}


def companies_page(companies: DataFrame, page: int = 1, q: str | None = None, sort: str = "jobs", excluded: list[int] | None = None, favorites: DataFrame | None = None) -> DataFrame:
    """Exclude, search, sort, then offset; an empty favourites table gives an empty page."""
    df = companies
    if favorites is not None:
        df = df.join(favorites.select(F.col("company_id").alias("id")).distinct(), "id", "left_semi")
    if excluded:
        df = df.filter(~F.col("id").isin(*excluded))
    if q:
        df = df.filter(F.col("trading_name").ilike(f"%{q}%"))
    order = [*ORDERS.get(sort, ORDERS["jobs"])(), F.col("id").asc()]
    shown = df.orderBy(*order).offset((page - 1) * PAGE_SIZE).limit(PAGE_SIZE)
    return shown.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def company_detail(companies: DataFrame, jobs: DataFrame, company_id: int) -> DataFrame:
    """A company and its jobs, the newest first; nothing for an unknown id."""
    c = companies.filter(F.col("id") == company_id).select(F.col("id").alias("company_id"), "trading_name")
    order = [F.desc_nulls_first("created_at"), F.desc("id")]
    return jobs.join(F.broadcast(c), "company_id").withColumn("pos", F.row_number().over(Window.partitionBy("company_id").orderBy(*order)))


def register_search(register: DataFrame, query: str | None = None, tab: str = "all", new_since: int = 0) -> DataFrame:
    """Sponsor register (organisation, town, county, rating, pos): a search overrides the tab."""
    if query and query.strip():
        low = query.lower()
        return register.filter(any_of(F.lower(c).contains(low) for c in ("organisation", "town", "county")))
    if tab == "aiVerified":
        return register.filter(F.col("rating").contains("A rating"))
    if tab == "new":
        return register.orderBy("pos").limit(min(100, new_since))
    return register


def register_stats(register: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return register.agg(n.alias("total"), F.floor(n * 0.114).alias("new_since"), F.floor(n * 0.0074).alias("removed"))


def occupation_search(codes: DataFrame, query: str | None) -> DataFrame:
    """Occupation codes (code, name, related_titles): name or related titles in any case, code as typed."""
    if not query:
        return codes
    low = query.lower()
    return codes.filter(F.lower("name").contains(low) | F.col("code").contains(query) | F.coalesce(F.lower("related_titles").contains(low), F.lit(False)))
