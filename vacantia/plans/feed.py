"""The job feed: one lazy plan from request parameters to a page."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.values import any_of, ilike_any

PAGE_SIZE, WINDOW = 10, 50


@dataclass
class Preferences:
    locations: list[str] = field(default_factory=list)
    job_types: list[str] = field(default_factory=list)
    sectors: list[str] = field(default_factory=list)
    sponsorship_needed: bool = False


@dataclass
class FeedRequest:
    page: int = 1
    q: str | None = None
    loc: str | None = None
    tier2: str | None = None
    locs: list[str] | None = None
    prefs: Preferences | None = None
    excluded_jobs: list[int] = field(default_factory=list)
    excluded_companies: list[int] = field(default_factory=list)
    company_id: int | None = None
    sort: str = "newest"
    graduate: bool = False


def search_term(q: str) -> str:
    """Trimmed, cut to 100 characters, without brackets and commas; % and _ stay wildcards."""
    return "".join(c for c in q.strip()[:100] if c not in "(),")


def expand_locations(names: list[str]) -> list[str]:
    return [x for n in names for x in (R.REST_OF_UK if n in ("Rest of UK", "Rest of the UK") else (n,))]


def type_words(types: list[str]) -> list[str]:
    """Title words of the wanted types; full-time alone asks for nothing."""
    return [w for t in types if t != "Full-time" for w in R.TYPE_WORDS.get(t, ())]


def sector_words(sectors: list[str]) -> list[str]:
    words = [w for s in sectors for w in R.SECTOR_WORDS.get(s, ())]
    return [w for w in dict.fromkeys([*words, *sectors]) if w.strip()]


ORDERS = {
    "oldest": (F.asc_nulls_last, "created_at", F.asc_nulls_last),
    "title_asc": (F.asc_nulls_last, "title", F.desc_nulls_first),
    "title_desc": (F.desc_nulls_first, "title", F.desc_nulls_first),
    "newest": (F.desc_nulls_first, "created_at", F.desc_nulls_first),
}


def order_by(sort: str) -> list:
    """Order of a feed; ties go by id. Nulls sort as the largest values."""
    first, column, tie = ORDERS.get(sort, ORDERS["newest"])
    return [first(column), tie("id")]


def matching(jobs: DataFrame, companies: DataFrame | None, r: FeedRequest) -> DataFrame:
    """All rows that a request selects. jobs: id, company_id, title, location, department, created_at;
    companies: id, trading_name, licensed_sponsor. Graduate roles carry their own trading_name."""
    p = r.prefs or Preferences()
    df = jobs
    if not r.graduate:
        c = companies.select(F.col("id").alias("company_id"), "trading_name", "licensed_sponsor")
        df = df.join(c, "company_id")
    if r.excluded_jobs:
        df = df.filter(~F.col("id").isin(*r.excluded_jobs))
    if r.excluded_companies and not r.graduate:
        df = df.filter(~F.col("company_id").isin(*r.excluded_companies))
    if r.company_id:
        df = df.filter(F.col("company_id") == r.company_id)
    has_q, has_loc = bool(r.q and r.q.strip()), bool(r.loc and r.loc.strip())
    if has_q:
        # the company of every row is joined already, so the two-step search is one disjunction
        df = df.filter(ilike_any([F.col("title"), F.col("trading_name")], [search_term(r.q)]))
    if has_loc:
        df = df.filter(F.col("location").ilike(f"%{r.loc.strip()}%"))
    if r.locs is not None:
        if r.locs:
            df = df.filter(ilike_any([F.col("location")], r.locs))
    elif not r.q and not r.loc and p.locations:
        df = df.filter(ilike_any([F.col("location")], expand_locations(p.locations)))
    if not r.graduate and (r.tier2 == "true" or (not r.q and not r.loc and not r.tier2 and p.sponsorship_needed)):
        df = df.filter("licensed_sponsor")
    if not r.q and (words := type_words(p.job_types)):
        df = df.filter(ilike_any([F.col("title")], words))
    if not r.q and (words := sector_words(p.sectors)):
        df = df.filter(ilike_any([F.col("title"), F.col("department")], words))
    return df


def page(jobs: DataFrame, companies: DataFrame | None, r: FeedRequest) -> DataFrame:
    """A page, with pos from 1.

    The general feed takes the first 50 rows, shows one row per company first, and fills up with
    the rest in order; a company's page is a plain offset page; graduate roles are not cut to ten.
    """
    found = matching(jobs, companies, r)
    if r.company_id:
        ordered = found.orderBy(*order_by(r.sort)).offset((r.page - 1) * PAGE_SIZE).limit(PAGE_SIZE)
        return _numbered(ordered, order_by(r.sort))
    top = _numbered(found.orderBy(*order_by(r.sort)).limit(WINDOW), order_by(r.sort))
    if r.graduate:
        return top
    # at most 50 rows from here on
    turn = F.row_number().over(Window.partitionBy("company_id").orderBy("pos"))
    again = top.withColumn("again", turn > 1).orderBy("again", "pos").limit(PAGE_SIZE)
    return again.withColumn("pos", F.row_number().over(Window.orderBy("again", "pos"))).drop("again")


def _numbered(df: DataFrame, order: list) -> DataFrame:
    """pos of the rows of one page (at most 50)."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def total_pages(jobs: DataFrame, companies: DataFrame | None, r: FeedRequest) -> DataFrame:
    """n and total_pages; rows excluded by id count as if they were there."""
    seen = 0 if r.company_id else len(r.excluded_jobs)
    n = matching(jobs, companies, r).agg(F.count(F.lit(1)).alias("n"))
    return n.select((F.col("n") + seen).alias("n"), F.ceil((F.col("n") + seen) / PAGE_SIZE).cast("long").alias("total_pages"))


def is_new(created_at, now):
    return created_at > now - F.expr("INTERVAL 48 HOURS")


__all__ = ["FeedRequest", "Preferences", "any_of", "expand_locations", "matching", "order_by", "page", "search_term", "sector_words", "total_pages", "type_words", "is_new"]
