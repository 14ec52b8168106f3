"""Registered queries over the derived tables; every callable takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import location as L
from .functions import titles, tokens, urls
from .functions.values import js_trim
from .operators import dedup, detect, merge, sync
from .plans import access, browse, feed, reports
from .plans.feed import FeedRequest, Preferences
from .tables import dealt

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


# ---------------------------------------------------------------- feed

FEEDS = {
    "feed_newest": FeedRequest(tier2="true"),
    "feed_oldest": FeedRequest(sort="oldest"),
    "feed_title_asc": FeedRequest(sort="title_asc"),
    "feed_title_desc": FeedRequest(sort="title_desc"),
    "feed_search": FeedRequest(q=" (data), "),
    "feed_search_company": FeedRequest(q="#00000001%"),
    "feed_city": FeedRequest(loc=" london "),
    "feed_multi_location": FeedRequest(locs=["Leeds", "Remote"]),
    "feed_exclusions": FeedRequest(excluded_jobs=list(range(0, 400)), excluded_companies=[1, 2, 3, 5, 8, 13]),
    "feed_company_page": FeedRequest(company_id=36, page=2),
    "feed_prefs_locations": FeedRequest(prefs=Preferences(locations=["Rest of UK", "Scotland"], sponsorship_needed=True)),
    "feed_prefs_types": FeedRequest(prefs=Preferences(job_types=["Full-time", "Internship", "Part-time"])),
    "feed_prefs_sectors": FeedRequest(prefs=Preferences(sectors=["Data", "Design"]), locs=[]),
}


def _feed(r: FeedRequest) -> Query:
    def run(spark, sf_dir):
        found = feed.page(X.jobs(spark, sf_dir), X.companies(spark, sf_dir), r)
        return found.select("pos", "id", "company_id", "trading_name", "title", "location")

    return run


FOUND |= {name: _feed(r) for name, r in FEEDS.items()}


@query
def feed_total_pages(spark, sf_dir):
    return feed.total_pages(X.jobs(spark, sf_dir), X.companies(spark, sf_dir), FeedRequest(loc="london", excluded_jobs=list(range(40))))


@query
def graduate_feed(spark, sf_dir):
    return feed.page(X.graduate_roles(spark, sf_dir), None, FeedRequest(graduate=True, q="e")).select("pos", "id", "title", "trading_name")


# ---------------------------------------------------------------- browse


def _companies(**kw) -> Query:
    return lambda spark, sf_dir: browse.companies_page(X.companies(spark, sf_dir), **kw).select("pos", "id", "trading_name", "active_jobs_count")


FOUND["companies_by_jobs"] = _companies(page=2, excluded=[4, 5])
FOUND["companies_by_jobs_asc"] = _companies(sort="jobs_asc")
FOUND["companies_alpha"] = _companies(sort="alphabetical", page=3)
FOUND["companies_alpha_desc"] = _companies(sort="alphabetical_desc", q="#0000000_2%")


@query
def companies_favorites(spark, sf_dir):
    mine = X.events(spark, sf_dir, "click").filter("user_id < 40").select((F.col("event_id") % 1500).alias("company_id"))
    return browse.companies_page(X.companies(spark, sf_dir), favorites=mine).select("pos", "id", "trading_name", "active_jobs_count")


@query
def company_detail(spark, sf_dir):
    return browse.company_detail(X.companies(spark, sf_dir), X.jobs(spark, sf_dir), 10).select("pos", "id", "title")


@query
def register_search(spark, sf_dir):
    return browse.register_search(X.register(spark, sf_dir), "LE", tab="aiVerified")


@query
def register_tab(spark, sf_dir):
    return browse.register_search(X.register(spark, sf_dir), " ", tab="aiVerified")


@query
def register_new(spark, sf_dir):
    return browse.register_search(X.register(spark, sf_dir), None, tab="new", new_since=7)


@query
def register_stats(spark, sf_dir):
    return browse.register_stats(X.register(spark, sf_dir))


@query
def occupation_search(spark, sf_dir):
    codes = X.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("related_titles"))
    return browse.occupation_search(codes, "al")


# ---------------------------------------------------------------- reports


@query
def diag_company_job_counts(spark, sf_dir):
    found = reports.company_job_counts(X.companies(spark, sf_dir), X.jobs(spark, sf_dir), ["%00001%", "%9_"])
    return found.withColumn("most_recent_job", F.date_format("most_recent_job", "yyyy-MM-dd"))


@query
def diag_locations(spark, sf_dir):
    return reports.location_counts(X.companies(spark, sf_dir), X.jobs(spark, sf_dir), "%1%")


@query
def diag_provider_summary(spark, sf_dir):
    return reports.provider_summary(X.companies(spark, sf_dir), X.jobs(spark, sf_dir))


@query
def diag_null_provider(spark, sf_dir):
    return reports.null_provider(X.companies(spark, sf_dir))


@query
def diag_config_status(spark, sf_dir):
    return reports.config_status(X.companies(spark, sf_dir))


@query
def diag_likely_ats(spark, sf_dir):
    return reports.likely_ats(X.companies(spark, sf_dir))


@query
def baseline_provider_status(spark, sf_dir):
    return reports.provider_status(X.companies(spark, sf_dir))


@query
def detectable_pct(spark, sf_dir):
    return reports.detectable(X.companies(spark, sf_dir))


@query
def rejection_top5(spark, sf_dir):
    return reports.rejection_top(X.jobs(spark, sf_dir).select(X.pick(X.REASONS, F.col("id")).alias("reason")))


@query
def status_counts(spark, sf_dir):
    return reports.status_counts(X.companies(spark, sf_dir), ["ok", "dead", "bad_token"])


@query
def jobs_by_provider(spark, sf_dir):
    return reports.jobs_by_provider(X.companies(spark, sf_dir), X.jobs(spark, sf_dir))


@query
def jobs_by_company(spark, sf_dir):
    return reports.jobs_by_company(X.companies(spark, sf_dir), X.jobs(spark, sf_dir))


# ---------------------------------------------------------------- classification


@query
def infer_level(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("id", titles.infer_level(F.col("title")).alias("level"))


@query
def infer_sector(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("id", titles.infer_sector(F.col("title"), F.col("department")).alias("sector"))


@query
def infer_sector_texts(spark, sf_dir):
    d = X.read(spark, sf_dir, "documents")
    return d.select("doc_id", titles.infer_sector(F.col("text"), F.col("source")).alias("sector"), titles.infer_level(F.col("text")).alias("level"))


@query
def valid_title(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("id", titles.valid_title(F.col("title")).alias("valid"))


@query
def normalize_location(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("id", L.normalize_location(F.col("location")).alias("normalized"))


@query
def is_uk_job(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("id", "location", L.is_uk_job(L.default_evidence(F.col("location"))).alias("keep"))


@query
def is_uk_location_v1(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("id", L.is_uk_location_v1(F.col("location")).alias("keep"))


@query
def is_uk_location_v2(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("id", L.is_uk_location_v2(F.col("location")).alias("keep"))


@query
def is_uk_location_v3(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("id", L.is_uk_location_v3(F.col("location")).alias("keep"))


@query
def is_uk_location_v4(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("id", L.is_uk_location_v4(F.col("location")).alias("keep"))


@query
def verdict_words(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("id", L.verdict_words(F.col("location")).alias("uk"))


@query
def cleanup_bad_locations(spark, sf_dir):
    return X.jobs(spark, sf_dir).filter(L.cleanup_bad(F.col("location"))).select("id", "location")


@query
def likely_uk_explain(spark, sf_dir):
    j = X.jobs(spark, sf_dir).withColumn("v", L.likely_uk(F.col("location"), F.col("url"), F.col("title"), F.col("department"), F.col("id") % 11 == 0))
    return j.select("id", "v.keep", "v.needs_review", "v.reason")


# ---------------------------------------------------------------- merge and sync


def _split(spark, sf_dir):
    """Target and new snapshot: overlapping parts of the jobs, with changed titles."""
    j = X.jobs(spark, sf_dir)
    return j.filter("id % 10 < 8"), j.filter("id % 10 >= 3").withColumn("title", F.concat("title", F.lit(" *")))


@query
def upsert_jobs(spark, sf_dir):
    target, source = _split(spark, sf_dir)
    merged = merge.upsert(target.drop("created_at"), source.select("id", "title", "location"), ["id"])
    return merged.withColumn("company_id", F.coalesce("company_id", F.lit(-1)))


@query
def upsert_staging(spark, sf_dir):
    """Staging rows: new ones get all columns, known ones two."""
    c = X.companies(spark, sf_dir)
    staged = c.filter("id % 5 = 2").select("id", F.concat("trading_name", F.lit("!")).alias("trading_name"), F.lit("staged").alias("ats_provider"), F.col("ats_status"))
    return merge.upsert(c.filter("id % 10 <> 2").select("id", "trading_name", "ats_provider", "ats_status"), staged, ["id"], update=["ats_provider", "ats_status"])


@query
def stale_delete_url(spark, sf_dir):
    j = X.jobs(spark, sf_dir)
    return merge.stale_by_url(j, j.filter("id % 3 = 0 and company_id % 2 = 0"), "company_id", "url").select("id", "company_id", "url")


@query
def stale_delete_run(spark, sf_dir):
    return merge.stale_by_run(X.graduate_roles(spark, sf_dir), "r1").select("id", "sync_run_id")


@query
def expire_unseen(spark, sf_dir):
    j = X.jobs(spark, sf_dir).select("id", F.col("created_at").alias("last_seen_at"))
    return merge.expire(j, F.to_timestamp(F.lit("1997-01-01")), hours=24 * 365).select("id")


@query
def recount_active(spark, sf_dir):
    return merge.recount(X.companies(spark, sf_dir), X.jobs(spark, sf_dir).filter("id % 4 = 0")).select("id", "active_jobs_count")


@query
def health_transition(spark, sf_dir):
    failed = F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False)
    c = X.companies(spark, sf_dir).withColumn("h", sync.health_after(F.col("ats_status"), F.col("ats_failure_count"), failed))
    return c.select("id", "h.ats_status", F.col("h.ats_failure_count").cast("long").alias("ats_failure_count"))


def _snapshot(spark, sf_dir):
    j = X.jobs(spark, sf_dir)
    target = j.filter("id % 10 < 8").select("id", "company_id", "title", "location", "url", "department", F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("sector"))
    target = dedup.first_value(target, "url", "id")
    fetched = j.filter("id % 10 >= 3 and company_id % 11 <> 0").withColumn("location", F.when(F.col("company_id") % 11 == 1, "Paris").otherwise(F.col("location")))
    tried = X.companies(spark, sf_dir).filter("id % 13 <> 0").select(F.col("id").alias("company_id"))
    postings = fetched.filter("company_id % 13 <> 0").select("company_id", "title", "location", "url", "department", F.col("id").alias("pos"))
    return target, tried, postings


@query
def snapshot_sync(spark, sf_dir):
    target, tried, postings = _snapshot(spark, sf_dir)
    return sync.sync(target, tried, postings)[0].select("company_id", "title", "location", "url", "department", "level", "sector")


@query
def sync_outcomes(spark, sf_dir):
    target, tried, postings = _snapshot(spark, sf_dir)
    return sync.sync(target, tried, postings)[1]


@query
def bulk_update_ilike(spark, sf_dir):
    rules = spark.createDataFrame(X.RULES, "rule_no int, pattern string, alt_pattern string, not_pattern string, max_length int, ats_provider string, ats_board_token string")
    return merge.update_by_rules(X.companies(spark, sf_dir), rules).select("id", "ats_provider", "ats_board_token")


@query
def overrides_merge(spark, sf_dir):
    o = X.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, F.lower("s_name")).alias("ats_provider"), F.lit("t").alias("ats_board_token"))
    return merge.overlay(X.companies(spark, sf_dir).select("id", "ats_provider", "ats_board_token"), o, "id", ["ats_provider", "ats_board_token"])


@query
def toggle_favorite(spark, sf_dir):
    clicks = X.events(spark, sf_dir, "click").select("user_id", (F.col("event_id") % 7).alias("company_id"))
    return merge.toggle(clicks, ["user_id", "company_id"])


@query
def insert_if_absent(spark, sf_dir):
    a = X.events(spark, sf_dir, "purchase").select("user_id", (F.col("event_id") % 5).alias("job_id"))
    return merge.insert_absent(a.filter("user_id % 2 = 0").distinct(), a, ["user_id", "job_id"])


@query
def cascade_delete(spark, sf_dir):
    c = X.companies(spark, sf_dir).filter("id % 6 <> 0")
    (j,) = merge.cascade(c, "id", (X.jobs(spark, sf_dir), "company_id"))
    applied = X.events(spark, sf_dir, "purchase").select("user_id", (F.col("event_id") % 15000).alias("job_id"))
    (left,) = merge.cascade(j, "id", (applied, "job_id"))
    return left


@query
def get_or_create(spark, sf_dir):
    known = X.companies(spark, sf_dir).filter("id % 2 = 0").select("id", "trading_name")
    names = X.companies(spark, sf_dir).filter("id % 5 = 0").select("trading_name")
    return merge.get_or_create(known, names, "id", "trading_name")


@query
def backfill_seen(spark, sf_dir):
    j = X.jobs(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.col("created_at")).alias("last_seen_at"), "created_at")
    return merge.backfill(j, "last_seen_at", F.col("created_at"), F.to_timestamp(F.lit("2000-01-01"))).select("id", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


# ---------------------------------------------------------------- dedup


@query
def dedup_map_last(spark, sf_dir):
    return dedup.last_value(X.jobs(spark, sf_dir).select("url", "id", "title"), "url", "id")


@query
def dedup_set_first(spark, sf_dir):
    return dedup.first_value(X.jobs(spark, sf_dir).select("company_id", "title", "id"), ["company_id", "title"], "id")


@query
def dedup_greedy(spark, sf_dir):
    j = X.jobs(spark, sf_dir).select("company_id", F.col("title").alias("key"), F.concat(F.lit("u"), F.col("id") % 9).alias("url"), "id")
    return dedup.greedy(j, "company_id", "key", "url", "id")


@query
def csv_import_last_wins(spark, sf_dir):
    rows = X.jobs(spark, sf_dir).select(F.col("id").alias("line"), F.col("company_id").alias("id"), tokens.clean_cell(X.pick(["n/a", "﻿acme", "a â€” b", " - ", "Workday"], F.col("id"))).alias("token"))
    return dedup.last_value(rows, "id", "line").select("id", "line", "token")


# ---------------------------------------------------------------- addresses and detection


def _hit(f) -> Query:
    def run(spark, sf_dir):
        c = X.companies(spark, sf_dir).withColumn("h", f(F.col("careers_url")))
        return c.select("id", "h.provider", "h.token")

    return run


FOUND["infer_ats_v1"] = _hit(urls.infer_v1)
FOUND["infer_ats_v3"] = _hit(urls.infer_v3)
FOUND["infer_ats_v6"] = _hit(urls.infer_v6)
FOUND["infer_ats_v2"] = lambda spark, sf_dir: X.companies(spark, sf_dir).select("id", urls.infer_v2(F.col("careers_url")).alias("provider"))
FOUND["infer_ats_v4"] = lambda spark, sf_dir: X.companies(spark, sf_dir).select("id", urls.infer_v4(F.col("careers_url")).alias("provider"))
FOUND["infer_ats_v5"] = lambda spark, sf_dir: X.companies(spark, sf_dir).select("id", urls.infer_v5(F.col("careers_url")).alias("provider"))


@query
def url_host(spark, sf_dir):
    return X.read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))


@query
def page_links(spark, sf_dir):
    p = X.read(spark, sf_dir, "pages").select("page_id", urls.page_links(F.col("html")).alias("links"))
    return p.select("page_id", F.size("links").cast("long").alias("n"), F.array_join("links", " ").alias("links"))


@query
def extract_token(spark, sf_dir):
    k = F.col("id")
    endpoint = X.pick(["https://api.lever.co/v0/postings/acme?mode=json", "https://boards-api.greenhouse.io/v1/boards/beta/jobs", "https://x.bamboohr.com/careers/list", "plain", "https://t.wd3.myworkdayjobs.com/wday/cxs/t/Board/jobs", "https://other.test/x"], k)
    provider = X.pick(["lever", "greenhouse", "bamboohr", "ashby", "workday"], k)
    return X.companies(spark, sf_dir).select("id", urls.endpoint_token(provider, endpoint).alias("token"))


@query
def token_validity(spark, sf_dir):
    t = F.col("ats_board_token")
    return X.companies(spark, sf_dir).select("id", tokens.is_invalid(t).alias("invalid"), tokens.is_plausible(t).alias("plausible"))


@query
def token_similarity(spark, sf_dir):
    return X.companies(spark, sf_dir).select("id", tokens.similarity(F.col("ats_board_token"), F.col("trading_name")).alias("score"))


@query
def token_variants(spark, sf_dir):
    return X.companies(spark, sf_dir).select("id", F.array_join(tokens.variants(F.col("ats_board_token")), ",").alias("variants"))


@query
def careers_link_score(spark, sf_dir):
    return X.companies(spark, sf_dir).select("id", urls.careers_score(F.col("careers_url"), F.col("ats_provider")).alias("score"), urls.excluded_path(F.col("careers_url")).alias("excluded"))


@query
def fingerprint_scan(spark, sf_dir):
    k = F.col("id")
    sources = X.companies(spark, sf_dir).select((k % 50).alias("company_id"), k.alias("pos"), F.col("careers_url").alias("source")).filter("source is not null")
    return detect.fingerprint_scan(dealt(sources, "pos"))


@query
def job_url_fix(spark, sf_dir):
    url = X.pick(["https://api.smartrecruiters.com/v1/companies/Acme/postings/77?x=1", "https://example.test/a", None], F.col("id"))
    return X.jobs(spark, sf_dir).select("id", urls.public_job_url(url).alias("url"))


@query
def discovery_url(spark, sf_dir):
    return X.companies(spark, sf_dir).select("id", urls.discovery_url(F.col("careers_url"), F.lit("https://www.example.com/about")).alias("likely"))


@query
def resolve_provider(spark, sf_dir):
    provider = X.pick(["Custom", "AshbyHQ", "workday", "Team Tailor", None, "Greenhouse"], F.col("id"))
    token = X.pick(["https://www.amazon.jobs/en", "acme", "nu", "", "x/y"], F.col("id"))
    c = X.companies(spark, sf_dir).withColumn("h", urls.resolve_provider(provider, token, F.col("careers_url")))
    return c.select("id", "h.provider", "h.token")


@query
def probe_status(spark, sf_dir):
    code = X.pick(X.CODES, F.col("id"))
    return X.companies(spark, sf_dir).select("id", detect.probe_status(code).alias("status"), detect.strict_probe_status(code, F.col("id") % 100).alias("strict"))


@query
def write_gate(spark, sf_dir):
    k = F.col("id")
    provider = X.pick(["ashby", "workday", "unknown", "custom", "none", "oracle", "zzz", "lever"], k)
    token = X.pick(["acme", "https://nu.myworkdayjobs.com/B", "www", "ab", None, "https://www.myworkdayjobs.com/x", "http://c.test"], k)
    reason = detect.write_gate(provider, token, F.col("careers_url"), k % 9 != 0, X.pick(["high", "none", "low"], k), ("ashby", "workday", "custom", "oracle", "icims", "lever"))
    return X.companies(spark, sf_dir).select("id", reason.alias("reason"))


@query
def change_detect(spark, sf_dir):
    new = F.when(F.col("id") % 2 == 0, F.col("ats_provider")).otherwise(F.lit("ashby"))
    return X.companies(spark, sf_dir).select("id", detect.changed([(new, F.col("ats_provider")), (F.col("ats_status"), X.pick(["ok", None], F.col("id")))]).alias("changed"))


@query
def layered_resolution(spark, sf_dir):
    k = F.col("id")
    hits = X.companies(spark, sf_dir).select((k % 300).alias("company_id"), (k % 4).alias("layer"), (k % 5 != 1).alias("verified"), F.lower("trading_name").alias("provider"), F.col("id").cast("string").alias("token"))
    return detect.layered(hits)


@query
def search_hits(spark, sf_dir):
    k = F.col("id")
    link = X.pick(["https://a.test/x", "//duck.test/l/?uddg=https%3A%2F%2Fb.test%2Fjobs&rut=1", "ftp://c.test", "https://d.test/", "https://a.test/x", None], k)
    return detect.search_hits(X.companies(spark, sf_dir).select((k % 20).alias("query_id"), k.alias("rank"), link.alias("link")), 3)


@query
def discovery_queries(spark, sf_dir):
    return detect.discovery_queries(X.companies(spark, sf_dir).select("id", "trading_name", F.col("careers_url").alias("url")))


# ---------------------------------------------------------------- users


@query
def applied_jobs(spark, sf_dir):
    applied = X.events(spark, sf_dir, "purchase").select("event_id", "user_id", (F.col("event_id") * 3 % 20000).alias("job_id"))
    return access.applied_jobs(applied, X.jobs(spark, sf_dir), X.companies(spark, sf_dir))


@query
def reports_admin(spark, sf_dir):
    reported = X.events(spark, sf_dir, "error").select("event_id", (F.col("event_id") * 7 % 20000).alias("job_id"))
    found = access.reports(reported, X.jobs(spark, sf_dir), X.companies(spark, sf_dir))
    return found.withColumn("company_id", F.coalesce("company_id", F.lit(-1)))


@query
def rls_user_rows(spark, sf_dir):
    rows = X.events(spark, sf_dir, "purchase").select("event_id", "user_id")
    return access.visible("user_applied_jobs", rows, "authenticated", 5)


@query
def prefs_whitelist(spark, sf_dir):
    k = F.col("event_id")
    values = F.array_sort(F.collect_set(X.pick(["London", "Paris", "Scotland", "Rest of UK", "Mars"], k)))
    mine = X.read(spark, sf_dir, "events").groupBy("user_id").agg(values.alias("v"))
    return mine.select("user_id", F.array_join(F.array_sort(access.allowed(F.col("v"), "locations")), ",").alias("locations"))


@query
def subscription_fold(spark, sf_dir):
    e = X.read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("status"))
    return access.subscriptions(e).select("user_id", "event_id", "status")


# ---------------------------------------------------------------- feeds of sources


@query
def first_nonempty_attempt(spark, sf_dir):
    k = F.col("id")
    a = X.companies(spark, sf_dir).select((k % 400).alias("company_id"), (k % 5).alias("attempt_no"), F.concat(F.lit("p"), k % 3).alias("provider"), (k % 4).alias("n_rows"))
    return sync.first_attempt(a)


@query
def resume_from(spark, sf_dir):
    c = X.companies(spark, sf_dir).select(F.col("id").alias("pos"), "trading_name", "ats_provider")
    return sync.resume_after(c, "pos", F.col("ats_provider") == "machinery")


@query
def facet_trust(spark, sf_dir):
    k = F.col("id")
    return sync.facet_trust(X.companies(spark, sf_dir).select(k.alias("board_id"), (k % 50).alias("total"), (k % 67).alias("global_total"), (k % 3 != 0).alias("applied"), (k % 5).alias("n_uk"), (k % 4).alias("n_other")))


@query
def normalize_json_events(spark, sf_dir):
    v = F.try_parse_json("props")
    return X.read(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), js_trim(F.col("event_type")).alias("kind"))


def queries() -> dict[str, Query]:
    from .streaming import jobs as streams

    return FOUND | streams.queries()
