"""Registered queries of logs, state, bucketed tables, dumps and board samples; every callable takes (spark, sf_dir)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import fixtures as X
from .operators import counts, dedup, merge, runs, sync
from .operators.bucketed import BucketedTable
from .operators.grams import GramIndex, indexed_search
from .operators.replay import replay
from .plans import feed, keyset
from .sources import dump, files
from .streaming import failures
from .streaming import jobs as streams
from .tables import materialize, scratch

FOUND = {}
FAILED = ("error", "view", "click")  # events that stand for failed probes


def query(f):
    FOUND[f.__name__] = f
    return f


def _probes(events):
    return events.select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(F.col("event_id") % 11 > 0, F.col("event_type").isin(*FAILED)).alias("failed"))


@query
def failure_replay(spark, sf_dir):
    """The failure counter after every probe of the whole log."""
    return replay(_probes(X.read(spark, sf_dir, "events"))).select("event_id", "source_id", "ats_failure_count", "ats_status")


@query
def stream_failure_counter(spark, sf_dir):
    """The counters that a stream of probes ends with; sources silent for 48 hours have expired by timer."""
    out = f"{scratch(spark)}/failures-{uuid.uuid4().hex}"
    failures.run(failures.failure_changes(_probes(streams._events(spark, sf_dir))), f"{out}/changes", f"{out}/checkpoint")
    found = failures.latest(spark.read.schema(failures.CHANGES).parquet(f"{out}/changes"))
    return found.select("source_id", "at_ms", "ats_failure_count", "ats_status")


@query
def bucketed_upsert(spark, sf_dir):
    """Jobs in a bucketed table by url, after an upsert that touches few buckets and a delete."""
    j = X.jobs(spark, sf_dir).select("url", "id", "company_id", "title", "location")
    table = BucketedTable(spark, f"{scratch(spark)}/bucketed-{uuid.uuid4().hex}", j.schema, ["url"], 16)
    table.upsert(dedup.first_value(j.filter("id % 10 < 8"), "url", "id"))
    newer = dedup.first_value(j.filter("company_id % 500 = 7"), "url", "id").withColumn("title", F.concat("title", F.lit(" *"))).drop("location")
    table.upsert(newer)
    table.delete(j.filter("id % 1000 = 3").select("url"))
    return table.read()


@query
def dump_round_trip(spark, sf_dir):
    """Orders written as one INSERT statement a file, and read back with the dump's own columns and types."""
    o = X.read(spark, sf_dir, "orders")
    note = F.concat(F.lit("it's ("), "o_orderpriority", F.lit("), ';\n"), F.col("o_orderkey") % 7)
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 > 0, note).alias("note"), F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 2 == 0).alias("even"))
    where = f"{scratch(spark)}/orders-{uuid.uuid4().hex}"
    files.write_dump(rows, "orders", where)
    return dump.read_dump(spark, where, "orders", 1 << 20)


@query
def board_facet_trust(spark, sf_dir):
    """Facet trust of each board from the places of its first 20 postings."""
    j = X.jobs(spark, sf_dir).filter("company_id % 9 <> 4")
    # a third of the boards names places of one list half only, so that all verdicts occur
    place = F.when(F.col("company_id") % 3 == 0, F.lit("London")).when(F.col("company_id") % 3 == 1, F.when(F.col("id") % 4 > 0, "New York, NY").otherwise("Leeds")).otherwise(F.col("location"))
    postings = j.select(F.col("company_id").alias("board_id"), F.col("id").alias("pos"), place.alias("location"))
    k = F.col("c_custkey")
    boards = X.read(spark, sf_dir, "customer").select(k.alias("board_id"), (k % 50).alias("total"), (k % 67).alias("global_total"), (k % 4 != 0).alias("applied"))
    return sync.facet_trust(sync.with_samples(boards, postings))


@query
def sync_outcomes_nhs(spark, sf_dir):
    """Outcomes of a sync in which the postings of NHS companies pass wherever they are."""
    from .queries import _snapshot

    target, tried, postings = _snapshot(spark, sf_dir)
    name = F.when(F.col("company_id") % 7 == 3, F.lit("Leeds NHS Trust")).when(F.col("company_id") % 7 == 5, F.lit("NHSX Ltd"))
    return sync.sync(target, tried, postings.withColumn("trading_name", name), sync.nhs_company(F.col("trading_name")))[1]


INDEXED_TERM = "a en%neer"


@query
def feed_search_indexed(spark, sf_dir):
    """The feed's search page, its candidates from a gram index that was brought up to date in two batches."""
    jobs, companies = X.jobs(spark, sf_dir), X.companies(spark, sf_dir)
    index = GramIndex(spark, f"{scratch(spark)}/grams-{uuid.uuid4().hex}")
    titles = jobs.select("id", F.col("title").alias("text"))
    index.add("title", titles.filter("id % 10 < 8"))
    index.add("title", titles.filter("id % 10 >= 8"))
    index.add("company", companies.select("id", F.col("trading_name").alias("text")))
    found = indexed_search(index, jobs, INDEXED_TERM)
    page = feed.page(found, companies, feed.FeedRequest(q=INDEXED_TERM))
    return page.select("pos", "id", "company_id", "title", "trading_name")


@query
def recount_deltas(spark, sf_dir):
    """Jobs by company, kept up to date by what three syncs add, remove and move."""
    j = X.jobs(spark, sf_dir).select("id", "company_id")
    states = [j.filter("id % 10 < 6"), j.filter("id % 10 >= 2"), j.filter("id % 10 >= 2 AND company_id % 50 <> 3").withColumn("company_id", F.when(F.col("id") % 101 == 0, F.col("company_id") + 1).otherwise(F.col("company_id")))]
    table = BucketedTable(spark, f"{scratch(spark)}/counts-{uuid.uuid4().hex}", "company_id long, active_jobs_count long", ["company_id"], 16)
    before = j.limit(0)
    for after in states:
        counts.apply(table, counts.changes(before, after, "id", "company_id"), "company_id")
        before = after
    return table.read().filter("active_jobs_count > 0")


KEYSET_PAGES = 4


@query
def keyset_pages(spark, sf_dir):
    """The first pages of a walk by cursor under each order, rows seen before left out."""
    jobs, companies = X.jobs(spark, sf_dir), X.companies(spark, sf_dir)
    seen, rows = keyset.Seen(jobs.filter("id % 3 = 0").select("id")), []
    left = materialize(keyset.unseen(jobs, companies, feed.FeedRequest(), seen).select("id", "company_id", "title", "created_at"))
    for sort in ("newest", "oldest", "title_asc", "title_desc"):
        walk = keyset.Walk()
        for number in range(1, KEYSET_PAGES + 1):
            shown, walk = keyset.next_rows(left, sort, walk)
            rows += [(sort, number, k, r["id"], r["company_id"]) for k, r in enumerate(shown, 1)]
    return spark.createDataFrame(rows, "sort string, page int, pos int, id long, company_id long")


@query
def stream_bucketed_upsert(spark, sf_dir):
    """The latest event of each user, upserted by micro-batch into a bucketed table."""
    where = f"{scratch(spark)}/latest-{uuid.uuid4().hex}"
    table = BucketedTable(spark, f"{where}/table", "user_id long, event_id long, event_type string", ["user_id"], 16)
    stream = streams._events(spark, sf_dir).select("user_id", "event_id", "event_type")
    streams.upsert_buckets(stream, table, f"{where}/checkpoint", "event_id").trigger(availableNow=True).start().awaitTermination()
    return table.read()


@query
def preferences_upsert(spark, sf_dir):
    """Preferences by user: those that were there, overwritten or joined by what users sent since."""
    e = X.read(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    last = lambda df: df.groupBy("user_id").agg(F.max_by(F.struct(F.col("event_type").alias("sectors"), (F.col("event_id") % 5).alias("salary_min")), "event_id").alias("p")).select("user_id", "p.*")
    held = last(e.filter("event_id % 2 = 0 AND user_id % 3 > 0"))
    sent = last(e.filter("event_id % 7 = 1 AND user_id % 4 > 0")).drop("salary_min")
    return merge.upsert(held, sent, ["user_id"])


@query
def company_lookup(spark, sf_dir):
    """The one company that a point lookup by name finds, with its jobs; an unknown name gives none."""
    companies = X.companies(spark, sf_dir)
    found = runs.only_row(companies.filter(F.col("trading_name") == "Customer#000000042"))
    assert runs.only_row(companies.filter("trading_name = 'nobody'"), absent_is_fine=True) is None
    return X.jobs(spark, sf_dir).filter(F.col("company_id") == found["id"]).select("id", F.lit(found["trading_name"]).alias("trading_name"), "title")
