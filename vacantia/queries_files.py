"""Registered queries of file sources and sinks, reports and small lookups; every callable takes (spark, sf_dir).

Files are made from the given tables, written to the shared folder and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import fixtures as X
from .functions import location, urls
from .plans import access, feed
from .sources import files
from .streaming import jobs as streams
from .tables import scratch

FOUND = {}
ADMINS = ["Admin@x.test"]


def query(f):
    FOUND[f.__name__] = f
    return f


def _folder(spark, name):
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _nasty(k):
    """Texts with commas, quotes, line breaks."""
    return F.concat(F.lit('say "x", '), k.cast("string"), F.lit("\nand, é"))


@query
def csv_round_trip(spark, sf_dir):
    k = F.col("c_custkey")
    rows = X.read(spark, sf_dir, "customer").select(k.cast("string").alias("id"), _nasty(k).alias("note"), F.when(k % 3 > 0, F.col("c_name")).alias("name"))
    files.write_csv(rows, path := _folder(spark, "csv"))
    return files.read_csv(spark, path, ["id", "note", "name"])


@query
def csv_lines(spark, sf_dir):
    """Lines as a hand-rolled reader takes them: quotes inside a field, doubled quotes, a quote that stays open."""
    k = F.col("c_custkey")
    line = F.concat_ws(",", k.cast("string"), F.concat(F.lit('"a, ""'), F.col("c_name"), F.lit('"""')), F.concat(F.lit('p"q,r"s'), k % 5), F.when(k % 4 == 0, F.lit('"open, to the end')).otherwise(F.lit("")))
    lines = X.read(spark, sf_dir, "customer").select(F.explode(F.when(k == 0, F.array(F.lit("id,name,mixed,last"), line)).otherwise(F.array(line))).alias("value"))
    lines.write.text(path := _folder(spark, "lines"))
    return files.read_line_csv(spark, path, ["id", "name", "mixed", "last"])


@query
def csv_naive(spark, sf_dir):
    """Fields broken at every comma, quotes kept."""
    k = F.col("c_custkey")
    lines = X.read(spark, sf_dir, "customer").select(F.concat(k.cast("string"), F.lit(',"'), F.col("c_name"), F.lit(', x",'), k % 7).alias("value"))
    headed = lines.repartition(3).select(F.explode(F.when(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0, F.array(F.lit("a,b,c,d"), "value")).otherwise(F.array("value"))).alias("value"))
    headed.write.text(path := _folder(spark, "naive"))
    return files.read_naive_csv(spark, path, ["a", "b", "c", "d"])


@query
def register_csv(spark, sf_dir):
    r = X.register(spark, sf_dir)
    named = r.select(F.when(F.col("pos") % 9 > 0, F.concat(F.lit(" "), "organisation", F.lit(', "Ltd"'))).otherwise("  ").alias("Organisation Name"), F.col("town").alias("Town/City"), F.col("county").alias("County"), F.col("rating").alias("Type & Rating"), F.lit("Skilled Worker").alias("Route"))
    files.write_csv(named, path := _folder(spark, "register"))
    return files.read_register(spark, path)


@query
def processed_ids(spark, sf_dir):
    """Ids of outcome buckets that were written before, for a run that goes on."""
    k = F.col("c_custkey")
    lines = X.read(spark, sf_dir, "customer").select(F.when(k % 5 == 0, "Company ID,Name").when(k % 5 == 1, F.concat(F.lit(" "), k % 100, F.lit(",x"))).otherwise(F.concat(k.cast("string"), F.lit(",y,z"))).alias("value"))
    lines.write.text(path := _folder(spark, "processed"))
    return files.read_processed_ids(spark, path)


@query
def companies_json(spark, sf_dir):
    """Documents of 500 companies each, opened into rows."""
    c = X.read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 500).alias("n"), F.struct(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name")).alias("c"))
    documents = c.groupBy("n").agg(F.collect_list("c").alias("companies")).select(F.to_json(F.struct(F.struct("companies").alias("data"))).alias("value"))
    documents.write.option("maxRecordsPerFile", 1).text(path := _folder(spark, "documents"))
    return files.read_companies_json(spark, path, ["id", "name"])


@query
def outcome_buckets(spark, sf_dir):
    """Outcomes appended to a folder a bucket, by two runs."""
    k = F.col("c_custkey")
    rows = X.read(spark, sf_dir, "customer").select(k.alias("company_id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "zero_jobs").when(k % 3 == 1, "uk_jobs").otherwise("non_uk_jobs").alias("bucket"))
    path = _folder(spark, "buckets")
    for part in (0, 1):
        files.append_buckets(rows.filter(k_part(part)), path)
    return spark.read.option("header", True).schema("company_id long, name string, bucket string").csv(path)


def k_part(part):
    return F.col("company_id") % 2 == part


@query
def json_array(spark, sf_dir):
    """The lines of the pretty-printed array that an export writes."""
    k = F.col("c_custkey")
    rows = X.read(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 4 > 0, F.concat(F.lit('a "b"\n'), "c_name")).alias("name"))
    files.write_json_array(rows, path := _folder(spark, "array"), ["id"])
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def update_statements(spark, sf_dir):
    """UPDATE statements of repaired tokens."""
    c = X.companies(spark, sf_dir).filter("id % 3 = 1").select("id", F.concat(F.lit("it's "), "ats_board_token").alias("ats_board_token"), "ats_provider", (F.col("id") % 2 == 0).alias("checked"))
    return files.sql_updates(c, "companies", ["id"])


@query
def redelivered_events(spark, sf_dir):
    """Events of a stream that delivers some of them up to three times, counted once."""
    sent = streams._events(spark, sf_dir).select("event_id", "ts", "event_type", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))).alias("copy"))
    once = streams.dedup_deliveries(sent.drop("copy"))
    out = _folder(spark, "deliveries")
    streams.run_to_files(once.select("event_type"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema("event_type string").parquet(f"{out}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def new_flags(spark, sf_dir):
    j = X.jobs(spark, sf_dir)
    return j.select("id", feed.is_new(F.col("created_at"), F.to_timestamp(F.lit("1996-06-01"))).alias("is_new"))


@query
def applied_times(spark, sf_dir):
    """A page of the feed with the time of one user's application to each job."""
    jobs, companies = X.jobs(spark, sf_dir), X.companies(spark, sf_dir)
    page = feed.page(jobs, companies, feed.FeedRequest(sort="oldest")).select("id", "pos")
    applied = X.events(spark, sf_dir, "purchase").select((F.col("event_id") % 7).alias("user_id"), F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("created_at"))
    ids = page.select("id", "pos").withColumnRenamed("id", "job_id")
    made = applied.withColumn("pos", (F.col("n") % 25 + 1).cast("int")).join(F.broadcast(ids), "pos").select("user_id", "job_id", "created_at")
    return access.applied_times(page, made, 3).select("id", "pos", F.unix_micros("applied_at").alias("applied_us"))


@query
def infer_ats_v6_tagged(spark, sf_dir):
    hit = X.companies(spark, sf_dir).select("id", urls.infer_v6_tagged(F.col("careers_url")).alias("h"))
    return hit.select("id", *[F.col(f"h.{c}").alias(c) for c in ("provider", "token", "careers_url", "confidence", "layer")])


@query
def cleanup_scan(spark, sf_dir):
    """Stored jobs with a place outside, and the company's name where there is one."""
    c = X.companies(spark, sf_dir).filter("id % 5 > 0").select(F.col("id").alias("company_id"), "trading_name")
    bad = X.jobs(spark, sf_dir).filter(location.cleanup_bad(F.col("location"))).select("id", "title", "location", "company_id")
    return bad.join(c, "company_id", "left").select("id", "title", "location", "trading_name")


def _reports(spark, sf_dir):
    e = X.events(spark, sf_dir, "error")
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") % 40).alias("job_id"), F.col("user_id"), F.when(F.col("event_id") % 2 == 0, "spam").alias("notes"))


@query
def report_insert(spark, sf_dir):
    """Reports after a new one, and after an administrator dismissed the oldest."""
    reported = _reports(spark, sf_dir)
    oldest = reported.agg(F.min("id")).first()[0]
    return access.dismiss(access.report(reported, 12, 77, ""), oldest, "authenticated", "admin@X.test ", ADMINS)


@query
def report_delete(spark, sf_dir):
    """Jobs and reports left when an administrator deletes the job that the oldest report names."""
    reported, jobs = _reports(spark, sf_dir), X.jobs(spark, sf_dir).select("id", "title")
    oldest = reported.agg(F.min("id")).first()[0]
    jobs, reported = access.delete_reported(jobs, reported, oldest, "service", None, ADMINS)
    return jobs.select(F.lit("job").alias("kind"), "id").unionByName(reported.select(F.lit("report").alias("kind"), "id"))


@query
def account_delete(spark, sf_dir):
    """Rows of all users but one in three tables of theirs."""
    tables = {kind: X.events(spark, sf_dir, kind).select("user_id", F.col("event_id").alias("id")) for kind in ("purchase", "click", "error")}
    left = access.delete_account(3, **tables)
    out = None
    for kind, df in left.items():
        named = df.select(F.lit(kind).alias("kind"), "user_id", "id")
        out = named if out is None else out.unionByName(named)
    return out
