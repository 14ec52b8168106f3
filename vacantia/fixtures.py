"""Domain tables derived deterministically from the generic test tables (keys pick from lists of values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = [
    "Chief Technology Officer", "VP of Sales", "Director of Finance", "Principal Software Engineer", "Lead Data Scientist", "Senior Product Manager",
    "Staff Nurse", "Marketing Intern", "Graduate Analyst", "Junior Legal Counsel", "Electrical Engineer", "UX Designer", "Customer Success Manager",
    "HR Business Partner", "Supply Chain Planner", "Market Research Assistant", "PhD Investigator", "Broadcast Editor", "Civil Engineering Technician",
    "Corporate Strategy Consultant", "Scrum Master", "Account Executive", "Gardener", "Entry-level Warehouse Operative", "Sr. Backend Developer", "Placement Scheme Student",
    "Part-time Teaching Assistant", "Lead Director", "Data Engineer", "View all jobs", "Ab", "", "Careers at our company", "Full-time Cook",
]
LOCATIONS = [
    "London", "London | New York", "Remote", "Remote - US", "Manchester, UK", "New York, NY", "York", "York, New York", "Cambridge, Massachusetts", "Perth, Australia",
    "EC2V 8RF", "3 Locations", "Multiple Locations", "Belfast, Northern Ireland", "Dublin, Ireland", "Cork", "Cork / London", "Bangalore; India", "EMEA", "u.k.", "UK", "Reading, PA",
    "Berlin · London", "Kyiv (Ukraine)", "New South Wales", "Leeds - Hybrid", "WA1 2AB", "Paris • Leeds", "Anywhere", "remote uk", "Edinburgh [Scotland]", "", None, "TBD", "England", "Global", "Sydney, Australia",
]
DEPARTMENTS = ["Engineering", "Finance", None, "", "Design", "London Team", "People Ops"]
HOSTS = [
    "https://boards.greenhouse.io/acme", "https://job-boards.eu.greenhouse.io/acme-eu/jobs", "https://jobs.lever.co/beta-co/123", "https://jobs.ashbyhq.com/Gamma",
    "https://delta.workable.com/jobs", "https://apply.workable.com/delta2/", "https://epsilon.teamtailor.com/jobs", "https://zeta.bamboohr.com/careers", "https://careers.smartrecruiters.com/Eta",
    "https://jobs.smartrecruiters.com/Theta/998", "https://iota.pinpointhq.com", "https://kappa.breezy.hr", "https://lambda.recruitee.com/o/x", "https://mu.jobs.personio.de",
    "https://nu.wd3.myworkdayjobs.com/NuCareers/job/1", "https://xi.wd1.myworkdayjobs.com/en-GB/XiBoard", "https://omicron.icims.com/jobs", "https://www.example.com/careers", "pi.example.org/jobs", None,
    "https://boards.greenhouse.io/embed/job_board?for=rho", "https://www.breezy.hr/careers", "https://sigma.taleo.net/careersection", "https://boards.greenhouse.io/",
]
TOKENS = ["www", "12345", "deadbeef01", "a", "__assets__", "my-co", "Acme_Ltd-7", "jobs/", "Customer", "x" * 60, None, "", "CUSTOMER#1", "northwind 12"]
STATUSES = ["ok", "dead", "bad_token", None, "needs_manual_review"]
CODES = [200, 404, 401, 403, 500, 503, 302, None]
REASONS = ["unknown", None, "non_uk", "no_title", "junk", "late", "dup"]
TOWNS = ["London", "Leeds", "Bath", "York", None, "Hull"]
RULES = [
    (1, "%000001%", None, None, None, "workable", "one"), (2, "%00002_%", None, "%000025%", None, "lever", "two"), (3, "%3%", "%77%", None, 12, "ashby", "never"),
    (4, "%00012%", "%00099%", None, None, "greenhouse", "four"), (5, "%5%", None, "%1%", None, "bamboohr", "five"), (6, "%000001_5", None, None, None, "breezy", "six"),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, key: Column) -> Column:
    """values[key mod n], as a native lookup."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), ((key % len(values)) + 1).cast("int"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("active_jobs_count"))
    provider = F.when(k % 7 != 0, F.lower("c_mktsegment"))
    return c.join(counts, "c_custkey", "left").select(
        k.alias("id"), F.col("c_name").alias("trading_name"), provider.alias("ats_provider"), (F.col("c_nationkey") % 2 == 0).alias("licensed_sponsor"), "active_jobs_count",
        pick(HOSTS, k).alias("careers_url"), pick(STATUSES, k).alias("ats_status"), (k % 4).alias("ats_failure_count"), pick(TOKENS, k).alias("ats_board_token"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("company_id"), pick(TITLES, k).alias("title"), pick(LOCATIONS, k).alias("location"), pick(DEPARTMENTS, k).alias("department"),
        F.concat(F.lit("https://example.test/"), F.col("o_custkey"), F.lit("/"), k % 5000).alias("url"), F.when(k % 97 != 0, F.col("o_orderdate")).alias("created_at"),
    )


def graduate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    run = F.when(k % 3 == 0, "r1").when(k % 3 == 1, "r2")
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("g-"), F.lpad(k.cast("string"), 8, "0")).alias("id"), F.lit(0).alias("company_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("trading_name"),
        pick(LOCATIONS, k).alias("location"), F.lit(None).cast("string").alias("department"), F.timestamp_seconds(F.lit(1700000000) + k * 60).alias("created_at"), run.alias("sync_run_id"),
    )


def events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter(F.col("event_type") == kind)


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rating = F.when(k % 3 == 0, "Worker (A rating)").when(k % 3 == 1, "Temporary Worker (A rating)").otherwise("Worker (B rating)")
    return read(spark, sf_dir, "supplier").select(k.alias("pos"), F.col("s_name").alias("organisation"), pick(TOWNS, k).alias("town"), F.concat(F.lit("County "), k % 11).alias("county"), rating.alias("rating"))
