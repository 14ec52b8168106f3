"""Registered queries of detection runs, imports and lookups; every callable takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as X
from .functions import titles, tokens, urls
from .operators import detect, merge, runs
from .sources import files
from .tables import dealt

FOUND = {}


def query(f):
    FOUND[f.__name__] = f
    return f


SNIPPETS = ["see jobs.lever.co/snip-co today", None, "nothing here", "apply at https://www.teamtailor.com/x", ""]
BODIES = [
    '{"jobs": [{"location": {"name": "Leeds, UK"}}, {"location": {"name": "Paris"}}], "departments": [1, 2, 3]}', '[{"categories": {"location": "Berlin"}}, {"categories": {"location": "wales"}}]',
    '{"jobPostings": [{"locationName": "Oslo"}], "jobs": [1]}', '{"results": [{"location": {"city": "London", "country": "x"}}]}', '{"content": [], "data": [1, 2]}', '{"offers": [{"location": "Bristol"}], "posts": [7]}',
    "<html>we hire in Glasgow and elsewhere, see all our open roles</html>", "short", "", None, '{"data": [{"office": "Leeds"}], "positions": [1, 2]}', '{"result": [{"location": "Hull"}]}',
]
VERDICT_PROVIDERS = ["Greenhouse", "lever ", "ashby", "workable", "smartrecruiters", "recruitee", "icims", "personio", "bamboohr", None, "jobvite", "pinpoint", "breezy"]
RUN_STATUSES = ["ok", "unchecked", "no_careers_page_found", "auth_or_bot_protected", "needs_manual_review", "dead", None]
GATE_TOKENS = ["https://x.myworkdayjobs.com/a", "https://x.test/a", "acme", "ab", "Jobs", "data", None, "", "plain-token", "myworkdayjobs.com", "!x!"]
GATE_PROVIDERS = ["workday", "greenhouse", "icims", "none", "mystery", "lever_eu", None]
CELLS = [" 12 ", "x", "0", "-4", None, "40", "7.5"]
SALARIES = [None, 0, 25000, 31000]


def _companies(spark, sf_dir):
    return X.companies(spark, sf_dir)


@query
def search_hit_match(spark, sf_dir):
    k = F.col("id")
    link = F.when(k % 3 > 0, F.col("careers_url"))
    return runs.match_search_hits(_companies(spark, sf_dir).select((k % 200).alias("query_id"), k.alias("rank"), link.alias("link"), X.pick(SNIPPETS, k).alias("snippet")))


def _tokens(spark, sf_dir):
    name = F.when(F.col("id") % 5 == 0, F.col("careers_url")).otherwise(F.concat(F.lit(" The "), F.col("trading_name"), F.lit(" & Co. ")))
    c = dealt(_companies(spark, sf_dir).select("id", "trading_name", "careers_url"), "id")  # names are narrow, their pairs are not
    return c.select("id", runs.heuristic_tokens(name, F.col("careers_url")).alias("tokens"))


@query
def heuristic_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("id", F.array_join("tokens", ",").alias("tokens"))


@query
def heuristic_probe(spark, sf_dir):
    pairs = runs.heuristic_pairs(_tokens(spark, sf_dir))
    code = X.pick([404, 404, 404, 200, 404, 500, 403], F.col("id") + F.col("n") * 3)
    return runs.first_probe(pairs.withColumn("status", detect.probe_status(code)))


@query
def write_gate_second(spark, sf_dir):
    k = F.col("id")
    made = _companies(spark, sf_dir).select("id", X.pick(GATE_PROVIDERS, k).alias("p"), X.pick(GATE_TOKENS, k).alias("t"), "ats_status")
    return made.select("id", runs.writable(F.col("p"), F.col("t"), F.col("ats_status")).alias("writable"))


@query
def run_summary(spark, sf_dir):
    k = F.col("id")
    same = k % 3 > 0
    rows = _companies(spark, sf_dir).select(
        F.col("ats_provider").alias("old_provider"), F.col("ats_board_token").alias("old_token"), F.when(same, F.col("ats_provider")).otherwise("ashby").alias("new_provider"),
        F.when(k % 2 == 0, F.col("ats_board_token")).otherwise(X.pick(X.TOKENS, k + 3)).alias("new_token"), X.pick(RUN_STATUSES, k).alias("status"),
    )
    return runs.summary(rows)


def _bodies(spark, sf_dir):
    k = F.col("id")
    return _companies(spark, sf_dir).select("id", X.pick(VERDICT_PROVIDERS, k).alias("p"), X.pick(BODIES, k * 7 + F.floor(k / 13)).alias("body"), X.pick(X.TOKENS, k).alias("t"), "careers_url", X.pick([200, 200, 200, 404, None], F.floor(k / 3)).alias("code"))


@query
def jobs_found_estimate(spark, sf_dir):
    return _bodies(spark, sf_dir).select("id", runs.jobs_found(F.trim(F.lower("p")), F.coalesce("body", F.lit(""))).cast("long").alias("n"))


@query
def company_verdict(spark, sf_dir):
    return _bodies(spark, sf_dir).select("id", runs.verdict(F.col("p"), F.col("t"), F.col("careers_url"), F.col("code"), F.coalesce("body", F.lit(""))).alias("verdict"))


@query
def sheet_import(spark, sf_dir):
    k = F.col("s_suppkey")
    sheet = X.read(spark, sf_dir, "supplier").select(F.coalesce(X.pick(CELLS, k), k.cast("string")).alias("company_id"), X.pick([" Greenhouse", "Breezy HR", "breezyhr", "Oracle  Cloud", "nobody", None], k).alias("provider"), X.pick(["n/a", "acme", " - ", "a â€” b"], k).alias("board_token"))
    return runs.import_rows(sheet, _companies(spark, sf_dir))


@query
def graduate_rows(spark, sf_dir):
    k = F.col("p_partkey")
    made = X.read(spark, sf_dir, "part").select(
        k.alias("pos"), k.alias("jobId"), F.col("p_brand").alias("employerName"), F.repeat(F.col("p_name"), 30).alias("jobTitle"), X.pick(X.LOCATIONS, k).alias("locationName"),
        F.when(k % 50 > 0, F.concat(F.lit("https://g.test/"), k % 700)).alias("jobUrl"), X.pick(SALARIES, k).alias("minimumSalary"), X.pick([None, 28000, 40000], k).alias("maximumSalary"),
    )
    return runs.graduate_rows(made, "r9")


@query
def valid_attempt(spark, sf_dir):
    j = X.jobs(spark, sf_dir).select("company_id", ((F.col("id") / 5).cast("long") % 4).alias("attempt_no"), "id", "title")
    return runs.choose_attempt(j.filter("attempt_no <> 1 or length(title) > 16"), titles.valid_title(F.col("title")))


@query
def set_first_by_name(spark, sf_dir):
    names = spark.createDataFrame([(1, "00000012", "ashby", "one"), (2, "#00000013", "lever", "two"), (3, "no such", "x", "y"), (4, "0000012", "workable", "four"), (5, "12", "breezy", "five")], "n int, name string, ats_provider string, ats_board_token string")
    return runs.set_first_by_name(_companies(spark, sf_dir), names).select("id", "ats_provider", "ats_board_token")


@query
def subscription_users(spark, sf_dir):
    subs = X.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subscription"), F.concat(F.lit("cus_"), F.col("o_custkey")).alias("customer"))
    users = X.read(spark, sf_dir, "customer").filter("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("cus_"), F.col("c_custkey")).alias("customer"))
    return runs.subscription_users(subs, users)


@query
def top_saved(spark, sf_dir):
    return runs.top_saved(_companies(spark, sf_dir).select("id", F.coalesce("active_jobs_count", F.lit(0)).alias("saved")))


@query
def client_page(spark, sf_dir):
    return runs.client_page(_companies(spark, sf_dir).select("id", "trading_name"), [F.asc("trading_name"), F.asc("id")], 3)


@query
def url_encoded(spark, sf_dir):
    """Query texts as URL components: blanks as %20."""
    text = F.concat("trading_name", F.lit(" / ä & ö? x=1+2"), F.col("id").cast("string"))
    return _companies(spark, sf_dir).select("id", F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")).alias("encoded"))


ANSWERS = ['Here:\n```json\n{"a": "x\ny\tz", "b": 1}\n``` done', '{"a": "plain", "b": 2}', "no object", '```{"a": "q\\"u\no", "b": 3}```', '{"a": broken}']


@query
def salvage_answers(spark, sf_dir):
    v = _companies(spark, sf_dir).select("id", files.salvage_json(X.pick(ANSWERS, F.col("id"))).alias("v"))
    return v.select("id", F.try_variant_get("v", "$.a", "string").alias("a"), F.try_variant_get("v", "$.b", "long").alias("b"))


@query
def staged_new_columns(spark, sf_dir):
    """Upsert whose source has a column that the target lacks: the new schema has both."""
    c = _companies(spark, sf_dir)
    audit = c.filter("id % 3 = 0").select("id", F.concat("ats_status", F.lit("*")).alias("ats_status"), F.lit("sheet").alias("sync_provider"))
    return merge.upsert(merge.widen(c.filter("id % 4 > 0").select("id", "ats_status"), audit), audit, ["id"])


@query
def all_fingerprints(spark, sf_dir):
    k = F.col("id")
    text = F.concat(F.coalesce("careers_url", F.lit("none")), F.lit(" jobs.lever.co/Two and JOBS.LEVER.CO/two/ "), X.pick(SNIPPETS, k))
    c = dealt(_companies(spark, sf_dir).select("id", "careers_url"), "id")
    return detect.all_matches(c.select((k % 40).alias("company_id"), text.alias("source")))


@query
def name_slugs(spark, sf_dir):
    h = urls.host(F.col("careers_url"))
    return _companies(spark, sf_dir).select("id", F.array_join(tokens.slugs(F.concat(F.lit("the acme & co "), F.col("trading_name")), h), ",").alias("slugs"))


@query
def careers_candidates(spark, sf_dir):
    """The best-scored careers link of each page's recorded links."""
    k = F.col("id")
    text = X.pick(["Careers", "Join us", "Read the blog", "Jobs at Acme", ""], k)
    links = _companies(spark, sf_dir).filter("careers_url is not null").select((k % 60).alias("page_id"), k.alias("pos"), F.col("careers_url").alias("url"), text.alias("text"))
    return detect.best_careers_link(links).select("page_id", "url", F.col("score").cast("long").alias("score"))
