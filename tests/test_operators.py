"""Relational operators: dedup, merge, sync, feed, access, streams."""

import random

from pyspark.sql import functions as F

from vacantia.operators import dedup, merge, sync
from vacantia.plans import access, feed
from vacantia.plans.feed import FeedRequest
from vacantia.streaming import jobs as streams


def test_greedy_is_no_pair_of_windows(spark):
    rows = [(1, "k1", "u1", 0), (1, "k1", "u2", 1), (1, "k2", "u2", 2), (2, "k1", "u1", 3)]
    got = dedup.greedy(spark.createDataFrame(rows, "c int, k string, u string, p int"), "c", "k", "u", "p").collect()
    assert sorted(r.p for r in got) == [0, 2, 3]


def test_greedy_against_the_loop(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), f"k{rng.randrange(6)}", f"u{rng.randrange(6)}", i) for i in range(150)]
    kept = []
    for c, k, u, p in rows:
        if not any(c == a and (k == b or u == d) for a, b, d, _ in kept):
            kept.append((c, k, u, p))
    got = dedup.greedy(spark.createDataFrame(rows, "c int, k string, u string, p int"), "c", "k", "u", "p").collect()
    assert sorted(map(tuple, got)) == sorted(kept)


def test_last_value_keeps_first_place(spark):
    got = dedup.last_value(spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, p int"), "k", "p").collect()
    assert sorted((r.k, r.p, r.first_pos) for r in got) == [("a", 3, 1), ("b", 2, 2)]


def test_run_delete_keeps_null(spark):
    df = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, None)], "id int, sync_run_id string")
    assert sorted(r.id for r in merge.stale_by_run(df, "r1").collect()) == [1, 3]


def test_health(spark):
    rows = [("ok", 2, True), ("ok", None, True), ("dead", 2, False), ("dead", 2, None)]
    df = spark.createDataFrame(rows, "s string, n int, failed boolean")
    got = [tuple(r.h) for r in df.select(sync.health_after(F.col("s"), F.col("n"), F.col("failed")).alias("h")).collect()]
    assert got == [("needs_manual_review", 3), ("dead", 1), ("ok", 0), ("dead", 2)]


JOBS = "url string, company_id long, title string, location string, department string, level string, sector string"
POSTINGS = "company_id long, title string, location string, url string, department string, pos int"


def sync_case(spark):
    jobs = spark.createDataFrame([("u1", 1, "Old", "London", None, None, None), ("u2", 2, "Old", "London", None, None, None), ("u3", 3, "Old", "London", None, None, None), ("u4", 3, "Old", "Leeds", None, None, None), ("u5", 9, "Old", "Bath", None, None, None)], JOBS)
    tried = spark.createDataFrame([(1,), (2,), (3,)], "company_id long")
    postings = spark.createDataFrame([(2, "Cook", "Paris", "u2", None, 0), (3, "New", "Leeds", "u4", "Data", 0), (3, "More", "London | Paris", "u6", None, 1), (3, "", "London", "u7", None, 2), (3, "More", "LONDON | paris ", "u8", None, 3)], POSTINGS)
    return jobs, tried, postings


def test_sync(spark):
    new, out = sync.sync(*sync_case(spark))
    # 1 fetched nothing and keeps its jobs, 2 has no eligible posting and loses them, 9 was not tried
    assert {(r.url, r.company_id, r.title) for r in new.collect()} == {("u1", 1, "Old"), ("u4", 3, "New"), ("u6", 3, "More"), ("u5", 9, "Old")}
    assert {r.company_id: r.bucket for r in out.collect()} == {1: "zero_jobs", 2: "non_uk_jobs", 3: "uk_jobs"}


def test_sync_is_idempotent(spark):
    jobs, tried, postings = sync_case(spark)
    once = sync.sync(jobs, tried, postings)[0]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(sync.sync(once, tried, postings)[0]) == rows(once)


def test_sequence_is_dense(spark):
    got = merge.with_sequence(spark.range(1000).withColumn("k", F.col("id") * 7 % 1000).repartition(7), "n", ["k"]).collect()
    assert sorted(r.n for r in got) == list(range(1, 1001)) and all(r.n == r.k + 1 for r in got)


def test_rules_last_wins(spark):
    companies = spark.createDataFrame([(1, "King Activision", None, None), (2, "King", "a", "b")], "id int, trading_name string, ats_provider string, ats_board_token string")
    rules = spark.createDataFrame([(1, "%king%", None, None, None, "x", "1"), (2, "%king%", None, "%acti%", 9, "y", "2")], "rule_no int, pattern string, alt_pattern string, not_pattern string, max_length int, ats_provider string, ats_board_token string")
    assert {r.id: r.ats_board_token for r in merge.update_by_rules(companies, rules).collect()} == {1: "1", 2: "2"}


def test_pages_by_seen_set_are_disjoint(spark):
    rows = [(i, i % 7, f"t{i}", "London", None, None) for i in range(90)]
    jobs = spark.createDataFrame(rows, "id long, company_id long, title string, location string, department string, created_at timestamp")
    companies = spark.createDataFrame([(i, f"c{i}", True) for i in range(7)], "id long, trading_name string, licensed_sponsor boolean")
    seen = []
    for _ in range(9):
        page = [r.id for r in feed.page(jobs, companies, FeedRequest(excluded_jobs=list(seen))).orderBy("pos").collect()]
        assert len(page) == 10 and not set(page) & set(seen)
        seen += page
    assert sorted(seen) == list(range(90))
    first = feed.page(jobs, companies, FeedRequest()).orderBy("pos").collect()
    assert len({r.company_id for r in first[:7]}) == 7 and [r.id for r in first[7:]] == [82, 81, 80]


def test_seven_cases_of_empty_input(spark):
    jobs, tried, postings = (df.limit(0) for df in sync_case(spark))
    assert sync.sync(jobs, tried, postings)[0].count() == 0
    assert merge.upsert(jobs, jobs, ["url"]).count() == 0
    assert merge.toggle(jobs, ["url"]).count() == 0


def test_access(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, x string")
    count = lambda role, user=None: access.visible("user_preferences", rows, role, user).count()
    assert (count("anon"), count("authenticated", 2), count("service")) == (0, 1, 2)
    assert access.delete_account(1, prefs=rows)["prefs"].count() == 1


def test_stream_upsert(spark, tmp_path):
    for k, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        spark.createDataFrame(rows, "id int, x string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        writer = streams.upsert_batches(streams.stream_of(spark, f"{tmp_path}/in"), f"{tmp_path}/out", ["id"], f"{tmp_path}/check")
        writer.trigger(availableNow=True).start().awaitTermination()
    assert {(r.id, r.x) for r in spark.read.parquet(f"{tmp_path}/out/v=1").collect()} == {(1, "a"), (2, "c"), (3, "d")}
