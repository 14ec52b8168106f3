"""Logs, keyed state, bucketed tables, dumps, greedy rounds and board samples."""

import datetime as dt
import glob
import random
import re

import pytest

from pyspark.sql import functions as F

from test_entry import duck, rows  # noqa: F401
from vacantia import oracle_state, queries_state
from vacantia.functions import titles
from vacantia.operators import counts, dedup, grams, merge, sync
from vacantia.operators.bucketed import BucketedTable
from vacantia.operators.replay import replay
from vacantia.plans import feed, keyset
from vacantia.sources import dump, files
from vacantia.streaming import failures
from vacantia.streaming import jobs as streams

BASE = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("name", sorted(queries_state.FOUND))
def test_query_equals_sql(spark, duck, tiny, name):  # noqa: F811
    assert rows(queries_state.FOUND[name](spark, tiny).toPandas()) == rows(duck.execute(oracle_state.SQL[name]).df())


# ------------------------------------------------------------------ failure counter


def fold(log, hours=48):
    """Count and status after each event; last state and time of each source."""
    out, state = {}, {}
    for s, t, e, f in sorted(log, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or BASE, r[2])):
        n, known, last = state.get(s, (0, False, None))
        if last and t and t >= last + dt.timedelta(hours=hours):
            n, known = 0, False
        if f is not None:
            n, known = (n + 1 if f else 0), True
        state[s] = (n, known, t or last)
        out[e] = (n, ("needs_manual_review" if n >= 3 else "dead") if n else ("ok" if known else None))
    return out, state


LOG = "source_id long, ts timestamp, event_id long, failed boolean"


@pytest.mark.parametrize("seed", range(3))
def test_replay_of_a_hot_source(spark, seed, monkeypatch):
    rng = random.Random(seed)
    spread = [300, 3000, 100_000][seed]
    log = [(rng.choice([None, 1, 1, 1, 1, 1, 2, 3]), None if rng.random() < 0.02 else BASE + dt.timedelta(hours=rng.randrange(spread)), k, rng.choice([True, True, True, None, False]) if seed else True) for k in range(600)]
    found = replay(spark.createDataFrame(log, LOG).repartition(3)).collect()
    assert {r.event_id: (r.ats_failure_count, r.ats_status) for r in found} == fold(log)[0] and len(found) == 600


def test_replay_deals_one_source_over_ranges(spark):
    log = spark.range(20_000).select(F.lit(7).cast("long").alias("source_id"), F.timestamp_seconds(F.lit(1.7e9) + F.col("id")).alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 9973 > 0).alias("failed"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = replay(log)
        ranges = plan._jdf.queryExecution().toString()
        got = {r.event_id: r.ats_failure_count for r in plan.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: k % 9973 for k in range(20_000)} and "__range" in ranges
    assert replay(log.limit(0)).count() == 0


def test_counter_state_survives_a_restart(spark, tmp_path):
    rng = random.Random(5)
    log = sorted((rng.randrange(6), BASE + dt.timedelta(minutes=rng.randrange(60 * 24 * 20)), k, rng.choice([True, True, False, None])) for k in range(500))
    log = sorted([r for r in log if r[0] != 5 or r[1] < BASE + dt.timedelta(days=9)], key=lambda r: r[1])  # source 5 falls silent
    for k in range(4):  # a file in time order, then a run from the checkpoint of the one before
        spark.createDataFrame(log[len(log) * k // 4 : len(log) * (k + 1) // 4], LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        probes = streams.stream_of(spark, f"{tmp_path}/in")
        failures.run(failures.failure_changes(probes), f"{tmp_path}/out", f"{tmp_path}/check")
    found = {r.source_id: (r.at_ms, r.ats_failure_count, r.ats_status) for r in failures.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    out, state = fold(log)
    ms = lambda t: (t - BASE) // dt.timedelta(milliseconds=1) + 1704067200000
    mark = max(r[1] for r in log) - dt.timedelta(hours=1)
    expected = {}
    for s, (n, known, last) in state.items():
        gone = last + dt.timedelta(hours=48) <= mark
        status = ("needs_manual_review" if n >= 3 else "dead") if n else ("ok" if known else None)
        expected[s] = (ms(last) + 48 * 3_600_000, 0, "expired") if gone else (ms(last), n, status)
    assert found == expected and found[5][2] == "expired"


# ------------------------------------------------------------------ greedy dedup


def walk(rows_):
    keys, urls, out = set(), set(), []
    for g, k, u, p in sorted(rows_, key=lambda r: r[3]):
        if (g, k) not in keys and (g, u) not in urls:
            keys.add((g, k))
            urls.add((g, u))
            out.append((g, k, u, p))
    return sorted(map(str, out))


@pytest.mark.parametrize("rest", [0, 40, 1 << 16])
@pytest.mark.parametrize("case", ["random", "chain"])
def test_greedy_rounds_against_the_loop(spark, monkeypatch, rest, case):
    monkeypatch.setattr(dedup, "REST_ROWS", rest)
    rng = random.Random(rest)
    if case == "chain":  # each row waits for the one before: rounds decide little, so the rest is walked through
        rows_ = [(1, f"k{(i + 1) // 2}", f"u{i // 2}", i) for i in range(300)]
    else:
        value = lambda c: rng.choice([None, *[f"{c}{rng.randrange(60)}"] * 9])
        rows_ = [(rng.choice([1, 1, 1, 2, None]), value("k"), value("u"), i) for i in range(700)]
    got = dedup.greedy(spark.createDataFrame(rows_, "g int, k string, u string, pos int"), "g", "k", "u", "pos").collect()
    assert sorted(map(str, map(tuple, got))) == walk(rows_)


def test_greedy_of_equal_rows_and_places(spark):
    rows_ = [(1, "k", "u", 0, "a")] * 5 + [(1, "k", "w", 0, "b"), (1, "j", "u", 0, "c")]
    got = dedup.greedy(spark.createDataFrame(rows_, "g int, k string, u string, pos int, extra string"), "g", "k", "u", "pos").collect()
    assert [tuple(r) for r in got] == [(1, "j", "u", 0, "c"), (1, "k", "w", 0, "b")] or sorted(r.k for r in got) == ["j", "k"]


def test_a_hot_group_is_no_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(dedup, "REST_ROWS", 500)
    groups = spark.sparkContext.accumulator(0)
    walked = dedup._walk

    def counted(table):
        groups.add(table.num_rows)
        return walked(table)

    monkeypatch.setattr(dedup, "_walk", counted)
    k = F.xxhash64("id")
    hot = spark.range(60_000).select(F.lit(1).alias("g"), F.pmod(k, F.lit(9_000)).cast("string").alias("k"), F.pmod(F.xxhash64(k), F.lit(9_000)).cast("string").alias("u"), F.col("id").alias("pos"))
    got = dedup.greedy(hot, "g", "k", "u", "pos").collect()
    assert groups.value <= 500  # of 60,000 tied rows of one group
    assert sorted(map(str, map(tuple, got))) == walk([tuple(r) for r in hot.collect()])


# ------------------------------------------------------------------ bucketed table


def files_of(path, version):
    return glob.glob(f"{path}/data/v={version}/bucket=*/part-*.parquet")


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = BucketedTable(spark, path, "id long, x string, y string", ["id"], 16)
    assert table.read().count() == 0 and table.versions() == []
    assert table.upsert(spark.range(1000).selectExpr("id", "'a' AS x", "'b' AS y")) == 0 and len(files_of(path, 0)) == 16
    batch = spark.createDataFrame([(5, "c"), (2000, "d")], "id long, x string")
    assert table.upsert(batch) == 1 and 1 <= len(files_of(path, 1)) <= 2
    found = {r.id: (r.x, r.y) for r in table.read().collect()}
    assert len(found) == 1001 and found[5] == ("c", "b") and found[2000] == ("d", None) and found[6] == ("a", "b")
    assert table.read(0).count() == 1000  # the version before is there still
    assert {r.id for r in table.lookup(batch).collect()} == {5, 2000}
    assert table.upsert(batch, version=1) is None and table.upsert(batch.limit(0)) == 2 and table.read().count() == 1001
    assert table.delete(batch) == 3 and table.read().count() == 999
    assert table.vacuum(1) > 0 and table.read().count() == 999 and table.versions() == [3]
    with pytest.raises(Exception, match="a key is null"):
        table.upsert(spark.createDataFrame([(None, "z")], "id long, x string"))


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path):
    table = BucketedTable(spark, f"{tmp_path}/t", "id long, x string", ["id"], 4)
    table.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"))
    broken = spark.createDataFrame([(1, "c"), (3, "d")], "id long, x string").withColumn("x", F.when(F.col("id") == 3, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    assert {(r.id, r.x) for r in table.read().collect()} == {(1, "a"), (2, "b")}
    assert table.upsert(spark.createDataFrame([(1, "c")], "id long, x string")) == 1  # over what it had written
    assert {(r.id, r.x) for r in table.read().collect()} == {(1, "c"), (2, "b")}


def test_micro_batches_into_buckets(spark, tmp_path):
    table = BucketedTable(spark, f"{tmp_path}/t", "id int, x string, n int", ["id"], 8)
    for rows_ in ([(1, "a", 1), (2, "b", 1), (1, "z", 0)], [(2, "c", 2), (3, "d", 2)]):
        spark.createDataFrame(rows_, "id int, x string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.upsert_buckets(streams.stream_of(spark, f"{tmp_path}/in"), table, f"{tmp_path}/check", "n").trigger(availableNow=True).start().awaitTermination()
    assert {(r.id, r.x) for r in table.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert table.versions() == [0, 1] and len(files_of(f"{tmp_path}/t", 1)) <= 2


# ------------------------------------------------------------------ dumps


def sql(v):
    return "null" if v is None else str(v).lower() if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"


@pytest.mark.parametrize("size", [211, 5000, 1 << 25])
def test_dump_ranges(spark, tmp_path, size):
    rng = random.Random(1)
    texts = [None, "it's (x), y", "');\nINSERT INTO t (a) VALUES ('", "é日" * 5, "''", "(", "", "z" * 900, "null", "-- no ' comment"]
    made = [(i, rng.choice(texts), rng.choice([None, True, False]), rng.choice([1, 2.5, -3e-2, None])) for i in range(300)]
    text = "-- head\nCREATE TABLE t (a int, b text);\n"
    for k in range(0, 300, 90):
        text += 'INSERT INTO "public"."t" ("a", "b", "c", "d") VALUES ' + ",\n ".join(f"({', '.join(map(sql, r))})" for r in made[k : k + 90]) + ";\nSELECT setval('x', 1, true);\n"
    text += "INSERT INTO other (z) VALUES (1),\n(now()), (2);\nINSERT INTO public.t (b, a) VALUES ('late', 9001), ('bad'), ('x', 'text'), (7, 9002);\n"
    (tmp_path / "a.sql").write_text(text)
    df = dump.read_dump(spark, str(tmp_path / "a.sql"), "t", size)
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "boolean"), ("d", "double")]
    expected = [(a, b, c, None if d is None else float(d)) for a, b, c, d in made] + [(9001, "late", None, None), (9002, "7", None, None)]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, expected))
    bad = dump.read_dump(spark, f"file:{tmp_path}", "t", size, errors=True).collect()
    assert [(r.n, r.tuple) for r in sorted(bad, key=lambda r: r.at)] == [(1, "'bad'"), (2, "'x', 'text'")] and text.encode()[bad[0].at : bad[0].at + 1] == b"("
    assert df.rdd.getNumPartitions() == -(-len(text.encode()) // size)


def test_dump_without_the_first_pass(spark, tmp_path):
    (tmp_path / "a.sql").write_text("INSERT INTO o (`z`, [w]) VALUES (1, 'x'),\n(null, now());")
    spark.dataSource.register(dump.DumpSource)
    df = spark.read.format("sql_dump").load(str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (None, "now()")] and df.dtypes == [("z", "bigint"), ("w", "string")]
    (tmp_path / "a.sql").write_text("-- nothing")
    with pytest.raises(Exception, match="no INSERT"):
        dump.infer(str(tmp_path))


def test_updates_as_text(spark):
    df = spark.createDataFrame([(1, "it's", None), (None, "x", True)], "id int, token string, ok boolean")
    assert [r.sql for r in files.sql_updates(df, "companies", ["id"]).collect()] == ["UPDATE companies SET token = 'it''s', ok = NULL WHERE id = 1;"]


# ------------------------------------------------------------------ samples and titles


def test_samples_are_cut_before_the_shuffle(spark):
    boards = spark.createDataFrame([(1, 5, 10, True), (2, 5, 10, True), (3, 0, 0, False)], "board_id int, total int, global_total int, applied boolean")
    places = [(1, k, "Leeds" if k < 20 else "Paris") for k in range(400)] + [(2, k, ["Oslo", "remote", None, "3 Locations"][k % 4]) for k in range(12)]
    sampled = sync.with_samples(boards, spark.createDataFrame(places, "board_id int, pos int, location string"))
    assert {r.board_id: (r.n_uk, r.n_other) for r in sampled.collect()} == {1: (20, 0), 2: (0, 3), 3: (0, 0)}
    assert re.search("WindowGroupLimit .*, 20, Partial", sampled._jdf.queryExecution().executedPlan().toString())
    assert {r.board_id: (r.uses_facet, r.trusted) for r in sync.facet_trust(sampled).collect()} == {1: (True, True), 2: (False, False), 3: (False, True)}


def test_titles_are_judged_alike_with_the_text_bound(spark):
    cases = [None, "", "ab", "Cook", "  View All Jobs ", "careers at our company", "View all jobs in our very large and long named team", "Apply", "﻿Home "]
    got = [r.v for r in spark.createDataFrame([(c,) for c in cases], "t string").select(titles.valid_title(F.col("t")).alias("v")).collect()]
    assert got[:4] == [False, False, False, True] and got[4] is False and got[6] is True


# ------------------------------------------------------------------ grams behind ILIKE


def like(pattern):
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"%": "(?s:.*)", "_": "(?s:.)"}.get(c, re.escape(c))
        k += 1
    return re.compile(out)


def test_candidates_hold_every_match(spark):
    rng = random.Random(2)
    letters = "abcAB1é日Σσς %_"
    texts = [(k, None if k % 50 == 0 else "".join(rng.choices(letters, k=rng.randrange(12)))) for k in range(300)]
    patterns = [(k, None if k % 40 == 0 else "".join(rng.choices([*"abAé1Σ日 ", "%", "%", "_", "\\%", "\\_"], k=rng.randrange(7)))) for k in range(200)] + [(900, "%"), (901, ""), (902, "__")]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(patterns, "rule int, pattern string")
    pairs = {(r.id, r.rule) for r in grams.candidates(t, p).collect()}
    every = t.crossJoin(p).filter(F.ilike("text", F.col("pattern"))).collect()  # 300 x 200: what a nested loop finds
    assert {(r.id, r.rule) for r in every} <= pairs and len(every) > 200
    assert {(r.id, r.rule) for r in every} == {(i, k) for i, x in texts if x is not None for k, y in patterns if y is not None and like(y.lower()).fullmatch(x.lower())}


def test_ten_thousand_rules_without_a_nested_loop(spark):
    companies = spark.range(2000).select("id", F.concat(F.lit("Acme "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" Holdings")).alias("trading_name"), F.lit(None).cast("string").alias("ats_provider"), F.lit(None).cast("string").alias("ats_board_token"))
    rules = spark.range(10_000).select(F.col("id").cast("int").alias("rule_no"), F.concat(F.lit("%ACME_"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("%")).alias("pattern"), *[F.lit(None).cast(t).alias(c) for c, t in (("alt_pattern", "string"), ("not_pattern", "string"), ("max_length", "int"))], F.lit("x").alias("ats_provider"), F.col("id").cast("string").alias("ats_board_token"))
    out = merge.update_by_rules(companies, rules)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    assert {r.id: r.ats_board_token for r in out.collect()} == {k: str(k) for k in range(2000)}
    names = companies.select("id", F.col("trading_name").alias("text"))
    assert grams.candidates(names, rules.select(F.col("rule_no").alias("rule"), "pattern")).count() < 200_000  # of 20 million pairs


def test_indexed_search(spark, tmp_path):
    jobs = spark.createDataFrame([(1, 1, "Data Engineer"), (2, 1, "Cook"), (3, 2, None), (4, 2, "ΔΙΑΣ engineer"), (5, 3, "Engineering")], "id long, company_id long, title string")
    companies = spark.createDataFrame([(1, "Acme"), (2, "Engine Works"), (3, None)], "id long, trading_name string")
    index = grams.GramIndex(spark, f"{tmp_path}/g")
    assert index.segments() == []
    index.add("title", jobs.select("id", F.col("title").alias("text")).filter("id < 4"))
    index.add("title", jobs.select("id", F.col("title").alias("text")).filter("id >= 4"))
    index.add("company", companies.select("id", F.col("trading_name").alias("text")))
    ids = lambda term: sorted(r.id for r in grams.indexed_search(index, jobs, term).collect())
    assert ids("engine") == [1, 3, 4, 5] and ids("DATA%eer") == [1] and ids("zzz") == [] and ids("διας") == [4]
    assert ids("co") == [1, 2, 3, 4, 5]  # too short for the index: all rows, the feed's ILIKE decides
    opened = index.postings(index.grams_of("cook")).inputFiles()
    every = glob.glob(f"{tmp_path}/g/*/bucket=*/part-*.parquet")
    read = index.postings(index.grams_of("cook"))
    read.collect()
    assert len(every) > 20 and re.search(r"PartitionFilters: \[.*bucket.*IN \(\d+,\d+\)", read._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))), (len(opened), len(every))
    index.add("title", spark.createDataFrame([(2, "Head Cook")], "id long, text string"))  # a new text of a known row
    assert ids("head cook") == [2]


# ------------------------------------------------------------------ walks and counts


@pytest.mark.parametrize("sort", ["newest", "oldest", "title_asc", "title_desc"])
def test_a_walk_shows_every_row_once(spark, sort):
    rng = random.Random(sort)
    made = [(k, rng.choice([0, 0, 0, 0, 1, 2, 3]), rng.choice([None, "", "Cook", "cook", "Über", "日本", "z"]), rng.choice([None, *[BASE + dt.timedelta(minutes=rng.randrange(20)) for _ in range(3)]])) for k in range(140)]
    jobs = spark.createDataFrame(made, "id long, company_id long, title string, created_at timestamp").withColumns({c: F.lit("x") for c in ("location", "department")}).cache()
    companies = spark.createDataFrame([(k, f"c{k}", True) for k in range(4)], "id long, trading_name string, licensed_sponsor boolean")
    seen = keyset.Seen(spark.createDataFrame([(k,) for k in range(0, 140, 7)] + [(None,), (7,), (7,)], "id long"))
    walk, shown, excluded = keyset.Walk(), [], list(range(0, 140, 7))
    for number in range(200):
        page, after = keyset.next_page(jobs, companies, feed.FeedRequest(sort=sort), walk, seen)
        if number < 3:  # the page that a growing list of excluded ids gives
            whole = feed.page(jobs, companies, feed.FeedRequest(sort=sort, excluded_jobs=excluded)).orderBy("pos").collect()
            assert [r.id for r in whole] == [r["id"] for r in page]
        if not page:
            break
        assert after.cursor != walk.cursor and len(after.ahead) <= 500
        walk = after
        excluded += [r["id"] for r in page]
        shown += [r["id"] for r in page]
    assert sorted(shown) == [k for k in range(140) if k % 7]  # no gap, no repeat
    jobs.unpersist()


def test_a_million_seen_ids(spark, monkeypatch):
    ids = spark.range(1_000_000).select((F.col("id") * 2).alias("id"))
    rows_ = spark.createDataFrame([(k,) for k in (0, 1, 2, 32767, 32768, 32769, 65536, 1_999_998, 1_999_999, 2_000_000, -3, -2)], "id long")
    left = [1, 32767, 32769, 1_999_999, 2_000_000, -3, -2]
    dense = keyset.Seen(ids)
    assert dense.ids is None and dense.bitmaps.count() < 70 and sorted(r.id for r in dense.drop_from(rows_).collect()) == sorted(left)
    assert sorted(r.id for r in keyset.Seen(rows_.filter("id < 1")).drop_from(rows_).collect()) == sorted(r.id for r in rows_.filter("id > 0").collect())
    monkeypatch.setattr(keyset, "BITMAPS", 3)
    sparse = keyset.Seen(ids)
    assert sparse.bitmaps is None and sorted(r.id for r in sparse.drop_from(rows_).collect()) == sorted(left)


def test_counts_after_ten_syncs(spark, tmp_path):
    rng = random.Random(9)
    table = BucketedTable(spark, f"{tmp_path}/t", "company_id long, active_jobs_count long", ["company_id"], 8)
    schema, held = "id long, company_id long", {}
    before = spark.createDataFrame([], schema)
    for turn in range(10):
        for k in rng.sample(range(200), 25):
            held[k] = rng.choice([None, *range(12)])
        for k in rng.sample(sorted(held), min(len(held), 8)):
            del held[k]
        after = spark.createDataFrame(sorted(held.items()), schema)
        deltas = counts.changes(before, after, "id", "company_id")
        touched = {r.company_id for r in deltas.collect()}
        counts.apply(table, deltas, "company_id", version=turn)
        assert counts.apply(table, deltas, "company_id", version=turn) is None  # sent again: counted once
        full = {r.company_id: r["count"] for r in after.filter("company_id IS NOT NULL").groupBy("company_id").count().collect()}
        assert {r.company_id: r.active_jobs_count for r in table.read().filter("active_jobs_count > 0").collect()} == full
        assert len(files_of(f"{tmp_path}/t", turn)) <= len(touched)
        before = after
    with pytest.raises(Exception, match="negative"):
        counts.apply(table, spark.createDataFrame([(1, -99)], "company_id long, delta long"), "company_id")
