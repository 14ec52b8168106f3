"""Plans and steps that hold at larger tables: what is broadcast, what reaches the driver, what one task takes."""

from pyspark.sql import functions as F

from vacantia import queries_files, queries_runs, queries_state, tables
from vacantia.operators import grams, merge, runs
from vacantia.plans import keyset

RULES = "rule_no int, pattern string, alt_pattern string, not_pattern string, max_length int, ats_provider string, ats_board_token string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def companies_file(spark, path):
    made = spark.range(3000).select("id", F.concat(F.lit("Acme "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("trading_name"), F.lit("p").alias("ats_provider"), F.lit("t").alias("ats_board_token"))
    made.coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_rules_are_broadcast_and_not_names(spark, tmp_path, monkeypatch):
    companies = companies_file(spark, tmp_path / "c")
    rules = spark.createDataFrame([(1, "%0001%", None, None, None, "x", "1"), (2, "%7_", "%99%", "%98%", 30, "y", "2")], RULES)
    out = merge.update_by_rules(companies, rules)
    joins = [line for line in plan(out).splitlines() if "Join" in line and "Inner" in line]
    assert len(joins) == 2 and all("BroadcastHashJoin" in line and "BuildRight" in line for line in joins), joins
    found = {tuple(r) for r in out.collect()}
    monkeypatch.setattr(tables, "SMALL_ROWS", 1)
    many = merge.update_by_rules(companies, rules)
    assert all("SortMergeJoin" in line for line in plan(many).splitlines() if "Join" in line and "Inner" in line)
    assert {tuple(r) for r in many.collect()} == found and len(found) == 3000 and sum(r[2] != "p" for r in found) > 300


def test_wanted_names_are_broadcast_and_not_names(spark, tmp_path):
    companies = companies_file(spark, tmp_path / "c")
    out = runs.set_first_by_name(companies, spark.createDataFrame([(1, "0012", "x", "1"), (2, "12", "y", "2"), (3, "none", "z", "3")], "n int, name string, ats_provider string, ats_board_token string"))
    joins = [line for line in plan(out).splitlines() if "Join" in line and "Inner" in line]
    assert len(joins) == 2 and all("BuildRight" in line for line in joins), joins
    assert {r.id: r.ats_board_token for r in out.collect() if r.ats_provider != "p"} == {12: "2"}


def test_names_are_dealt_before_they_are_exploded(spark, tmp_path):
    names = companies_file(spark, tmp_path / "c").select("id", F.col("trading_name").alias("text"))
    pairs = grams.candidates(names, spark.createDataFrame([(1, "%me 0%")], "rule int, pattern string"))
    assert names.rdd.getNumPartitions() == 1 and pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_deliveries_do_not_pass_through_the_driver(spark, tiny):
    plans = queries_files.redelivered_events(spark, tiny)
    assert "FileScan parquet" in plan(plans) and "MemoryPlan" not in plan(plans) and "LocalTableScan" not in plan(plans)
    every = {r.event_type: r.n for r in spark.read.parquet(f"{tiny}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.event_type: r.n for r in plans.collect()} == every


def test_pairs_are_dealt_once_and_not_sorted_by_the_file(spark, tiny):
    text = plan(queries_runs.heuristic_probe(spark, tiny))
    assert text.count("REPARTITION_BY_NUM") == 1 and "Sort" not in text[text.index("REPARTITION_BY_NUM") :], text


def test_ranges_follow_the_postings(spark, tmp_path, monkeypatch):
    names = companies_file(spark, tmp_path / "c").select("id", F.col("trading_name").alias("text"))  # 9 grams each
    monkeypatch.setattr(grams, "RANGE_ROWS", 1000)
    index = grams.GramIndex(spark, f"{tmp_path}/g")
    index.add("title", names)
    sizes = [r.n for r in spark.read.parquet(index.segments()[0]).groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) > 20_000 and max(sizes) < 5000, sizes
    found = index.having("title", index.grams_of("Acme 0012"))
    ids = {r.id for r in found.collect()}
    assert ids >= set(range(1200, 1300)) and len(ids) < 150 and "REPARTITION_BY_NUM" in plan(found)


def test_having_of_more_grams_than_bits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grams, "BITS", 3)
    index = grams.GramIndex(spark, f"{tmp_path}/g")
    index.add("title", spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefgx"), (3, None)], "id long, text string"))
    index.add("title", spark.createDataFrame([(1, "abcdefgh")], "id long, text string"))
    assert [[r.id for r in index.having("title", index.grams_of(t)).collect()] for t in ("abcdefgh", "zabcdefgh")] == [[1], []]


def test_a_walk_joins_and_broadcasts_once(spark, tiny, monkeypatch):
    made, kept = [], keyset.Seen.drop_from
    monkeypatch.setattr(keyset.Seen, "drop_from", lambda self, rows: made.append(1) or kept(self, rows))
    assert queries_state.keyset_pages(spark, tiny).count() == 160 and len(made) == 1


def test_search_hits_are_dealt_by_row(spark, tiny):
    text = plan(queries_runs.search_hit_match(spark, tiny))
    assert "REPARTITION_BY_NUM" in text and "(?i)" not in text[text.index("REPARTITION_BY_NUM") :]  # the patterns come after it
