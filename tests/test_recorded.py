"""Queries over recorded responses and of detection runs, against DuckDB on the smallest tables; parts that have no table."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_entry import duck, rows  # noqa: F401
from vacantia import oracle_runs, queries_runs
from vacantia.operators import dedup, merge, runs
from vacantia.recorded import queries as recorded
from vacantia.recorded import sql
from vacantia.sources import html

ROOT = Path(__file__).resolve().parent.parent
SQL = oracle_runs.SQL | sql.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, tiny, name):  # noqa: F811
    from vacantia import queries

    found = queries.queries() | queries_runs.FOUND | recorded.queries()
    got = rows(found[name](spark, tiny).toPandas())
    assert got == rows(duck.execute(SQL[name]).df()) and got[1]


def test_every_query_has_sql():
    assert set(queries_runs.FOUND) | set(recorded.queries()) <= set(SQL)


def test_point_lookup(spark):
    two = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, x string")
    assert runs.only_row(two.filter("id = 2")).x == "c" and runs.only_row(two.filter("id = 3"), absent_is_fine=True) is None
    for wrong in ("id = 1", "id = 3"):
        with pytest.raises(LookupError):
            runs.only_row(two.filter(wrong))


def test_write_check(spark):
    mine = spark.createDataFrame([("u1", 1), ("u1", 2)], "user_id string, job int")
    assert merge.checked(mine, F.col("user_id") == "u1").count() == 2
    with pytest.raises(Exception, match="row-level rule"):
        merge.checked(mine.union(mine.withColumn("user_id", F.lit("u2"))), F.col("user_id") == "u1").collect()


def test_last_company_has_a_shared_url(spark):
    from vacantia.operators import sync

    postings = spark.createDataFrame([(1, "Data Engineer", "London", "https://x.test/1", None, 1), (2, "Data Engineer", "London", "https://x.test/1", None, 2)], "company_id int, title string, location string, url string, department string, pos int")
    jobs = spark.createDataFrame([], "url string, company_id int, title string, location string, department string, level string, sector string")
    assert [r.company_id for r in sync.sync(jobs, postings.select("company_id"), postings)[0].collect()] == [2]


def test_greedy_splits_a_hot_group(spark):
    rows_ = [(1, f"k{i // 3}", f"u{i % 50}", i) for i in range(400)]
    got = sorted(r.pos for r in dedup.greedy(spark.createDataFrame(rows_, "g int, k string, u string, pos int"), "g", "k", "u", "pos").collect())
    keys, urls, kept = set(), set(), []
    for _, k, u, i in rows_:
        if k not in keys and u not in urls:
            keys.add(k)
            urls.add(u)
            kept.append(i)
    assert got == kept


def test_plausible_titles_agree_with_the_column(spark):
    from vacantia.functions import titles

    texts = ["Ab", "Cook", "View job", "view all jobs today", "Careers", " Home ", "See all jobs in the very long list of our openings", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(titles.valid_title(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [html.plausible_title(t) for t in texts]


def test_all_test_modules_are_collected():
    done = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", str(ROOT / "tests")], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-2000:]


def test_dump_columns_errors_and_statements(spark, tmp_path):
    from vacantia.sources import files

    text = "INSERT INTO t (`a`, \"b\") VALUES ('it''s', 1), ('short'), (true, null);"
    (tmp_path / "d.sql").write_text(text)
    assert files.dump_columns(text) == ["a", "b"]
    assert [tuple(r) for r in files.sql_dump_errors(spark, str(tmp_path / "d.sql"), 2).collect()] == [(1, '["short"]')]
    df = spark.createDataFrame([("it's", 1, None, True)], "a string, b int, c string, d boolean")
    assert files.sql_inserts(df, "t").first().sql == "INSERT INTO t (a, b, c, d) VALUES ('it''s', 1, NULL, true);"
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().asDict() == {"a": "it's", "b": 1, "d": True}
    typed = spark.createDataFrame([("1.5",), ("TRUE",), ("x",), (None,)], "t string").select(files.typed_literal(F.col("t")).alias("v")).collect()
    assert [(r.v.number, r.v.flag) for r in typed] == [(1.5, None), (None, True), (None, None), (None, None)]
