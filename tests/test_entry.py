"""The driver's contract: every query of the library against DuckDB on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from vacantia import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(tiny):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


def rows(df):
    cols = sorted(df.columns)
    clean = df[cols].astype(object).where(df[cols].notna(), None)
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return cols, sorted(str(tuple(number(x) for x in r)) for r in clean.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, duck, tiny, name):
    assert rows(queries.queries()[name](spark, tiny).toPandas()) == rows(duck.execute(oracle.SQL[name]).df())


def test_queries_without_sql_run(spark, tiny):
    for name in sorted(set(queries.queries()) - set(oracle.SQL)):
        queries.queries()[name](spark, tiny).toPandas()


def test_every_branch_is_in_the_tables(spark):
    from pyspark.sql import functions as F

    from vacantia import fixtures
    from vacantia.functions import rules, titles

    df = spark.createDataFrame([(t,) for t in fixtures.TITLES], "t string")
    got = df.select(titles.infer_level(F.col("t")).alias("level"), titles.infer_sector(F.col("t"), F.lit(None).cast("string")).alias("sector")).collect()
    assert {r.level for r in got} >= {name for name, _ in rules.LEVELS}
    assert {r.sector for r in got} >= {name for name, _ in rules.SECTORS}


def test_the_rest_works_without_the_pipeline(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); print(len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, capture_output=True).returncode == 0
