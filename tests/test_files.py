"""File sources and sinks, reports and small lookups."""

import json

import pytest

from pyspark.sql import functions as F

from test_entry import duck, rows  # noqa: F401
from vacantia import oracle_files, queries_files
from vacantia.plans import access
from vacantia.sources import files


@pytest.mark.parametrize("name", sorted(queries_files.FOUND))
def test_query_equals_sql(spark, duck, tiny, name):  # noqa: F811
    assert rows(queries_files.FOUND[name](spark, tiny).toPandas()) == rows(duck.execute(oracle_files.SQL[name]).df())


def test_lines_with_odd_quotes(spark, tmp_path):
    def loop(line):  # quotes toggle wherever they stand, doubled ones within are one
        out, now, inside, k = [], "", False, 0
        while k < len(line):
            c = line[k]
            if c == '"':
                if inside and line[k + 1 : k + 2] == '"':
                    now, k = now + '"', k + 1
                else:
                    inside = not inside
            elif c == "," and not inside:
                out, now = [*out, now], ""
            else:
                now += c
            k += 1
        return [*out, now]

    lines = ['a,"b,""c""",d', '""', ',,', '"open, to the end', 'x"y,"z,w"v', 'a""b,c', '"a""', '"""",""""""', "é,日", "one", '"' + "x," * 5000 + '"', "a,b,c,d,e"]
    (tmp_path / "t.csv").write_text("p,q,r,s\n" + "\n".join(lines))
    got = [list(r) for r in files.read_line_csv(spark, str(tmp_path / "t.csv"), ["p", "q", "r", "s"]).collect()]
    assert got == [(loop(x) + [None] * 4)[:4] for x in lines]


def test_one_array_over_several_files(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('q"\n'), "id")).alias("x"), F.array("id").alias("a")).repartition(7)
    files.write_json_array(df, f"{tmp_path}/j", ["id"])
    whole = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*")))
    assert json.loads(whole) == [{"id": k, "x": f'q"\n{k}' if k % 3 else None, "a": [k]} for k in range(1000)]
    files.write_json_array(df.limit(0), f"{tmp_path}/e", ["id"])
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*")))) == []


def test_blanks_at_the_ends_survive(spark, tmp_path):
    df = spark.createDataFrame([(" a ", "\tb")], "x string, y string")
    files.write_csv(df, f"{tmp_path}/c")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c", ["x", "y"]).collect()] == [(" a ", "\tb")]


def test_reports_need_a_user_and_an_administrator(spark):
    reported = spark.createDataFrame([(1, 5, "u", None), (2, 5, "v", "x"), (3, 6, "u", None)], "id long, job_id long, user_id string, notes string")
    jobs = spark.createDataFrame([(5,), (6,)], "id long")
    with pytest.raises(PermissionError):
        access.report(reported, 5, None)
    assert tuple(access.report(reported, 6, "w", "").filter("id = 4").first()) == (4, 6, "w", None)
    narrow = access.report(reported.drop("user_id"), 6, "w", "n")
    assert narrow.columns == ["id", "job_id", "notes"] and narrow.count() == 4
    for role, email in (("anon", "a@x"), ("authenticated", "other@x"), ("authenticated", None)):
        with pytest.raises(PermissionError):
            access.dismiss(reported, 1, role, email, ["a@x"])
        with pytest.raises(PermissionError):
            access.delete_reported(jobs, reported, 1, role, email, ["a@x"])
    assert access.dismiss(reported, 1, "authenticated", " A@X", ["a@x"]).count() == 2
    left, rest = access.delete_reported(jobs, reported, 1, "service", None, [])
    assert [r.id for r in left.collect()] == [6] and [r.id for r in rest.collect()] == [3]
    assert access.report(reported.limit(0), 1, "u").first().id == 1
