"""File sources and sinks: delimited text, JSON documents, SQL dumps, outcome buckets."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..functions.values import js_trim
from ..operators.merge import with_sequence


def read_csv(spark: SparkSession, path: str, columns: list[str], strict: bool = True) -> DataFrame:
    """Header and quotes (doubled inside), line breaks in quotes; all columns as text.

    strict: a malformed row fails the read; else it is kept as far as it could be read.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("enforceSchema", False).csv(path)


def read_naive_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Split at commas only: quotes are text, and a comma in them breaks the field."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("quote", "").csv(path)


def read_line_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A line that equals ``columns`` is a header. Quoted fields, a line a row: quotes may open anywhere in a field, are doubled inside, and end with the line.

    A missing field is null, further fields are left out.
    """
    quoted = r'"[^"]*+(?:""[^"]*+)*+(?:"|$)'
    fields = F.regexp_extract_all(F.concat(F.lit(","), "value"), F.lit(rf',((?:[^",]++|{quoted})*+)'), F.lit(1))
    plain = F.transform(fields, lambda x: F.replace(F.regexp_replace(x, r'"([^"]*+(?:""[^"]*+)*+)(?:"|$)', "$1"), F.lit('""'), F.lit('"')))
    rows = spark.read.text(path).filter("value <> ''").select(plain.alias("c")).filter(F.col("c") != F.array(*map(F.lit, columns)))
    return rows.select(*[F.try_element_at("c", F.lit(k + 1)).alias(c) for k, c in enumerate(columns)])


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Sponsor register rows with a name, under short column names."""
    df = read_csv(spark, path, ["Organisation Name", "Town/City", "County", "Type & Rating", "Route"])
    names = ["organisation", "town", "county", "rating", "route"]
    return df.toDF(*names).filter(js_trim(F.col("organisation")) != "")


def read_processed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids in the first field of bucket files; lines without a number are left out."""
    first = F.expr("try_cast(trim(split(value, ',')[0]) AS bigint)")
    return spark.read.text(path).select(first.alias("id")).filter("id is not null").distinct()


def read_companies_json(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Documents of the form {"data": {"companies": [...]}} as rows of text fields."""
    item = ", ".join(f"`{f}`: string" for f in fields)
    df = spark.read.schema(f"data struct<companies: array<struct<{item}>>>").option("multiLine", True).json(path)
    return df.select(F.explode("data.companies").alias("c")).select("c.*")


def _as_is(writer: DataFrameWriter) -> DataFrameWriter:
    """Quotes doubled, blanks at the ends kept (Spark's writer drops them otherwise)."""
    return writer.option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def write_csv(df: DataFrame, path: str) -> None:
    _as_is(df.write).option("header", True).csv(path)


def append_buckets(outcomes: DataFrame, path: str) -> None:
    """Outcome rows appended to a folder per bucket."""
    _as_is(outcomes.write.mode("append").partitionBy("bucket")).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, null fields left out."""
    df.write.json(path)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """One pretty-printed JSON array, null fields kept, rows by ``order``: part files of ``path`` that are the array when put together by name.

    Nothing is gathered: rows are range-sorted, every row but the first brings the comma before it.
    """
    body = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    shown = with_sequence(df.select(body.alias("body"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(order)]), "__n", [f"__{k}" for k in range(len(order))])
    ends = df.sparkSession.createDataFrame([(0, "["), ((1 << 62), "]")], "__n long, line string")
    indented = F.concat(F.when(F.col("__n") > 1, ",\n").otherwise(""), F.lit("  "), F.regexp_replace("body", "\n", "\n  "))
    lines = shown.select(F.col("__n").cast("long").alias("__n"), indented.alias("line")).unionByName(ends)
    lines.repartitionByRange("__n").sortWithinPartitions("__n").select("line").write.text(path)


def _literal(field) -> Column:
    """A value as SQL: numbers and booleans bare, other types quoted with doubled quotes, NULL."""
    plain = ("byte", "short", "integer", "long", "float", "double", "boolean")
    c = F.col(field.name).cast("string")
    quoted = c if field.dataType.typeName() in plain or field.dataType.typeName().startswith("decimal") else F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(quoted, F.lit("NULL"))


def sql_inserts(df: DataFrame, table: str) -> DataFrame:
    """sql: an INSERT statement for each row."""
    values = F.concat_ws(", ", *map(_literal, df.schema))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("sql"))


def sql_updates(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """sql: an UPDATE statement for each row, found by ``keys``; rows with a null key give none."""
    of = {f.name: f for f in df.schema}
    sets = F.concat_ws(", ", *(F.concat(F.lit(f"{c} = "), _literal(of[c])) for c in df.columns if c not in keys))
    where = F.concat_ws(" AND ", *(F.concat(F.lit(f"{c} = "), _literal(of[c])) for c in keys))
    return df.na.drop(subset=keys).select(F.concat(F.lit(f"UPDATE {table} SET "), sets, F.lit(" WHERE "), where, F.lit(";")).alias("sql"))


def write_dump(df: DataFrame, table: str, path: str) -> None:
    """A folder of dump files, each with one INSERT statement over all its rows."""
    columns = ", ".join(f'"{c}"' for c in df.columns)
    tuple_ = F.concat(F.lit("("), F.concat_ws(", ", *map(_literal, df.schema)), F.lit(")"))
    id_ = F.monotonically_increasing_id()
    first = id_.bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition, which is a file
    df.select(F.concat(F.when(first, f'INSERT INTO "{table}" ({columns}) VALUES ').otherwise(","), tuple_).alias("value")).write.text(path)


_TOKEN = re.compile(r"'((?:[^']|'')*)'|([(),])|([^\s(),']+)")


def sql_tuples(text: str) -> Iterator[list[str | None]]:
    """Value tuples of INSERT statements: quoted texts with doubled quotes, bare literals, null."""
    values = text[m.end() :] if (m := re.search(r"\bVALUES\b", text, re.IGNORECASE)) else ""
    row, depth = [], 0
    for quoted, mark, bare in _TOKEN.findall(values):
        if mark == "(":
            depth += 1
            row = [] if depth == 1 else row
        elif mark == ")":
            depth -= 1
            if depth == 0:
                yield row
        elif mark == ",":
            continue
        elif depth == 1:
            row.append(quoted.replace("''", "'") if not bare else None if bare.lower() == "null" else bare)


def dump_columns(text: str) -> list[str]:
    """The column list of the first INSERT statement, without quotes; none: empty."""
    m = re.search(r"\bINSERT\s+INTO\s+[^\s(]+\s*\(([^)]*)\)\s*VALUES\b", text, re.IGNORECASE)
    return [c.strip().strip('`"[]') for c in m[1].split(",")] if m else []


def typed_literal(text):
    """struct<number, flag, text> of a dump's literal: at most one of number and flag is there besides the text."""
    low = F.lower(text)
    return F.struct(text.try_cast("double").alias("number"), F.when(low == "true", True).when(low == "false", False).alias("flag"), text.alias("text"))


def sql_dump_errors(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Tuples of dump files that have not ``width`` values: file number of values and the values as JSON."""

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                bad = [r for r in sql_tuples(text) if len(r) != width]
                yield pa.RecordBatch.from_arrays([pa.array([len(r) for r in bad], pa.int32()), pa.array([json.dumps(r) for r in bad], pa.string())], ["n", "tuple"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "n int, tuple string")


def read_sql_dump(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of dump files as text columns; each file is parsed by one task, files in parallel.

    Tuples with another number of values are rows of ``sql_dump_errors``.
    """

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = [r for r in sql_tuples(text) if len(r) == len(columns)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns))], columns)

    return spark.read.text(path, wholetext=True).mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


_TEXT = r'"[^"\\]*(?:\\.[^"\\]*)*"'


def salvage_json(text):
    """The JSON object in a generated answer: fences off, first brace to last; only where that is no JSON
    are raw line breaks and tabs inside its texts escaped."""
    body = F.regexp_extract(F.regexp_replace(text, "(?i)```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    whole = F.regexp_extract_all(body, F.lit(f"(?s){_TEXT}"), F.lit(0))
    escaped = F.transform(whole, lambda t: F.replace(F.replace(F.replace(t, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")))
    between = F.split(body, f"(?s){_TEXT}")
    joined = F.array_join(F.zip_with(between, escaped, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(joined))
