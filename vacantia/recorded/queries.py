"""Queries over recorded responses: every supplier row is given one of its provider's responses in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import read
from ..sources import adapters, providers
from . import payloads as P


def dealt(spark: SparkSession, sf_dir: str, provider: str, token: str, recorded: list) -> DataFrame:
    """company_id, provider, token, payload: response number s_suppkey modulo their count, broken ones among them."""
    texts = [*map(P.as_text, recorded), *P.BAD]
    rows = spark.createDataFrame([(k, provider, token, x) for k, x in enumerate(texts)], "k int, provider string, token string, payload string")
    companies = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("company_id"), (F.col("s_suppkey") % len(texts)).cast("int").alias("k"))
    return companies.join(F.broadcast(rows), "k").drop("k")


def _normalised(provider: str, entry: tuple):
    def run(spark, sf_dir):
        found = providers.normalize(dealt(spark, sf_dir, provider, *entry))
        return found.select("company_id", F.col("pos").cast("long").alias("pos"), "title", "location", "url", "department")

    return run


def _adapted(provider: str, recorded: list):
    def run(spark, sf_dir):
        raw = dealt(spark, sf_dir, provider, "", recorded).filter(F.try_parse_json("payload").isNotNull())
        e = raw.select("company_id", adapters.adapt(F.col("provider"), F.try_parse_json("payload")).alias("e")).filter("e is not null")
        return e.select("company_id", F.array_join("e.locations", "|").alias("locations"), F.coalesce("e.is_remote", F.lit(False)).alias("is_remote"), F.coalesce("e.is_trusted_source", F.lit(False)).alias("is_trusted"))

    return run


#: Names of the queries whose provider is known by another name.
ALIAS = {"teamtailor_feed": "teamtailor", "jobvite_html": "jobvite"}


def queries() -> dict:
    found = {f"normalize_{p}": _normalised(ALIAS.get(p, p), entry) for table in (P.JSON, P.FEEDS, P.PAGES) for p, entry in table.items()}
    found["normalize_generic_careers"] = _normalised("generic_careers", P.CAREERS)
    found |= {f"adapt_{p}": _adapted(p, recorded) for p, recorded in P.ADAPTED.items()}
    return found
