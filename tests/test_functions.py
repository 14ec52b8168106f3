"""Rule functions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from vacantia.functions import location as L
from vacantia.functions import titles, tokens, urls
from vacantia.operators import detect
from vacantia.plans import feed


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


EVIDENCE = "locations array<string>, is_remote boolean, is_trusted_source boolean"


@pytest.mark.parametrize("locations, remote, trusted, expected", [
    ([], False, True, True), ([], True, False, True), (["London"], False, False, True), (["United Kingdom"], False, False, True),
    (["New York", "London", "Singapore"], False, False, True), (["New York", "Singapore", "Dubai"], False, False, False), (["California"], False, False, False),
    (["Global"], False, False, True), (["EMEA"], False, False, True), ([], False, False, False), (["Northern Ireland"], False, False, True),
    (["Remote UK"], False, False, True), (["Dublin"], False, False, False), (["Remote"], False, False, True),
    # a UK word beats everything else in the same evidence
    (["Cambridge, Massachusetts"], False, False, True), (["Perth, Australia"], False, False, True), (["New South Wales"], False, False, True),
    (["York"], False, False, True), (["New York"], False, False, False), (["York, New York"], False, False, False), (["EC2V 8RF"], False, False, True),
    (["U.K."], False, False, False), (["3 Locations"], False, False, True), (["Multiple Locations"], False, False, True),
    (["India - Northern Ireland"], False, False, True), (["India", "Remote"], False, False, False), (["éuk"], False, False, True), (None, None, None, False), ([None, ""], False, False, False),
])
def test_is_uk_job(spark, locations, remote, trusted, expected):
    assert one(spark, EVIDENCE, (locations, remote, trusted), L.is_uk_job(F.struct("locations", "is_remote", "is_trusted_source"))) is expected


@pytest.mark.parametrize("text, expected", [
    ("Remote", False), ("Cork", False), ("Cork / London", True), ("London, UK", True), ("UK", False), ("WA1 2AB", True), ("Reading, PA", False), ("England", True), ("", False), (None, False),
])
def test_is_uk_location_v1(spark, text, expected):
    assert one(spark, "t string", (text,), L.is_uk_location_v1(F.col("t"))) is expected


def test_bare_uk_in_the_other_predicates(spark):
    df = spark.createDataFrame([("UK",), ("Ukraine",), ("gbx",)], "t string")
    got = df.select(*(f(F.col("t")) for f in (L.is_uk_location_v2, L.is_uk_location_v3, L.is_uk_location_v4))).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, True), (False, False, True)]


def test_default_evidence(spark):
    df = spark.createDataFrame([("London | New York",), ("A · B • C",), ("Leeds",), ("",), (None,), ("Remote - UK",)], "t string")
    got = [(r.x.locations, r.x.is_remote) for r in df.select(L.default_evidence(F.col("t")).alias("x")).collect()]
    assert got == [(["London", "New York"], False), (["A", "B", "C"], False), (["Leeds"], False), ([], False), ([], False), (["Remote - UK"], True)]


def test_normalize_location(spark):
    assert one(spark, "t string", (" (London)  /[UK]; a_b|c ",), L.normalize_location(F.col("t"))) == "london uk a b c"


@pytest.mark.parametrize("title, level", [
    ("Lead Director", "Director"), ("CTO", "Executive"), ("Senior VP", "VP"), ("Sr. Engineer", "Senior"), ("Entry-level Cook", "Graduate"), ("Internal Auditor", "Mid-level"), ("Cook", "Mid-level"), ("", None), (None, None),
])
def test_level(spark, title, level):
    assert one(spark, "t string", (title,), titles.infer_level(F.col("t"))) == level


@pytest.mark.parametrize("title, dept, sector", [("Data Engineer", None, "Data"), ("Engineer", "", "Engineering (Other)"), ("Gardener", "Finance", "Finance"), ("R&D Lead", None, "Research (Technical)"), ("Gardener", None, None), (" ", "Data", None)])
def test_sector(spark, title, dept, sector):
    assert one(spark, "t string, d string", (title, dept), titles.infer_sector(F.col("t"), F.col("d"))) == sector


@pytest.mark.parametrize("title, ok", [("See all jobs in London", False), ("Careers", False), ("Careers adviser for the whole of the northern region", True), ("ab", False), (None, False), ("Cook", True)])
def test_valid_title(spark, title, ok):
    assert one(spark, "t string", (title,), titles.valid_title(F.col("t"))) is ok


@pytest.mark.parametrize("token, invalid", [("www", True), ("12345", True), ("deadbeef01", True), ("a", True), ("__assets__", True), ("my-co", False), (None, True)])
def test_token_validity(spark, token, invalid):
    assert one(spark, "t string", (token,), tokens.is_invalid(F.col("t"))) is invalid


@pytest.mark.parametrize("token, name, score", [("acme", "Acme", 10), ("acme", "Acme Ltd", 10), ("acmx", "acme", 5), ("zzzz", "acme", 0), (None, "a", 0)])
def test_similarity(spark, token, name, score):
    assert one(spark, "t string, n string", (token, name), tokens.similarity(F.col("t"), F.col("n"))) == score


def test_variants_and_cells(spark):
    assert one(spark, "t string", ("Acme Ltd_7/",), tokens.variants(F.col("t"))) == ["acme ltd_7", "acme-ltd-7", "acme ltd", "acme-ltd"]
    df = spark.createDataFrame([("n/a",), ("﻿x",), ("a â€” b",), (" - ",)], "t string")
    assert [r.x for r in df.select(tokens.clean_cell(F.col("t")).alias("x")).collect()] == [None, "x", "a - b", None]


@pytest.mark.parametrize("url, hit", [
    ("https://boards.greenhouse.io/acme/jobs", ("greenhouse", "acme")), ("boards.greenhouse.io/embed?for=x", ("greenhouse", "embed")), ("https://boards.greenhouse.io/?for=x", ("greenhouse", "x")),
    ("https://nu.wd3.myworkdayjobs.com/Board", ("workday", "nu/Board")), ("https://nu.wd3.myworkdayjobs.com/en-GB/Board", ("workday", "https://nu.wd3.myworkdayjobs.com/en-GB/Board")),
    ("example.org", ("generic_careers", "https://example.org")), ("", None), (None, None),
])
def test_inference(spark, url, hit):
    got = one(spark, "u string", (url,), urls.infer_v1(F.col("u")))
    assert (tuple(got) if got else None) == hit


def test_job_url(spark):
    assert one(spark, "u string", ("https://api.smartrecruiters.com/v1/companies/A/postings/1",), urls.public_job_url(F.col("u"))) == "https://jobs.smartrecruiters.com/A/1"


def test_fingerprints(spark):
    rows = [(1, 0, "https://www.breezy.hr/x"), (1, 1, "see jobs.lever.co/acme"), (1, 2, "boards.greenhouse.io/Beta"), (2, 0, "https://www.recruitee.com"), (3, 0, "nothing")]
    got = {r.company_id: (r.provider, r.token, r.valid) for r in detect.fingerprint_scan(spark.createDataFrame(rows, "company_id int, pos int, source string")).collect()}
    assert got == {1: ("greenhouse", "beta", True), 2: ("recruitee", "www", False)}


def test_best_link(spark):
    rows = [(1, 0, "https://a.test/about", "About"), (1, 1, "https://a.test/careers", "Careers"), (1, 2, "https://a.test/careers2", "careers"), (1, 3, "https://a.test/", "jobs")]
    got = detect.best_careers_link(spark.createDataFrame(rows, "page_id int, pos int, url string, text string")).collect()
    assert [(r.url, r.score) for r in got] == [("https://a.test/careers", 7)]


def test_gate(spark):
    row = ("zz9", "Acme", "https://x.test/acme", "https://acme.test", 404)
    cols = [F.col(c) for c in "tnsuc"]
    schema = "t string, n string, s string, u string, c int"
    assert one(spark, schema, row, detect.gate(*cols)).note == "crawl_weak_evidence"
    assert one(spark, schema, ("acme", *row[1:]), detect.gate(*cols)).note == "crawl_probe_bad_token"
    assert tuple(one(spark, schema, ("acme", *row[1:4], 200), detect.gate(*cols))) == ("ok", "source")


def test_search_terms():
    assert feed.search_term("  a(b),c" + "x" * 200) == "abc" + "x" * 94
    assert feed.type_words(["Full-time"]) == [] and feed.sector_words(["Data", "Nope"])[-2:] == ["Data", "Nope"]
    assert feed.expand_locations(["Rest of UK", "Bath"])[-2:] == ["Reading", "Bath"]
