"""Payload normalisers, adapters and files."""

import json

import pytest
from pyspark.sql import functions as F

from vacantia.sources import adapters, files, html, providers

LD = '<script type="application/ld+json">{"@type":"JobPosting","title":"LD","url":"x","jobLocation":{"address":{"addressLocality":"Hull","addressCountry":"GB"}}}</script>'
STATE = {"props": {"pageProps": {"dehydratedState": {"queries": [{"state": {"data": {"items": [{"name": "R", "id": "9", "locations": [{"name": "a"}, {"city": "b"}]}]}}}]}}}}
JAZZ = '<li class="list-group-item"><h3 class="list-group-item-heading"><a href="/apply/1">Cook</a></h3><ul class="list-inline"><li>* London</li><li>Kitchen</li></ul></li>'
CASES = [
    ("greenhouse", "t", {"jobs": [{"title": "A", "location": {"name": "X"}, "offices": [{"name": "London"}, {"location": "Paris"}], "absolute_url": "u", "departments": [{"name": "D"}]}]}, [("A", "London | Paris", "u", "D")]),
    ("ashby", "t", {"jobs": [{"title": "A", "location": "London", "secondaryLocations": [{"location": "Leeds"}], "isRemote": True, "jobUrl": "z"}]}, [("A", "London Leeds Remote", "z", "")]),
    ("lever", "t", [{"title": "E", "postings": [{"text": "T", "categories": {"location": "L", "team": "tm"}, "hostedUrl": "h"}]}], [("T", "L", "h", "tm")]),
    ("lever", "t", [{"text": "T", "workplaceType": "remote", "hostedUrl": "h"}], [("T", "remote", "h", "")]),
    ("workable", "t", {"jobs": [{"title": "W", "city": "Bath", "country": "UK", "shortcode": "S"}]}, [("W", "Bath, UK", "https://apply.workable.com/j/S", "")]),
    ("teamtailor", "t", {"data": [{"attributes": {"title": "T", "human-location": "H"}, "links": {"careersite-job-url": "c"}}]}, [("T", "H", "c", "")]),
    ("smartrecruiters", "t", {"content": [{"name": "S", "id": 4, "location": {"city": "Hull", "country": "gb"}}]}, [("S", "Hull gb", "https://jobs.smartrecruiters.com/t/4", "")]),
    ("breezy", "t", [{"name": "N", "location": {"name": "L"}, "url": "u"}], [("N", "L", "u", "")]),
    ("workday", "nu/Board", {"jobPostings": [{"title": "W", "externalPath": "/job/x", "bulletFields": ["r", "London"]}]}, [("W", "London", "https://nu.myworkdayjobs.com/Board/job/x", "")]),
    ("rippling", "t", f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(STATE)}</script>', [("R", "a, b", "https://ats.rippling.com/t/jobs/9", "")]),
    ("gem", "t", [{"data": {"oatsExternalJobPostings": {"jobPostings": [{"title": "G", "id": 5, "locations": [{"city": "Bath"}]}]}}}], [("G", "Bath", "https://jobs.gem.com/t/5", "")]),
    ("mercor", "t", {"listings": [{"listingId": "7", "title": "C++ Dev (x)"}]}, [("C++ Dev (x)", "", "https://work.mercor.com/jobs/7/c-dev-x", "")]),
    ("amazon", "t", {"jobs": [{"title": "a", "country_code": "US"}, {"title": "b", "country_code": "GBR", "city": "Hull", "job_path": "/p"}]}, [("b", "Hull", "https://www.amazon.jobs/p", "Various")]),
    ("icims", "ic", {"results": [{"JobTitle": "I", "JobId": 3}]}, [("I", "", "https://ic.icims.com/jobs/3/job", "")]),
    ("personio", "p", "<x><position><name>Dev</name><office>Berlin</office></position></x>", [("Dev", "Berlin", "https://p.jobs.personio.de", "")]),
    ("teamtailor", "t", "<rss><item><title>A</title><description>x · London</description><link>l</link><category>K</category></item></rss>", [("A", "London", "l", "K")]),
    ("jazzhr", "j", JAZZ, [("Cook", "London", "https://j.applytojob.com/apply/1", "Kitchen")]),
    ("generic_careers", "g", LD, [("LD", "Hull, GB", "x", "")]),
    ("greenhouse", "t", "no json", []), ("greenhouse", None, "", []), ("unheard_of", "t", {"jobs": [{"title": "A"}]}, []),
]


def test_normalisers(spark):
    rows = [(i, p, t, v if isinstance(v, str) else json.dumps(v)) for i, (p, t, v, _) in enumerate(CASES)]
    found = {i: [] for i in range(len(CASES))}
    for r in providers.normalize(spark.createDataFrame(rows, "company_id long, provider string, token string, payload string")).orderBy("company_id", "pos").collect():
        found[r.company_id].append((r.title, r.location, r.url, r.department))
    for i, case in enumerate(CASES):
        assert found[i] == case[3], case[:3]


def test_every_provider_has_a_shape():
    assert len(set(providers.SHAPES) | set(html.CARDS) | {"personio", "generic_careers"}) >= 41
    assert len(adapters.ADAPTERS) == 17


@pytest.mark.parametrize("provider, raw, locations, remote, trusted", [
    ("greenhouse", {"location": {"name": "London"}, "offices": [{"name": "London", "location": "Remote"}]}, ["London", "Remote"], True, False),
    ("lever", {"categories": {"location": "Leeds"}, "workplaceType": "Remote", "tags": ["a", "remote", "Hybrid"]}, ["Leeds", "remote", "Hybrid"], True, False),
    ("ashby", {"location": "Bath", "secondaryLocations": [{"name": "Hull"}], "isRemote": True}, ["Bath", "Hull"], True, False),
    ("bamboohr", {"city": "York", "location": {"country": "UK"}}, ["York", "UK"], False, False),
    ("workday", {"locationsText": "Various, TBD", "url": "x/job/Milton-Keynes/y"}, ["Milton Keynes"], False, False),
    ("workday", {"locationsText": "London, Remote", "verified": True}, ["London", "Remote"], True, True),
    ("workable", {"location": {"city": "Hull", "region": "E", "country": "UK"}}, ["Hull", "E", "UK"], False, False),
    ("nhs", {"location": "Ward 3"}, ["Ward 3"], False, True), ("nobody", {"location": "x"}, None, None, None),
])
def test_adapters(spark, provider, raw, locations, remote, trusted):
    df = spark.createDataFrame([(provider, json.dumps(raw))], "p string, j string")
    e = df.select(adapters.adapt(F.col("p"), F.parse_json("j")).alias("e")).first().e
    assert (list(e) if e else [None] * 3) == [locations, remote, trusted]


def test_html_helpers():
    assert html.once("LondonLondon") == "London" and html.once("abab") == "abab"
    page = '<div class="base-search-card"><a class="base-card__full-link" href="https://x.test/1?t=2">x</a><h3 class="base-search-card__title"> T </h3></div><p>'
    assert html.cards("linkedin", "", page) == [("T", "", "https://x.test/1", "")]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a, ""b"""\n2,"two\nlines"\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), ["id", "name"]).collect()] == [("1", 'a, "b"'), ("2", "two\nlines")]
    (tmp_path / "b.csv").write_text("1,x\nid,y\n\n 7 ,z\n7\n")
    assert sorted(r.id for r in files.read_processed_ids(spark, str(tmp_path / "b.csv")).collect()) == [1, 7]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "x"'), ("", None), ("line\nbreak", "é")]
    files.write_csv(spark.createDataFrame(rows, "a string, b string"), str(tmp_path / "out"))
    got = {tuple(r) for r in files.read_csv(spark, str(tmp_path / "out"), ["a", "b"]).collect()}
    assert {("a,b", 'say "x"'), ("line\nbreak", "é")} <= got


def test_sql_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO t (a, b) VALUES ('it''s (x), y', null), ('z', -5),\n(true, 'q');")
    assert [tuple(r) for r in files.read_sql_dump(spark, str(tmp_path / "d.sql"), ["a", "b"]).collect()] == [("it's (x), y", None), ("z", "-5"), ("true", "q")]


def test_json_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"data": {"companies": [{"id": 1, "name": "A"}, {"id": 2}]}}))
    assert [tuple(r) for r in files.read_companies_json(spark, str(tmp_path / "c.json"), ["id", "name"]).collect()] == [("1", "A"), ("2", None)]


def test_salvage(spark):
    text = 'Here:\n```json\n{"a": "x\ny", "b": 1}\n``` done'
    v = spark.createDataFrame([(text,)], "t string").select(files.salvage_json(F.col("t")).alias("v"))
    assert v.select(F.variant_get("v", "$.b", "int")).first()[0] == 1
