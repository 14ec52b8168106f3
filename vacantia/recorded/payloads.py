"""Small recorded responses of every provider: (token, [payload, ...]); texts stand for pages and feeds."""

from __future__ import annotations

import json

BAD = ["no json", "{}", ""]

JSON = {
    "greenhouse": ("acme", [
        {"jobs": [{"title": "Data Engineer", "location": {"name": "Leeds"}, "offices": [{"name": "London"}, {"location": "Paris"}, {}], "absolute_url": "https://g.test/1", "departments": [{"name": "Data"}]},
                  {"title": "Analyst", "location": {"name": "Hull"}, "offices": [], "url": "https://g.test/2"}, {"location": {}, "absolute_url": ""}]},
        {"jobs": []}]),
    "ashby": ("acme", [
        {"jobs": [{"title": "Chef", "location": "London", "secondaryLocations": [{"location": "Leeds"}, {"name": "Hull"}], "isRemote": True, "jobUrl": "https://a.test/1", "department": "Food"},
                  {"title": "Cook", "location": {"name": "Bath"}, "jobUrl": "https://a.test/2"}, {"title": "Any", "isRemote": False}]}]),
    "lever": ("acme", [
        [{"title": "Eng", "postings": [{"text": "Dev", "categories": {"location": "London", "team": "Core"}, "hostedUrl": "https://l.test/1"}]}, {"title": "Ops", "postings": [{"text": "Op", "workplaceType": "remote", "hostedUrl": "https://l.test/2"}]}],
        [{"text": "Flat", "categories": {"location": "Hull", "department": "D", "team": "T"}, "hostedUrl": "https://l.test/3"}]]),
    "workable": ("acme", [
        {"jobs": [{"title": "W", "city": "Bath", "country": "UK", "shortcode": "S1", "department": "X"}, {"title": "R", "telecommuting": True, "url": "https://w.test/2"}]},
        {"results": [{"title": "N", "location": {"city": "Hull", "region": "Yorks", "country": "UK"}, "shortlink": "https://w.test/3"}, {"title": "none"}]}]),
    "teamtailor": ("acme", [{"data": [{"attributes": {"title": "T", "human-location": "Leeds"}, "links": {"careersite-job-url": "https://t.test/1"}}, {"attributes": {"title": "U"}, "links": {}}]}]),
    "bamboohr": ("acme", [
        {"result": [{"id": "4", "jobOpeningName": "B", "location": {"city": "York", "state": None, "country": "UK"}, "department": {"label": "HR"}}, {"id": 5, "jobTitle": {"label": "C"}, "location": {"label": "Remote"}}]},
        [{"id": 6, "title": "Root"}]]),
    "smartrecruiters": ("acme", [{"content": [{"name": "S", "id": 4, "location": {"city": "Hull", "country": "gb"}, "department": {"label": "L"}}, {"name": "F", "id": "5", "location": {"fullLocation": "Leeds, UK", "city": "x"}}]}]),
    "pinpoint": ("acme", [{"data": [{"title": "P", "location": {"name": "London", "province": "England"}, "path": "/en/1", "job_function": "Ops"}, {"title": "Q", "location": {"city": "Hull"}, "url": "https://p.test/2", "department": "D"}, {"title": "R", "location": "Bath"}]}]),
    "breezy": ("acme", [[{"name": "N", "location": {"name": "Leeds"}, "url": "https://b.test/1", "department": {"name": "D"}}, {"name": "M"}]]),
    "recruitee": ("acme", [{"offers": [{"title": "R", "city": "Bath", "country": "UK", "careers_url": "https://r.test/1", "department": "D"}, {"title": "S", "location": "Remote"}]}]),
    "jobvite": ("acme", [{"jobs": [{"title": "J", "location": "Hull", "applyUrl": "https://j.test/1", "category": "C", "department": "D"}, {"jobTitle": "K", "id": "k9", "department": "D"}]}]),
    "avature": ("acme", [{"items": [{"jobTitle": "A", "location": "Hull", "detailUrl": "https://v.test/1", "category": "C"}, {"title": "B", "department": "D"}]}]),
    "workday": ("nu/Board", [{"jobPostings": [{"title": "W", "externalPath": "/job/x", "locationsText": "2 Locations"}, {"title": "V", "externalPath": "/job/y", "bulletFields": ["r", "London"]}]}]),
    "oracle_cloud": ("eu.test|CX_1", [{"items": [{"requisitionList": [{"Id": 7, "Title": "O", "PrimaryLocation": "London", "Organization": "Org"}, {"Id": "8", "Title": "P", "workLocation": {"Region": "Wales"}}]}]}]),
    "jpmc": ("https://x.test/sites/CX_9/jobs", [{"items": [{"requisitionList": [{"Id": 7, "Title": "O", "PrimaryLocation": "Bournemouth"}, {"Id": 8, "Title": "P"}]}]}]),
    "wipro": ("wipro", [{"jobSearchResult": [{"response": {"id": 3, "unifiedStandardTitle": "W", "unifiedUrlTitle": "w-t", "jobLocationShort": ["London", "Hull"], "custRMKMappingPicklist": ["IT"]}}, {"response": {"id": 4, "unifiedStandardTitle": "V"}}]}]),
    "hibob": ("acme", [{"jobAdDetails": [{"id": "h1", "title": "H", "site": "London", "country": "UK", "department": {"name": "D"}}, {"id": "h2", "title": "I", "department": "E"}]}]),
    "eightfold": ("acme.test|acme", [{"data": {"positions": [{"name": "E", "locations": ["London, UK"], "positionUrl": "/p/1", "department": "D"}, {"name": "F", "standardizedLocations": ["Hull"], "positionUrl": "/p/2"}]}}]),
    "icims": ("acme", [{"results": [{"JobTitle": "I", "JobId": 3, "JobLocation": "UK-Hull", "JobCategory": "C"}]}, [{"title": "J", "id": "4", "location": "Leeds", "url": "https://i.test/4", "department": "D"}]]),
    "rippling": ("acme", ['<html><script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"dehydratedState": {"queries": [
        {"state": {"data": {"items": [{"name": "R", "id": "9", "locations": [{"name": "London"}, {"city": "Hull"}], "department": {"name": "D"}}]}}}, {"state": {}}, {"state": {"data": {"items": [{"name": "S", "url": "https://r.test/2"}]}}}]}}}}) + "</script></html>"]),
    "oracle": ("https://o.test/careersection/2/joblist.ftl?lang=en", [{"requisitionList": [{"title": "O", "location": "Hull", "referenceNumber": "R1", "department": "D"}, {"jobTitle": "P", "locationDescr": "Bath", "jobDetailUrl": "https://o.test/p"}]}, {"requisitions": [{"title": "Q", "primaryLocation": "York", "referenceNumber": 7}]}]),
    "eploy": ("https://e.test", [{"vacancies": [{"VacancyTitle": "E", "town": "Hull", "VacancyId": 3, "category": "C"}, {"jobTitle": "F", "Location": "Bath", "applyUrl": "https://e.test/f"}]}, [{"title": "G", "region": "Kent", "id": 5, "department": "D"}]]),
    "cornerstone": ("acme", [{"data": {"requisitions": [{"requisitionId": 11, "displayJobTitle": "C", "locations": [{"city": "Hull"}, {"name": "Leeds"}], "department": "D"}, {"requisitionId": 12, "category": "K"}]}}]),
    "gem": ("acme", [[{"data": {"oatsExternalJobPostings": {"jobPostings": [{"title": "G", "id": 5, "locations": [{"city": "Bath"}], "job": {"department": {"name": "D"}}}, {"title": "H", "extId": "e6", "locations": [{"name": "Remote UK"}]}]}}}]]),
    "join_com": ("acme", [{"items": [{"title": "J", "city": {"cityName": "Hull"}, "idParam": "j-1", "department": {"name": "D"}}, {"title": "K", "location": "Leeds", "url": "https://j.test/k", "department": "E"}]}]),
    "mercor": ("mercor", [{"listings": [{"listingId": "7", "title": "C++ Dev (x)", "location": "Remote"}, {"listingId": 8, "title": " - Two  words_ok - "}]}]),
    "phenom": ("https://p.test/uk/", [{"refineSearch": {"data": {"jobs": [{"title": "P", "city": "Hull", "country": "UK", "jobUrl": "job/1", "category": "C"}, {"jobTitle": "Q", "location": "Bath", "jobId": 9}]}}}, {"refineSearch": {"hits": [{"title": "R", "url": "https://p.test/r", "department": "D"}]}}, {"jobs": [{"title": "S", "id": "s1"}]}]),
    "recruiterbox": ("acme", [{"objects": [{"title": "R", "location": {"city": "Hull", "state": "", "country": "UK"}, "hosted_url": "https://r.test/1", "team": "T"}, {"title": "S", "url": "https://r.test/2", "department": "D"}]}]),
    "amazon": ("amazon", [{"jobs": [{"title": "a", "country_code": "US", "job_path": "/a"}, {"title": "b", "country_code": "GBR", "city": "Hull", "state": "ENG", "job_path": "/b", "job_category": "C"}, {"title": "c", "country_code": "UK", "normalized_location": "London, GBR", "job_path": "/c", "job_family_name": "F"}, {"title": "d", "country_code": "GB", "job_path": "/d"}]}]),
    "apple": ("apple", [{"searchResults": [{"postingTitle": "A", "homeOffice": True, "locations": [{"city": "London", "countryCode": "GBR"}], "positionId": "1", "team": {"teamName": "T"}}, {"title": "B", "locations": [{"countryName": "Ireland"}], "positionId": 2}, {"title": "C", "positionId": 3}]}]),
}

FEEDS = {
    "personio": ("acme", ["<x><position><name>Dev</name><office>Berlin</office><department>IT</department></position><position id='2'><title><![CDATA[Ops & co]]></title><location>Hull</location><jobUrl>https://p.test/2</jobUrl><category>C</category></position></x>", "<x></x>"]),
    "teamtailor_feed": ("acme", ["<rss><item><title>A</title><description>x · London</description><link>https://t.test/1</link><category>K</category></item><item><title>B</title><description>none</description><link>https://t.test/2</link></item></rss>", "<rss/>"]),
}

_CARD = '<div class="base-search-card"><a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/{0}?trk=x">go</a><h3 class="base-search-card__title"> {1} </h3><h4 class="base-search-card__subtitle">Acme</h4><span class="job-search-card__location">{2}</span></div>'
PAGES = {
    "successfactors": ("acme.com", ['<table><tr class="data-row"><td><span class="jobTitle">Cook</span><a href="/job/1">x</a><span class="jobLocation">Hull, UK</span></td></tr><tr class="data-row"><td><span class="jobTitle">Chef</span><a href="https://s.test/2">x</a></td></tr></table>']),
    "jazzhr": ("acme", ['<ul><li class="list-group-item"><h3 class="list-group-item-heading"><a href="/apply/1">Cook</a></h3><ul class="list-inline"><li>* London</li><li>Kitchen</li></ul></li><li class="list-group-item"><h3 class="list-group-item-heading"><a href="/apply/2">Chef</a></h3></li></ul>']),
    "goldmansachs": ("gs", ['<div><a href="/roles/1"><span class="gs-text">Analyst</span><span data-testid="location">London · UK</span><button class="gs-tag__button">Risk</button></a><a href="/roles/2"><span class="gs-text">Quant</span></a></div>']),
    "google": ("google", ['<div class="sMn82b"><h3>SRE</h3><span class="r0wTof">London, UK</span><a href="jobs/results/1">Learn</a></div><div class="sMn82b"><h3>PM</h3><a href="jobs/results/2">Learn</a></div>']),
    "meta": ("meta", ['<div><a href="/jobs/1"><div class="x-title">Eng</div><div class="x-location">Leeds, UK</div><div class="x-team">Infra</div></a><a href="/jobs/2"><h3>PM</h3></a></div>']),
    "publicis": ("publicis", ['<div class="job-card"><span class="job-title">Buyer</span><span class="job-location">Hull</span><a class="job-title-link" href="https://p.test/1"></a></div><div class="job-card"><span class="job-title">Planner</span><a href="https://p.test/2"></a></div>']),
    "linkedin": ("acme", [_CARD.format(1, "Clerk", "LondonLondon") + _CARD.format(2, "Baker", "Hull, UK")]),
    "nhs": ("nhs", ['<ul><li class="search-result"><a href="/job/1">Nurse</a><h3>Trust A</h3><div class="y-location">Ward 3, Hull</div></li><li class="search-result"><a href="/job/2">Porter</a></li></ul>']),
    "teamtailor_html": ("acme", ['<ul><li><a href="/jobs/1">Dev</a><span class="z-location">Leeds</span></li><li><a href="https://x.test/2">Ops</a></li><li>no link</li></ul>']),
    "jobvite_html": ("acme", ['<table><tr><td><a href="/acme/job/1">Dev</a></td><td class="jv-location">Leeds</td></tr><tr><td><a href="/acme/job/2">Ops</a></td></tr></table>']),
}

CAREERS = ("https://g.test/careers/", [
    '<script type="application/ld+json">{"@type":"JobPosting","title":" LD ","url":"https://g.test/ld","jobLocation":{"address":{"addressLocality":"Hull","addressCountry":"GB"}}}</script><script type="application/ld+json">[{"@type":"Organization"},{"@type":"JobPosting","title":"No link"}]</script><script type="application/ld+json">broken</script>',
    '<ul><li><a href="/jobs/1"> Data\n Engineer </a><p>Central London office</p></li><li><a href="https://x.test/job/2">Site Cook</a> Remote in UK</li><li><a href="/jobs/1">Again here</a></li><li><a href="/about/3">About</a></li><li><a href="/jobs/4">View job</a></li></ul>',
    "",
])

#: Raw provider rows for the location adapters.
ADAPTED = {
    "ashby": [{"location": "Bath", "secondaryLocations": [{"name": "Hull"}, {"location": "York"}, "Kent"], "isRemote": True}, {"location": {"name": "Leeds"}}, {}],
    "greenhouse": [{"location": {"name": "London"}, "offices": [{"name": "London", "location": "Remote"}, {"name": ""}]}, {"location": {"name": "Remote UK"}}, {}],
    "lever": [{"categories": {"location": "Leeds"}, "workplaceType": "Remote", "tags": ["a", "remote", "Hybrid"]}, {"workplaceType": "onsite"}, {"categories": {}, "workplaceType": "hybrid", "tags": []}],
    "workable": [{"location": {"city": "Hull", "region": "E", "country": "UK"}, "city": "no"}, {"city": "Bath", "state": "S", "country": "", "telecommuting": True}, {"remote": True}],
    "workday": [{"locationsText": "Various, TBD", "url": "x/job/Milton-Keynes/y"}, {"locationsText": "London, Remote", "verified": True}, {"locationsText": " ", "url": "none"}],
    "teamtailor": [{"attributes": {"human-location": "Leeds"}, "location": "x"}, {"location": "Remote"}, {}],
    "smartrecruiters": [{"location": {"city": "Hull", "country": "gb"}, "typeOfEmployment": "Fully Remote"}, {"location": {"city": "remote"}}, {}],
    "pinpoint": [{"location": {"name": "London", "city": "L", "province": "England"}}, {"location": {"city": "Remote"}}, {}],
    "breezy": [{"location": {"name": "Remote, UK"}}, {"location": {"name": ""}}, {}],
    "recruitee": [{"city": "Bath", "country": "UK", "location": "Remote"}, {"country": "UK"}, {}],
    "bamboohr": [{"city": "York", "location": {"country": "UK"}}, {"location": {"city": "Remote", "state": "S"}}, {}],
    "jobvite": [{"location": "Hull"}, {"location": "remote"}, {}],
    "personio": [{"office": "Berlin", "location": "Hull"}, {"location": "Remote"}, {}],
    "hibob": [{"site": "London", "country": "UK"}, {"site": "Remote"}, {}],
    "icims": [{"location": "Leeds", "JobLocation": "UK-Hull"}, {"JobLocation": "Remote"}, {}],
    "rippling": [{"locations": [{"name": "London"}, {"city": "Hull"}, {"name": "London", "city": ""}]}, {"locations": [{"name": "Remote"}]}, {}],
    "nhs": [{"location": "Ward 3 remote"}, {"location": ""}, {}],
}


def as_text(payload) -> str:
    return payload if isinstance(payload, str) else json.dumps(payload)
