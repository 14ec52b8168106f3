"""Normalisers: recorded provider payloads to one posting schema.

payloads: company_id, provider, token, payload (the response text). All JSON providers are dealt
with in one pass: the payload is parsed once into a VARIANT, the provider picks the array of rows and the
field rules, and no provider costs a scan of its own. XML feeds are split by native regex; HTML
pages go through the parser in ``html``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import first_of, js_trim, nonempty
from . import html

SCHEMA = "company_id, provider, pos, title, location, url, department"


def _at(path: str) -> str:
    return f"${path}" if not path or path.startswith("[") else f"$.{path}"


def get(v: Column, path: str) -> Column:
    """Text at a path (a number or flag becomes text), null where it is missing or an object."""
    return F.try_variant_get(v, _at(path), "string")


def rows(v: Column, path: str) -> Column:
    return F.try_variant_get(v, _at(path), "array<variant>")


class Item:
    """Field access on one row of a payload: ``i.title`` texts, with the company's token at hand."""

    def __init__(self, value: Column, token: Column):
        self.value, self.token = value, token

    def __call__(self, *paths: str) -> Column:
        """The first non-empty text of the paths, else empty."""
        return F.coalesce(first_of(*(get(self.value, p) for p in paths)), F.lit(""))

    def joined(self, separator: str, *paths: str) -> Column:
        return F.concat_ws(separator, *(nonempty(get(self.value, p)) for p in paths))

    def each(self, path: str, separator: str, *fields: str) -> Column:
        """The first non-empty field of every element, joined."""
        texts = F.transform(F.coalesce(rows(self.value, path), F.array().cast("array<variant>")), lambda x: first_of(*(get(x, f) for f in fields)))
        return F.array_join(F.filter(texts, lambda t: t.isNotNull()), separator)

    def words(self, path: str, separator: str) -> Column:
        return F.array_join(F.coalesce(F.try_variant_get(self.value, f"$.{path}", "array<string>"), F.array().cast("array<string>")), separator)

    def flag(self, *paths: str) -> Column:
        return reduce(lambda a, b: a | b, (F.coalesce(F.try_variant_get(self.value, f"$.{p}", "boolean"), F.lit(False)) for p in paths))

    def built(self, *parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@dataclass
class Shape:
    """paths: where the rows are (the first that holds an array); a rule for each field."""

    paths: tuple[str, ...]
    title: Callable[[Item], Column]
    location: Callable[[Item], Column]
    url: Callable[[Item], Column]
    department: Callable[[Item], Column] = lambda i: F.lit("")
    keep: Callable[[Item], Column] | None = None


def _or(a: Column, b: Column) -> Column:
    return F.coalesce(nonempty(a), b)


def _split(token: Column, separator: str, n: int) -> Column:
    return F.coalesce(F.try_element_at(F.split(token, separator), F.lit(n)), F.lit(""))


_DEPT = lambda i: i("department.name", "department")
_TEAM = lambda i: i("category", "department")

SHAPES: dict[str, Shape] = {
    "greenhouse": Shape(("jobs",), lambda i: i("title"), lambda i: _or(i.each("offices", " | ", "name", "location"), i("location.name")), lambda i: i("absolute_url", "url"), lambda i: i("departments[0].name")),
    "ashby": Shape(("jobs",), lambda i: i("title"), lambda i: js_trim(F.concat_ws(" ", i("location.name", "location"), i.each("secondaryLocations", " ", "location", "name"), F.when(i.flag("isRemote"), "Remote").otherwise(""))), lambda i: i("jobUrl"), lambda i: i("department")),
    "lever": Shape(("",), lambda i: i("text"), lambda i: i("categories.location", "workplaceType"), lambda i: i("hostedUrl"), lambda i: i("categories.department", "categories.team", "__group")),
    "workable": Shape(("jobs", "results"), lambda i: i("title"), lambda i: _or(_or(i.joined(", ", "city", "state", "country"), i.joined(", ", "location.city", "location.region", "location.country")), F.when(i.flag("telecommuting", "remote"), "Remote").otherwise("")), lambda i: _or(i("url", "shortlink"), i.built("https://apply.workable.com/j/", i("shortcode"))), lambda i: i("department")),
    "teamtailor": Shape(("data",), lambda i: i("attributes.title"), lambda i: get(i.value, "attributes['human-location']"), lambda i: get(i.value, "links['careersite-job-url']")),
    "bamboohr": Shape(("result", ""), lambda i: i("jobOpeningName", "jobTitle.label", "title"), lambda i: _or(i.joined(", ", "location.city", "location.state", "location.country"), i("location.label")), lambda i: i.built("https://", i.token, ".bamboohr.com/careers/", i("id")), lambda i: i("department.label")),
    "smartrecruiters": Shape(("content",), lambda i: i("name"), lambda i: _or(i("location.fullLocation"), i.joined(" ", "location.city", "location.country")), lambda i: i.built("https://jobs.smartrecruiters.com/", i.token, "/", i("id")), lambda i: i("department.label")),
    "pinpoint": Shape(("data",), lambda i: i("title"), lambda i: _or(F.concat_ws(", ", nonempty(i("location.name", "location.city")), nonempty(i("location.province"))), i("location")), lambda i: _or(i("url"), i.built("https://", i.token, ".pinpointhq.com", i("path"))), lambda i: i("job_function", "department")),
    "breezy": Shape(("",), lambda i: i("name"), lambda i: i("location.name"), lambda i: i("url"), lambda i: i("department.name")),
    "recruitee": Shape(("offers",), lambda i: i("title"), lambda i: _or(i.joined(", ", "city", "country"), i("location")), lambda i: i("careers_url"), lambda i: i("department")),
    "jobvite": Shape(("jobs",), lambda i: i("title", "jobTitle"), lambda i: i("location"), lambda i: _or(i("applyUrl", "url"), i.built("https://jobs.jobvite.com/", i.token, "/job/", i("id"))), _TEAM),
    "avature": Shape(("items",), lambda i: i("jobTitle", "title"), lambda i: i("location"), lambda i: _or(i("detailUrl", "url"), i.built("https://", i.token, ".avature.net/")), _TEAM),
    "workday": Shape(("jobPostings",), lambda i: i("title"), lambda i: i("locationsText", "bulletFields[1]"), lambda i: i.built("https://", _split(i.token, "/", 1), ".myworkdayjobs.com/", _split(i.token, "/", 2), i("externalPath"))),
    "oracle_cloud": Shape(("items[0].requisitionList",), lambda i: i("Title"), lambda i: i("PrimaryLocation", "workLocation.Region"), lambda i: i.built("https://", _split(i.token, r"\|", 1), "/hcmUI/CandidateExperience/en/sites/", _split(i.token, r"\|", 2), "/job/", i("Id")), lambda i: i("Organization")),
    "jpmc": Shape(("items[0].requisitionList",), lambda i: i("Title"), lambda i: _or(i("PrimaryLocation"), F.lit("United Kingdom")), lambda i: i.built("https://jpmc.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/", _or(F.regexp_extract(i.token, "sites/([^/?#]+)", 1), F.lit("CX_1001")), "/job/", i("Id"))),
    "wipro": Shape(("jobSearchResult",), lambda i: i("response.unifiedStandardTitle"), lambda i: i("response.jobLocationShort[0]"), lambda i: i.built("https://careers.wipro.com/job/", i("response.unifiedUrlTitle"), "/", i("response.id"), "-en_US"), lambda i: i("response.custRMKMappingPicklist[0]")),
    "hibob": Shape(("jobAdDetails",), lambda i: i("title"), lambda i: i.joined(" ", "site", "country"), lambda i: i.built("https://", F.when(i.token.contains("."), i.token).otherwise(F.concat(i.token, F.lit(".careers.hibob.com"))), "/jobs/", i("id")), _DEPT),
    "eightfold": Shape(("data.positions",), lambda i: i("name"), lambda i: i("locations[0]", "standardizedLocations[0]"), lambda i: i.built("https://jobs.", _split(i.token, r"\|", 1), i("positionUrl")), lambda i: i("department")),
    "icims": Shape(("", "results"), lambda i: i("title", "JobTitle"), lambda i: i("location", "JobLocation"), lambda i: _or(i("url"), i.built("https://", i.token, ".icims.com/jobs/", i("id", "JobId"), "/job")), lambda i: i("department", "JobCategory")),
    "rippling": Shape(("__items",), lambda i: i("name"), lambda i: i.each("locations", ", ", "name", "city"), lambda i: _or(i("url"), i.built("https://ats.rippling.com/", i.token, "/jobs/", i("id"))), lambda i: i("department.name")),
    "oracle": Shape(("requisitionList", "requisitions"), lambda i: i("title", "jobTitle"), lambda i: i("location", "locationDescr", "primaryLocation"), lambda i: F.when(i("referenceNumber") != "", i.built(F.regexp_replace(i.token, "/joblist.*$", ""), "/jobdetail.ftl?job=", i("referenceNumber"))).otherwise(i("jobDetailUrl")), lambda i: i("department")),
    "eploy": Shape(("", "vacancies", "results"), lambda i: i("title", "jobTitle", "VacancyTitle"), lambda i: i("location", "Location", "town", "region"), lambda i: _or(i("url", "applyUrl"), i.built(i.token, "/careers/vacancy/", i("id", "VacancyId"))), lambda i: i("department", "category")),
    "cornerstone": Shape(("data.requisitions",), lambda i: _or(i("displayJobTitle"), F.lit("Untitled")), lambda i: i.each("locations", ", ", "city", "name"), lambda i: i.built("https://", i.token, ".csod.com/ux/ats/careersite/1/job/", i("requisitionId"), "?c=", i.token), lambda i: i("department", "category")),
    "gem": Shape(("[0].data.oatsExternalJobPostings.jobPostings",), lambda i: i("title"), lambda i: i("locations[0].city", "locations[0].name"), lambda i: i.built("https://jobs.gem.com/", i.token, "/", i("extId", "id")), lambda i: i("job.department.name")),
    "join_com": Shape(("items",), lambda i: i("title"), lambda i: i("location", "city.cityName", "city.city"), lambda i: _or(i("url"), i.built("https://join.com/companies/", i.token, "/jobs/", i("idParam", "id"))), _DEPT),
    "mercor": Shape(("listings",), lambda i: i("title"), lambda i: i("location"), lambda i: i.built("https://work.mercor.com/jobs/", i("listingId"), "/", slug(i("title")))),
    "phenom": Shape(("refineSearch.data.jobs", "refineSearch.jobs", "refineSearch.hits", "jobs"), lambda i: i("title", "jobTitle"), lambda i: _or(i.joined(", ", "city", "state", "country"), i("location")), lambda i: absolute(i.token, _or(i("jobUrl", "url"), i.built("/job/", i("jobId", "id")))), lambda i: i("department", "category")),
    "recruiterbox": Shape(("objects",), lambda i: i("title"), lambda i: i.joined(", ", "location.city", "location.state", "location.country"), lambda i: i("hosted_url", "url"), lambda i: i("department", "team")),
    "amazon": Shape(("jobs",), lambda i: i("title"), lambda i: _or(F.concat_ws(", ", nonempty(i("normalized_location", "city")), nonempty(i("state"))), F.lit("United Kingdom")), lambda i: i.built("https://www.amazon.jobs", i("job_path")), lambda i: _or(i("job_category", "job_family_name"), F.lit("Various")), lambda i: i("country_code").isin("UK", "GB", "GBR")),
    "apple": Shape(("searchResults",), lambda i: i("postingTitle", "title"), lambda i: _or(F.concat_ws(", ", F.when(i.flag("homeOffice"), "Remote"), nonempty(i("locations[0].city")), F.when(i("locations[0].countryCode") == "GBR", "United Kingdom").otherwise(nonempty(i("locations[0].countryName")))), F.lit("United Kingdom")), lambda i: i.built("https://jobs.apple.com/en-gb/details/", i("positionId")), lambda i: i("team.teamName")),
}


def slug(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "-"), "^-+|-+$", "")


def absolute(base: Column, url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.when(url.startswith("/"), "").otherwise("/"), url))


_NO_ROWS = "array<variant>"


def _payload(provider: Column, payload: Column) -> Column:
    """The JSON text of a payload: the state embedded in a page for rippling, else the payload."""
    state = F.regexp_extract(payload, r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>', 1)
    return F.try_parse_json(F.when(provider == "rippling", state).otherwise(payload))


def _items(provider: Column, v: Column) -> Column:
    """Rows of a payload by provider; lever groups and rippling queries are flattened."""
    found = F.lit(None).cast(_NO_ROWS)
    for name, shape in SHAPES.items():
        if name == "lever":
            flat = F.coalesce(rows(v, ""), F.array().cast(_NO_ROWS))
            inner = F.flatten(F.transform(flat, lambda g: F.coalesce(rows(g, "postings"), F.array().cast(_NO_ROWS))))
            mine = F.when(F.size(inner) > 0, inner).otherwise(flat)
        elif name == "rippling":
            queries = F.coalesce(rows(v, "props.pageProps.dehydratedState.queries"), F.array().cast(_NO_ROWS))
            mine = F.flatten(F.transform(queries, lambda q: F.coalesce(rows(q, "state.data.items"), F.array().cast(_NO_ROWS))))
        else:
            mine = F.coalesce(*(rows(v, p) for p in shape.paths))
        found = F.when(provider == name, mine).otherwise(found)
    return found


def normalize_json(payloads: DataFrame) -> DataFrame:
    """Postings of all JSON providers; rows without title or address are kept (see valid titles)."""
    mine = payloads.filter(F.col("provider").isin(*SHAPES)).withColumn("__v", _payload(F.col("provider"), F.col("payload")))
    rows_ = mine.select("company_id", "provider", F.coalesce("token", F.lit("")).alias("token"), F.posexplode(_items(F.col("provider"), F.col("__v"))).alias("pos", "__i"))
    item = Item(F.col("__i"), F.col("token"))

    def choose(field: str) -> Column:
        out = F.lit("")
        for name, shape in SHAPES.items():
            out = F.when(F.col("provider") == name, getattr(shape, field)(item)).otherwise(out)
        return F.coalesce(out, F.lit(""))

    keep = F.lit(True)
    for name, shape in SHAPES.items():
        if shape.keep:
            keep = F.when(F.col("provider") == name, shape.keep(item)).otherwise(keep)
    return rows_.filter(keep).select("company_id", "provider", "pos", *(choose(f).alias(f) for f in ("title", "location", "url", "department")))


def normalize_xml(payloads: DataFrame) -> DataFrame:
    """Personio positions and Teamtailor feeds: first text of a tag within each block."""
    mine = payloads.filter(F.col("provider").isin("personio", "teamtailor") & F.col("payload").startswith("<"))
    tag = F.when(F.col("provider") == "personio", "position").otherwise("item")
    block = F.regexp_extract_all(F.col("payload"), F.concat(F.lit("(?s)<"), tag, F.lit("(?:\\s[^>]*)?>(.*?)</"), tag, F.lit(">")), F.lit(1))
    b = mine.select("company_id", "provider", "token", F.posexplode(block).alias("pos", "b"))

    def text(*tags: str) -> Column:
        found = [js_trim(F.regexp_replace(F.regexp_extract("b", rf"(?s)<{t}(?:\s[^>]*)?>(.*?)</{t}>", 1), r"^<!\[CDATA\[|\]\]>$", "")) for t in tags]
        return F.coalesce(first_of(*found), F.lit(""))

    second = js_trim(F.coalesce(F.try_element_at(F.split(text("description"), "·"), F.lit(2)), F.lit("")))
    personio = F.col("provider") == "personio"
    home = F.concat(F.lit("https://"), F.col("token"), F.lit(".jobs.personio.de"))
    return b.select(
        "company_id", "provider", "pos", text("name", "title").alias("title"), F.when(personio, text("office", "location")).otherwise(second).alias("location"),
        F.when(personio, _or(text("jobUrl"), home)).otherwise(text("link")).alias("url"), text("department", "category").alias("department"),
    )


def normalize(payloads: DataFrame) -> DataFrame:
    """All postings of a payload table, whatever the provider: company_id, provider, pos, title, location, url, department."""
    return normalize_json(payloads).unionByName(normalize_xml(payloads)).unionByName(html.normalize_html(payloads))
