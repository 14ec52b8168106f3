"""Location evidence from raw provider rows (VARIANT), one builder for each of 17 providers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.location import evidence
from ..functions.values import first_of, js_trim, nonempty
from .providers import get, rows


def _list(*texts: Column) -> Column:
    return F.filter(F.array(*texts), lambda t: t.isNotNull() & (t != ""))


def _remote(locations: Column) -> Column:
    return F.exists(locations, lambda t: F.lower(t).contains("remote"))


def _flag(v: Column, *paths: str) -> Column:
    out = F.lit(False)
    for p in paths:
        out = out | F.coalesce(F.try_variant_get(v, f"$.{p}", "boolean"), F.lit(False))
    return out


def _empty() -> Column:
    return F.array().cast("array<string>")


def _each(v: Column, path: str, make) -> Column:
    return F.flatten(F.transform(F.coalesce(rows(v, path), F.array().cast("array<variant>")), make))


def _plain(locations: Column, trusted: bool = False) -> Column:
    return evidence(locations, F.lit(False) if trusted else _remote(locations), F.lit(trusted))


def _ashby(v):
    more = F.transform(F.coalesce(rows(v, "secondaryLocations"), F.array().cast("array<variant>")), lambda x: first_of(get(x, "location"), get(x, "name"), F.try_variant_get(x, "$", "string")))
    locs = F.filter(F.concat(F.array(first_of(get(v, "location.name"), get(v, "location"))), more), lambda t: t.isNotNull())
    return evidence(locs, _flag(v, "isRemote"), F.lit(False))


def _greenhouse(v):
    offices = _each(v, "offices", lambda o: F.array(get(o, "name"), get(o, "location")))
    locs = F.array_distinct(F.filter(F.concat(F.array(get(v, "location.name")), offices), lambda t: t.isNotNull() & (t != "")))
    return _plain(locs)


def _lever(v):
    tags = F.coalesce(F.try_variant_get(v, "$.tags", "array<string>"), _empty())
    tags = F.filter(tags, lambda t: F.lower(t).contains("remote") | (F.length(t) > 2))
    locs = F.filter(F.concat(F.array(first_of(get(v, "categories.location"), get(v, "workplaceType"))), tags), lambda t: t.isNotNull() & (t != ""))
    return evidence(locs, F.lower(get(v, "workplaceType")) == "remote", F.lit(False))


def _workable(v):
    nested = F.try_variant_get(v, "$.location", "variant").isNotNull()
    at = lambda name: F.when(nested, get(v, f"location.{name}")).otherwise(get(v, name))
    return evidence(_list(at("city"), first_of(at("state"), at("region")), at("country")), _flag(v, "telecommuting", "remote"), F.lit(False))


def _workday(v):
    raw = F.filter(F.transform(F.split(F.coalesce(get(v, "locationsText"), F.lit("")), ","), js_trim), lambda t: t != "")
    named = F.filter(raw, lambda t: ~F.lower(t).isin(*R.VAGUE_PLACES))
    city = nonempty(F.regexp_replace(F.regexp_extract(F.coalesce(get(v, "url"), F.lit("")), "/job/([^/]+)/", 1), "-", " "))
    locs = F.when(F.size(named) > 0, named).when(city.isNotNull(), F.array(city)).otherwise(_empty())
    return evidence(locs, _remote(raw), _flag(v, "verified"))


def _teamtailor(v):
    return _plain(_list(first_of(get(v, "attributes['human-location']"), get(v, "location"))))


def _smartrecruiters(v):
    locs = _list(get(v, "location.city"), get(v, "location.country"))
    return evidence(locs, F.coalesce(F.lower(get(v, "typeOfEmployment")).contains("remote"), F.lit(False)) | _remote(locs), F.lit(False))


def _bamboohr(v):
    return _plain(_list(*(first_of(get(v, f"location.{n}"), get(v, n)) for n in ("city", "state", "country"))))


def _rippling(v):
    locs = _each(v, "locations", lambda o: F.array(get(o, "name"), get(o, "city")))
    return _plain(F.array_distinct(F.filter(locs, lambda t: t.isNotNull() & (t != ""))))


def _fields(*paths: str):
    return lambda v: _plain(_list(*(get(v, p) for p in paths)))


ADAPTERS = {
    "ashby": _ashby, "greenhouse": _greenhouse, "lever": _lever, "workable": _workable, "workday": _workday, "teamtailor": _teamtailor, "smartrecruiters": _smartrecruiters,
    "pinpoint": _fields("location.name", "location.city", "location.province"), "breezy": _fields("location.name"), "recruitee": _fields("city", "country", "location"), "bamboohr": _bamboohr,
    "jobvite": _fields("location"), "personio": _fields("office", "location"), "hibob": _fields("site", "country"), "icims": _fields("location", "JobLocation"), "rippling": _rippling,
    "nhs": lambda v: _plain(_list(get(v, "location")), True),
}


def adapt(provider: Column, v: Column) -> Column:
    """Evidence by provider; null where there is no adapter."""
    out = F.lit(None).cast("struct<locations:array<string>,is_remote:boolean,is_trusted_source:boolean>")
    for name, make in ADAPTERS.items():
        out = F.when(F.lower(provider) == name, make(v)).otherwise(out)
    return out
