"""Addresses: parts, provider inference, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .values import alternatives, contains_any, js_trim, nonempty


def with_scheme(url: Column) -> Column:
    """Trimmed address with https:// where no scheme is given; empty: null."""
    t = nonempty(js_trim(url))
    return F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def host(url: Column) -> Column:
    """Lower-case host of an http(s) address without user, port and path; else null."""
    return nonempty(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)


def path_part(url: Column, n: int) -> Column:
    """n-th non-empty path part (from 1), else null."""
    return F.try_element_at(F.filter(F.split(path(url), "/"), lambda x: x != ""), F.lit(n))


def query_value(url: Column, key: str) -> Column:
    return nonempty(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1))


def sub(url: Column) -> Column:
    return F.substring_index(host(url), ".", 1)


def _hit(provider, token: Column) -> Column:
    provider = F.lit(provider) if isinstance(provider, str) else provider
    return F.struct(provider.alias("provider"), token.alias("token"))


_NO_HIT = "struct<provider:string,token:string>"


def infer_v1(url: Column) -> Column:
    """struct<provider, token> by host rules, else generic_careers with the address; null without one."""
    u = with_scheme(url)
    h, part = host(u), path_part(u, 1)
    nothing = F.lit(None).cast(_NO_HIT)
    board = F.coalesce(part, F.lit(""))
    green = F.coalesce(part, query_value(u, "for"))
    out = F.when(h.isNull(), nothing).when(h.isin("boards.greenhouse.io", "job-boards.eu.greenhouse.io"), F.when(green.isNotNull(), _hit("greenhouse", green)))
    for piece, provider, where in R.HOST_RULES:
        token = part if where == "path" else sub(u) if where == "sub" else F.coalesce(part, sub(u))
        out = out.when(h.contains(piece), F.when(nonempty(token).isNotNull(), _hit(provider, token)))
    tenant = (board != "") & ~board.isin("en-US", "en-GB")
    out = out.when(h.contains("myworkdayjobs.com"), _hit("workday", F.when(tenant, F.concat_ws("/", sub(u), board)).otherwise(u)))
    return out.otherwise(_hit("generic_careers", u))


def infer_v2(url: Column) -> Column:
    """Provider by host, null where unknown; texts without a scheme are searched as they are."""
    h = F.coalesce(host(url), F.lower(url))
    return reduce(lambda acc, r: acc.when(h.contains(r[0]), r[1]), R.HOST_PROVIDERS, F.when(h.isNull(), F.lit(None).cast("string")))


_GENERIC = ("www", "jobs", "careers", "apply", "en", "us", "uk", "api")


def infer_v3(url: Column) -> Column:
    """Strict hosts; a generic word is no token; workday, oracle and icims keep the address as token."""
    h, part = host(url), path_part(url, 1)
    scheme = F.concat(F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1)), F.lit("://"), h)

    def known(token: Column, provider: str) -> Column:
        return F.when(nonempty(token).isNotNull() & ~F.lower(token).isin(*_GENERIC), _hit(provider, token))

    embedded = query_value(url, "for")
    out = F.when(h.isNull(), F.lit(None).cast(_NO_HIT))
    out = out.when(h == "boards.greenhouse.io", F.coalesce(known(embedded, "greenhouse"), known(part, "greenhouse")))
    for name, provider in (("job-boards.eu.greenhouse.io", "greenhouse_eu"), ("jobs.lever.co", "lever"), ("jobs.eu.lever.co", "lever_eu"), ("jobs.ashbyhq.com", "ashby"), ("apply.workable.com", "workable"), ("careers.smartrecruiters.com", "smartrecruiters")):
        out = out.when(h == name, known(part, provider))
    for end, provider in ((".workable.com", "workable"), (".smartrecruiters.com", "smartrecruiters"), (".recruitee.com", "recruitee"), (".teamtailor.com", "teamtailor"), (".bamboohr.com", "bamboohr"), (".jobs.personio.com", "personio"), (".jobs.personio.de", "personio")):
        out = out.when(h.endswith(end) & ~h.startswith("api."), known(sub(url), provider))
    out = out.when(h.endswith(".myworkdayjobs.com") & (h != "www.myworkdayjobs.com"), F.when(part.isNotNull(), _hit("workday", F.concat_ws("/", scheme, part))))
    out = out.when(h.endswith(".taleo.net") | (h.endswith(".oraclecloud.com") & path(url).contains("hcmUI")), _hit("oracle", scheme))
    return out.when(h.endswith(".icims.com"), _hit("icims", scheme))


def infer_v4(url: Column) -> Column:
    """First provider name that the address contains, else UNKNOWN."""
    return reduce(lambda acc, n: acc.when(url.ilike(f"%{n}%"), n), R.LIKELY_NAMES[1:], F.when(url.ilike(f"%{R.LIKELY_NAMES[0]}%"), R.LIKELY_NAMES[0])).otherwise("UNKNOWN")


def infer_v5(url: Column) -> Column:
    """First pattern that the address matches, else still_unknown."""
    low = F.lower(F.coalesce(url, F.lit("")))
    first = R.PATTERN_PROVIDERS[0]
    return reduce(lambda acc, r: acc.when(low.rlike(r[1]), r[0]), R.PATTERN_PROVIDERS[1:], F.when(low.rlike(first[1]), first[0])).otherwise("still_unknown")


def infer_v6(url: Column, min_length: int = 3) -> Column:
    """As v3 with the token normalised, and dropped where shorter than ``min_length``."""
    hit = infer_v3(url)
    token = F.when(hit["token"].startswith("http"), hit["token"]).otherwise(F.lower(js_trim(hit["token"])))
    return F.when(F.length(token) >= min_length, _hit(hit["provider"], token))


def infer_v6_tagged(url: Column) -> Column:
    """``infer_v6`` with the address to go to, and how it was found: an exact host is of high confidence, from the crawl layer."""
    hit = infer_v6(url)
    embedded = (hit["provider"] == "greenhouse") & (host(url) == "boards.greenhouse.io")
    address = F.when(embedded, F.concat(F.lit("https://boards.greenhouse.io/"), hit["token"])).otherwise(url)
    found = F.struct(hit["provider"].alias("provider"), hit["token"].alias("token"), address.alias("careers_url"), F.lit("high").alias("confidence"), F.lit("website_crawl").alias("layer"))
    return F.when(hit["provider"].isNotNull(), found)


def normalize_provider(c: Column) -> Column:
    key = F.regexp_replace(F.lower(js_trim(c)), r"\s+", "_")
    return nonempty(reduce(lambda acc, kv: acc.when(key == kv[0], kv[1]), list(R.PROVIDER_ALIASES.items())[1:], F.when(key == "ashbyhq", "ashby")).otherwise(key))


def custom_route(text: Column) -> Column:
    first = R.CUSTOM_ROUTES[0]
    return reduce(lambda acc, r: acc.when(F.lower(text).rlike(r[0]), r[1]), R.CUSTOM_ROUTES[1:], F.when(F.lower(text).rlike(first[0]), first[1]))


def resolve_provider(provider: Column, token: Column, careers_url: Column) -> Column:
    """struct<provider, token> that a feed is read by: custom routes, aliases, workday boards from the address."""
    p, t, u = (js_trim(F.coalesce(c, F.lit(""))) for c in (provider, token, careers_url))
    text = F.coalesce(nonempty(t), u)
    route = F.when(F.lower(p).isin("custom", "custom_site"), custom_route(text))
    name = normalize_provider(p)
    full = with_scheme(F.coalesce(nonempty(u), t))
    own = ~sub(full).startswith("wd")
    tenant, board = F.when(own, sub(full)).otherwise(path_part(full, 1)), F.when(own, path_part(full, 1)).otherwise(path_part(full, 2))
    good = tenant.isNotNull() & board.isNotNull() & ~board.isin("en-US", "en-GB")
    return (
        F.when(route.isNotNull(), _hit(route, text))
        .when((name == "workday") & (t != "") & ~t.contains("/"), _hit("workday", F.when(good, F.concat_ws("/", tenant, board)).otherwise(t)))
        .when(name.isNotNull() & (t != ""), _hit(name, t))
    )


def endpoint_token(provider: Column, endpoint: Column) -> Column:
    """Token in an endpoint address, by provider; anything that is no address, or has none, stays as it is."""
    out = F.when(nonempty(endpoint).isNull(), F.lit(None).cast("string")).when(~endpoint.startswith("http"), endpoint)
    cxs = "/cxs/([^/]+)/([^/]+)"
    out = out.when((provider == "workday") & endpoint.rlike(cxs), F.concat_ws("/", F.regexp_extract(endpoint, cxs, 1), F.regexp_extract(endpoint, cxs, 2)))
    for name, pattern in R.ENDPOINT_TOKENS.items():
        out = out.when((provider == name) & endpoint.rlike(pattern), F.regexp_extract(endpoint, pattern, 1))
    return out.when(provider == "teamtailor", host(endpoint)).otherwise(endpoint)


def careers_score(url: Column, text: Column) -> Column:
    """Two points for each pattern in the address and in the text, three more where it is in both."""
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for p in R.CAREERS_PATTERNS:
        a, b = u.rlike(p).cast("int"), t.rlike(p).cast("int")
        total = total + 2 * a + 2 * b + 3 * a * b
    return total


def excluded_path(url: Column) -> Column:
    """Pages that are no careers page: the root, and some fixed paths; malformed addresses too."""
    p = F.regexp_replace(F.lower(path(url)), "/+$", "")
    return F.coalesce(host(url).isNull() | p.isin(*R.EXCLUDED_PATHS), F.lit(True))


def discovery_url(url: Column, company_url: Column) -> Column:
    """A search hit that may be a careers page: known host, the company's own host, or a telling path."""
    h, own = (F.regexp_replace(host(c), r"^www\.", "") for c in (url, company_url))
    tail = F.lower(F.regexp_extract(url, r"(?i)^https?://[^/?#]*(.*)$", 1))
    return F.coalesce(contains_any(h, R.DISCOVERY_HOSTS), F.lit(False)) | F.coalesce(h == own, F.lit(False)) | (h.isNotNull() & tail.rlike(R.DISCOVERY_PATH))


def public_job_url(url: Column) -> Column:
    """The public page of a posting whose stored address is the provider's interface."""
    pattern = r"^https://api\.smartrecruiters\.com/v1/companies/([^/]+)/postings/([^/?]+).*$"
    return F.regexp_replace(url, pattern, "https://jobs.smartrecruiters.com/$1/$2")


def page_links(html: Column) -> Column:
    """Distinct addresses in href and src attributes, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)(?:href|src)\s*=\s*["']([^"'#\s]+)"""), F.lit(1)))


__all__ = [n for n in dir() if not n.startswith("_")] + ["alternatives"]
