"""Location predicates, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .values import alternatives, any_of, bind, contains_any, has_words, js_trim

POSTCODE = r"[a-z]{1,2}[0-9][a-z0-9]?\s?[0-9][a-z]{2}"
SOME_LOCATIONS = r"[0-9]+\s+locations?"


def _single(terms):
    return [t for t in terms if " " not in t and not t.endswith(".")]


def _phrases(terms):
    return [t for t in terms if " " in t]


_UK = (*R.UK_NATIONS, *R.UK_COUNTRY, *R.UK_PLACES)
_BLOCKED = R.BLOCKED_PLACES


def normalize_location(c: Column) -> Column:
    """Lower case, brackets dropped, separators to blanks, blanks squeezed; null becomes empty."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[()\[\]]", "")
    return js_trim(F.regexp_replace(F.regexp_replace(c, r"[/\-_|,;]", " "), r"\s+", " "))


def uk_term(loc: Column) -> Column:
    """One lower-case location names a UK place (single words by boundary, phrases anywhere)."""
    new_york = has_words(loc, r"new\s+york")
    return (
        has_words(loc, POSTCODE)
        | contains_any(loc, _phrases(_UK))
        | has_words(loc, alternatives(t for t in _single(_UK) if t != "york"))
        | loc.rlike(r"(^|[^a-z0-9_])u\.k\.[a-z0-9_]")  # a boundary behind a dot needs a word character there
        | (has_words(loc, "york") & ~new_york)
    )


def blocked_term(loc: Column) -> Column:
    """One lower-case location names a place outside; Northern Ireland never counts as Ireland."""
    return (
        contains_any(loc, _phrases(_BLOCKED))
        | has_words(loc, alternatives(t for t in _single(_BLOCKED) if t != "ireland"))
        | (has_words(loc, "ireland") & ~loc.contains("northern ireland"))
    )


def is_uk_job(evidence: Column) -> Column:
    """evidence: struct<locations:array<string>, is_remote:boolean, is_trusted_source:boolean>.

    Trust, then UK over blocked, then open wordings, then the remote flag. Null parts are empty or false.
    """
    locs = F.filter(F.transform(F.coalesce(evidence["locations"], F.array().cast("array<string>")), lambda x: js_trim(F.lower(x))), lambda x: x != "")
    uk = F.exists(locs, uk_term)
    blocked = F.exists(locs, lambda x: blocked_term(x) & ~x.contains("northern ireland"))
    open_ = F.exists(locs, lambda x: x.rlike(SOME_LOCATIONS) | x.rlike(r"multiple\s+locations?") | contains_any(x, R.GLOBAL_SIGNALS))
    trusted, remote = F.coalesce(evidence["is_trusted_source"], F.lit(False)), F.coalesce(evidence["is_remote"], F.lit(False))
    return F.when(trusted, True).when(blocked & ~uk, False).when(uk, True).otherwise(open_ | remote)


def evidence(locations: Column, remote: Column, trusted: Column) -> Column:
    return F.struct(locations.alias("locations"), F.coalesce(remote, F.lit(False)).alias("is_remote"), F.coalesce(trusted, F.lit(False)).alias("is_trusted_source"))


def default_evidence(location: Column) -> Column:
    """Evidence from a plain location text: offices split at bars and bullets."""
    raw = F.coalesce(location, F.lit(""))
    parts = F.filter(F.transform(F.split(raw, r"\s*[|·•]\s*"), js_trim), lambda x: x != "")
    locs = F.when(F.size(parts) > 0, parts).when(raw != "", F.array(raw)).otherwise(F.array().cast("array<string>"))
    return evidence(locs, has_words(F.lower(raw), "remote"), F.lit(False))


def _tokens_in(loc: Column, terms) -> Column:
    return F.arrays_overlap(F.split(loc, r"\s+"), F.array(*map(F.lit, terms)))


def is_uk_location_v1(location: Column) -> Column:
    """Ordered rules on a normalised location. Upper-case country names never equal a lower-case token."""
    return F.when(location.isNull(), False).otherwise(bind(normalize_location(location), _v1))


def _v1(n: Column) -> Column:
    names = [t.lower() for t in R.V1_COUNTRIES]
    signal = contains_any(n, [*names, *R.UK_NATIONS, *R.V1_PLACES])
    phrases = [t for t in (*R.V1_COUNTRIES, *R.UK_NATIONS, *R.V1_PLACES) if " " in t]
    return (
        F.when(n == "", False)
        .when(n.isin("remote", "anywhere", "worldwide"), False)
        .when(contains_any(n, R.V1_IRISH) & ~n.contains("northern ireland") & ~signal, False)
        .when(contains_any(n, R.V1_BLOCKS), False)
        .when(has_words(n, alternatives(R.V1_CODES)) & ~has_words(n, r"[a-z]{1,2}[0-9][a-z0-9]?\s*[0-9][a-z]{2}"), False)
        .when(n.contains("remote") & contains_any(n, ("uk", "united kingdom", "england", "britain")), True)
        .otherwise(_tokens_in(n, [*R.V1_COUNTRIES, *R.UK_NATIONS, *R.V1_PLACES]) | has_words(n, "england") | has_words(n, POSTCODE) | contains_any(n, phrases))
    )


def is_uk_location_v2(location: Column) -> Column:
    low = F.lower(F.coalesce(location, F.lit("")))
    ends = any_of(low.endswith(x) for x in (" uk", ", uk", " united kingdom"))
    return (low != "") & ~low.contains("ukraine") & (has_words(low, alternatives(R.V2_WORDS)) | low.rlike("[0-9]+ locations") | ends)


def is_uk_location_v3(location: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(location, F.lit(""))), "[()]", "")
    n = js_trim(F.regexp_replace(F.regexp_replace(low, r"[/\-_|,]", " "), r"\s+", " "))
    terms = (*R.V3_COUNTRIES, *R.UK_NATIONS, *R.V3_CITIES)
    remote = n.contains("remote") & contains_any(n, ("uk", "united kingdom"))
    return (n != "") & ~n.contains("ukraine") & (remote | _tokens_in(n, terms) | contains_any(n, _phrases(terms)))


def is_uk_location_v4(location: Column) -> Column:
    """Any keyword as a plain substring, also inside other words."""
    return contains_any(F.lower(F.coalesce(location, F.lit(""))), R.V4_WORDS)


def verdict_words(text: Column) -> Column:
    return has_words(F.lower(F.coalesce(text, F.lit(""))), alternatives(R.VERDICT_WORDS))


def cleanup_bad(location: Column) -> Column:
    """Stored jobs whose location is outside; an empty or null location stays."""
    low = F.lower(F.coalesce(location, F.lit("")))
    bad = contains_any(low, R.CLEANUP_BLOCKS) | (has_words(low, alternatives(R.CLEANUP_CODES)) & ~low.contains("australia"))
    return (low != "") & bad & ~contains_any(low, R.CLEANUP_RESCUES)


def _first_hit(text: Column, terms) -> Column:
    """The first of the terms, in their order, that the text contains, else null."""
    named = F.try_element_at(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)), F.lit(1))
    return F.when(contains_any(text, terms), named)


def likely_uk(location: Column, url: Column, title: Column, department: Column, verified: Column) -> Column:
    """The five-signal cascade with reasons: struct<keep:boolean, needs_review:boolean, reason:string>."""
    texts = [F.lower(F.coalesce(c, F.lit(""))).alias(n) for n, c in (("link", url), ("name", title), ("team", department))]
    given = F.struct(normalize_location(location).alias("loc"), *texts, F.coalesce(verified, F.lit(False)).alias("verified"))
    return bind(given, lambda g: bind(F.struct(_first_hit(g["link"], R.NON_UK_URL_HINTS).alias("url"), _first_hit(g["loc"], R.LIKELY_BLOCKED).alias("loc")), lambda bad: _cascade(g, bad)))


def _cascade(given: Column, bad: Column) -> Column:
    loc, link, name, team = (given[c] for c in ("loc", "link", "name", "team"))
    ambiguous = loc.isin(*R.AMBIGUOUS) | loc.rlike(SOME_LOCATIONS)
    terms = "|".join(t.lower().replace(" ", r"[\s.\-]+") for t in (*R.V1_COUNTRIES, *R.UK_NATIONS, *R.V1_PLACES))

    def out(keep: bool, review: bool = False, reason: Column | str | None = None) -> Column:
        reason = F.lit(reason) if not isinstance(reason, Column) else reason
        return F.struct(F.lit(keep).alias("keep"), F.lit(review).alias("needs_review"), reason.cast("string").alias("reason"))

    settled = (loc != "") & ~ambiguous
    return (
        F.when(bad["url"].isNotNull(), out(False, reason=F.concat(F.lit("non_uk_url: "), bad["url"])))
        .when(bad["loc"].isNotNull() & ~loc.contains("northern ireland"), out(False, reason=F.concat(F.lit("non_uk_location: "), bad["loc"])))
        .when(given["verified"], out(True))
        .when((loc != "") & _v1(loc), out(True))
        .when((loc == "remote") & contains_any(link, (".uk", "country=gb", "country=uk")), out(True))
        .when(settled & contains_any(loc, R.WIDE_AREAS), out(True, True))
        .when(settled, out(False, reason="failed_uk_location_check"))
        .when(contains_any(link, R.UK_URL_HINTS), out(True))
        .when(has_words(link, "uk|united.kingdom|england|scotland|wales|northern.ireland"), out(True))
        .when(has_words(name, terms) | has_words(team, terms), out(True))
        .when(loc == "", out(True, True))
        .otherwise(out(False, reason="no_uk_signals"))
    )
