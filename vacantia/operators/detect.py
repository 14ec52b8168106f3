"""Detection of providers and tokens from page evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import tokens, urls
from ..functions.values import nonempty


def fingerprint_table(spark: SparkSession) -> DataFrame:
    rows = [(i, p, x) for i, (p, x) in enumerate(R.FINGERPRINTS)]
    return spark.createDataFrame(rows, "priority int, provider string, pattern string")


#: One cheap pattern that every fingerprint's text holds; the sixteen are tried only where it is found.
_ANY = r"(?i)(greenhouse\.io|ashbyhq\.com|lever\.co|workable\.com|teamtailor\.com|bamboohr\.com|smartrecruiters\.com|recruitee\.com|pinpointhq\.com|breezy\.hr|jobvite\.com|myworkdayjobs\.com|icims\.com|successfactors\.com|taleo\.net|avature\.net)"


def best_hit(source: Column, *order: Column) -> Column:
    """struct<invalid, priority, ..., provider, token> of the best fingerprint in a text, null where none fits.

    Each fingerprint takes its first match; one with a generic token is used only where there is no other.
    """
    hits = []
    for i, (provider, pattern) in enumerate(R.FINGERPRINTS):
        token = nonempty(tokens.normalize_token(F.regexp_extract(source, f"(?i){pattern}", 1)))
        hits.append(F.when(token.isNotNull(), F.struct(tokens.is_invalid(token).alias("invalid"), F.lit(i).alias("priority"), *order, F.lit(provider).alias("provider"), token.alias("token"))))
    return F.when(source.rlike(_ANY), F.array_min(F.array_compact(F.array(*hits))))


def fingerprint_scan(sources: DataFrame) -> DataFrame:
    """One row per company with evidence: provider, token, source, valid.

    sources: company_id, pos, source. Provider priority, then source order decide. Sixteen expressions over one
    pass of the sources that hold any provider's host: no join and no explosion by pattern.
    """
    found = sources.withColumn("hit", best_hit(F.col("source"), F.col("pos"))).groupBy("company_id").agg(F.min(F.when(F.col("hit").isNotNull(), F.struct("hit", "source"))).alias("h")).filter("h is not null")
    return found.select("company_id", "h.hit.provider", "h.hit.token", "h.source", (~F.col("h.hit.invalid")).alias("valid"))


def all_matches(sources: DataFrame) -> DataFrame:
    """Every distinct (company, provider, token, source) with its priority."""

    def named(i: int, provider: str):
        return lambda t: F.struct(F.lit(i).alias("priority"), F.lit(provider).alias("provider"), tokens.normalize_token(t).alias("token"))

    parts = [F.transform(F.regexp_extract_all(F.col("source"), F.lit(f"(?i){pattern}"), F.lit(1)), named(i, p)) for i, (p, pattern) in enumerate(R.FINGERPRINTS)]
    hits = sources.filter(F.col("source").rlike(_ANY)).select("company_id", "source", F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("h"))
    return hits.select("company_id", "h.priority", "h.provider", "h.token", "source").filter("token <> ''").distinct()


def best_careers_link(links: DataFrame) -> DataFrame:
    """Per page the best-scored link: links (page_id, pos, url, text); ties go to the first."""
    score = urls.careers_score(F.col("url"), F.col("text"))
    scored = links.withColumn("score", score).filter((F.col("score") > 0) & ~urls.excluded_path(F.col("url")))
    best = scored.groupBy("page_id").agg(F.max_by(F.struct("url", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select("page_id", "b.url", "b.score")


def probe_status(code: Column) -> Column:
    """Status by response code; no response is dead."""
    return F.when(code == 200, "ok").when(code == 404, "bad_token").when(code.isin(401, 403), "auth_or_bot_protected").when(code.isNull() | (code >= 500), "dead").otherwise("bad_token")


def strict_probe_status(code: Column, body_length: Column) -> Column:
    return F.when((code == 200) & (F.coalesce(body_length, F.lit(0)) <= 50), "bad_token").otherwise(probe_status(code))


def gate(token: Column, name: Column, source: Column, company_url: Column, code: Column) -> Column:
    """Decision on a crawl hit: struct<status, note>."""
    out = lambda status, note: F.struct(status.alias("status") if isinstance(status, Column) else F.lit(status).alias("status"), F.lit(note).alias("note"))
    evidence = F.coalesce(F.contains(source, urls.host(company_url)), F.lit(False))
    status = probe_status(code)
    return (
        F.when(nonempty(token).isNull() | tokens.is_invalid(token) | ~tokens.is_plausible(token), out("needs_manual_review", "crawl_invalid_token"))
        .when((tokens.similarity(token, name) == 0) & ~evidence, out("needs_manual_review", "crawl_weak_evidence"))
        .when(status == "bad_token", out("needs_manual_review", "crawl_probe_bad_token"))
        .otherwise(out(status, "source"))
    )


def changed(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether any new value differs from the old one (null equals null)."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | ~a.eqNullSafe(b)
    return out


def write_gate(provider: Column, token: Column, careers_url: Column, verified: Column, confidence: Column, valid: tuple[str, ...]) -> Column:
    """Reason why a detection must not be stored, in order of the checks; null: it may."""
    none = provider.isNull() | (provider == "none")
    has = nonempty(token).isNotNull()
    h = urls.host(token)
    return (
        F.when(provider == "unknown", "unknown_provider")
        .when(provider.isNotNull() & ~provider.isin(*valid, "none"), "invalid_provider")
        .when(~F.coalesce(verified, F.lit(False)), "not_verified")
        .when(none & nonempty(careers_url).isNull(), "no_careers_url")
        .when(~none & ~has, "no_token")
        .when((provider == "custom") & ~token.startswith("http"), "custom_not_url")
        .when(has & (F.length(token) <= 2), "token_too_short")
        .when(has & F.lower(token).isin(*R.INVALID_TOKENS), "generic_token")
        .when(confidence == "none", "no_confidence")
        .when((provider == "workday") & ~token.startswith("http"), "workday_not_url")
        .when((provider == "workday") & ~token.contains("myworkdayjobs.com"), "workday_wrong_host")
        .when((provider == "workday") & h.isin("www.myworkdayjobs.com", "myworkdayjobs.com"), "workday_no_tenant")
        .when(provider.isin("oracle", "icims") & ~token.startswith("http"), "not_url")
    )


def layered(hits: DataFrame) -> DataFrame:
    """Per company the verified hit of the first layer; hits (company_id, layer, verified, provider, token)."""
    w = Window.partitionBy("company_id").orderBy("layer", "provider", "token")
    return hits.filter("verified").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def search_hits(results: DataFrame, limit: int = 8) -> DataFrame:
    """Links of search results: redirects unwrapped, http(s) only, first of repeats, ``limit`` per query.

    results: query_id, rank, link.
    """
    wrapped = urls.query_value(F.col("link"), "uddg")
    link = F.coalesce(F.try_url_decode(wrapped), F.col("link"))
    clean = results.withColumn("link", link).filter(F.col("link").rlike("(?i)^https?://"))
    first = clean.groupBy("query_id", "link").agg(F.min("rank").alias("rank"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "link"))).filter(F.col("n") <= limit).drop("n")


def discovery_queries(companies: DataFrame, limit: int = 16) -> DataFrame:
    """Search texts for each company (id, trading_name, url), in order."""
    name = F.concat(F.lit('"'), F.regexp_replace(F.trim("trading_name"), '"', ""), F.lit('"'))
    h = F.regexp_replace(urls.host(F.col("url")), r"^www\.", "")
    own = F.when(h.isNotNull(), F.array(F.concat(name, F.lit(" site:"), h), F.concat(F.lit("site:"), h, F.lit(" careers")))).otherwise(F.array().cast("array<string>"))
    plain = F.array(*(F.concat(name, F.lit(f" {x}")) for x in ("careers", "jobs", "apply", "hiring careers", "work with us", "careers UK", "jobs UK")))
    texts = F.slice(F.array_distinct(F.concat(own, plain)), 1, limit)
    return companies.select("id", F.posexplode(texts).alias("n", "query"))
