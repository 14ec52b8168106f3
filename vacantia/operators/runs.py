"""Detection runs over recorded evidence: search hits, heuristic tokens, verdicts, summaries, import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import tokens, urls
from ..functions.location import verdict_words
from ..functions.values import cut, js_trim, nonempty
from ..tables import dealt, lookup
from . import detect
from .grams import candidates


def match_search_hits(results: DataFrame) -> DataFrame:
    """Per query the first result that names a provider, by its link, else by its snippet.

    results: query_id, rank, link, snippet. Result: query_id, provider, token, source (link or snippet), careers_url.
    Results are narrow and their patterns slow, so they are dealt by row first.
    """
    link, snippet = (detect.best_hit(F.col(c)) for c in ("link", "snippet"))
    marked = dealt(results, "query_id", "rank").withColumn("l", link).withColumn("s", snippet)
    hit = F.coalesce("l", "s")  # no filter by it: that would be pushed below the exchange, patterns and all
    row = F.struct("rank", hit["provider"].alias("provider"), hit["token"].alias("token"), F.when(F.col("l").isNotNull(), "link").otherwise("snippet").alias("source"), nonempty(F.col("link")).alias("careers_url"))
    best = marked.groupBy("query_id").agg(F.min_by(row, F.when(hit.isNotNull(), F.col("rank"))).alias("b"), F.max(hit.isNotNull()).alias("any"))
    return best.filter("any").select("query_id", "b.provider", "b.token", "b.source", "b.careers_url")


def heuristic_tokens(name: Column, *addresses: Column, most: int = 6) -> Column:
    """The first ``most`` distinct slugs of a name, the name without blanks, and the first and last-but-one label of each host."""

    def slug(c: Column) -> Column:
        c = F.regexp_replace(F.regexp_replace(tokens.normalize_token(c), r"^www\.", ""), "[^a-z0-9-]", "-")
        return F.regexp_replace(F.regexp_replace(c, "-+", "-"), "^-+|-+$", "")

    found = [name, F.regexp_replace(name, r"\s+", "")]
    for address in addresses:
        labels = F.split(F.regexp_replace(urls.host(address), r"^www\.", ""), r"\.")
        found += [F.try_element_at(labels, F.lit(1)), F.when(F.size(labels) > 1, F.try_element_at(labels, F.lit(-2)))]
    good = F.filter(F.array(*map(slug, found)), lambda t: t.isNotNull() & (F.length(t) >= 3) & ~tokens.is_invalid(t))
    return F.slice(F.array_distinct(good), 1, most)


def heuristic_pairs(companies: DataFrame) -> DataFrame:
    """id, n, provider, token to probe, in order: companies has id and tokens (see ``heuristic_tokens``)."""
    providers = F.array(*map(F.lit, R.HEURISTIC_PROVIDERS))
    pairs = F.flatten(F.transform(providers, lambda p: F.transform("tokens", lambda t: F.struct(p.alias("provider"), t.alias("token")))))
    return companies.select("id", F.posexplode(pairs).alias("n", "p")).select("id", "n", "p.provider", "p.token")


def first_probe(pairs: DataFrame) -> DataFrame:
    """Per id the first pair (by n) whose recorded status is not bad_token; pairs: id, n, provider, token, status."""
    best = pairs.filter(~(F.col("status") == "bad_token")).groupBy("id").agg(F.min_by(F.struct("provider", "token", "status"), "n").alias("b"))
    return best.select("id", "b.provider", "b.token", "b.status")


def writable(provider: Column, token: Column, status: Column) -> Column:
    """The second write gate: a known provider with a token of its own that did not fail its probe."""
    full = provider.isin(*R.FULL_URL_PROVIDERS)
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(js_trim(token)), "[^a-z0-9-]", "-"), "-+", "-"), "^-+|-+$", "")
    generic = (F.length(t) < 3) | t.isin(*R.GENERIC_TOKENS)
    bad = ~provider.isin(*R.WRITABLE_PROVIDERS) | (~full & generic) | (F.length(token) <= 2) | (full & ~token.rlike("(?i)^https?://"))
    bad = bad | ((provider == "workday") & ~token.contains("myworkdayjobs.com")) | F.coalesce(status.isin("bad_token", "dead"), F.lit(False))
    return F.when(nonempty(provider).isNull() | nonempty(token).isNull(), False).otherwise(~bad)


def summary(runs: DataFrame) -> DataFrame:
    """One row of counts over run rows (old_provider, old_token, new_provider, new_token, status).

    A corrected token has two definitions: token_corrected wants an old token under one provider (two
    missing providers are equal); token_changed wants an old provider, and a token that differs, null from text too.
    """
    has = lambda c: nonempty(F.col(c)).isNotNull()
    same = F.col("old_provider").eqNullSafe(F.col("new_provider"))
    differs = ~F.col("old_token").eqNullSafe(F.col("new_token"))
    counts = {
        "total": F.lit(True), "newly_configured": (~has("old_provider") | ~has("old_token")) & has("new_provider") & has("new_token"),
        "token_corrected": same & has("old_token") & differs, "token_changed": has("old_provider") & same & differs,
    } | {f"status_{s}": F.col("status") == s for s in ("ok", "unchecked", "no_careers_page_found", "auth_or_bot_protected", "needs_manual_review", "dead")}
    return runs.agg(*(F.count_if(c).alias(name) for name, c in counts.items()))


def jobs_found(provider: Column, body: Column) -> Column:
    """Estimate from a probe's body: the length of the provider's list; else 1 for a body of over 50 characters."""
    v = F.try_parse_json(body)
    size = F.lit(None).cast("int")
    for name, path in R.PROBE_LISTS.items():
        size = F.when(provider == name, F.size(F.try_variant_get(v, path, "array<variant>"))).otherwise(size)
    return F.when(size >= 0, size).otherwise(F.when(F.length(body) > 50, 1).otherwise(0))


def verdict(provider: Column, token: Column, url: Column, code: Column, body: Column) -> Column:
    """Dead URL, No UK Jobs or UK, by a recorded response: list locations where the provider has a feed, else the page's words."""
    p, t, page = F.lower(js_trim(F.coalesce(provider, F.lit("")))), js_trim(F.coalesce(token, F.lit(""))), js_trim(F.coalesce(url, F.lit("")))
    v = F.try_parse_json(body)
    jobs = F.lit(None).cast("array<variant>")
    text = lambda j, path: F.coalesce(F.try_variant_get(j, path, "string"), F.lit(""))

    def in_uk(fields):
        return lambda j: verdict_words(F.concat_ws(" ", *(text(j, f) for f in fields)))

    hits = F.lit(False)
    for name, (path, fields) in R.VERDICT_FEEDS.items():
        mine = F.try_variant_get(v, path, "array<variant>")
        jobs = F.when(p == name, mine).otherwise(jobs)
        hits = F.when(p == name, F.exists(mine, in_uk(fields))).otherwise(hits)
    feed = p.isin(*R.VERDICT_FEEDS)
    dead = t.isin("") | (F.lower(t) == "nan") | (~feed & (page.isin("") | (F.lower(page) == "nan"))) | F.coalesce(code != 200, F.lit(True)) | (feed & v.isNull())
    return F.when(dead, "Dead URL").when(feed, F.when(F.coalesce(F.size(jobs), F.lit(0)) > 0, F.when(hits, "UK").otherwise("No UK Jobs")).otherwise("No UK Jobs")).when(verdict_words(body), "UK").otherwise("No UK Jobs")


def import_rows(sheet: DataFrame, companies: DataFrame) -> DataFrame:
    """Sheet rows (company_id, provider and board_token as texts) of known companies, providers by the importer's own alias map."""
    known = companies.select(F.col("id").alias("company_id"))
    clean = sheet.withColumn("company_id", F.expr("try_cast(trim(company_id) AS bigint)")).filter("company_id > 0").join(known, "company_id")
    key = F.regexp_replace(F.lower(js_trim(F.col("provider"))), r"\s+", "_")
    alias = F.create_map(*(F.lit(x) for name in R.IMPORT_PROVIDERS for x in (name, name)))
    return clean.select("company_id", F.try_element_at(alias, key).alias("provider"), tokens.clean_cell(F.col("board_token")).alias("board_token"))


def graduate_rows(results: DataFrame, run_id: str) -> DataFrame:
    """Search results of the graduate board as stored rows, the last of each address (pos).

    results: pos, jobId, employerName, jobTitle, locationName, jobUrl, minimumSalary, maximumSalary.
    """
    last = results.filter(F.coalesce("jobUrl", F.lit("")) != "").groupBy("jobUrl").agg(F.max_by(F.struct(*[c for c in results.columns if c != "jobUrl"]), "pos").alias("j"))
    text = lambda c, n: cut(F.coalesce(F.col(f"j.{c}"), F.lit("")), n)
    salary = F.when(F.coalesce(F.col("j.minimumSalary"), F.lit(0)) != 0, F.concat(F.lit("£"), F.col("j.minimumSalary").cast("string"), F.lit(" - £"), F.coalesce(F.col("j.maximumSalary").cast("string"), F.lit("null"))))
    return last.select(
        F.concat(F.lit("reed-"), F.col("j.jobId").cast("string")).alias("id"), F.lit(0).alias("company_id"), text("employerName", 200).alias("trading_name"), text("jobTitle", 500).alias("title"),
        text("locationName", 500).alias("location"), cut(F.col("jobUrl"), 500).alias("url"), F.lit("Graduate").alias("level"), salary.alias("salary"), F.lit(run_id).alias("sync_run_id"),
    )


def choose_attempt(postings: DataFrame, valid: Column) -> DataFrame:
    """Postings with a valid title of each company's first attempt that has any (company_id, attempt_no, ...)."""
    good = postings.filter(valid)
    first = good.groupBy("company_id").agg(F.min("attempt_no").alias("attempt_no"))
    return good.join(first, ["company_id", "attempt_no"])


def set_first_by_name(companies: DataFrame, names: DataFrame) -> DataFrame:
    """Provider and token set on the first company (by id) whose name contains each wanted one; others stay, later names win.

    names: n (distinct), name, ats_provider, ats_board_token. Companies meet only the wanted names that share a gram with theirs.
    """
    wanted = names.withColumn("__like", F.concat(F.lit("%"), F.col("name"), F.lit("%")))
    pairs = candidates(companies.select("id", F.col("trading_name").alias("text")), wanted.select(F.col("n").alias("rule"), F.col("__like").alias("pattern")))
    hits = pairs.withColumnRenamed("rule", "n").join(lookup(wanted), "n").filter(F.ilike("text", F.col("__like")))
    first = hits.groupBy("n").agg(F.min_by(F.struct("id", F.col("ats_provider").alias("__p"), F.col("ats_board_token").alias("__t")), "id").alias("h"))
    won = first.groupBy(F.col("h.id").alias("id")).agg(F.max_by("h", "n").alias("h"))
    hit = F.col("h").isNotNull()
    return companies.join(won, "id", "left").withColumns({"ats_provider": F.when(hit, F.col("h.__p")).otherwise(F.col("ats_provider")), "ats_board_token": F.when(hit, F.col("h.__t")).otherwise(F.col("ats_board_token"))}).drop("h")


def only_row(df: DataFrame, absent_is_fine: bool = False):
    """The one row of a point lookup; two rows are an error, none is one unless ``absent_is_fine``."""
    found = df.limit(2).collect()
    if len(found) > 1 or (not found and not absent_is_fine):
        raise LookupError(f"{'no row' if not found else 'more than one row'} where one was expected")
    return found[0] if found else None


def subscription_users(subscriptions: DataFrame, customers: DataFrame) -> DataFrame:
    """Subscriptions with the user of their payment customer; those of unknown customers are left out.

    subscriptions: customer, ...; customers: user_id, customer (unique).
    """
    return subscriptions.join(customers, "customer").drop("customer")


def top_saved(results: DataFrame, n: int = 10) -> DataFrame:
    """Companies with saved postings, the ``n`` with most (ties by id)."""
    return results.filter("saved > 0").orderBy(F.desc("saved"), "id").limit(n)


def client_page(df: DataFrame, order: list[Column], page: int, size: int = 12) -> DataFrame:
    """Slice ``page`` (from 1) of a sorted list that is shown ``size`` rows at a time."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)
