"""DuckDB SQL of the registered queries, written apart from the column expressions.

Only the values (lists of fixtures and of rules) are shared with the Spark side.
"""

from __future__ import annotations

from . import fixtures as X
from .functions import rules as R
from .queries import FEEDS


def q(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"


def pick(values, key: str) -> str:
    return f"([{', '.join(map(q, values))}])[({key} % {len(values)}) + 1]"


def esc(t: str) -> str:
    return "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in t)


def alt(terms) -> str:
    return "|".join(map(esc, terms))


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def bw(col: str, pattern: str) -> str:
    return rx(col, f"(^|[^a-z0-9_])({pattern})($|[^a-z0-9_])")


def trim(col: str) -> str:
    return f"regexp_replace({col}, '^[\\s\\x{{a0}}\\x{{feff}}]+|[\\s\\x{{a0}}\\x{{feff}}]+$', '', 'g')"


def case(pairs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


C = f"""c AS (
  SELECT c_custkey AS id, c_name AS trading_name, CASE WHEN c_custkey % 7 <> 0 THEN lower(c_mktsegment) END AS ats_provider,
         c_nationkey % 2 = 0 AS licensed_sponsor, o.n AS active_jobs_count, {pick(X.HOSTS, "c_custkey")} AS careers_url,
         {pick(X.STATUSES, "c_custkey")} AS ats_status, c_custkey % 4 AS ats_failure_count, {pick(X.TOKENS, "c_custkey")} AS ats_board_token
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey)"""
J = f"""j AS (
  SELECT o_orderkey AS id, o_custkey AS company_id, {pick(X.TITLES, "o_orderkey")} AS title, {pick(X.LOCATIONS, "o_orderkey")} AS location,
         {pick(X.DEPARTMENTS, "o_orderkey")} AS department, 'https://example.test/' || o_custkey || '/' || (o_orderkey % 5000) AS url,
         CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate END AS created_at
  FROM orders)"""
G = f"""g AS (
  SELECT 'g-' || lpad(p_partkey::VARCHAR, 8, '0') AS id, p_name AS title, p_brand AS trading_name, {pick(X.LOCATIONS, "p_partkey")} AS location,
         1700000000 + p_partkey * 60 AS created_at, CASE p_partkey % 3 WHEN 0 THEN 'r1' WHEN 1 THEN 'r2' END AS sync_run_id
  FROM part)"""
S = f"""s AS (
  SELECT s_suppkey AS pos, s_name AS organisation, {pick(X.TOWNS, "s_suppkey")} AS town, 'County ' || (s_suppkey % 11) AS county,
         ['Worker (A rating)', 'Temporary Worker (A rating)', 'Worker (B rating)'][(s_suppkey % 3) + 1] AS rating
  FROM supplier)"""

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- feed

ORDER = {
    "newest": "created_at DESC NULLS FIRST, id DESC", "oldest": "created_at ASC NULLS LAST, id ASC",
    "title_asc": "title ASC NULLS LAST, id DESC", "title_desc": "title DESC NULLS FIRST, id DESC",
}


def any_like(cols, terms) -> str:
    return "(" + " OR ".join(f"{c} ILIKE {q('%' + t + '%')}" for t in terms for c in cols) + ")"


CITIES = ["Manchester", "Birmingham", "Leeds", "Glasgow", "Sheffield", "Bristol", "Liverpool", "Newcastle", "Nottingham", "Southampton", "Reading"]
WHERE = {
    "feed_newest": "licensed_sponsor",
    "feed_search": any_like(["title", "trading_name"], ["data "]),
    "feed_search_company": any_like(["title", "trading_name"], ["#00000001%"]),
    "feed_city": any_like(["location"], ["london"]),
    "feed_multi_location": any_like(["location"], ["Leeds", "Remote"]),
    "feed_exclusions": "NOT (id BETWEEN 0 AND 399) AND company_id NOT IN (1, 2, 3, 5, 8, 13)",
    "feed_prefs_locations": "licensed_sponsor AND " + any_like(["location"], [*CITIES, "Scotland"]),
    "feed_prefs_types": any_like(["title"], ["intern", "placement", "internship", "student", "graduate", "part-time", "part time", "hourly", "flexible"]),
    "feed_prefs_sectors": any_like(["title", "department"], ["data", "analytics", "statistics", "machine learning", "ai", "sql", "python", "bi", "business intelligence", "design", "ui", "ux", "product designer", "graphic", "creative", "art"]),
}
for name, r in FEEDS.items():
    m = f"WITH {C}, {J}, m AS (SELECT j.*, trading_name, licensed_sponsor FROM j JOIN c ON c.id = company_id WHERE {WHERE.get(name, 'true').replace('(id ', '(j.id ')})"
    if name == "feed_company_page":
        SQL[name] = m.replace("WHERE true", "WHERE company_id = 36") + f""", n AS (SELECT *, row_number() OVER (ORDER BY {ORDER['newest']}) AS k FROM m)
          SELECT k - 10 AS pos, id, company_id, trading_name, title, location FROM n WHERE k BETWEEN 11 AND 20"""
        continue
    SQL[name] = m + f""",
      t AS (SELECT *, row_number() OVER (ORDER BY {ORDER[r.sort]}) AS k FROM m QUALIFY k <= 50),
      u AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY k) > 1 AS again FROM t),
      v AS (SELECT *, row_number() OVER (ORDER BY again, k) AS pos FROM u)
      SELECT pos, id, company_id, trading_name, title, location FROM v WHERE pos <= 10"""

SQL["feed_total_pages"] = f"""WITH {C}, {J}, m AS (SELECT count(*) + 40 AS n FROM j JOIN c ON c.id = company_id WHERE location ILIKE '%london%' AND j.id >= 40)
  SELECT n, ceil(n / 10)::BIGINT AS total_pages FROM m"""
SQL["graduate_feed"] = f"""WITH {G} SELECT row_number() OVER (ORDER BY created_at DESC, id DESC) AS pos, id, title, trading_name FROM g
  WHERE title ILIKE '%e%' OR trading_name ILIKE '%e%' QUALIFY pos <= 50"""

# ---------------------------------------------------------------- browse


def companies(where: str, order: str, page: int = 1) -> str:
    return f"""WITH {C}, n AS (SELECT id, trading_name, active_jobs_count, row_number() OVER (ORDER BY {order}, id) AS k FROM c WHERE {where})
      SELECT k - {(page - 1) * 10} AS pos, id, trading_name, active_jobs_count FROM n WHERE k > {(page - 1) * 10} AND k <= {page * 10}"""


MOST = "active_jobs_count DESC NULLS LAST, trading_name"
SQL["companies_by_jobs"] = companies("id NOT IN (4, 5)", MOST, 2)
SQL["companies_by_jobs_asc"] = companies("true", "active_jobs_count ASC NULLS LAST, trading_name")
SQL["companies_alpha"] = companies("true", "trading_name", 3)
SQL["companies_alpha_desc"] = companies("trading_name ILIKE '%#0000000_2%%'", "trading_name DESC")
SQL["companies_favorites"] = companies("id IN (SELECT event_id % 1500 FROM events WHERE event_type = 'click' AND user_id < 40)", MOST)
SQL["company_detail"] = f"WITH {J} SELECT row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id DESC) AS pos, id, title FROM j WHERE company_id = 10"
SQL["register_search"] = f"WITH {S} SELECT * FROM s WHERE contains(lower(organisation), 'le') OR contains(lower(town), 'le') OR contains(lower(county), 'le')"
SQL["register_tab"] = f"WITH {S} SELECT * FROM s WHERE contains(rating, 'A rating')"
SQL["register_new"] = f"WITH {S} SELECT * FROM s ORDER BY pos LIMIT 7"
SQL["register_stats"] = f"WITH {S} SELECT count(*) AS total, floor(count(*) * 0.114)::BIGINT AS new_since, floor(count(*) * 0.0074)::BIGINT AS removed FROM s"
SQL["occupation_search"] = """WITH o AS (SELECT p_partkey::VARCHAR AS code, p_name AS name, CASE WHEN p_size % 3 > 0 THEN p_type END AS related_titles FROM part)
  SELECT * FROM o WHERE contains(lower(name), 'al') OR contains(code, 'al') OR coalesce(contains(lower(related_titles), 'al'), false)"""

# ---------------------------------------------------------------- reports

SQL["diag_company_job_counts"] = f"""WITH {C}, {J} SELECT c.id, trading_name, count(j.id) AS jobs_in_db, strftime(max(created_at), '%Y-%m-%d') AS most_recent_job
  FROM c LEFT JOIN j ON company_id = c.id WHERE trading_name ILIKE '%00001%' OR trading_name ILIKE '%9_' GROUP BY 1, 2"""
SQL["diag_locations"] = f"""WITH {C}, {J} SELECT location, count(*) AS job_count FROM j JOIN c ON c.id = company_id WHERE trading_name ILIKE '%1%'
  GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 50"""
SQL["diag_provider_summary"] = f"""WITH {C}, {J} SELECT ats_provider, count(DISTINCT c.id) AS company_count, count(DISTINCT j.id) AS total_jobs,
  count(DISTINCT CASE WHEN j.id IS NULL THEN c.id END) AS companies_with_zero_jobs FROM c LEFT JOIN j ON company_id = c.id WHERE ats_provider IS NOT NULL GROUP BY 1"""
SQL["diag_null_provider"] = f"WITH {C} SELECT count(DISTINCT id) AS null_provider_companies, count(DISTINCT CASE WHEN careers_url IS NOT NULL THEN id END) AS with_careers_url FROM c WHERE ats_provider IS NULL"
SQL["diag_config_status"] = f"WITH {C} SELECT CASE WHEN careers_url IS NOT NULL THEN 'Has careers_url' ELSE 'No careers_url' END AS config_status, count(*) AS company_count FROM c WHERE ats_provider IS NULL GROUP BY 1"
LIKELY = case([(f"careers_url ILIKE '%{n}%'", q(n)) for n in "greenhouse workable lever ashby teamtailor bamboohr breezy smartrecruiters icims workday personio pinpoint jobvite avature".split()], "'UNKNOWN'")
SQL["diag_likely_ats"] = f"WITH {C} SELECT id, trading_name, careers_url, {LIKELY} AS likely_ats FROM c WHERE ats_provider IS NULL AND careers_url IS NOT NULL ORDER BY likely_ats, trading_name LIMIT 100"
SQL["baseline_provider_status"] = f"WITH {C} SELECT coalesce(ats_provider, 'unknown') AS ats_provider, coalesce(ats_status, 'null') AS ats_status, count(*) AS company_count FROM c GROUP BY 1, 2"
V5 = case([(rx("lower(coalesce(careers_url, ''))", p), q(n)) for n, p in R.PATTERN_PROVIDERS], "'still_unknown'")
SQL["detectable_pct"] = f"WITH {C}, k AS (SELECT {V5} AS ats, count(*) AS n FROM c WHERE ats_provider IS NULL GROUP BY 1) SELECT ats, n, round(100 * n / sum(n) OVER (), 1) AS pct FROM k"
SQL["rejection_top5"] = f"SELECT coalesce({pick(X.REASONS, 'o_orderkey')}, 'unknown') AS reason, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, reason LIMIT 5"
SQL["status_counts"] = f"WITH {C} SELECT count(*) AS total, count(*) FILTER (ats_status = 'ok') AS ok, count(*) FILTER (ats_status = 'dead') AS dead, count(*) FILTER (ats_status = 'bad_token') AS bad_token FROM c"
SQL["jobs_by_provider"] = f"WITH {C}, {J} SELECT coalesce(ats_provider, 'unknown') AS ats_provider, count(*) AS job_count FROM j JOIN c ON c.id = company_id GROUP BY 1"
SQL["jobs_by_company"] = f"WITH {C}, {J} SELECT c.id AS company_id, trading_name, ats_provider, count(*) AS job_count FROM j JOIN c ON c.id = company_id GROUP BY ALL ORDER BY job_count DESC, company_id LIMIT 200"

# ---------------------------------------------------------------- classification


def level(title: str) -> str:
    low = f"lower({title})"
    pairs = [(f"{title} IS NULL OR {title} = ''", "NULL")]
    for name, words in R.LEVELS:
        pairs.append((f"{bw(low, 'vp')} OR contains({low}, 'vice president')" if words.startswith("~") else bw(low, words), q(name)))
    return case(pairs, q(R.DEFAULT_LEVEL))


def sector(title: str, dept: str) -> str:
    text = trim(f"(lower({title}) || ' ' || lower(coalesce({dept}, '')))")
    return case([(f"{title} IS NULL OR {trim(title)} = ''", "NULL"), *((bw(text, words), q(name)) for name, words in R.SECTORS)])


def norm(col: str, strip: str = r"[()\[\]]", sep: str = r"[/\-_|,;]") -> str:
    s = f"regexp_replace(lower(coalesce({col}, '')), {q(strip)}, '', 'g')"
    return trim(f"regexp_replace(regexp_replace({s}, {q(sep)}, ' ', 'g'), '\\s+', ' ', 'g')")


POST = r"[a-z]{1,2}\d[a-z\d]?\s?\d[a-z]{2}"
UK = [*R.UK_NATIONS, *R.UK_COUNTRY, *R.UK_PLACES]
BLOCK = R.BLOCKED_PLACES
one = lambda terms, *no: alt(t for t in terms if " " not in t and t not in ("u.k.", *no))
two = lambda terms: alt(t for t in terms if " " in t)
SQL["infer_level"] = f"WITH {J} SELECT id, {level('title')} AS level FROM j"
SQL["infer_sector"] = f"WITH {J} SELECT id, {sector('title', 'department')} AS sector FROM j"
SQL["infer_sector_texts"] = f"SELECT doc_id, {sector('text', 'source')} AS sector, {level('text')} AS level FROM documents"
LOW_T = trim("lower(title)")
SQL["valid_title"] = f"""WITH {J} SELECT id, length(title) >= 3 AND {LOW_T} NOT IN ({', '.join(map(q, R.JUNK_TITLES))})
  AND NOT (length({LOW_T}) < 40 AND ({' OR '.join(f'starts_with({LOW_T}, {q(t)})' for t in R.JUNK_TITLES)})) AS valid FROM j"""
SQL["normalize_location"] = f"WITH {J} SELECT id, {norm('location')} AS normalized FROM j"
SQL["is_uk_job"] = f"""WITH {J}, p AS (SELECT id, location, {trim("unnest(regexp_split_to_array(lower(coalesce(location, '')), '\\s*[|·•]\\s*'))")} AS part FROM j),
  f AS (SELECT *, {rx('part', two(UK))} OR {bw('part', one(UK, 'york'))} OR {bw('part', POST)} OR {rx('part', r'(^|[^a-z0-9_])u[.]k[.][a-z0-9_]')}
                  OR ({bw('part', 'york')} AND NOT {bw('part', r'new\s+york')}) AS uk,
               NOT contains(part, 'northern ireland') AND ({rx('part', two(BLOCK))} OR {bw('part', one(BLOCK))}) AS blocked,
               {rx('part', r'\d+\s+locations?')} OR {rx('part', r'multiple\s+locations?')} OR {rx('part', alt(R.GLOBAL_SIGNALS))} AS open FROM p WHERE part <> ''),
  a AS (SELECT id, bool_or(uk) AS uk, bool_or(blocked) AS blocked, bool_or(open) AS open FROM f GROUP BY id)
  SELECT j.id, j.location, CASE WHEN coalesce(blocked, false) AND NOT uk THEN false WHEN uk THEN true ELSE coalesce(open, false) OR {bw("lower(coalesce(location, ''))", 'remote')} END AS keep
  FROM j LEFT JOIN a USING (id)"""


def tokens_in(col: str, terms) -> str:
    return f"list_has_any(regexp_split_to_array({col}, '\\s+'), [{', '.join(map(q, terms))}])"


V1_LOW = [t.lower() for t in R.V1_COUNTRIES]
V1_ALL = [*R.V1_COUNTRIES, *R.UK_NATIONS, *R.V1_PLACES]


def v1(n: str) -> str:
    return case([
        (f"{n} IN ('', 'remote', 'anywhere', 'worldwide')", "false"),
        (f"{rx(n, alt(R.V1_IRISH))} AND NOT contains({n}, 'northern ireland') AND NOT {rx(n, alt([*V1_LOW, *R.UK_NATIONS, *R.V1_PLACES]))}", "false"),
        (rx(n, alt(R.V1_BLOCKS)), "false"),
        (f"{bw(n, alt(R.V1_CODES))} AND NOT {bw(n, r'[a-z]{1,2}\d[a-z\d]?\s*\d[a-z]{2}')}", "false"),
        (f"contains({n}, 'remote') AND {rx(n, 'uk|united kingdom|england|britain')}", "true"),
    ], f"{tokens_in(n, V1_ALL)} OR {bw(n, 'england')} OR {bw(n, POST)} OR {rx(n, two(V1_ALL))}")


SQL["is_uk_location_v1"] = f"WITH {J}, n AS (SELECT id, {norm('location')} AS n FROM j) SELECT id, {v1('n')} AS keep FROM n"
SQL["is_uk_location_v2"] = f"""WITH {J}, n AS (SELECT id, lower(coalesce(location, '')) AS n FROM j)
  SELECT id, n <> '' AND NOT contains(n, 'ukraine') AND ({bw('n', alt(R.V2_WORDS))} OR {rx('n', r'\d+ locations')} OR {rx('n', '( uk|, uk| united kingdom)$')}) AS keep FROM n"""
V3 = [*R.V3_COUNTRIES, *R.UK_NATIONS, *R.V3_CITIES]
SQL["is_uk_location_v3"] = f"""WITH {J}, n AS (SELECT id, {norm('location', '[()]', r'[/\-_|,]')} AS n FROM j)
  SELECT id, n <> '' AND NOT contains(n, 'ukraine') AND ((contains(n, 'remote') AND {rx('n', 'uk|united kingdom')}) OR {tokens_in('n', V3)} OR {rx('n', two(V3))}) AS keep FROM n"""
SQL["is_uk_location_v4"] = f"WITH {J} SELECT id, {rx("lower(coalesce(location, ''))", alt(R.V4_WORDS))} AS keep FROM j"
SQL["verdict_words"] = f"WITH {J} SELECT id, {bw("lower(coalesce(location, ''))", alt(R.VERDICT_WORDS))} AS uk FROM j"
SQL["cleanup_bad_locations"] = f"""WITH {J} SELECT id, location FROM j WHERE coalesce(location, '') <> '' AND NOT {rx('lower(location)', 'uk|united kingdom|london')}
  AND ({rx('lower(location)', alt(R.CLEANUP_BLOCKS))} OR ({bw('lower(location)', alt(R.CLEANUP_CODES))} AND NOT contains(lower(location), 'australia')))"""
TERMS = "|".join(t.lower().replace(" ", r"[\s.\-]+") for t in V1_ALL)
hint = lambda col, terms: f"list_filter([{', '.join(map(q, terms))}], lambda t: contains({col}, t))[1]"
SQL["likely_uk_explain"] = f"""WITH {J}, n AS (SELECT id, {norm('location')} AS n, lower(url) AS u, lower(title) AS t, lower(coalesce(department, '')) AS d, id % 11 = 0 AS verified FROM j),
  k AS (SELECT *, {hint('u', R.NON_UK_URL_HINTS)} AS bu, {hint('n', R.LIKELY_BLOCKED)} AS bl,
        n <> '' AND NOT (n IN ({', '.join(map(q, R.AMBIGUOUS))}) OR {rx('n', r'\d+\s+locations?')}) AS settled, {v1('n')} AS v1 FROM n),
  r AS (SELECT id, {case([
      ("bu IS NOT NULL", "['f', 'f', 'non_uk_url: ' || bu]"), ("bl IS NOT NULL AND NOT contains(n, 'northern ireland')", "['f', 'f', 'non_uk_location: ' || bl]"),
      ("verified", "['t', 'f', NULL]"), ("n <> '' AND v1", "['t', 'f', NULL]"), (f"n = 'remote' AND {rx('u', '[.]uk|country=gb|country=uk')}", "['t', 'f', NULL]"),
      (f"settled AND {rx('n', alt(R.WIDE_AREAS))}", "['t', 't', NULL]"), ("settled", "['f', 'f', 'failed_uk_location_check']"), (rx('u', alt(R.UK_URL_HINTS)), "['t', 'f', NULL]"),
      (bw('u', 'uk|united.kingdom|england|scotland|wales|northern.ireland'), "['t', 'f', NULL]"), (f"{bw('t', TERMS)} OR {bw('d', TERMS)}", "['t', 'f', NULL]"), ("n = ''", "['t', 't', NULL]"),
  ], "['f', 'f', 'no_uk_signals']")} AS x FROM k)
  SELECT id, x[1] = 't' AS keep, x[2] = 't' AS needs_review, x[3] AS reason FROM r"""

# ---------------------------------------------------------------- merge and sync

SQL["upsert_jobs"] = f"""WITH {J}, t AS (SELECT * FROM j WHERE id % 10 < 8), s AS (SELECT id, title || ' *' AS title, location FROM j WHERE id % 10 >= 3)
  SELECT coalesce(t.id, s.id) AS id, coalesce(t.company_id, -1) AS company_id, CASE WHEN s.id IS NULL THEN t.title ELSE s.title END AS title, CASE WHEN s.id IS NULL THEN t.location ELSE s.location END AS location,
         t.department, t.url FROM t FULL JOIN s ON t.id = s.id"""
SQL["upsert_staging"] = f"""WITH {C}, t AS (SELECT * FROM c WHERE id % 10 <> 2), s AS (SELECT id, trading_name || '!' AS trading_name, 'staged' AS ats_provider, ats_status FROM c WHERE id % 5 = 2)
  SELECT coalesce(t.id, s.id) AS id, coalesce(t.trading_name, s.trading_name) AS trading_name, CASE WHEN s.id IS NULL THEN t.ats_provider ELSE s.ats_provider END AS ats_provider,
         CASE WHEN s.id IS NULL THEN t.ats_status ELSE s.ats_status END AS ats_status FROM t FULL JOIN s ON t.id = s.id"""
SQL["stale_delete_url"] = f"""WITH {J}, n AS (SELECT DISTINCT company_id, url FROM j WHERE id % 3 = 0 AND company_id % 2 = 0)
  SELECT id, company_id, url FROM j WHERE company_id NOT IN (SELECT company_id FROM n) OR (company_id, url) IN (SELECT company_id, url FROM n)"""
SQL["stale_delete_run"] = f"WITH {G} SELECT id, sync_run_id FROM g WHERE NOT coalesce(sync_run_id <> 'r1', false)"
SQL["expire_unseen"] = f"WITH {J} SELECT id FROM j WHERE created_at >= TIMESTAMP '1997-01-01' - INTERVAL 365 DAY"
SQL["recount_active"] = f"WITH {C}, {J} SELECT c.id, count(j.id) AS active_jobs_count FROM c LEFT JOIN j ON company_id = c.id AND j.id % 4 = 0 GROUP BY 1"
SQL["health_transition"] = f"""WITH {C} SELECT id, CASE id % 3 WHEN 0 THEN CASE WHEN ats_failure_count + 1 >= 3 THEN 'needs_manual_review' ELSE 'dead' END WHEN 1 THEN 'ok' ELSE ats_status END AS ats_status,
  CASE id % 3 WHEN 0 THEN ats_failure_count + 1 WHEN 1 THEN 0 ELSE ats_failure_count END AS ats_failure_count FROM c"""
RULE_ROWS = ", ".join("(" + ", ".join(map(q, r)) + ")" for r in X.RULES)
SQL["bulk_update_ilike"] = f"""WITH {C}, r(n, p, a, x, len, prov, tok) AS (VALUES {RULE_ROWS}),
  h AS (SELECT id, max_by(struct_pack(p := prov, t := tok), n) AS w FROM c JOIN r ON (trading_name ILIKE p OR coalesce(trading_name ILIKE a, false))
        AND NOT coalesce(trading_name ILIKE x, false) AND coalesce(length(trading_name) < len, true) GROUP BY id)
  SELECT c.id, CASE WHEN h.id IS NULL THEN ats_provider ELSE w.p END AS ats_provider, CASE WHEN h.id IS NULL THEN ats_board_token ELSE w.t END AS ats_board_token FROM c LEFT JOIN h ON h.id = c.id"""
SQL["overrides_merge"] = f"""WITH {C} SELECT c.id, coalesce(CASE s_suppkey % 3 WHEN 1 THEN lower(s_name) END, ats_provider) AS ats_provider, CASE WHEN s_suppkey IS NOT NULL THEN 't' ELSE ats_board_token END AS ats_board_token
  FROM c LEFT JOIN supplier ON s_suppkey = c.id"""
SQL["toggle_favorite"] = "SELECT user_id, event_id % 7 AS company_id FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 1"
SQL["insert_if_absent"] = "SELECT DISTINCT user_id, event_id % 5 AS job_id FROM events WHERE event_type = 'purchase'"
SQL["cascade_delete"] = f"""WITH {J} SELECT user_id, event_id % 15000 AS job_id FROM events JOIN j ON j.id = event_id % 15000 JOIN customer ON c_custkey = company_id
  WHERE event_type = 'purchase' AND company_id % 6 <> 0"""
SQL["get_or_create"] = """WITH k AS (SELECT c_custkey AS id, c_name AS trading_name FROM customer WHERE c_custkey % 2 = 0)
  SELECT * FROM k UNION ALL SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY c_name), c_name FROM customer WHERE c_custkey % 10 = 5"""
SQL["backfill_seen"] = f"WITH {J} SELECT id, strftime(coalesce(created_at, TIMESTAMP '2000-01-01'), '%Y-%m-%d') AS last_seen FROM j"

# ---------------------------------------------------------------- dedup

SQL["dedup_map_last"] = f"WITH {J} SELECT url, max(id) AS id, max_by(title, id) AS title, min(id) AS first_pos FROM j GROUP BY url"
SQL["dedup_set_first"] = f"WITH {J} SELECT company_id, title, min(id) AS id FROM j GROUP BY 1, 2"
CELLS = ["n/a", "﻿acme", "a â€” b", " - ", "Workday"]
SQL["csv_import_last_wins"] = f"""WITH l AS (SELECT o_custkey AS id, max(o_orderkey) AS line FROM orders GROUP BY 1), t AS (SELECT *, {trim(f"replace(replace({pick(CELLS, 'line')}, chr(65279), ''), 'â€”', '-')")} AS v FROM l)
  SELECT id, line, CASE WHEN lower(v) NOT IN ('', '-', '__', 'n/a', 'na') THEN v END AS token FROM t"""

# ---------------------------------------------------------------- addresses and detection

SQL["infer_ats_v4"] = f"WITH {C} SELECT id, {LIKELY} AS provider FROM c"
SQL["infer_ats_v5"] = f"WITH {C} SELECT id, {V5} AS provider FROM c"
URL = "CASE WHEN regexp_matches(careers_url, '^https?://') THEN careers_url ELSE 'https://' || careers_url END"
hostof = lambda u: f"nullif(lower(regexp_extract({u}, '^(?i)https?://([^/?#:\\s]+)', 1)), '')"
SQL["infer_ats_v2"] = f"""WITH {C}, h AS (SELECT id, coalesce({hostof('careers_url')}, lower(careers_url)) AS h FROM c)
  SELECT id, {case([(f"contains(h, {q(p)})", q(v)) for p, v in R.HOST_PROVIDERS])} AS provider FROM h"""
PARTS = "list_filter(string_split(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"
SUB = "split_part(h, '.', 1)"
V1_CASES = [("h IS NULL", "NULL"), ("h IN ('boards.greenhouse.io', 'job-boards.eu.greenhouse.io')", "CASE WHEN coalesce(p, f) IS NOT NULL THEN ['greenhouse', coalesce(p, f)] END")]
for piece, prov, where in R.HOST_RULES:
    tok = {"path": "p", "sub": SUB, "path_sub": f"coalesce(p, {SUB})"}[where]
    V1_CASES.append((f"contains(h, {q(piece)})", f"CASE WHEN {tok} IS NOT NULL THEN [{q(prov)}, {tok}] END"))
V1_CASES.append(("contains(h, 'myworkdayjobs.com')", f"['workday', CASE WHEN p IS NOT NULL AND p NOT IN ('en-US', 'en-GB') THEN {SUB} || '/' || p ELSE u END]"))
SQL["infer_ats_v1"] = f"""WITH {C}, a AS (SELECT id, {URL} AS u FROM c), b AS (SELECT *, {hostof('u')} AS h, {PARTS}[1] AS p, nullif(regexp_extract(u, '[?&]for=([^&#]*)', 1), '') AS f FROM a),
  r AS (SELECT id, {case(V1_CASES, "['generic_careers', u]")} AS x FROM b) SELECT id, x[1] AS provider, x[2] AS token FROM r"""
GEN = "('www', 'jobs', 'careers', 'apply', 'en', 'us', 'uk', 'api')"
ok = lambda t, prov: f"CASE WHEN {t} <> '' AND lower({t}) NOT IN {GEN} THEN ['{prov}', {t}] END"
V3_CASES = [("h IS NULL", "NULL"), ("h = 'boards.greenhouse.io'", f"coalesce({ok('f', 'greenhouse')}, {ok('p', 'greenhouse')})")]
V3_CASES += [(f"h = '{n}'", ok("p", v)) for n, v in (("job-boards.eu.greenhouse.io", "greenhouse_eu"), ("jobs.lever.co", "lever"), ("jobs.eu.lever.co", "lever_eu"), ("jobs.ashbyhq.com", "ashby"), ("apply.workable.com", "workable"), ("careers.smartrecruiters.com", "smartrecruiters"))]
V3_CASES += [(f"ends_with(h, '.{n}') AND NOT starts_with(h, 'api.')", ok(SUB, v)) for n, v in (("workable.com", "workable"), ("smartrecruiters.com", "smartrecruiters"), ("recruitee.com", "recruitee"), ("teamtailor.com", "teamtailor"), ("bamboohr.com", "bamboohr"), ("jobs.personio.com", "personio"), ("jobs.personio.de", "personio"))]
V3_CASES += [("ends_with(h, '.myworkdayjobs.com') AND h <> 'www.myworkdayjobs.com'", "CASE WHEN p IS NOT NULL THEN ['workday', 'https://' || h || '/' || p] END"), ("ends_with(h, '.taleo.net')", "['oracle', 'https://' || h]"), ("ends_with(h, '.icims.com')", "['icims', 'https://' || h]")]
V3_BASE = f"""WITH {C}, a AS (SELECT id, careers_url AS u FROM c), b AS (SELECT *, {hostof('u')} AS h, {PARTS}[1] AS p, nullif(regexp_extract(u, '[?&]for=([^&#]*)', 1), '') AS f FROM a),
  r AS (SELECT id, {case(V3_CASES)} AS x FROM b)"""
SQL["infer_ats_v3"] = V3_BASE + " SELECT id, x[1] AS provider, x[2] AS token FROM r"
SQL["infer_ats_v6"] = V3_BASE + """, k AS (SELECT id, x[1] AS p, CASE WHEN starts_with(x[2], 'http') THEN x[2] ELSE lower(x[2]) END AS t FROM r)
  SELECT id, CASE WHEN length(t) >= 3 THEN p END AS provider, CASE WHEN length(t) >= 3 THEN t END AS token FROM k"""
SQL["url_host"] = f"SELECT page_id, {hostof('url')} AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages"
SQL["page_links"] = r"""WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)\s*=\s*["'']([^"''#\s]+)', 1) AS a FROM pages),
  d AS (SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS l FROM l) SELECT page_id, len(l)::BIGINT AS n, array_to_string(l, ' ') AS links FROM d"""
ENDPOINTS = ["https://api.lever.co/v0/postings/acme?mode=json", "https://boards-api.greenhouse.io/v1/boards/beta/jobs", "https://x.bamboohr.com/careers/list", "plain", "https://t.wd3.myworkdayjobs.com/wday/cxs/t/Board/jobs", "https://other.test/x"]
SQL["extract_token"] = f"""WITH e AS (SELECT c_custkey AS id, {pick(ENDPOINTS, 'c_custkey')} AS e, {pick(['lever', 'greenhouse', 'bamboohr', 'ashby', 'workday'], 'c_custkey')} AS p FROM customer)
  SELECT id, CASE WHEN NOT starts_with(e, 'http') THEN e WHEN p = 'workday' AND contains(e, '/cxs/') THEN 't/Board' WHEN p = 'lever' AND contains(e, '/postings/') THEN 'acme'
    WHEN p = 'greenhouse' AND contains(e, '/boards/') THEN 'beta' WHEN p = 'bamboohr' AND contains(e, 'bamboohr.com') THEN 'x' ELSE e END AS token FROM e"""
NORM_T = f"regexp_replace(lower({trim('t')}), '/+$', '')"
CORE = f"regexp_replace(regexp_replace({NORM_T}, '^[_\\-]+|[_\\-]+$', '', 'g'), '[_\\-\\s]+', '', 'g')"
BAD = lambda k: f"coalesce(length({k}) < 2 OR {rx(k, '^[0-9]+$')} OR {k} IN ({', '.join(map(q, R.INVALID_TOKENS))}) OR {rx(k, '^[a-f0-9]{8,}$')}, true)"
TOK = f"WITH {C}, a AS (SELECT id, trading_name, ats_board_token AS t FROM c), k AS (SELECT *, {NORM_T} AS n, {CORE} AS k FROM a)"
SQL["token_validity"] = TOK + f" SELECT id, {BAD('k')} AS invalid, coalesce(length(k) BETWEEN 2 AND 50 AND {rx('k', '[a-z]')}, false) AS plausible FROM k"
SQL["token_similarity"] = TOK + """, m AS (SELECT *, regexp_replace(lower(trading_name), '[^a-z0-9]', '', 'g') AS c FROM k),
  o AS (SELECT *, len(list_filter(string_split(n, ''), lambda x: x <> '' AND contains(c, x))) AS shared FROM m)
  SELECT id, CASE WHEN coalesce(t, '') = '' THEN 0 WHEN contains(c, n) OR contains(n, c) THEN 10 WHEN abs(length(n) - length(c)) <= 3 AND shared >= greatest(length(n), length(c)) * 0.6 THEN 5 ELSE 0 END AS score FROM o"""
SQL["token_variants"] = TOK + f""", d AS (SELECT id, n, regexp_replace(n, '[\\s_]+', '-', 'g') AS h FROM k),
  v AS (SELECT id, [n, h, regexp_replace(n, '[-_]?[0-9]+$', ''), regexp_replace(h, '[-_]?[0-9]+$', ''), regexp_replace(n, '[0-9]+$', '')] AS v FROM d),
  e AS (SELECT id, i, regexp_replace(regexp_replace({trim('v[i]')}, '/+$', ''), '[-_]+$', '') AS w FROM v, range(1, 6) r(i)),
  f AS (SELECT id, w, min(i) AS i FROM (SELECT *, {CORE.replace(NORM_T, 'w')} AS z FROM e) WHERE w <> '' AND NOT {BAD('z')} GROUP BY 1, 2)
  SELECT c.id, CASE WHEN any_value(c.ats_board_token) IS NOT NULL THEN coalesce(string_agg(w, ',' ORDER BY i), '') ELSE '' END AS variants FROM c LEFT JOIN f ON f.id = c.id GROUP BY c.id"""
SCORE = " + ".join(f"2 * {a}::INT + 2 * {b}::INT + 3 * ({a} AND {b})::INT" for p in R.CAREERS_PATTERNS for a, b in [(rx("u", p), rx("t", p))])
SQL["careers_link_score"] = f"""WITH {C}, a AS (SELECT id, careers_url, lower(coalesce(careers_url, '')) AS u, coalesce(ats_provider, '') AS t FROM c)
  SELECT id, {SCORE} AS score, {hostof('careers_url')} IS NULL OR regexp_replace(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') IN ({', '.join(map(q, R.EXCLUDED_PATHS))}) AS excluded FROM a"""
FP = " UNION ALL ".join(f"SELECT k, id AS pos, {i} AS pr, '{p}' AS provider, lower(regexp_extract(u, {q('(?i)' + x)}, 1)) AS t, u FROM a" for i, (p, x) in enumerate(R.FINGERPRINTS))
SQL["fingerprint_scan"] = f"""WITH {C}, a AS (SELECT id % 50 AS k, id, careers_url AS u FROM c WHERE careers_url IS NOT NULL), m AS ({FP}),
  h AS (SELECT *, {BAD(CORE.replace(NORM_T, 't'))} AS bad FROM m WHERE t <> ''), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bad, pr, pos) AS n FROM h)
  SELECT k AS company_id, provider, t AS token, u AS source, NOT bad AS valid FROM w WHERE n = 1"""
SQL["job_url_fix"] = "SELECT o_orderkey AS id, ['https://jobs.smartrecruiters.com/Acme/77', 'https://example.test/a', NULL][(o_orderkey % 3) + 1] AS url FROM orders"
SQL["discovery_url"] = f"""WITH {C}, h AS (SELECT id, careers_url AS u, regexp_replace({hostof('careers_url')}, '^www[.]', '') AS h FROM c)
  SELECT id, coalesce({rx('h', alt(R.DISCOVERY_HOSTS))} OR h = 'example.com' OR {rx("lower(regexp_extract(u, '^https?://[^/?#]*(.*)$', 1))", R.DISCOVERY_PATH)}, false) AS likely FROM h"""
SQL["probe_status"] = f"""WITH p AS (SELECT c_custkey AS id, {pick(X.CODES, 'c_custkey')} AS k, c_custkey % 100 AS b FROM customer),
  s AS (SELECT *, CASE WHEN k = 200 THEN 'ok' WHEN k = 404 THEN 'bad_token' WHEN k IN (401, 403) THEN 'auth_or_bot_protected' WHEN k IS NULL OR k >= 500 THEN 'dead' ELSE 'bad_token' END AS status FROM p)
  SELECT id, status, CASE WHEN k = 200 AND b <= 50 THEN 'bad_token' ELSE status END AS strict FROM s"""
SQL["change_detect"] = f"""WITH {C} SELECT id, (CASE WHEN id % 2 = 0 THEN ats_provider ELSE 'ashby' END) IS DISTINCT FROM ats_provider OR ats_status IS DISTINCT FROM ['ok', NULL][(id % 2) + 1] AS changed FROM c"""
SQL["layered_resolution"] = """WITH h AS (SELECT c_custkey % 300 AS company_id, c_custkey % 4 AS layer, c_custkey % 5 <> 1 AS verified, lower(c_name) AS provider, c_custkey::VARCHAR AS token FROM customer)
  SELECT * FROM h WHERE verified QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY layer, provider, token) = 1"""
HITS = ["https://a.test/x", "https://b.test/jobs", "ftp://c.test", "https://d.test/", "https://a.test/x", None]
SQL["search_hits"] = f"""WITH r AS (SELECT c_custkey % 20 AS query_id, c_custkey AS rank, {pick(HITS, 'c_custkey')} AS link FROM customer),
  f AS (SELECT query_id, link, min(rank) AS rank FROM r WHERE starts_with(link, 'http') GROUP BY 1, 2)
  SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, link) <= 3"""
GATE_P = ["ashby", "workday", "unknown", "custom", "none", "oracle", "zzz", "lever"]
GATE_T = ["acme", "https://nu.myworkdayjobs.com/B", "www", "ab", None, "https://www.myworkdayjobs.com/x", "http://c.test"]
SQL["write_gate"] = f"""WITH {C}, g AS (SELECT id, careers_url AS u, {pick(GATE_P, 'id')} AS p, {pick(GATE_T, 'id')} AS t, id % 9 <> 0 AS v, {pick(['high', 'none', 'low'], 'id')} AS f FROM c)
  SELECT id, CASE WHEN p = 'unknown' THEN 'unknown_provider' WHEN p = 'zzz' THEN 'invalid_provider' WHEN NOT v THEN 'not_verified' WHEN p = 'none' AND u IS NULL THEN 'no_careers_url'
    WHEN p <> 'none' AND t IS NULL THEN 'no_token' WHEN p = 'custom' AND NOT starts_with(t, 'http') THEN 'custom_not_url' WHEN length(t) <= 2 THEN 'token_too_short' WHEN t = 'www' THEN 'generic_token'
    WHEN f = 'none' THEN 'no_confidence' WHEN p = 'workday' AND NOT starts_with(t, 'http') THEN 'workday_not_url' WHEN p = 'workday' AND NOT contains(t, 'myworkdayjobs.com') THEN 'workday_wrong_host'
    WHEN p = 'workday' AND contains(t, '//www.myworkdayjobs') THEN 'workday_no_tenant' WHEN p = 'oracle' AND NOT starts_with(t, 'http') THEN 'not_url' END AS reason FROM g"""
SQL["discovery_queries"] = f"""WITH {C}, b AS (SELECT id, '"' || trading_name || '"' AS n, regexp_replace({hostof('careers_url')}, '^www[.]', '') AS h FROM c),
  l AS (SELECT id, list_concat(CASE WHEN h IS NULL THEN [] ELSE [n || ' site:' || h, 'site:' || h || ' careers'] END,
        [n || ' ' || x for x in ['careers', 'jobs', 'apply', 'hiring careers', 'work with us', 'careers UK', 'jobs UK']]) AS l FROM b)
  SELECT id, i - 1 AS n, l[i] AS query FROM l, range(1, 17) r(i) WHERE i <= len(l)"""

# ---------------------------------------------------------------- users and sources

SQL["applied_jobs"] = f"""WITH {C}, {J} SELECT event_id, user_id, j.id AS job_id, company_id, title, trading_name FROM events JOIN j ON j.id = event_id * 3 % 20000 LEFT JOIN c ON c.id = company_id WHERE event_type = 'purchase'"""
SQL["reports_admin"] = f"""WITH {C}, {J} SELECT event_id, event_id * 7 % 20000 AS job_id, coalesce(company_id, -1) AS company_id, title, trading_name FROM events LEFT JOIN j ON j.id = event_id * 7 % 20000 LEFT JOIN c ON c.id = company_id WHERE event_type = 'error'"""
SQL["rls_user_rows"] = "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND user_id = 5"
SQL["prefs_whitelist"] = f"""WITH e AS (SELECT DISTINCT user_id, {pick(['London', 'Paris', 'Scotland', 'Rest of UK', 'Mars'], 'event_id')} AS v FROM events)
  SELECT user_id, coalesce(string_agg(v, ',' ORDER BY v) FILTER (v IN ('London', 'Rest of UK', 'Scotland', 'Wales')), '') AS locations FROM e GROUP BY 1"""
SQL["subscription_fold"] = "SELECT user_id, event_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
SQL["first_nonempty_attempt"] = """WITH a AS (SELECT c_custkey % 400 AS company_id, c_custkey % 5 AS attempt_no, 'p' || (c_custkey % 3) AS provider, c_custkey % 4 AS n_rows FROM customer)
  SELECT * FROM a WHERE n_rows > 0 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY attempt_no, provider, n_rows) = 1"""
SQL["resume_from"] = f"WITH {C} SELECT id AS pos, trading_name, ats_provider FROM c WHERE id >= coalesce((SELECT min(id) FROM c WHERE ats_provider = 'machinery'), 0)"
SQL["facet_trust"] = """WITH b AS (SELECT c_custkey AS board_id, c_custkey % 50 AS total, c_custkey % 67 AS global_total, c_custkey % 3 <> 0 AS applied, c_custkey % 5 AS n_uk, c_custkey % 4 AS n_other FROM customer),
  r AS (SELECT *, applied AND global_total > 0 AND coalesce(total / nullif(global_total, 0) < 0.75, false) AND n_other <= n_uk AS uses_facet FROM b)
  SELECT *, uses_facet OR n_other = 0 AS trusted FROM r"""
SQL["normalize_json_events"] = "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, event_type AS kind FROM events"
SQL["stream_daily_counts"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"
ROUTE_P = ["Custom", "AshbyHQ", "workday", "Team Tailor", None, "Greenhouse"]
ROUTE_T = ["https://www.amazon.jobs/en", "acme", "nu", "", "x/y"]
SQL["resolve_provider"] = f"""WITH {C}, a AS (SELECT id, {pick(ROUTE_P, 'id')} AS r, {pick(ROUTE_T, 'id')} AS t, {URL} AS u, coalesce(careers_url, '') AS raw FROM c),
  b AS (SELECT *, {hostof('u')} AS h, {PARTS}[1] AS p FROM a),
  x AS (SELECT id, CASE WHEN r = 'Custom' AND contains(coalesce(nullif(t, ''), raw), 'amazon.jobs') THEN ['amazon', t]
      WHEN r = 'workday' AND t <> '' AND NOT contains(t, '/') THEN ['workday', CASE WHEN h IS NOT NULL AND p IS NOT NULL AND p NOT IN ('en-US', 'en-GB') THEN {SUB} || '/' || p ELSE t END]
      WHEN r IS NOT NULL AND t <> '' THEN [CASE r WHEN 'AshbyHQ' THEN 'ashby' WHEN 'Team Tailor' THEN 'teamtailor' ELSE lower(r) END, t] END AS x FROM b)
  SELECT id, x[1] AS provider, x[2] AS token FROM x"""
