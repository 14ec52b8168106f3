"""DuckDB SQL of the queries of detection runs, imports and lookups, and of the synchronisation."""

from __future__ import annotations

from . import fixtures as X
from . import queries_runs as Q
from .functions import rules as R
from .oracle import BAD, C, CORE, J, NORM_T, SCORE, alt, bw, hostof, level, pick, q, sector, trim
from .oracle import SQL as BASE

SQL: dict[str, str] = {}
FPS = " UNION ALL ".join(f"SELECT query_id, rank, kind, link, {i} AS pr, '{p}' AS provider, lower(regexp_extract(u, {q('(?i)' + x)}, 1)) AS t FROM a" for i, (p, x) in enumerate(R.FINGERPRINTS))
SQL["search_hit_match"] = f"""WITH {C}, r AS (SELECT id % 200 AS query_id, id AS rank, CASE WHEN id % 3 > 0 THEN careers_url END AS link, {pick(Q.SNIPPETS, 'id')} AS snippet FROM c),
  a AS (SELECT query_id, rank, 0 AS kind, link, link AS u FROM r UNION ALL SELECT query_id, rank, 1, link, snippet FROM r), m AS ({FPS}),
  h AS (SELECT *, {BAD(CORE.replace(NORM_T, 't'))} AS bad FROM m WHERE t <> '')
  SELECT query_id, provider, t AS token, CASE kind WHEN 0 THEN 'link' ELSE 'snippet' END AS source, nullif(link, '') AS careers_url FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, kind, bad, pr) = 1"""

SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '/+$', ''), '^www[.]', ''), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
TOKENS = f"""{C}, n AS (SELECT id, CASE WHEN id % 5 = 0 THEN careers_url ELSE ' The ' || trading_name || ' & Co. ' END AS name, string_split(regexp_replace({hostof('careers_url')}, '^www[.]', ''), '.') AS l FROM c),
  v AS (SELECT id, unnest([name, regexp_replace(name, '\\s+', '', 'g'), l[1], CASE WHEN len(l) > 1 THEN l[len(l) - 1] END]) AS t, unnest([1, 2, 3, 4]) AS o FROM n),
  s AS (SELECT id, o, {SLUG} AS t FROM v), k AS (SELECT id, t, min(o) AS o FROM s WHERE length(t) >= 3 AND NOT {BAD(CORE.replace(NORM_T, 't'))} GROUP BY 1, 2),
  w AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY o) AS k FROM k)"""
SQL["heuristic_tokens"] = f"WITH {TOKENS} SELECT c.id, coalesce(string_agg(t, ',' ORDER BY k), '') AS tokens FROM c LEFT JOIN w ON w.id = c.id AND k <= 6 GROUP BY 1"
SQL["heuristic_probe"] = f"""WITH {TOKENS}, p AS (SELECT id, provider, t AS token, row_number() OVER (PARTITION BY id ORDER BY o, k) - 1 AS n FROM w, (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(R.HEURISTIC_PROVIDERS))}) v(o, provider) WHERE k <= 6),
  z AS (SELECT *, {pick([404, 404, 404, 200, 404, 500, 403], "(id + n * 3)")} AS code FROM p)
  SELECT id, provider, token, CASE code WHEN 200 THEN 'ok' WHEN 500 THEN 'dead' ELSE 'auth_or_bot_protected' END AS status FROM z WHERE code <> 404 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1"""
WORD = "regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
within = lambda c, xs: f"{c} IN ({', '.join(map(q, xs))})"
SQL["write_gate_second"] = f"""WITH {C}, g AS (SELECT id, {pick(Q.GATE_PROVIDERS, 'id')} AS p, {pick(Q.GATE_TOKENS, 'id')} AS t, ats_status FROM c)
  SELECT id, CASE WHEN coalesce(p, '') = '' OR coalesce(t, '') = '' OR NOT {within('p', R.WRITABLE_PROVIDERS)} OR length(t) <= 2 THEN false
    WHEN {within('p', R.FULL_URL_PROVIDERS)} AND NOT regexp_matches(t, '(?i)^https?://') THEN false WHEN NOT {within('p', R.FULL_URL_PROVIDERS)} AND (length({WORD}) < 3 OR {within(WORD, R.GENERIC_TOKENS)}) THEN false
    WHEN p = 'workday' AND NOT contains(t, 'myworkdayjobs.com') THEN false ELSE NOT coalesce(ats_status IN ('bad_token', 'dead'), false) END AS writable FROM g"""
SQL["run_summary"] = f"""WITH {C}, r AS (SELECT ats_provider AS op, ats_board_token AS ot, CASE WHEN id % 3 > 0 THEN ats_provider ELSE 'ashby' END AS np, CASE WHEN id % 2 = 0 THEN ats_board_token ELSE {pick(X.TOKENS, '(id + 3)')} END AS nt, {pick(Q.RUN_STATUSES, 'id')} AS s FROM c)
  SELECT count(*) AS total, count(*) FILTER ((coalesce(op, '') = '' OR coalesce(ot, '') = '') AND coalesce(np, '') <> '' AND coalesce(nt, '') <> '') AS newly_configured,
    count(*) FILTER (op IS NOT DISTINCT FROM np AND coalesce(ot, '') <> '' AND ot IS DISTINCT FROM nt) AS token_corrected, count(*) FILTER (coalesce(op, '') <> '' AND op = np AND ot IS DISTINCT FROM nt) AS token_changed,
    {", ".join(f"count(*) FILTER (s = '{s}') AS status_{s}" for s in Q.RUN_STATUSES if s)} FROM r"""
B = f"""{C}, b AS (SELECT id, {pick(Q.VERDICT_PROVIDERS, 'id')} AS p0, coalesce({pick(Q.BODIES, '(id * 7 + id // 13)')}, '') AS body, {pick(X.TOKENS, 'id')} AS t0, careers_url, {pick([200, 200, 200, 404, None], '(id // 3)')} AS code FROM c),
  d AS (SELECT *, trim(lower(coalesce(p0, ''))) AS p, trim(coalesce(t0, '')) AS t, trim(coalesce(careers_url, '')) AS u, json_valid(body) AS ok FROM b)"""
LISTS = " ".join(f"WHEN p = '{p}' AND ok AND json_type(CASE WHEN ok THEN body END, '{path}') = 'ARRAY' THEN json_array_length(CASE WHEN ok THEN body END, '{path}')" for p, path in R.PROBE_LISTS.items())
SQL["jobs_found_estimate"] = f"WITH {B} SELECT id, CASE {LISTS} WHEN length(body) > 50 THEN 1 ELSE 0 END::BIGINT AS n FROM d"
JSON_BODY = "CASE WHEN ok THEN body END"


def places(path: str, fields: tuple[str, ...]) -> str:
    at = path if path == "$" else path
    text = ", ".join(f"CASE WHEN json_type(x, '{f}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(x, '{f}') ELSE '' END" for f in fields)
    return f"list_transform(json_extract({JSON_BODY}, '{at}[*]'), lambda x: concat_ws(' ', {text}))"


HITS = " ".join(f"WHEN p = '{p}' THEN CASE WHEN json_type({JSON_BODY}, '{path}') = 'ARRAY' THEN len(list_filter({places(path, fields)}, lambda y: {bw('lower(y)', alt(R.VERDICT_WORDS))})) ELSE 0 END" for p, (path, fields) in R.VERDICT_FEEDS.items())
SQL["company_verdict"] = f"""WITH {B} SELECT id, CASE WHEN lower(t) IN ('', 'nan') OR coalesce(code <> 200, true) THEN 'Dead URL' WHEN {within('p', R.VERDICT_FEEDS)} THEN CASE WHEN NOT ok THEN 'Dead URL' WHEN (CASE {HITS} END) > 0 THEN 'UK' ELSE 'No UK Jobs' END
  WHEN lower(u) IN ('', 'nan') THEN 'Dead URL' WHEN {bw('lower(body)', alt(R.VERDICT_WORDS))} THEN 'UK' ELSE 'No UK Jobs' END AS verdict FROM d"""
SQL["sheet_import"] = f"""WITH s AS (SELECT TRY_CAST(CASE WHEN regexp_matches(trim(i), '^[+-]?[0-9]+$') THEN trim(i) END AS BIGINT) AS company_id, regexp_replace(lower(trim(p)), '\\s+', '_', 'g') AS p, t FROM
    (SELECT coalesce({pick(Q.CELLS, 's_suppkey')}, s_suppkey::VARCHAR) AS i, {pick([' Greenhouse', 'Breezy HR', 'breezyhr', 'Oracle  Cloud', 'nobody', None], 's_suppkey')} AS p, {pick([None, 'acme', None, 'a - b'], 's_suppkey')} AS t FROM supplier))
  SELECT company_id, CASE WHEN {within('p', R.IMPORT_PROVIDERS)} THEN p END AS provider, t AS board_token FROM s JOIN customer ON c_custkey = company_id WHERE company_id > 0"""
SQL["graduate_rows"] = f"""WITH r AS (SELECT p_partkey AS k, p_brand, p_name, {pick(X.LOCATIONS, 'p_partkey')} AS loc, CASE WHEN p_partkey % 50 > 0 THEN 'https://g.test/' || (p_partkey % 700) END AS u, {pick(Q.SALARIES, 'p_partkey')} AS lo, {pick([None, 28000, 40000], 'p_partkey')} AS hi FROM part)
  SELECT 'reed-' || k AS id, 0 AS company_id, left(p_brand, 200) AS trading_name, left(repeat(p_name, 30), 500) AS title, coalesce(loc, '') AS location, u AS url, 'Graduate' AS level,
         CASE WHEN coalesce(lo, 0) <> 0 THEN '£' || lo || ' - £' || coalesce(hi::VARCHAR, 'null') END AS salary, 'r9' AS sync_run_id FROM r WHERE u IS NOT NULL QUALIFY row_number() OVER (PARTITION BY u ORDER BY k DESC) = 1"""
LOW = trim("lower(title)")
VALID = f"(length(title) >= 3 AND {within(LOW, R.JUNK_TITLES).replace(' IN ', ' NOT IN ')} AND NOT (length({LOW}) < 40 AND ({' OR '.join(f'starts_with({LOW}, {q(t)})' for t in R.JUNK_TITLES)})))"
SQL["valid_attempt"] = f"""WITH {J}, v AS (SELECT company_id, (id // 5) % 4 AS attempt_no, id, title FROM j WHERE {VALID}), w AS (SELECT * FROM v WHERE attempt_no <> 1 OR length(title) > 16)
  SELECT * FROM w QUALIFY attempt_no = min(attempt_no) OVER (PARTITION BY company_id)"""
SQL["set_first_by_name"] = f"""WITH {C}, n(n, name, p, t) AS (VALUES (1, '00000012', 'ashby', 'one'), (2, '#00000013', 'lever', 'two'), (3, 'no such', 'x', 'y'), (4, '0000012', 'workable', 'four'), (5, '12', 'breezy', 'five')),
  f AS (SELECT n, min(id) AS id FROM n JOIN c ON contains(lower(trading_name), name) GROUP BY 1), w AS (SELECT f.id, p, t FROM f JOIN n USING (n) QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY n DESC) = 1)
  SELECT c.id, CASE WHEN w.id IS NULL THEN ats_provider ELSE p END AS ats_provider, CASE WHEN w.id IS NULL THEN ats_board_token ELSE t END AS ats_board_token FROM c LEFT JOIN w ON w.id = c.id"""
SQL["subscription_users"] = "SELECT o_orderkey AS subscription, c_custkey AS user_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 3 <> 1"
SQL["top_saved"] = f"WITH {C} SELECT id, active_jobs_count AS saved FROM c WHERE active_jobs_count > 0 ORDER BY saved DESC, id LIMIT 10"
SQL["client_page"] = f"WITH {C} SELECT id, trading_name FROM c ORDER BY trading_name, id LIMIT 12 OFFSET 24"
SQL["url_encoded"] = f"WITH {C} SELECT id, url_encode(trading_name || ' / ä & ö? x=1+2' || id) AS encoded FROM c"
SQL["salvage_answers"] = f"""WITH {C} SELECT id, {pick(['x\ny\tz', 'plain', None, 'q"u\no', None], 'id')} AS a, {pick([1, 2, None, 3, None], 'id')}::BIGINT AS b FROM c"""
SQL["staged_new_columns"] = f"""WITH {C}, t AS (SELECT id, ats_status FROM c WHERE id % 4 > 0), s AS (SELECT id, ats_status || '*' AS ats_status FROM c WHERE id % 3 = 0)
  SELECT coalesce(t.id, s.id) AS id, CASE WHEN s.id IS NULL THEN t.ats_status ELSE s.ats_status END AS ats_status, CASE WHEN s.id IS NOT NULL THEN 'sheet' END AS sync_provider FROM t FULL JOIN s ON t.id = s.id"""

FPA = " UNION ALL ".join(f"SELECT company_id, source, {i} AS priority, '{p}' AS provider, unnest(regexp_extract_all(source, {q('(?i)' + x)}, 1)) AS t FROM a" for i, (p, x) in enumerate(R.FINGERPRINTS))
SQL["all_fingerprints"] = f"""WITH {C}, a AS (SELECT id % 40 AS company_id, coalesce(careers_url, 'none') || ' jobs.lever.co/Two and JOBS.LEVER.CO/two/ ' || {pick(Q.SNIPPETS, 'id')} AS source FROM c), m AS ({FPA})
  SELECT DISTINCT company_id, priority, provider, lower(t) AS token, source FROM m WHERE t <> ''"""
NAME = "('the acme & co ' || lower(trading_name))"
TITLE = "array_to_string(list_transform(string_split(NAME, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')".replace("NAME", NAME)
CLEAN = lambda x: f"regexp_replace({x}, '[^A-Za-z0-9-]', '', 'g')"
SQL["name_slugs"] = f"""WITH {C}, h AS (SELECT *, string_split(regexp_replace({hostof('careers_url')}, '^www[.]', ''), '.')[1] AS root FROM c),
  v AS (SELECT id, [{CLEAN(f"replace({NAME}, ' ', '')")}, {CLEAN(f"replace({NAME}, ' ', '-')")}, {CLEAN(f"replace({TITLE}, ' ', '')")}, 'the', {CLEAN('root')}, {CLEAN("upper(left(root, 1)) || substr(root, 2)")}] AS l FROM h),
  w AS (SELECT id, list_filter(l, lambda x: x IS NOT NULL AND length(x) > 2 AND NOT list_contains([{', '.join(map(q, R.INVALID_TOKENS))}], lower(x))) AS l FROM v)
  SELECT id, array_to_string(list_filter(l, lambda x, k: list_position(l, x) = k), ',') AS slugs FROM w"""
TEXTS = ["Careers", "Join us", "Read the blog", "Jobs at Acme", ""]
SQL["careers_candidates"] = f"""WITH {C}, a AS (SELECT id % 60 AS page_id, id AS pos, careers_url, lower(careers_url) AS u, lower({pick(TEXTS, 'id')}) AS t FROM c WHERE careers_url IS NOT NULL),
  s AS (SELECT page_id, pos, careers_url AS url, ({SCORE})::BIGINT AS score, {hostof('careers_url')} IS NULL OR regexp_replace(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') IN ({', '.join(map(q, R.EXCLUDED_PATHS))}) AS excluded FROM a)
  SELECT page_id, url, score FROM s WHERE score > 0 AND NOT excluded QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1"""

# ---------------------------------------------------------------- synchronisation


def greedy(of: str, key: str) -> str:
    """g: rows of ``of`` (company_id, n, url) that are kept, one step of the recursion a row of every company."""
    return f"""g AS (SELECT company_id, 0::BIGINT AS n, CAST([] AS VARCHAR[]) AS keys, CAST([] AS VARCHAR[]) AS urls, false AS kept FROM (SELECT DISTINCT company_id FROM {of})
    UNION ALL SELECT g.company_id, x.n, CASE WHEN x.ok THEN list_append(keys, x.{key}) ELSE keys END, CASE WHEN x.ok THEN list_append(urls, x.url) ELSE urls END, x.ok
    FROM g JOIN LATERAL (SELECT u.*, NOT list_contains(g.keys, u.{key}) AND NOT list_contains(g.urls, u.url) AS ok FROM {of} u WHERE u.company_id = g.company_id AND u.n = g.n + 1) x ON true)"""


SQL["dedup_greedy"] = f"""WITH RECURSIVE {J}, u AS (SELECT company_id, title AS key, 'u' || (id % 9) AS url, id, row_number() OVER (PARTITION BY company_id ORDER BY id) AS n FROM j), {greedy('u', 'key')}
  SELECT u.company_id, key, url, id FROM g JOIN u ON u.company_id = g.company_id AND u.n = g.n WHERE kept"""
_uk = BASE["is_uk_job"][len(f"WITH {J}, ") :].replace(" FROM j)", " FROM jj)").replace("SELECT j.id, j.location", "SELECT jj.id, jj.location").replace("FROM j LEFT JOIN", "FROM jj LEFT JOIN")
_cut = _uk.rindex("SELECT jj.id")
SYNC = f"""WITH RECURSIVE {J}, {C},
  jj AS (SELECT id, company_id, title, CASE WHEN company_id % 11 = 1 THEN 'Paris' ELSE location END AS location, url, department FROM j WHERE id % 10 >= 3 AND company_id % 11 <> 0 AND company_id % 13 <> 0 AND {VALID}),
  {_uk[:_cut].rstrip()}, kk AS ({_uk[_cut:]}), m AS (SELECT jj.*, kk.keep FROM jj JOIN kk ON kk.id = jj.id),
  o AS (SELECT t.company_id, coalesce(fetched, 0) AS fetched, coalesce(uk, 0) AS uk, CASE WHEN coalesce(fetched, 0) = 0 THEN 'zero_jobs' WHEN uk = 0 THEN 'non_uk_jobs' ELSE 'uk_jobs' END AS bucket
        FROM (SELECT id AS company_id FROM c WHERE id % 13 <> 0) t LEFT JOIN (SELECT company_id, count(*) AS fetched, count(*) FILTER (keep) AS uk FROM m GROUP BY 1) n ON n.company_id = t.company_id)"""
SQL["sync_outcomes"] = SYNC + " SELECT company_id, fetched, uk, bucket FROM o"
SQL["snapshot_sync"] = f"""{SYNC}, t0 AS (SELECT company_id, title, location, url, department FROM j WHERE id % 10 < 8 QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1),
  u AS (SELECT *, {trim('lower(title)')} || '_' || {trim("lower(coalesce(location, ''))")} AS key, row_number() OVER (PARTITION BY company_id ORDER BY id) AS n FROM m WHERE keep AND url <> ''), {greedy('u', 'key')},
  w AS (SELECT u.* FROM g JOIN u ON u.company_id = g.company_id AND u.n = g.n WHERE kept), l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY url ORDER BY company_id DESC) = 1),
  x AS (SELECT coalesce(l.company_id, t0.company_id) AS company_id, coalesce(l.url, t0.url) AS url, CASE WHEN l.url IS NULL THEN t0.title ELSE left(l.title, 255) END AS title, CASE WHEN l.url IS NULL THEN t0.location ELSE left(coalesce(l.location, ''), 255) END AS location,
               CASE WHEN l.url IS NULL THEN t0.department ELSE nullif(left(l.department, 255), '') END AS department, CASE WHEN l.url IS NOT NULL THEN {level('l.title')} END AS level, CASE WHEN l.url IS NOT NULL THEN {sector('l.title', 'l.department')} END AS sector
        FROM t0 FULL JOIN l ON l.url = t0.url)
  SELECT x.* FROM x LEFT JOIN o ON o.company_id = x.company_id LEFT JOIN (SELECT DISTINCT company_id, url FROM w) s ON s.company_id = x.company_id AND s.url = x.url WHERE bucket IS NULL OR bucket = 'zero_jobs' OR s.url IS NOT NULL"""
