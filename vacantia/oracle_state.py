"""DuckDB SQL of the queries of logs, state, bucketed tables, dumps and board samples."""

from __future__ import annotations

from . import queries_state as Q
from .functions import rules as R
from .oracle import C, J, norm, q, rx, v1
from .oracle_runs import SQL as RUNS

SQL: dict[str, str] = {}
PROBES = """e AS (SELECT user_id AS source_id, ts, event_id, CASE WHEN event_id % 11 > 0 THEN event_type IN ('error', 'view', 'click') END AS failed FROM events),
  n AS (SELECT *, coalesce(NOT failed, false) OR coalesce(ts >= lag(ts) OVER w + INTERVAL 48 HOURS, false) AS fresh FROM e WINDOW w AS (PARTITION BY source_id ORDER BY ts, event_id)),
  r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS run FROM n),
  k AS (SELECT *, count(*) FILTER (failed) OVER v AS n, count(failed) OVER v > 0 AS known FROM r WINDOW v AS (PARTITION BY source_id, run ORDER BY ts, event_id)),
  h AS (SELECT *, CASE WHEN n >= 3 THEN 'needs_manual_review' WHEN n > 0 THEN 'dead' WHEN known THEN 'ok' END AS status FROM k)"""
SQL["failure_replay"] = f"WITH {PROBES} SELECT event_id, source_id, n AS ats_failure_count, status AS ats_status FROM h"
SQL["stream_failure_counter"] = f"""WITH {PROBES}, l AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM h QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, event_id DESC) = 1),
  x AS (SELECT *, ms + 172800000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) AS gone FROM l)
  SELECT source_id, CASE WHEN gone THEN ms + 172800000 ELSE ms END AS at_ms, CASE WHEN gone THEN 0 ELSE n END AS ats_failure_count, CASE WHEN gone THEN 'expired' ELSE status END AS ats_status FROM x"""

SQL["bucketed_upsert"] = f"""WITH {J}, t AS (SELECT url, id, company_id, title, location FROM j WHERE id % 10 < 8 QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1),
  s AS (SELECT url, id, company_id, title || ' *' AS title FROM j WHERE company_id % 500 = 7 QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1),
  m AS (SELECT coalesce(t.url, s.url) AS url, coalesce(s.id, t.id) AS id, coalesce(s.company_id, t.company_id) AS company_id, CASE WHEN s.url IS NOT NULL THEN s.title ELSE t.title END AS title, t.location FROM t FULL JOIN s ON s.url = t.url)
  SELECT * FROM m WHERE url NOT IN (SELECT url FROM j WHERE id % 1000 = 3)"""

SQL["dump_round_trip"] = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN 'it''s (' || o_orderpriority || '), '';' || chr(10) || (o_orderkey % 7) END AS note, o_totalprice AS price, o_custkey % 2 = 0 AS even FROM orders"""

VAGUE = f"(n = '' OR {rx('n', '[0-9]+\\s+locations?')} OR n IN ({', '.join(map(q, R.SAMPLE_VAGUE))}))"
SQL["board_facet_trust"] = f"""WITH {J}, p AS (SELECT company_id, id, CASE company_id % 3 WHEN 0 THEN 'London' WHEN 1 THEN CASE WHEN id % 4 > 0 THEN 'New York, NY' ELSE 'Leeds' END ELSE location END AS location FROM j
    WHERE company_id % 9 <> 4 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY id) <= 20),
  f AS (SELECT company_id, {norm('location')} AS n FROM p), u AS (SELECT company_id, {v1('n')} AS uk, {VAGUE} AS vague FROM f),
  a AS (SELECT company_id, count(*) FILTER (uk) AS n_uk, count(*) FILTER (NOT uk AND NOT vague) AS n_other FROM u GROUP BY 1),
  b AS (SELECT c_custkey AS board_id, c_custkey % 50 AS total, c_custkey % 67 AS global_total, c_custkey % 4 <> 0 AS applied, coalesce(n_uk, 0) AS n_uk, coalesce(n_other, 0) AS n_other FROM customer LEFT JOIN a ON company_id = c_custkey),
  r AS (SELECT *, applied AND global_total > 0 AND coalesce(total / nullif(global_total, 0) < 0.75, false) AND n_other <= n_uk AS uses_facet FROM b)
  SELECT *, uses_facet OR n_other = 0 AS trusted FROM r"""
SQL["sync_outcomes_nhs"] = RUNS["sync_outcomes"].replace("m AS (SELECT jj.*, kk.keep FROM", "m AS (SELECT jj.*, kk.keep OR jj.company_id % 7 = 3 AS keep FROM")

SQL["feed_search_indexed"] = f"""WITH {C}, {J}, m AS (SELECT j.id, company_id, title, trading_name, created_at FROM j JOIN c ON c.id = company_id WHERE title ILIKE {q('%' + Q.INDEXED_TERM + '%')} OR trading_name ILIKE {q('%' + Q.INDEXED_TERM + '%')}),
  t AS (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id DESC) AS p FROM m QUALIFY p <= 50), a AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY p) > 1 AS again FROM t)
  SELECT row_number() OVER (ORDER BY again, p) AS pos, id, company_id, title, trading_name FROM a ORDER BY pos LIMIT 10"""

SQL["recount_deltas"] = """SELECT CASE WHEN o_orderkey % 101 = 0 THEN o_custkey + 1 ELSE o_custkey END AS company_id, count(*) AS active_jobs_count FROM orders WHERE o_orderkey % 10 >= 2 AND o_custkey % 50 <> 3 GROUP BY 1"""


def _walk(sort: str, order: str) -> str:
    """CTEs of the pages of one walk: each takes ten of the first fifty rows that no page before it has."""
    out = []
    for k in range(1, Q.KEYSET_PAGES + 1):
        shown = "".join(f" AND id NOT IN (SELECT id FROM {sort}{i})" for i in range(1, k))
        out.append(f"""{sort}{k} AS (SELECT {q(sort)} AS sort, {k} AS page, row_number() OVER (ORDER BY again, p) AS pos, id, company_id FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY p) > 1 AS again FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS p FROM m WHERE true{shown} QUALIFY p <= 50)) ORDER BY again, p LIMIT 10)""")
    return ",\n  ".join(out)


SORTS = {"newest": "created_at DESC NULLS FIRST, id DESC", "oldest": "created_at ASC NULLS LAST, id ASC", "title_asc": "title ASC NULLS LAST, id DESC", "title_desc": "title DESC NULLS FIRST, id DESC"}
SQL["keyset_pages"] = f"""WITH {J}, m AS (SELECT j.id, company_id, title, created_at FROM j JOIN customer ON c_custkey = company_id WHERE j.id % 3 <> 0),
  {", ".join(_walk(s, o) for s, o in SORTS.items())}
  {" UNION ALL ".join(f"SELECT * FROM {s}{k}" for s in SORTS for k in range(1, Q.KEYSET_PAGES + 1))}"""
SQL["stream_bucketed_upsert"] = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
SQL["preferences_upsert"] = """WITH l AS (SELECT user_id, max_by(event_type, event_id) AS sectors, max_by(event_id % 5, event_id) AS salary_min FROM events WHERE event_id % 2 = 0 AND user_id % 3 > 0 GROUP BY 1),
  s AS (SELECT user_id, max_by(event_type, event_id) AS sectors FROM events WHERE event_id % 7 = 1 AND user_id % 4 > 0 GROUP BY 1)
  SELECT coalesce(l.user_id, s.user_id) AS user_id, coalesce(s.sectors, l.sectors) AS sectors, l.salary_min FROM l FULL JOIN s ON s.user_id = l.user_id"""
SQL["company_lookup"] = f"WITH {J} SELECT j.id, c_name AS trading_name, title FROM j JOIN customer ON c_custkey = company_id WHERE c_name = 'Customer#000000042'"
