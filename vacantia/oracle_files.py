"""DuckDB SQL of the queries of file sources and sinks, reports and small lookups."""

from __future__ import annotations

from .oracle import C, J, S
from .oracle import SQL as BASE

SQL: dict[str, str] = {}
SQL["csv_round_trip"] = """SELECT c_custkey::VARCHAR AS id, 'say "x", ' || c_custkey || chr(10) || 'and, é' AS note, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name FROM customer"""
SQL["csv_lines"] = """SELECT c_custkey::VARCHAR AS id, 'a, "' || c_name || '"' AS name, 'pq,rs' || (c_custkey % 5) AS mixed, CASE WHEN c_custkey % 4 = 0 THEN 'open, to the end' ELSE '' END AS last FROM customer"""
SQL["csv_naive"] = """SELECT c_custkey::VARCHAR AS a, '"' || c_name AS b, ' x"' AS c, (c_custkey % 7)::VARCHAR AS d FROM customer"""
SQL["register_csv"] = f"""WITH {S} SELECT ' ' || organisation || ', "Ltd"' AS organisation, town, county, rating, 'Skilled Worker' AS route FROM s WHERE pos % 9 > 0"""
SQL["processed_ids"] = "SELECT DISTINCT CASE WHEN c_custkey % 5 = 1 THEN c_custkey % 100 ELSE c_custkey END AS id FROM customer WHERE c_custkey % 5 > 0"
SQL["companies_json"] = "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name FROM customer"
SQL["outcome_buckets"] = "SELECT c_custkey AS company_id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'zero_jobs' WHEN 1 THEN 'uk_jobs' ELSE 'non_uk_jobs' END AS bucket FROM customer"
SQL["json_array"] = r"""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN '"a \"b\"\n' || c_name || '"' ELSE 'null' END AS name, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)
  SELECT unnest(['  {', '    "id" : ' || id || ',', '    "name" : ' || name, '  }']) AS line FROM r UNION ALL SELECT ',' FROM r WHERE n > 1 UNION ALL SELECT unnest(['[', ']'])"""
SQL["update_statements"] = f"""WITH {C} SELECT 'UPDATE companies SET ats_board_token = ' || coalesce('''it''''s ' || ats_board_token || '''', 'NULL') || ', ats_provider = ' || coalesce('''' || ats_provider || '''', 'NULL') || ', checked = ' || (id % 2 = 0)::VARCHAR || ' WHERE id = ' || id || ';' AS sql FROM c WHERE id % 3 = 1"""
SQL["redelivered_events"] = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"
SQL["new_flags"] = f"WITH {J} SELECT id, created_at > TIMESTAMP '1996-06-01' - INTERVAL 48 HOURS AS is_new FROM j"
SQL["applied_times"] = f"""WITH {J}, m AS (SELECT j.id, company_id, created_at FROM j JOIN customer ON c_custkey = company_id), t AS (SELECT *, row_number() OVER (ORDER BY created_at ASC NULLS LAST, id ASC) AS p FROM m QUALIFY p <= 50),
  a AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY p) > 1 AS again FROM t), g AS (SELECT id, row_number() OVER (ORDER BY again, p) AS pos FROM a QUALIFY pos <= 10),
  u AS (SELECT event_id % 25 + 1 AS pos, max(ts) AS ts FROM events WHERE event_type = 'purchase' AND event_id % 7 = 3 GROUP BY 1)
  SELECT id, pos, epoch_us(ts) AS applied_us FROM g LEFT JOIN u USING (pos)"""
SQL["infer_ats_v6_tagged"] = f"""WITH {C}, h AS ({BASE["infer_ats_v6"]}), b AS (SELECT h.id, provider, token, c.careers_url AS u FROM h JOIN c ON c.id = h.id)
  SELECT id, provider, token, CASE WHEN provider = 'greenhouse' AND regexp_matches(u, '(?i)^https?://boards[.]greenhouse[.]io(/|$)') THEN 'https://boards.greenhouse.io/' || token WHEN provider IS NOT NULL THEN u END AS careers_url,
    CASE WHEN provider IS NOT NULL THEN 'high' END AS confidence, CASE WHEN provider IS NOT NULL THEN 'website_crawl' END AS layer FROM b"""
SQL["cleanup_scan"] = f"""WITH {J}, k AS ({BASE["cleanup_bad_locations"]}) SELECT j.id, title, j.location, c_name AS trading_name FROM j JOIN (SELECT id FROM k) k ON k.id = j.id LEFT JOIN customer ON c_custkey = company_id AND c_custkey % 5 > 0"""
R = "r AS (SELECT event_id AS id, event_id % 40 AS job_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'spam' END AS notes FROM events WHERE event_type = 'error')"
SQL["report_insert"] = f"WITH {R} SELECT * FROM r WHERE id > (SELECT min(id) FROM r) UNION ALL SELECT max(id) + 1, 12, 77, NULL FROM r"
SQL["report_delete"] = f"WITH {R}, {J}, o AS (SELECT job_id AS gone FROM r ORDER BY id LIMIT 1) SELECT 'job' AS kind, id FROM j WHERE id <> (SELECT gone FROM o) UNION ALL SELECT 'report', id FROM r WHERE job_id <> (SELECT gone FROM o)"
SQL["account_delete"] = "SELECT event_type AS kind, user_id, event_id AS id FROM events WHERE event_type IN ('purchase', 'click', 'error') AND user_id <> 3"
