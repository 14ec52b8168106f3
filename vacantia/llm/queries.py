"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, exact_dedup, jaccard, language, licenses, mixing, pieces, resampling, secret_scan, sharding, suffixes, tiff, toxicity
from .common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.round_trip(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.in_order(table(spark, sf_dir, "documents"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    found = (
        op1_language, op2_exact_dedup, op3_tiff, op4_sharding, op5_toxicity, op6_pieces, op7_licenses, op8_mixing, op9_suffixes, op10_jaccard,
        op11_filter_audit, op12_secrets, op13_resampling,
    )
    return {f.__name__: f for f in found}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = {
    "op2_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ASC)
""",
    "op9_suffixes": r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, b, unnest(range(1, greatest(octet_length(b) - 48, 1))) AS i FROM b),
s AS (SELECT doc_id, i, b[i:i + 49] AS s FROM w),
m AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, i FROM s JOIN m USING (s) WHERE least < doc_id),
n AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM h),
r AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
p AS (SELECT doc_id, k, min(i) AS lo, max(i) + 49 AS hi FROM r GROUP BY doc_id, k),
q AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM p),
t AS (SELECT doc_id, sum(hi - lo + 1)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last FROM p GROUP BY doc_id),
k AS (SELECT q.doc_id, string_agg(hex(b[before + 1:lo - 1]), '' ORDER BY lo) AS kept FROM q JOIN b USING (doc_id) GROUP BY q.doc_id)
SELECT b.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN last IS NULL THEN b ELSE unhex(kept || hex(b[last + 1:])) END) AS kept_sha256
FROM b LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op10_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op11_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, part,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM d),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (
  SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
         coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k::INT, 1)) - 65))), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
x AS (SELECT part, filter_order, step, mask, bit, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, mask & bit > 0 AS fails, mask & before = 0 AS free
      FROM m LEFT JOIN l USING (doc_id), s),
r AS (
  SELECT part, filter_order, step, bit, count(*) FILTER (free AND NOT fails) AS kept, count(*) FILTER (free AND fails) AS removed, count(*) FILTER (NOT free AND fails) AS redundant,
         count(*) FILTER (mask = bit) AS unique_fails, coalesce(sum(good) FILTER (free AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (free AND fails), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
""",
    "op12_secrets": rf"""
WITH r AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{r.kind}', {_quoted(r.pattern)}, {r.least})" for k, r in enumerate(secret_scan.RULES))}) AS r(k, kind, p, least)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, k, kind, least, regexp_split_to_array(text, p) AS gaps, regexp_extract_all(text, p, 0) AS hits FROM d, r WHERE regexp_matches(text, p)),
h AS (SELECT doc_id, k, kind, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits FROM m),
e AS (SELECT doc_id, k, kind, hits[i] AS hit, length(CASE WHEN k = 0 THEN regexp_extract(hits[i], {_quoted(secret_scan.BASE[0].pattern)}, 2) ELSE hits[i] END) >= least AS kept,
             sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM h),
t AS (SELECT doc_id, k, kind, (e - length(hit))::BIGINT AS s, concat_ws(':', kind, (e - length(hit))::BIGINT, e::BIGINT) AS t FROM e WHERE kept),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             coalesce(string_agg(t, ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(t, ',' ORDER BY s, k) AS spans FROM t GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
""",
    "op13_resampling": r"""
WITH RECURSIVE c AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) AS t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM c WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS crc FROM c WHERE k = 8),
x AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
y AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM x UNION SELECT w FROM y)),
u AS (
  SELECT w, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM x JOIN u USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM y JOIN u USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM x) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM y) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
n AS (SELECT doc_id, count(*) AS n, sum(gain) AS gain FROM x JOIN u USING (w) JOIN g USING (bucket) GROUP BY doc_id),
f AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(floor(gain::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN n USING (doc_id)),
q AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM q WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM q LEFT JOIN r USING (doc_id)
""",
}
