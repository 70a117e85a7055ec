"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import op01_pii, op02_mixing, op03_quality, op04_urls, op05_decontaminate, op06_substring, op07_near, op08_classifier, op09_language, op10_secrets
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_pii.find_personal(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_quality.quality(table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_urls.judge(table(spark, sf_dir, "pages"), op04_urls.rule_table(spark))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op05_decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hits")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_substring.remove_repeats(table(spark, sf_dir, "documents")).drop("runs")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_near.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op8_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_language.languages(table(spark, sf_dir, "documents"))


def op10_secrets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_secrets.find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_mixing, op3_quality_outliers, op4_url_rules, op5_decontaminate, op6_substrings, op7_near_duplicates, op8_quality_votes, op9_language, op10_secrets_scan)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK = r"[^\x20\x09-\x0D]+"

ORACLE = {
    "op4_url_rules": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)
""",
    "op5_decontaminate": f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, w[i : i + 9] AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(x) AS n FROM windows),
places AS (SELECT doc_id, n, i, w[i : i + n - 1] AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM places JOIN windows USING (x)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op6_substrings": f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i : i + 12] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
low AS (SELECT x, min(doc_id) AS m FROM windows GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM windows JOIN low USING (x) WHERE doc_id > m),
lists AS (SELECT doc_id, list(j) AS g FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, w, g, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda v, k: NOT list_contains(g, k)) END AS r FROM words LEFT JOIN lists USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(array_to_string(r, ' ')) AS kept_sha256 FROM kept
""",
    "op7_near_duplicates": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_BLANK}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets WHERE len(s) > 0),
rarity AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
ranked AS (SELECT doc_id, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY c, t) AS r FROM tokens JOIN rarity USING (t)),
prefix AS (SELECT doc_id, n, t FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
near AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM prefix x JOIN prefix y ON x.t = y.t AND x.doc_id < y.doc_id AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n),
inter AS (SELECT a, b, len(p.s) AS na, len(q.s) AS nb, len(list_intersect(p.s, q.s)) AS k FROM near JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b),
links AS (SELECT a, b FROM inter WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp USING (doc_id)
""",
}
