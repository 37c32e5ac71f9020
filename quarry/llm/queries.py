"""Queries of this subpackage: opN_<name>(spark, sf_dir) and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat_format, decontaminate, exact_dedup, line_dedup, ngram_join, packing, quality, token_files, url_reputation, warc
from quarry.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label with the page's number: bad is label 0."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.read_token_files(folder, rows)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per turn: its new role, what was merged or inserted, and the piece that it adds to the rendered text."""
    repaired = chat_format.render(chat_format.repair(table(spark, sf_dir, "conversations")))
    out = ("conv_id", "turn", "role", "new_role", "merged", "inserted_before", "inserted_after", "cost", "rendered")
    return repaired.select(*out)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_OP1 = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dg AS (SELECT r, doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
hit AS (SELECT r, item_id, i, dg.k FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
o AS (SELECT *, row_number() OVER w AS i, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS m FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id, r))
SELECT doc_id, keep_id, CAST(m AS BIGINT) AS group_size, i = 1 AS kept, h AS text_sha256 FROM o
"""

_OP3 = r"""
WITH seen AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule, h, p) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('block', 'net/de/', 'net', '/de/'), ('allow', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
worst AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
c AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS k, regexp_extract(b, '[^.]*$') AS suffix, regexp_extract(b, '([^.]*\.)?[^.]*$') AS domain
      FROM (SELECT host, bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS b FROM seen JOIN worst USING (page_id)) GROUP BY host, b),
g AS (SELECT coalesce(sum(k) / sum(n), 0) AS m FROM c),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM c, g GROUP BY suffix),
s1 AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.0001), 0.0001), 0.5) - 1 AS t FROM s0),
s AS (SELECT suffix, (k + m * t) / (n + t) AS m FROM s0, s1),
d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM c JOIN s USING (suffix) GROUP BY domain),
d1 AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.0001), 0.0001), 0.5) - 1 AS t FROM d0),
d AS (SELECT domain, (k + m * t) / (n + t) AS m FROM d0, d1),
h0 AS (SELECT host, n, k, m FROM c JOIN d USING (domain)),
h1 AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.0001), 0.0001), 0.5) - 1 AS t FROM h0),
h AS (SELECT host, (k + m * t) / (n + t) AS m, n + t AS w FROM h0, h1),
blocked AS (SELECT host FROM h WHERE m - 1.645 * sqrt(m * (1 - m) / (w + 1)) > 0.5),
fit AS (SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM (SELECT DISTINCT page_id, url, host, path FROM seen) v JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, url)
SELECT seen.page_id, seen.host, path, rule, coalesce(verdict, CASE WHEN blocked.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM seen LEFT JOIN fit ON seen.page_id = fit.page_id AND seen.url = fit.url LEFT JOIN blocked ON seen.host = blocked.host
"""

ORACLE = {"op3_url_reputation": _OP3, "op1_decontaminate": _OP1, "op8_exact_dedup": _OP8}
