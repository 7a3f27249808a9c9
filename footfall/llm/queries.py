"""The document operators as queries over whole tables, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import (block_naming, bottom_k, byte_bpe, jaccard_join, license_scan, packing, secret_ledger, source_audit, spelling, suffix_buckets,
                          token_files, toxicity, url_filter)
from footfall.llm.common import table

# Ends every document of the token operators.
END_ID = 1

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


@_query("op1_byte_bpe")
def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query("op3_token_files")
def huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query("op9_best_fit_packing")
def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


@_query("op5_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_dedup(table(spark, sf_dir, "documents"))


@_query("op4_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_ledger.secrets(spark, docs)


@_query("op7_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.compare_edits(table(spark, sf_dir, "documents"))


@_query("op8_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("sha")


@_query("op10_jaccard_join")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@_query("op6_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_buckets.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op2_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@_query("op11_source_audit", r"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS no,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT lang, source, no, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT no) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT g.lang, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM g GROUP BY g.lang),
        grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v FROM g JOIN kept k USING (lang) JOIN v USING (lang)
            LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT *, sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS lt,
            sum(n) OVER (PARTITION BY lang, source) AS t FROM grid),
        p AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 5) // (t + 5 * v) AS p, 1 + 1000000000::HUGEINT * (ln + 5) // (lt + 5 * v) AS q FROM f),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b
                ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
            ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
            FROM (FROM pairs UNION ALL FROM terms))
    FROM ranked WHERE part = 'pair' OR rank <= 50""")
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


URL_RULES = (url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"),
             url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"))


@_query("op13_url_filter", r"""
    WITH RECURSIVE u AS (SELECT page_id, html, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0
            THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        rules(rule, host, path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
            ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        h AS (SELECT page_id, html, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
            regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM u),
        nodes AS (SELECT *, lower(regexp_extract(url, '^[^:]*://')) || host || tail AS node FROM h),
        found AS (SELECT node AS a, unnest(regexp_extract_all(html, '<link rel="canonical" href="([^"#]+://[^"#]+)', 1) ||
            regexp_extract_all(html, '<meta http-equiv="refresh" content="[0-9]+;\s*url=([^"#]+://[^"#]+)', 1)) AS b FROM nodes),
        edges AS (SELECT a, b FROM found UNION SELECT b, a FROM found),
        ruled AS (SELECT x.host, x.path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
            FROM (SELECT DISTINCT host, path FROM h) x JOIN rules r ON (x.host = r.host OR ends_with(x.host, '.' || r.host))
            AND starts_with(x.path, r.path) GROUP BY ALL),
        bad(node) AS (SELECT node FROM nodes JOIN ruled USING (host, path) WHERE verdict = 'block' AND node IN (SELECT a FROM edges)
            UNION SELECT e.b FROM bad JOIN edges e ON bad.node = e.a)
    SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict
        WHEN node IN (FROM bad) THEN 'block' ELSE 'allow' END AS verdict
    FROM nodes LEFT JOIN ruled USING (host, path)""")
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@_query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
