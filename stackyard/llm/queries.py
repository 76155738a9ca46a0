"""The ``opN_<name>`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackyard.llm.bestfit_packing import pack
from stackyard.llm.bpe_codec import encode
from stackyard.llm.exact_dedup import exact_dedup
from stackyard.llm.interpolated_lm import lm_scores
from stackyard.llm.minmax_dedup import near_duplicates
from stackyard.llm.pair_maxscore import ranked
from stackyard.llm.sharding import shard_documents
from stackyard.llm.spelling import spelling_variants
from stackyard.llm.syncmers import fingerprints
from stackyard.llm.token_counts import count_tokens
from stackyard.llm.toxicity import toxicity
from stackyard.llm.url_filter import PATTERN_RULES, filter_urls
from stackyard.llm.warc import archive_roundtrip
from stackyard.tables import load


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op2_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(load(spark, sf_dir, "documents"))


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return encode(load(spark, sf_dir, "documents"), ranks, pattern, decoded=True).select(
        "doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_roundtrip(load(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(load(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_minmax_dedup, op2_interpolated_lm, op3_url_filter, op4_sharding, op5_bestfit_packing, op6_exact_dedup,
        op7_bpe_codec, op8_toxicity, op9_token_counts, op10_syncmers, op11_warc,
        op12_spelling, op13_search)}

#: The same patterns as in url_filter, each run over every url (DuckDB has no \\b beside '-').
_BLOCKED = " OR ".join(f"regexp_matches(lower(url), '{r.pattern}')" for r in PATTERN_RULES)
_FIRST = ", ".join(f"CASE WHEN regexp_matches(lower(url), '{r.pattern}') THEN '{r.pattern}' END"
                   for r in sorted(PATTERN_RULES, key=lambda r: r.pattern))

def _terms(col: str) -> str:
    return (f"regexp_extract_all(translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


ORACLES: dict[str, str] = {
    "op3_url_filter": rf"""
        WITH t AS (SELECT page_id, url,
            coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS raw_host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        h AS (SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
              FROM t),
        r AS (SELECT *, CASE
            WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
        SELECT page_id, host, path, rule,
            CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                 WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict,
            CASE WHEN rule IS NULL THEN coalesce({_FIRST}) END AS pattern
        FROM r""",
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g ON t.text = g.text""",
    # base32 of a SHA-1: every five hexadecimal digits are four of its letters
    "op11_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT *, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS top FROM t)
        SELECT page_id, strlen(html) AS payload_bytes,
            list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST(('0x' || substr(sha, 1 + 5 * (i // 4), 5)) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS BIGINT) + 1, 1)
                FOR i IN range(32)], 'string_agg', '') AS payload_digest,
            CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
        FROM h""",
    "op13_search": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, text FROM documents),
        t AS (SELECT row_no, doc_id, unnest({_terms('text')}) AS term FROM d),
        f AS (SELECT row_no, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        l AS (SELECT row_no, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY row_no),
        g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM l),
        q AS (SELECT DISTINCT item_id, unnest({_terms('text')}) AS term FROM benchmark),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
              FROM f, g GROUP BY term),
        s AS (SELECT item_id, row_no, doc_id,
                CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
              FROM q JOIN w USING (term) JOIN f USING (term) JOIN l USING (row_no), g GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row_no) AS INTEGER) AS rank,
            doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
