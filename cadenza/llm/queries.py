"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import bpe, decontam, jaccard, langid, outliers, quality, suffix_dedup, tokencount, toxicity, warc
from cadenza.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.verdicts(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.screen(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_langid": op8_langid,
    "op9_jaccard": op9_jaccard,
    "op10_outliers": op10_outliers,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
        m AS (SELECT h, max(page_id) AS r FROM d GROUP BY h),
        b AS (SELECT h, r, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * i::INT + 1, 5))::INT >> (15 - 5 * j::INT)) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
              FROM m)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = r THEN NULL ELSE r END AS refers_to
        FROM d JOIN b USING (h)""",
    # every 50-byte window of every text, by the smallest doc_id that has it; bytes covered by one that a smaller has go
    "op2_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
        h AS MATERIALIZED (SELECT r, doc_id, n, hex(encode(t)) AS h FROM d),
        w AS MATERIALIZED (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS i FROM h WHERE n >= 50)),
        m AS (SELECT w, min(doc_id) AS least FROM w GROUP BY w),
        s AS (SELECT r, i FROM w JOIN m USING (w) WHERE least < doc_id),
        e AS (SELECT r, i, max(i + 50) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
        g AS (SELECT r, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM e),
        c AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY r, run),
        k AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM c),
        x AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM c GROUP BY r),
        p AS (SELECT k.r, string_agg(substr(h.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS p FROM k JOIN h USING (r) GROUP BY k.r)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(p, '') || substr(h.h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM h LEFT JOIN x USING (r) LEFT JOIN p USING (r)""",
    # all pairs that share a shingle, counted; then what links reach
    "op9_jaccard": """
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT r, list_aggregate(w[i:least(i + 4, len(w))], 'string_agg', ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
        n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
        b AS (SELECT s, count(*) AS k FROM s GROUP BY s HAVING count(*) > 1), f AS MATERIALIZED (SELECT r, s FROM s JOIN b USING (s)),
        o AS (SELECT x.r AS a, y.r AS b, count(*) AS o FROM f x JOIN f y ON x.s = y.s AND x.r < y.r GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        c AS (SELECT r AS a, r AS b FROM n UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
        m AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)""",
}
