"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edit_counts, exact_dedup, html_text, knn, lexical, mixing, ngram_join, packing, quality, sharding, spelling, token_files, warc
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), added_tokens=True)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words, similarity 0.9, as this query's contract says."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), added_tokens=True)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards by source to 24 of equal bytes."""
    old = F.pmod(F.xxhash64("source"), F.lit(16))
    return sharding.shard_digest(table(spark, sf_dir, "documents"), old, 16, 24)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(knn.integer_vectors(table(spark, sf_dir, "embeddings")), query_every=100, k=10)


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits to every document, made from its own text; see edit_counts.scripted_edits."""
    docs = edit_counts.scripted_edits(table(spark, sf_dir, "documents"))
    return edit_counts.edited_counts(docs, tokenizer_path("byte_bpe_50k.json"), added_tokens=True)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_ngram_join": op2_ngram_join,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_sharding": op5_sharding,
    "op6_html": op6_html,
    "op7_mixing": op7_mixing,
    "op8_knn": op8_knn,
    "op9_edit_counts": op9_edit_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_warc": op11_warc,
    "op12_lexical": op12_lexical,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL = {
    "op8_knn": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS i
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, v.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.i, v.i), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) t
        WHERE r <= 10""",
    "op10_exact_dedup": """
        WITH n AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM n""",
    "op11_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM t""",
    "op12_lexical": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
          FROM documents),
        k AS (SELECT r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
        g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM k),
        q AS (
          SELECT qr, item_id, term, count(*) AS times
          FROM (SELECT row_number() OVER () AS qr, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) b
          GROUP BY ALL),
        p AS (
          SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM k) u
          WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term) f, g),
        s AS (
          SELECT qr, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * nn) // ll))))) AS BIGINT) AS score
          FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) t
        WHERE rank <= 10""",
}
