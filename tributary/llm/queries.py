"""Registered queries of this subpackage: thin callables over whole tables."""

from __future__ import annotations

from tributary.llm.common import table


def tokenizer_path(name):
    """A public vocabulary file of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    from tributary.llm.toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark, sf_dir):
    from tributary.llm.exact_dedup import exact_dedup_report

    return exact_dedup_report(table(spark, sf_dir, "documents"))


def op4_html_text(spark, sf_dir):
    from tributary.llm.html_text import extract_report

    return extract_report(table(spark, sf_dir, "pages"))


def op5_bpe(spark, sf_dir):
    import public_tokenizers

    from tributary.llm.bpe_sql import bpe_report

    return bpe_report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_simhash(spark, sf_dir):
    from tributary.llm.simhash import near_dedup_report

    return near_dedup_report(table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    from tributary.llm.packing import packed_report

    return packed_report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_embedding_dedup(spark, sf_dir):
    from tributary.llm.embedding_dedup import near_vectors_report

    return near_vectors_report(table(spark, sf_dir, "embeddings"))


def op8_warc(spark, sf_dir):
    from tributary.llm.warc import warc_report

    return warc_report(table(spark, sf_dir, "pages"))


def op9_token_files(spark, sf_dir):
    from tributary.llm.token_files import token_file_report

    return token_file_report(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_substring_dedup(spark, sf_dir):
    from tributary.llm.sentence_dedup import substring_report

    return substring_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_packing, op4_html_text, op5_bpe, op6_simhash, op7_embedding_dedup, op8_warc, op9_token_files, op10_substring_dedup)}
ORACLES = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT *, sha1(h) || '0' AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, strlen(h) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 5 * i // 4 + 1, 2) AS INTEGER) >> (3 - 5 * i % 4)::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d
    """,
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
        ),
        reach AS (
          SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ),
        low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
        FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
    """,
}
