"""Queries over the corpus tables, and SQL for those that SQL can express."""

from __future__ import annotations

from .common import table
from .decontamination import find_leaks
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .jaccard_join import jaccard_join
from .pieces import encode
from .quality import score_quality
from .repeats import remove_repeats
from .secret_scan import find_secrets
from .toxicity import score_toxicity
from .warc import archive_and_read


def op1_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_pieces(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op5_warc(spark, sf_dir):
    return archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op7_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


def op9_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERIES = {f.__name__: f for f in (op1_quality, op2_exact_dedup, op3_pieces, op4_suffix_dedup, op5_warc, op6_decontamination, op7_toxicity, op8_secret_scan, op9_html_text, op10_jaccard_join)}

ORACLE_SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op5_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f""",
}
