"""The queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

from . import chat, clusters, divergence

#: Module of each query; imported when the queries are listed.
MODULES = {
    "op1_bpe": "bpe",
    "op2_substring_dedup": "substring_dedup",
    "op3_chat": "chat",
    "op4_url_rules": "url_rules",
    "op5_quality": "quality",
    "op6_simhash": "simhash",
    "op7_media": "media",
    "op8_main_text": "main_text",
    "op9_mixing": "mixing",
    "op10_warc": "warc",
    "op11_pieces": "pieces",
    "op12_divergence": "divergence",
    "op13_clusters": "clusters",
}

SQL = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT win, min(doc_id) AS f FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM windows JOIN firsts USING (win) WHERE f < doc_id)),
listed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT l.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY l.p) FILTER (WHERE g.p IS NULL) AS text FROM listed l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op3_chat": chat.SQL,
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
t AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex, first FROM p JOIN f USING (h))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substring(hex, (k // 4) * 5 + 1, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM t""",
    "op12_divergence": divergence.SQL,
    "op13_clusters": clusters.sql(),
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
