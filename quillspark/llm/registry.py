"""Queries of this subpackage for the driver's entry module, and their SQL where SQL can express them."""

from __future__ import annotations

from quillspark.llm import decontamination, divergence, fingerprints, html_text, mixing, negatives, ngram_join, pii, quality, secrets, substrings, toxicity, warc

QUERIES = {
    "op1_fingerprints": fingerprints.fingerprints,
    "op2_substrings": substrings.deduplicate,
    "op3_decontamination": decontamination.leaks,
    "op4_toxicity": toxicity.classify,
    "op5_mixing": mixing.plan,
    "op6_html": html_text.main_texts,
    "op7_quality": quality.classify,
    "op8_warc": warc.round_trip,
    "op9_ngram_join": ngram_join.components_of_documents,
    "op10_secrets": secrets.find,
    "op11_negatives": negatives.hard_negatives,
    "op12_divergence": divergence.audit,
    "op13_pii": pii.find,
}

_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda k: CAST(substr(
    array_to_string(list_transform(range(40), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, c + 1, 1)) - 1) + 1, 4)), ''),
    5 * i + k + 1, 1) AS INTEGER) * (16 >> k))) AS INTEGER), 1)), '')"""

ORACLES = {
    "op2_substrings": substrings.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op11_negatives": negatives.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op8_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS digest_ok
FROM f""",
}
