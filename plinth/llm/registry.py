"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from plinth.llm import decontaminate, fingerprint, html_extract, katz, near_dedup, packing, piece_count, quality, suffix_dedup, url_filter

QUERIES = {
    "op1_katz_lm": katz.op1_katz_lm,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op2_minhash_dedup": near_dedup.op2_minhash_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_token_count": piece_count.op5_token_count,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_quality": quality.op9_quality,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLES = {
    "op10_url_filter": url_filter.OP10_SQL,
}
