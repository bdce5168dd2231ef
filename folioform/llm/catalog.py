"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import conversation_repair, decontamination, embedding_dedup, html_extraction, mixing, near_dedup, periodic_runs, quality, secret_scan, sharding, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_simhash": near_dedup.op6_simhash,
    "op7_sharding": sharding.op7_sharding,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_html_extraction": html_extraction.op12_html_extraction,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

SQL = {
    "op1_embedding_dedup": embedding_dedup.OP1_SQL,
    "op2_url_filter": url_filter.OP2_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op9_secret_scan": secret_scan.OP9_SQL,
}
