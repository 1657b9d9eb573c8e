"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from wattscan.llm import bpe, conversation_repair, exact_dedup, html_extract, language_id, lexical_search, lm_score, mixing, near_dup, quality, secret_scan, token_counts, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_near_dup": near_dup.op4_near_dup,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_lm_score": lm_score.op8_lm_score,
    "op8_lm_score_whole": lm_score.op8_lm_score_whole,
    "op9_bpe": bpe.op9_bpe,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
