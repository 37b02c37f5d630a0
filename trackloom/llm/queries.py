"""The registered queries of this subpackage and the SQL that some of them can be checked against."""

from __future__ import annotations

from . import ann, bpe, chat, html_text, line_dedup, mixing, ngram_join, pii, quality_qda, quality_rules

QUERIES = {
    "op1_pii": pii.query,
    "op2_ngram_jaccard": ngram_join.query,
    "op3_quality_qda": quality_qda.query,
    "op4_chat_format": chat.query,
    "op5_html_text": html_text.query,
    "op6_line_dedup": line_dedup.query,
    "op7_adaptive_scan": ann.query,
    "op8_quality_rules": quality_rules.query,
    "op9_source_mix": mixing.query,
    "op10_bpe_trie": bpe.query,
}

ORACLE_SQL = {
    "op4_chat_format": chat.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op9_source_mix": mixing.SQL,
}
