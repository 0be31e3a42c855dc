"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, html_template, language_id, near_dup, pii, quality_lm, sentencepiece_fst, token_counts, warc_audit

QUERIES = {
    "op1_merkle_audit": warc_audit.op1_merkle_audit,
    "op2_language_id": language_id.op2_language_id,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_sentencepiece": sentencepiece_fst.op4_sentencepiece,
    "op5_chat_format": chat.op5_chat_format,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_html_extract": html_template.op7_html_extract,
    "op8_near_dup": near_dup.op8_near_dup,
    "op9_pii": pii.op9_pii,
    "op10_quality": quality_lm.op10_quality,
}
SQL = {"op1_merkle_audit": warc_audit.OP1_SQL, "op5_chat_format": chat.OP5_SQL}
