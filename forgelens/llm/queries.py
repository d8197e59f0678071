"""Registered queries of the subpackage and their SQL counterparts."""

from . import (
    brown_lm,
    embedding_dedup,
    importance_resampling,
    language_id,
    license_scan,
    line_dedup,
    near_dedup,
    posting_search,
    sentence_pieces,
    soft_mixing,
    token_output,
    topk_search,
    whitening,
)

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_minhash_dedup": near_dedup.query,
    "op3_brown_lm": brown_lm.query,
    "op4_soft_mixing": soft_mixing.query,
    "op5_license_scan": license_scan.query,
    "op6_sentence_pieces": sentence_pieces.query,
    "op7_topk_search": topk_search.query,
    "op8_line_dedup": line_dedup.query,
    "op9_token_output": token_output.query,
    "op10_language_id": language_id.query,
    "op11_embedding_whitening": whitening.query,
    "op12_posting_search": posting_search.query,
    "op13_importance_resampling": importance_resampling.query,
}
STATEMENTS = {
    "op1_embedding_dedup": embedding_dedup.SQL,
    "op5_license_scan": license_scan.SQL,
    "op7_topk_search": topk_search.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op13_importance_resampling": importance_resampling.SQL,
}
