"""The queries of this package and the SQL that gives the same rows, by name."""

from __future__ import annotations

from . import (
    chat_format,
    embedding_dedup,
    infill,
    minhash_dedup,
    mixing,
    packing,
    piece_encoding,
    pii,
    quality_classifier,
    quality_rules,
    secret_scan,
    url_filter,
    vector_codes,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_minhash_dedup": minhash_dedup.op2_minhash_dedup,
    "op3_pii": pii.op3_pii,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_packing": packing.op6_packing,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_infill": infill.op11_infill,
    "op12_piece_encoding": piece_encoding.op12_piece_encoding,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op9_embedding_dedup": embedding_dedup.OP9_SQL,
    "op10_chat_format": chat_format.OP10_SQL,
    "op11_infill": infill.OP11_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
