"""The queries of this folder and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import bpe, chat, chat_repair, fingerprints, licenses, line_dedup, mixing, ngram_join, pii, quality, toxicity, vector_codes, vector_dedup

QUERIES = {
    "op1_fuzzy_lines": line_dedup.query,
    "op2_license_scan": licenses.query,
    "op3_ngram_jaccard": ngram_join.query,
    "op4_minhash_fingerprints": fingerprints.query,
    "op5_byte_bpe": bpe.query,
    "op6_quality_rules": quality.query,
    "op7_chat_windows": chat.query,
    "op8_personal_data": pii.query,
    "op9_source_mixing": mixing.query,
    "op10_toxicity": toxicity.query,
    "op11_conversation_repair": chat_repair.query,
    "op12_vector_codes": vector_codes.query,
    "op13_vector_dedup": vector_dedup.query,
}

#: The others hash, learn, merge bytes or draw; they are tested by brute force.
ORACLES: dict[str, str] = {
    "op3_ngram_jaccard": ngram_join.ORACLE,
    "op7_chat_windows": chat.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_vector_dedup": vector_dedup.ORACLE,
}
