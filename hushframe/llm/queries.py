"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from . import chat, exact_dedup, jaccard, packing, pieces, pii, quality, search, secrets, sharding

QUERIES = {
    "op1_nearest_neighbours": search.op1_nearest_neighbours,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_sharding": sharding.op4_sharding,
    "op5_pii": pii.op5_pii,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_quality_classifier": quality.op10_quality_classifier,
}

SQL = {"op7_exact_dedup": exact_dedup.OP7_SQL, "op8_chat_formatting": chat.OP8_SQL}
