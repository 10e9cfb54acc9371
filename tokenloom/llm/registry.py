"""All queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from tokenloom.llm import oracles
from tokenloom.llm import queries_basic as basic
from tokenloom.llm import queries_models as models
from tokenloom.llm import queries_pairs as pairs

QUERIES = {
    "op1_suffix_array_dedup": pairs.op1_suffix_array_dedup,
    "op2_minhash_near_dedup": pairs.op2_minhash_near_dedup,
    "op3_quality_classifier": models.op3_quality_classifier,
    "op4_language_id": models.op4_language_id,
    "op5_chat_formatting": basic.op5_chat_formatting,
    "op6_document_fingerprints": models.op6_document_fingerprints,
    "op7_bpe_round_trip": basic.op7_bpe_round_trip,
    "op8_secret_scans": basic.op8_secret_scans,
    "op9_embedding_near_dedup": pairs.op9_embedding_near_dedup,
    "op10_source_mixing": basic.op10_source_mixing,
    "language_id_pages": models.language_id_pages,
}
ORACLES = {
    "op1_suffix_array_dedup": oracles.OP1_SQL,
    "op2_minhash_near_dedup": oracles.OP2_SQL,
    "op5_chat_formatting": basic.OP5_SQL,
    "op7_bpe_round_trip": oracles.OP7_SQL,
    "op8_secret_scans": basic.OP8_SQL,
    "op9_embedding_near_dedup": oracles.OP9_SQL,
    "op10_source_mixing": basic.OP10_SQL,
}
