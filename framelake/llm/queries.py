"""The dealt queries by name, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from . import bpe, chat, conversation_repair, decontamination, exact_dedup, language_id, license_scan, near_dedup, pii, sharding, token_files, toxicity, vector_codes

QUERIES = {
    "op1_shard_matrix": sharding.op1_shard_matrix,
    "op2_license_digest": license_scan.op2_license_digest,
    "op3_simhash": decontamination.op3_simhash,
    "op4_crf": language_id.op4_crf,
    "op5_simple8b": token_files.op5_simple8b,
    "op6_minhash": near_dedup.op6_minhash,
    "op7_surrogates": pii.op7_surrogates,
    "op8_nnpu": toxicity.op8_nnpu,
    "op9_duckdb_bpe": bpe.op9_duckdb_bpe,
    "op10_block_naming": exact_dedup.op10_block_naming,
    "op11_chat_format": chat.op11_chat_format,
    "op12_filtering_lloyd": vector_codes.op12_filtering_lloyd,
    "op13_earley_repair": conversation_repair.op13_earley_repair,
}

ORACLE_SQL = {
    "op2_license_digest": license_scan.oracle(),
    "op10_block_naming": exact_dedup.OP10_SQL,
    "op11_chat_format": chat.OP11_SQL,
    "op12_filtering_lloyd": vector_codes.OP12_SQL,
    "op13_earley_repair": conversation_repair.OP13_SQL,
}
