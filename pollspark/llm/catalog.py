"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pollspark.llm import chat, licences, merkle, mixing, packing, pii, quality, simhash, spelling, token_files, topk, trie, unigram

QUERIES = {
    q.__name__: q
    for q in (
        mixing.op1_temperature_mixing,
        packing.op2_best_fit_packing,
        token_files.op3_token_files,
        licences.op4_license_scan,
        pii.op5_personal_data,
        unigram.op6_token_counts,
        simhash.op7_simhash_near_dedup,
        quality.op8_quality_rules,
        chat.op9_chat_formatting,
        merkle.op10_merkle_fingerprints,
        topk.op11_exact_top_k,
        spelling.op12_spelling_variants,
        trie.op13_conversation_trie,
    )
}
SQL = {
    "op1_temperature_mixing": mixing.ORACLE_SQL,
    "op10_merkle_fingerprints": merkle.ORACLE_SQL,
    "op11_exact_top_k": topk.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
    "op13_conversation_trie": trie.ORACLE_SQL,
}
