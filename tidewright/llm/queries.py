"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, language, minhash, mixing, packing, quality, repair, sentence_spans, suffix_dedup, toxicity, trie, warc


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_language_id": language.op5_language_id,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_sentence_spans": sentence_spans.op7_sentence_spans,
        "op8_warc_round_trip": warc.op8_warc_round_trip,
        "op9_pack_documents": packing.op9_pack_documents,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_repair_conversations": repair.op11_repair_conversations,
        "op12_conversation_trie": trie.op12_conversation_trie,
        "op13_byte_bpe": bpe.op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup.OP1_SQL,
        "op2_mix_sources": mixing.OP2_SQL,
        "op4_quality_rules": quality.OP4_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op7_sentence_spans": sentence_spans.OP7_SQL,
        "op8_warc_round_trip": warc.OP8_SQL,
        "op11_repair_conversations": repair.OP11_SQL,
        "op12_conversation_trie": trie.OP12_SQL,
    }
