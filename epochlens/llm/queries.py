"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from epochlens.llm import chat_tools, conversation_repair, decontaminate, language_id, lm_scoring, media_avi, pii, quality, ranked_search, sentencepiece_codec, simhash_dedup, substring_dedup, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality": quality.op2_quality,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_chat_tools": chat_tools.op6_chat_tools,
    "op7_pii": pii.op7_pii,
    "op8_media_avi": media_avi.op8_media_avi,
    "op9_simhash": simhash_dedup.op9_simhash,
    "op10_language_id": language_id.op10_language_id,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op6_chat_tools": chat_tools.OP6_SQL,
    "op11_substring_dedup": substring_dedup.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
