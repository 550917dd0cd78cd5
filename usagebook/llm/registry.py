"""The queries of this subpackage and, where SQL can express them, their SQL."""

from usagebook.llm import conversation_repair, decontamination, exact_dedup, filter_audit, langid, near_dedup, pieces, sharding, token_counts, token_files, toxicity, transcripts, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_sharding": sharding.op3_sharding,
    "op4_token_files": token_files.op4_token_files,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": langid.op7_language_id,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_chat_format": transcripts.op10_chat_format,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLE_SQL = {"op8_exact_dedup": exact_dedup.SQL, "op5_warc": warc.SQL, "op11_filter_audit": filter_audit.SQL, "op12_conversation_repair": conversation_repair.SQL}
