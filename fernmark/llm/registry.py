"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from fernmark.llm import alignment, chat, decontam, langid, line_dedup, media, mixing, ngram_join, personal_data, resampling, suffix_dedup, token_output, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_langid": langid.op3_langid,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat": chat.op5_chat,
    "op6_decontam": decontam.op6_decontam,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_output": token_output.op9_token_output,
    "op10_media": media.op10_media,
    "op11_alignment": alignment.op11_alignment,
    "op12_resampling": resampling.op12_resampling,
    "op13_personal_data": personal_data.op13_personal_data,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op5_chat": chat.ORACLE,
    "op6_decontam": decontam.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op12_resampling": resampling.ORACLE,
}
