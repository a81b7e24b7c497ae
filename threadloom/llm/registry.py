"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from threadloom.llm import chat, crossentropy, decontaminate, html, jaccard, language, mixing, neardup, quality, toxicity

QUERIES = {
    "op1_quality_classifier": quality.quality_query,
    "op2_toxicity": toxicity.toxicity_query,
    "op3_language_id": language.language_query,
    "op4_ngram_jaccard_join": jaccard.jaccard_query,
    "op5_decontamination": decontaminate.decontamination_query,
    "op6_chat_formatting": chat.chat_query,
    "op7_source_mixing": mixing.mixing_query,
    "op8_html_extraction": html.extraction_query,
    "op9_lm_scoring": crossentropy.scoring_query,
    "op10_embedding_neardup": neardup.neardup_query,
}

ORACLE_SQL = {
    "op4_ngram_jaccard_join": jaccard.JACCARD_SQL,
    "op6_chat_formatting": chat.CHAT_SQL,
    "op7_source_mixing": mixing.decide_sql("documents"),
    "op10_embedding_neardup": neardup.NEARDUP_SQL,
}
