"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import conversations, decontamination, jaccard, language, language_model, licenses, mixing, oracles, quality, quality_rules, secrets, suffixes, token_counts, whitening

QUERIES = {f.__name__: f for f in (language.op1_language_id, language_model.op2_lm_scores, quality.op3_quality_classifier, jaccard.op4_jaccard_join, secrets.op5_secret_scan, decontamination.op6_decontaminate, mixing.op7_source_mix, suffixes.op8_suffix_dedup, quality_rules.op9_quality_rules, licenses.op10_license_scan, conversations.op11_conversation_repair, whitening.op12_embedding_whitening, token_counts.op13_token_counts)}

ORACLES: dict[str, str] = {
    "op4_jaccard_join": oracles.JACCARD, "op7_source_mix": mixing.ORACLE, "op8_suffix_dedup": oracles.PASSAGES, "op9_quality_rules": oracles.LINE_RULES, "op10_license_scan": licenses.ORACLE, "op11_conversation_repair": conversations.ORACLE,
}
