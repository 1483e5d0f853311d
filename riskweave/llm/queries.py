"""The queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from riskweave.llm import (
    decontaminate,
    jaccard_join,
    language_id,
    line_dedup,
    pii,
    quality_rules,
    sentencepiece_codec,
    token_store,
    toxicity,
    warc_archive,
)

QUERIES = {
    "op1_warc_archive": warc_archive.op1_warc_archive,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_language_id": language_id.op4_language_id,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_pii": pii.op6_pii,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_token_store": token_store.op9_token_store,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}

ORACLES = warc_archive.ORACLE | quality_rules.ORACLE | line_dedup.ORACLE | decontaminate.ORACLE
