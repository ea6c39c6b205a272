"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import conversations, decontaminate, html_extract, language_id, near_dedup, quality_crf, quality_rules, sentencepiece_codec, sharding, substring_dedup, toxicity, variants, warc


def queries() -> dict:
    return {
        "op1_html_extraction": html_extract.op1_html_extraction,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_sharding": sharding.op4_sharding,
        "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
        "op6_quality_crf": quality_crf.op6_quality_crf,
        "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
        "op8_warc": warc.op8_warc,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_language_id": language_id.op12_language_id,
        "op13_spelling_variants": variants.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.sql(), "op2_substring_dedup": substring_dedup.SQL, "op5_minhash_near_dedup": near_dedup.SQL, "op8_warc": warc.SQL, "op9_decontamination": decontaminate.SQL}
