"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, byte_bpe, html_text, language_id, lexical, licences, lm_score, mixing, near_dedup, quality_classifier, quality_rules, resampling, topk


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_licences": licences.op1_licences,
        "op2_bpe": bpe.op2_bpe,
        "op3_lm_score": lm_score.op3_lm_score,
        "op4_language_id": language_id.op4_language_id,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op6_html_text": html_text.op6_html_text,
        "op7_topk": topk.op7_topk,
        "op8_mixing": mixing.op8_mixing,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_resampling": resampling.op11_resampling,
        "op12_lexical": lexical.op12_lexical,
        "op13_byte_bpe": byte_bpe.op13_byte_bpe,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_topk": topk.OP7_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op11_resampling": resampling.OP11_SQL,
        "op12_lexical": lexical.OP12_SQL,
    }
