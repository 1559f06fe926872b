"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, classifier, exact_dedup, html_main, langid, lm_score, mixing, pii, quality_rules, simhash


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_simhash": simhash.op2_simhash,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_html_extraction": html_main.op5_html_extraction,
        "op6_bpe": bpe.op6_bpe,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_lm_scoring": lm_score.op8_lm_scoring,
        "op9_pii": pii.op9_pii,
        "op10_quality_classifier": classifier.op10_quality_classifier,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op4_mixing": mixing.OP4_SQL}
