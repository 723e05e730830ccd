"""The operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedback_engine.llm import alignment, byte_bpe, html, importance, language_id, ngram_join, packing, pieces, quality_classifier, quality_rules, repeats, store, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_repeated_substrings": repeats.op4_repeated_substrings,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_token_store": store.op6_token_store,
    "op7_language_id": language_id.op7_language_id,
    "op8_html_extraction": html.op8_html_extraction,
    "op9_exact_top_k": topk.op9_exact_top_k,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op9_exact_top_k": topk.OP9_SQL,
    "op13_importance_resampling": importance.OP13_SQL,
}
