"""Queries over the operators of this subpackage and their SQL counterparts."""

from __future__ import annotations

from panelweave.llm import (
    byte_bpe, content_sort, importance, line_rules, mixing, near_dup, repeats, spellings, token_counts, url_filter, warc, weak_labels, word_windows,
)

QUERIES = {
    "op1_minhash_near_dedup": near_dup.near_query,
    "op2_warc": warc.warc_query,
    "op3_weak_label_quality": weak_labels.quality_query,
    "op4_url_filter": url_filter.urls_query,
    "op5_repeated_spans": repeats.repeats_query,
    "op6_source_mixing": mixing.mixing_query,
    "op7_byte_bpe": byte_bpe.bpe_query,
    "op8_exact_dedup": content_sort.exact_query,
    "op9_quality_rules": line_rules.rules_query,
    "op10_token_counts": token_counts.counts_query,
    "op11_importance_resampling": importance.resampling_query,
    "op12_word_windows": word_windows.windows_query,
    "op13_spelling_variants": spellings.spelling_query,
}
ORACLES = {
    "op4_url_filter": url_filter.URLS_SQL,
    "op6_source_mixing": mixing.MIXING_SQL,
    "op8_exact_dedup": content_sort.EXACT_SQL,
    "op9_quality_rules": line_rules.RULES_SQL,
    "op11_importance_resampling": importance.RESAMPLING_SQL,
    "op12_word_windows": word_windows.WINDOWS_SQL,
    "op13_spelling_variants": spellings.SPELLING_SQL,
}


def _pipeline(spark, folder: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES["pipeline"] = _pipeline
