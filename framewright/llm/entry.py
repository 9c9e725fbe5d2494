"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, decontaminate, exact_dedup, html_text, jaccard, language_id, licenses, line_dedup, merkle, packing, quality_rules, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_html_extraction": html_text.op7_html_extraction,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
        "op10_language_id": language_id.op10_language_id,
        "op11_quality_rules": quality_rules.op11_quality_rules,
        "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.OP1_SQL, "op2_exact_dedup": exact_dedup.OP2_SQL, "op13_merkle_manifest": merkle.OP13_SQL}
