"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from panelscore.llm import circulant, knn, language, lexical, line_dedup, near_join, packing, periodic, repeats, toxicity, url_filter, winnowing


def queries() -> dict:
    return {
        "op1_language_id": language.op1_language_id,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_ngram_jaccard_join": near_join.op3_ngram_jaccard_join,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_substring_dedup": repeats.op5_substring_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_packing": packing.op7_packing,
        "op8_decontamination": winnowing.op8_decontamination,
        "op9_suffix_array_dedup": repeats.op9_suffix_array_dedup,
        "op10_topk_search": knn.op10_topk_search,
        "op11_ranked_lexical_search": lexical.op11_ranked_lexical_search,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_minhash_near_dedup": circulant.op13_minhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": url_filter.ORACLE,
        "op11_ranked_lexical_search": lexical.ORACLE,
        "op12_periodic_runs": periodic.ORACLE,
        "op13_minhash_near_dedup": circulant.ORACLE,
    }
