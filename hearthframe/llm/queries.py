"""The subpackage's queries and their SQL, as the repository's entry module registers them."""

from __future__ import annotations

from . import alignment, contamination, language, lines, mixing, neighbours, ngram_join, pii, quality, resampling, sharding, toxicity, urls

QUERIES = {
    "op1_bootstrapped_pii": pii.op1_bootstrapped_pii,
    "op2_jump_hash_sharding": sharding.op2_jump_hash_sharding,
    "op3_compression_quality": quality.op3_compression_quality,
    "op4_fm_toxicity": toxicity.op4_fm_toxicity,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_line_spread_dedup": lines.op6_line_spread_dedup,
    "op7_hilbert_neighbours": neighbours.op7_hilbert_neighbours,
    "op8_chosen_path_jaccard": ngram_join.op8_chosen_path_jaccard,
    "op9_benchmark_decontamination": contamination.op9_benchmark_decontamination,
    "op10_glob_url_filter": urls.op10_glob_url_filter,
    "op11_centroid_language": language.op11_centroid_language,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_token_alignment": alignment.op13_token_alignment,
}

ORACLE_SQL = {
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op6_line_spread_dedup": lines.ORACLE_SQL,
    "op7_hilbert_neighbours": neighbours.ORACLE_SQL,
    "op8_chosen_path_jaccard": ngram_join.ORACLE_SQL,
    "op9_benchmark_decontamination": contamination.ORACLE_SQL,
    "op10_glob_url_filter": urls.ORACLE_SQL,
    "op12_importance_resampling": resampling.ORACLE_SQL,
}
