"""Operators for training-data pipelines over documents, embeddings and pages."""

from memloom.llm import cover_tree, decontamination, fingerprints, jaccard_join, line_dedup, merkle, mixing, packing, ranked_search, secret_scan, span_dedup, toxicity, url_filters

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_embedding_near_dedup": cover_tree.op2_embedding_near_dedup,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_scan_secrets": secret_scan.op5_scan_secrets,
    "op6_sentence_span_dedup": span_dedup.op6_sentence_span_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_decontaminate": decontamination.op13_decontaminate,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_mix_sources": mixing.SQL,
    "op5_scan_secrets": secret_scan.SQL,
    "op8_url_filters": url_filters.SQL,
    "op11_ranked_search": ranked_search.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_decontaminate": decontamination.SQL,
}
