"""The operators' queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from docintake.llm import ann, audit, langid, licences, matroska, neardup, packing, quality, runs, tokens, toxicity, urlrules, warc

QUERIES = {
    "op1_nearest_centroid_language": langid.query,
    "op2_matroska_packets": matroska.query,
    "op3_kmeans_tree_search": ann.query,
    "op4_attention_mil_quality": quality.query,
    "op5_seekable_zstd_warc": warc.query,
    "op6_pu_toxicity": toxicity.query,
    "op7_bpe_roundtrip": tokens.query,
    "op8_licence_paragraphs": licences.query,
    "op9_best_fit_packing": packing.query,
    "op10_bbit_minhash": neardup.query,
    "op11_periodic_runs": runs.query,
    "op12_filter_interactions": audit.query,
    "op13_url_trie": urlrules.query,
}

ORACLE_SQL: dict[str, str] = {"op5_seekable_zstd_warc": warc.SQL, "op10_bbit_minhash": neardup.SQL, "op12_filter_interactions": audit.SQL, "op13_url_trie": urlrules.SQL}
