"""Queries of the corpus operators, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from . import chat, filter_audit, jaccard, language_id, media, packing, pieces, secrets_scan, toxicity, url_lists, vector_codes, voronoi, warc

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_language_id": language_id.op2_language_id,
    "op3_media_columns": media.op3_media_columns,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_voronoi_top_k": voronoi.op5_voronoi_top_k,
    "op6_secret_scans": secrets_scan.op6_secret_scans,
    "op7_url_filters": url_lists.op7_url_filters,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_warc": warc.op11_warc,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": jaccard.ORACLE_SQL,
    "op5_voronoi_top_k": voronoi.ORACLE_SQL,
    "op6_secret_scans": secrets_scan.ORACLE_SQL,
    "op7_url_filters": url_lists.ORACLE_SQL,
    "op9_chat_formatting": chat.ORACLE_SQL,
    "op11_warc": warc.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
